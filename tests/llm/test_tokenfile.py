import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vlprep.llm import common
from vlprep.llm.queries import tokenizer_path
from vlprep.llm.tokenfile import FileWriter, PieceEncoder, TokenFile, read_index, token_index, write_tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path())
    return found


def test_pieces_give_the_ids_of_the_whole(tokenizer):
    rng = random.Random(6)
    parts = [" ", "  ", "\n", "\t", "a", "Bc", "'s", "12", "!?", "é", " ", "　", "<|endoftext|>", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["".join(rng.choice(["ab ", "\n", " ", "c", "\x85", "\u2003", "\x1c", "<|endoftext|>", "Ġ", "9"]) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    texts += ["", " ", "x" * 10_000, " " * 500 + "y", "<|endoftext|>"]
    encoder = PieceEncoder(tokenizer_path(), cache_pieces=50)
    for i in range(0, len(texts), 100):
        part = texts[i : i + 100]
        ids, sizes = encoder.encode(pa.array(part))
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in part]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]
        ids, sizes = encoder.encode(pa.array(part), 2)
        assert ids.tolist() == [x for w in want for x in (*w, 2)]


def test_finer_cuts_give_the_ids_of_the_whole(tokenizer):
    rng = random.Random(7)
    parts = ["word", "Öl", "où", "x", "e\u0301", "\u0301", "д", "字", "か", "\U0001f600", "\U00010400", "١", "²", "ª", "×", "\u2019", "\u201c", "\u2014", "\xad", "7", "2019", ".", ",", "!'", "'", "'s", "'re", "'S", "(", "_"]
    parts += [" ", "  ", "\n", "\n\n", "\r\n", " \n", "\t", "\x0b", "\x1c", "\x7f", "\0", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u200b", "\u2028", "\u3000", "\ufeff", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 12))) for _ in range(12_000)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    column = pa.array(texts)
    for encoder in (PieceEncoder(tokenizer_path(), cache_pieces=200), PieceEncoder(tokenizer_path())):
        for i in range(0, len(texts), 400):
            ids, sizes = encoder.encode(column.slice(i, 400))
            assert sizes.tolist() == list(map(len, want[i : i + 400])) and ids.tolist() == [x for w in want[i : i + 400] for x in w]
    ids, sizes = encoder.encode(column.cast(pa.large_string()).slice(5, 3000), 2)
    assert ids.tolist() == [x for w in want[5:3005] for x in (*w, 2)] and sizes.sum() == len(ids)
    for i, text in enumerate(["x.\nY", "a ", " ", "\n", "", " b\n", "\n c"]):  # what ends one text does not meet the next
        assert encoder.encode(pa.array([text, "Z", text]))[0].tolist() == [x for t in (text, "Z", text) for x in tokenizer.encode(t, add_special_tokens=False).ids], i


def test_tokenizers_of_other_patterns_are_cut_at_spaces_only(tmp_path):
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    other = Tokenizer.from_file(tokenizer_path())
    split = pre_tokenizers.Split(Regex(r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"), "isolated")
    other.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    other.add_special_tokens(["two words"])
    other.save(f"{tmp_path}/other.json")
    texts = ["say (word),\nNext.\n\nlast 12345 don't .end\n", "two", "is two and words to it", "ab.cd\nef"]
    ids, sizes = PieceEncoder(f"{tmp_path}/other.json").encode(pa.array(texts))
    want = [other.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [x for w in want for x in w] and sizes.tolist() == list(map(len, want))


def heard(encoder):
    """What the encoder gives to its tokenizer from now on."""
    alone, given = encoder._alone, []
    encoder._alone = lambda texts: [given.extend(texts), alone(texts)][1]
    return given


def test_words_are_encoded_once_whatever_stands_around_them():
    encoder = PieceEncoder(tokenizer_path())
    words = [f"{a}{b}qu" for a in "bcdfghjklmnp" for b in "aeiouäé"]
    encoder.encode(pa.array([" ".join(["A", *words]) + " .\n,"]))
    encoder.encode(pa.array(["\n".join(["A", *words])]))
    given = heard(encoder)
    encoder.encode(pa.array([" ".join(f"{w}{end}" for w in words for end in (".", ",", ".\nA", "!", "?!"))]))
    assert sum(map(len, given)) < 20


def test_pieces_seen_often_outlast_a_full_cache():
    encoder = PieceEncoder(tokenizer_path(), cache_pieces=300)
    often = [f"b{a}{b}t" for a in "aeiou" for b in "aeioulmnrs"]
    for i in range(30):
        given = heard(encoder) if i == 10 else [] if i < 10 else given
        once = [" " + "".join("abcdefghij"[int(d)] for d in f"{i:03d}{k:03d}") for k in range(100)]
        encoder.encode(pa.array([" " + " ".join(often) + "".join(once)]))
        assert len(encoder.place) <= 300 + 150
    assert not any(f" {w}" in text for w in often for text in given)


def test_special_tokens_as_text(tokenizer):
    text = "<|endoftext|> hi a<|endoftext|>"
    plain, as_text = (PieceEncoder(tokenizer_path(), special_as_text=flag).encode(pa.array([text]))[0].tolist() for flag in (False, True))
    assert plain == tokenizer.encode(text, add_special_tokens=False).ids and plain.count(50256) == 2
    tokenizer.encode_special_tokens = True
    assert as_text == tokenizer.encode(text, add_special_tokens=False).ids and 50256 not in as_text
    tokenizer.encode_special_tokens = False


@pytest.mark.parametrize("n", [1, 127, 128, 129, 1000])
@pytest.mark.parametrize("high", [0, 1, 255, 50_256, 2**32 - 1])
def test_blocks_give_the_ids_back(n, high):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, high, n, dtype=np.uint32, endpoint=True)
    ids[:: 40] = rng.integers(0, 2**32, len(ids[::40]), dtype=np.uint32)  # outliers
    writer = FileWriter()
    writer.CHUNK = 300
    for i in range(0, n, 70):
        part = ids[i : i + 70]
        writer.add([i, i + 1], [3 if len(part) > 3 else 0, len(part) - (3 if len(part) > 3 else 0)], part)
    assert writer.finish()[1] == n
    file = TokenFile(writer.sink.getvalue())
    assert file.ids(0, n).tolist() == ids.tolist()
    for _ in range(20):
        a, b = sorted(rng.integers(0, n + 1, 2))
        assert file.ids(int(a), int(b)).tolist() == ids[a:b].tolist()


def test_outliers_do_not_widen_blocks():
    small = np.arange(1280, dtype=np.uint32) % 16
    odd = small.copy()
    odd[::128] = 2**31
    size = {}
    for name, ids in (("small", small), ("odd", odd)):
        writer = FileWriter()
        writer.add([1], [len(ids)], ids)
        writer.finish()
        size[name] = len(writer.sink.getvalue())
    assert size["odd"] == size["small"] + 10 * 5


def expected(rows, tokenizer):
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_documents_in_order(spark, docs_of, tokenizer):
    rng = random.Random(1)
    rows = [(rng.randrange(10**12), " ".join(rng.choice(["The", "tok", "éa", "x,"]) for _ in range(rng.choice([0, 5, 300])))) for _ in range(200)]
    rows += [(3, None), (4, ""), (5, "w " * 100_000), (6, "twice"), (6, "twice"), (6, "other"), (None, "no id")]
    got = sorted(tuple(r) for r in token_index(docs_of(rows, 7), tokenizer_path()).collect() if r["doc_id"] is not None)
    nulls = [tuple(r) for r in token_index(docs_of(rows, 5), tokenizer_path()).filter("doc_id is null").collect()]
    want = expected(rows, tokenizer)
    assert got == sorted(r for r in want if r[0] is not None)
    assert nulls == [r for r in want if r[0] is None]


def test_other_orders_and_odd_tables(spark, docs_of, tmp_path, tokenizer):
    rows = [(i, f"text {i}") for i in range(30)]
    docs = docs_of(rows).withColumn("key", -F.col("doc_id")).withColumn("path", F.lit("clash"))
    files = write_tokens(docs, f"file://{tmp_path}/files", tokenizer_path(), order=["key"])
    got = sorted((r["start"], r["doc_id"]) for r in read_index(files).collect())
    assert [d for _, d in got] == list(range(29, -1, -1))
    assert token_index(docs_of([]).limit(0), tokenizer_path()).collect() == []


def test_stored_rows_stay_in_their_files(spark, docs_of, tmp_path, tokenizer):
    rows = [(i, f"text {i} " * (i % 7)) for i in range(200)]
    docs_of(rows).orderBy("doc_id").repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    placed = docs.select("doc_id", "text", part.alias("_part"), F.col("_metadata.row_index").alias("_row"))
    files = write_tokens(placed, f"file://{tmp_path}/files", tokenizer_path(), placed=True)
    assert "Exchange" not in placed._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["start"], *r[:1], *r[2:]) for r in read_index(files).collect())
    assert [(d, s, n, c) for s, d, n, c in got] == expected(rows, tokenizer)
    # a row missing in the middle of a file begins a new one
    files = write_tokens(placed.filter("doc_id != 50"), f"file://{tmp_path}/more", tokenizer_path(), placed=True)
    got = sorted((r["start"], *r[:1], *r[2:]) for r in read_index(files).collect())
    assert [(d, s, n, c) for s, d, n, c in got] == expected([r for r in rows if r[0] != 50], tokenizer)


def test_workers_let_encoders_go_for_other_work():
    kept = common.worker_cache("token encoders")
    kept["some file"] = PieceEncoder(tokenizer_path())
    batch = pa.RecordBatch.from_pydict({"text": ["a b", None]})
    assert [len(texts) for _, texts in common.steps(iter([batch]))] == [2]
    assert not common.worker_cache("token encoders")
