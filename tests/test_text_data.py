import random
import pytest
from pyspark.sql import functions as F

from vlprep.config import PRETRAIN
from vlprep.functions import text
from vlprep.operators import batching, dialogue, filters, metrics, tokens
from vlprep.plans import captions, dialogues
from vlprep.session import cut

PROMPTS = ["Say what you see.", "What is this?"]


def caption_rows(spark):
    values = [None, "", " ", "one", "two words"] + [" ".join(["w"] * n) for n in (126, 127, 128)]
    return spark.createDataFrame(list(enumerate(values)), "id bigint, text string")


@pytest.mark.parametrize("append_end, kept", [(True, {3, 4, 5}), (False, {4, 5, 6})])
def test_caption_window(spark, append_end, kept):
    out = filters.filter_captions(caption_rows(spark), "text", append_end)
    assert {r.id for r in out.collect()} == kept


def test_caption_window_over_long_text_is_exact(spark):
    df = spark.createDataFrame([(1, "x " * 200_000), (2, "x " * 100 + " " * 500_000)], "id bigint, text string")
    assert [r.id for r in filters.filter_captions(df, "text", True).collect()] == [2]


@pytest.mark.parametrize("high", [128, 5000])
def test_word_windows_by_match_and_by_count_agree(spark, sf, high):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, ""), (-2, " \t\n"), (-3, " a"), (-4, "a "), (-5, " a\r\n b "), (-6, "a\u00a0b c")], "doc_id bigint, text string")
    )
    t = F.col("text")
    for low in (-1, 0, 1, 2, 40):
        odd = docs.filter(text.words_between(t, low, high) != ((text.count_words(t) > low) & (text.count_words(t) < high)))
        assert odd.count() == 0


def test_required_members(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "c")], "id int, jpg string, json string")
    assert [r.json for r in filters.to_columns(df, ["jpg", "json"]).collect()] == ["c"]
    with pytest.raises(Exception, match="sample without member 'json'"):
        filters.to_columns(df, ["jpg", "json"], missing="error").collect()
    with pytest.raises(ValueError):
        filters.to_columns(df, ["jpg"], missing="x")


def test_disjoint_ignores_case_and_margins(spark):
    new = spark.createDataFrame([("A b",), (" a B ",), ("c",), (None,)], "text string")
    used = spark.createDataFrame([("a b",), ("a b",), (None,)], "text string")
    assert {r.text for r in filters.disjoint(new, used).collect()} == {"c", None}


def test_vocabulary_order_and_encoding_paths(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "b a b c"), (2, "a d"), (3, ""), (4, None)], "id bigint, text string")
    vocab = tokens.build_vocab(docs, "text", 3)
    assert [(r.word, r.token_id) for r in vocab.orderBy("token_id").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    listed = docs.select("id", text.words(F.col("text")).alias("w"))
    expected = {1: [1, 0, 1, 2], 2: [0, 9], 3: [], 4: None}

    def encoded(method):
        return {r.id: r.ids for r in tokens.encode(listed, "w", vocab, 9, "id", method).collect()}

    assert encoded("lookup") == expected
    assert encoded("join") == expected
    # a vocabulary over the broadcast limit: its head by broadcast, its tail by shuffle
    monkeypatch.setattr(tokens, "BROADCAST_ROWS", 1)
    assert encoded("auto") == expected
    # words that the vocabulary can't hold are told apart before anything is shuffled
    asked = spark.createDataFrame([(w,) for w in "abcdefghijklmnop"], "word string")
    kept = {r.word for r in tokens.may_hold(asked, vocab).collect()}
    assert {"a", "b", "c"} <= kept and len(kept) < 6
    many = spark.range(5000).select(F.concat(F.lit("w"), "id").alias("word"))
    assert tokens.may_hold(many, many).count() == 5000
    assert tokens.may_hold(many.select(F.concat("word", F.lit("x")).alias("word")), many).count() < 50
    with pytest.raises(ValueError):
        encoded("lookup")
    # without row_id too: size never decides whether a call works
    assert {r.id: r.ids for r in tokens.encode(listed, "w", vocab, 9).collect()} == expected


def test_vocabulary_of_ties(spark):
    """Of the words with the border's count, the first by name; as many as fit."""
    words = [w for i in range(40) for w in [f"w{i:02d}"] * (1 + i // 10)]
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    ranked = sorted({w: words.count(w) for w in words}.items(), key=lambda x: (-x[1], x[0]))
    for size in (0, 10, 11, 25, 50):
        got = [(r.word, r.n) for r in tokens.build_vocab(df, "text", size).orderBy("token_id").collect()]
        assert got == ranked[:size]


def test_long_lists_by_join(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BROADCAST_ROWS", 3)
    rng = random.Random(2)
    vocab = spark.createDataFrame([(f"w{i}", i) for i in range(50)], "word string, token_id long")
    rows = [(i, [rng.choice([f"w{rng.randrange(80)}", None, ""]) for _ in range(rng.choice([0, 1, 300]))]) for i in range(20)] + [(99, None)]
    out = tokens.encode(spark.createDataFrame(rows, "id long, w array<string>"), "w", vocab, -1, "id", "join")
    want = {i: None if ws is None else [int(w[1:]) if w and int(w[1:]) < 50 else -1 for w in ws] for i, ws in rows}
    assert {r.id: r.ids for r in out.collect()} == want


def test_join_gives_python_few_bytes_at_a_time(spark, monkeypatch):
    """Nothing but the lookup of the head runs in Python, at some MB a batch; repeated rows are encoded alike."""
    monkeypatch.setattr(tokens, "BROADCAST_ROWS", 3)
    sizes = []
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    monkeypatch.setattr(tokens, "cut", lambda df: sizes.append(int(spark.conf.get(name))) or cut(df))
    before = spark.conf.get(name)
    vocab = spark.createDataFrame([(f"w{i}", i) for i in range(50)], "word string, token_id long")
    rows = [(i // 2, [f"w{i // 2 + j}" for j in range(9)]) for i in range(80)]
    out = tokens.encode(spark.createDataFrame(rows, "id long, w array<string>"), "w", vocab, -1, "id", "join")
    assert sizes and sizes[-1] <= 4 << 20 and spark.conf.get(name) == before
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.id, r.ids) for r in out.collect())
    assert got == [(i, [int(w[1:]) if int(w[1:]) < 50 else -1 for w in ws]) for i, ws in rows]


def test_lookup_keeps_sliced_and_null_rows_apart(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", text.words(F.col("text")).alias("w"))
    holes = docs.withColumn("w", F.when(F.col("doc_id") % 3 != 0, F.col("w")))
    vocab = tokens.build_vocab(spark.read.parquet(f"{sf}/documents.parquet"), "text", 50)
    out = tokens.encode(holes, "w", vocab, 50, method="lookup")
    assert out.filter(F.col("w").isNull() != F.col("ids").isNull()).count() == 0
    assert out.filter(F.size("w") != F.size("ids")).count() == 0


def test_encode_with_runs_the_loader_per_worker(spark):
    df = spark.createDataFrame([("a bb",), (None,)], "text string")

    def loader():
        return lambda s: [len(w) for w in s.split()]

    assert [r.ids for r in tokens.encode_with(df, "text", loader).collect()] == [[1, 2], None]


def test_prompt_is_a_prefix_of_the_full_sample(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = tokens.caption_samples(docs, "doc_id", "text", PROMPTS, seed=1).collect()
    assert rows and {r.prompt for r in rows} <= set(PROMPTS)
    for r in rows:
        n = len(r.prompt_tokens)
        assert r.full_tokens[:n] == r.prompt_tokens
        assert 1 < len(r.caption_tokens) < 128


def turns(spark, dialogs):
    rows = [(c, t, role, body) for c, messages in dialogs.items() for t, (role, body) in enumerate(messages)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


U, A = ("user", "q"), ("assistant", "a")
EDGE = {
    1: [U, A],
    2: [("system", "s"), U, A, U, A, U, A],
    3: [U, A, U, A, U, A, ("assistant", "bad"), ("assistant", "")],  # only the fourth pair is bad
    4: [A, U],
    5: [("user", ""), A],
    6: [U, A, U],                                                      # unanswered before the third pair
    7: [U, A, U, A, U, A, U],                                          # unanswered after it
    8: [("system", "s")],
    9: [U, ("assistant", "")],
    10: [U],
}


@pytest.mark.parametrize("options, kept", [
    ({}, {1: 1, 2: 3, 3: 3, 7: 3}),
    ({"on_dangling": "truncate"}, {1: 1, 2: 3, 3: 3, 6: 1, 7: 3}),
    ({"on_dangling": "truncate", "keep_empty": True}, {1: 1, 2: 3, 3: 3, 6: 1, 7: 3, 10: 0}),
    ({"max_pairs": 1}, {1: 1, 2: 1, 3: 1, 6: 1, 7: 1}),
])
def test_dialogue_rules(spark, options, kept):
    out = dialogue.dialogue_samples(turns(spark, EDGE), **options)
    assert {r.conv_id: r.n_pairs for r in out.collect()} == kept


def test_nested_dialogues(spark):
    content = lambda ms: [{"from": {"assistant": "gpt"}.get(r, r), "value": v} for r, v in ms]
    docs = [
        {"image_id": 1, "conversations": [{"topic": "x", "content": content(EDGE[1])}, {"topic": "y", "content": content(EDGE[3])}, {"topic": "z", "content": content(EDGE[6])}]},
        {"image_id": 2, "conversations": [{"topic": "x", "content": content(EDGE[1])}]},
        {"image_id": 3, "conversations": [{"topic": "e", "content": []}]},
    ]
    from vlprep.sources.tables import DIALOGUE

    df = spark.createDataFrame(docs, DIALOGUE)
    images = spark.createDataFrame([(1,), (3,)], "image_id bigint")
    got = {(r.image_id, r.topic): r.text for r in dialogue.nested_samples(df, images).collect()}
    assert set(got) == {(1, "x"), (1, "y")}
    assert got[1, "x"] == (
        "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n"
        "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    )
    kept = dialogue.nested_samples(df, images, keep_empty=True).filter("n_pairs = 0").collect()
    assert [r.image_id for r in kept] == [3]


def test_hot_conversation_is_reduced_before_the_shuffle(spark):
    hot = spark.range(30_000).select(
        F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("t").alias("text"),
    )
    out = dialogue.dialogue_samples(hot.unionByName(turns(spark, EDGE).withColumn("conv_id", F.col("conv_id") + 100)))
    assert {r.conv_id: r.n_pairs for r in out.collect()}[1] == 3
    assert "row_number(), 6, Partial" in out._jdf.queryExecution().executedPlan().toString()
    pairs = dialogue.pair_turns(hot)
    assert pairs.count() == 15_000 and pairs.filter("answer IS NULL").count() == 0


def test_turn_pairs(spark):
    got = {(r.conv_id, r.pair): (r.question_role, r.answer_role) for r in dialogue.pair_turns(turns(spark, EDGE)).collect()}
    assert got[6, 0] == ("user", "assistant") and got[6, 1] == ("user", None)
    assert got[2, 2] == ("user", "assistant") and (8, 0) not in got
    assert got[4, 0] == ("assistant", "user")


@pytest.mark.parametrize("chunk", [1, 2, 3, 64])
def test_history_prompts_are_all_turns_before(spark, chunk):
    talk = {1: [("system", "s")] + [(("user", "assistant")[i % 2], f"m{i}") for i in range(9)], 2: [U, A]}
    df = turns(spark, talk)
    chunks = {(r.conv_id, r.chunk): r.text for r in dialogue.transcript_chunks(df, chunk=chunk).collect()}
    history = dialogue.history_prompts(df, chunk=chunk)
    rows = history.collect()
    assert len(rows) == 5
    whole = {(r.conv_id, r.n_messages): r.prompt for r in dialogue.whole_prompts(history, dialogue.transcript_chunks(df, chunk=chunk)).collect()}
    for r in rows:
        spoken = [m for m in talk[r.conv_id] if m[0] != "system"]
        full = "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n"
        full += "".join(f"<|im_start|>{role}\n{body}<|im_end|>\n" for role, body in spoken[: r.n_messages])
        prompt = "".join(chunks[r.conv_id, c] for c in range(r.prior_chunks)) + r.prompt_tail
        assert prompt == full + "<|im_start|>assistant\n" == whole[r.conv_id, r.n_messages]


def test_padding_masks_and_counts_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = batching.pad_batch(captions.contrastive_batches(docs, "doc_id", "text", 8, seed=1)).collect()
    for batch in {r.batch_id for r in rows}:
        part = [r for r in rows if r.batch_id == batch]
        width = max(len(r.ids) for r in part)
        for r in part:
            assert len(r.input_ids) == len(r.attention_mask) == width
            assert sum(r.attention_mask) == len(r.ids) and r.input_ids[: len(r.ids)] == r.ids


def test_prefix_extends_ids_mask_and_labels_together(spark):
    df = spark.createDataFrame([(0, [5, 6], 1), (0, [7], 1)], "batch_id int, ids array<int>, prompt_len int")
    rows = batching.make_labels(batching.pad_batch(df), PRETRAIN)
    out = batching.extend_prefix(rows, positions=196, image_id=3, start_id=1, end_id=2).collect()
    for r in out:
        assert len(r.input_ids) == len(r.attention_mask) == len(r.labels) == 200
        assert r.attention_mask[:198] == [1] * 198 and r.labels[:198] == [-100] * 198
        assert r.input_ids[:198] == [1] + [3] * 196 + [2]


def test_label_stats_and_masked_mean(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = captions.captioning_batches(docs, "doc_id", "text", 8, PROMPTS, 1, PRETRAIN)
    got = {r.batch_id: r for r in batching.label_stats(rows).collect()}
    losses = rows.withColumn("losses", F.transform("input_ids", lambda x: x * 1.0))
    means = {r.batch_id: r for r in metrics.masked_mean(losses, "losses", "labels", "batch_id").collect()}
    for batch, r in got.items():
        part = [x for x in rows.filter(F.col("batch_id") == batch).collect()]
        kept = [(i, y) for x in part for i, y in zip(x.input_ids, x.labels) if y != -100]
        assert r.supervised_tokens == len(kept) == means[batch].n_tokens
        assert means[batch].loss == pytest.approx(sum(i for i, _ in kept) / len(kept))
        break


def test_finetune_rows_have_one_split_each(spark, sf):
    talk = spark.read.parquet(f"{sf}/conversations.parquet")
    images = talk.select("conv_id").distinct()
    rows = dialogues.finetune_rows(talk, images, seed=1, val=3).collect()
    assert len(rows) == len({r.conv_id for r in rows}) and sum(r.split == "val" for r in rows) == min(3, len(rows))
