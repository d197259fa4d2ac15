import hashlib
import math

import pytest
from pyspark.sql import functions as F

from vlprep.config import FINETUNE, PRETRAIN, STRICT
from vlprep.functions import arrays, keys, text, vectors


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def ints(*values):
    return F.array(*[F.lit(v).cast("int") for v in values]) if values else F.array().cast("array<int>")


def test_hash_key_is_md5_of_seed_and_parts(spark):
    row = one(spark, k=keys.hash_key(7, F.lit(3), F.lit("a")))
    assert row.k == hashlib.md5(b"7:3:a").hexdigest()


def test_key_numbers_stay_in_range(spark):
    df = spark.range(500).select(keys.hash_key(1, "id").alias("k"))
    row = df.select(keys.key_choice(F.col("k"), 11).alias("c"), keys.key_uniform(F.col("k")).alias("u")).agg(
        F.min("c"), F.max("c"), F.min("u"), F.max("u"), F.countDistinct("c")
    ).first()
    assert row[0] == 0 and row[1] == 10 and 0 <= row[2] and row[3] < 1 and row[4] == 11


@pytest.mark.parametrize("n, kept", [(0, False), (1, False), (2, True), (126, True), (127, True), (128, False), (129, False)])
def test_length_window_is_open_on_both_sides(spark, n, kept):
    assert one(spark, ok=arrays.length_between(F.lit(n))).ok is kept


def test_white_space_is_text_but_empty_is_not(spark):
    df = spark.createDataFrame([(None,), ("",), (" ",), ("a",)], "t string")
    assert [r.t for r in df.filter(text.has_text(F.col("t"))).collect()] == [" ", "a"]


def test_words_and_ids(spark):
    row = one(spark, w=text.words(F.lit("a  bc\n d")), n=text.count_words(F.lit("a  bc\n d")),
              ids=text.with_end(text.hash_ids(text.words(F.lit("a bc")), 100, 2), 1))
    assert row.w == ["a", "bc", "d"] and row.n == 3
    expected = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 100 + 2 for w in ("a", "bc")]
    assert row.ids == expected + [1]


def test_chat_rendering(spark):
    chat = F.array(text.system_message("S"), text.message("user", "hi"))
    row = one(spark, plain=text.render_chat(chat), ask=text.render_chat(chat, add_generation_prompt=True),
              own=text.render_chat(chat, template=lambda role, content: F.concat(role, F.lit(":"), content, F.lit(";"))))
    assert row.plain == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
    assert row.ask == row.plain + "<|im_start|>assistant\n"
    assert row.own == "system:S;user:hi;"


@pytest.mark.parametrize("raw, prompt, clean", [
    ("Q: \n<|im_start|>yes<|im_end|>\n", 2, "yes"),
    (" plain ", 0, "plain"),
    ("<|im_start|> padded <|im_end|>", 0, " padded "),
    ("<|im_end|>", 0, ""),
    ("a<|im_end|>b", 0, "a<|im_end|>b"),
    ("ab", 5, ""),
])
def test_response_cleaning_trims_once_before_the_marks(spark, raw, prompt, clean):
    assert one(spark, c=text.clean_response(F.lit(raw), prompt)).c == clean


def test_prompt_pick_is_seeded_and_from_the_list(spark):
    df = spark.range(300).select("id", text.pick_prompt("id", ["a", "b", "c"], 1).alias("p"))
    first = {r.id: r.p for r in df.collect()}
    assert set(first.values()) == {"a", "b", "c"}
    assert first == {r.id: r.p for r in df.repartition(7).collect()}


def test_json_member_of_bad_text_is_null(spark):
    df = spark.createDataFrame([('{"caption": "x"}',), ("{",), ('{"other": 1}',)], "j string")
    assert [r[0] for r in df.select(text.json_member(F.col("j"), "caption", "string")).collect()] == ["x", None, None]


@pytest.mark.parametrize("ids", [[5], [5, 6, 7], [1, 2, 3, 4, 5, 6, 7]])
@pytest.mark.parametrize("prompt", [0, 2, 7])
@pytest.mark.parametrize("rule", [PRETRAIN, FINETUNE, STRICT])
def test_labels(spark, ids, prompt, rule):
    width = 7
    row = one(spark, p=arrays.pad(ints(*ids), F.lit(width)), m=arrays.mask(ints(*ids), F.lit(width)),
              y=arrays.labels(ints(*ids), F.lit(width), F.lit(prompt), rule))
    n = len(ids)
    assert row.p == ids + [0] * (width - n)
    assert row.m == [1] * n + [0] * (width - n)
    expected = [
        -100 if (rule.mask_prompt and i < min(prompt, n)) or (rule.mask_pad and i >= n) else (ids + [0] * width)[i]
        for i in range(width)
    ]
    assert row.y == expected


def test_prefix_extension(spark):
    row = one(spark, a=arrays.prefixed(ints(1, 2), -100, 3), b=arrays.prefixed(ints(1, 2), 1, 3, brackets=False),
              c=arrays.prefixed_ids(ints(1), 9, 7, 8, 2), d=arrays.prefixed_ids(ints(1), 9, 7, 8, 2, brackets=False))
    assert row.a == [-100] * 5 + [1, 2] and row.b == [1, 1, 1, 1, 2]
    assert row.c == [7, 9, 9, 8, 1] and row.d == [9, 9, 1]


@pytest.mark.parametrize("ids, mask, prompt, kept, finish", [
    ([1, 9, 3, 9, 4], [1] * 5, 2, [1, 9, 3], 3),          # a stop in the prompt does not count
    ([1, 2, 3, 0, 0], [1, 1, 1, 0, 0], 1, [1, 2, 3], None),  # unfinished: cut at the mask
    ([1, 2, 9, 9, 9], [1] * 5, 2, [1, 2], 2),
    ([1, 2, 3, 9, 0], [1, 1, 1, 0, 0], 1, [1, 2, 3], None),  # beyond the mask
])
def test_generation_cut(spark, ids, mask, prompt, kept, finish):
    cut = one(spark, c=arrays.cut_at_stop(ints(*ids), ints(*mask), F.lit(prompt), 9)).c
    assert cut.answer_ids == kept and cut.finish_index == finish


def doubles(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_normalise_keeps_the_zero_vector(spark):
    row = one(spark, u=vectors.l2_normalize(doubles(3, 4)), z=vectors.l2_normalize(doubles(0, 0)))
    assert row.u == pytest.approx([0.6, 0.8]) and row.z == [0.0, 0.0]


def test_scaler_is_clamped(spark):
    row = one(spark, a=vectors.scaler(), b=vectors.scaler(10.0))
    assert row.a == pytest.approx(math.exp(0.07)) and row.b == 100.0


def test_softmax_and_choice(spark):
    row = one(spark, p=vectors.softmax(doubles(1, 2, 3), 0.5), top=vectors.argmax(doubles(1, 5, 5)),
              big=vectors.softmax(doubles(1000, 0)))
    e = [math.exp(2 * v) for v in (1, 2, 3)]
    assert row.p == pytest.approx([v / sum(e) for v in e])
    assert row.top == 1 and row.big == [1.0, 0.0]


@pytest.mark.parametrize("u, at", [(0.0, 0), (0.19, 0), (0.2, 1), (0.69, 1), (0.71, 2), (0.9999, 2)])
def test_draw_inverts_the_distribution(spark, u, at):
    assert one(spark, d=vectors.draw(doubles(0.2, 0.5, 0.3), F.lit(u))).d == at


def test_drawn_tokens_follow_the_probabilities(spark):
    logits = doubles(math.log(0.1), math.log(0.9))
    share = spark.range(4000).select(vectors.select_token(logits, 1.0, "id", 3).alias("t")).agg(F.avg("t")).first()[0]
    assert share == pytest.approx(0.9, abs=0.02)


def test_pooling(spark):
    t = F.array(doubles(1, 2), doubles(3, 4), doubles(5, 6))
    row = one(spark, a=vectors.pool(t, "first"), b=vectors.pool(t, "last"), c=vectors.pool(t, "last", F.lit(2)), d=vectors.pool(t, "rest"))
    assert row.a == [1, 2] and row.b == [5, 6] and row.c == [3, 4] and row.d == [[3, 4], [5, 6]]
    with pytest.raises(ValueError):
        vectors.pool(t, "mean")
