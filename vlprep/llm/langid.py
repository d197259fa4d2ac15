"""Language of texts: averaged embeddings of hashed subwords under a linear softmax.

Subwords are the 3 and 4 byte pieces of the lower-cased text with every run of
ASCII non-letters read as one space. Each falls into one of ``2 * SLOTS`` embeddings; a
text is the mean of its subwords' embeddings, and a linear softmax gives the
language. Embeddings and weights are trained together by stochastic gradient
descent in numpy on a bounded sample of labelled rows, whose whole texts are
counted by subword in Spark tasks. A temperature fitted on sample rows kept
back calibrates the probabilities, and a text whose calibrated probability is
under ``REJECT_BELOW`` is rejected: the guess is then more likely wrong than right.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vlprep.llm.common import renamed, slices, small, steps, stored

SLOT_BITS = 15
SLOTS = 1 << SLOT_BITS
DIM = 16
EPOCHS = 6
RATE = 10.0
BATCH = 32
LEAST_STEPS = 450
REJECT_BELOW = 0.5
#: Most labelled rows a language gives to the sample, and most languages.
ROWS_PER_LANGUAGE = 600
LANGUAGES = 512

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B], np.uint32)


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding numbers of all subwords of some lower-cased texts, and the text each belongs to."""
    raw = np.frombuffer(b" " + b"\n".join(texts) + b"\n", np.uint8)
    letter = _LETTER[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    code = np.where(letter, raw, np.uint8(32))[keep].astype(np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    owner = np.concatenate([[0], owner]).astype(np.int32)[keep]
    slots, owners = [], []
    for k, size in enumerate((3, 4)):
        n = len(code) - size + 1
        if n <= 0:
            continue
        piece = code[:n].copy()
        for j in range(1, size):
            piece |= code[j : n + j] << np.uint32(8 * j)
        # the space before a text is the last byte kept of the one before
        whole = owner[1 : n + 1] == owner[size - 1 : size - 1 + n]
        slots.append(((piece[whole] * _FACTORS[k]) >> np.uint32(32 - SLOT_BITS)).astype(np.int64) + k * SLOTS)
        owners.append(owner[1 : n + 1][whole])
    return (np.concatenate(slots), np.concatenate(owners)) if slots else (np.empty(0, np.int64), np.empty(0, np.int32))


def _lower(batches, text: str = "_text"):
    for batch in batches:
        yield batch.set_column(batch.schema.get_field_index(text), text, pc.utf8_lower(batch.column(text)))


def _count_rows(batches):
    for batch, texts in steps(_lower(slices(batches, "_text")), "_text"):
        slots, owners = subwords(texts)
        keys, counts = np.unique(owners.astype(np.int64) * (2 * SLOTS) + slots, return_counts=True)
        cut = np.searchsorted(keys, np.arange(len(texts) + 1) * (2 * SLOTS))
        rows = [(keys[a:b] % (2 * SLOTS)).astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
        times = [counts[a:b].astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("_at"), pa.array(rows, pa.binary()), pa.array(times, pa.binary())], ["lang", "at", "slots", "counts"])


class Model:
    """Trained weights: ``table`` holds each subword's share of the scores, ``temperature`` calibrates."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.table, self.bias, self.temperature = languages, table, bias, temperature

    def probabilities(self, mean_scores: np.ndarray) -> np.ndarray:
        z = (mean_scores + self.bias) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 1) -> Model | None:
    """Train on (language, subword numbers, counts); every fifth row is kept back for calibration."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    target = np.array([languages.index(r[0]) for r in rows])
    share = [r[2] / r[2].sum() for r in rows]
    emb = rng.normal(0, 1 / DIM, (2 * SLOTS, DIM))
    out, bias = np.zeros((DIM, len(languages))), np.zeros(len(languages))
    held = np.arange(len(rows)) % 5 == 4
    held &= len(rows) >= 50
    train = np.flatnonzero(~held)
    each = -(-len(train) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // each))  # few rows are gone through more often
    total, step = epochs * each, 0
    for _ in range(epochs):
        rng.shuffle(train)
        for begin in range(0, len(train), BATCH):
            part = train[begin : begin + BATCH]
            idx = np.concatenate([rows[i][1] for i in part])
            weight = np.concatenate([share[i] for i in part])
            starts = np.concatenate([[0], np.cumsum([len(rows[i][1]) for i in part])[:-1]])
            x = np.add.reduceat(emb[idx] * weight[:, None], starts)
            z = x @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), target[part]] -= 1
            rate = RATE * (1 - step / total)
            back = p @ out.T
            out -= rate * (x.T @ p) / len(part)
            bias -= 0.1 * rate * p.mean(0)
            sizes = np.diff(np.append(starts, len(idx)))
            np.add.at(emb, idx, -rate * np.repeat(back, sizes, 0) * weight[:, None])
            step += 1
    table = (emb @ out).astype(np.float32)
    model = Model(languages, table, bias, 1.0)
    known = np.flatnonzero(held) if held.any() else train
    scores = np.stack([share[i] @ table[rows[i][1]] for i in known])
    if len(languages) > 1:
        model.temperature = min(
            np.geomspace(0.05, 5, 60),
            key=lambda t: -np.log(np.maximum(Model(languages, table, bias, t).probabilities(scores)[np.arange(len(known)), target[known]], 1e-12)).mean(),
        )
    return model


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """Fit on at most ``rows_per_language`` rows per value of ``lang``, the first by a hash of ``doc_id``.

    ``docs`` has ``doc_id``, ``text`` and ``lang``; rows without a label or without letters
    teach nothing. None where no row is left.
    """
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = known.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages; labels look wrong")
    if not sizes:
        return None
    at = F.xxhash64(F.lit("langid"), "doc_id")
    # thinned by rate first, so that few rows reach the exact cut below
    rate = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], min(1.0, (2.0 * rows_per_language + 50) / r["count"]))])
    near = known.select("doc_id", "lang", at.alias("_at")).filter(F.pmod("_at", F.lit(1_000_000)) < 1_000_000 * rate[F.col("lang")])
    first = near.withColumn("_row", F.row_number().over(W.partitionBy("lang").orderBy("_at", "doc_id"))).filter(F.col("_row") <= rows_per_language)
    chosen = known.withColumn("_at", at).join(small(stored(first.select("doc_id").distinct(), "langid-sample")), "doc_id", "left_semi")
    counted = chosen.select("lang", "_at", F.col("text").alias("_text")).mapInArrow(_count_rows, "lang string, at long, slots binary, counts binary")
    found = counted.collect()  # at most ``rows_per_language`` rows a language, the sample
    rows = sorted(found, key=lambda r: (r["at"], r["lang"], bytes(r["slots"]), bytes(r["counts"])))
    return fit([(r["lang"], np.frombuffer(r["slots"], np.uint32), np.frombuffer(r["counts"], np.uint32)) for r in rows if len(r["slots"])])


def _guess_rows(batches, shared):
    model = Model(*shared.value) if shared.value is not None else None
    for batch, lowered in steps(_lower(slices(batches, 0), "l0"), 0):
        n = len(lowered)
        if model is None:
            best, score = ["und"] * n, np.zeros(n)
        else:
            slots, owners = subwords(lowered)
            sums = np.stack([np.bincount(owners, model.table[:, j][slots], n) for j in range(len(model.languages))], 1)
            sizes = np.bincount(owners, minlength=n)
            p = model.probabilities(sums / np.maximum(sizes, 1)[:, None])
            best, score = [model.languages[j] for j in p.argmax(1)], p.max(1)
        lettered = batch.column(1).to_pylist()
        best = [b if has else "und" for b, has in zip(best, lettered)]
        score = np.where(np.array(lettered, bool), score, 0.0)
        rejected = [b == "und" or s < REJECT_BELOW for b, s in zip(best, score)]
        found = [pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], *found], [*batch.schema.names[2:], "lang_pred", "score", "rejected"])


def identify(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of each row of ``docs`` with ``lang_pred``, ``score`` and ``rejected``, names that can't be kept.

    Null texts and texts without a letter are ``und`` with score 0; all others
    get a learned language, also where the guess is rejected. Without a model (no
    labelled rows) every text is ``und``. Repeated rows are judged alike.
    """
    # plain arrays, which a worker needs no code of ours to read; 2 * SLOTS rows of one number per language
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.languages, model.table, model.bias, model.temperature))
    text = F.col("text").cast("string")
    results = ("lang_pred", "score", "rejected")
    rows, kept, names = renamed(docs, keep, results, text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))
    schema = f"{kept}lang_pred string, score double, rejected boolean"
    return rows.mapInArrow(partial(_guess_rows, shared=shared), schema).toDF(*names, *results)
