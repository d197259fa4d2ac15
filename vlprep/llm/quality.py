"""Document quality by a linear-chain conditional random field over lines.

Every line gets numbers about its letters, marks and words, and those of the
lines before and after it. A chain model with two states, bad and good, scores
each line by these numbers and each step from line to line by the two states.
It is trained by likelihood (Adam, in numpy) on a bounded sample of labelled
documents, whose lines all carry the document's label. Forward-backward
gives each line's probability of being good; a document's quality is their mean,
weighted by line length.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vlprep.llm.common import BYTE_CODES, mix, powers, small, steps, stored

#: Most labelled documents of each label in the sample, and most lines of one of them.
DOCS_PER_LABEL = 1500
LINES_PER_DOC = 500
STEPS = 150
RATE = 0.05
DECAY = 1e-4

_UPPER, _LOWER, _DIGIT, _MARK, _SPACE, _OTHER = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = _UPPER, _LOWER, _LOWER, _DIGIT
_KIND[np.frombuffer(b".,;:'\"?()-", np.uint8)] = _MARK
_KIND[np.frombuffer(b" \t\r\v\f\n\0", np.uint8)] = _SPACE
N_FEATURES = 17


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of each line, its weight, and where each text's lines begin (with the end). Every text has a line."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(raw == 10)
    begins = np.concatenate([[0], ends[:-1] + 1])
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.searchsorted(begins, np.concatenate([[0], np.cumsum(lengths)]))
    size = ends - begins
    kind = _KIND[raw]
    # the second byte of a capital letter of Latin-1
    kind[1:][(raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)] = _UPPER
    share = [np.add.reduceat((kind == k).view(np.uint8), begins, dtype=np.int64) for k in range(6)]
    share[_SPACE] -= 1  # the line feed itself
    n = np.maximum(size, 1)
    inside = kind != _SPACE
    edge = np.diff(inside.view(np.int8), prepend=0)
    word_begin, word_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    line = np.searchsorted(begins, word_begin, "right") - 1
    with np.errstate(over="ignore"):
        base, inverse = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
        total = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_CODES[raw] * powers(base, len(raw)))])
        words = mix((total[word_end] - total[word_begin]) * powers(inverse, len(raw))[word_begin])
        whole = mix((total[ends] - total[begins]) * powers(inverse, len(raw))[begins])
    n_words = np.bincount(line, minlength=len(begins))
    per = np.maximum(n_words, 1)
    length = word_end - word_begin

    def of_words(flag: np.ndarray) -> np.ndarray:
        return np.bincount(line[flag], minlength=len(begins)) / per

    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (line[1:] == line[:-1])
    keys = np.sort((line.astype(np.uint64) << np.uint64(40)) | (words >> np.uint64(24)))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    distinct = np.bincount((keys[fresh] >> np.uint64(40)).astype(np.int64), minlength=len(begins)) / per
    mark = (kind == _MARK) | (kind == _OTHER)
    letter = (kind == _LOWER) | (kind == _UPPER)
    inner = np.flatnonzero(mark[:-1] & letter[1:])
    inner = inner[(inner > 0)]
    inner = inner[letter[inner - 1]]
    owner = np.searchsorted(begins, inner, "right") - 1
    last_kind, first_kind = raw[np.maximum(ends - 1, 0)], kind[begins]
    same = np.zeros(len(begins))
    same[1:] = whole[1:] == whole[:-1]
    same[first[:-1]] = 0
    lone_mark = of_words((length == 1) & mark[word_begin]) if len(words) else np.zeros(len(begins))
    columns = [
        np.log1p(size) / 6, *(share[k] / n for k in range(6)), share[_OTHER] / per, share[_MARK] / per,
        np.bincount(line, length, len(begins)) / per / 10, of_words(again), distinct, of_words(length <= 3),
        np.bincount(owner, minlength=len(begins)) / per, ((last_kind == 46) & (size > 0)).astype(float), (first_kind == _UPPER).astype(float), same + lone_mark,
    ]
    return np.stack(columns, 1).astype(np.float32), np.maximum(size, 1), first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Numbers of a line, the line before, the line after, edges of the text, and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    edges = np.zeros((len(x), 3), np.float32)
    edges[first[:-1], 0] = edges[first[1:] - 1, 1] = edges[:, 2] = 1
    return np.concatenate([x, before, after, edges], 1)


class Chain:
    """Weights of the two states' line scores (as the good one's lead), and of the steps between states."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray | None = None, step: np.ndarray | None = None):
        self.mean, self.scale = mean, scale
        self.weights = np.zeros(3 * N_FEATURES + 3) if weights is None else weights
        self.step = np.zeros((2, 2)) if step is None else step

    def leads(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return with_neighbours((x - self.mean) / self.scale, first) @ self.weights

    def marginals(self, lead: np.ndarray, first: np.ndarray, pairs: bool = False):
        """Each line's probability of the good state; with ``pairs``, the sums of step probabilities too.

        Runs over all texts at once, line by line; texts are sorted by length,
        so that the ones that have ended are a tail. Messages are kept
        normalised, which changes no probability.
        """
        sizes = np.diff(first)
        order = np.argsort(-sizes, kind="stable")
        begin, sizes = first[:-1][order], sizes[order]
        alive = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")
        m = np.exp(self.step - self.step.max())
        # scores of both states, the larger one 1
        local = np.exp(np.stack([np.minimum(-lead, 0), np.minimum(lead, 0)], 1))
        forward, backward = np.ones((len(lead), 2)), np.ones((len(lead), 2))
        for t, k in enumerate(alive):
            at = begin[:k] + t
            f = local[at] * ((forward[at - 1] @ m) if t else 1)
            forward[at] = f / f.sum(1, keepdims=True)
        for t in range(len(alive) - 2, -1, -1):
            at = begin[: alive[t + 1]] + t
            b = (backward[at + 1] * local[at + 1]) @ m.T
            backward[at] = b / b.sum(1, keepdims=True)
        both = forward * backward
        good = both[:, 1] / both.sum(1)
        if not pairs:
            return good
        inner = np.ones(len(lead), bool)
        inner[first[:-1]] = False
        at = np.flatnonzero(inner)
        joint = forward[at - 1][:, :, None] * m[None] * (local[at] * backward[at])[:, None, :]
        return good, (joint / joint.sum((1, 2), keepdims=True)).sum(0)

    def qualities(self, texts: list[bytes]) -> np.ndarray:
        x, weight, first = line_features(texts)
        good = self.marginals(self.leads(x, first), first)
        return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def fit(docs: list[tuple[int, np.ndarray]]) -> Chain | None:
    """Train on (label, line numbers) of documents; None without documents."""
    if not docs:
        return None
    x = np.concatenate([d[1] for d in docs])
    sizes = np.array([len(d[1]) for d in docs])
    first = np.concatenate([[0], np.cumsum(sizes)])
    chain = Chain(x.mean(0), x.std(0) + 1e-3)
    label = np.repeat([d[0] for d in docs], sizes)
    wide = with_neighbours((x - chain.mean) / chain.scale, first).astype(np.float64)
    # each document counts alike, whatever its lines, so that long ones don't rule
    share = np.repeat(1 / np.sqrt(sizes), sizes)
    inner = np.repeat([d[0] for d in docs], sizes - 1)
    seen = np.array([[(inner == 0).sum(), 0], [0, (inner == 1).sum()]], float)
    moments = [np.zeros(chain.weights.size + 4), np.zeros(chain.weights.size + 4)]
    for i in range(1, STEPS + 1):
        good, steps_ = chain.marginals(wide @ chain.weights, first, pairs=True)
        g_w = wide.T @ ((good - label) * share) / share.sum() + DECAY * chain.weights
        g_s = (steps_ - seen) / max(seen.sum(), 1) * 0.5 + 10 * DECAY * chain.step
        g = np.concatenate([g_w, g_s.ravel()])
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        move = RATE * (moments[0] / (1 - 0.9**i)) / (np.sqrt(moments[1] / (1 - 0.99**i)) + 1e-9)
        chain.weights -= move[:-4]
        chain.step -= move[-4:].reshape(2, 2)
    return chain


def _sample_rows(batches, most: int):
    for batch, texts in steps(batches):
        x, _, first = line_features(texts)
        rows = [x[a:b].tobytes() if b - a <= most else None for a, b in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "lines"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", docs_per_label: int = DOCS_PER_LABEL) -> Chain | None:
    """Fit on at most ``docs_per_label`` documents of each label, the first by a hash of ``doc_id``.

    ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and ``label`` (0 or 1; rows
    with another value teach nothing). Documents of over ``LINES_PER_DOC`` lines
    are not part of the sample. None without labelled documents.
    """
    at = F.xxhash64(F.lit("quality"), "doc_id")
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null").distinct()
    clear = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_max")).filter("label = _max").drop("_max")
    sides = [clear.filter(F.col("label") == v).orderBy(at, "doc_id").limit(docs_per_label) for v in (0, 1)]
    chosen = stored(sides[0].unionByName(sides[1]), "quality-sample")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(small(chosen), "doc_id")
    sample = rows.mapInArrow(partial(_sample_rows, most=LINES_PER_DOC), "doc_id string, label int, lines binary").filter("lines is not null")
    rows = sample.collect()  # at most ``docs_per_label`` documents a label
    rows = sorted((r["doc_id"], bytes(r["lines"]), r["label"]) for r in rows)
    return fit([(y, np.frombuffer(x, np.float32).reshape(-1, N_FEATURES)) for _, x, y in rows])


def _score_rows(batches, shared):
    chain = Chain(*shared.value) if shared.value is not None else None
    for batch, texts in steps(batches):
        scores = np.full(len(texts), 0.5) if chain is None else chain.qualities(texts)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])


def score(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of each row, a null id too; repeated rows are scored alike.

    Null and empty texts are one empty line; without a model 0.5. Other columns don't matter.
    """
    # plain arrays of a few hundred numbers, which a worker needs no code of ours to read
    shared = docs.sparkSession.sparkContext.broadcast(None if chain is None else (chain.mean, chain.scale, chain.weights, chain.step))
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(partial(_score_rows, shared=shared), f"doc_id {kind}, score double")
