"""Hard negatives of anchor vectors, by exact integer products in residue numbers.

Components are made whole numbers. Their inner products are taken modulo a few
small primes, each as a float32 matrix product that is exact because every partial sum
stays below ``2**24``. The Chinese remainder theorem gives the signed product back from its residues;
as many primes are used as the largest possible product asks.

Anchors are shipped to the rows in blocks of at most ``ANCHOR_BYTES``. Each task goes
through its rows a tile at a time and holds only the best few for each anchor.
"""

from __future__ import annotations

import math
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vlprep.llm.common import stored

#: Bytes of the anchors' whole numbers that are shipped at a time.
ANCHOR_BYTES = 8 << 20
#: Rows a side of one matrix product.
TILE = 1024
#: Groups in which the best of the tasks are merged before the last merge.
MERGES = 64
#: Whole sums below this are exact in float32.
EXACT = 1 << 24
_LEAST = np.iinfo(np.int64).min


def primes(size: int, bound: int) -> list[int]:
    """Primes for products of ``size`` terms up to ``bound`` in absolute value, largest first.

    Residues lie in ``-(p - 1) / 2 .. (p - 1) / 2``, so that ``size`` products of two add up below ``EXACT``.
    """
    half = int((EXACT // max(size, 1)) ** 0.5)
    while half * half * size > EXACT:
        half -= 1
    out, product = [], 1
    p = min(2 * half + 1, 4093)
    while product <= 4 * bound:
        if p < 3:
            raise ValueError("vectors too long or components too large for exact products")
        if all(p % d for d in range(3, int(p**0.5) + 1, 2)) and p % 2:
            out.append(p)
            product *= p
        p -= 1
    return out


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers modulo ``p``, around zero, as float32."""
    r = np.mod(x, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def reconstruct(parts: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """Signed whole numbers from their residues, by the digits of the mixed radix.

    Numbers lie within a quarter of the moduli's product around zero, so the last digit tells the sign, and
    sums may wrap around 64 bits.
    """
    digits: list[np.ndarray] = []
    for i, (part, p) in enumerate(zip(parts, moduli)):
        known = np.zeros_like(part)
        for j in reversed(range(i)):
            known = (known * moduli[j] + digits[j]) % p
        digits.append((part - known) * pow(math.prod(moduli[:i]), -1, p) % p)
    total = np.zeros(parts[0].shape, np.uint64)
    for digit, p in zip(reversed(digits), reversed(moduli)):
        total = total * np.uint64(p) + digit.astype(np.uint64)
    total[digits[-1] > moduli[-1] // 2] -= np.uint64(math.prod(moduli) % (1 << 64))
    return total.view(np.int64)


def products(a: list[np.ndarray], b: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """Exact inner products of rows given by their residues for each modulus, as int64."""
    return reconstruct([(x @ y.T).astype(np.int64) for x, y in zip(a, b)], moduli)


def _whole(vectors: pa.Array, size: int) -> np.ndarray:
    """Whole numbers of a list column, shorter vectors filled up with zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == size).all():
        return flat.reshape(-1, size)
    out = np.zeros((len(lengths), size), np.int64)
    out[np.arange(size) < lengths[:, None]] = flat
    return out


class _Best:
    """The first ``k`` rows found for each of ``n`` targets: higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.target, self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.limit = np.full(n, _LEAST)  # below it no row can come in

    def add(self, target: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(target):
            return
        target, score, ids = np.concatenate([self.target, target]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, target))
        target, score, ids = target[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(target, prepend=-1))
        place = np.arange(len(target)) - np.repeat(first, np.diff(first, append=len(target)))
        keep = place < self.k
        self.target, self.score, self.id = target[keep], score[keep], ids[keep]
        full = place == self.k - 1
        self.limit[target[full]] = score[full]


def _tiles(batches, size: int, moduli: list[int]):
    """Rows a tile at a time: ids, labels and residues."""
    for batch in batches:
        for begin in range(0, batch.num_rows, TILE):
            part = batch.slice(begin, TILE)
            x = _whole(part.column("v"), size)
            yield part.column("id").to_numpy(), part.column("label").to_numpy(), [residues(x, p) for p in moduli]


def _best_rows(best: _Best):
    for begin in range(0, len(best.target), 100_000):
        cut = slice(begin, begin + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(c[cut]) for c in (best.target, best.id, best.score)], ["target", "id", "score"])


def _positive_rows(batches, anchors, size: int, moduli: list[int], k: int):
    ids, labels, x = anchors
    sides = [residues(x, p) for p in moduli]
    best = _Best(len(ids), k)
    for row_ids, row_labels, rows in _tiles(batches, size, moduli):
        for begin in range(0, len(ids), TILE):
            cut = slice(begin, begin + TILE)
            score = products([s[cut] for s in sides], rows, moduli)
            fits = (labels[cut, None] == row_labels) & (ids[cut, None] != row_ids) & (score >= best.limit[cut, None])
            target, row = np.nonzero(fits)
            best.add(target + begin, score[target, row], row_ids[row])
    yield from _best_rows(best)


def _negative_rows(batches, anchors, windows, size: int, moduli: list[int], k: int):
    """``windows``: for each target its anchor's place, lowest and highest score, in order of the anchors."""
    ids, labels, x = anchors
    owner, low, high = windows
    sides = [residues(x, p) for p in moduli]
    best = _Best(len(owner), k)
    for row_ids, row_labels, rows in _tiles(batches, size, moduli):
        for begin in range(0, len(ids), TILE):
            cut = slice(begin, begin + TILE)
            score = products([s[cut] for s in sides], rows, moduli)
            other = labels[cut, None] != row_labels
            a, b = np.searchsorted(owner, [begin, begin + TILE])
            nth = np.arange(a, b) - np.searchsorted(owner, owner[a:b])
            for j in range(int(nth.max()) + 1 if b > a else 0):
                at = np.arange(a, b)[nth == j]  # the j-th target of each anchor that has so many
                least = np.maximum(low[at], best.limit[at])
                mine = score[owner[at] - begin]
                fits = (mine >= least[:, None]) & (mine <= high[at, None]) & other[owner[at] - begin]
                if mine.shape[1] > k and np.count_nonzero(fits) > 4 * k * len(at):  # far more than can stay
                    fits &= mine >= np.partition(np.where(fits, mine, _LEAST), -k, axis=1)[:, -k, None]
                target, row = np.nonzero(fits)
                best.add(at[target], mine[target, row], row_ids[row])
    yield from _best_rows(best)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each target over all tasks with ``rank``, merged in two levels."""
    order = [F.col("score").desc(), F.col("id")]
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(MERGES)))
    some = salted.withColumn("_r", F.row_number().over(W.partitionBy("target", "_salt").orderBy(*order))).filter(F.col("_r") <= k)
    ranked = some.select("target", "id", "score", F.row_number().over(W.partitionBy("target").orderBy(*order)).alias("rank"))
    return ranked.filter(F.col("rank") <= k)


def _blocks(anchors: DataFrame, size: int):
    """Anchors on the driver, at most ``ANCHOR_BYTES`` at a time: ids, labels, whole numbers."""
    per = max(1, ANCHOR_BYTES // (8 * max(size, 1)))
    n_blocks = -(-anchors.count() // per)
    placed = stored(anchors.withColumn("_block", F.pmod(F.xxhash64("id", "label", "v"), F.lit(max(n_blocks, 1)))), "anchors")
    for i in range(n_blocks):
        table = placed.filter(F.col("_block") == i).select("id", "label", "v").toArrow()  # at most about ANCHOR_BYTES
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        vectors = table.column("v").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int64()))
        if table.num_rows:
            yield table.column("id").to_numpy(), table.column("label").to_numpy(), _whole(vectors, size)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column | None = None,
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    scale: int = 256,
) -> DataFrame:
    """Negatives of other labels whose score lies in a window of each positive's score, in hundredths of it.

    ``vectors`` has ``vec_id``, ``embedding`` and ``label``; ``anchor`` says which rows are anchors, ``label``
    gives another label. Scores are inner products of ``floor(scale * x)``. An anchor's positives are its
    first rows of the same label and another ``vec_id``. Higher scores come first, ties by smaller ``vec_id``.

    Rows without an id, a label or a vector, or with a null or non-finite component, take no part. Repeated rows are rows of their
    own, but equal anchors are one. A vector shorter than the longest counts as filled up with zeros. Products that don't fit into
    62 bits fail. Other columns don't matter. No rows, no result.
    """
    x = F.col("embedding")
    plain = vectors.select(
        F.col("vec_id").cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"),
        F.transform(x, lambda c: c.cast("double")).alias("x"), (F.col("vec_id") % 100 == 0 if anchor is None else anchor).alias("is_anchor"),
    )
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    fit = plain.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    whole = F.transform("x", lambda c: F.floor(c * scale).cast("long"))
    rows = stored(fit.select("id", "label", whole.alias("v"), "is_anchor"), "vectors")

    squares = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    size, most = rows.agg(F.max(F.size("v")), F.max(squares)).first()
    schema = "target long, id long, score long"
    empty = vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if size is None:
        return empty
    bound = int(most * (1 + 1e-9)) + 1  # no product exceeds the longest vector's square
    if bound >= 1 << 62:
        raise ValueError("components too large: products don't fit into 62 bits")
    moduli = primes(size, bound)
    found = [empty]
    for ids, labels, values in _blocks(rows.filter("is_anchor").select("id", "label", "v").distinct(), size):
        anchors = (ids, labels, values)
        plain_rows = rows.select("id", "label", "v")
        near = plain_rows.mapInArrow(partial(_positive_rows, anchors=anchors, size=size, moduli=moduli, k=positives), schema)
        chosen = sorted(tuple(r) for r in _merged(near, positives).select("target", "rank", "id", "score").collect())  # at most a few rows an anchor of the block
        owner, _, positive, score = (np.array(c, np.int64) for c in zip(*chosen)) if chosen else (np.empty(0, np.int64),) * 4
        low, high = -(-window[0] * score // 100), window[1] * score // 100
        windows = (owner, low, high)
        far = plain_rows.mapInArrow(partial(_negative_rows, anchors=anchors, windows=windows, size=size, moduli=moduli, k=negatives), schema)
        targets = vectors.sparkSession.createDataFrame(
            pa.table({"target": np.arange(len(owner)), "anchor_id": ids[owner], "positive_id": positive, "positive_score": score})
        )
        ranked = _merged(far, negatives).join(F.broadcast(targets), "target")
        found.append(ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    return reduce(DataFrame.unionByName, found)


__all__ = ["hard_negatives", "primes", "products", "reconstruct", "residues"]
