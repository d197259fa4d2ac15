"""Near-duplicate vectors by NN-descent.

Vectors of one label that are equal become one node. A first neighbour graph
comes from random projections: nodes with the same signs meet in leaves, in several
tables. Then rounds of NN-descent (Dong et al., 2011): at every node, its
neighbours and those that have it as a neighbour are compared with each other, and each
keeps the best it has met. A node whose whole list is above the threshold is
saturated, and its list is enlarged for the next round. The rounds end when they
add hardly any pair above the threshold.

Edges at the threshold, computed again in double precision, give components. Lists are
bounded, so a node of a dense cluster may have more partners than its list, and
all its links to another cluster may be missing. Three steps make up for that:

1. Crowded nodes of a component lie in a ball around one of them. Components whose balls
   come within the threshold of each other are compared in tiles, so no pair of
   crowded nodes is left out.
2. Partners are counted exactly, by comparing the members of each component in
   tiles, of which only counts leave a task.
3. An audit compares a sample of the nodes of every label with all its nodes. A label
   of which too few of the sample's pairs are found is compared as a whole, in tiles.

A label may have so few pairs that its sample holds hardly any. It passes if the sample shows none that is missing.
What then holds: two vectors at the threshold miss each other in all tables with a probability of at
most ``MISSED``, by the angle between them, where leaves are not crowded; and of q nodes asked, with 95 of 100 samples,
a share of at most 3 / q of the nodes has a partner that is missing.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vlprep.llm.common import components, groups, small, stored

THRESHOLD = 0.98
NEIGHBOURS = 8
MOST_NEIGHBOURS = 64
#: Two vectors at the threshold may meet in no table with this probability; it sets the number of tables.
MISSED = 1e-3
LEAST_TABLES = 8
BITS = 24
LEAF = 48
LEAF_ROWS = 512
ROUNDS = 6
TILE = 1024
#: Audited nodes of a label: so many, and so many times the root of their number.
AUDIT_NODES = 400
AUDIT_ROOTS = 2
AUDIT_TILE = 4096
AUDIT_RECALL = 0.98
#: Audited nodes with partners from which the audit of a label tells.
AUDIT_LEAST = 20
#: Sign of a difference that single precision may hide.
SLACK = 1e-4


def _matrix(column, kind=np.float32) -> np.ndarray:
    """Rows of equally long byte strings as a matrix."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), kind).reshape(len(parts), -1)


def _bytes(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as byte strings."""
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int64) * width), pa.py_buffer(np.ascontiguousarray(x))])


def tables_for(bits: int, threshold: float) -> int:
    """Tables after which vectors at the threshold have met with a probability of 1 - ``MISSED``."""
    meet = (1 - np.arccos(threshold) / np.pi) ** bits
    return LEAST_TABLES if meet == 1 else max(LEAST_TABLES, int(np.ceil(np.log(MISSED) / np.log1p(-meet))))


def _node_rows(batches, seed: int, threshold: float):
    for batch in batches:
        vectors, bits = batch.column("vec"), batch.column("bits").to_numpy()
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            part = batch.take(pa.array(at))
            x = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
            x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            near, most = x.astype(np.float32), tables_for(int(bits[at].max()), threshold)
            codes = np.zeros((len(at), most), np.int32)
            for t in range(most):
                planes = np.random.default_rng([seed, d, t]).normal(size=(BITS, d)).astype(np.float32)
                codes[:, t] = (((near @ planes.T) > 0) & (np.arange(BITS) < bits[at][:, None])) @ (1 << np.arange(BITS))
            used = np.array([tables_for(int(k), threshold) for k in range(BITS + 1)])[bits[at]]
            offsets = np.concatenate([[0], np.cumsum(used)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(codes[np.arange(most) < used[:, None]]))
            columns = [part.column("node"), part.column("part"), part.column("copies"), _bytes(near).cast(pa.binary()), _bytes(x).cast(pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["node", "part", "copies", "near", "exact", "codes"])


def _dots(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Inner products of rows of vectors in double precision; those of a row are equally long."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.float64) for c in (a, b))
    sizes = np.fromiter(map(len, a.to_pylist()), np.int64, len(a)) // 8
    return np.add.reduceat(x * y, np.cumsum(sizes) - sizes) if len(a) else np.empty(0)


def _best(ids: np.ndarray, sim: np.ndarray, k: int):
    """The ``k`` best partners of each row of a similarity matrix, as (rows, columns)."""
    k = min(k, sim.shape[1] - 1)
    if k < 1:
        return np.empty(0, int), np.empty(0, int)
    cols = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(len(ids)), k), cols.ravel()


def _pair_batch(a, b, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sim.astype(np.float32))], ["node", "other", "sim"])


def _leaf_rows(batches, k: int):
    for leaf in groups(batches, ["part", "t", "code", "salt"]):
        ids, x = leaf.column("node").to_numpy(), _matrix(leaf.column("near"))
        for begin in range(0, len(ids), 2 * LEAF_ROWS):
            own, y = ids[begin : begin + 2 * LEAF_ROWS], x[begin : begin + 2 * LEAF_ROWS]
            sim = y @ y.T
            np.fill_diagonal(sim, -2)
            r, c = _best(own, sim, k)
            if len(r):
                yield _pair_batch(own[r], own[c], sim[r, c])


def _meeting_rows(batches, k: int):
    for around in groups(batches, ["centre"]):
        ids, x = around.column("node").to_numpy(), _matrix(around.column("near"))
        floor = around.column("floor").to_numpy()
        sim = x @ x.T
        np.fill_diagonal(sim, -2)
        r, c = _best(ids, sim, k)
        keep = sim[r, c] > floor[r]
        if keep.any():
            r, c = r[keep], c[keep]
            yield _pair_batch(ids[r], ids[c], sim[r, c])


def _exact_rows(batches, threshold: float):
    for batch in batches:
        sim = _dots(batch.column("xa"), batch.column("xb"))
        keep = pa.array(sim >= threshold, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def _tile_rows(batches, threshold: float):
    for tile in groups(batches, ["component_id", "i", "j"]):
        side, ids = tile.column("side").to_numpy(), tile.column("node").to_numpy()
        x, copies = _matrix(tile.column("exact"), np.float64), tile.column("copies").to_numpy()
        own = side[0] == side[-1] and tile.column("i")[0] == tile.column("j")[0]
        left, right = (slice(None), slice(None)) if own else (side == 0, side == 1)
        for rows, cols in [(left, right)] if own else [(left, right), (right, left)]:
            a, b, n = x[rows], x[cols], copies[cols]
            for begin in range(0, len(a), TILE):
                near = (a[begin : begin + TILE] @ b.T) >= threshold
                if own:
                    near[np.arange(near.shape[0]), np.arange(near.shape[0]) + begin] = False
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows][begin : begin + TILE]), pa.array(near @ n)], ["node", "links"])


def _stars(near: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """The connected parts of a matrix of links between ``rows`` and ``cols``, as links to one row of each."""
    out, fresh, open_rows = [], near.any(0), near.any(1)
    for i in np.flatnonzero(open_rows):
        if not open_rows[i]:
            continue
        open_rows[i], front = False, np.array([i])
        while len(front):
            hit = np.flatnonzero(near[front].any(0) & fresh)
            fresh[hit] = False
            out += [(cols[j], rows[i]) for j in hit]
            front = np.flatnonzero(near[:, hit].any(1) & open_rows) if len(hit) else hit
            open_rows[front] = False
            out += [(rows[k], rows[i]) for k in front]
    return out


def _joined_rows(batches, threshold: float):
    for tile in groups(batches, ["c", "d", "i", "j"]):
        side, ids = tile.column("side").to_numpy(), tile.column("node").to_numpy()
        x, own = _matrix(tile.column("exact"), np.float64), not side.any()
        left, right = (slice(None), slice(None)) if own else (side == 0, side == 1)
        near = (x[left] @ x[right].T) >= threshold
        if own:
            np.fill_diagonal(near, False)
        links = [v for v in _stars(near, ids[left], ids[right]) if v[0] != v[1]]
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([max(v) for v in links], pa.int64()), pa.array([min(v) for v in links], pa.int64())], ["a", "b"])


def _cosine_rows(batches):
    for batch in batches:
        cos = _dots(batch.column("exact"), batch.column("centre"))
        yield pa.RecordBatch.from_arrays([batch.column("component_id"), pa.array(np.arccos(np.clip(cos, -1, 1)))], ["component_id", "angle"])


def _ball_rows(batches, threshold: float):
    for tile in groups(batches, ["part", "i", "j"]):
        side, ids = tile.column("side").to_numpy(), tile.column("component_id").to_numpy()
        x, radius = _matrix(tile.column("centre"), np.float64), tile.column("radius").to_numpy()
        own = not side.any()
        left, right = (slice(None), slice(None)) if own else (side == 0, side == 1)
        apart = np.arccos(np.clip(x[left] @ x[right].T, -1, 1))
        r, c = np.nonzero(apart <= radius[left][:, None] + radius[right] + np.arccos(threshold) + SLACK)
        r, c = ids[left][r], ids[right][c]
        if own:
            r, c = r[r < c], c[r < c]
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(r, c)), pa.array(np.maximum(r, c))], ["c", "d"])


def _halves(rows: DataFrame, key: str, group: str) -> DataFrame:
    """Rows laid out so that all of a ``group`` meet in tiles ``i``, ``j``: ``side`` 0 meets 1, in tiles of one side all meet."""
    tiles = rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    laid = rows.join(tiles, group).withColumn("own", F.pmod(F.xxhash64(key), F.col("tiles")).cast("int"))
    laid = laid.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return laid.withColumns({"i": F.least("own", "o"), "j": F.greatest("own", "o"), "side": (F.col("own") > F.col("o")).cast("int")})


def _joined(laid: DataFrame, threshold: float, name: str) -> DataFrame:
    keys = ["c", "d", "i", "j"]
    laid = laid.select(*keys, "side", "node", "exact").repartition(*keys).sortWithinPartitions(*keys, "side", "node")
    return stored(laid.mapInArrow(partial(_joined_rows, threshold=threshold), "a long, b long"), name)


def _crossings(coded: DataFrame, close: DataFrame, found: DataFrame, threshold: float) -> DataFrame | None:
    """Links that join components by their crowded nodes, those whose partners may exceed a list or what a meeting proposes.

    None where fewer than two components have any.
    """
    crowded = close.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count().filter(F.col("count") >= NEIGHBOURS).select("node")
    members = coded.select("node", "part", "exact").join(crowded, "node").join(found.withColumnRenamed("id", "node"), "node")
    members = stored(members, "crowded")
    centres = members.groupBy("component_id").agg(F.min(F.struct("node", "part", "exact")).alias("m"), F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("n"))
    centres = stored(centres.select("component_id", F.col("m.part").alias("part"), F.col("m.exact").alias("centre"), "n"), "centres")
    if centres.limit(2).count() < 2:
        return None
    far = members.join(centres.select("component_id", "centre"), "component_id").select("component_id", "exact", "centre")
    radius = far.mapInArrow(_cosine_rows, "component_id long, angle double").groupBy("component_id").agg(F.max("angle").alias("radius"))
    keys = ["part", "i", "j"]
    balls = _halves(centres.join(radius, "component_id"), "component_id", "part").select(*keys, "side", "component_id", "centre", "radius")
    balls = balls.repartition(*keys).sortWithinPartitions(*keys, "side", "component_id")
    near = stored(balls.mapInArrow(partial(_ball_rows, threshold=threshold), "c long, d long"), "near-balls")
    size = centres.select("component_id", "n")
    near = near.join(size.toDF("c", "nc"), "c").join(size.toDF("d", "nd"), "d")
    spot, every = (lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    m = members.select("component_id", "node", "exact")
    one = m.withColumnRenamed("component_id", "c").join(near, "c").withColumn("i", spot("nc")).withColumn("j", every("nd")).withColumn("side", F.lit(0))
    two = m.withColumnRenamed("component_id", "d").join(near, "d").withColumn("i", every("nc")).withColumn("j", spot("nd")).withColumn("side", F.lit(1))
    return _joined(one.unionByName(two), threshold, "crossings")


def _audit_rows(batches, threshold: float):
    for tile in groups(batches, ["part", "i", "j"]):
        asks, where, ids = tile.column("asks").to_numpy(), tile.column("component_id").to_numpy(), tile.column("node").to_numpy()
        x, q = _matrix(tile.column("exact"), np.float64), asks == 1
        near = (x[q] @ x[~q].T >= threshold) & (ids[q][:, None] != ids[~q])
        hit = near & (where[q][:, None] == where[~q])
        n = int(q.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[q]), pa.array(tile.column("part").to_numpy()[q]), pa.array(near.sum(1), pa.int64()), pa.array(hit.sum(1), pa.int64())], ["node", "part", "true", "hit"]
        ) if n else pa.RecordBatch.from_pylist([], AUDITED)


AUDITED = pa.schema([("node", pa.int64()), ("part", pa.int64()), ("true", pa.int64()), ("hit", pa.int64())])


def _audit(coded: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """Labels (``part``) of which too few pairs of a sample of nodes share a component.

    The sample of a label grows with it. Where fewer than ``AUDIT_LEAST`` of it have a partner, no pair may be missing.
    """
    sizes = stored(coded.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("tiles", F.ceil(F.col("n") / AUDIT_TILE).cast("int")), "part-sizes")
    placed = coded.select("node", "part", "exact").join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component_id", F.coalesce("component_id", "node"))
    placed = placed.join(small(sizes), "part")
    share = (AUDIT_NODES + AUDIT_ROOTS * F.sqrt("n")) / F.col("n")
    chosen = placed.filter(F.pmod(F.xxhash64(F.lit(23), "node"), F.lit(1 << 30)) < share * (1 << 30))
    # the nodes asked are dealt out in tiles as well
    asked_tiles = F.ceil((AUDIT_NODES + AUDIT_ROOTS * F.sqrt("n")) / AUDIT_TILE).cast("int")
    every, spot = (lambda c: F.explode(F.sequence(F.lit(0), c - 1))), (lambda c: F.pmod(F.xxhash64("node"), c).cast("int"))
    asks = chosen.withColumn("i", every(F.col("tiles"))).withColumn("j", spot(asked_tiles)).withColumn("asks", F.lit(1))
    told = placed.withColumn("i", spot(F.col("tiles"))).withColumn("j", every(asked_tiles)).withColumn("asks", F.lit(0))
    keys = ["part", "i", "j"]
    laid = asks.unionByName(told).select(*keys, "asks", "node", "component_id", "exact").repartition(*keys).sortWithinPartitions(*keys, "asks")
    per_node = laid.mapInArrow(partial(_audit_rows, threshold=threshold), "node long, part long, true long, hit long")
    per_node = per_node.groupBy("part", "node").agg(F.sum("true").alias("true"), F.sum("hit").alias("hit")).withColumn("recall", F.when(F.col("true") > 0, F.col("hit") / F.col("true")))
    per_part = per_node.groupBy("part").agg(F.count("recall").alias("told"), F.avg("recall").alias("recall"), F.sum(F.col("true") - F.col("hit")).alias("missed"))
    good = F.when(F.col("told") >= AUDIT_LEAST, F.col("recall") >= AUDIT_RECALL).otherwise(F.col("missed") == 0)
    return stored(sizes.join(per_part.filter(good).select("part"), "part", "left_anti").select("part"), "failed-parts")


def _lists(pairs: DataFrame, most: DataFrame | None = None, k: int = NEIGHBOURS) -> DataFrame:
    """The best partners per node: ``node``, ``k``, ``near`` (array of sim and other, best first)."""
    best = pairs.groupBy("node", "other").agg(F.max("sim").alias("sim")).withColumn(
        "_row", F.row_number().over(W.partitionBy("node").orderBy(F.desc("sim"), "other"))
    )
    best = best.filter(F.col("_row") <= MOST_NEIGHBOURS)
    near = best.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("sim", "other")), asc=False).alias("near"))
    near = near.withColumn("k", F.lit(k)) if most is None else near.join(most, "node", "left").withColumn("k", F.coalesce("k", F.lit(k)))
    return near.select("node", "k", F.slice("near", 1, F.col("k")).alias("near"))


def near_duplicate_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
                           threshold: float = THRESHOLD, seed: int = 3) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors link when their labels are equal and not null, their lengths are equal, and
    their cosine is at least ``threshold``. Null and zero vectors, and those with a
    component that is null or not finite, link with nothing. Equal vectors are linked, under
    the same id too. A null id has a null component and is kept. An empty table gives an
    empty result.
    """
    v = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("string").alias("_label"), v.alias("_v"))
    good = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("_label").isNotNull() & ~F.exists("_v", odd) & F.exists("_v", lambda x: x != 0), F.lit(False)
    )
    part = F.xxhash64("_label", F.size("_v"))
    # adding 0.0 makes -0.0 and 0.0 the same
    clean = F.transform("_v", lambda x: x + F.lit(0.0))
    rows = rows.select("vec_id", F.when(good, part).alias("part"), F.when(good, clean).alias("vec"))
    keyed = stored(rows.withColumn("h1", F.xxhash64("part", "vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec", "part")), "vectors")
    real = keyed.filter("part is not null")
    nodes = real.groupBy("h1", "h2").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("part").alias("part"), F.first("vec").alias("vec")
    )
    classes = stored(nodes, "nodes")
    sizes = classes.groupBy("part").agg(F.greatest(F.lit(0), F.least(F.lit(BITS), F.ceil(F.log2(F.count(F.lit(1)) / LEAF)))).cast("int").alias("bits"))
    coded = stored(
        classes.join(small(sizes), "part").select("node", "part", "copies", "vec", "bits").mapInArrow(
            partial(_node_rows, seed=seed, threshold=threshold), "node long, part long, copies long, near binary, exact binary, codes array<int>"
        ),
        "coded",
    )
    # first graph: leaves of several tables; crowded leaves are split by chance
    spread = coded.select("node", "part", "near", F.posexplode("codes").alias("t", "code"))
    crowd = spread.groupBy("part", "t", "code").agg(F.ceil(F.count(F.lit(1)) / LEAF_ROWS).alias("salts"))
    spread = spread.join(crowd, ["part", "t", "code"]).withColumn("salt", F.pmod(F.xxhash64("t", "node"), "salts"))
    keys = ["part", "t", "code", "salt"]
    leaves = spread.select(*keys, "node", "near").repartition(*keys).sortWithinPartitions(*keys)
    graph = stored(_lists(leaves.mapInArrow(partial(_leaf_rows, k=NEIGHBOURS), "node long, other long, sim float")), "graph")
    flat = graph.select("node", F.explode("near").alias("n")).select("node", F.col("n.other").alias("other"), F.col("n.sim").alias("sim"))
    above = 0
    for turn in range(ROUNDS):
        now = flat.filter(F.col("sim") >= threshold - SLACK).count()
        close = (flat.filter(F.col("sim") >= threshold - SLACK)).select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()
        settled = turn > 0 and now <= above * 1.001
        above = now
        if settled or turn == ROUNDS - 1:
            exact = coded.select("node", "exact")
            pairs = close.join(exact.toDF("a", "xa"), "a").join(exact.toDF("b", "xb"), "b")
            links = stored(pairs.mapInArrow(partial(_exact_rows, threshold=threshold), "a long, b long"), "links")
            found = stored(components(links), "vector-components")
            crossed = _crossings(coded, close, found, threshold)
            if crossed is not None and crossed.limit(1).count():
                links = links.unionByName(crossed)
                found = stored(components(links), "vector-components")
            failed = _audit(coded, found, threshold)
            if failed.limit(1).count():
                whole = coded.select("node", "part", "exact").join(small(failed), "part", "left_semi")
                laid = _halves(whole, "node", "part").withColumns({"c": F.col("part"), "d": F.col("part")})
                found = stored(components(links.unionByName(_joined(laid, threshold, "whole-parts"))), "vector-components")
            break
        # who meets where: neighbours, the best of those that have the node as neighbour, and the node itself
        back = flat.select(F.col("other").alias("centre"), "node", "sim")
        back = back.withColumn("_row", F.row_number().over(W.partitionBy("centre").orderBy(F.desc("sim"), "node"))).filter(F.col("_row") <= NEIGHBOURS)
        meet = flat.select(F.col("node").alias("centre"), F.col("other").alias("node")).unionByName(back.select("centre", "node"))
        meet = meet.unionByName(coded.select(F.col("node").alias("centre"), "node")).distinct()
        full = F.size("near") >= F.col("k")
        floors = graph.select("node", F.when(full, F.element_at("near", -1)["sim"]).otherwise(F.lit(-2.0)).cast("float").alias("floor"))
        saturated = F.element_at("near", -1)["sim"] >= threshold
        most = graph.select("node", F.when(full & saturated, F.least(2 * F.col("k"), F.lit(MOST_NEIGHBOURS))).otherwise(F.col("k")).alias("k"))
        carried = coded.select("node", "near").join(floors, "node", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0).cast("float")))
        meet = meet.join(carried, "node").select("centre", "node", "near", "floor").repartition("centre").sortWithinPartitions("centre", "node")
        met = meet.mapInArrow(partial(_meeting_rows, k=NEIGHBOURS), "node long, other long, sim float")
        graph = stored(_lists(flat.unionByName(met), most), "graph")
        flat = graph.select("node", F.explode("near").alias("n")).select("node", F.col("n.other").alias("other"), F.col("n.sim").alias("sim"))
    members = coded.select("node", "copies", "exact").join(found.withColumnRenamed("id", "node"), "node")
    laid = _halves(members, "node", "component_id").select("component_id", "i", "j", "side", "node", "copies", "exact")
    keys = ["component_id", "i", "j"]
    counted = laid.repartition(*keys).sortWithinPartitions(*keys, "side", "node").mapInArrow(partial(_tile_rows, threshold=threshold), "node long, links long")
    counted = counted.groupBy("node").agg(F.sum("links").alias("links"))
    result = classes.select("h1", "h2", "node", "copies").join(counted, "node", "left").join(found.withColumnRenamed("id", "node"), "node", "left")
    result = result.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "node").alias("component_id"))
    alone = keyed.filter("part is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = real.select("vec_id", "h1", "h2").join(result, ["h1", "h2"]).select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
