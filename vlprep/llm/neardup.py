"""Near-duplicate documents by HyperMinHash sketches.

A document's set is its distinct word shingles. Each shingle hash falls into one
of ``BUCKETS`` buckets, and a bucket keeps its smallest hash as a small number:
the count of leading zeros and the next ``MANTISSA`` bits (HyperMinHash, Yu and
Weber). The way from sketches to classes:

1. Documents with equal sets become one class, whatever their number.
2. Empty buckets are filled from others, so that short texts have whole bands
   too. Bands of ``BAND`` registers are hashed; classes with a band in common meet.
   In each bucket of a band every class is paired with the smallest one only.
3. A pair is dropped when its collision-corrected Jaccard estimate is more than
   ``MARGIN`` standard deviations below the threshold; the rest is confirmed on
   the full sets, which are computed again for the documents concerned alone.
4. Confirmed links give components. Members of a bucket that are still in
   another component than its smallest one are paired with ``LEADS`` others chosen
   by chance, and confirmed alike.
5. Members of a bucket that are in different components even then are all paired with each
   other. Nothing is left out: pairs not compared are in one component already.

A pair at Jaccard 0.8 misses all 48 bands with probability 5e-9.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vlprep.llm.common import Words, arrow_batches, components, grams, groups, mix, seeds, small, steps, stored

BUCKETS = 240
BAND = 5
MANTISSA = 10
MARGIN = 6.0
PROBES = 400
LEADS = 4
BLOCK_MEMBERS = 512
#: Rows with whole sets that Python gets at a time.
SET_ROWS = 500
#: Most rows of other kinds.
ROWS = 10_000
SHINGLE_WORDS = 5
THRESHOLD = (4, 5)

#: Bytes of words: everything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[0x20, 9, 10, 11, 12, 13]] = False


def shingle_sets(texts: list[bytes], n: int):
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    words = Words(texts, WORD_BYTES)
    for i in range(len(texts)):
        own = words.of(i)
        yield np.unique(grams(own, min(n, len(own)))) if len(own) else own


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a sorted set: 0 for an empty bucket, else 1 + (leading zeros, mantissa bits).

    The hash, read as a fraction, times the number of buckets gives the bucket
    and a fraction inside it. Sorted hashes are sorted by bucket and fraction.
    """
    out = np.zeros(BUCKETS, np.uint16)
    high, low = hashes >> np.uint64(32), hashes & np.uint64(0xFFFFFFFF)
    scaled = high * np.uint64(BUCKETS) + ((low * np.uint64(BUCKETS)) >> np.uint64(32))
    bucket = (scaled >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    with np.errstate(over="ignore"):
        rest = hashes[at] * np.uint64(BUCKETS)
    zeros = 64 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1] - 11
    zeros = np.minimum(zeros, 62)
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out[bucket[at]] = (zeros << MANTISSA) + mantissa.astype(np.int64) + 1
    return out


def set_hashes(own: np.ndarray) -> tuple[int, int]:
    """Two numbers that tell a set from others."""
    return int(own.sum(dtype=np.uint64).astype(np.int64)), int(mix(own).sum(dtype=np.uint64).astype(np.int64))


def _sketch_rows(batches, n: int):
    for batch, texts in steps(batches):
        size, one, two, regs = [], [], [], []
        for own in shingle_sets(texts, n):
            size.append(len(own))
            h1, h2 = set_hashes(own)
            one.append(h1)
            two.append(h2)
            regs.append(sketch(own).tobytes() if len(own) else b"")
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(regs, pa.binary())],
            ["doc_id", "text_hash", "n_shingles", "h1", "h2", "sketch"],
        )


_PROBES = (mix(np.arange(PROBES * BUCKETS, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64).reshape(PROBES, BUCKETS)


def filled(regs: np.ndarray) -> np.ndarray:
    """Rows of registers with empty buckets filled from others (optimal densification, Shrivastava, 2017).

    Each empty bucket tries the others in an order of its own and takes the
    register of the first that is not empty. So bands of short texts hold as
    many draws as those of long ones. Rows without any register stay empty.
    """
    out = regs.copy()
    for probe in _PROBES:
        rows = np.flatnonzero((out == 0).any(1))
        if not len(rows):
            break
        part = out[rows]
        out[rows] = np.where(part == 0, regs[rows][:, probe], part)
    rest = np.flatnonzero((out == 0).any(1))
    for _ in range(BUCKETS):  # a text of one or two shingles may not be hit: the next bucket that is filled
        if not len(rest):
            break
        part = out[rest]
        out[rest] = np.where(part == 0, np.roll(part, 1, axis=1), part)
        rest = rest[(out[rest] == 0).any(1)]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A hash for each band of each row of registers."""
    bands, factors = filled(regs).reshape(-1, BUCKETS // BAND, BAND).astype(np.uint64), seeds(BAND, 17)
    with np.errstate(over="ignore"):
        keys = (bands * factors).sum(2, dtype=np.uint64) + np.arange(BUCKETS // BAND, dtype=np.uint64) * factors[0]
    return mix(keys).view(np.int64)


def _band_rows(batches):
    for batch in batches:
        for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
            keys = band_keys(np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint16).reshape(-1, BUCKETS))
            ids = np.repeat(part.column("class_id").to_numpy(), BUCKETS // BAND)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["band", "class_id"])


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of registers, and the number of buckets they rest on.

    Registers of different smallest hashes agree by chance when their leading
    zeros and all mantissa bits do: at most 2**-MANTISSA / 3 for uniform hashes.
    The expected number of such agreements is taken off the matches.
    """
    used = ((a != 0) | (b != 0)).sum(1)
    same = ((a == b) & (a != 0)).sum(1)
    both = ((a != 0) & (b != 0)).sum(1)
    chance = 2.0**-MANTISSA / 3
    corrected = (same - both * chance) / (1 - chance)
    return np.clip(corrected / np.maximum(used, 1), 0, 1), used


def margin(share: float, used: np.ndarray) -> np.ndarray:
    used = np.maximum(used, 1)
    return MARGIN * np.sqrt(share * (1 - share) / used) + 1 / used


def _likely_rows(batches, share: float):
    for batch in batches:
        for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
            a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("sa", "sb"))
            found, used = estimate(a, b)
            keep = pa.array(found >= share - margin(share, used))
            yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], ["a", "b"])


def _set_rows(batches, n: int):
    """Sets of the rows that have the set asked for; an id may stand on rows of other texts too."""
    for batch, texts in steps(batches):
        asked = zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist())
        sets = [own.tobytes() if set_hashes(own) == want else None for own, want in zip(shingle_sets(texts, n), asked)]
        found = pa.array(sets, pa.large_binary())
        yield pa.RecordBatch.from_arrays([batch.column("class_id").filter(found.is_valid()), found.drop_null()], ["class_id", "members"])


def _confirmed_rows(batches, above: int, below: int):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("ma"), batch.column("mb")):
            shared, union = shared_part(*(np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y)))
            keep.append(below * shared >= above * union)
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def shared_part(p: np.ndarray, q: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    both = np.concatenate([p, q])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared, len(p) + len(q) - shared


def _crowd_rows(batches, above: int, below: int):
    """Links between a tile's members that are apart and its others, each pair in its first common band only."""
    share = above / below
    for tile in groups(batches, ["band", "xb", "yb"]):
        side, ids, parts = (tile.column(c).to_numpy() for c in ("side", "class_id", "part"))
        late, band = tile.column("apart").to_numpy(zero_copy_only=False), tile.column("band")[0].as_py()
        regs = np.frombuffer(b"".join(tile.column("sketch").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        keys, sets = band_keys(regs), tile.column("members").to_pylist()
        y, links = np.flatnonzero(side == 1), []
        for i in np.flatnonzero(side == 0):
            j = y[(parts[y] != parts[i]) & (~late[y] | (ids[y] > ids[i]))]
            first = (keys[j] == keys[i]).argmax(1)
            j = j[keys[i][first] == band]
            found, used = estimate(np.broadcast_to(regs[i], (len(j), BUCKETS)), regs[j])
            for k in j[found >= share - margin(share, used)]:
                shared, union = shared_part(np.frombuffer(sets[i], np.uint64), np.frombuffer(sets[k], np.uint64))
                if below * shared >= above * union:
                    links.append((max(ids[i], ids[k]), min(ids[i], ids[k])))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in links], pa.int64()), pa.array([v[1] for v in links], pa.int64())], ["a", "b"])


def crowd_links(mixed: DataFrame, sketches: DataFrame, docs: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """Links between members of a bucket that are in different parts.

    A bucket is split into tiles by chance, where its members that are apart meet all
    others. Estimates and full sets are compared there, so only links become rows.
    """
    seen = mixed.filter("class_id != lead")
    sets = full_sets(seen.select("class_id").distinct(), sketches, docs, n)
    size = lambda c: F.greatest(F.lit(1), F.ceil(F.sum(c) / BLOCK_MEMBERS)).cast("int")
    blocks = seen.groupBy("band").agg(size(F.col("apart").cast("int")).alias("xs"), size(F.lit(1)).alias("ys"))
    spot = lambda of: F.array(F.pmod(F.xxhash64("class_id"), F.col(of)).cast("int"))
    every = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    seen = seen.join(blocks, "band")
    x = seen.filter("apart").withColumn("xb", F.explode(spot("xs"))).withColumn("yb", F.explode(every("ys"))).withColumn("side", F.lit(0))
    y = seen.withColumn("xb", F.explode(every("xs"))).withColumn("yb", F.explode(spot("ys"))).withColumn("side", F.lit(1))
    laid = x.unionByName(y).select("band", "xb", "yb", "side", "class_id", "part", "apart")
    laid = laid.join(sketches.select("class_id", "sketch"), "class_id").join(sets, "class_id")
    laid = laid.repartition("band", "xb", "yb").sortWithinPartitions("band", "xb", "yb")
    with arrow_batches(docs.sparkSession, SET_ROWS):
        return stored(laid.mapInArrow(partial(_crowd_rows, above=threshold[0], below=threshold[1]), "a long, b long"), "crowd-links")


def full_sets(ids: DataFrame, classes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """``class_id`` and ``members`` of some classes, computed from the text of one of their documents again; stored."""
    wanted = stored(classes.select("class_id", F.col("first_doc").alias("doc_id"), "h1", "h2").join(small(stored(ids, "class-ids")), "class_id", "left_semi"), "set-ids")
    texts = docs.select("doc_id", "text").join(small(wanted), "doc_id")
    return stored(texts.mapInArrow(partial(_set_rows, n=n), "class_id long, members binary").dropDuplicates(["class_id"]), "sets")


def likely(pairs: DataFrame, sketches: DataFrame, share: float) -> DataFrame:
    """Pairs (``a``, ``b``) of class ids whose estimate does not rule a link out."""
    side = sketches.select("class_id", "sketch")
    both = pairs.join(side.toDF("a", "sa"), "a").join(side.toDF("b", "sb"), "b")
    return both.mapInArrow(partial(_likely_rows, share=share), "a long, b long")


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (``a``, ``b``) of class ids whose full sets reach the threshold; stored."""
    above, below = threshold
    pairs = stored(pairs, "likely")
    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct(), classes, docs, n)
    both = pairs.join(sets.toDF("a", "ma"), "a").join(sets.toDF("b", "mb"), "b").select("a", "b", "ma", "mb")
    with arrow_batches(docs.sparkSession, SET_ROWS):
        return stored(both.mapInArrow(partial(_confirmed_rows, above=above, below=below), "a long, b long"), "links")


def apart(meets: DataFrame, links: DataFrame) -> DataFrame:
    """Members of the buckets whose members are in several components, by the links so far.

    ``part`` is a member's component, ``apart`` whether it differs from that of the bucket's lead.
    """
    found = stored(components(links), "found")
    part = F.coalesce("component_id", "class_id").alias("part")
    placed = stored(meets.join(found.withColumnRenamed("id", "class_id"), "class_id", "left").select("band", "class_id", "lead", part), "placed")
    main = placed.filter("class_id = lead").select("band", F.col("part").alias("main"))
    mixed = placed.join(main, "band").withColumn("apart", F.col("part") != F.col("main")).drop("main")
    several = mixed.groupBy("band").agg(F.max("apart").alias("any"), F.count(F.lit(1)).alias("_n")).filter("any and _n > 2").select("band")
    return stored(mixed.join(several, "band", "left_semi"), "mixed")


def near_duplicates(docs: DataFrame, n: int = SHINGLE_WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per row: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``, ``group_id``, ``text_hash``.

    ``docs`` has a whole-number ``doc_id`` and ``text``; other columns are not
    read. ``component_id`` is the smallest ``doc_id`` reachable by links of
    Jaccard at least ``threshold`` (a fraction), the document's own without
    links. Null, empty and wordless texts have no shingles and link with
    nothing. A ``doc_id`` on rows of different texts links by each of them: every row goes by its own text, and
    ``group_id`` (null without shingles) and ``text_hash`` tell groups and texts apart where ids don't.
    A null ``doc_id`` is left unlinked, with a null component, and kept. An
    empty table gives an empty result.
    """
    # every job that runs Python is started in here; what is returned only reads tables
    with arrow_batches(docs.sparkSession, ROWS):
        return _classes(docs, n, threshold)


def _classes(docs: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    text = F.col("text").cast("string")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    sk = stored(
        ids.mapInArrow(partial(_sketch_rows, n=n), "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, sketch binary"), "sketches"
    )
    real = sk.filter("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "h1", "h2"]
    sets = stored(real.groupBy(*same).agg(F.min("doc_id").alias("first_doc"), F.first("sketch").alias("sketch")), "distinct-sets")
    # a class is called by its smallest doc_id; where texts share that id, by a hash
    shared = stored(sets.groupBy("first_doc").count().filter("count > 1").select("first_doc", F.lit(True).alias("_shared")), "shared-ids")
    name = F.when(F.col("_shared"), F.shiftrightunsigned(F.xxhash64("h1", "h2"), 2) + F.lit(1 << 62)).otherwise(F.col("first_doc"))
    classes = stored(sets.join(small(shared), "first_doc", "left").select(*same, "first_doc", name.alias("class_id"), "sketch"), "classes")
    bands = stored(classes.select("class_id", "sketch").mapInArrow(_band_rows, "band long, class_id long"), "bands")
    leads = bands.groupBy("band").agg(F.min("class_id").alias("lead"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    meets = stored(bands.join(leads, "band"), "meets")
    share = threshold[0] / threshold[1]
    first = meets.filter("class_id != lead").select(F.col("class_id").alias("a"), F.col("lead").alias("b")).distinct()
    links = confirm(likely(first, classes, share), classes, ids, n, threshold)
    mixed = apart(meets, links)
    # a few more leads, chosen by chance in every bucket, settle nearly all of a crowd
    more = [F.min_by(F.struct("class_id", "part"), F.xxhash64(F.lit(i), "band", "class_id")) for i in range(LEADS)]
    leads = mixed.groupBy("band").agg(F.array(*more).alias("leads")).select("band", F.explode(F.array_distinct("leads")).alias("y"))
    settled = mixed.filter("apart").join(leads, "band").filter(F.col("part") != F.col("y.part"))
    settled = settled.select(F.greatest("class_id", "y.class_id").alias("a"), F.least("class_id", "y.class_id").alias("b")).distinct()
    links = stored(links.unionByName(confirm(likely(settled, classes, share), classes, ids, n, threshold)), "links")
    second = crowd_links(apart(meets, links), classes, ids, n, threshold)
    linked = stored(components(links.unionByName(second)), "components")
    to_class = classes.select(*same, "class_id", "first_doc").join(linked.withColumnRenamed("id", "class_id"), "class_id", "left")
    to_class = to_class.withColumn("group_id", F.coalesce("component_id", "class_id")).drop("component_id")
    if shared.limit(1).count():  # groups with a class that is called by a hash
        odd = to_class.filter("class_id != first_doc").select("group_id").distinct()
        lowest = to_class.join(small(odd), "group_id", "left_semi").groupBy("group_id").agg(F.min("first_doc").alias("lowest"))
        to_class = to_class.join(small(stored(lowest, "lowest")), "group_id", "left")
    else:
        to_class = to_class.withColumn("lowest", F.col("group_id"))
    to_class = to_class.select(*same, F.coalesce("lowest", "group_id").alias("component_id"), "group_id")
    nothing = F.lit(None).cast("long").alias("group_id")
    alone = sk.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), nothing, "text_hash")
    out = real.select("doc_id", "text_hash", *same).join(to_class, same).select("doc_id", "n_shingles", "component_id", "group_id", "text_hash").unionByName(alone)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return out.select("doc_id", "n_shingles", "component_id", kept, "group_id", "text_hash")
