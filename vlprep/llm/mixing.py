"""Sources interleaved at target weights by Pfair scheduling. DataFrame functions only.

The rows of a source are put in a seeded order and cut into blocks. By its target weight a
source is due a growing, fractional number of blocks at every slot; when a source runs out, the others are due
its share in the ratio of their weights. Block k may come from the slot on in which its source is due more
than k blocks, and must come before it is due more than k + 1. Of the blocks that may come, the one with the
earliest deadline comes (Baruah et al., 1996). So at every slot, over the whole sequence, each source has had less than
one block more or less than it is due.

The slots are cut into frames, which are scheduled apart. A frame has ``FRAME`` slots, or as many as lie between
two blocks of the slowest source. At a border, blocks whose time has come but not gone lie on either side. Those left for the later frame are chosen by latest
deadline, as far as the frame before can do without them: it must fill every run of slots up to
its end. This is a greedy choice of a basis of a laminar matroid, the best for every deadline at
once, so both frames have schedules that keep all times, and earliest deadline first finds them.

Weights are whole numbers, the shares times ``WHOLE`` over their sum: over N blocks a source is off its
exact share by N / ``WHOLE`` blocks more at most. All rows are placed. Of the schedule, one number per pair of sources is
made on the driver; frames, blocks and rows are DataFrames.
"""

from __future__ import annotations

import json
import math
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vlprep.llm.common import small, stored

BLOCK_ROWS = 64
#: Least slots of a frame.
FRAME = 128
#: Most sources; the weights of more are better given to groups of them.
SOURCES = 1000
ROWS_PER_BUCKET = 50_000
#: Sum of the whole weights.
WHOLE = 10**15
RESULTS = ("block", "slot", "position")

_BIG = "decimal(38,0)"


def whole_weights(shares: dict[str, float]) -> dict[str, int]:
    """Shares as whole numbers that add up to about ``WHOLE``; those not above zero are 0, no other is."""
    exact = {s: Fraction(v) if v > 0 else Fraction(0) for s, v in shares.items()}
    total = sum(exact.values())
    return {s: max(1, round(v * WHOLE / total)) if v else 0 for s, v in exact.items()}


def phases(blocks: dict[str, int], weights: dict[str, int]) -> tuple[list[dict], list[dict]]:
    """What is due, as long as the same sources have blocks.

    When every source has had its weight times x of its blocks, or all, ``before + weight * x`` slots are over. Returns these
    two numbers and the first whole slot of each phase; and of each source its weight, blocks, and the
    first block of each phase.
    """
    ends = sorted({Fraction(blocks[s], weights[s]) for s in blocks})
    begins = [Fraction(0), *ends[:-1]]
    out = []
    for x in begins:
        over = [s for s in blocks if Fraction(blocks[s], weights[s]) <= x]
        before, weight = sum(blocks[s] for s in over), sum(weights[s] for s in blocks if s not in over)
        out.append({"before": before, "weight": str(weight), "slot": math.ceil(before + weight * x)})
    return out, [{"source": s, "weight": str(weights[s]), "blocks": n, "firsts": [math.ceil(x * weights[s]) for x in begins]} for s, n in blocks.items()]


def _literal(value, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), schema)


def _big(c: Column) -> Column:
    return c.cast(_BIG)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def schedule(spark: SparkSession, blocks: dict[str, int], weights: dict[str, int], frame: int = FRAME) -> DataFrame:
    """``source``, ``block`` and ``slot`` of every block; weights are whole and above zero.

    Frames are at least as long as the blocks of the slowest source are apart, so that no block's time spans one.
    """
    total = sum(blocks.values())
    frame = min(total, max(frame, -(-sum(weights.values()) // min(weights.values())) + 2))
    each, sources = phases(blocks, weights)
    parts = _literal(each, f"array<struct<before: long, weight: {_BIG}, slot: long>>")
    sources_ = _literal(sources, f"array<struct<source: string, weight: {_BIG}, blocks: long, firsts: array<long>>>")
    one = _big(F.lit(1))

    def part_at(slot: Column) -> Column:
        return F.element_at(parts, F.size(F.filter(parts, lambda x: x["slot"] <= slot)))

    def due(s: Column, p: Column, slot: Column, up: bool) -> Column:
        """Blocks of a source due before a slot, rounded down or up."""
        share = s["weight"] * _big(slot - p["before"])
        return F.least(s["blocks"], _div(share + (p["weight"] - one) if up else share, p["weight"]))

    def time(s: Column, block: Column, up: bool) -> Column:
        """The slot in which so many blocks of a source are due, rounded down or up."""
        p = F.element_at(parts, F.size(F.filter(s["firsts"], lambda x: x <= block)))
        share = p["weight"] * _big(block)
        return p["before"] + _div(share + (s["weight"] - one) if up else share, s["weight"])

    begin, end, s = F.col("begin"), F.col("end"), F.col("s")
    frames = spark.range(-(-total // frame)).select(F.col("id").alias("frame"), (F.col("id") * frame).alias("begin"), F.least(F.lit(total), (F.col("id") + 1) * frame).alias("end"))
    frames = frames.withColumns({"p": part_at(begin), "q": part_at(end)})
    lines = frames.select("*", F.explode(sources_).alias("s")).select(
        "frame", "begin", "end", "s", due(s, F.col("p"), begin, False).alias("a"), due(s, F.col("q"), end, False).alias("b"), due(s, F.col("q"), end, True).alias("b_up")
    )
    # blocks whose time lies in the frame at least in part
    numbers = F.when(F.col("b_up") > F.col("a"), F.sequence("a", F.col("b_up") - 1)).otherwise(F.array().cast("array<long>"))
    jobs = F.transform(numbers, lambda k: F.struct(time(s, k + 1, True).alias("deadline"), time(s, k, False).alias("release"), k.alias("block")))
    line = F.struct(F.col("s.source").alias("source"), "a", "b", "b_up", jobs.alias("jobs"))
    held = stored(lines.groupBy("frame", "begin", "end").agg(F.sort_array(F.collect_list(line)).alias("lines")), "frames")

    # for every run of slots up to the end: how many blocks that could fill it may be left for the next frame
    def released(t: Column) -> Column:
        return F.element_at(F.transform(F.array(part_at(t)), lambda p: F.aggregate(sources_, F.lit(0).cast("long"), lambda n, x: n + due(x, p, t, True))), 1)

    spare = F.transform(F.sequence(begin + 1, end), lambda t: released(t) - t)
    open_ = F.filter("lines", lambda x: x["b_up"] > x["b"])
    open_ = F.transform(open_, lambda x: F.struct(F.element_at(x["jobs"], -1)["deadline"].alias("deadline"), x["source"].alias("source"), F.element_at(x["jobs"], -1)["release"].alias("release")))
    over = F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["b"])
    none = F.array().cast("array<string>")

    def leave(state: Column, job: Column) -> Column:
        at = F.greatest(job["release"] - begin, F.lit(0)).cast("int")
        fits = (F.size(state["left"]) < F.col("n_left")) & (F.array_min(F.slice(state["spare"], at + 1, frame)) >= 1)
        less = F.transform(state["spare"], lambda x, i: x - (i >= at).cast("long"))
        return F.when(fits, F.struct(less.alias("spare"), F.array_append(state["left"], job["source"]).alias("left"))).otherwise(state)

    # of the open blocks, as many come before the border as there are slots left
    borders = held.select("frame", "begin", "end", spare.alias("spare"), F.sort_array(open_, asc=False).alias("open"), (end - over).alias("n_early"))
    borders = borders.withColumn("n_left", F.size("open") - F.col("n_early"))
    left = F.aggregate("open", F.struct(F.col("spare").alias("spare"), none.alias("left")), leave, lambda x: x["left"])
    borders = stored(borders.select("frame", F.array_except(F.transform("open", lambda j: j["source"]), left).alias("early")), "borders")
    before = borders.select((F.col("frame") + 1).alias("frame"), F.col("early").alias("done"))
    both = held.join(borders, "frame").join(before, "frame", "left").withColumn("done", F.coalesce("done", none))

    def own(x: Column) -> Column:
        first = x["a"] + F.array_contains("done", x["source"]).cast("long")
        stop = x["b"] + F.array_contains("early", x["source"]).cast("long")
        return F.struct(x["source"].alias("source"), F.filter(x["jobs"], lambda j: (j["block"] >= first) & (j["block"] < stop)).alias("jobs"))

    # only sources that have blocks in the frame
    both = both.select("begin", "end", F.filter(F.transform("lines", own), lambda x: F.size(x["jobs"]) > 0).alias("lanes"))

    def place(state: Column, slot: Column) -> Column:
        ready = F.transform(
            "lanes",
            lambda x, i: F.element_at(
                F.transform(F.array(F.get(x["jobs"], F.get(state["at"], i))), lambda j: F.when(j["release"] <= slot, F.struct(F.least(j["deadline"], end).alias("deadline"), i.alias("lane"), j["block"].alias("block")))), 1
            ),
        )
        # one element, so that the choice is made once
        return F.element_at(
            F.transform(
                F.array(F.array_min(ready)),
                lambda j: F.struct(
                    F.transform(state["at"], lambda n, i: n + (i == j["lane"]).cast("int")).alias("at"),
                    F.array_append(state["out"], F.struct(j["lane"].alias("lane"), j["block"].alias("block"))).alias("out"),
                ),
            ),
            1,
        )

    start = F.struct(F.transform("lanes", lambda x: F.lit(0)).alias("at"), F.array().cast("array<struct<lane: int, block: long>>").alias("out"))
    order = F.aggregate(F.sequence(begin, end - 1), start, place, lambda x: x["out"])
    placed = both.select("begin", "lanes.source", F.posexplode(order).alias("nth", "job"))
    return placed.select(F.get("source", F.col("job.lane")).alias("source"), "job.block", (F.col("begin") + F.col("nth")).alias("slot"))


def mix_sources(docs: DataFrame, shares: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, seed: int = 7,
                id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """Add ``block``, ``slot`` and ``position`` (from 0, without gaps) to every row of ``docs``.

    ``shares`` gives the target weight of each source (``None``: that of null sources);
    without it, weights are the square roots of the sources' sizes. Sources without a weight
    come after all others, at equal weights. Rows of equal ids, repeated ones too, are placed one after
    the other in the order of a hash of their other columns. An empty table stays empty. Columns of ``docs`` may have any
    names but those of the three that are added.
    """
    clash = sorted(set(RESULTS).intersection(docs.columns))
    if clash:
        raise ValueError(f"rename the columns {clash}: the result has columns of these names")
    own = [f"c{i}" for i in range(len(docs.columns))]
    name = dict(zip(docs.columns, own))
    key = F.coalesce(F.concat(F.lit("s"), F.col(name[source_column]).cast("string")), F.lit("null"))
    rows = docs.toDF(*own).withColumn("source", key).withColumn("at", F.xxhash64(F.lit(seed), name[id_column]))
    found = rows.groupBy("source").count().limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources: group them first")
    if not found:
        return docs.select("*", *[F.lit(None).cast("long").alias(c) for c in RESULTS])
    counts = {r["source"]: r["count"] for r in sorted(found)}
    given = {s: math.sqrt(n) for s, n in counts.items()} if shares is None else {("null" if s is None else f"s{s}"): v for s, v in shares.items()}
    weights = whole_weights({s: given.get(s, 0.0) for s in counts}) if any(given.get(s, 0) > 0 for s in counts) else dict.fromkeys(counts, 0)
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    spark, tables, over = docs.sparkSession, [], 0
    for chosen in ({s: w for s, w in weights.items() if w}, {s: 1 for s, w in weights.items() if not w}):
        if chosen:
            mine = {s: blocks[s] for s in chosen}
            tables.append(schedule(spark, mine, chosen).withColumn("slot", F.col("slot") + over))
            over += sum(mine.values())
    table = stored(reduce(DataFrame.unionByName, tables), "schedule")
    # the last block of a source may be short: rows after it move up
    ends = _literal([{"source": s, "block": n - 1, "missing": -counts[s] % block_rows} for s, n in blocks.items() if counts[s] % block_rows], "array<struct<source: string, block: long, missing: long>>")
    last = table.select("slot", F.get(F.filter(ends, lambda e: (e["source"] == F.col("source")) & (e["block"] == F.col("block"))), F.lit(0))["missing"].alias("missing"))
    short = [r.asDict() for r in last.filter("missing > 0").collect()]  # at most a row a source
    gap = F.aggregate(_literal(short, "array<struct<slot: long, missing: long>>"), F.lit(0).cast("long"), lambda a, g: a + F.when(g["slot"] < F.col("slot"), g["missing"]).otherwise(0))
    buckets = 1 << max(4, min(16, math.ceil(math.log2(max(1, max(counts.values()) / ROWS_PER_BUCKET))) + 4))
    rows = rows.withColumn("bucket", F.pmod("at", F.lit(buckets)))
    tally = rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # one row per bucket
    tally = tally.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    here = F.row_number().over(W.partitionBy("source", "bucket").orderBy("at", name[id_column], F.xxhash64(*own)))
    rows = rows.withColumn("here", here).join(small(tally, rows=len(counts) * buckets), ["source", "bucket"])
    rows = rows.withColumn("rank", F.col("start") + F.col("here") - 1).withColumn("block", F.floor(F.col("rank") / block_rows))
    rows = rows.join(small(table, rows=sum(blocks.values())), ["source", "block"])
    rows = rows.withColumn("position", F.col("slot") * block_rows + F.col("rank") % block_rows - gap)
    return rows.select(*own, *RESULTS).toDF(*docs.columns, *RESULTS)
