"""Vector queries: projections, contrastive loss and zero-shot classification.

Scores are computed by matrix products on blocks of rows. A block never holds
more than ``block`` rows of either side, and only sums or best matches per row
leave it, never the pairs.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vlprep.config import SCALER_MAX, TEMPERATURE_INIT
from vlprep.functions.vectors import l2_normalize
from vlprep.session import cut

BLOCK = 2048
#: Bytes of class vectors that are shipped to the tasks at a time.
CLASS_BYTES = 64 << 20
#: So many classes are fetched without being counted first.
FEW_CLASSES = 1024

_TILE = pa.schema(
    [("batch_id", pa.int64()), ("pos", pa.int64())]
    + [(n, pa.float64()) for n in ("i_top", "i_sum", "t_top", "t_sum", "own", "best_score")]
    + [("best", pa.int64())]
)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of an Arrow list column without nulls, one per row."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(rows.reshape(-1)))


def _by_row(column: pa.Array, compute) -> list[pa.Array]:
    """Apply ``compute`` to the rows that are not null, and put nulls back in their places."""
    present = column.drop_null()
    places = pc.if_else(pc.is_valid(column), pc.cast(pc.cumulative_sum(pc.cast(pc.is_valid(column), pa.int64())), pa.int64()), None)
    return [out.take(pc.subtract(places, 1)) for out in compute(present)]


def _sides(rows: pa.Table, order: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys and vectors of both sides of a tile, each in order of its key."""
    sides = []
    for side in (0, 1):
        part = rows.filter(pc.equal(rows["_side"], side)).sort_by(order)
        vectors = part["_vec"].combine_chunks()
        sides.append((part[order].to_numpy(), _matrix(vectors) if len(part) else np.zeros((0, 0))))
    return sides


def project(df: DataFrame, vector: str, weights, bias=None, out: str = "projected") -> DataFrame:
    """``W x + b`` for each vector; ``weights`` has one row per output dimension."""
    w = np.asarray(weights, dtype=np.float64)
    b = np.zeros(w.shape[0]) if bias is None else np.asarray(bias, dtype=np.float64)
    shared = df.sparkSession.sparkContext.broadcast((w, b))

    @F.arrow_udf("array<double>")
    def apply(column: pa.Array) -> pa.Array:
        weight, shift = shared.value

        def product(present: pa.Array) -> list[pa.Array]:
            if not len(present):
                return [pa.array([], pa.list_(pa.float64()))]
            return [_lists(_matrix(present) @ weight.T + shift)]

        return _by_row(column, product)[0]

    return df.withColumn(out, apply(F.col(vector)))


def pair_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Members of one sample from two tables."""
    return left.join(right, key)


def gather_ranks(df: DataFrame, position: str, micro: int, world: int, out: str = "batch_id") -> DataFrame:
    """Add the global batch that micro batches of all ranks form: ``world`` micro batches each.

    ``pos`` is the place in the global batch; with ``world=1`` batches stay local.
    """
    size = int(micro) * int(world)
    return df.withColumns({out: F.expr(f"`{position}` div {size}"), "pos": F.col(position) % size})


def concat_ranks(tables: list[DataFrame]) -> DataFrame:
    """Tables of the single ranks put together, with column ``rank``."""
    return reduce(DataFrame.unionByName, [t.withColumn("rank", F.lit(i).cast("bigint")) for i, t in enumerate(tables)])


def batch_pairs(df: DataFrame, image: str = "image_vec", text: str = "text_vec", batch: str = "batch_id",
                pos: str = "pos", scaler: float | None = None, block: int = BLOCK, batch_size: int | None = None) -> DataFrame:
    """Every image against every text of its batch, summed up per row and column.

    Per (batch, pos): ``own`` is the score of the matching pair, ``image_lse`` and
    ``text_lse`` are the log-sum-exp of the image's row and the text's column, and
    ``best`` is the text the image scores highest (lowest place on ties).

    ``pos`` runs from zero below ``batch_size`` (found when not given), or the job fails. Batches
    over ``block`` rows are split in tiles of ``block`` x ``block``.
    """
    scale = min(float(np.exp(TEMPERATURE_INIT)), SCALER_MAX) if scaler is None else float(scaler)
    if batch_size is None:
        batch_size = (df.agg(F.max(pos)).first()[0] or 0) + 1
    n_blocks = -(-int(batch_size) // block)
    own_block = F.expr(f"cast(`{pos}` div {block} as int)")
    blocks = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    vec = {0: F.col(image), 1: F.col(text).cast(df.schema[image].dataType)}

    def copy(side: int, row_block: Column, column_block: Column) -> Column:
        return F.struct(F.lit(side).alias("_side"), vec[side].alias("_vec"), row_block.alias("_r"), column_block.alias("_c"))

    # one pass: an image goes to every column block of its row block, a text the other way round
    copies = F.concat(
        F.transform(blocks, lambda b: copy(0, own_block, b)), F.transform(blocks, lambda b: copy(1, b, own_block))
    )
    inside = (F.col(pos) >= 0) & (F.col(pos) < int(batch_size))
    fault = F.raise_error(F.concat(F.lit(f"place outside batches of {int(batch_size)}: "), F.coalesce(F.col(pos).cast("string"), F.lit("null"))))
    place = F.when(inside, F.col(pos).cast("bigint")).otherwise(fault.cast("bigint"))
    sides = df.select(F.col(batch).alias("_batch"), place.alias("_pos"), F.inline(copies))
    schema = (
        "batch_id bigint, pos bigint, i_top double, i_sum double, t_top double, t_sum double, own double,"
        " best_score double, best bigint"
    )

    def tile(rows: pa.Table) -> pa.Table:
        (ipos, left), (tpos, right) = _sides(rows, "_pos")
        if not len(ipos) or not len(tpos):
            return pa.table({n: [] for n in _TILE.names}, schema=_TILE)
        z = left @ right.T * scale
        i_top, t_top, at = z.max(axis=1), z.max(axis=0), z.argmax(axis=1)
        own = np.full(len(ipos), np.nan)
        _, where_i, where_t = np.intersect1d(ipos, tpos, assume_unique=True, return_indices=True)
        own[where_i] = z[where_i, where_t]
        n, m = len(ipos), len(tpos)
        image_only = lambda v: pa.array(np.concatenate([v, np.zeros(m, v.dtype)]), mask=np.arange(n + m) >= n)
        text_only = lambda v: pa.array(np.concatenate([np.zeros(n, v.dtype), v]), mask=np.arange(n + m) < n)
        return pa.table(
            [
                pa.array(np.full(n + m, rows["_batch"][0].as_py())),
                pa.array(np.concatenate([ipos, tpos])),
                image_only(i_top),
                image_only(np.exp(z - i_top[:, None]).sum(axis=1)),
                text_only(t_top),
                text_only(np.exp(z - t_top[None, :]).sum(axis=0)),
                pc.if_else(pc.is_nan(image_only(own)), None, image_only(own)),
                image_only(i_top),
                image_only(tpos[at]),
            ],
            schema=_TILE,
        )

    tiles = sides.groupBy("_batch", "_r", "_c").applyInArrow(tile, schema)
    part = lambda top, s: F.collect_list(F.when(F.col(top).isNotNull(), F.struct(F.col(top).alias("m"), F.col(s).alias("s"))))
    merged = tiles.groupBy("batch_id", "pos").agg(
        part("i_top", "i_sum").alias("_i"),
        part("t_top", "t_sum").alias("_t"),
        F.max("own").alias("own"),
        F.max_by("best", F.when(F.col("best").isNotNull(), F.struct("best_score", -F.col("best")))).alias("best"),
    )

    # one entry per tile: shift to the common maximum, add up
    def lse(parts: str):
        top = F.array_max(F.transform(parts, lambda p: p["m"]))
        total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p["s"] * F.exp(p["m"] - top))
        return top + F.log(total)

    return merged.select("batch_id", "pos", "own", lse("_i").alias("image_lse"), lse("_t").alias("text_lse"), "best")


def contrastive_loss(pairs: DataFrame) -> DataFrame:
    """Loss per batch from :func:`batch_pairs`: cross-entropy by row and by column, averaged."""
    return pairs.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg(F.col("image_lse") - F.col("own")).alias("image_loss"),
        F.avg(F.col("text_lse") - F.col("own")).alias("text_loss"),
        ((F.avg(F.col("image_lse") - F.col("own")) + F.avg(F.col("text_lse") - F.col("own"))) / 2).alias("loss"),
    )


def contrastive_report(images: DataFrame, texts: DataFrame, micro: int, world: int = 1, key: str = "key",
                       position: str = "place", scaler: float | None = None, block: int = BLOCK, normalize: bool = True) -> DataFrame:
    """Contrastive loss of the batches that ``world`` ranks of ``micro`` pairs form.

    ``images`` has ``key``, ``position`` and ``image_vec``; ``texts`` has ``key`` and
    ``text_vec``, both scaled to length 1 unless ``normalize`` is off. ``world=1``
    gives the loss each rank would see alone.
    """
    if normalize:
        images = images.withColumn("image_vec", l2_normalize(F.col("image_vec")))
        texts = texts.withColumn("text_vec", l2_normalize(F.col("text_vec")))
    pairs = gather_ranks(pair_by_key(images, texts, key), position, micro, world)
    return contrastive_loss(batch_pairs(pairs, scaler=scaler, block=block, batch_size=micro * world))


def class_vectors(df: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """Mean vector per label, normalised. Vectors are summed in place, not exploded."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return df.groupBy(label).agg(mean.alias("_mean")).select(label, l2_normalize(vector_to_array("_mean")).alias("class_vec"))


def zero_shot(images: DataFrame, classes: DataFrame, vector: str = "embedding", class_vec: str = "class_vec",
              label: str = "label", scaler: float = 1.0, class_block: int | None = None) -> DataFrame:
    """Add ``predicted`` and ``score``: the class whose vector scores highest, the lowest label on ties.

    Classes are shipped to the tasks, at most ``class_block`` at a time (by default as many as
    ``CLASS_BYTES`` hold); images stay where they are. With more classes than
    that, the images are written after each block with the best class so far.
    """
    names = classes.select(F.col(label).cast("bigint").alias("label"), F.col(class_vec).cast("array<double>").alias("v"))
    out = images.withColumns({"predicted": F.lit(None).cast("bigint"), "score": F.lit(None).cast("double")})
    few = names.limit(min(class_block or FEW_CLASSES, FEW_CLASSES) + 1).toPandas()
    if len(few) <= min(class_block or FEW_CLASSES, FEW_CLASSES):
        return _best_of(out, few, vector, scaler)
    table = cut(names)
    size, n_classes = table.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    n_blocks = -(-n_classes // (class_block or max(1, CLASS_BYTES // (8 * max(size, 1)))))
    for i in range(n_blocks):
        part = table.filter(F.pmod(F.xxhash64("label"), F.lit(n_blocks)) == i).toPandas()  # at most about a block
        out = _best_of(out, part, vector, scaler)
        if i < n_blocks - 1 and len(part):
            out = cut(out)
    return out


def _best_of(images: DataFrame, classes: pd.DataFrame, vector: str, scaler: float) -> DataFrame:
    """The better one of each row's ``predicted`` and ``score`` and the best of some classes."""
    if classes.empty:
        return images
    classes = classes.sort_values("label")
    shared = images.sparkSession.sparkContext.broadcast((classes["label"].to_numpy(), np.stack(classes["v"].to_numpy())))

    @F.arrow_udf("struct<predicted bigint, score double>")
    def best(column: pa.Array) -> pa.Array:
        names, matrix = shared.value

        def highest(present: pa.Array) -> list[pa.Array]:
            places, scores = np.zeros(len(present), np.int64), np.zeros(len(present))
            for begin in range(0, len(present), BLOCK):  # a tile of scores at a time
                z = _matrix(present.slice(begin, BLOCK)) @ matrix.T * scaler
                places[begin : begin + BLOCK], scores[begin : begin + BLOCK] = z.argmax(axis=1), z.max(axis=1)
            return [pa.array(names[places], pa.int64()), pa.array(scores, pa.float64())]

        predicted, score = _by_row(column, highest)
        return pa.StructArray.from_arrays([predicted, score], names=["predicted", "score"])

    new, score, predicted = F.col("_best.score"), F.col("score"), F.col("predicted")
    better = score.isNull() | (new > score) | ((new == score) & (F.col("_best.predicted") < predicted))
    return (
        images.withColumn("_best", best(F.col(vector)))
        .withColumns({"predicted": F.when(better, F.col("_best.predicted")).otherwise(predicted), "score": F.when(better, new).otherwise(score)})
        .drop("_best")
    )
