"""Token generation with a user's step function."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vlprep.config import MAX_NEW_TOKENS
from vlprep.functions import arrays

ROWS_PER_STEP = 256


def truncate_generation(df: DataFrame, ids: str, attention_mask: str, prompt_len: str, stop_id: int, out: str = "answer_ids") -> DataFrame:
    """Add the row cut before its first stop id, and ``finish_index`` (null = unfinished)."""
    cut = arrays.cut_at_stop(F.col(ids), F.col(attention_mask), F.col(prompt_len), stop_id)
    return df.withColumn("_cut", cut).select(
        "*", F.col("_cut.answer_ids").alias(out), F.col("_cut.finish_index").alias("finish_index")
    ).drop("_cut")


def _uniform(seed, row_id, step: int) -> float:
    return int(hashlib.md5(f"{seed}:{row_id}:{step}".encode()).hexdigest()[:8], 16) / float(1 << 32)


def _next(logits: np.ndarray, temperature: float, draws: list[float]) -> np.ndarray:
    if temperature == 0:
        return logits.argmax(axis=1)
    z = logits / temperature
    p = np.exp(z - z.max(axis=1, keepdims=True))
    sums = np.cumsum(p / p.sum(axis=1, keepdims=True), axis=1)
    return np.minimum((sums <= np.asarray(draws)[:, None]).sum(axis=1), logits.shape[1] - 1)


def generate_table(df: DataFrame, row_id: str, ids: str, loader: Callable[[], Callable], stop_id: int,
                   temperature: float = 0.0, max_steps: int = MAX_NEW_TOKENS, seed=0, rows_per_step: int = ROWS_PER_STEP) -> DataFrame:
    """Continue each row of token ids, one token per step.

    ``loader()`` runs once per Python worker and returns a function from a list of
    id lists to logits, one row each. A row stops at ``stop_id``, which is not
    kept, or after ``max_steps``. Columns: ``row_id``, ``output_ids``,
    ``finish_index`` (place of the stop id, null = unfinished). Draws are seeded
    by row, so results do not depend on which rows share a step.
    """
    kind = df.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step_fn = loader()
        for pdf in batches:
            for start in range(0, len(pdf), rows_per_step):
                part = pdf.iloc[start : start + rows_per_step]
                keys = part[row_id].tolist()
                rows = [list(map(int, r)) for r in part[ids]]
                finish: list[int | None] = [None] * len(rows)
                for step in range(max_steps):
                    open_rows = [i for i, f in enumerate(finish) if f is None]
                    if not open_rows:
                        break
                    logits = np.asarray(step_fn([rows[i] for i in open_rows]), dtype=np.float64)
                    draws = [_uniform(seed, keys[i], step) for i in open_rows]
                    for i, token in zip(open_rows, _next(logits, temperature, draws)):
                        if int(token) == stop_id:
                            finish[i] = len(rows[i])
                        else:
                            rows[i].append(int(token))
                yield pd.DataFrame(
                    {row_id: keys, "output_ids": rows, "finish_index": pd.array(finish, dtype="Int64")}
                )

    return df.select(row_id, ids).mapInPandas(run, f"`{row_id}` {kind}, output_ids array<int>, finish_index bigint")
