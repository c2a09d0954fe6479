"""Sums of many resamples in one pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Weights worked out at a time, and sums that a task holds before it hands them on.
CELLS, HELD = 1 << 20, 1 << 22
#: Cumulative probabilities of a Poisson count with mean 1, as numbers below 2**32.
_POISSON = np.ceil(np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 8)])) * (1 << 32)).clip(max=(1 << 32) - 1).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def poisson_counts(high: np.ndarray, low: np.ndarray, draws: int) -> np.ndarray:
    """A row of counts for each key, a column for each draw; a key is 64 bits of a hash."""
    x = low.astype(np.uint32)[:, None] + np.arange(draws, dtype=np.uint32) * np.uint32(0x9E3779B9)
    x = _mix(_mix(x) ^ high.astype(np.uint32)[:, None])
    counts = np.zeros(x.shape, np.uint8)
    for bound in _POISSON:
        counts += x >= bound
    return counts


def resampled_sums(rows: DataFrame, by: list[str], key: str, value: str, draws: int, seed: int) -> DataFrame:
    """(by..., draw, s, w): in each draw the sum of weighted values and of weights.

    A draw gives every row a Poisson(1) count from a hash of its key, in place of n draws with replacement: so n varies
    a little between draws, and rows neither move nor multiply. Partitions hand on a list of sums for each group.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    half = [F.conv(F.substring(digest, at, 8), 16, 10).cast("long").alias(n) for at, n in ((1, "_high"), (9, "_low"))]
    schema = T.StructType([*rows.select(*by).schema.fields, *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in "sw"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[tuple, int] = {}
        held: list[np.ndarray] = []

        def full() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in number], types[i]) for i in range(len(by))]
            sums = [pa.array([h[j] for h in held], pa.list_(pa.float64())) for j in (0, 1)]
            number.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([*columns, *sums], [*by, "s", "w"])

        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * batch.num_rows
            v, high, low = (batch.column(c).to_numpy(zero_copy_only=False) for c in (value, "_high", "_low"))
            step = max(1, CELLS // draws)
            for at in range(0, len(keys), step):
                part = slice(at, at + step)
                for k in keys[part]:
                    if k not in number:
                        number[k] = len(number)
                        held.append(np.zeros((2, draws)))
                group = np.array([number[k] for k in keys[part]])
                order = np.argsort(group, kind="stable")
                group = group[order]
                counts = poisson_counts(high[part][order], low[part][order], draws).astype(np.float64)
                starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                for g, s, w in zip(group[starts], np.add.reduceat(counts * v[part][order, None], starts, axis=0), np.add.reduceat(counts, starts, axis=0), strict=True):
                    held[g] += (s, w)
                if len(held) * draws * 2 > HELD:
                    yield full()
        if held:
            yield full()

    made = rows.select(*by, F.col(value).cast("double").alias(value), *half).mapInArrow(run, schema)
    draw = F.posexplode(F.arrays_zip("s", "w")).alias("draw", "x")
    return made.select(*by, draw).groupBy(*by, "draw").agg(F.sum("x.s").alias("s"), F.sum("x.w").alias("w"))
