"""Exact ranks and percentiles without sorting a group in one task.

Equal values are counted first. Cells cut the values at approximate quantiles of what was counted; which cell a value is
in follows from the value alone, so a lost task makes the same cells again. Values are ordered inside their cell, and the
counts of the cells before it are added: only a row for each cell and group is ever summed in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a value's range, and the rank error of their bounds.
CELLS, ERROR = 128, 0.002


def _same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[p].eqNullSafe(right[q]) for p, q in pairs])


def running_counts(df: DataFrame, by: list[str], value: str, cells: int = CELLS) -> DataFrame:
    """(by..., value, n, before, total): each different value, how many rows have it, a smaller one, and any in the group. Nulls don't count."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    bounds = sorted({x for x in counts.select(F.col(value).cast("double").alias("_v")).approxQuantile("_v", [i / cells for i in range(1, cells)], ERROR) if x == x})
    cell = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(value).cast("double"))) if bounds else F.lit(0)
    counts = counts.withColumn("_cell", cell)
    upward = Window.partitionBy(*by).orderBy("_cell")
    sums = counts.groupBy(*by, "_cell").agg(F.sum("n").alias("_n"))
    sums = sums.withColumn("_before", F.sum("_n").over(upward) - F.col("_n")).withColumn("total", F.sum("_n").over(Window.partitionBy(*by)))
    named = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_cell").alias("_at"), "_before", "total")
    rows = counts.join(named, _same(counts, named, [*[(c, f"_by_{c}") for c in by], ("_cell", "_at")]))
    inside = F.sum("n").over(Window.partitionBy(*by, "_cell").orderBy(value)) - F.col("n")
    return rows.withColumn("before", F.col("_before") + inside).select(*by, value, "n", "before", "total")


def average_ranks(df: DataFrame, by: list[str], ranks: dict[str, str]) -> DataFrame:
    """Add for each ``name: value`` the rank of the value inside ``by``; ties share their mean rank, nulls have none."""
    rows = df  # every rank counts the rows as they came
    for name, value in ranks.items():
        counted = running_counts(rows, by, value)
        placed = counted.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col(value).alias("_value"), (F.col("before") + (F.col("n") + 1) / 2).alias(name))
        df = df.join(placed, _same(df, placed, [*[(c, f"_by_{c}") for c in by], (value, "_value")]), "left").select(*df.columns, name)
    return df


def exact_percentiles(df: DataFrame, value: str, by: list[str], points: dict[str, float]) -> DataFrame:
    """(by..., name...): percentiles with linear interpolation between neighbouring ranks; no row for a group of nulls."""
    counted = running_counts(df, by, value)
    wide = []
    for name, p in points.items():
        at = F.lit(float(p)) * (F.col("total") - 1)
        here = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n")), F.col(value).cast("double")))
        wide += [here(F.floor(at)).alias(f"_low_{name}"), here(F.ceil(at)).alias(f"_high_{name}"), F.max(at - F.floor(at)).alias(f"_share_{name}")]
    out = counted.groupBy(*by).agg(*wide)
    blend = lambda n: (F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_share_{n}")).alias(n)
    return out.select(*by, *[blend(n) for n in points])
