"""Mix sources to target weights by pivotal dependent rounding.

Every document of a source shares the source's ratio of target to size. Its whole part is taken for sure; what
remains is a fractional copy probability, held as expected words. Inside blocks of similar sizes, two fractional
documents at a time transfer mass at random until one is integral: expectations and the sum of words stay put. A
block leaves one fractional document at most; these residuals meet in a reduction tree of blocks until each source
has one, which goes to the nearer whole copy: so a source misses its target by half a document at most, at the price
of a bias in that one document of a source.

Defined cases: null text or no word has size 0 and takes 0; a null source is a source of its own and sorts last; an
empty source has target 0; repeated rows are separate documents; an empty table gives no rows; columns besides
doc_id, text and source are ignored. Draws depend on a seed and the rows of a block alone, so reruns agree. Rows of one
doc_id (or none), source and size can't be told apart in the result; they are counted, and their copies are numbered
and dealt to blocks by number, so that they spread.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_side, table, word_count, write_cut

WEIGHTS = (5, 2, 1)
#: A source is repeated this often at most.
MOST = 3.0
#: Documents in a block of the reduction tree, in the mean.
BLOCK = 4096
SEED = 7
_EPS = 1e-6


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size, copies).

    Targets share the total by weight and stop at ``most`` times the size. Ordered by the level at which they stop,
    the stopped sources are a prefix, so one pass of running sums finds the level of the others. The windows run on
    a row for each source.
    """
    by_source = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    by_stop = Window.orderBy("stop", F.col("source").asc_nulls_last())
    before, everything = by_stop.rowsBetween(Window.unboundedPreceding, -1), by_stop.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limit = F.lit(most) * F.col("source_size")
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return (
        by_source.withColumn("weight", weight)
        .withColumn("stop", limit / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "source_size", "level"))).over(everything)["level"])
        .select("source", "source_size", F.when(F.col("level").isNull() | (F.col("stop") < F.col("level")), limit).otherwise(F.col("level") * F.col("weight")).alias("target"))
    )


def _pivot(mass: np.ndarray, size: np.ndarray, draws: np.ndarray) -> int:
    """Round ``mass`` (expected words, between 0 and ``size``) in place, neighbours first.

    Of two fractional documents one gives words to the other until either is empty or whole; the direction is drawn
    so that neither's expectation changes, and the sum of words stays. Returns the position left fractional, or -1.
    """
    at = -1
    for i in range(len(mass)):
        if mass[i] < _EPS or mass[i] > size[i] - _EPS:
            mass[i] = 0.0 if mass[i] < _EPS else size[i]
            continue
        if at < 0:
            at = i
            continue
        up, down = min(mass[at], size[i] - mass[i]), min(mass[i], size[at] - mass[at])  # words that i may get, or give
        give = up if draws[i] * (up + down) < down else -down
        mass[at] -= give
        mass[i] += give
        whole = [mass[k] < _EPS or mass[k] > size[k] - _EPS for k in (at, i)]
        for k, settled in zip((at, i), whole, strict=True):
            if settled:
                mass[k] = 0.0 if mass[k] < _EPS else size[k]
        at = -1 if all(whole) else i if whole[0] else at
    return at


def _rounded(df: DataFrame, keys: list[str], depth: int, last: bool, seed: int) -> DataFrame:
    """Round each group of ``keys``; column ``open`` tells the row that stays fractional."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "tie", "doc_id"], ascending=[False, True, True], na_position="last", kind="stable").reset_index(drop=True)
        name = repr((seed, depth, rows["source"].iloc[0], int(rows["block"].iloc[0])))
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big"))
        mass, size = rows["mass"].to_numpy(np.float64).copy(), rows["size"].to_numpy(np.float64)
        left = _pivot(mass, size, rng.random(len(mass)))
        if last and left >= 0:
            mass[left] = size[left] if 2 * mass[left] >= size[left] else 0.0
            left = -1
        rows["mass"] = mass
        rows["open"] = rows.index == left
        return rows

    return df.groupBy(*keys).applyInPandas(run, df.drop("open").schema.add("open", "boolean"))


def _numbered(sizes: DataFrame, block: int) -> DataFrame:
    """A row for each of the ``copies``, numbered from 0; those of a row with many are made in several tasks."""
    one = sizes.filter("copies = 1").drop("copies").withColumn("copy", F.lit(0).cast("long"))
    many = sizes.filter("copies > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) DIV {block}"))))
    many = many.repartition("doc_id", "source", "size", "part")
    numbers = F.sequence(F.col("part") * block, F.least(F.col("copies"), (F.col("part") + 1) * block) - 1)
    return one.unionByName(many.withColumn("copy", F.explode(numbers)).drop("copies", "part"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every document."""
    sizes = write_cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")), "mix-sizes")
    targets = source_targets(sizes, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    band = F.floor(F.log2(F.col("size") + 1.0) * 4).cast("int")
    blocks = sizes.groupBy("source", band.alias("band")).agg(F.ceil(F.sum("copies") / block).alias("parts"), F.sum("copies").alias("rows")).withColumn("rows", F.sum("rows").over(Window.partitionBy("source"))).withColumnsRenamed({"source": "s", "band": "b"})
    tie = F.xxhash64(F.lit(seed), "doc_id", F.when(F.col("copy") > 0, F.col("copy")), "size")
    rows = (
        _numbered(sizes, block).join(small_side(targets.withColumnRenamed("source", "t"), 64), F.col("source").eqNullSafe(F.col("t")))
        .drop("t")
        .withColumn("band", band)
        .join(small_side(blocks, 64), F.col("source").eqNullSafe(F.col("s")) & (F.col("band") == F.col("b")))
        .withColumn("base", F.floor(ratio + 1e-12).cast("long"))
        .withColumn("mass", F.greatest(F.lit(0.0), ratio - F.col("base")) * F.col("size"))
        .withColumn("tie", tie)
        .withColumn("block", F.when(F.col("rows") <= block, 0).otherwise(F.col("band") * F.lit(1 << 40) + F.pmod(F.col("tie"), F.col("parts"))))  # a small source is one block
        .select("doc_id", "source", "size", "source_size", "target", "base", "mass", "tie", "block")
    )
    depth, done = 0, None
    step = write_cut(_rounded(rows, ["source", "block"], depth, False, seed), "mix-0")
    while True:
        settled, left = step.filter(~F.col("open")), step.filter("open").drop("open")
        done = settled if done is None else done.unionByName(settled)
        most_left = left.groupBy("source").count().agg(F.max("count")).first()[0]
        if not most_left:
            break
        parts, depth = math.ceil(most_left / block), depth + 1
        step = _rounded(left.withColumn("block", F.pmod("tie", F.lit(parts))), ["source", "block"], depth, parts == 1, seed)
        if parts == 1:
            done = done.unionByName(step)
            break
        step = write_cut(step, f"mix-{depth}")
    return done.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("base") + F.round("mass").cast("long")).alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
