"""Leakage-safe splits, donors, samples and the checks of frozen artifacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolane.functions.hashing import hash_int, split_position
from chronolane.functions.scalars import check_ratios
from chronolane.session import parts_for


#: Keys that are ranked in one task, in the mean.
BUCKET = 1 << 17


def hash_split(groups: DataFrame, group: str, ratios: dict[str, float], seed: int = 0) -> DataFrame:
    """Add ``split``: the group's hash position against the cumulative ratios. A projection, no shuffle."""
    position, total, out = split_position(seed, F.col(group)), 0.0, None
    for name, share in check_ratios(ratios).items():
        total += share
        test = position < total
        out = F.when(test, name) if out is None else out.when(test, name)
    return groups.withColumn("split", out.otherwise(list(ratios)[-1]))


def assign_splits(charts: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """The group decides a chart's split; charts of unknown groups are left out (see drift)."""
    return charts.join(groups.select(group, "split"), group)


def split_counts(charts: DataFrame, group: str, names: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """(split, groups, charts), a row for each name even if empty."""
    counts = charts.groupBy("split").agg(F.count_distinct(group).alias("groups"), F.count("*").alias("charts"))
    every = charts.sparkSession.createDataFrame([(n,) for n in names], "split string")
    return every.join(counts, "split", "left").select("split", F.coalesce("groups", F.lit(0)).cast("long").alias("groups"), F.coalesce("charts", F.lit(0)).cast("long").alias("charts"))


def drift(now: DataFrame, snapshot: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(kind, key): extra (now only), missing (snapshot only), or changed_<value> where both have it differently.

    One full join on the key finds all kinds.
    """
    a = now.select(F.col(key).alias("a"), *[F.col(v).alias(f"a_{v}") for v in values])
    b = snapshot.select(F.col(key).alias("b"), *[F.col(v).alias(f"b_{v}") for v in values])
    kinds = F.filter(
        F.array(F.when(F.col("b").isNull(), "extra"), F.when(F.col("a").isNull(), "missing"), *[F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}")), f"changed_{v}") for v in values]),
        lambda k: k.isNotNull(),
    )
    return a.join(b, F.col("a") == F.col("b"), "full").select(F.explode(kinds).alias("kind"), F.coalesce("a", "b").alias("key"))


def integrity(charts: DataFrame, group: str, key: str, names: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Violations (rule, what): a group in more than one split, a repeated key, a split without charts."""
    split_groups = charts.groupBy(group).agg(F.count_distinct("split").alias("n")).filter("n > 1").select(F.lit("group in several splits").alias("rule"), F.col(group).cast("string").alias("what"))
    repeated = charts.groupBy(key).count().filter("count > 1").select(F.lit("repeated key").alias("rule"), F.col(key).cast("string").alias("what"))
    every = charts.sparkSession.createDataFrame([(n,) for n in names], "split string")
    empty = every.join(charts.select("split").distinct(), "split", "left_anti").select(F.lit("empty split").alias("rule"), F.col("split").alias("what"))
    return split_groups.unionByName(repeated).unionByName(empty)


def difference(a: DataFrame, b: DataFrame, key: str, most: int = 20) -> DataFrame:
    """(side, n, sample): keys on one side only, and the first of them."""
    sides = []
    for name, x, y in (("left_only", a, b), ("right_only", b, a)):
        only = x.select(key).distinct().join(y.select(key), key, "left_anti")
        sides.append(only.orderBy(key).limit(most).agg(F.array_sort(F.collect_list(key)).alias("sample")).crossJoin(only.agg(F.count("*").alias("n"))).select(F.lit(name).alias("side"), "n", "sample"))
    return sides[0].unionByName(sides[1])


def require_subset(frozen: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """The frozen rows; an error names a key outside the pool when the rows are read."""
    known = pool.select(F.col(key).alias("_known")).distinct()
    joined = frozen.join(known, F.col(key) == F.col("_known"), "left")
    bad = F.raise_error(F.concat(F.lit("not in the pool: "), F.col(key).cast("string")))
    return joined.withColumn(key, F.when(F.col("_known").isNotNull(), F.col(key)).otherwise(bad.cast(dict(frozen.dtypes)[key]))).drop("_known")


def order_of(key: str, *seed: str | int) -> list[Column]:
    """A seeded order of keys that doesn't depend on the order of rows."""
    return [F.md5(F.concat_ws("|", *[F.lit(str(s)) for s in seed], F.col(key).cast("string"))), F.col(key)]


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n of the distinct keys."""
    return df.select(key).distinct().orderBy(*order_of(key, seed)).limit(n)


def uniform_pick(df: DataFrame, by: list[str], key: str, seed: int) -> DataFrame:
    """One row of each group, and how many there were. Two pre-aggregated passes, no group is gathered."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return df.groupBy(*by).agg(F.min_by(F.col(key), F.struct(h, F.col(key))).alias(key), F.count("*").alias("matches"))


def stratified_pick(df: DataFrame, group: str, part: str, key: str, groups: int, most: int, seed: int) -> DataFrame:
    """``groups`` groups, one part of each, at most ``most`` keys of that part."""
    chosen = seeded_sample(df, group, groups, seed)
    parts = uniform_pick(df.join(F.broadcast(chosen), group).select(group, part).distinct(), [group], part, seed).drop("matches")
    rows = df.join(F.broadcast(parts), [group, part])
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order_of(key, seed)))
    return rows.withColumn("n", rank).filter(F.col("n") <= most).select(group, part, key)


def donor_map(charts: DataFrame, key: str, seed: int, buckets: int | None = None) -> DataFrame:
    """(target, donor): each target draws one donor of the same pool, itself allowed, whatever the order of rows.

    Ranks inside hash buckets and the buckets' running totals number the pool without a global sort. Buckets are 64, and
    more for a pool of over 64 * BUCKET; a row for each is broadcast.
    """
    pool = charts.select(key).distinct()
    buckets = buckets or max(64, -(-pool.count() // BUCKET))
    bucketed = pool.withColumn("b", F.pmod(hash_int("pool", F.col(key)), F.lit(buckets)))
    sizes = bucketed.groupBy("b").agg(F.count("*").alias("n"))
    offsets = sizes.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    numbered = bucketed.withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy(key)) - 1).join(F.broadcast(offsets), "b")
    places = numbered.select((F.col("first") + F.col("rank")).alias("place"), F.col(key).alias("donor"))
    draws = numbered.select(F.col(key).alias("target"), F.pmod(hash_int(seed, F.col(key)), F.col("total")).alias("place"))
    return draws.join(places, "place").select("target", "donor")


def donor_join(targets: DataFrame, donors: DataFrame, meta: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields of each target and of its donor; a donor without a row is an error."""
    mine = targets.select(F.col(key).alias("target"), *[F.col(f).alias(f"target_{f}") for f in fields])
    theirs = meta.select(F.col(key).alias("_found"), *[F.col(f).alias(f"donor_{f}") for f in fields])
    out = mine.join(donors, "target").join(theirs, F.col("donor") == F.col("_found"), "left")
    ok = F.when(F.col("_found").isNotNull(), F.col("donor")).otherwise(F.raise_error(F.concat(F.lit("donor without a row: "), F.col("donor").cast("string"))).cast(dict(donors.dtypes)["donor"]))
    return out.withColumn("donor", ok).drop("_found")


def scenario_cases(charts: DataFrame, key: str, scenarios: list[str], modes: dict[str, int]) -> DataFrame:
    """(key, scenario, mode, seed): every scenario in every mode, with seeds 0..n-1 of the mode; greedy modes have one."""
    cases = [(s, m, i) for s in scenarios for m, n in modes.items() for i in range(n)]
    plan = charts.sparkSession.createDataFrame(cases, "scenario string, mode string, seed long")
    return charts.select(key).crossJoin(F.broadcast(plan))


def coverage(expected: DataFrame, journal: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., problem): cases missing from the journal, and ones it shouldn't have."""
    parts = parts_for(expected.sparkSession, expected.count() + journal.count())
    a, b = (df.select(*keys).repartition(parts, *keys).distinct().withColumn(name, F.lit(True)) for df, name in ((expected, "e"), (journal, "j")))
    return a.join(b, keys, "full").filter("e IS NULL OR j IS NULL").select(*keys, F.when(F.col("j").isNull(), "missing").otherwise("unexpected").alias("problem"))


def reusable(stored: DataFrame, wanted: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to reuse, rows to make): stored rows whose every frozen field equals a wanted row's, nulls included."""
    same = reduce(lambda a, b: a & b, [stored[f].eqNullSafe(wanted[f]) for f in fields])
    return stored.join(wanted, same, "left_semi"), wanted.join(stored, same, "left_anti")


def universe_digest(df: DataFrame, key: str) -> DataFrame:
    """(digest, n) of the distinct keys, whatever their order and number.

    A key's sha256 is eight numbers of 32 bits; each is summed over all keys, and the digest is that of the count and the
    sums. Sums add up where the keys are, so nothing is sorted or gathered. Null keys don't count.
    """
    keys = df.filter(F.col(key).isNotNull()).select(F.sha2(F.col(key).cast("string"), 256).alias("h")).distinct()
    parts = [F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(10,0)")).cast("decimal(38,0)").alias(f"s{i}") for i in range(8)]
    sums = keys.agg(F.count("*").alias("n"), *parts)
    return sums.select(F.sha2(F.concat_ws("|", F.col("n").cast("string"), *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) for i in range(8)]), 256).alias("digest"), "n")


def retain(df: DataFrame, by: list[str], step: str, loss: str, newest: int = 3) -> DataFrame:
    """The newest rows of each group and its best."""
    last = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(step)))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(loss, step))
    return df.withColumn("_last", last).withColumn("best", best == 1).filter((F.col("_last") <= newest) | F.col("best")).drop("_last")


def bound_sets(charts: DataFrame, files: DataFrame, group: str, name: str, file: str) -> DataFrame:
    """(group, charts, bound, complete): charts whose named file is in their set, by base name without case."""
    base = lambda c: F.lower(F.regexp_extract(c, r"([^/\\]*)$", 1))
    have = files.select(F.col(group), base(F.col(file)).alias("_b")).distinct().withColumn("_has", F.lit(True))
    return charts.withColumn("_b", base(F.col(name))).join(have, [group, "_b"], "left").groupBy(group).agg(F.count("*").alias("charts"), F.count("_has").alias("bound"), F.bool_and(F.col("_has").isNotNull()).alias("complete"))


def set_layout(files: DataFrame, referenced: DataFrame, group: str, file: str, chart_suffix: str) -> DataFrame:
    """(group, exact): whether a set's files besides charts are just the referenced ones."""
    others = files.filter(~F.col(file).endswith(chart_suffix)).select(group, F.col(file).alias("f"), F.lit(1).alias("x"), F.lit(0).alias("y"))
    wanted = referenced.select(group, F.col(file).alias("f"), F.lit(0).alias("x"), F.lit(1).alias("y"))
    each = others.unionByName(wanted).groupBy(group, "f").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return each.groupBy(group).agg(F.bool_and(F.col("x") == F.col("y")).alias("exact"))


def cache_audit(left: DataFrame, right: DataFrame, stem: str, valid: Column) -> DataFrame:
    """(stem, state): valid or invalid where both files exist, else the side that stands alone."""
    a, b = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    state = F.when(F.col("_r").isNull(), "left_orphan").when(F.col("_l").isNull(), "right_orphan").when(valid, "valid").otherwise("invalid")
    return a.join(b, stem, "full").select(stem, state.alias("state"))
