"""Decision traces: per row a vector of logits, allowed ids and a gold id, read by higher-order functions in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not again for every element of a lambda around it."""
    return F.transform(F.array(value), body)[0]


def log_sum_exp(x: Column) -> Column:
    return let(F.array_max(x), lambda top: top + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))))


def softmax(x: Column, temperature: float = 1.0) -> Column:
    scaled = F.transform(x, lambda v: v / temperature)
    return let(scaled, lambda s: let(log_sum_exp(s), lambda whole: F.transform(s, lambda v: F.exp(v - whole))))


def nll(x: Column, gold: Column) -> Column:
    """Cross entropy of a gold id (from 0); null when it is out of range."""
    return F.when(gold.between(0, F.size(x) - 1), log_sum_exp(x) - F.element_at(x, (gold + 1).cast("int")))


def argmax(x: Column) -> Column:
    """First position of the largest value, from 0."""
    return F.array_position(x, F.array_max(x)).cast("long") - 1


def nll_stats(df: DataFrame, x: str, gold: str, by: list[str]) -> DataFrame:
    """(by..., nll, n, hits): sums that merge."""
    loss = nll(F.col(x), F.col(gold))
    return df.select(*by, loss.alias("l"), (argmax(F.col(x)) == F.col(gold)).alias("h")).groupBy(*by).agg(F.sum("l").alias("nll"), F.count("l").alias("n"), F.count_if(F.col("h")).alias("hits"))


def legal(x: Column, allowed: Column) -> Column:
    """struct(argmax_legal, mass): whether the best id is allowed, and the softmax mass on allowed ids."""
    p = softmax(x)
    mass = F.aggregate(F.filter(p, lambda v, i: F.array_contains(allowed, i)), F.lit(0.0), lambda a, v: a + v)
    return F.struct(F.array_contains(allowed, argmax(x).cast("int")).alias("argmax_legal"), mass.alias("mass"))


def decision(x: Column, allowed: Column, gold: Column, temperature: float) -> Column:
    """struct(raw_rank, legal_rank, p, p_t, entropy): rank of the gold id, its probability among allowed ids at two temperatures, entropy."""
    def described(inside: Column) -> Column:
        g = F.element_at(x, (gold + 1).cast("int"))

        def p(t: float) -> Column:
            return F.exp(g / t - log_sum_exp(F.transform(inside, lambda v: v / t)))

        entropy = F.aggregate(softmax(inside), F.lit(0.0), lambda a, q: a - F.when(q > 0, q * F.log(q)).otherwise(0.0))
        above = lambda values: let(g, lambda gold_value: F.size(F.filter(values, lambda v: v > gold_value)) + 1)
        return F.struct(above(x).alias("raw_rank"), above(inside).alias("legal_rank"), p(1.0).alias("p"), p(temperature).alias("p_t"), entropy.alias("entropy"))

    return let(F.filter(x, lambda v, i: F.array_contains(allowed, i)), described)


def history_pairs(a: DataFrame, b: DataFrame, state: list[str], target: str, allowed: str) -> DataFrame:
    """Decisions of two traces in one state; a row where targets or allowed sets differ is an error when read."""
    left = a.select(*state, *[F.col(c).alias(f"a_{c}") for c in a.columns if c not in state])
    right = b.select(*state, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in state])
    same = F.col(f"a_{target}").eqNullSafe(F.col(f"b_{target}")) & F.col(f"a_{allowed}").eqNullSafe(F.col(f"b_{allowed}"))
    on = [left[c].eqNullSafe(right[c]) for c in state]
    joined = left.join(right, on).drop(*[right[c] for c in state])
    return joined.filter(F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("decisions of one state differ")).cast("boolean")))


def split_accuracy(df: DataFrame, gold: str, predicted: str, by: list[str]) -> DataFrame:
    """Accuracy of rows, of their lanes, and recall of taps and starts; tokens are row digits of equal length."""
    pairs = F.arrays_zip(F.split(gold, "").alias("g"), F.split(predicted, "").alias("p"))
    rows = df.select(*by, (F.col(gold) == F.col(predicted)).alias("row"), F.explode(F.filter(pairs, lambda x: x["g"] != "")).alias("x"))
    lane = F.col("x.g") == F.col("x.p")
    n = lambda d: F.count_if(F.col("x.g") == d)
    return rows.groupBy(*by).agg(F.avg(F.col("row").cast("double")).alias("row_accuracy"), F.avg(lane.cast("double")).alias("lane_accuracy"), F.when(n("1") > 0, F.count_if(lane & (F.col("x.g") == "1")) / n("1")).alias("tap_recall"), F.when(n("2") > 0, F.count_if(lane & (F.col("x.g") == "2")) / n("2")).alias("start_recall"))


def row_marginals(df: DataFrame, key: str, x: str, allowed: str, facts: DataFrame, fact_id: str, heads: str, most: int = 4) -> DataFrame:
    """(key, p_0.., expected): probability of each number of heads among allowed ids. ``facts`` is the vocabulary, one row an id."""
    each = df.select(key, F.posexplode(x).alias("i", "v"), allowed).filter(F.array_contains(allowed, F.col("i"))).select(key, "i", "v")
    top = each.groupBy(key).agg(F.max("v").alias("top"))
    weights = each.join(top, key).withColumn("w", F.exp(F.col("v") - F.col("top"))).join(F.broadcast(facts.select(F.col(fact_id).alias("i"), F.col(heads).alias("h"))), "i")
    total = F.sum("w")
    return weights.groupBy(key).agg(*[(F.sum(F.when(F.col("h") == k, F.col("w")).otherwise(0.0)) / total).alias(f"p_{k}") for k in range(most + 1)], (F.sum(F.col("w") * F.col("h")) / total).alias("expected"))


def trace_summary(df: DataFrame, by: list[str], skipped: str, extra: str, rank: str) -> DataFrame:
    """Per trace: steps, steps with skipped or extra references, runs of such steps are counted as blocks, median rank."""
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy("step")
    bad = (F.col(skipped) > 0) | (F.col(extra) > 0)
    rows = df.withColumn("_bad", bad).withColumn("_new", bad & ~F.coalesce(F.lag(bad).over(order), F.lit(False)))
    return rows.groupBy(*by).agg(F.count("*").alias("steps"), F.count_if(F.col(skipped) > 0).alias("skipping"), F.count_if(F.col(extra) > 0).alias("extra"), F.count_if("_new").alias("blocks"), F.percentile(rank, 0.5).alias("median_rank"))


def aligned_pairs(a: DataFrame, b: DataFrame, position: list[str], same: list[str]) -> DataFrame:
    """Two traces by position; a position where they differ in ``same``, or that one lacks, is an error when read."""
    left = a.select(*position, F.struct(*a.columns).alias("a"))
    right = b.select(*position, F.struct(*b.columns).alias("b"))
    ok = F.col("a").isNotNull() & F.col("b").isNotNull()
    for c in same:
        ok = ok & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return left.join(right, position, "full").filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("traces don't align"))).cast("boolean"))
