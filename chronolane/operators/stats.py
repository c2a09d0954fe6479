"""Evaluation statistics. The chart is the unit: samples are averaged inside it first. Undefined is null, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolane.functions.resampling import resampled_sums
from chronolane.functions.scalars import finite, ratio
from chronolane.operators.ranks import average_ranks, exact_percentiles
from chronolane.session import cut


def chart_values(df: DataFrame, chart: str, value: Column, by: list[str] | None = None) -> DataFrame:
    """(by..., chart, value): mean of the finite values of a chart."""
    return df.groupBy(*(by or []), chart).agg(F.avg(finite(value)).alias("value"))


def describe_values(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """count, mean, p10, p50, p90, min and max of the finite values; null when there are none."""
    x = finite(F.col(value))
    if not by:  # all rows are one group: no task is to hold every value
        rows = df.select(x.cast("double").alias("_x"))
        points = exact_percentiles(rows, "_x", [], {"p10": 0.1, "p50": 0.5, "p90": 0.9})
        sums = rows.agg(F.count("_x").alias("count"), F.avg("_x").alias("mean"), F.min("_x").alias("min"), F.max("_x").alias("max"))
        return sums.join(F.broadcast(points), F.lit(True)).select("count", "mean", "p10", "p50", "p90", "min", "max")  # a row each
    p = F.percentile(x, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = df.groupBy(*by).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), p.alias("p"), F.min(x).alias("min"), F.max(x).alias("max"))
    return out.select(*by, "count", "mean", *[F.col("p")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90"))], "min", "max")


def percentiles(df: DataFrame, value: str, by: list[str], points: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, by counts of values dealt in cells; approximate ones are the caller's choice."""
    return exact_percentiles(df, value, by, points)


def mean_interval(values: DataFrame, chart: str, value: str, by: list[str], draws: int = 2000, level: float = 0.95, seed: int = 20261106) -> DataFrame:
    """(by..., n, mean, low, high): percentile bootstrap over charts; no bounds for fewer than two.

    Each draw gives every chart a Poisson(1) count in place of drawing n charts with replacement, so bounds differ from
    that bootstrap's by the spread of n. Sums are made where the rows are; a row for each draw and group is shuffled.
    """
    rows = values.filter(finite(F.col(value)).isNotNull())
    sums = resampled_sums(rows.select(*by, F.col(value).alias("_v"), F.col(chart).alias("_k")), by, "_k", "_v", draws, seed)
    tail = (1 - level) / 2
    bounds = sums.filter("w > 0").groupBy(*by).agg(F.percentile(F.col("s") / F.col("w"), F.array(F.lit(tail), F.lit(1 - tail))).alias("b"))
    means = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    joined = means.join(bounds, by) if by else means.crossJoin(bounds)
    return joined.select(*by, "n", "mean", *[F.when(F.col("n") >= 2, F.col("b")[i]).alias(c) for i, c in enumerate(("low", "high"))])


def paired_by_chart(left: DataFrame, right: DataFrame, chart: str, value: str, by: list[str] | None = None) -> DataFrame:
    """(by..., chart, left, right, difference): right minus left; a chart on one side has a null difference."""
    keys = [*(by or []), chart]
    both = left.select(*keys, F.col(value).alias("left")).join(right.select(*keys, F.col(value).alias("right")), keys, "full")
    return both.withColumn("difference", F.col("right") - F.col("left"))


def slope(x: Column, y: Column, centred: bool = False) -> Column:
    """Aggregate: slope through the origin, or centred; null where x has no spread."""
    if centred:
        return F.when(F.var_pop(F.when(y.isNotNull(), x)) > 0, F.regr_slope(y, x))
    xx = F.sum(F.when(y.isNotNull(), x * x))
    return F.when(xx > 0, F.sum(x * y) / xx)


def condition_response(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """Per field: pairs, missing, unchanged, slope, direction matches and rate, mean changes of target and generated.

    ``pairs`` has target_a_f, target_b_f, made_a_f, made_b_f for each field f.
    """
    long = pairs.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f"target_b_{f}") - F.col(f"target_a_{f}")).alias("target"), (F.col(f"made_b_{f}") - F.col(f"made_a_{f}")).alias("made")) for f in fields])).alias("x")).select("x.*")
    known = F.col("target").isNotNull() & F.col("made").isNotNull()
    moved = known & (F.col("target") != 0)
    hit = moved & (F.signum("made") == F.signum("target"))
    x, y = F.when(moved, F.col("target")), F.when(moved, F.col("made"))
    n = F.count_if(moved)
    return long.groupBy("field").agg(
        n.alias("pairs"), F.count_if(~known).alias("missing"), F.count_if(known & (F.col("target") == 0)).alias("unchanged"),
        slope(x, y).alias("slope"), F.count_if(hit).alias("direction_matches"), F.when(n > 0, F.count_if(hit) / n).alias("direction_rate"),
        F.avg(F.abs(x)).alias("target_change"), F.avg(F.abs(y)).alias("made_change"),
    )


def control_response(rows: DataFrame, chart: str, level: str, value: str) -> DataFrame:
    """Per chart: levels seen, whether complete, centred slope, whether nondecreasing, highest minus lowest level."""
    levels = rows.select(level).distinct().count()
    each = rows.groupBy(chart, level).agg(F.avg(value).alias("v"))
    sorted_ = F.array_sort(F.collect_list(F.struct(F.col(level).alias("x"), F.col("v").alias("y"))))
    out = each.groupBy(chart).agg(sorted_.alias("s"), slope(F.col(level), F.col("v"), centred=True).alias("slope"))
    ys = F.transform("s", lambda p: p["y"])
    rises = F.forall(F.arrays_zip(F.slice(ys, 1, F.size(ys) - 1).alias("a"), F.slice(ys, 2, F.size(ys)).alias("b")), lambda p: p["a"] <= p["b"])
    return out.select(chart, F.size("s").cast("long").alias("levels"), (F.size("s") == levels).alias("complete"), "slope", F.when(F.size("s") > 1, rises).otherwise(True).alias("nondecreasing"), (F.element_at(ys, -1) - ys[0]).alias("rise"))


def condition_error(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Add error_f = |target_f - made_f| (null if either is), their mean over those present, and how many."""
    errors = [F.abs(F.col(f"target_{f}") - F.col(f"made_{f}")) for f in fields]
    known = F.filter(F.array(*errors), lambda e: e.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, e: a + e) / F.size(known))
    return rows.withColumns({f"error_{f}": e for f, e in zip(fields, errors, strict=True)}).withColumn("mean_error", mean).withColumn("observed", F.size(known).cast("long"))


def rates(df: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """Count and, for each flag, count and share of rows."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(test).alias(f"n_{name}") for name, test in flags.items()])
    return out.select("*", *[F.when(F.col("n") > 0, F.col(f"n_{name}") / F.col("n")).otherwise(0.0).alias(f"rate_{name}") for name in flags])


def issue_rate(issues: DataFrame, chart: str) -> DataFrame:
    """Total issues, charts with one or more, charts, and their share; ``issues`` has a row for each chart and count n."""
    return issues.groupBy(chart).agg(F.sum("n").alias("n")).agg(F.sum("n").alias("issues"), F.count_if(F.col("n") > 0).alias("charts_with"), F.count("*").alias("charts"), F.avg((F.col("n") > 0).cast("double")).alias("rate"))


def weighted_means(df: DataFrame, by: list[str], values: list[str], weight: str) -> DataFrame:
    """Chart mean and weighted mean of each value, and the perplexity of the weighted mean.

    Null where weights sum to 0, and perplexity where exp overflows.
    """
    out = []
    for v in values:
        mean = weighted_mean(v, weight)
        out += [F.avg(v).alias(f"{v}_mean"), mean.alias(f"{v}_weighted"), perplexity(mean).alias(f"{v}_perplexity")]
    return df.groupBy(*by).agg(*out)


def weighted_mean(value: str, weight: str) -> Column:
    """Aggregate: mean by weight of the rows that have the value; null where these weights sum to 0."""
    return F.try_divide(F.sum(F.col(value) * F.col(weight)).cast("double"), F.sum(F.when(F.col(value).isNotNull(), F.col(weight))))


def perplexity(loss: Column) -> Column:
    return F.when(loss < 709.0, F.exp(loss))


def teacher_summary(charts: DataFrame, by: list[str], means: list[str], weighted: list[str], tokens: str, loss: str, types: dict[str, dict[str, str]], details: dict[str, tuple[str, str]]) -> DataFrame:
    """(by..., section, name, value): a readout of charts, a long row a figure.

    chart: number of charts and tokens, and plain means of ``means``. token: means of ``weighted`` by tokens, and the
    perplexity of ``loss``. One section a token type: its tokens, and means by that type's tokens of the columns that
    ``types[name]`` names (key tokens: the counts; a key nll also gives a perplexity). rows: how many charts have
    details, and correct, total and rate of each pair of columns in ``details`` over them. Null where a weight or total
    is 0; a chart with nulls in its details has none.
    """
    has = F.lit(True)
    for right, total in details.values():
        has = has & F.col(right).isNotNull() & F.col(total).isNotNull()
    figures: list[tuple[str, str, Column]] = [("chart", "charts", F.count("*")), ("chart", "tokens", F.sum(tokens))]
    figures += [("chart", c, F.avg(c)) for c in means] + [("token", c, weighted_mean(c, tokens)) for c in weighted] + [("token", "perplexity", perplexity(weighted_mean(loss, tokens)))]
    for kind, columns in types.items():
        count = columns["tokens"]
        figures.append((kind, "tokens", F.sum(count)))
        figures += [(kind, n, weighted_mean(c, count)) for n, c in columns.items() if n != "tokens"]
        figures += [(kind, "perplexity", perplexity(weighted_mean(columns["nll"], count)))] if "nll" in columns else []
    figures.append(("rows", "available", F.count_if(has)))
    for name, (right, total) in details.items():
        sums = [F.sum(F.when(has, F.col(c))) for c in (right, total)]
        figures += [("rows", f"{name}_correct", sums[0]), ("rows", f"{name}_total", sums[1]), ("rows", f"{name}_rate", F.try_divide(sums[0].cast("double"), sums[1]))]
    wide = charts.groupBy(*by).agg(*[value.cast("double").alias(f"_{i}") for i, (_, _, value) in enumerate(figures)])
    each = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), F.col(f"_{i}").alias("value")) for i, (section, name, _) in enumerate(figures)])
    return wide.select(*by, F.inline(each))


def mix_branches(df: DataFrame, by: list[str], branch: str, value: str, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of the branches' means; null unless every branch is there."""
    means = [F.avg(F.when(F.col(branch) == b, F.col(value))) * w for b, w in weights.items()]
    total = means[0]
    for m in means[1:]:
        total = total + m
    return df.groupBy(*by).agg(total.alias("mixed"))


def early_stop(df: DataFrame, by: list[str], step: str, loss: str, patience: int) -> DataFrame:
    """Per step: best so far (strictly better only), steps since then, and whether patience has run out."""
    order = Window.partitionBy(*by).orderBy(step)
    before = F.min(loss).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("improved", F.coalesce(F.col(loss) < before, F.lit(True)))
    run = rows.withColumn("island", F.sum(F.col("improved").cast("int")).over(order))
    stalled = F.row_number().over(Window.partitionBy(*by, "island").orderBy(step)) - 1
    return run.withColumn("best", F.min(loss).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("stalled", stalled).withColumn("stop", F.col("stalled") >= patience).drop("island")


def correlations(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """pearson and spearman of rows that have both; null for fewer than two or no spread. Ranks are dealt by value, see ranks."""
    rows = cut(df.select(*by, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull()), "pairs")
    ranked = average_ranks(rows, by, {"rx": x, "ry": y})

    def safe(a: str, b: str) -> Column:
        return F.when((F.count("*") > 1) & (F.var_pop(a) > 0) & (F.var_pop(b) > 0), F.corr(a, b))

    return ranked.groupBy(*by).agg(safe(x, y).alias("pearson"), safe("rx", "ry").alias("spearman"))


def coverage_within(df: DataFrame, value: str, limits: list[float], target: float = 0.995) -> DataFrame:
    """(limit, share, chosen): share of values at most the limit; chosen is the smallest that covers ``target``, else the largest."""
    shares = df.agg(*[F.avg((F.col(value) <= x).cast("double")).alias(f"s{i}") for i, x in enumerate(limits)])
    rows = shares.select(F.explode(F.array(*[F.struct(F.lit(float(x)).alias("limit"), F.col(f"s{i}").alias("share")) for i, x in enumerate(limits)])).alias("r")).select("r.*")
    best = F.coalesce(F.min(F.when(F.col("share") >= target, F.col("limit"))).over(Window.partitionBy()), F.lit(float(max(limits))))
    return rows.withColumn("chosen", F.col("limit") == best)


def weighted_percentile(df: DataFrame, by: list[str], value: str, weight: str, points: list[float]) -> DataFrame:
    """The smallest value whose cumulative weight reaches each share of the total."""
    order = Window.partitionBy(*by).orderBy(value)
    cumulative = df.groupBy(*by, value).agg(F.sum(weight).alias("w")).withColumn("c", F.sum("w").over(order)).withColumn("t", F.sum("w").over(Window.partitionBy(*by)))
    return cumulative.groupBy(*by).agg(*[F.min(F.when(F.col("c") >= F.col("t") * p - 1e-12, F.col(value))).alias(f"q{round(p * 100)}") for p in points])


def histogram_percentile(hist: DataFrame, by: list[str], low: str, high: str, n: str, p: float) -> DataFrame:
    """Percentile from bins: midpoint of the bin where the cumulative count reaches it; an open last bin gives its low edge."""
    order = Window.partitionBy(*by).orderBy(low)
    cumulative = hist.withColumn("c", F.sum(n).over(order)).withColumn("t", F.sum(n).over(Window.partitionBy(*by)))
    value = F.when(F.col(high).isNull(), F.col(low)).otherwise((F.col(low) + F.col(high)) / 2)
    return cumulative.filter(F.col("c") >= F.col("t") * p).groupBy(*by).agg(F.min_by(value, F.col(low)).alias("percentile"))


def pooled_moments(df: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """n, mean and population deviation of every element of the vectors."""
    s = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double"))
    q = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    out = df.select(*by, F.size(vector).alias("n"), s.alias("s"), q.alias("q")).groupBy(*by).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    return out.select(*by, "n", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("std"))


def ledger_stats(df: DataFrame, status: str) -> DataFrame:
    """Count and percent of rows by status."""
    counts = df.groupBy(status).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def pattern_levels(df: DataFrame, fields: list[str]) -> DataFrame:
    """Per field: 0 and the quartiles of its positive values, without repeats, and how many are positive."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields])).alias("x")).select("x.*")
    positive = F.when(F.col("v") > 0, F.col("v"))
    agg = long.groupBy("field").agg(F.percentile(positive, F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count(positive).alias("positive"))
    levels = F.array_distinct(F.array_sort(F.concat(F.array(F.lit(0.0)), F.coalesce("q", F.array().cast("array<double>")))))
    return agg.select("field", levels.alias("levels"), "positive")


def shift_response(df: DataFrame, chart: str, offset: str, value: str, draws: int = 2000) -> DataFrame:
    """Per offset: description of chart means, and the interval of their paired difference to offset 0."""
    values = chart_values(df, chart, F.col(value), [offset])
    baseline = values.filter(F.col(offset) == 0).select(chart, F.col("value").alias("_base"))
    shifted = values.join(baseline, chart).withColumn("_difference", F.col("value") - F.col("_base"))
    intervals = mean_interval(shifted, chart, "_difference", [offset], draws).withColumnsRenamed({"n": "pairs", "mean": "shift_mean", "low": "shift_low", "high": "shift_high"})
    return describe_values(values, "value", [offset]).join(intervals, offset, "left")


def distribution(df: DataFrame, chart: str, parts: dict[str, Column]) -> DataFrame:
    """(chart, part, key, n): counts of several keys of each row in one pass; summed over charts they merge."""
    each = F.array(*[F.struct(F.lit(name).alias("part"), key.cast("string").alias("key")) for name, key in parts.items()])
    return df.select(chart, F.inline(each)).filter("key IS NOT NULL").groupBy(chart, "part", "key").agg(F.count("*").alias("n"))


def merge_distributions(counts: DataFrame) -> DataFrame:
    """(part, key, n, charts): counts added over charts."""
    return counts.groupBy("part", "key").agg(F.sum("n").alias("n"), F.count("*").alias("charts"))


def merged_totals(df: DataFrame, totals: list[str]) -> DataFrame:
    """Sums of per-chart totals; one that a chart lacks is null as a whole."""
    return df.agg(*[F.when(F.count(t) == F.count("*"), F.sum(t)).alias(t) for t in totals])


def threshold_choice(matches: DataFrame, threshold: str) -> DataFrame:
    """The threshold with the best micro f1, then precision, then the lowest."""
    from .match import micro

    best = F.max_by(F.struct(threshold, "precision", "recall", "f1"), F.struct("f1", "precision", -F.col(threshold)))
    return micro(matches, [threshold]).agg(best.alias("b")).select("b.*")


def with_totals(counts: DataFrame, n: str, charts: int, total: int) -> DataFrame:
    """Add avg_count, by chart, and pooled, the share of the whole statistic; 0 where there is nothing."""
    return counts.withColumn("avg_count", F.col(n) / charts if charts else F.lit(0.0)).withColumn("pooled", F.col(n) / total if total else F.lit(0.0))


def atomic_counts(endpoints: DataFrame, notes: DataFrame, rows: DataFrame, position: str, lane: str, kind: str, duration: str, row: str) -> DataFrame:
    """(statistic, lane, key, kind, n): counts of endpoints by lane and place, notes by lane, holds by duration, and rows."""
    none = F.lit(None).cast("string")
    text = lambda c: F.col(c).cast("string")
    parts = [
        endpoints.select(F.lit("tick").alias("statistic"), text(lane).alias("lane"), text(position).alias("key"), F.col(kind).alias("kind")),
        notes.select(F.lit("note").alias("statistic"), text(lane).alias("lane"), none.alias("key"), F.when(F.col(duration).isNull(), "tap").otherwise("hold").alias("kind")),
        notes.filter(F.col(duration).isNotNull()).select(F.lit("hold").alias("statistic"), text(lane).alias("lane"), text(duration).alias("key"), F.lit("hold").alias("kind")),
        rows.select(F.lit("row").alias("statistic"), none.alias("lane"), F.col(row).alias("key"), none.alias("kind")),
    ]
    counted = [p.groupBy("statistic", "lane", "key", "kind").agg(F.count("*").alias("n")) for p in parts]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


def marginals(counts: DataFrame, keys: list[str], always: str, n: str) -> DataFrame:
    """Sums of atoms over every choice of ``keys``, each with ``always``; a key that is summed over is 'all'."""
    sets = [[k for i, k in enumerate(keys) if mask >> i & 1] + [always] for mask in range(1 << len(keys))]
    out = counts.groupingSets(sets, *keys, always).agg(F.sum(n).alias(n))
    return out.select(*[F.coalesce(F.col(k).cast("string"), F.lit("all")).alias(k) for k in keys], always, n)


def match_distributions(matches: DataFrame, by: list[str], chart: str, draws: int = 2000) -> DataFrame:
    """Micro scores of (tp, fp, fn) rows, descriptions of f1 over samples and over charts, the interval of the chart mean, and support."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rows = matches.withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn).cast("double"))
    total = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.count_distinct(F.when(tp + fn > 0, F.col(chart))).alias("charts_with_reference"))
    total = total.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn)).withColumn("reference_support", tp + fn)
    charts = chart_values(rows, chart, F.col("f1"), by)
    named = lambda df, prefix: df.select(*by, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in by])
    ci = mean_interval(charts, chart, "value", by, draws).drop("n")
    return total.join(named(describe_values(rows, "f1", by), "sample"), by).join(named(describe_values(charts, "value", by), "chart"), by).join(named(ci, "ci"), by, "left")


def plausibility_summary(rows: DataFrame, by: list[str], chart: str, flags: list[str], notes: str) -> DataFrame:
    """Totals of each flag's count, charts that have it, samples without notes, and the share of samples with each."""
    return rows.groupBy(*by).agg(
        *[F.sum(f).alias(f) for f in flags], *[F.count_distinct(F.when(F.col(f) > 0, F.col(chart))).alias(f"charts_with_{f}") for f in flags],
        F.count_if(F.col(notes) == 0).alias("empty_samples"), *[F.avg((F.col(f) > 0).cast("double")).alias(f"rate_{f}") for f in flags],
    )


def row_states(rows: DataFrame, row: str, states: dict[str, str]) -> DataFrame:
    """(state, lanes, rows, share): how many lanes of all rows are in a state, and how many rows have it."""
    each = F.array(*[F.struct(F.lit(name).alias("state"), F.regexp_count(row, F.lit(code)).cast("long").alias("n")) for code, name in states.items()])
    return rows.select(F.inline(each)).groupBy("state").agg(F.sum("n").alias("lanes"), F.count_if(F.col("n") > 0).alias("rows"), F.avg((F.col("n") > 0).cast("double")).alias("share"))


def weighted_power_mean(df: DataFrame, by: list[str], value: str, weight: str, power: float) -> DataFrame:
    """(by..., mean, power_mean) of weighted values; null without weight."""
    total = F.sum(weight)
    return df.groupBy(*by).agg(F.when(total > 0, F.sum(F.col(value) * F.col(weight)) / total).alias("mean"), F.when(total > 0, F.pow(F.sum(F.pow(value, F.lit(power)) * F.col(weight)) / total, F.lit(1 / power))).alias("power_mean"))


def timing_report(charts: DataFrame, segments: str, tempo: str, error: str, top: int = 8) -> DataFrame:
    """(section, key, n, share): charts by kind of timing, and the commonest segment counts and tempos."""
    kind = F.when(F.col(error).isNotNull(), "error").when(F.col(segments) == 0, "none").when(F.col(segments) == 1, "constant").otherwise("variable")
    rows = charts.withColumn("_k", kind)
    parts = [("kind", F.col("_k"), F.lit(True)), ("segments", F.col(segments).cast("string"), F.col("_k") == "variable"), ("tempo", F.round(tempo).cast("long").cast("string"), F.col("_k") == "constant")]
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(name).alias("section"), F.when(test, key).alias("key")) for name, key, test in parts]))).filter("key IS NOT NULL")
    counted = long.groupBy("section", "key").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "key"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("section"))).withColumn("_r", place).filter((F.col("_r") <= top) | (F.col("section") == "kind")).drop("_r")


def field_summary(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n, missing, mean, p10, p50, p90) of each field's finite values."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields])))
    x = finite(F.col("v"))
    out = long.groupBy("field").agg(F.count(x).alias("n"), F.count_if(x.isNull()).alias("missing"), F.avg(x).alias("mean"), F.percentile(x, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"))
    return out.select("field", "n", "missing", "mean", *[F.col("p")[i].alias(c) for i, c in enumerate(("p10", "p50", "p90"))])
