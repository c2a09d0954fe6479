"""Composite reports: one plan from operators, no loop over charts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.operators import match, splits, stats, vocabulary
from chronolane.operators.ranks import exact_percentiles
from chronolane.session import cut


def summarize_records(records: DataFrame, by: list[str], chart: str) -> DataFrame:
    """Per mode and scenario: samples, charts, micro scores and chart mean of f1. ``records`` has tp, fp, fn."""
    return match.micro(records, by).join(match.macro(records, chart, by), by).join(records.groupBy(*by).agg(F.count("*").alias("samples"), F.count_distinct(chart).alias("charts")), by)


def compare_runs(left: DataFrame, right: DataFrame, keys: list[str], chart: str, value: str, frozen: list[str], draws: int = 2000) -> DataFrame:
    """Paired difference of two runs per scenario; runs of different cases or settings are an error."""
    odd = splits.coverage(left, right, [*keys, chart])
    if not odd.isEmpty():
        raise ValueError("the runs have different cases")
    for f in frozen:
        seen = left.select(f).unionByName(right.select(f)).distinct().count()
        if seen > 1:
            raise ValueError(f"the runs differ in {f}")
    a, b = (stats.chart_values(side, chart, F.col(value), keys) for side in (left, right))
    return stats.mean_interval(stats.paired_by_chart(a, b, chart, "value", keys), chart, "difference", keys, draws)


def verify_archive(expected: DataFrame, journal: DataFrame, keys: list[str], digests: list[str]) -> DataFrame:
    """(keys..., problem): missing and unexpected cases, and cases whose frozen digests differ."""
    gaps = splits.coverage(expected, journal, keys)
    e, j = expected.select(*keys, *[F.col(d).alias(f"e_{d}") for d in digests]), journal.select(*keys, *[F.col(d).alias(f"j_{d}") for d in digests])
    differs = reduce(lambda a, b: a | b, [~F.col(f"e_{d}").eqNullSafe(F.col(f"j_{d}")) for d in digests])
    return gaps.unionByName(e.join(j, keys).filter(differs).select(*keys, F.lit("differs").alias("problem")))


def dataset_report(charts: DataFrame, reason: str, numbers: list[str], groups: list[str]) -> DataFrame:
    """Long report (section, key, value): totals, reasons, histograms of ``groups``, percentiles of ``numbers``. One scan for each part."""
    parts = [charts.agg(F.count("*").cast("double").alias("value")).select(F.lit("total").alias("section"), F.lit("charts").alias("key"), "value")]
    for column in (reason, *groups):
        parts.append(charts.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("none")).alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit(column).alias("section"), "key", "value"))
    points = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    for c in numbers:
        rows = F.array(*[F.struct(F.lit(c).alias("section"), F.lit(n).alias("key"), F.col(n).alias("value")) for n in points])
        parts.append(exact_percentiles(charts, c, [], points).select(F.inline(rows)))
    return reduce(DataFrame.unionByName, parts)


def train_plan(charts: DataFrame, group: str, key: str, length: str, ratios: dict[str, float], reason: str, budget: int, epoch: int, seed: int, fields: list[str] | None = None) -> DataFrame:
    """(key, window, batch, mirror, rate): the epoch's batches of training charts that pass the gate, with augmentation.

    With ``fields`` also mask, a digit for each condition field that the epoch shows, and the fields, null where it doesn't.
    """
    from chronolane.functions.scalars import augment_choice, train_mask

    from .windows import pack_batches

    kept = splits.hash_split(charts, group, ratios, seed).filter((F.col("split") == "train") & F.col(reason).isNull())
    batches = pack_batches(kept.select(key, length), key, length, budget, epoch, seed)
    plan = batches.withColumn("a", augment_choice(seed, epoch, F.col(key))).select(key, "window", "batch", "a.mirror", "a.rate")
    if not fields:
        return plan
    mask = train_mask(fields, {f: F.col(f).isNotNull() for f in fields}, seed, epoch, F.col(key))
    shown = kept.select(key, *fields).withColumn("_mask", mask)
    shown = shown.select(key, F.array_join("_mask", "").alias("mask"), *[F.when(F.get("_mask", F.lit(i)) == 1, F.col(f)).alias(f) for i, f in enumerate(fields)])
    return plan.join(shown, key)


def eval_pool(charts: DataFrame, group: str, key: str, ratios: dict[str, float], reason: str, n: int, seed: int) -> DataFrame:
    """(target, donor): seeded sample of test charts that pass the gate, each with a donor of the same pool."""
    test = splits.hash_split(charts, group, ratios, seed).filter((F.col("split") == "test") & F.col(reason).isNull())
    pool = splits.seeded_sample(test, key, n, seed)
    return splits.donor_map(pool, key, seed)


#: Whose fields a scenario takes, and whether all, some or none of them.
SCENARIOS = {"matched": ("own", "all"), "matched_partial": ("own", "some"), "random": ("donor", "all"), "random_partial": ("donor", "some"), "none": ("own", "none")}


def scenario_conditions(donors: DataFrame, meta: DataFrame, key: str, fields: list[str], seed: int, scenarios: list[str] | None = None) -> DataFrame:
    """(target, scenario, donor, mask, fields...): what each target is conditioned on in each scenario.

    ``donors`` has (target, donor). Random scenarios take the donor's fields and name it, the others the target's own.
    The mask has a digit a field: 1 for a field that is there and kept, where partial scenarios keep half by a hash of
    seed, target and scenario (of two fields or more never all or none), and ``none`` keeps none. A field that isn't kept
    is null. A donor without a row in ``meta`` is an error, a target without one is left out.
    """
    from chronolane.functions.scalars import bernoulli_mask

    rows = splits.donor_join(meta.join(donors.select(F.col("target").alias(key)), key, "left_semi"), donors, meta, key, fields)
    plans = {name: SCENARIOS[name] for name in scenarios or SCENARIOS}
    each = F.array(*[F.struct(F.lit(name).alias("scenario"), F.lit(source == "donor").alias("_random"), F.lit(kept).alias("_kept")) for name, (source, kept) in plans.items()])
    rows = rows.select("target", "donor", *[f"{side}_{f}" for side in ("target", "donor") for f in fields], F.inline(each))
    rows = rows.withColumns({f: F.when(F.col("_random"), F.col(f"donor_{f}")).otherwise(F.col(f"target_{f}")) for f in fields})
    present = {f: F.col(f).isNotNull() for f in fields}
    some = bernoulli_mask(fields, present, 0.5, seed, F.col("target"), F.col("scenario"))
    mask = F.when(F.col("_kept") == "all", F.array(*[present[f].cast("int") for f in fields])).when(F.col("_kept") == "some", some).otherwise(F.array(*[F.lit(0)] * len(fields)))
    rows = rows.withColumn("_mask", mask)
    kept = [F.when(F.get("_mask", F.lit(i)) == 1, F.col(f)).alias(f) for i, f in enumerate(fields)]
    return rows.select("target", "scenario", F.when(F.col("_random"), F.col("donor")).alias("donor"), F.array_join("_mask", "").alias("mask"), *kept)


def corpus_compare(sides: dict[str, DataFrame], chart: str, keys: list[str], always: str) -> DataFrame:
    """(keys..., always, n_s, avg_s, pooled_s for each side s): totals of endpoint counts of several corpora side by side.

    A key that is summed over is 'all'; a place that a side lacks counts 0.
    """
    out = None
    for name, rows in sides.items():
        counts = rows.groupBy(*keys, always).agg(F.count("*").alias("n"))
        size = rows.agg(F.count_distinct(chart).alias("charts"), F.count("*").alias("n")).first()
        side = stats.with_totals(stats.marginals(counts, keys, always, "n"), "n", size.charts, size.n).withColumnsRenamed({"n": f"n_{name}", "avg_count": f"avg_{name}", "pooled": f"pooled_{name}"})
        out = side if out is None else out.join(side, [*keys, always], "full")
    return out.fillna(0)


def verify_training(corpus: DataFrame, manifest: DataFrame, key: str, split: str, stored: str, current: str) -> DataFrame:
    """(problem, n): what speaks against a corpus as the training part of a split; no rows if nothing does."""
    train = manifest.filter(F.col(split) == "train").select(key)
    outside = corpus.select(key).distinct().join(train, key, "left_anti").agg(F.lit("outside train").alias("problem"), F.count("*").alias("n"))
    empty = corpus.agg(F.lit("empty").alias("problem"), (F.count("*") == 0).cast("long").alias("n"))
    digest = corpus.agg(F.lit("another split").alias("problem"), F.lit(int(stored != current)).cast("long").alias("n"))
    return outside.unionByName(empty).unionByName(digest).filter("n > 0")


def rescore(records: DataFrame, generated: DataFrame, reference: DataFrame, keys: list[str], chart: str, match_on: list[str]) -> DataFrame:
    """(keys..., tp, fp, fn): scores of stored sequences anew; a record whose sequence is gone is an error when read.

    ``generated`` has the keys, ``reference`` the chart alone; both have the columns to match on.
    """
    have = generated.select(*keys).distinct().withColumn("_have", F.lit(True))
    checked = records.select(*keys).join(have, keys, "left").filter(F.when(F.col("_have"), F.lit(True)).otherwise(F.raise_error(F.lit("a record's sequence is missing"))).cast("boolean")).select(*keys)
    wanted = checked.join(reference.select(chart, *match_on), chart)
    return match.multiset_match(generated.join(checked, keys, "left_semi").select(*keys, *match_on), wanted.select(*keys, *match_on), match_on, keys)


def seed_scores(requested: DataFrame, samples: DataFrame, chart: str, seed: str, keys: list[str], always: str) -> DataFrame:
    """(seed, keys..., always, n, avg_count, pooled): totals of each seed's samples; each must have every requested chart."""
    wanted = requested.select(chart).filter(F.col(chart).isNotNull()).distinct()
    size = wanted.count()
    have = samples.select(seed, chart).distinct().join(wanted.withColumn("_wanted", F.lit(True)), chart, "left")
    if not have.groupBy(seed).agg((F.count("_wanted") < F.lit(size)).alias("_lacks")).filter("_lacks").isEmpty():
        raise ValueError("a seed lacks requested charts")
    counts = samples.groupBy(seed, *keys, always).agg(F.count("*").alias("n"))
    sets = [[seed, *[k for i, k in enumerate(keys) if mask >> i & 1], always] for mask in range(1 << len(keys))]
    out = counts.groupingSets(sets, seed, *keys, always).agg(F.sum("n").alias("n"))
    sizes = samples.groupBy(seed).agg(F.count_distinct(chart).alias("_charts"), F.count("*").alias("_total"))
    return out.join(sizes, seed).select(seed, *[F.coalesce(F.col(k).cast("string"), F.lit("all")).alias(k) for k in keys], always, "n", (F.col("n") / F.col("_charts")).alias("avg_count"), (F.col("n") / F.col("_total")).alias("pooled"))


def issue_totals(issues: DataFrame, samples: DataFrame, by: list[str], chart: str, issue: str, kinds: list[str]) -> DataFrame:
    """(by..., issue, charts_with, instances, charts) of each kind of issue among samples (by..., chart); a row of zeros for kinds that none has."""
    charts = samples.groupBy(*by).agg(F.count_distinct(chart).alias("charts")).select(*by, "charts", F.explode(F.lit(kinds)).alias("issue"))
    found = issues.groupBy(*by, F.col(issue).alias("issue")).agg(F.count_distinct(chart).alias("charts_with"), F.count("*").alias("instances"))
    return charts.join(found, [*by, "issue"], "left").select(*by, "issue", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("charts_with", "instances")], "charts")


def seed_report(requested: DataFrame, samples: DataFrame, made: DataFrame, human: DataFrame, issues: DataFrame, listed: DataFrame, chart: str, seed: str, keys: list[str], always: str, issue: str, kinds: list[str]) -> DataFrame:
    """(seed, section, key, name, value): all that is told of each seed's samples; each seed must have every requested chart.

    ``made`` has the steps of (seed, chart) in their scopes, ``human`` those of the chart alone; both are counted by the
    frozen list, every seed in one pass. Sections: statistics (totals of endpoint counts), motifs (count, observations
    and average of every motif by part), distance (to the human corpus), issues (of each kind).
    """
    counted = cut(vocabulary.motif_report(made, [seed, chart], listed, by=[seed]), "seed-motifs")  # counts, distances and their keys read it
    distance = vocabulary.distance_to(counted, vocabulary.motif_report(human, [chart], listed), [seed])
    distance = cut(distance, "seed-distances")  # its sections are a plan of their own
    return reduce(
        DataFrame.unionByName,
        [
            _long(seed_scores(requested, samples, chart, seed, keys, always), "statistics", [*keys, always], [seed]),
            _long(counted, "motifs", ["scope", "part", "motif"], [seed]),
            _long(distance.select(seed, "scope", F.col("section").alias("of"), F.col("name").alias("what"), "value"), "distance", ["scope", "of", "what"], [seed]),
            _long(issue_totals(issues, samples, [seed], chart, issue, kinds), "issues", ["issue"], [seed]),
        ],
    )


def recheck_distances(stored: DataFrame, made: DataFrame, human: DataFrame, by: list[str], tolerance: float = 1e-8) -> DataFrame:
    """(by..., scope, name, stored, recomputed): figures of a stored distance summary that counting anew doesn't confirm.

    ``stored`` has (by..., scope, name, value); mae, rmse and spearman are worked out again from ``made`` and ``human``
    (see distance_to). A figure that is missing or null on either side is not confirmed.
    """
    again = vocabulary.distance_to(made, human, by).filter("section = 'summary' AND name <> 'vocabulary'").select(*by, "scope", "name", F.col("value").alias("recomputed"))
    both = stored.filter(F.col("name").isin("mae", "rmse", "spearman")).select(*by, "scope", "name", F.col("value").alias("stored")).join(again, [*by, "scope", "name"], "full")
    return both.filter(~F.coalesce(F.abs(F.col("stored") - F.col("recomputed")) <= tolerance, F.lit(False)))


def _long(df: DataFrame, section: str, keys: list[str], front: list[str] | None = None) -> DataFrame:
    """(front..., section, key, name, value): a row for each figure of a report."""
    front = front or []
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in df.columns if n not in [*keys, *front]])
    return df.select(*front, F.lit(section).alias("section"), F.concat_ws("|", *keys).alias("key"), F.inline(each))


def full_summary(records: DataFrame, by: list[str], chart: str, flags: list[str], distributions: DataFrame, pairs: DataFrame, fields: list[str], sections: dict[str, tuple[DataFrame, list[str]]] | None = None) -> DataFrame:
    """(section, key, name, value): scores and plausibility of each mode, merged distributions and condition responses in one long report.

    ``sections`` adds other reports, each a frame and its keys: every other column is a figure of its own (diversity of
    seeds, distances and coverage of motifs).
    """
    return reduce(
        DataFrame.unionByName,
        [
            _long(summarize_records(records, by, chart), "scores", by),
            _long(stats.plausibility_summary(records, by, chart, flags, "notes"), "plausibility", by),
            _long(stats.merge_distributions(distributions), "distribution", ["part", "key"]),
            _long(stats.condition_response(pairs, fields), "response", ["field"]),
            *[_long(frame, name, keys) for name, (frame, keys) in (sections or {}).items()],
        ],
    )
