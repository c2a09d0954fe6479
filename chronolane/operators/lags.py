"""How far a series lags behind anchors: profiles around them, and a verdict that time blocks have to agree on."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolane.operators.timeline import interpolate
from chronolane.session import cut, parts_for


@dataclass(frozen=True)
class LagRules:
    """What a verdict asks for; lags are in the unit of the series' time."""

    anchors: int = 80
    blocks: int = 6
    block_anchors: int = 10
    least_blocks: int = 4
    draws: int = 256
    seed: int = 1707
    width: float = 20.0
    contrast: float = 0.05
    prominence: float = 0.01
    exclusion: float = 12.0
    edge: float = 10.0
    floor: float = 2.220446049250313e-16


def lag_profile(series: DataFrame, anchors: DataFrame, chart: str, t: str, value: str, lags: list[float], rules: LagRules = LagRules()) -> DataFrame:
    """(chart, block, lag, n, value): the series at anchor + lag over the anchor's largest value, averaged in time blocks.

    Anchors whose largest value isn't above ``rules.floor`` are silent and take no part; n counts the others. Blocks cut
    the time from the first to the last of them in equal parts. Equal anchors count once. Each anchor's marks join the
    series in one window by chart, which the later windows share; the number of marks says how many tasks charts are dealt to.
    """
    each = cut(anchors.select(chart, F.col(t).cast("double").alias("_anchor")).distinct(), "anchors")  # counted, then read
    series = cut(series.select(chart, t, value), "series")
    parts = parts_for(anchors.sparkSession, each.count() * len(lags) + series.count())
    points = series.select(chart, F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("v"), F.lit(0).alias("mark"))
    dealt = points.unionByName(each.withColumn("mark", F.lit(1)), allowMissingColumns=True).repartition(parts, chart)
    # Anchors become marks where they were dealt to, so that they move once and not once for each lag.
    marks = F.when(F.col("mark") == 1, F.array(*[F.lit(float(x)) for x in lags])).otherwise(F.array(F.lit(None).cast("double")))
    both = dealt.withColumn("lag", F.explode(marks)).withColumn("t", F.coalesce(F.col("_anchor") + F.col("lag"), "t"))
    at = interpolate(both, chart, t, value, ("_anchor", "lag"))
    heard = at.withColumn("_scale", F.max(value).over(Window.partitionBy(chart, "_anchor"))).filter(F.col("_scale") > rules.floor)
    whole = Window.partitionBy(chart)
    heard = heard.withColumn("_first", F.min("_anchor").over(whole)).withColumn("_span", F.max("_anchor").over(whole) - F.col("_first"))
    part = F.floor((F.col("_anchor") - F.col("_first")) / F.nullif("_span", F.lit(0.0)) * rules.blocks)
    heard = heard.withColumn("block", F.coalesce(F.least(part, F.lit(rules.blocks - 1)), F.lit(0)).cast("int"))
    return heard.groupBy(chart, "block", "lag").agg(F.count("*").alias("n"), F.avg(F.col(value) / F.col("_scale")).alias("value"))


def _picks(rules: LagRules) -> np.ndarray:
    """For every draw and place a number in [0, 1), from a hash: which block stands there."""
    unit = lambda d, j: int(md5(f"{rules.seed}|{d}|{j}".encode()).hexdigest()[:8], 16) / 2.0**32
    return np.array([[unit(d, j) for j in range(rules.blocks)] for d in range(rules.draws)])


def _judge(curves: np.ndarray, at: np.ndarray, picks: np.ndarray, exclusion: float) -> tuple[float | None, ...]:
    """(lag, low, high, contrast, prominence) of one chart's block curves; means are rounded, so that their order doesn't matter."""
    curve = curves.mean(axis=0).round(9)
    best = int(curve.argmax())
    drawn = (picks[:, : len(curves)] * len(curves)).astype(int)
    low, high = np.quantile(at[curves[drawn].mean(axis=1).round(9).argmax(axis=1)], (0.025, 0.975))
    outside = curve[np.abs(at - at[best]) > exclusion]
    return at[best], low, high, curve[best] - np.median(curve), curve[best] - outside.max() if len(outside) else None


def lag_verdict(series: DataFrame, anchors: DataFrame, chart: str, t: str, value: str, lags: list[float], rules: LagRules = LagRules()) -> DataFrame:
    """(chart, status, reasons, anchors, lag, low, high, contrast, prominence) of every chart with an anchor.

    The curve is the mean of the time blocks' profiles that have ``rules.block_anchors``, its largest value stands at the
    lag. [low, high] is the 95 % interval of that lag when whole blocks are drawn with replacement, so anchors close in
    time count as one observation. Status: too_few_anchors, too_few_audible_anchors, too_few_time_blocks (then nothing
    else is given, and anchors are those before silent ones were dropped only for the first), else resolved, or
    unresolved for reasons: search_edge, weak_alignment, competing_peak, unstable_time_blocks.
    """
    lags = sorted(map(float, lags))
    profile = lag_profile(series, anchors, chart, t, value, lags, rules)
    blocks = profile.groupBy(chart, "block").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("lag", "value"))), lambda x: x["value"]).alias("curve"))
    heard = blocks.groupBy(chart).agg(F.sum("n").alias("_heard"), F.transform(F.array_sort(F.collect_list(F.when(F.col("n") >= rules.block_anchors, F.struct("block", "curve")))), lambda x: x["curve"]).alias("_curves"))
    rows = anchors.groupBy(chart).agg(F.countDistinct(F.col(t).cast("double")).alias("_all")).join(heard, chart, "left")
    rows = rows.withColumn("_heard", F.coalesce("_heard", F.lit(0))).withColumn(
        "status",
        F.when(F.col("_all") < rules.anchors, "too_few_anchors").when(F.col("_heard") < rules.anchors, "too_few_audible_anchors").when(F.size("_curves") < rules.least_blocks, "too_few_time_blocks"),
    )
    at, picks = np.array(lags), _picks(rules)

    @F.pandas_udf("lag double, low double, high double, contrast double, prominence double")
    def judged(curves: pd.Series) -> pd.DataFrame:
        """Of a chart's few curves each; null where there is nothing to judge."""
        out = [[None] * 5 if c is None else _judge(np.stack(c), at, picks, rules.exclusion) for c in curves]
        return pd.DataFrame(out, columns=["lag", "low", "high", "contrast", "prominence"], dtype="float64")

    rows = rows.withColumn("_found", judged(F.when(F.col("status").isNull(), F.col("_curves")))).select("*", "_found.*")
    tests = {
        "search_edge": F.abs("lag") >= lags[-1] - rules.edge,
        "weak_alignment": F.col("contrast") < rules.contrast,
        "competing_peak": F.col("prominence") < rules.prominence,
        "unstable_time_blocks": F.col("high") - F.col("low") > rules.width,
    }
    reasons = F.when(F.col("status").isNull(), F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()])))
    rows = rows.withColumn("reasons", reasons).withColumn("status", F.coalesce("status", F.when(F.size("reasons") == 0, "resolved").otherwise("unresolved")))
    known = F.when(F.col("status") == "too_few_anchors", F.col("_all")).otherwise(F.col("_heard"))
    return rows.select(chart, "status", "reasons", known.alias("anchors"), "lag", "low", "high", "contrast", "prominence")
