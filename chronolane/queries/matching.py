"""Multiset matching and evaluation statistics over events, orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolane.operators import match, stats

from .base import bootstrap_sql, events, rounded, table

IDENTITY = ["event_type", "day"]


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1")


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.multiset_match(*_sides(spark, sf_dir), IDENTITY, ["user_id"])


def match_micro(spark, sf_dir):
    return rounded(match.micro(_matched(spark, sf_dir), []))


def match_by_user(spark, sf_dir):
    return rounded(match.micro(_matched(spark, sf_dir), ["user_id"]))


def _views() -> dict:
    bought = F.col("event_type") == "purchase"
    return {"event": (["event_type", "day", "lane"], None), "event_any_lane": (["event_type", "day"], None), "purchase": (["event_type", "day", "lane"], bought), "purchase_any_lane": (["event_type", "day"], bought)}


def match_views(spark, sf_dir):
    return rounded(match.micro(match.match_views(*_sides(spark, sf_dir), _views(), ["user_id"]), ["user_id", "view"]))


def match_summary(spark, sf_dir):
    views = match.match_views(*_sides(spark, sf_dir), _views(), ["user_id"])
    return rounded(match.macro(views, "user_id", ["view"]))


def seed_pairs(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("seed", F.pmod("event_id", F.lit(5)))
    return match.seed_pairs(rows, "user_id", "seed", ["event_type", "lane"])


def multiset_union(spark, sf_dir):
    return match.multiset_union(*_sides(spark, sf_dir), ["event_type", "day"])


def onset_match(spark, sf_dir):
    rows = events(spark, sf_dir).filter("event_type IN ('view', 'click')").select("user_id", (F.col("ms") / 1000.0).alias("t"), F.when(F.col("event_type") == "view", "p").otherwise("e").alias("side"))
    return match.within_tolerance(rows, "user_id", "side", "t", [60.0, 600.0, 3600.0])


def _orders_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))


def chart_describe(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    charts = stats.chart_values(rows, "l_orderkey", F.col("l_quantity"), ["l_returnflag"])
    return rounded(stats.describe_values(charts, "value", ["l_returnflag"]))


def bootstrap_ci(spark, sf_dir):
    charts = stats.chart_values(_orders_of(spark, sf_dir), "c_custkey", F.col("o_totalprice"), ["c_mktsegment"])
    return rounded(stats.mean_interval(charts, "c_custkey", "value", ["c_mktsegment"]), 4)


def paired_ci(spark, sf_dir):
    rows = _orders_of(spark, sf_dir)
    left = stats.chart_values(rows.filter("o_orderstatus = 'O'"), "c_custkey", F.col("o_totalprice"), ["c_mktsegment"])
    right = stats.chart_values(rows.filter("o_orderstatus = 'F'"), "c_custkey", F.col("o_totalprice"), ["c_mktsegment"])
    pairs = stats.paired_by_chart(left, right, "c_custkey", "value", ["c_mktsegment"])
    ci = stats.mean_interval(pairs, "c_custkey", "difference", ["c_mktsegment"])
    alone = pairs.groupBy("c_mktsegment").agg(F.count_if(F.col("right").isNull()).alias("left_only"), F.count_if(F.col("left").isNull()).alias("right_only"))
    return rounded(ci.join(alone, "c_mktsegment"), 4)


def slopes(spark, sf_dir):
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(stats.slope(x, y).alias("through_origin"), stats.slope(x, y, centred=True).alias("centred")), 4)


def condition_response(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select("l_orderkey", F.col("l_quantity").alias("target_a_q"), F.col("l_extendedprice").alias("made_a_q"), F.col("l_discount").alias("target_a_d"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("made_a_d"))
    b = table(spark, sf_dir, "lineitem").filter("l_linenumber = 2").select("l_orderkey", F.col("l_quantity").alias("target_b_q"), F.col("l_extendedprice").alias("made_b_q"), F.col("l_discount").alias("target_b_d"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("made_b_d"))
    return rounded(stats.condition_response(a.join(b, "l_orderkey"), ["q", "d"]), 4)


def control_response(spark, sf_dir):
    return rounded(stats.control_response(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_linenumber", "l_extendedprice"), 4)


def condition_mae(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("target_d"), F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("made_d"), (F.col("l_quantity") / 50).alias("target_q"), F.lit(0.5).alias("made_q"))
    return rounded(stats.condition_error(rows, ["d", "q"]).groupBy("l_linenumber").agg(F.avg("error_d").alias("error_d"), F.count("error_d").alias("n_d"), F.avg("error_q").alias("error_q"), F.avg("mean_error").alias("mean_error"), F.sum("observed").alias("observed")))


def validity_rates(spark, sf_dir):
    return rounded(stats.rates(table(spark, sf_dir, "orders"), ["o_orderstatus"], {"urgent": F.col("o_orderpriority").startswith("1"), "large": F.col("o_totalprice") > 200000}))


def issue_rate(spark, sf_dir):
    issues = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_discount") > 0.08).cast("long").alias("n"))
    return rounded(stats.issue_rate(issues, "l_orderkey"))


def teacher_weighted(spark, sf_dir):
    return rounded(stats.weighted_means(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_discount", "l_tax"], "l_quantity"))


def branch_mix(spark, sf_dir):
    return rounded(stats.mix_branches(table(spark, sf_dir, "lineitem"), ["l_linenumber"], "l_returnflag", "l_extendedprice", {"A": 0.1, "N": 0.8, "R": 0.1}), 4)


def early_stop(spark, sf_dir):
    steps = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return rounded(stats.early_stop(steps, ["o_custkey"], "o_orderkey", "o_totalprice", 3))


def percentile_table(spark, sf_dir):
    return rounded(stats.percentiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"], {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p995": 0.995}), 4)


def coverage_within(spark, sf_dir):
    return rounded(stats.coverage_within(table(spark, sf_dir, "lineitem"), "l_quantity", [10.0, 25.0, 40.0, 50.0]))


def rank_correlation(spark, sf_dir):
    per_part = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_partkey").agg(F.sum("l_quantity").alias("x"), F.count("*").cast("double").alias("y"))
    return rounded(stats.correlations(per_part, "x", "y", ["l_returnflag"]))


def weighted_percentile(spark, sf_dir):
    return rounded(stats.weighted_percentile(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity", [0.25, 0.5, 0.9]))


def hist_percentile(spark, sf_dir):
    low = F.floor(F.col("l_quantity") / 5) * 5.0
    hist = table(spark, sf_dir, "lineitem").groupBy("l_linestatus", low.alias("low")).agg(F.count("*").alias("n")).withColumn("high", F.when(F.col("low") < 45, F.col("low") + 5))
    return rounded(stats.histogram_percentile(hist, ["l_linestatus"], "low", "high", "n", 0.9))


def pooled_moments(spark, sf_dir):
    return rounded(stats.pooled_moments(table(spark, sf_dir, "embeddings"), "embedding", ["label"]), 5)


def ledger_stats(spark, sf_dir):
    return rounded(stats.ledger_stats(table(spark, sf_dir, "orders"), "o_orderpriority"))


def pattern_levels(spark, sf_dir):
    levels = stats.pattern_levels(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax", "l_quantity"])
    return rounded(levels.select("field", F.array_join(F.transform("levels", lambda x: F.format_string("%.4f", x)), ",").alias("levels"), "positive"))


_M = """
WITH sides AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, event_id % 4 AS lane, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS p, CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END AS e FROM events)
"""
_F1 = "CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0 END AS f1"
_COUNTS = _M + ", counts AS (SELECT user_id, event_type, day, sum(p) AS p, sum(e) AS e FROM sides GROUP BY ALL)"
_T = "CAST(sum(least(p, e)) AS BIGINT) AS tp, CAST(sum(p) - sum(least(p, e)) AS BIGINT) AS fp, CAST(sum(e) - sum(least(p, e)) AS BIGINT) AS fn"
_V = (
    _M
    + """, views AS (
  SELECT user_id, 'event' AS view, event_type, day, lane, p, e FROM sides
  UNION ALL SELECT user_id, 'event_any_lane', event_type, day, NULL, p, e FROM sides
  UNION ALL SELECT user_id, 'purchase', event_type, day, lane, p, e FROM sides WHERE event_type = 'purchase'
  UNION ALL SELECT user_id, 'purchase_any_lane', event_type, day, NULL, p, e FROM sides WHERE event_type = 'purchase'
), counts AS (SELECT user_id, view, event_type, day, lane, sum(p) AS p, sum(e) AS e FROM views GROUP BY ALL)
"""
)
_CO = "WITH co AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)"
SQL = {
    "match_micro": _COUNTS + f", t AS (SELECT {_T} FROM counts) SELECT tp, fp, fn, {_F1} FROM t",
    "match_by_user": _COUNTS + f", t AS (SELECT user_id, {_T} FROM counts GROUP BY user_id) SELECT user_id, tp, fp, fn, {_F1} FROM t",
    "match_views": _V + f", t AS (SELECT user_id, view, {_T} FROM counts GROUP BY ALL) SELECT user_id, view, tp, fp, fn, {_F1} FROM t",
    "match_summary": _V + f", t AS (SELECT user_id, view, {_T} FROM counts GROUP BY ALL), f AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM t) SELECT view, round(avg(f1), 6) AS sample_f1, round(avg(f1), 6) AS chart_f1, CAST(sum(tp + fn) AS BIGINT) AS support, count(*) FILTER (WHERE tp + fn > 0) AS charts_with_reference FROM f GROUP BY view",
    "seed_pairs": """
WITH c AS (SELECT user_id, event_id % 5 AS seed, event_type, event_id % 4 AS lane, count(*) AS n FROM events GROUP BY ALL),
t AS (SELECT user_id, seed, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT a.user_id, a.seed AS seed_a, b.seed AS seed_b, a.total AS na, b.total AS nb FROM t a JOIN t b ON a.user_id = b.user_id AND a.seed < b.seed),
s AS (SELECT a.user_id, a.seed AS seed_a, b.seed AS seed_b, sum(least(a.n, b.n)) AS tp FROM c a JOIN c b ON a.user_id = b.user_id AND a.seed < b.seed AND a.event_type IS NOT DISTINCT FROM b.event_type AND a.lane = b.lane GROUP BY ALL)
SELECT user_id, seed_a, seed_b, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(na - coalesce(tp, 0) AS BIGINT) AS fp, CAST(nb - coalesce(tp, 0) AS BIGINT) AS fn, na = coalesce(tp, 0) AND nb = coalesce(tp, 0) AS identical FROM p LEFT JOIN s USING (user_id, seed_a, seed_b)""",
    "multiset_union": _M + "SELECT event_type, day, CAST(greatest(sum(p), sum(e)) AS BIGINT) AS n_max, CAST(sum(p) + sum(e) AS BIGINT) AS n_sum FROM sides GROUP BY ALL",
    "chart_describe": "WITH c AS (SELECT l_returnflag, l_orderkey, avg(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT l_returnflag, count(v) AS count, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90, round(min(v), 6) AS min, round(max(v), 6) AS max FROM c GROUP BY ALL",
    "bootstrap_ci": _CO + ", cv AS (SELECT c_mktsegment, c_custkey, avg(o_totalprice) AS value FROM co GROUP BY ALL)" + bootstrap_sql("cv", "c_mktsegment", "c_custkey", "value") + "SELECT c_mktsegment, n, round(mean, 4) AS mean, CASE WHEN n > 1 THEN round(low, 4) END AS low, CASE WHEN n > 1 THEN round(high, 4) END AS high FROM m JOIN b USING (c_mktsegment)",
    "paired_ci": _CO
    + """, l AS (SELECT c_mktsegment, c_custkey, avg(o_totalprice) AS l FROM co WHERE o_orderstatus = 'O' GROUP BY ALL)
, r AS (SELECT c_mktsegment, c_custkey, avg(o_totalprice) AS r FROM co WHERE o_orderstatus = 'F' GROUP BY ALL)
, pv AS (SELECT *, r - l AS difference FROM l FULL JOIN r USING (c_mktsegment, c_custkey))
, alone AS (SELECT c_mktsegment, count(*) FILTER (WHERE r IS NULL) AS left_only, count(*) FILTER (WHERE l IS NULL) AS right_only FROM pv GROUP BY ALL)"""
    + bootstrap_sql("pv", "c_mktsegment", "c_custkey", "difference")
    + "SELECT c_mktsegment, n, round(mean, 4) AS mean, round(low, 4) AS low, round(high, 4) AS high, left_only, right_only FROM m JOIN b USING (c_mktsegment) JOIN alone USING (c_mktsegment)",
    "slopes": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 4) AS through_origin, round(regr_slope(l_extendedprice, l_quantity), 4) AS centred FROM lineitem GROUP BY ALL",
    "condition_response": """
WITH a AS (SELECT * FROM lineitem WHERE l_linenumber = 1), b AS (SELECT * FROM lineitem WHERE l_linenumber = 2),
x AS (
  SELECT 'q' AS field, b.l_quantity - a.l_quantity AS target, b.l_extendedprice - a.l_extendedprice AS made FROM a JOIN b USING (l_orderkey)
  UNION ALL SELECT 'd', b.l_discount - a.l_discount, CASE WHEN b.l_tax > 0 THEN b.l_tax END - CASE WHEN a.l_tax > 0 THEN a.l_tax END FROM a JOIN b USING (l_orderkey)
), y AS (SELECT *, target IS NOT NULL AND made IS NOT NULL AS known FROM x), z AS (SELECT *, known AND target <> 0 AS moved FROM y)
SELECT field, count(*) FILTER (WHERE moved) AS pairs, count(*) FILTER (WHERE NOT known) AS missing, count(*) FILTER (WHERE known AND target = 0) AS unchanged,
  round(sum(target * made) FILTER (WHERE moved) / sum(target * target) FILTER (WHERE moved), 4) AS slope,
  count(*) FILTER (WHERE moved AND sign(target) = sign(made)) AS direction_matches, round(count(*) FILTER (WHERE moved AND sign(target) = sign(made)) / count(*) FILTER (WHERE moved), 4) AS direction_rate,
  round(avg(abs(target)) FILTER (WHERE moved), 4) AS target_change, round(avg(abs(made)) FILTER (WHERE moved), 4) AS made_change
FROM z GROUP BY field""",
    "control_response": """
WITH e AS (SELECT l_suppkey, l_linenumber, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
o AS (SELECT *, lag(v) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber) AS p FROM e)
SELECT l_suppkey, count(*) AS levels, count(*) = (SELECT count(DISTINCT l_linenumber) FROM e) AS complete, round(regr_slope(v, l_linenumber), 4) AS slope,
  coalesce(bool_and(p <= v) FILTER (WHERE p IS NOT NULL), true) AS nondecreasing, round(max_by(v, l_linenumber) - min_by(v, l_linenumber), 4) AS rise FROM o GROUP BY l_suppkey""",
    "condition_mae": """
WITH x AS (SELECT l_linenumber, abs(l_discount - CASE WHEN l_tax > 0.01 THEN l_tax END) AS d, abs(l_quantity / 50 - 0.5) AS q FROM lineitem)
SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, round(avg(d), 6) AS error_d, count(d) AS n_d, round(avg(q), 6) AS error_q, round(avg(CASE WHEN d IS NULL THEN q ELSE (d + q) / 2 END), 6) AS mean_error, CAST(sum(1 + CASE WHEN d IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS observed FROM x GROUP BY ALL""",
    "validity_rates": "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS n_urgent, count(*) FILTER (WHERE o_totalprice > 200000) AS n_large, round(count(*) FILTER (WHERE o_orderpriority LIKE '1%') / count(*), 6) AS rate_urgent, round(count(*) FILTER (WHERE o_totalprice > 200000) / count(*), 6) AS rate_large FROM orders GROUP BY ALL",
    "issue_rate": "WITH c AS (SELECT l_orderkey, count(*) FILTER (WHERE l_discount > 0.08) AS n FROM lineitem GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS issues, count(*) FILTER (WHERE n > 0) AS charts_with, count(*) AS charts, round(count(*) FILTER (WHERE n > 0) / count(*), 6) AS rate FROM c",
    "teacher_weighted": "SELECT l_returnflag, " + ", ".join(f"round(avg({v}), 6) AS {v}_mean, round(sum({v} * l_quantity) / sum(l_quantity), 6) AS {v}_weighted, round(exp(sum({v} * l_quantity) / sum(l_quantity)), 6) AS {v}_perplexity" for v in ("l_discount", "l_tax")) + " FROM lineitem GROUP BY ALL",
    "branch_mix": "SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, round(0.1 * avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') + 0.8 * avg(l_extendedprice) FILTER (WHERE l_returnflag = 'N') + 0.1 * avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 4) AS mixed FROM lineitem GROUP BY ALL",
    "early_stop": """
WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM orders),
i AS (SELECT *, coalesce(o_totalprice < before, true) AS improved FROM s),
r AS (SELECT *, sum(CASE WHEN improved THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS island, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM i),
z AS (SELECT *, rn - min(rn) OVER (PARTITION BY o_custkey, island) AS stalled FROM r)
SELECT o_custkey, o_orderkey, round(o_totalprice, 6) AS o_totalprice, improved, round(least(o_totalprice, coalesce(before, o_totalprice)), 6) AS best, stalled, stalled >= 3 AS stop FROM z""",
    "percentile_table": "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 4) AS {n}" for n, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p995", 0.995))) + " FROM lineitem GROUP BY ALL",
    "coverage_within": "WITH l(lim) AS (VALUES (10.0::DOUBLE), (25.0), (40.0), (50.0)), s AS (SELECT lim, (SELECT avg(CASE WHEN l_quantity <= lim THEN 1.0 ELSE 0 END) FROM lineitem) AS share FROM l) SELECT lim AS \"limit\", round(share, 6) AS share, lim = coalesce((SELECT min(lim) FROM s WHERE share >= 0.995), 50.0) AS chosen FROM s",
    "rank_correlation": """
WITH p AS (SELECT l_returnflag, l_partkey, sum(l_quantity) AS x, CAST(count(*) AS DOUBLE) AS y FROM lineitem GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY x) + (count(*) OVER (PARTITION BY l_returnflag, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY y) + (count(*) OVER (PARTITION BY l_returnflag, y) - 1) / 2 AS ry FROM p)
SELECT l_returnflag, CASE WHEN count(*) > 1 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN round(corr(x, y), 6) END AS pearson, CASE WHEN count(*) > 1 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN round(corr(rx, ry), 6) END AS spearman FROM r GROUP BY ALL""",
    "weighted_percentile": """
WITH c AS (SELECT l_returnflag, l_discount AS x, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
k AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY x) AS c, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM c)
SELECT l_returnflag, """ + ", ".join(f"round(min(x) FILTER (WHERE c >= t * {p} - 1e-12), 6) AS q{round(p * 100)}" for p in (0.25, 0.5, 0.9)) + " FROM k GROUP BY ALL",
    "hist_percentile": """
WITH h AS (SELECT l_linestatus, floor(l_quantity / 5) * 5 AS low, count(*) AS n FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY l_linestatus ORDER BY low) AS c, sum(n) OVER (PARTITION BY l_linestatus) AS t FROM h)
SELECT l_linestatus, min_by(CASE WHEN low >= 45 THEN low ELSE low + 2.5 END, low) AS percentile FROM c WHERE c >= 0.9 * t GROUP BY ALL""",
    "pooled_moments": "WITH u AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT CAST(label AS BIGINT) AS label, count(*) AS n, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std FROM u GROUP BY ALL",
    "ledger_stats": "SELECT o_orderpriority, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM orders GROUP BY ALL",
    "pattern_levels": """
WITH x AS (SELECT unnest([{'f': 'l_discount', 'v': l_discount}, {'f': 'l_tax', 'v': l_tax}, {'f': 'l_quantity', 'v': l_quantity}]) AS s FROM lineitem),
q AS (SELECT s.f AS field, count(*) FILTER (WHERE s.v > 0) AS positive, quantile_cont(s.v, 0.25) FILTER (WHERE s.v > 0) AS a, quantile_cont(s.v, 0.75) FILTER (WHERE s.v > 0) AS b FROM x GROUP BY ALL)
SELECT field, '0.0000,' || printf('%.4f', a) || CASE WHEN a = b THEN '' ELSE ',' || printf('%.4f', b) END AS levels, positive FROM q""",
}

QUERIES = {
    f.__name__: f
    for f in (
        match_micro, match_by_user, match_views, match_summary, seed_pairs, multiset_union, onset_match, chart_describe, bootstrap_ci, paired_ci, slopes,
        condition_response, control_response, condition_mae, validity_rates, issue_rate, teacher_weighted, branch_mix, early_stop, percentile_table,
        coverage_within, rank_correlation, weighted_percentile, hist_percentile, pooled_moments, ledger_stats, pattern_levels,
    )
}
