"""A frozen list of motifs counted by lane, hand and row, how much of the windows it covers, and how two halves of the users differ."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolane.operators import match, motif, ranks, stats, vocabulary
from chronolane.plans import reports
from chronolane.session import cut

from .base import events, rounded, table
from .matching import SQL as MATCHING
from .records import SQL as RECORDS
from .reporting import _records
from .sequences import _P, _grams, _placed

TOP = 30


def _steps(spark, sf_dir):
    rows = _placed(spark, sf_dir).withColumn("week", F.floor(F.col("bar") / 7))
    return motif.scope_steps(rows, ["user_id"], ["ms", "event_id"], "lane", "event_type", "bar", keep=("week",))


def _list(stepped, written=False):
    return motif.motif_topk(stepped.drop("week"), ["user_id", "scope", "part"], ["scope"], TOP, written).select("scope", "motif")


def motif_report(spark, sf_dir):
    stepped = _steps(spark, sf_dir)
    return rounded(vocabulary.motif_report(stepped, ["user_id"], _list(stepped)))


def motif_coverage(spark, sf_dir):
    stepped = _steps(spark, sf_dir)
    counts = vocabulary.count_motifs(stepped, ["user_id"], _list(stepped))
    return rounded(vocabulary.window_coverage(stepped, ["user_id"], "week", counts, [1, 2, 3]))


def distance_report(spark, sf_dir):
    stepped = _steps(spark, sf_dir)
    listed = _list(stepped)
    sides = [vocabulary.motif_report(stepped.filter(F.pmod("user_id", F.lit(2)) == k), ["user_id"], listed).filter("part = 'all'") for k in (0, 1)]
    return rounded(vocabulary.distance_report(*sides, ["scope"]))


def whole_summary(spark, sf_dir):
    """The composite report with diversity of seeds, motif distances and coverage."""
    records = _records(spark, sf_dir).withColumn("concurrent", F.col("fp") % 3).withColumn("notes", F.col("tp") + F.col("fp"))
    counts = stats.distribution(_placed(spark, sf_dir), "user_id", {"kind": F.col("kind")})
    line = table(spark, sf_dir, "lineitem")
    a, b = (line.filter(f"l_linenumber = {k}").select("l_orderkey", F.col("l_quantity").alias(f"target_{s}_q"), F.col("l_extendedprice").alias(f"made_{s}_q")) for k, s in ((1, "a"), (2, "b")))
    stepped = _steps(spark, sf_dir)
    listed = _list(stepped)
    sides = [vocabulary.motif_report(stepped.filter(F.pmod("user_id", F.lit(2)) == k), ["user_id"], listed).filter("part = 'all'") for k in (0, 1)]
    distance = vocabulary.distance_report(*sides, ["scope"]).filter("section IN ('summary', 'contribution')").select("scope", "section", "name", F.round("value", 6).alias("value"))
    coverage = vocabulary.window_coverage(stepped, ["user_id"], "week", vocabulary.count_motifs(stepped, ["user_id"], listed), [1, 2, 3])
    rows = events(spark, sf_dir).withColumn("seed", F.pmod("event_id", F.lit(5)))
    pairs = match.seed_pairs(rows, "user_id", "seed", ["event_type", "lane"])
    diversity = pairs.groupBy(F.lit("seeds").alias("of")).agg(F.count("*").alias("pairs"), F.count_if("identical").alias("identical"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    coverage = coverage.withColumn("coverage", F.round("coverage", 6))
    extra = {"diversity": (diversity, ["of"]), "distance": (distance, ["scope", "section", "name"]), "coverage": (coverage, ["scope", "length"])}
    return rounded(reports.full_summary(records, ["mode"], "user_id", ["concurrent"], counts, a.join(b, "l_orderkey"), ["q"], extra), 4)


def _halves(spark, sf_dir):
    """Motif counts of each half of the users, and of all of them, by the list of all."""
    stepped = cut(_steps(spark, sf_dir).drop("week").withColumn("side", F.pmod("user_id", F.lit(2))), "steps")  # the list and both reports read it
    listed = _list(stepped.drop("side"), written=True)
    made, human = vocabulary.motif_report(stepped, ["side", "user_id"], listed, by=["side"]), vocabulary.motif_report(stepped.drop("side"), ["user_id"], listed)
    return cut(made, "made"), cut(human, "human")  # a row for each motif; every distance reads them


def distance_recheck(spark, sf_dir):
    """A stored summary in which one figure is another and one is gone, checked against the corpora."""
    made, human = _halves(spark, sf_dir)
    stored = vocabulary.distance_to(made, human, ["side"]).filter("section = 'summary'").select("side", "scope", "name", "value")
    stored = stored.filter("NOT (side = 1 AND scope = 'row' AND name = 'rmse')").withColumn("value", F.col("value") + F.when(F.expr("side = 0 AND scope = 'hand' AND name = 'mae'"), 0.001).otherwise(0.0))
    return rounded(reports.recheck_distances(stored, made, human, ["side"]))


def length_shares(spark, sf_dir):
    return rounded(vocabulary.length_shares(vocabulary.distance_to(*_halves(spark, sf_dir), ["side"]), ["side", "scope"]))


def seed_report(spark, sf_dir):
    """Two seeds of every user that has both, against the user's events as a whole; a hold's start that no end follows in its lane is an issue."""
    rows = _placed(spark, sf_dir).withColumns({"seed": F.col("event_id") % 2, "week": F.floor(F.col("bar") / 7)})
    both = rows.groupBy("user_id").agg(F.count_distinct("seed").alias("n")).filter("n = 2").select("user_id")
    rows = cut(rows.join(both, "user_id", "left_semi"), "samples")  # every section reads them
    order = ["ms", "event_id"]
    made = motif.scope_steps(rows, ["seed", "user_id"], order, "lane", "event_type", "bar")
    human = motif.scope_steps(rows, ["user_id"], order, "lane", "event_type", "bar")
    follows = F.lead("kind").over(Window.partitionBy("seed", "user_id", "lane").orderBy(*order))
    issues = rows.withColumn("issue", F.when((F.col("kind") == "start") & ~follows.eqNullSafe(F.lit("end")), "missing_hold_tail")).filter("issue IS NOT NULL")
    kinds = ["missing_hold_head", "missing_hold_tail"]
    return rounded(reports.seed_report(both, rows, made, human, issues, _list(human), "user_id", "seed", ["lane", "kind"], "pos", "issue", kinds))


def percentiles_whole(spark, sf_dir):
    return rounded(ranks.exact_percentiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", [], {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p995": 0.995}), 4)


def describe_whole(spark, sf_dir):
    return rounded(stats.describe_values(table(spark, sf_dir, "orders"), "o_totalprice", []), 4)


def correlation_whole(spark, sf_dir):
    return rounded(stats.correlations(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", []))


def average_ranks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"))
    return rounded(ranks.average_ranks(rows, [], {"rank": "quantity"}))


def _scoped(base: str, src: str, more: str = "", frozen: str = "TRUE") -> str:
    """The steps s, their motifs and the list v; ``more`` names a column of the corpus, ``frozen`` the rows that the list is taken from."""
    seq = f"{more}user_id, scope, part"
    return (
        base
        + f""", e AS (SELECT {more}user_id, 'lane' AS scope, CAST(lane AS VARCHAR) AS part, event_type AS symbol, bar, ms, event_id FROM {src} UNION ALL SELECT {more}user_id, 'hand', CASE WHEN lane < 2 THEN 'left' ELSE 'right' END, event_type || CASE WHEN lane < 2 THEN lane ELSE 3 - lane END, bar, ms, event_id FROM {src} UNION ALL SELECT {more}user_id, 'row', 'all', event_type || lane, bar, ms, event_id FROM {src}),
s AS (SELECT {seq}, symbol, bar // 7 AS week, row_number() OVER w AS i, lead(bar) OVER w - bar AS gap FROM e WINDOW w AS (PARTITION BY {seq} ORDER BY ms, event_id)), """
        + ", ".join(f"g{n} AS ({_grams(n, seq)})" for n in (1, 2, 3, 4))
        + ", every AS ("
        + " UNION ALL ".join(f"SELECT {seq}, motif, {n} AS length FROM g{n}" for n in (1, 2, 3, 4))
        + f"), v AS (SELECT scope, motif, length FROM (SELECT scope, motif, length, row_number() OVER (PARTITION BY scope ORDER BY n DESC, motif) AS place FROM (SELECT scope, motif, length, count(*) AS n FROM every WHERE {frozen} GROUP BY ALL)) WHERE place <= {TOP})"
    )


_SC = _scoped(_P, "p")


def _report(where: str, more: str = "") -> str:
    """Pooled counts (scope, motif, length, n, observations) of some users, or of each corpus."""
    same = f"x.{more.rstrip(', ')} = o.{more.rstrip(', ')} AND " if more else ""
    front = f"o.{more}" if more else ""
    return f"SELECT {front}v.scope, v.motif, v.length, count(x.motif) AS n, any_value(o.n) AS observations FROM v JOIN (SELECT {more}scope, count(*) AS n FROM s WHERE {where} GROUP BY ALL) o ON o.scope = v.scope LEFT JOIN (SELECT * FROM every WHERE {where}) x ON {same}x.scope = v.scope AND x.motif = v.motif GROUP BY {front}v.scope, v.motif, v.length"


_B = "(VALUES ('1', 1, 1), ('2', 2, 2), ('3', 3, 3), ('4', 4, 4), ('5', 5, 5), ('6-8', 6, 8), ('9-16', 9, 16), ('17+', 17, 1000000000)) b(name, low, high)"
_NO = "NULL::BIGINT AS rank, NULL::BIGINT AS length, NULL::DOUBLE AS f_left, NULL::DOUBLE AS f_right"


def _distance(k: str) -> str:
    """The distance report r of the frequencies a and b, for each value of the columns ``k``."""
    of = ", ".join(f"t.{c.strip()}" for c in k.split(","))
    on = " AND ".join(f"k.{c.strip()} = t.{c.strip()}" for c in k.split(","))
    return f"""f AS (SELECT {k}, motif, a.length::BIGINT AS length, a.n / a.observations AS x, b.n / b.observations AS y FROM a JOIN b USING (scope, motif)),
k AS (SELECT *, x - y AS d, round(abs(x - y), 12) AS g, rank() OVER (PARTITION BY {k} ORDER BY x) + (count(*) OVER (PARTITION BY {k}, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY {k} ORDER BY y) + (count(*) OVER (PARTITION BY {k}, y) - 1) / 2 AS ry FROM f),
t AS (SELECT {k}, count(*)::DOUBLE AS vocabulary, avg(abs(d)) AS mae, sqrt(avg(d * d)) AS rmse, corr(rx, ry) AS spearman FROM k GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY g DESC, motif) AS by_gap, row_number() OVER (PARTITION BY {k} ORDER BY round(d, 12) DESC, motif) AS by_excess FROM k),
bk AS (SELECT {of}, b.name, any_value(vocabulary) AS vocabulary, sum(abs(d)) AS total, count(d) AS n FROM t CROSS JOIN {_B} LEFT JOIN k ON {on} AND k.length BETWEEN b.low AND b.high GROUP BY ALL),
r AS (SELECT {k}, 'summary' AS section, unnest(['vocabulary', 'mae', 'rmse', 'spearman']) AS name, {_NO}, unnest([vocabulary, mae, rmse, spearman]) AS value FROM t
UNION ALL SELECT {k}, 'largest', motif, 1, length, x, y, d FROM q WHERE by_gap = 1 UNION ALL SELECT {k}, 'excess', motif, 1, length, x, y, d FROM q WHERE by_excess = 1 UNION ALL SELECT {k}, 'gap', motif, by_gap, length, x, y, d FROM q WHERE by_gap <= 15
UNION ALL SELECT {k}, 'length', CAST(length AS VARCHAR), count(*), length, NULL, NULL, sum(abs(d)) / any_value(vocabulary) FROM k JOIN t USING ({k}) GROUP BY {k}, length
UNION ALL SELECT {k}, 'bucket', name, {_NO}, total / nullif(n, 0) FROM bk UNION ALL SELECT {k}, 'contribution', name, {_NO}, coalesce(total, 0) / vocabulary FROM bk)"""


_FIVE = ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 4) AS {n}" for n, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p995", 0.995)))
SQL = {
    "motif_report": f"""WITH {_SC}, pt AS (SELECT DISTINCT scope, part FROM s UNION SELECT DISTINCT scope, 'all' FROM s), o AS (SELECT pt.scope, pt.part, count(*) AS observations FROM pt JOIN s ON s.scope = pt.scope AND (pt.part = 'all' OR s.part = pt.part) GROUP BY ALL),
c AS (SELECT scope, part, motif, count(*) AS n FROM every GROUP BY ALL UNION ALL SELECT scope, 'all', motif, count(*) FROM every WHERE scope <> 'row' GROUP BY ALL)
SELECT o.scope, o.part, v.motif, coalesce(c.n, 0) AS n, observations, round(coalesce(c.n, 0) / (SELECT count(DISTINCT user_id) FROM s), 6) AS average FROM o JOIN v USING (scope) LEFT JOIN c ON c.scope = o.scope AND c.part = o.part AND c.motif = v.motif""",
    "motif_coverage": f"WITH {_SC}, u AS ("
    + " UNION ALL ".join(f"SELECT scope, {n}::BIGINT AS length, week, lead(week, {n - 1}) OVER (PARTITION BY user_id, scope, part ORDER BY i) AS l FROM s" for n in (1, 2, 3))
    + "), a AS (SELECT scope, length, count(*) AS windows, count(*) FILTER (WHERE l <> week) AS crossing FROM u WHERE l IS NOT NULL GROUP BY ALL), h AS (SELECT scope, every.length, count(*) AS hits FROM every JOIN v USING (scope, motif) GROUP BY ALL) SELECT scope, length, windows, crossing, coalesce(hits, 0) AS hits, round(coalesce(hits, 0) / windows, 6) AS coverage FROM a LEFT JOIN h USING (scope, length)",
    "distance_report": f"WITH {_SC}, a AS ({_report('user_id % 2 = 0')}), b AS ({_report('user_id % 2 = 1')}), {_distance('scope')} SELECT scope, section, name, rank, length, round(f_left, 6) AS f_left, round(f_right, 6) AS f_right, round(value, 6) AS value FROM r",
    "percentiles_whole": f"SELECT {_FIVE} FROM lineitem",
    "describe_whole": "SELECT count(*) AS count, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, round(min(o_totalprice), 4) AS min, round(max(o_totalprice), 4) AS max FROM orders",
    "correlation_whole": "WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rx, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS ry FROM lineitem) SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r",
    "average_ranks": "WITH q AS (SELECT l_partkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL) SELECT l_partkey, quantity, rank() OVER (ORDER BY quantity) + (count(*) OVER (PARTITION BY quantity) - 1) / 2 AS rank FROM q",
}
_EACH = lambda names: f"unnest([{', '.join(repr(n) for n in names.split())}]) AS name, unnest([{', '.join(f'round({n}::DOUBLE, 4)' for n in names.split())}]) AS value"
SQL["whole_summary"] = f"""SELECT section, key, name, value FROM ({RECORDS['full_summary']}) WHERE NOT (section = 'distribution' AND key LIKE 'position|%')
UNION ALL SELECT 'diversity', 'seeds', {_EACH('pairs identical tp fp fn')} FROM (SELECT count(*) AS pairs, count(*) FILTER (WHERE identical) AS identical, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM ({MATCHING['seed_pairs']}))
UNION ALL SELECT 'distance', scope || '|' || section || '|' || name, 'value', round(value, 4) FROM ({SQL['distance_report']}) WHERE section IN ('summary', 'contribution')
UNION ALL SELECT 'coverage', scope || '|' || length, {_EACH('windows crossing hits coverage')} FROM ({SQL['motif_coverage']})"""
_SIDES = _scoped(_P + ", p2 AS (SELECT user_id % 2 AS side, * FROM p UNION ALL SELECT -1, * FROM p)", "p2", "side, ", "side = -1")
_SIDES += f", a AS ({_report('side >= 0', 'side, ')}), b AS ({_report('side = -1')}), {_distance('side, scope')}"
SQL["distance_recheck"] = f"""WITH {_SIDES}, o AS (SELECT side, scope, name, value FROM r WHERE section = 'summary' AND name <> 'vocabulary')
SELECT side, scope, name, round(value + 0.001, 6) AS stored, round(value, 6) AS recomputed FROM o WHERE side = 0 AND scope = 'hand' AND name = 'mae' UNION ALL SELECT side, scope, name, NULL, round(value, 6) FROM o WHERE (side = 1 AND scope = 'row' AND name = 'rmse') OR value IS NULL"""
SQL["length_shares"] = f"WITH {_SIDES} SELECT side, scope, length, rank AS motifs, round(value, 6) AS contribution, round(CASE WHEN sum(value) OVER w > 0 THEN value / sum(value) OVER w ELSE 0 END, 6) AS share FROM r WHERE section = 'length' WINDOW w AS (PARTITION BY side, scope)"
_SEEDS = _scoped(_P + ", q0 AS (SELECT * FROM p WHERE user_id IN (SELECT user_id FROM p GROUP BY user_id HAVING count(DISTINCT event_id % 2) = 2)), p2 AS (SELECT event_id % 2 AS seed, * FROM q0 UNION ALL SELECT -1, * FROM q0)", "p2", "seed, ", "seed = -1")
_SEEDS += f", a AS ({_report('seed >= 0', 'seed, ')}), b AS ({_report('seed = -1')}), {_distance('seed, scope')}"
_SEED_EACH = lambda names: f"unnest([{', '.join(repr(n) for n in names.split())}]) AS name, unnest([{', '.join(f'{n}::DOUBLE' for n in names.split())}]) AS value"
SQL["seed_report"] = f"""WITH {_SEEDS}, z AS (SELECT seed, count(DISTINCT user_id) AS charts, count(*) AS total FROM p2 WHERE seed >= 0 GROUP BY ALL),
st AS (SELECT seed, coalesce(CAST(lane AS VARCHAR), 'all') || '|' || coalesce(kind, 'all') || '|' || pos AS key, count(*) AS n, count(*) / any_value(charts) AS avg_count, count(*) / any_value(total) AS pooled FROM p2 JOIN z USING (seed) GROUP BY GROUPING SETS ((seed, lane, kind, pos), (seed, kind, pos), (seed, lane, pos), (seed, pos))),
pt AS (SELECT DISTINCT seed, scope, part FROM s WHERE seed >= 0 UNION SELECT DISTINCT seed, scope, 'all' FROM s WHERE seed >= 0), o AS (SELECT pt.seed, pt.scope, pt.part, count(*) AS observations FROM pt JOIN s ON s.seed = pt.seed AND s.scope = pt.scope AND (pt.part = 'all' OR s.part = pt.part) GROUP BY ALL),
c AS (SELECT seed, scope, part, motif, count(*) AS n FROM every GROUP BY ALL UNION ALL SELECT seed, scope, 'all', motif, count(*) FROM every WHERE scope <> 'row' GROUP BY ALL),
mo AS (SELECT o.seed, o.scope || '|' || o.part || '|' || v.motif AS key, coalesce(c.n, 0) AS n, observations, coalesce(c.n, 0) / charts AS average FROM o JOIN v USING (scope) JOIN z ON z.seed = o.seed LEFT JOIN c ON c.seed = o.seed AND c.scope = o.scope AND c.part = o.part AND c.motif = v.motif),
h AS (SELECT seed, user_id FROM (SELECT seed, user_id, kind, lead(kind) OVER (PARTITION BY seed, user_id, lane ORDER BY ms, event_id) AS follows FROM p2 WHERE seed >= 0) WHERE kind = 'start' AND follows IS DISTINCT FROM 'end'),
iss AS (SELECT seed, 'missing_hold_tail' AS key, (SELECT count(DISTINCT user_id) FROM h WHERE h.seed = z.seed) AS charts_with, (SELECT count(*) FROM h WHERE h.seed = z.seed) AS instances, charts FROM z UNION ALL SELECT seed, 'missing_hold_head', 0, 0, charts FROM z),
whole AS (SELECT seed, 'statistics' AS section, key, {_SEED_EACH('n avg_count pooled')} FROM st UNION ALL SELECT seed, 'motifs', key, {_SEED_EACH('n observations average')} FROM mo
UNION ALL SELECT seed, 'distance', scope || '|' || section || '|' || name, 'value', value FROM r UNION ALL SELECT seed, 'issues', key, {_SEED_EACH('charts_with instances charts')} FROM iss)
SELECT seed, section, key, name, round(value, 6) AS value FROM whole"""
QUERIES = {f.__name__: f for f in (motif_report, motif_coverage, distance_report, distance_recheck, length_shares, seed_report, whole_summary, percentiles_whole, describe_whole, correlation_whole, average_ranks)}
