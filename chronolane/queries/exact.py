"""Exact places, ticks, splits, samples and readouts over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolane.functions.scalars import reduced
from chronolane.operators import match, patterns, splits, stats, timeline, tokens
from chronolane.plans import reports, windows

from .base import EVENTS, events, rounded, table
from .matching import _F1
from .sequences import _P, _R, PER_DAY, _placed, _rows
from .splitting import _POOL, _POS, _SPLIT, _U
from .timelines import _LOCAL, _beats


def _fractions(spark, sf_dir):
    """Hours as fractions of a quarter day, on grids of 6, 12 and 18 parts."""
    times = F.pmod("event_id", F.lit(3)) + 1
    return _placed(spark, sf_dir).select("user_id", "event_id", "kind", "lane", F.floor(F.col("tick") / 6).alias("beat"), (F.pmod("tick", F.lit(6)) * times).alias("numer"), (6 * times).alias("denom"))


def exact_match(spark, sf_dir):
    rows = _fractions(spark, sf_dir).withColumn("side", F.pmod(F.floor(F.col("event_id") / 3), F.lit(2)))
    views = match.exact_views(*(rows.filter(f"side = {k}") for k in (0, 1)), ["user_id"], "beat", "numer", "denom", "lane", "kind", "event_id")
    return rounded(match.micro(views, ["user_id", "view"]))


def hold_spans(spark, sf_dir):
    """Lengths of holds in exact quarter days, and by how many rows of the user they reach."""
    holds = tokens.pair_holds(_placed(spark, sf_dir), ["user_id", "lane"], "tick", "kind", "event_id").filter("state = 'paired'")
    length = F.col("end") - F.col("start")
    part = reduced(F.pmod(length, F.lit(6)), F.lit(6))
    beats = F.concat_ws("+", F.floor(length / 6).cast("string"), F.concat_ws("/", part["numer"].cast("string"), part["denom"].cast("string")))
    ordinals = _rows(spark, sf_dir).selectExpr("user_id", "tick", "row_number() OVER (PARTITION BY user_id ORDER BY tick) AS place")
    start, end = (ordinals.select("user_id", F.col("tick").alias(c), F.col("place").alias(f"{c}_place")) for c in ("start", "end"))
    placed = holds.withColumn("beats", beats).join(start, ["user_id", "start"]).join(end, ["user_id", "end"])
    return stats.merge_distributions(stats.distribution(placed, "user_id", {"beats": F.col("beats"), "rows": F.col("end_place") - F.col("start_place")}))


def grid_points(spark, sf_dir):
    """Places of every beat by section: how many, and the first and last of each cell."""
    beats = _beats(spark, sf_dir)
    points = timeline.grid_points(beats, "user_id", timeline.grid_cells((1, 2, 3, 4)), F.lit(20 * 86_400_000.0))
    return rounded(points.groupBy("user_id", "section", "cell").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last")), 3)


def tick_notes(spark, sf_dir):
    notes = events(spark, sf_dir).select("user_id", "event_id", F.pmod("ms", F.lit(100000)).cast("double").alias("t"), F.when(F.col("event_type") == "signup", F.pmod("ms", F.lit(100000)) + F.col("value") * 10).alias("end"))
    timing = table(spark, sf_dir, "events").select("user_id", F.pmod("user_id", F.lit(7)).cast("double").alias("offset"), (F.pmod("user_id", F.lit(100)) + 100).cast("double").alias("bpm")).distinct()
    return rounded(timeline.tick_notes(notes, timing, "user_id", "t", "end", "offset", "bpm").select("event_id", "tick", "end_tick"))


def assigned_splits(spark, sf_dir):
    """Customers by their nation's split; nations of one region are unknown."""
    nations = splits.hash_split(table(spark, sf_dir, "nation").filter("n_regionkey <> 3"), "n_nationkey", {"train": 0.8, "val": 0.1, "test": 0.1}, 0)
    return splits.assign_splits(table(spark, sf_dir, "customer"), nations.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey").select("c_custkey", "split")


def scenario_conditions(spark, sf_dir):
    """Customers conditioned on their own or a donor's nation and balance; balances below 0 are unknown."""
    rows = table(spark, sf_dir, "customer")
    meta = rows.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"), F.col("c_nationkey").cast("long").alias("nation"))
    return rounded(reports.scenario_conditions(splits.donor_map(rows, "c_custkey", 4), meta, "c_custkey", ["balance", "nation"], 6))


def kept_samples(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("bar", F.floor(F.col("tick") / PER_DAY))
    spans = rows.groupBy("user_id").agg(F.min("bar").alias("low"), (F.max("bar") + 1).alias("high"))
    return rounded(windows.kept_samples(rows, spans, "user_id", "bar", "low", "high", 6, 11, 90))


def teacher_summary(spark, sf_dir):
    """Order lines as charts: quantities are tokens, discounts and taxes losses; lines returned have no row details, and no tokens of their type."""
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_quantity", "l_discount", "l_tax", (F.col("l_quantity") % 7).alias("taps"), F.when(F.col("l_quantity") < 0, 1.0).otherwise(0.0).alias("none"), F.when(F.col("l_returnflag") != "R", F.col("l_linenumber")).alias("right"), F.lit(7).alias("total"), F.lit(0).alias("nothing"))
    out = stats.teacher_summary(rows, ["l_linestatus"], ["l_discount"], ["l_discount", "l_tax"], "l_quantity", "l_tax", {"tap": {"tokens": "taps", "nll": "l_tax", "accuracy": "l_discount"}, "empty": {"tokens": "none", "nll": "l_tax"}}, {"lanes": ("right", "total"), "bare": ("nothing", "nothing")})
    return rounded(out)


def speed_times(spark, sf_dir):
    """Tempos at errors, some of no length; speeds at every event."""
    rows = events(spark, sf_dir)
    changes = rows.groupBy("user_id", F.col("ms").cast("double").alias("t")).agg(F.max(F.when(F.col("event_type") == "view", 1.0).otherwise(F.col("value") / 50)).alias("speed"))
    tempos = rows.filter("event_type = 'error'").groupBy("user_id", F.col("ms").cast("double").alias("t")).agg((F.pmod(F.max("event_id"), F.lit(40)) * 12.0 + F.when(F.pmod("user_id", F.lit(9)) == 0, 0.0).otherwise(300.0)).alias("length"))
    spans = rows.groupBy("user_id").agg(F.min("ms").cast("double").alias("first"), F.max("ms").cast("double").alias("last"))
    return rounded(patterns.speed_time(changes, tempos, spans, "user_id", "t", "speed", "length"), 3)


def _teacher() -> str:
    def part(section: str, name: str, value: str) -> str:
        return f"SELECT l_linestatus, '{section}' AS section, '{name}' AS name, round(CAST({value} AS DOUBLE), 6) AS value FROM t GROUP BY l_linestatus"

    mean = lambda v, w: f"sum({v} * {w}) / nullif(sum({w}), 0)"
    figures = [("chart", "charts", "count(*)"), ("chart", "tokens", "sum(l_quantity)"), ("chart", "l_discount", "avg(l_discount)"), ("token", "l_discount", mean("l_discount", "l_quantity")), ("token", "l_tax", mean("l_tax", "l_quantity")), ("token", "perplexity", f"exp({mean('l_tax', 'l_quantity')})")]
    figures += [("tap", "tokens", "sum(taps)"), ("tap", "nll", mean("l_tax", "taps")), ("tap", "accuracy", mean("l_discount", "taps")), ("tap", "perplexity", f"exp({mean('l_tax', 'taps')})"), ("empty", "tokens", "sum(0)"), ("empty", "nll", "NULL"), ("empty", "perplexity", "NULL")]
    figures += [("rows", "available", "count(*) FILTER (WHERE kept)"), ("rows", "lanes_correct", "sum(l_linenumber) FILTER (WHERE kept)"), ("rows", "lanes_total", "sum(7) FILTER (WHERE kept)"), ("rows", "lanes_rate", "sum(l_linenumber) FILTER (WHERE kept) / nullif(sum(7) FILTER (WHERE kept), 0)"), ("rows", "bare_correct", "sum(0) FILTER (WHERE kept)"), ("rows", "bare_total", "sum(0) FILTER (WHERE kept)"), ("rows", "bare_rate", "NULL")]
    return "WITH t AS (SELECT *, l_quantity % 7 AS taps, l_returnflag <> 'R' AS kept FROM lineitem) " + " UNION ALL ".join(part(*f) for f in figures)


_H = _P + ", h0 AS (SELECT user_id, lane, event_id, kind, tick, lead(kind) OVER w AS nk, lead(tick) OVER w AS nt FROM p WHERE kind <> 'tap' WINDOW w AS (PARTITION BY user_id, lane ORDER BY tick, event_id)), h AS (SELECT user_id, lane, tick AS s, nt AS e FROM h0 WHERE kind = 'start' AND nk = 'end')"
_COUNTED = "c AS (SELECT user_id, \"view\", a, b, lane, kind, sum(1 - side) AS p, sum(side) AS e FROM v GROUP BY ALL), m AS (SELECT user_id, \"view\", CAST(sum(least(p, e)) AS BIGINT) AS tp, CAST(sum(p) - sum(least(p, e)) AS BIGINT) AS fp, CAST(sum(e) - sum(least(p, e)) AS BIGINT) AS fn FROM c GROUP BY ALL)"
SQL = {
    "exact_match": f"""WITH {_P}, f AS (SELECT *, event_id // 3 % 2 AS side FROM p), h0 AS (SELECT *, lead(kind) OVER w AS nk, lead(tick) OVER w AS nt FROM f WHERE kind <> 'tap' WINDOW w AS (PARTITION BY side, user_id, lane ORDER BY tick, event_id)),
v AS (SELECT user_id, side, 'event' AS "view", tick AS a, NULL::BIGINT AS b, lane, kind FROM f UNION ALL SELECT user_id, side, 'kind', tick, NULL, NULL, kind FROM f UNION ALL SELECT user_id, side, 'lane', tick, NULL, lane, NULL FROM f
UNION ALL SELECT user_id, side, 'note', tick, NULL, lane, NULL FROM f WHERE kind = 'tap' UNION ALL SELECT user_id, side, 'note', tick, nt, lane, NULL FROM h0 WHERE kind = 'start' AND nk = 'end'), {_COUNTED}
SELECT user_id, "view", tp, fp, fn, {_F1} FROM m""",
    "hold_spans": f"""WITH {_H}, q AS (SELECT user_id, tick, row_number() OVER (PARTITION BY user_id ORDER BY tick) AS n FROM (SELECT DISTINCT user_id, tick FROM p)), x AS (SELECT h.*, e - s AS l, b.n - a.n AS k FROM h JOIN q a ON a.user_id = h.user_id AND a.tick = s JOIN q b ON b.user_id = h.user_id AND b.tick = e),
d AS (SELECT user_id, 'beats' AS part, (l // 6) || '+' || (l % 6 // gcd(l % 6, 6)) || '/' || (6 // gcd(l % 6, 6)) AS key FROM x UNION ALL SELECT user_id, 'rows', CAST(k AS VARCHAR) FROM x) SELECT part, key, count(*) AS n, count(DISTINCT user_id) AS charts FROM d GROUP BY ALL""",
    "grid_points": _LOCAL
    + ", c(cell, numer, denom) AS (VALUES " + ", ".join(f"({i}, {n}, {d})" for i, (n, d) in enumerate(timeline.grid_cells((1, 2, 3, 4)))) + "), g2 AS (SELECT user_id, section, cell::BIGINT AS cell, start, actual, nominal, start + numer::DOUBLE / denom * nominal AS t FROM b, c) SELECT user_id, section, cell, count(*) AS n, round(min(t), 3) AS first, round(max(t), 3) AS last FROM g2 WHERE t >= 0 AND t < 20 * 86400000.0 AND NOT (nominal - actual > 1e-6 AND t >= start + actual - 1e-6) GROUP BY ALL",
    "tick_notes": f"WITH n AS (SELECT event_id, user_id, CAST(ms % 100000 AS DOUBLE) AS t, CASE WHEN event_type = 'signup' THEN ms % 100000 + value * 10 END AS fin FROM {EVENTS}) SELECT event_id, CAST(round_even((t - user_id % 7) * (user_id % 100 + 100)::DOUBLE / 60000.0::DOUBLE * 48, 0) AS BIGINT) AS tick, CAST(round_even((fin - user_id % 7) * (user_id % 100 + 100)::DOUBLE / 60000.0::DOUBLE * 48, 0) AS BIGINT) AS end_tick FROM n",
    "assigned_splits": f"SELECT c_custkey, {_SPLIT.format(p=_POS.format('c_nationkey'))} AS split FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 3",
    "scenario_conditions": _POOL
    + f""", m AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, CAST(c_nationkey AS BIGINT) AS nation FROM customer),
x AS (SELECT target, scenario, CASE WHEN r THEN donor END AS donor, kept, CASE WHEN r THEN b.balance ELSE a.balance END AS balance, CASE WHEN r THEN b.nation ELSE a.nation END AS nation
  FROM d JOIN m a ON a.c_custkey = target JOIN m b ON b.c_custkey = donor, (VALUES ('matched', false, 'all'), ('matched_partial', false, 'some'), ('random', true, 'all'), ('random_partial', true, 'some'), ('none', false, 'none')) s(scenario, r, kept)),
y AS (SELECT *, CASE WHEN balance IS NOT NULL AND {_U.format("'6|' || target || '|' || scenario || '|balance'")} / 4294967296.0::DOUBLE < 0.5 THEN 1 ELSE 0 END AS d0, CASE WHEN {_U.format("'6|' || target || '|' || scenario || '|nation'")} / 4294967296.0::DOUBLE < 0.5 THEN 1 ELSE 0 END AS d1, balance IS NOT NULL AS p FROM x),
z AS (SELECT *, CASE kept WHEN 'all' THEN p::INT WHEN 'none' THEN 0 ELSE CASE WHEN p AND d0 = d1 THEN 1 - d0 ELSE d0 END END AS k0, CASE kept WHEN 'all' THEN 1 WHEN 'none' THEN 0 ELSE d1 END AS k1 FROM y)
SELECT target, scenario, donor, k0 || '' || k1 AS mask, round(CASE WHEN k0 = 1 THEN balance END, 6) AS balance, CASE WHEN k1 = 1 THEN nation END AS nation FROM z""",
    "kept_samples": f"WITH {_R}, es AS (SELECT user_id, min(bar) AS low, max(bar) + 1 AS high FROM r GROUP BY ALL), s AS (SELECT user_id, i AS sample, low + CAST('0x' || substr(md5('11|' || user_id || '|' || i), 1, 8) AS BIGINT) % (high - low - 15) AS start FROM es, range(6) f(i) WHERE high - low >= 16), c AS (SELECT s.*, 2 * count(r.tick) + 19 AS tokens FROM s LEFT JOIN r ON r.user_id = s.user_id AND r.bar >= start AND r.bar < start + 16 GROUP BY ALL) SELECT user_id, sample, start, tokens FROM c WHERE tokens <= 90",
    "teacher_summary": _teacher(),
    "speed_times": f"""WITH c AS (SELECT user_id, ms::DOUBLE AS t, max(CASE WHEN event_type = 'view' THEN 1.0 ELSE value / 50 END) AS v FROM {EVENTS} GROUP BY ALL), sp AS (SELECT user_id, max(ms)::DOUBLE AS last FROM {EVENTS} GROUP BY ALL),
n AS (SELECT c.*, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), last) AS u FROM c JOIN sp USING (user_id)), a AS (SELECT user_id, sum(CASE WHEN abs(v - 1) > 0.05 THEN u - t ELSE 0 END) AS total FROM n GROUP BY ALL),
l AS (SELECT user_id, ms, max(event_id) % 40 * 12.0::DOUBLE + CASE WHEN user_id % 9 = 0 THEN 0 ELSE 300 END AS x FROM {EVENTS} WHERE event_type = 'error' GROUP BY user_id, ms), b AS (SELECT *, lag(x) OVER (PARTITION BY user_id ORDER BY ms) AS w FROM l),
j AS (SELECT user_id, bool_or(x <= 0 OR 60000 / nullif(x, 0) <= 30 OR 60000 / nullif(x, 0) >= 350 OR greatest(w / nullif(x, 0), x / nullif(w, 0)) >= 3) AS jump FROM b GROUP BY ALL)
SELECT user_id, round(CASE WHEN coalesce(jump, false) THEN greatest(total, 2001.0) ELSE total END, 3) AS speed_time FROM a LEFT JOIN j USING (user_id)""",
}
QUERIES = {f.__name__: f for f in (exact_match, hold_spans, grid_points, scenario_conditions, tick_notes, assigned_splits, kept_samples, teacher_summary, speed_times)}
