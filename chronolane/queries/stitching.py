"""Windows of a user's days as token sequences: encoded, damaged, stitched, replayed and decoded.

Of a user's events in one lane and hour the first counts; signups and purchases open and close the lane's holds by turns,
taps inside a hold are left out, so that every lane is legal. Every third window loses its last token and its end, every
fourth all from its eleventh bar on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolane.operators import decoding, tokens
from chronolane.plans import stitching, windows
from chronolane.session import cut

from .sequences import _P, PER_DAY, _placed, _sequences, _windows


def _legal(spark, sf_dir) -> DataFrame:
    cells = _placed(spark, sf_dir).groupBy("user_id", "lane", "tick").agg(F.min_by("kind", "event_id").alias("kind"))
    turn = F.count_if(F.col("kind") != "tap").over(Window.partitionBy("user_id", "lane").orderBy("tick"))
    cells = cells.withColumn("k", turn).filter("kind <> 'tap' OR k % 2 = 0")
    return cells.withColumn("kind", F.when(F.col("kind") == "tap", "tap").when(F.col("k") % 2 == 1, "start").otherwise("end")).drop("k")


def _encoded(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Windows with tokens, and spans of bars."""
    legal = _legal(spark, sf_dir)
    rows = tokens.event_rows(legal, "user_id", "tick", "lane", "kind").withColumn("bar", F.floor(F.col("tick") / PER_DAY)).withColumn("pos", F.pmod("tick", F.lit(PER_DAY)))
    spans = rows.groupBy("user_id").agg(F.min("bar").alias("low"), (F.max("bar") + 1).alias("high"))
    made = windows.overlap_windows(spans, "user_id", "low", "high")
    initial = stitching.initial_rows(legal, made, "user_id", "tick", "lane", "kind", PER_DAY)
    return cut(stitching.encode_windows(rows, made, initial, "user_id", "n", "bar", "pos", "row"), "windows"), spans


def _damaged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    made, spans = _encoded(spark, sf_dir)
    markers = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.get("tokens", i) == "BAR")
    cut = F.when(F.pmod("n", F.lit(4)) == 3, F.slice("tokens", F.lit(1), F.get(markers, F.lit(10)))).when(F.pmod("n", F.lit(3)) == 2, F.slice("tokens", F.lit(1), F.size("tokens") - 2)).otherwise(F.col("tokens"))
    return made.withColumn("tokens", cut), spans


def _stitched(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    made, spans = _damaged(spark, sf_dir)
    return stitching.whole_charts(stitching.kept_bars(made, "user_id", "n"), spans, "user_id", "low", "high"), made


def stitched_tokens(spark, sf_dir):
    return stitching.chart_tokens(_stitched(spark, sf_dir)[0], "user_id").select("user_id", F.array_join("tokens", " ").alias("tokens"))


def stitch_missing(spark, sf_dir):
    return stitching.missing_keeps(_damaged(spark, sf_dir)[0], "user_id", "n").select("user_id", F.col("n").cast("long").alias("n"), "bar")


def replayed_rows(spark, sf_dir):
    bars, made = _stitched(spark, sf_dir)
    states = stitching.states_at_bars(bars, "user_id")
    return made.join(states, (made.user_id == states.user_id) & (made.start == states.bar)).select(made.user_id, made.n.cast("long").alias("n"), states.row)


def context_prompts(spark, sf_dir):
    out = stitching.context_prompts(*_stitched(spark, sf_dir), "user_id", "n")
    return out.select("user_id", F.col("n").cast("long").alias("n"), F.array_join("prompt", " ").alias("prompt"))


def decode_notes(spark, sf_dir):
    made = _encoded(spark, sf_dir)[0].withColumn("initial", F.substr(F.get("tokens", F.lit(1)), F.lit(5)))
    out = decoding.decode_notes(made, ["user_id", "n"], "tokens", "start", "initial", PER_DAY)
    return out.withColumn("n", F.col("n").cast("long")).withColumn("lane", F.col("lane").cast("long"))


def decode_rejects(spark, sf_dir):
    """The days as they are, most of them with lanes that aren't legal, and some with tokens changed."""
    at = F.array_position("tokens", F.element_at(F.filter("tokens", lambda t: t.startswith("ROW_")), 1)).cast("int")
    less = F.concat(F.slice("tokens", F.lit(1), at - 1), F.slice("tokens", at + 1, F.size("tokens")))
    twice = F.concat(F.slice("tokens", F.lit(1), at), F.slice("tokens", at - 1, F.lit(2)), F.slice("tokens", at + 1, F.size("tokens")))
    which = F.pmod("user_id", F.lit(6))
    changed = F.when(which == 1, less).when(which == 2, F.concat(F.array(F.lit("POS_1")), F.col("tokens"))).when(which == 3, twice).when(which == 4, F.concat(F.slice("tokens", F.lit(1), F.lit(1)), F.array(F.lit("POS_x")), F.col("tokens")))
    rows = _sequences(spark, sf_dir).withColumn("tokens", F.coalesce(changed, F.col("tokens"))).withColumns({"start": F.lit(0), "initial": F.when(F.col("user_id") % 12 == 5, "0200").otherwise("0000")})
    return decoding.cells(rows, ["user_id"], "tokens", "start", "initial", PER_DAY)[1].withColumn("i", F.col("i").cast("long"))


_L = (
    _P
    + """, k0 AS (SELECT user_id, lane, tick, arg_min(kind, event_id) AS kind FROM p GROUP BY ALL), k1 AS (SELECT *, count(*) FILTER (WHERE kind <> 'tap') OVER (PARTITION BY user_id, lane ORDER BY tick) AS k FROM k0),
l AS (SELECT user_id, lane, tick, tick // 24 AS bar, CASE WHEN kind = 'tap' THEN 1 WHEN k % 2 = 1 THEN 2 ELSE 4 END AS code FROM k1 WHERE kind <> 'tap' OR k % 2 = 0),
x AS (SELECT user_id, tick, i AS lane FROM (SELECT DISTINCT user_id, tick FROM l) g, range(4) f(i)),
y AS (SELECT x.*, code, last_value(CASE WHEN code IN (2, 4) THEN code END IGNORE NULLS) OVER (PARTITION BY x.user_id, x.lane ORDER BY x.tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM x LEFT JOIN l USING (user_id, tick, lane)),
r AS (SELECT user_id, tick, tick // 24 AS bar, tick % 24 AS pos, string_agg(CAST(coalesce(code, CASE WHEN was = 2 THEN 3 ELSE 0 END) AS VARCHAR), '' ORDER BY lane) AS row FROM y GROUP BY ALL),
es AS (SELECT user_id, min(bar) AS low, max(bar) + 1 AS high FROM l GROUP BY ALL), """
    + _windows("es", "user_id")
)
_KEPT = (
    _L
    + """, lt AS (SELECT w.user_id, w.n, max(tick) AS last FROM w JOIN r ON r.user_id = w.user_id AND r.bar = start + 15 GROUP BY ALL),
em AS (SELECT w.*, last, CASE WHEN w.n % 4 = 3 THEN 10 WHEN w.n % 3 = 2 AND last IS NULL THEN 15 ELSE 16 END AS given FROM w LEFT JOIN lt USING (user_id, n)),
kr AS (SELECT r.* FROM r JOIN em ON em.user_id = r.user_id AND r.bar >= keep_start AND r.bar < keep_end AND r.bar < start + given AND NOT coalesce(n % 3 = 2 AND n % 4 <> 3 AND r.tick = last, false)),
tk AS (SELECT user_id, unnest(range(low, high)) AS bar, -1 AS pos, 0 AS k, 'BAR' AS tok FROM es UNION ALL SELECT user_id, bar, pos, 0, 'POS_' || pos FROM kr UNION ALL SELECT user_id, bar, pos, 1, 'ROW_' || row FROM kr),
ch AS (SELECT user_id, bar, tick, unnest([0, 1, 2, 3]) AS lane, unnest([row[1], row[2], row[3], row[4]]) AS d FROM kr),
st AS (SELECT w.user_id, w.n, i AS lane, arg_max(d, tick) AS d FROM w CROSS JOIN range(4) f(i) LEFT JOIN ch ON ch.user_id = w.user_id AND ch.lane = i AND d IN ('2', '4') AND ch.bar < w.start GROUP BY ALL),
ro AS (SELECT user_id, n, string_agg(CASE WHEN d = '2' THEN '3' ELSE '0' END, '' ORDER BY lane) AS row FROM st GROUP BY ALL)"""
)
SQL = {
    "stitched_tokens": f"WITH {_KEPT} SELECT user_id, string_agg(tok, ' ' ORDER BY bar, pos, k) AS tokens FROM tk GROUP BY ALL",
    "stitch_missing": f"WITH {_KEPT}, b AS (SELECT user_id, n, start + given AS fin, unnest(range(keep_start, keep_end)) AS bar FROM em) SELECT user_id, n, bar FROM b WHERE bar >= fin",
    "replayed_rows": f"WITH {_KEPT} SELECT user_id, n, row FROM ro",
    "context_prompts": f"WITH {_KEPT}, c AS (SELECT w.user_id, w.n, string_agg(tok, ' ' ORDER BY bar, pos, k) AS t FROM w JOIN tk ON tk.user_id = w.user_id AND bar >= start AND bar < keep_start GROUP BY ALL) SELECT ro.user_id, ro.n, '<BOS> ROW_' || row || ' ' || t AS prompt FROM ro LEFT JOIN c USING (user_id, n)",
    "decode_notes": f"""WITH {_L}, q AS (SELECT user_id, n, start * 24 AS a, (start + 16) * 24 AS b FROM w),
h0 AS (SELECT user_id, lane, code, tick AS s, lead(tick) OVER (PARTITION BY user_id, lane ORDER BY tick) AS e FROM l WHERE code <> 1), h AS (SELECT * FROM h0 WHERE code = 2),
v AS (SELECT q.user_id, n, lane, greatest(s, a) AS tick, least(coalesce(e, b), b) AS fin, nullif(concat_ws(',', CASE WHEN s < a THEN 'missing_hold_head' END, CASE WHEN e IS NULL OR e >= b THEN 'missing_hold_tail' END), '') AS issue FROM q JOIN h ON h.user_id = q.user_id AND s < b AND (e IS NULL OR e >= a))
SELECT q.user_id, n, tick, lane, 'tap' AS kind, NULL::BIGINT AS "end", NULL::VARCHAR AS issue FROM q JOIN l ON l.user_id = q.user_id AND code = 1 AND tick >= a AND tick < b
UNION ALL SELECT user_id, n, tick, lane, CASE WHEN fin > tick THEN 'hold' END, CASE WHEN fin > tick THEN fin END, issue FROM v WHERE fin > tick OR issue IS NOT NULL""",
}


def _rejects_sql() -> str:
    from .sequences import _TOK

    return f"""WITH {_TOK}, t0 AS (SELECT user_id, list(tok ORDER BY i) AS t FROM tk GROUP BY ALL), t1 AS (SELECT user_id, t, list_position(list_transform(t, lambda v: v LIKE 'ROW%'), true) AS f FROM t0),
t2 AS (SELECT user_id, CASE user_id % 6 WHEN 1 THEN t[:f - 1] || t[f + 1:] WHEN 2 THEN ['POS_1'] || t WHEN 3 THEN t[:f] || t[f - 1:f] || t[f + 1:] WHEN 4 THEN t[:1] || ['POS_x'] || t ELSE t END AS t FROM t1),
u AS (SELECT user_id, unnest(t) AS tok, unnest(range(len(t))) AS i FROM t2),
b AS (SELECT *, count(*) FILTER (WHERE tok = 'BAR') OVER w - 1 AS bar, lag(tok) OVER w AS prev, CASE WHEN regexp_full_match(tok, 'POS_[0-9]+') THEN tok END AS pos FROM u WINDOW w AS (PARTITION BY user_id ORDER BY i)),
d AS (SELECT *, row_number() OVER (PARTITION BY user_id, bar, pos ORDER BY i) AS nth FROM b),
bad AS (SELECT user_id, i, CASE WHEN NOT regexp_full_match(tok, 'BAR|POS_[0-9]+|ROW_[0-4]{{4}}') THEN 'unexpected token' WHEN pos IS NOT NULL AND bar < 0 THEN 'position before a bar' WHEN regexp_full_match(prev, 'POS_[0-9]+') AND (pos IS NOT NULL OR tok = 'BAR') THEN 'position without a row' WHEN pos IS NOT NULL AND nth > 1 THEN 'repeated position' WHEN tok LIKE 'ROW%' AND NOT coalesce(regexp_full_match(prev, 'POS_[0-9]+'), false) THEN 'row without a position' END AS reason FROM d),
c AS (SELECT user_id, i, unnest([0, 1, 2, 3]) AS lane, unnest([tok[5], tok[6], tok[7], tok[8]]) AS g FROM d WHERE tok LIKE 'ROW%' AND regexp_full_match(prev, 'POS_[0-9]+')),
h AS (SELECT *, last_value(CASE WHEN g IN ('2', '4') THEN g END IGNORE NULLS) OVER (PARTITION BY user_id, lane ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM c),
everything AS (SELECT user_id, i, reason FROM bad WHERE reason IS NOT NULL UNION ALL SELECT user_id, i, 'lane state' FROM h WHERE coalesce(was = '2', false) <> (g IN ('3', '4')) UNION ALL SELECT user_id, -1, 'initial row' FROM t2 WHERE user_id % 12 = 5)
SELECT user_id, i, reason FROM everything QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i, reason) = 1"""


SQL["decode_rejects"] = _rejects_sql()
QUERIES = {f.__name__: f for f in (stitched_tokens, stitch_missing, replayed_rows, context_prompts, decode_notes, decode_rejects)}
