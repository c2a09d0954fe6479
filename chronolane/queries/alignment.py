"""Lag profiles of a user's views around the other events that stand alone, and what they say of a common lag."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolane.operators import lags, timeline

from .base import EVENTS, events, rounded

HOUR = 3_600_000.0
LAGS = [HOUR * h for h in range(-24, 25, 2)]
#: Users have some dozens of events, a day apart.
RULES = lags.LagRules(anchors=12, blocks=5, block_anchors=2, least_blocks=3, draws=64, width=20 * HOUR, contrast=0.1, prominence=0.01, exclusion=3 * HOUR, edge=2 * HOUR)


def _inputs(spark, sf_dir):
    rows = events(spark, sf_dir)
    series = rows.filter("event_type = 'view'").groupBy("user_id", "ms").agg(F.max("value").alias("value"))
    others = rows.filter("event_type <> 'view'").groupBy("user_id", "ms").agg(F.count("*").alias("n"))
    return series, timeline.isolated_anchors(others, "user_id", "ms", HOUR, 1200)


def lag_profile(spark, sf_dir):
    return rounded(lags.lag_profile(*_inputs(spark, sf_dir), "user_id", "ms", "value", LAGS, RULES))


def lag_verdict(spark, sf_dir):
    out = lags.lag_verdict(*_inputs(spark, sf_dir), "user_id", "ms", "value", LAGS, RULES)
    return rounded(out.withColumn("reasons", F.array_join("reasons", ",")), 5)


_PROFILE = f"""WITH ser AS (SELECT user_id, ms::DOUBLE AS t, max(value) AS v FROM {EVENTS} WHERE event_type = 'view' GROUP BY user_id, ms),
o AS (SELECT DISTINCT user_id, ms::DOUBLE AS ms FROM {EVENTS} WHERE event_type <> 'view'), a0 AS (SELECT *, lag(ms) OVER w AS p, lead(ms) OVER w AS q FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ms)),
a1 AS (SELECT user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM a0 WHERE coalesce(ms - p, 3600000) >= 3600000 AND coalesce(q - ms, 3600000) >= 3600000),
a AS (SELECT user_id, ms FROM a1 WHERE n <= 1200 OR i IN (SELECT (j * (n - 1)) // 1199 FROM range(1200) r(j))),
m AS (SELECT user_id, ms AS anchor, h * 3600000.0::DOUBLE AS lag, ms + h * 3600000.0::DOUBLE AS t FROM a, range(-24, 25, 2) r(h)),
i1 AS (SELECT m.*, s.t AS pt, s.v AS pv FROM m ASOF LEFT JOIN ser s ON m.user_id = s.user_id AND m.t >= s.t),
i2 AS (SELECT i1.*, s.t AS qt, s.v AS qv FROM i1 ASOF LEFT JOIN ser s ON i1.user_id = s.user_id AND i1.t <= s.t),
v AS (SELECT user_id, anchor, lag, CASE WHEN pt IS NULL THEN qv WHEN qt IS NULL OR qt = pt THEN pv ELSE pv + (t - pt) / (qt - pt) * (qv - pv) END AS v FROM i2),
s AS (SELECT *, max(v) OVER (PARTITION BY user_id, anchor) AS top FROM v), h AS (SELECT *, min(anchor) OVER (PARTITION BY user_id) AS f, max(anchor) OVER (PARTITION BY user_id) AS l FROM s WHERE top > 2.220446049250313e-16),
pr AS (SELECT user_id, CASE WHEN l > f THEN least(4, floor((anchor - f) / (l - f) * 5)) ELSE 0 END::BIGINT AS block, lag, count(*) AS n, avg(v / top) AS value FROM h GROUP BY ALL)"""
SQL = {
    "lag_profile": _PROFILE + " SELECT user_id, block, lag, n, round(value, 6) AS value FROM pr",
    "lag_verdict": _PROFILE
    + """, al AS (SELECT user_id, count(DISTINCT ms) AS everything FROM a GROUP BY ALL), hd AS (SELECT user_id, sum(n)::BIGINT AS heard FROM pr WHERE lag = 0 GROUP BY ALL),
kb AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY block) - 1 AS place FROM pr WHERE n >= 2), ks AS (SELECT user_id, max(place) + 1 AS k FROM kb GROUP BY ALL),
st AS (SELECT al.user_id, everything, coalesce(heard, 0) AS heard, k, CASE WHEN everything < 12 THEN 'too_few_anchors' WHEN coalesce(heard, 0) < 12 THEN 'too_few_audible_anchors' WHEN coalesce(k, 0) < 3 THEN 'too_few_time_blocks' END AS short FROM al LEFT JOIN hd USING (user_id) LEFT JOIN ks USING (user_id)),
cv AS (SELECT user_id, lag, round(sum(value) / any_value(k), 9) AS c FROM kb JOIN st USING (user_id) WHERE short IS NULL GROUP BY ALL),
bl AS (SELECT user_id, arg_max(lag, struct_pack(c := c, l := -lag)) AS lag, max(c) AS peak, quantile_cont(c, 0.5) AS mid FROM cv GROUP BY ALL),
pm AS (SELECT user_id, max(c) AS other FROM cv JOIN bl USING (user_id) WHERE abs(cv.lag - bl.lag) > 3 * 3600000.0 GROUP BY ALL),
pk AS (SELECT user_id, d, floor(CAST('0x' || substr(md5('1707|' || d || '|' || j), 1, 8) AS UBIGINT) / 4294967296.0::DOUBLE * k) AS place FROM st, range(64) a(d), range(5) b(j) WHERE short IS NULL AND j < k),
dr AS (SELECT user_id, d, lag, round(sum(value) / count(*), 9) AS c FROM pk JOIN kb USING (user_id, place) GROUP BY ALL),
bt AS (SELECT user_id, d, arg_max(lag, struct_pack(c := c, l := -lag)) AS lag FROM dr GROUP BY ALL), ci AS (SELECT user_id, quantile_cont(lag, 0.025) AS low, quantile_cont(lag, 0.975) AS high FROM bt GROUP BY ALL),
al2 AS (SELECT st.*, bl.lag, low, high, peak - mid AS contrast, peak - other AS prominence FROM st LEFT JOIN bl USING (user_id) LEFT JOIN pm USING (user_id) LEFT JOIN ci USING (user_id)),
re AS (SELECT *, CASE WHEN short IS NULL THEN concat_ws(',', CASE WHEN abs(lag) >= 22 * 3600000.0 THEN 'search_edge' END, CASE WHEN contrast < 0.1 THEN 'weak_alignment' END, CASE WHEN prominence < 0.01 THEN 'competing_peak' END, CASE WHEN high - low > 20 * 3600000.0 THEN 'unstable_time_blocks' END) END AS reasons FROM al2)
SELECT user_id, coalesce(short, CASE WHEN reasons = '' THEN 'resolved' ELSE 'unresolved' END) AS status, reasons, CASE WHEN short = 'too_few_anchors' THEN everything ELSE heard END AS anchors, lag, round(low, 5) AS low, round(high, 5) AS high, round(contrast, 5) AS contrast, round(prominence, 5) AS prominence FROM re""",
}
QUERIES = {f.__name__: f for f in (lag_profile, lag_verdict)}
