"""Time grids over events: signups of a user are tempo segments, the other events are points on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.functions import scalars
from chronolane.operators import timeline

from .base import EVENTS, events, rounded, table

DAY = 86_400_000.0


def _segments(spark, sf_dir) -> DataFrame:
    """A segment at each signup: its beat is between one and four hours."""
    rows = events(spark, sf_dir).filter("event_type = 'signup'")
    return rows.groupBy("user_id", "ms").agg(F.min("event_id").alias("event_id")).select("user_id", "ms", "event_id", (F.pmod("event_id", F.lit(4)) + 1).alias("hours"), ((F.pmod("event_id", F.lit(4)) + 1) * 3_600_000.0).alias("beat_length"))


_SEG = f"seg AS (SELECT user_id, ms, min(event_id) AS event_id, min(event_id) % 4 + 1 AS hours, (min(event_id) % 4 + 1) * 3600000.0::DOUBLE AS beat_length FROM {EVENTS} WHERE event_type = 'signup' GROUP BY user_id, ms)"


def _points(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).filter("event_type <> 'signup'").select("user_id", "event_id", "ms")


def tempo_asof(spark, sf_dir):
    found = timeline.asof(_points(spark, sf_dir), _segments(spark, sf_dir), "user_id", "ms", "ms", ["hours"])
    return found.filter("hours IS NOT NULL")


def segment_durations(spark, sf_dir):
    rows = _segments(spark, sf_dir)
    last = rows.groupBy("user_id").agg(F.max("ms").alias("end"))
    return rounded(timeline.segment_durations(rows.join(last, "user_id"), "user_id", "ms", F.col("end") * 0, F.col("end") + DAY).filter("section > 0").select("user_id", "ms", "section", "duration"))


def dominant_segment(spark, sf_dir):
    rows = _segments(spark, sf_dir)
    last = rows.groupBy("user_id").agg(F.max("ms").alias("end"))
    timed = timeline.segment_durations(rows.join(last, "user_id"), "user_id", "ms", F.col("end") - 20 * DAY, F.col("end") + DAY)
    return rounded(timeline.dominant(timed, "user_id", "hours", "duration", "ms"))


def timing_summary(spark, sf_dir):
    out = timeline.timing_summary(_segments(spark, sf_dir).withColumn("bpm", 60000.0 / F.col("beat_length") * 1000), "user_id", "ms", "bpm", "hours")
    return out.select("user_id", "segments", F.array_join(F.transform("bpms", lambda x: F.format_string("%.2f", x)), ",").alias("bpms"), F.array_join("meters", ",").alias("meters"), "constant_bpm", "constant_meter")


def _beats(spark, sf_dir) -> DataFrame:
    """Times from the user's first signup on, so that the back extension stays short."""
    rows = _segments(spark, sf_dir)
    first = rows.groupBy("user_id").agg((F.min("ms") - 5_400_000).alias("zero"), F.max("ms").alias("last"))
    local = rows.join(first, "user_id").withColumn("t", (F.col("ms") - F.col("zero")).cast("double")).withColumn("end", (F.col("last") - F.col("zero")).cast("double") + DAY)
    return timeline.beat_grid(local, "user_id", "t", "beat_length", F.col("end"))


def beat_grid(spark, sf_dir):
    return rounded(_beats(spark, sf_dir))


def beat_phase(spark, sf_dir):
    first = _segments(spark, sf_dir).groupBy("user_id").agg((F.min("ms") - 5_400_000).alias("zero"))
    points = _points(spark, sf_dir).join(first, "user_id").select("user_id", "event_id", (F.col("ms") - F.col("zero")).cast("double").alias("t"))
    return rounded(timeline.phase(points, _beats(spark, sf_dir), "user_id", "t").filter("beat IS NOT NULL"))


def tick_quantize(spark, sf_dir):
    q = scalars.quantize_error(F.col("ms").cast("double"), F.lit(0.0), F.lit(120.0))
    rows = _points(spark, sf_dir).withColumn("ms", F.pmod("ms", F.lit(100000))).withColumn("q", q).withColumn("tick", F.col("q.tick"))
    return rounded(rows.select("event_id", "tick", scalars.split_tick(F.col("tick"))["bar"].alias("bar"), scalars.split_tick(F.col("tick"))["pos"].alias("pos"), scalars.snap_denominator(F.col("tick")).alias("snap"), F.col("q.error").alias("error"), F.col("q.exact").alias("exact")))


def quantize_bands(spark, sf_dir):
    q = scalars.quantize_error(F.col("ms").cast("double"), F.lit(0.0), F.lit(150.0))
    rows = _points(spark, sf_dir).withColumn("ms", F.pmod("ms", F.lit(100000))).withColumn("q", q)
    out = timeline.quantization(rows, scalars.bpm_band(F.pmod("user_id", F.lit(100)) + 100), F.pmod("q.tick", F.lit(48)), F.col("q.error"), F.col("q.exact"), [0.0, 0.5, 1.0, 2.0, 3.0])
    return rounded(out.select("band", "total", "n", "mean", "mean_abs", "std", "n_exact", "snap_1", "snap_2", "snap_3", "snap_4", "snap_16", "bin_0", "bin_1", "bin_2", "bin_3", "bin_4"))


def canonical_bpm(spark, sf_dir):
    c = scalars.canonical_bpm(F.col("p_retailprice") / 10)
    return rounded(table(spark, sf_dir, "part").select("p_partkey", c["bpm"].alias("bpm"), c["exponent"].alias("exponent")))


def density_window(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_type", "ms")
    marks = rows.filter("event_type = 'purchase'").select("user_id", "ms").distinct()
    return timeline.density(rows.filter("event_type = 'view'"), marks, "user_id", "ms", 3_600_000, 3_599_999)


def _series(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).filter("event_type = 'view'").groupBy("user_id", "ms").agg(F.max("value").alias("value"))


def resample(spark, sf_dir):
    marks = events(spark, sf_dir).filter("event_type = 'purchase'").select("user_id", "ms").distinct()
    return rounded(timeline.resample(_series(spark, sf_dir), marks, "user_id", "ms", "value").filter("value IS NOT NULL"), 4)


def step_integral(spark, sf_dir):
    marks = events(spark, sf_dir).filter("event_type = 'purchase'").select("user_id", "ms").distinct()
    return rounded(timeline.step_integral(_series(spark, sf_dir), marks, "user_id", "ms", "value", 3_600_000.0), 4)


def anchors(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy("user_id", "ms").agg(F.count("*").alias("n"))
    return timeline.isolated_anchors(rows, "user_id", "ms", 3_600_000, 12).select("user_id", "ms")


def _intervals(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select("user_id", "event_type", "event_id", F.col("ms").alias("start"), (F.col("ms") + (F.col("value") * 60_000).cast("long")).alias("end"))


def interval_union(spark, sf_dir):
    return timeline.interval_union(_intervals(spark, sf_dir), ["user_id", "event_type"], "start", "end")


def interval_amount(spark, sf_dir):
    return timeline.interval_amount(_intervals(spark, sf_dir), ["user_id", "event_type"], "start", "end", "event_id")


def pattern_share(spark, sf_dir):
    rows = _intervals(spark, sf_dir)
    durations = rows.groupBy("user_id").agg((F.max("end") - F.min("start")).alias("duration"))
    return rounded(timeline.pattern_share(rows, "user_id", "event_type", "start", "end", durations, "duration", ["view", "signup", "purchase", "click", "error", "absent"]))


_LOCAL = f"""WITH {_SEG}, z AS (SELECT user_id, min(ms) - 5400000 AS zero, max(ms) AS last FROM seg GROUP BY ALL),
s AS (SELECT seg.*, (ms - zero)::DOUBLE AS t, (last - zero)::DOUBLE + 86400000.0 AS fin, row_number() OVER w - 1 AS section, lead((ms - zero)::DOUBLE) OVER w AS nxt FROM seg JOIN z USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY ms)),
e AS (SELECT *, least(coalesce(nxt, fin), fin) AS stop FROM s),
f AS (SELECT *, CASE WHEN section = 0 THEN -CAST(ceil((t - 1e-6) / beat_length) AS BIGINT) ELSE 0 END AS k0, CASE WHEN abs((stop - t) / beat_length - round_even((stop - t) / beat_length, 0)) * beat_length <= 1e-6 THEN round_even((stop - t) / beat_length, 0) ELSE ceil((stop - t) / beat_length) END - 1 AS k1 FROM e),
g AS (SELECT user_id, section, unnest(range(k0, CAST(k1 AS BIGINT) + 1)) AS k, t, beat_length, stop FROM f WHERE k1 >= k0),
b AS (SELECT user_id, section, k, row_number() OVER (PARTITION BY user_id ORDER BY section, k) - 1 AS beat, t + k * beat_length AS start, beat_length AS nominal, least(beat_length, stop - (t + k * beat_length)) AS actual FROM g)
"""
_IV = f"(SELECT user_id, event_type, event_id, ms AS start, ms + CAST(trunc(value * 60000) AS BIGINT) AS fin FROM {EVENTS})"
_UNION = f"""WITH i AS (SELECT * FROM {_IV} WHERE fin > start), r AS (SELECT *, max(fin) OVER (PARTITION BY user_id, event_type ORDER BY start, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY start, fin ROWS UNBOUNDED PRECEDING) AS island FROM r),
u AS (SELECT user_id, event_type, CAST(sum(l) AS BIGINT) AS length FROM (SELECT user_id, event_type, island, max(fin) - min(start) AS l FROM n GROUP BY ALL) GROUP BY ALL)
"""
_Q = "(SELECT event_id, user_id, CAST(ms % 100000 AS DOUBLE) AS ms FROM " + EVENTS + " WHERE event_type <> 'signup')"
_SER = f"ser AS (SELECT user_id, ms::DOUBLE AS t, max(value) AS v FROM {EVENTS} WHERE event_type = 'view' GROUP BY user_id, ms), mk AS (SELECT DISTINCT user_id, ms FROM {EVENTS} WHERE event_type = 'purchase')"
_ANC = f"""o AS (SELECT DISTINCT user_id, ms FROM {EVENTS}), a AS (SELECT *, lag(ms) OVER w AS p, lead(ms) OVER w AS q FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ms)),
k AS (SELECT user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM a WHERE coalesce(ms - p, 3600000) >= 3600000 AND coalesce(q - ms, 3600000) >= 3600000)"""
SQL = {
    "tempo_asof": f"WITH {_SEG}, p AS (SELECT user_id, event_id, ms FROM {EVENTS} WHERE event_type <> 'signup'), j AS (SELECT p.*, s.hours FROM p ASOF LEFT JOIN seg s ON p.user_id = s.user_id AND p.ms >= s.ms) SELECT j.user_id, event_id, j.ms, coalesce(j.hours, f.hours) AS hours FROM j JOIN (SELECT user_id, min_by(hours, ms) AS hours FROM seg GROUP BY ALL) f ON f.user_id = j.user_id",
    "segment_durations": f"WITH {_SEG}, l AS (SELECT user_id, max(ms) AS fin FROM seg GROUP BY ALL), s AS (SELECT user_id, ms, row_number() OVER w - 1 AS section, lead(ms) OVER w AS nxt FROM seg WINDOW w AS (PARTITION BY user_id ORDER BY ms)) SELECT user_id, ms, section, (coalesce(nxt, fin + 86400000) - ms)::DOUBLE AS duration FROM s JOIN l USING (user_id) WHERE section > 0",
    "dominant_segment": f"""WITH {_SEG}, l AS (SELECT user_id, max(ms) AS fin FROM seg GROUP BY ALL),
s AS (SELECT seg.user_id, ms, hours, fin, row_number() OVER w - 1 AS section, lead(ms) OVER w AS nxt FROM seg JOIN l USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY ms)),
d AS (SELECT user_id, hours, ms, greatest(0, least(coalesce(nxt, fin + 86400000), fin + 86400000) - CASE WHEN section = 0 THEN fin - 20 * 86400000 ELSE greatest(ms, fin - 20 * 86400000) END)::DOUBLE AS d FROM s),
g AS (SELECT user_id, hours, sum(d) AS duration, min(ms) AS first FROM d GROUP BY ALL)
SELECT user_id, hours, duration FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY duration DESC, first) = 1""",
    "timing_summary": f"""WITH {_SEG}, f AS (SELECT user_id, hours, min(ms) AS first, count(*) AS n FROM seg GROUP BY ALL)
SELECT user_id, CAST(sum(n) AS BIGINT) AS segments, string_agg(printf('%.2f', 60000.0 / (hours * 3600000.0) * 1000), ',' ORDER BY first) AS bpms, string_agg(CAST(hours AS VARCHAR), ',' ORDER BY first) AS meters, count(*) = 1 AS constant_bpm, count(*) = 1 AS constant_meter FROM f GROUP BY ALL""",
    "beat_grid": _LOCAL + "SELECT user_id, section, k, beat, round(start, 6) AS start, round(nominal, 6) AS nominal, round(actual, 6) AS actual, nominal - actual > 1e-6 AS residual FROM b",
    "beat_phase": _LOCAL
    + f""", p AS (SELECT e.user_id, event_id, (ms - zero)::DOUBLE AS t FROM {EVENTS} e JOIN z USING (user_id) WHERE event_type <> 'signup'),
j AS (SELECT p.*, b.beat, b.start, b.nominal FROM p ASOF LEFT JOIN b ON p.user_id = b.user_id AND p.t >= b.start), h AS (SELECT user_id, min_by(struct_pack(beat := beat, start := start, nominal := nominal), start) AS s FROM b GROUP BY ALL),
x AS (SELECT user_id, event_id, t, coalesce(beat, h.s.beat) AS beat, coalesce(start, h.s.start) AS start, coalesce(nominal, h.s.nominal) AS nominal FROM j JOIN h USING (user_id))
SELECT user_id, event_id, round(t, 6) AS t, beat, round(greatest(0.0, least(0.9999999999999999, (t - start) / nominal)), 6) AS phase FROM x""",
    "tick_quantize": f"WITH q AS (SELECT event_id, ms, CAST(round_even(ms * 120.0::DOUBLE / 60000 * 48, 0) AS BIGINT) AS tick FROM {_Q}) SELECT event_id, tick, tick // 192 AS bar, tick % 192 AS pos, 48 // gcd(48, tick % 48) AS snap, round(tick * 60000.0::DOUBLE / 120 / 48 - ms, 6) AS error, abs(tick * 60000.0::DOUBLE / 120 / 48 - ms) < 1e-6 AS exact FROM q",
    "quantize_bands": f"""WITH q AS (SELECT (user_id % 100 + 100) // 10 * 10 AS band, CAST(round_even(ms * 150.0::DOUBLE / 60000 * 48, 0) AS BIGINT) AS tick, ms FROM {_Q}), e AS (SELECT band, tick, tick * 60000.0::DOUBLE / 150 / 48 - ms AS x FROM q)
SELECT band, CAST(grouping(band) AS BIGINT) AS total, count(*) AS n, round(avg(x), 6) AS mean, round(avg(abs(x)), 6) AS mean_abs, round(stddev_pop(x), 6) AS std, count(*) FILTER (WHERE abs(x) < 1e-6) AS n_exact, """
    + ", ".join(f"count(*) FILTER (WHERE tick % 48 * {n} % 48 = 0) AS snap_{n}" for n in (1, 2, 3, 4, 16))
    + ", "
    + ", ".join(f"count(*) FILTER (WHERE abs(x) >= {a} AND abs(x) < {b}) AS bin_{i}" for i, (a, b) in enumerate(((0, 0.5), (0.5, 1), (1, 2), (2, 3), (3, 1e300))))
    + " FROM e GROUP BY ROLLUP (band)",
    "canonical_bpm": "SELECT p_partkey, round(p_retailprice / 10 * pow(2, -floor(log2(p_retailprice / 10 / 120))), 6) AS bpm, CAST(-floor(log2(p_retailprice / 10 / 120)) AS BIGINT) AS exponent FROM part",
    "density_window": f"WITH mk AS (SELECT DISTINCT user_id, ms FROM {EVENTS} WHERE event_type = 'purchase'), v AS (SELECT user_id, ms FROM {EVENTS} WHERE event_type = 'view') SELECT mk.user_id, mk.ms, count(v.ms) AS n FROM mk LEFT JOIN v ON v.user_id = mk.user_id AND v.ms BETWEEN mk.ms - 3600000 AND mk.ms + 3599999 GROUP BY ALL",
    "resample": f"""WITH {_SER}, m AS (SELECT user_id, ms::DOUBLE AS t FROM mk), a AS (SELECT m.user_id, m.t, s.t AS pt, s.v AS pv FROM m ASOF LEFT JOIN ser s ON m.user_id = s.user_id AND m.t >= s.t), b AS (SELECT a.*, s.t AS qt, s.v AS qv FROM a ASOF LEFT JOIN ser s ON a.user_id = s.user_id AND a.t <= s.t)
SELECT user_id, t AS ms, round(CASE WHEN pt IS NULL THEN qv WHEN qt IS NULL OR qt = pt THEN pv ELSE pv + (t - pt) / (qt - pt) * (qv - pv) END, 4) AS value FROM b WHERE pt IS NOT NULL OR qt IS NOT NULL""",
    "step_integral": f"""WITH {_SER}, st AS (SELECT user_id, t, v, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), 1e18) AS nt FROM ser)
SELECT mk.user_id, mk.ms::DOUBLE AS ms, round(coalesce(sum(greatest(0, least(nt, mk.ms + 3600000.0) - greatest(t, mk.ms - 3600000.0)) * v), 0) / 7200000.0, 4) AS mean FROM mk LEFT JOIN st ON st.user_id = mk.user_id AND nt > mk.ms - 3600000.0 AND t < mk.ms + 3600000.0 GROUP BY ALL""",
    "anchors": f"WITH {_ANC}, j AS (SELECT unnest(range(12)) AS j) SELECT DISTINCT user_id, ms FROM k, j WHERE n <= 12 OR i = (j * (n - 1)) // 11",
    "interval_union": _UNION + "SELECT * FROM u",
    "interval_amount": f"WITH r AS (SELECT *, max(fin) OVER (PARTITION BY user_id, event_type ORDER BY start, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {_IV}) SELECT user_id, event_type, CAST(sum(fin - start) AS BIGINT) AS amount FROM r WHERE reach IS NULL OR fin > reach GROUP BY ALL",
    "pattern_share": _UNION + f", d AS (SELECT user_id, max(fin) - min(start) AS duration FROM {_IV} GROUP BY ALL) SELECT user_id, event_type, CASE WHEN duration > 0 THEN round(least(1.0::DOUBLE, coalesce(length, 0) / duration), 6) END AS share FROM d CROSS JOIN (VALUES ('view'), ('signup'), ('purchase'), ('click'), ('error'), ('absent')) k(event_type) LEFT JOIN u USING (user_id, event_type)",
}

QUERIES = {
    f.__name__: f
    for f in (
        tempo_asof, segment_durations, dominant_segment, timing_summary, beat_grid, beat_phase, tick_quantize, quantize_bands, canonical_bpm,
        density_window, resample, step_integral, anchors, interval_union, interval_amount, pattern_share,
    )
}
