"""Queries of gates, onsets and totals over the supplied tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolane.operators import gates, onsets, stats, tokens

from .base import EVENTS, bootstrap_sql, events, rounded, table
from .sequences import _P, _R, _placed, _rows


def eligibility(spark, sf_dir):
    size, price = F.col("p_size"), F.col("p_retailprice")
    reason = gates.eligibility_reason(size % 11, size % 7 > 0, size % 5 > 0, F.when(size % 3 == 0, 3).otherwise(4), F.floor(price) % 13, price < 1700)
    return table(spark, sf_dir, "part").select("p_partkey", reason.alias("reason"))


def gate_order(spark, sf_dir):
    k = F.col("o_orderkey")
    reason = gates.gate_reason(F.when(k % 17 == 0, "not_4k"), k % 13, F.when(k % 11 == 0, "beat length"), k % 7 > 0, k % 5 == 0, k % 3 > 0, F.when(F.col("o_totalprice") > 200000, "outside_audio"))
    return table(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"))


def audio_range(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("t", F.col("ms") % 86400000 - F.col("user_id") * 1000)
    lengths = rows.groupBy("user_id").agg((F.max("ms") % 86400000).alias("length"))
    return rounded(gates.outside_audio(rows, lengths, "user_id", "t", "length"))


def hold_checks(spark, sf_dir):
    rows = _placed(spark, sf_dir).withColumn("hold", F.when(F.col("kind") != "tap", F.floor(F.col("event_id") / 7)))
    return rounded(gates.hold_checks(rows, ["user_id"], "lane", "tick", "kind", "hold"))


def set_mismatch(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat_ws(" ", F.col("doc_id").cast("string"), "source")).otherwise(F.concat_ws(" ", F.lit("x"), "source")).alias("folder"), (F.col("doc_id") - F.col("doc_id") % 3).alias("declared"))
    return gates.set_id_mismatch(rows, "folder", "declared").select("doc_id", "declared", "folder_id")


def shared_work(spark, sf_dir):
    work = lambda keys: keys.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_nationkey", F.sha2("n_name", 256).alias("digest"))
    return rounded(gates.shared_work(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", work))


def isolated_fields(spark, sf_dir):
    return rounded(table(spark, sf_dir, "part").select("p_partkey", *gates.isolated(["size", "price", "length"], "price", F.col("p_retailprice"))))


def metric_records(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "unconstrained").otherwise("constrained").alias("mode"), F.when(F.col("o_orderstatus") == "F", "valid").when(F.col("o_orderstatus") == "O", "invalid").alias("validity"))
    return rows.filter(gates.enters_metrics(F.col("mode"), F.col("validity"))).select("o_orderkey")


def scenario_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") == 1, "full").when(F.col("l_linenumber") == 2, "random").otherwise("other").alias("scenario"), "l_quantity", "l_tax", F.when(F.col("l_orderkey") % 5 == 0, F.col("l_orderkey")).otherwise(F.col("l_suppkey")).alias("donor"))
    return rounded(gates.scenario_pairs(rows, "l_orderkey", "scenario", ("full", "random"), "donor", ["l_quantity", "l_tax"]))


def next_reference(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("day", F.floor(F.col("ms") / 86400000)).withColumn("second", F.floor(F.col("ms") % 86400000 / 1000))
    return rounded(gates.next_reference(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), "user_id", "day", "second", "event_id"))


#: Milliseconds of a frame here: a minute, for events that are hours apart.
_FRAME = 60000.0


def frame_targets(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("t", (F.col("ms") % 86400000).cast("double"))
    spans = rows.groupBy("user_id").agg((F.min("user_id") % 100).alias("low"), F.lit(1300).alias("frames"))
    return rounded(onsets.frame_targets(rows.select("user_id", "t"), spans, "user_id", "t", "low", "frames", _FRAME))


def _scored_frames(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("probability"), (F.col("l_discount") * 10).alias("made"), (F.col("l_tax") * 10).alias("wanted"), (F.col("l_linenumber") < 4).alias("present"), (F.col("l_suppkey") % 5 == 0).alias("silent"))


def threshold_onsets(spark, sf_dir):
    return rounded(onsets.threshold_onsets(_scored_frames(spark, sf_dir), "l_suppkey", F.col("l_orderkey") * 8 + F.col("l_linenumber"), "probability", "made", 0.9, 11.61))


def onset_errors(spark, sf_dir):
    return rounded(onsets.onset_errors(_scored_frames(spark, sf_dir), "l_suppkey", "present", "silent", "probability", "made", "wanted", 0.9, 11.61))


def atomic_counts(spark, sf_dir):
    rows = _placed(spark, sf_dir)
    notes = rows.filter("kind <> 'end'").withColumn("duration", F.when(F.col("kind") == "start", F.floor("value")))
    return rounded(stats.atomic_counts(rows, notes, _rows(spark, sf_dir), "pos", "lane", "kind", "duration", "row"))


def marginal_totals(spark, sf_dir):
    rows = _placed(spark, sf_dir)
    counts = rows.groupBy("lane", "kind", "pos").agg(F.count("*").alias("n"))
    return rounded(stats.with_totals(stats.marginals(counts, ["lane", "kind"], "pos", "n"), "n", rows.select("user_id").distinct().count(), rows.count()))


def match_distributions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey", F.floor("l_quantity").alias("tp"), F.floor(F.col("l_discount") * 100).alias("fp"), F.floor(F.col("l_tax") * 100).alias("fn"))
    return rounded(stats.match_distributions(rows, ["l_returnflag"], "l_suppkey"))


def plausibility_summary(spark, sf_dir):
    notes = events(spark, sf_dir).select("user_id", F.pmod("event_id", F.lit(3)).alias("seed"), "lane", F.floor(F.col("ms") / 60000).alias("t"), F.lit(None).cast("long").alias("fin"))
    flagged = tokens.plausibility(notes.distinct(), ["user_id", "seed", "lane"], "t", "fin")
    flags = ["concurrent", "almost"]
    samples = flagged.groupBy("user_id", "seed").agg(*[F.count_if(f).alias(f) for f in flags], F.count("*").alias("notes"))
    return rounded(stats.plausibility_summary(samples, ["seed"], "user_id", flags, "notes"))


def row_states(spark, sf_dir):
    return rounded(stats.row_states(_rows(spark, sf_dir), "row", {"1": "tap", "2": "start", "3": "active", "4": "end"}))


def power_means(spark, sf_dir):
    return rounded(stats.weighted_power_mean(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", 4.0), 4)


def timing_report(spark, sf_dir):
    charts = events(spark, sf_dir).groupBy("user_id").agg((F.count_distinct("event_type") - 3).alias("segments"), F.avg("value").alias("tempo"), F.when(F.min("event_id") % 6 == 0, "bad").alias("error"))
    return rounded(stats.timing_report(charts, "segments", "tempo", "error"))


_RATIO = "CASE WHEN {1} > 0 THEN {0} / ({1})::DOUBLE ELSE 0 END"
_DESC = "count({0}) AS {1}_count, round(avg({0}), 6) AS {1}_mean, round(quantile_cont({0}, 0.1), 6) AS {1}_p10, round(quantile_cont({0}, 0.5), 6) AS {1}_p50, round(quantile_cont({0}, 0.9), 6) AS {1}_p90, round(min({0}), 6) AS {1}_min, round(max({0}), 6) AS {1}_max"
SQL = {
    "eligibility": "SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN 'no_timing' WHEN p_size % 7 = 0 THEN 'variable_bpm' WHEN p_size % 5 = 0 THEN 'variable_meter' WHEN p_size % 3 = 0 THEN 'meter_not_4' WHEN floor(p_retailprice)::BIGINT % 13 = 0 THEN 'no_notes' WHEN p_retailprice >= 1700 THEN 'invalid_grid' END AS reason FROM part",
    "gate_order": "SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'not_4k' WHEN o_orderkey % 13 = 0 THEN 'no_notes' WHEN o_orderkey % 11 = 0 THEN 'beat length' WHEN o_orderkey % 7 = 0 THEN 'missing_audio' WHEN o_orderkey % 5 = 0 THEN 'spliced_timeline' WHEN o_orderkey % 3 = 0 THEN 'decode_failed' WHEN o_totalprice > 200000 THEN 'outside_audio' END AS reason FROM orders",
    "audio_range": f"WITH e AS (SELECT user_id, ms % 86400000 - user_id * 1000 AS t, max(ms) OVER (PARTITION BY user_id) % 86400000 AS length FROM {EVENTS}) SELECT user_id, count(*) AS outside FROM e WHERE t < 0 OR t >= length GROUP BY ALL",
    "hold_checks": f"WITH {_P}, h AS (SELECT user_id, event_id // 7 AS hold, min(tick) FILTER (WHERE kind = 'start') AS head, max(tick) FILTER (WHERE kind = 'end') AS tail FROM p WHERE kind <> 'tap' GROUP BY ALL), r AS (SELECT user_id, CASE WHEN head IS NULL OR tail IS NULL THEN 'incomplete_hold' WHEN tail <= head THEN 'hold_not_after_head' END AS reason FROM h UNION ALL SELECT user_id, 'duplicate_endpoint' FROM p WHERE kind <> 'end' GROUP BY user_id, lane, tick HAVING count(*) > 1) SELECT user_id, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL",
    "set_mismatch": "SELECT doc_id, doc_id - doc_id % 3 AS declared, doc_id AS folder_id FROM documents WHERE doc_id % 4 = 0 AND doc_id % 3 > 0 AND doc_id - doc_id % 3 > 0",
    "shared_work": "SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, sha256(n_name) AS digest FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "isolated_fields": "SELECT p_partkey, NULL::DOUBLE AS size, p_retailprice AS price, NULL::DOUBLE AS length FROM part",
    "metric_records": "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 > 0 AND o_orderstatus = 'F'",
    "scenario_pairs": "WITH s AS (SELECT l_orderkey, "
    + ", ".join(f"max({v}) FILTER (WHERE l_linenumber = {k}) AS {v}_{x}" for v in ("l_quantity", "l_tax") for k, x in ((1, "a"), (2, "b")))
    + ", max(CASE WHEN l_orderkey % 5 = 0 THEN l_orderkey ELSE l_suppkey END) FILTER (WHERE l_linenumber = 2) AS donor FROM lineitem GROUP BY ALL) SELECT * EXCLUDE (donor), donor = l_orderkey AS self_draw FROM s WHERE l_quantity_a IS NOT NULL AND l_quantity_b IS NOT NULL",
    "next_reference": f"WITH e AS (SELECT user_id, event_id, ms // 86400000 AS day, ms % 86400000 // 1000 AS second FROM {EVENTS}), c AS (SELECT *, lag(second) OVER (PARTITION BY user_id, day ORDER BY second, event_id) AS prior FROM e WHERE event_id % 2 = 0), r AS (SELECT DISTINCT user_id, day, second AS place FROM e WHERE event_id % 2 = 1) SELECT c.user_id, c.day, c.second, c.event_id, min(place) FILTER (WHERE place >= second) AS next_position, count(place) FILTER (WHERE place < second AND (prior IS NULL OR place >= prior)) AS skipped FROM c LEFT JOIN r ON c.user_id = r.user_id AND c.day = r.day GROUP BY ALL",
    "frame_targets": f"WITH e AS (SELECT user_id, (ms % 86400000) / 60000.0::DOUBLE AS q FROM {EVENTS}), f AS (SELECT user_id, CAST(floor(q) AS BIGINT) - user_id % 100 AS frame, min(q - floor(q)) AS fraction, count(*) AS n FROM e GROUP BY ALL) SELECT user_id, frame, round(fraction, 6) AS fraction, CASE WHEN frame < 0 OR frame >= 1300 THEN 'outside' WHEN n > 1 THEN 'collision' END AS reject FROM f",
    "threshold_onsets": "SELECT l_suppkey, round((l_orderkey * 8 + l_linenumber + l_discount * 10) * 11.61::DOUBLE, 6) AS t FROM lineitem WHERE l_quantity / 50 >= 0.9",
    "onset_errors": "WITH f AS (SELECT l_suppkey, l_suppkey % 5 = 0 AS silent, l_quantity / 50 >= 0.9 AS hit, CASE WHEN l_linenumber < 4 AND l_suppkey % 5 > 0 THEN abs(l_discount * 10 - l_tax * 10) * 11.61::DOUBLE END AS e FROM lineitem) SELECT l_suppkey, silent, count(*) FILTER (WHERE hit) AS onsets, round(avg(e), 6) AS mae_ms, round(quantile_cont(e, 0.95), 6) AS p95_ms, CASE WHEN silent THEN round(count(*) FILTER (WHERE hit) / (count(*) * 11.61::DOUBLE / 60000), 6) END AS false_per_minute FROM f GROUP BY l_suppkey, silent",
    "atomic_counts": f"WITH {_R} SELECT 'tick' AS statistic, CAST(lane AS VARCHAR) AS lane, CAST(pos AS VARCHAR) AS key, kind, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT 'note', CAST(lane AS VARCHAR), NULL, CASE WHEN kind = 'tap' THEN 'tap' ELSE 'hold' END, count(*) FROM p WHERE kind <> 'end' GROUP BY lane, kind UNION ALL SELECT 'hold', CAST(lane AS VARCHAR), CAST(floor(value)::BIGINT AS VARCHAR), 'hold', count(*) FROM p WHERE kind = 'start' GROUP BY lane, floor(value)::BIGINT UNION ALL SELECT 'row', NULL, row, NULL, count(*) FROM r GROUP BY row",
    "marginal_totals": f"WITH {_P} SELECT coalesce(CAST(lane AS VARCHAR), 'all') AS lane, coalesce(kind, 'all') AS kind, pos, count(*) AS n, round(count(*) / (SELECT count(DISTINCT user_id) FROM p), 6) AS avg_count, round(count(*) / (SELECT count(*) FROM p), 6) AS pooled FROM p GROUP BY GROUPING SETS ((lane, kind, pos), (kind, pos), (lane, pos), (pos))",
    "match_distributions": f"WITH x AS (SELECT l_returnflag, l_suppkey, CAST(floor(l_quantity) AS BIGINT) AS tp, CAST(floor(l_discount * 100) AS BIGINT) AS fp, CAST(floor(l_tax * 100) AS BIGINT) AS fn FROM lineitem), f AS (SELECT *, {_RATIO.format('2 * tp', '2 * tp + fp + fn')} AS f1 FROM x), c AS (SELECT l_returnflag, l_suppkey, avg(f1) AS f1 FROM f GROUP BY ALL)" + bootstrap_sql("c", "l_returnflag", "l_suppkey", "f1") + f", t AS (SELECT l_returnflag, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, count(DISTINCT l_suppkey) FILTER (WHERE tp + fn > 0) AS charts_with_reference FROM x GROUP BY ALL), sd AS (SELECT l_returnflag, {_DESC.format('f1', 'sample')} FROM f GROUP BY ALL), cd AS (SELECT l_returnflag, {_DESC.format('f1', 'chart')} FROM c GROUP BY ALL) SELECT t.*, round({_RATIO.format('tp', 'tp + fp')}, 6) AS precision, round({_RATIO.format('tp', 'tp + fn')}, 6) AS recall, round({_RATIO.format('2 * tp', '2 * tp + fp + fn')}, 6) AS f1, tp + fn AS reference_support, sd.* EXCLUDE (l_returnflag), cd.* EXCLUDE (l_returnflag), round(m.mean, 6) AS ci_mean, CASE WHEN m.n > 1 THEN round(b.low, 6) END AS ci_low, CASE WHEN m.n > 1 THEN round(b.high, 6) END AS ci_high FROM t JOIN sd USING (l_returnflag) JOIN cd USING (l_returnflag) LEFT JOIN m USING (l_returnflag) LEFT JOIN b USING (l_returnflag)",
    "plausibility_summary": f"WITH n AS (SELECT DISTINCT user_id, event_id % 3 AS seed, lane, ms // 60000 AS t FROM {EVENTS}), g AS (SELECT *, lead(t) OVER (PARTITION BY user_id, seed, lane ORDER BY t) - t AS gap FROM n), s AS (SELECT user_id, seed, count(*) FILTER (WHERE gap <= 2) AS concurrent, count(*) FILTER (WHERE abs(gap) < 10) AS almost, count(*) AS notes FROM g GROUP BY ALL) SELECT seed, CAST(sum(concurrent) AS BIGINT) AS concurrent, CAST(sum(almost) AS BIGINT) AS almost, count(DISTINCT user_id) FILTER (WHERE concurrent > 0) AS charts_with_concurrent, count(DISTINCT user_id) FILTER (WHERE almost > 0) AS charts_with_almost, count(*) FILTER (WHERE notes = 0) AS empty_samples, round(avg((concurrent > 0)::INT), 6) AS rate_concurrent, round(avg((almost > 0)::INT), 6) AS rate_almost FROM s GROUP BY ALL",
    "row_states": f"WITH {_R}, s AS (SELECT unnest(['tap', 'start', 'active', 'end']) AS state, unnest([len(row) - len(replace(row, '1', '')), len(row) - len(replace(row, '2', '')), len(row) - len(replace(row, '3', '')), len(row) - len(replace(row, '4', ''))]) AS n FROM r) SELECT state, CAST(sum(n) AS BIGINT) AS lanes, count(*) FILTER (WHERE n > 0) AS rows, round(avg((n > 0)::INT), 6) AS share FROM s GROUP BY ALL",
    "power_means": "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean, round(pow(sum(pow(l_extendedprice, 4) * l_quantity) / sum(l_quantity), 0.25), 4) AS power_mean FROM lineitem GROUP BY ALL",
    "timing_report": f"WITH c AS (SELECT user_id, count(DISTINCT event_type) - 3 AS segments, avg(value) AS tempo, min(event_id) % 6 = 0 AS bad FROM {EVENTS} GROUP BY ALL), k AS (SELECT *, CASE WHEN bad THEN 'error' WHEN segments = 0 THEN 'none' WHEN segments = 1 THEN 'constant' ELSE 'variable' END AS kind FROM c), l AS (SELECT 'kind' AS section, kind AS key FROM k UNION ALL SELECT 'segments', CAST(segments AS VARCHAR) FROM k WHERE kind = 'variable' UNION ALL SELECT 'tempo', CAST(CAST(round(tempo) AS BIGINT) AS VARCHAR) FROM k WHERE kind = 'constant'), n AS (SELECT section, key, count(*) AS n FROM l GROUP BY ALL) SELECT section, key, n, round(n / sum(n) OVER (PARTITION BY section), 6) AS share FROM n QUALIFY section = 'kind' OR row_number() OVER (PARTITION BY section ORDER BY n DESC, key) <= 8",
}

QUERIES = {
    f.__name__: f
    for f in (
        eligibility, gate_order, audio_range, hold_checks, set_mismatch, shared_work, isolated_fields, metric_records, scenario_pairs, next_reference, frame_targets, threshold_onsets,
        onset_errors, atomic_counts, marginal_totals, match_distributions, plausibility_summary, row_states, power_means, timing_report,
    )
}
