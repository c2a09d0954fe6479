"""Queries of stored records, artifacts, grids and composite reports over the supplied tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolane.operators import logits, splits, stats, timeline
from chronolane.plans import reports, windows
from chronolane.session import parts_for, scratch_dir
from chronolane.sources import artifacts

from .base import EVENTS, events, rounded, table
from .matching import _F1, _T
from .reporting import RATIOS, _records
from .sequences import _P, _R, _placed, _rows
from .splitting import _POS, _SPLIT
from .timelines import _LOCAL, _beats


def _path(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _text(spark, rows: DataFrame, name: str) -> str:
    """Write (part, place, line) as a text file a part."""
    path = _path(spark, name)
    rows.repartition("part").sortWithinPartitions("part", "place").select("part", "line").write.partitionBy("part").text(path)
    return path


def _segments(spark, rows: DataFrame, name: str) -> str:
    """Write (place, line) in order of place as text files, each behind the one before by place and by name."""
    path = _path(spark, name)
    rows.repartitionByRange(parts_for(spark, rows.count()), "place").sortWithinPartitions("place").select("line").write.text(path)
    return path


def versioned_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 3).alias("part"), "doc_id", "n_chars")
    line = F.when(F.col("doc_id") % 50 == 0, '{"doc_id": oops').otherwise(F.to_json(F.struct("doc_id", "n_chars")))
    heads = spark.range(3).select(F.col("id").alias("part"), F.lit(-1).cast("long").alias("place"), F.when(F.col("id") == 1, '{"kind": "lengths", "version": 1}').otherwise('{"kind": "lengths", "version": 2}').alias("line"))
    path = _text(spark, heads.unionByName(docs.select("part", F.col("doc_id").alias("place"), line.alias("line"))), "versioned")
    return artifacts.read_versioned(spark, f"{path}/*", T.StructType.fromDDL("doc_id long, n_chars long"), "lengths", 2)


def keyed_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 4).alias("version"))
    path = _segments(spark, rows.select(F.col("o_custkey").alias("place"), F.to_json(F.struct("*")).alias("line")), "keyed")
    good, bad = artifacts.read_keyed(spark, path, T.StructType.fromDDL("o_custkey long, o_orderkey long, version long"), "o_custkey", "o_orderkey", F.col("r.version") > 0)
    return good.select("o_custkey", "o_orderkey").unionByName(bad.agg(F.lit(-1).cast("long").alias("o_custkey"), F.count("*").alias("o_orderkey")))


def journal_files(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    path = _segments(spark, rows.select(F.col("o_orderkey").alias("place"), F.to_json(F.struct("*")).alias("line")), "journal")
    return artifacts.read_journal(spark, path, T.StructType.fromDDL("o_custkey long, o_orderkey long, o_orderstatus string"), ["o_custkey"])


def frozen_rows(spark, sf_dir):
    rows, path = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("long").alias("toxic")), _path(spark, "frozen")
    artifacts.freeze(rows, path)
    return artifacts.freeze(rows.orderBy(F.desc("doc_id")), path)


def report_csv(spark, sf_dir):
    path = _path(spark, "report")
    artifacts.write_report(stats.rates(table(spark, sf_dir, "orders"), ["o_orderpriority"], {"large": F.col("o_totalprice") > 200000}), path)
    return rounded(spark.read.option("header", "true").schema("o_orderpriority string, n long, n_large long, rate_large double").csv(path))


def near_segments(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", (F.floor(F.col("ms") / 7200000) + F.when(F.col("event_id") % 2 == 0, 0.0).otherwise(5e-7)).alias("offset"))
    return rounded(timeline.near_duplicates(rows.filter("event_id % 3 > 0").select("user_id", "offset").groupBy("user_id", "offset").agg(F.count("*").alias("n")), "user_id", "offset").groupBy("user_id", "problem").agg(F.count("*").alias("n")))


_DENOMINATORS = (1, 2, 3, 4, 6, 8)


def grid_labels(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", (F.col("ms") % 100000 / 100.0).alias("t"), F.lit(0.0).alias("start"), F.lit(1000.0).alias("nominal"))
    return rounded(timeline.label_grid(rows, "t", "start", "nominal", timeline.grid_cells(_DENOMINATORS), window=3.0).select("event_id", "numer", "denom", "in_window"))


def bar_spans(spark, sf_dir):
    return rounded(timeline.bar_range(_placed(spark, sf_dir), "user_id", "tick", 24))


def trace_pairs(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", "event_type", "value")
    other = rows.withColumn("value", F.col("value") + 1)
    return rounded(logits.aligned_pairs(rows, other, ["user_id", "event_id"], ["event_type"]).groupBy("user_id").agg(F.count("*").alias("steps"), F.sum(F.col("b.value") - F.col("a.value")).alias("difference")))


def set_layouts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.concat(F.lit("f"), (F.col("doc_id") % 90).cast("string"), F.when(F.col("doc_id") % 3 == 0, ".osu").otherwise(".mp3")).alias("file"), "doc_id")
    wanted = rows.filter("doc_id % 3 > 0 AND (length(source) % 2 = 0 OR doc_id % 90 <> 7)").select("source", "file")
    return splits.set_layout(rows, wanted, "source", "file", ".osu")


def cache_states(spark, sf_dir):
    left = table(spark, sf_dir, "documents").filter("doc_id % 5 > 0").select("doc_id", "n_chars")
    right = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return splits.cache_audit(left, right, "doc_id", F.col("n_chars") > 100 + 500 * F.col("quality"))


def threshold_choice(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") / 10).alias("threshold"), F.floor("l_quantity").alias("tp"), F.floor(F.col("l_discount") * 100).alias("fp"), F.floor(F.col("l_tax") * 100).alias("fn"))
    return rounded(stats.threshold_choice(rows, "threshold"))


def field_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("l_tax"))
    return rounded(stats.field_summary(rows, ["l_quantity", "l_extendedprice", "l_tax"]), 4)


def object_ends(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("fin", F.when(F.col("event_type") == "purchase", F.col("ms") + F.floor(F.col("value") * 60000)))
    return rounded(timeline.object_end(rows, "user_id", "ms", "fin"))


def batch_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("batch"), F.floor("l_quantity").alias("length"))
    return rounded(windows.batch_rules(rows, ["batch"], "length", 3000, 49))


def bar_slices(spark, sf_dir):
    rows = _placed(spark, sf_dir)
    features = rows.groupBy("user_id", "tick").agg(F.sum("value").alias("value"))
    spans = rows.groupBy("user_id").agg(F.min("bar").alias("start")).withColumn("end", F.col("start") + 2)
    return rounded(windows.slice_bars(features, spans, "user_id", "tick", "value", 24), 4)


def scaled_clock(spark, sf_dir):
    return rounded(timeline.scale_clock(_beats(spark, sf_dir).select("user_id", "beat", "start", "nominal"), 1.25, ["start", "nominal"]))


def chart_shapes(spark, sf_dir):
    return rounded(timeline.chart_shape(_beats(spark, sf_dir), _rows(spark, sf_dir), "user_id", "start", "actual"))


def corpus_compare(spark, sf_dir):
    rows = _placed(spark, sf_dir)
    return rounded(reports.corpus_compare({name: rows.filter(F.col("user_id") % 2 == k) for k, name in enumerate(("human", "made"))}, "user_id", ["lane", "kind"], "pos"))


def verify_training(spark, sf_dir):
    manifest = splits.hash_split(table(spark, sf_dir, "customer"), "c_nationkey", RATIOS, 0)
    return reports.verify_training(table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0"), manifest, "c_custkey", "split", "a", "b")


def rescore(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("seed", F.col("event_id") % 3)
    made, wanted = rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1")
    return rounded(reports.rescore(made.select("user_id", "seed").distinct(), made, wanted, ["user_id", "seed"], "user_id", ["event_type", "lane"]))


def seed_scores(spark, sf_dir):
    rows = _placed(spark, sf_dir).withColumn("seed", F.col("event_id") % 2)
    both = rows.groupBy("user_id").agg(F.count_distinct("seed").alias("n")).filter("n = 2").select("user_id")
    return rounded(reports.seed_scores(both, rows.join(both, "user_id", "left_semi"), "user_id", "seed", ["lane", "kind"], "pos"))


def full_summary(spark, sf_dir):
    records = _records(spark, sf_dir).withColumn("concurrent", F.col("fp") % 3).withColumn("notes", F.col("tp") + F.col("fp"))
    counts = stats.distribution(_placed(spark, sf_dir), "user_id", {"position": F.col("pos"), "kind": F.col("kind")})
    line = table(spark, sf_dir, "lineitem")
    a, b = (line.filter(f"l_linenumber = {k}").select("l_orderkey", F.col("l_quantity").alias(f"target_{s}_q"), F.col("l_extendedprice").alias(f"made_{s}_q")) for k, s in ((1, "a"), (2, "b")))
    return rounded(reports.full_summary(records, ["mode"], "user_id", ["concurrent"], counts, a.join(b, "l_orderkey"), ["q"]), 4)


_CELLS = ", ".join(f"({n}, {d})" for n, d in timeline.grid_cells(_DENOMINATORS))
_FRAME = "CAST(CASE WHEN abs({0} - round_even({0}, 0)) <= 1e-8 THEN round_even({0}, 0) ELSE ceil({0}) END AS BIGINT)"
_SETS = "GROUPING SETS ((lane, kind, pos), (kind, pos), (lane, pos), (pos))"
_SUM = f"""WITH {_P}, e AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'teacher' ELSE 'free' END AS mode, user_id, event_id % 3 AS seed, event_type, event_id % 4 AS lane, 1 - event_id // 3 % 2 AS p, event_id // 3 % 2 AS e FROM events),
counts AS (SELECT mode, user_id, seed, event_type, lane, sum(p) AS p, sum(e) AS e FROM e GROUP BY ALL), t AS (SELECT mode, user_id, seed, {_T} FROM counts GROUP BY ALL),
f AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, fp % 3 AS concurrent, tp + fp AS notes FROM t), c AS (SELECT mode, user_id, avg(f1) AS f1, max(CASE WHEN tp + fn > 0 THEN 1 ELSE 0 END) AS has FROM f GROUP BY ALL),
m AS (SELECT mode, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, avg(f1) AS sample_f1, count(*) AS samples, count(DISTINCT user_id) AS charts, sum(concurrent) AS concurrent, count(DISTINCT user_id) FILTER (WHERE concurrent > 0) AS charts_with_concurrent, count(*) FILTER (WHERE notes = 0) AS empty_samples, avg((concurrent > 0)::INT) AS rate_concurrent FROM f GROUP BY ALL),
s AS (SELECT mode, tp, fp, fn, {_F1}, sample_f1, x.chart_f1, tp + fn AS support, x.h AS charts_with_reference, samples, charts, concurrent, charts_with_concurrent, empty_samples, rate_concurrent FROM m JOIN (SELECT mode, avg(f1) AS chart_f1, CAST(sum(has) AS BIGINT) AS h FROM c GROUP BY ALL) x USING (mode)),
d AS (SELECT user_id, 'position' AS part, CAST(pos AS VARCHAR) AS key FROM p UNION ALL SELECT user_id, 'kind', kind FROM p), dd AS (SELECT part || '|' || key AS key, count(*) AS n, count(DISTINCT user_id) AS charts FROM d GROUP BY ALL),
l AS (SELECT b.l_quantity - a.l_quantity AS x, b.l_extendedprice - a.l_extendedprice AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2),
r AS (SELECT count(*) FILTER (WHERE x <> 0) AS pairs, count(*) FILTER (WHERE x IS NULL OR y IS NULL) AS missing, count(*) FILTER (WHERE x = 0) AS unchanged, sum(x * y) FILTER (WHERE x <> 0) / sum(x * x) FILTER (WHERE x <> 0) AS slope, count(*) FILTER (WHERE x <> 0 AND sign(x) = sign(y)) AS direction_matches, count(*) FILTER (WHERE x <> 0 AND sign(x) = sign(y)) / count(*) FILTER (WHERE x <> 0) AS direction_rate, avg(abs(x)) FILTER (WHERE x <> 0) AS target_change, avg(abs(y)) FILTER (WHERE x <> 0) AS made_change FROM l)
"""


def _long(section: str, key: str, source: str, names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {key} AS key, '{n}' AS name, round({n}::DOUBLE, 4) AS value FROM {source}" for n in names.split())


SQL = {
    "versioned_rows": "SELECT doc_id, n_chars FROM documents WHERE doc_id % 3 <> 1 AND doc_id % 50 <> 0",
    "keyed_rows": "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 4 > 0 GROUP BY ALL UNION ALL SELECT -1, count(*) FROM orders WHERE o_orderkey % 4 = 0",
    "journal_files": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, max_by(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY ALL",
    "frozen_rows": "SELECT doc_id, toxic::BIGINT AS toxic FROM labels",
    "report_csv": "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 200000) AS n_large, round(avg((o_totalprice > 200000)::INT), 6) AS rate_large FROM orders GROUP BY ALL",
    "near_segments": f"WITH o AS (SELECT DISTINCT user_id, ms // 7200000 AS slot, event_id % 2 AS odd FROM {EVENTS} WHERE event_id % 3 > 0) SELECT user_id, CASE WHEN lead(odd) OVER w = 1 AND odd = 0 AND lead(slot) OVER w = slot THEN 'near' END AS problem, 0 AS n FROM o WINDOW w AS (PARTITION BY user_id ORDER BY slot, odd)",
    "grid_labels": f"WITH c(numer, denom) AS (VALUES {_CELLS}), x AS (SELECT event_id, numer, denom, numer * 1000.0::DOUBLE / denom - t AS off FROM (SELECT event_id, ms % 100000 / 100.0::DOUBLE AS t FROM {EVENTS}), c), y AS (SELECT *, off > -1e-6 AND off < 3 + 1e-6 AS hit FROM x) SELECT event_id, numer::BIGINT AS numer, denom::BIGINT AS denom, hit AS in_window FROM y QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY hit DESC, CASE WHEN hit THEN denom END, round(abs(off), 12), denom, numer) = 1",
    "bar_spans": f"WITH {_P} SELECT user_id, min(tick) // 24 AS first_bar, max(tick) // 24 + 1 AS end_bar FROM p GROUP BY ALL",
    "trace_pairs": "SELECT user_id, count(*) AS steps, count(*)::DOUBLE AS difference FROM events GROUP BY ALL",
    "set_layouts": "WITH f AS (SELECT DISTINCT source, doc_id % 90 AS f FROM documents WHERE doc_id % 3 > 0), w AS (SELECT DISTINCT source, doc_id % 90 AS f FROM documents WHERE doc_id % 3 > 0 AND (length(source) % 2 = 0 OR doc_id % 90 <> 7)) SELECT source, bool_and(w.f IS NOT NULL) AS exact FROM f LEFT JOIN w USING (source, f) GROUP BY ALL",
    "cache_states": "WITH l AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 5 > 0) SELECT doc_id, CASE WHEN r.quality IS NULL AND r.doc_id IS NULL THEN 'left_orphan' WHEN l.n_chars IS NULL THEN 'right_orphan' WHEN n_chars > 100 + 500 * quality THEN 'valid' ELSE 'invalid' END AS state FROM l FULL JOIN (SELECT doc_id, quality FROM labels) r USING (doc_id)",
    "threshold_choice": f"WITH m AS (SELECT l_linenumber / 10 AS threshold, CAST(sum(floor(l_quantity)) AS BIGINT) AS tp, CAST(sum(floor(l_discount * 100)) AS BIGINT) AS fp, CAST(sum(floor(l_tax * 100)) AS BIGINT) AS fn FROM lineitem GROUP BY ALL), s AS (SELECT threshold, {_F1} FROM m) SELECT round(threshold, 6) AS threshold, precision, recall, f1 FROM s ORDER BY f1 DESC, precision DESC, threshold LIMIT 1",
    "field_summary": " UNION ALL ".join(f"SELECT '{f}' AS field, count({x}) AS n, count(*) - count({x}) AS missing, round(avg({x}), 4) AS mean, round(quantile_cont({x}, 0.1), 4) AS p10, round(quantile_cont({x}, 0.5), 4) AS p50, round(quantile_cont({x}, 0.9), 4) AS p90 FROM lineitem" for f, x in (("l_quantity", "l_quantity"), ("l_extendedprice", "l_extendedprice"), ("l_tax", "CASE WHEN l_tax > 0.01 THEN l_tax END"))),
    "object_ends": f"SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN greatest(ms, ms + CAST(floor(value * 60000) AS BIGINT)) ELSE ms END) AS object_end FROM {EVENTS} GROUP BY ALL",
    "batch_rules": "WITH b AS (SELECT l_orderkey % 500 AS batch, CAST(floor(l_quantity) AS BIGINT) AS length FROM lineitem) SELECT batch, count(*) AS rows, max(length) AS longest, count(*) * max(length) AS padded, count(*) * max(length) <= 3000 OR count(*) = 1 AS fits, CAST(floor(3000 / quantile_cont(length, 0.9)) AS BIGINT) AS share_by_p90, max(length) > 49 AS too_long FROM b GROUP BY ALL",
    "bar_slices": f"WITH {_P}, s AS (SELECT user_id, min(bar) AS start FROM p GROUP BY ALL), o AS (SELECT user_id, start, unnest(range(48)) AS \"offset\" FROM s), v AS (SELECT user_id, tick, sum(value) AS value FROM p GROUP BY ALL) SELECT o.user_id, o.start, o.\"offset\", round(coalesce(v.value, 0), 4) AS value FROM o LEFT JOIN v ON o.user_id = v.user_id AND v.tick = o.start * 24 + o.\"offset\"",
    "scaled_clock": _LOCAL + "SELECT user_id, beat, round(start / 1.25, 6) AS start, round(nominal / 1.25, 6) AS nominal FROM b",
    "chart_shapes": _LOCAL + f", {_R}, w AS (SELECT user_id, min(start) / (256 / 22050.0::DOUBLE * 1000) AS low, max(start + actual) / (256 / 22050.0::DOUBLE * 1000) AS high, count(*) AS beats FROM b GROUP BY ALL), y AS (SELECT user_id, count(*) AS n FROM r GROUP BY ALL) SELECT user_id, {_FRAME.format('high')} - {_FRAME.format('low')} AS frames, 2 + beats + 2 * coalesce(n, 0) AS tokens FROM w LEFT JOIN y USING (user_id)",
    "corpus_compare": f"WITH {_P}, a AS (SELECT coalesce(CAST(lane AS VARCHAR), 'all') AS lane, coalesce(kind, 'all') AS kind, pos, count(*) FILTER (WHERE user_id % 2 = 0) AS n_human, count(*) FILTER (WHERE user_id % 2 = 1) AS n_made FROM p GROUP BY {_SETS}), z AS (SELECT count(DISTINCT user_id) FILTER (WHERE user_id % 2 = 0) AS ch, count(*) FILTER (WHERE user_id % 2 = 0) AS nh, count(DISTINCT user_id) FILTER (WHERE user_id % 2 = 1) AS cm, count(*) FILTER (WHERE user_id % 2 = 1) AS nm FROM p) SELECT lane, kind, pos, n_human, round(n_human / ch, 6) AS avg_human, round(n_human / nh, 6) AS pooled_human, n_made, round(n_made / cm, 6) AS avg_made, round(n_made / nm, 6) AS pooled_made FROM a, z",
    "verify_training": f"WITH s AS (SELECT c_custkey, {_SPLIT.format(p=_POS.format('c_nationkey'))} AS split FROM customer), o AS (SELECT count(*) AS n FROM s WHERE c_custkey % 2 = 0 AND split <> 'train') SELECT 'outside train' AS problem, n FROM o WHERE n > 0 UNION ALL SELECT 'another split', 1",
    "rescore": f"WITH e AS (SELECT user_id, event_id % 3 AS seed, event_type, event_id % 4 AS lane, event_id % 2 AS odd FROM events), k AS (SELECT DISTINCT user_id, seed FROM e WHERE odd = 0), counts AS (SELECT user_id, seed, event_type, lane, sum(p) AS p, sum(e) AS e FROM (SELECT user_id, seed, event_type, lane, 1 AS p, 0 AS e FROM e WHERE odd = 0 UNION ALL SELECT k.user_id, k.seed, event_type, lane, 0, 1 FROM k JOIN e ON k.user_id = e.user_id AND odd = 1) GROUP BY ALL) SELECT user_id, seed, {_T} FROM counts GROUP BY ALL",
    "seed_scores": f"WITH {_P}, q AS (SELECT *, event_id % 2 AS seed FROM p WHERE user_id IN (SELECT user_id FROM p GROUP BY user_id HAVING count(DISTINCT event_id % 2) = 2)), z AS (SELECT seed, count(DISTINCT user_id) AS charts, count(*) AS total FROM q GROUP BY ALL), a AS (SELECT seed, coalesce(CAST(lane AS VARCHAR), 'all') AS lane, coalesce(kind, 'all') AS kind, pos, count(*) AS n FROM q GROUP BY GROUPING SETS ((seed, lane, kind, pos), (seed, kind, pos), (seed, lane, pos), (seed, pos))) SELECT seed, lane, kind, pos, n, round(n / charts, 6) AS avg_count, round(n / total, 6) AS pooled FROM a JOIN z USING (seed)",
    "full_summary": _SUM
    + _long("scores", "mode", "s", "tp fp fn precision recall f1 sample_f1 chart_f1 support charts_with_reference samples charts")
    + " UNION ALL " + _long("plausibility", "mode", "s", "concurrent charts_with_concurrent empty_samples rate_concurrent")
    + " UNION ALL " + _long("distribution", "key", "dd", "n charts")
    + " UNION ALL " + _long("response", "'q'", "r", "pairs missing unchanged slope direction_matches direction_rate target_change made_change"),
}
SQL["near_segments"] = f"WITH x AS ({SQL['near_segments']}) SELECT user_id, problem, count(*) AS n FROM x GROUP BY ALL"

QUERIES = {
    f.__name__: f
    for f in (
        versioned_rows, keyed_rows, journal_files, frozen_rows, report_csv, near_segments, grid_labels, bar_spans, trace_pairs, set_layouts, cache_states, threshold_choice, field_summary,
        object_ends, batch_rules, bar_slices, scaled_clock, chart_shapes, corpus_compare, verify_training, rescore, seed_scores, full_summary,
    )
}
