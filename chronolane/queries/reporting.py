"""Composite reports, journals and streams over events, orders and documents. Streams end when all there is was read."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.operators import match
from chronolane.plans import reports
from chronolane.session import scratch_dir
from chronolane.sources import artifacts
from chronolane.streaming import ledger

from .base import EVENTS, bootstrap_sql, events, rounded, table
from .matching import _F1, _T

RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}


def _records(spark, sf_dir) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("mode", F.when(F.pmod("user_id", F.lit(2)) == 0, "teacher").otherwise("free")).withColumn("seed", F.pmod(F.col("event_id"), F.lit(3)))
    sides = [rows.filter(F.pmod(F.floor(F.col("event_id") / 3), F.lit(2)) == k) for k in (0, 1)]
    return match.multiset_match(*sides, ["event_type", "lane"], ["mode", "user_id", "seed"])


def summarize_records(spark, sf_dir):
    return rounded(reports.summarize_records(_records(spark, sf_dir), ["mode"], "user_id"))


def compare_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"))
    runs = [rows.select("l_returnflag", "l_suppkey", F.col(c).alias("score"), F.lit("v1").alias("settings")) for c in "ab"]
    return rounded(reports.compare_runs(*runs, ["l_returnflag"], "l_suppkey", "score", ["settings"]))


def verify_archive(spark, sf_dir):
    expected = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("digest"))
    journal = table(spark, sf_dir, "labels").select("doc_id", F.sha2((F.col("doc_id") + F.col("toxic")).cast("string"), 256).alias("digest"))
    return reports.verify_archive(expected, journal, ["doc_id"], ["digest"])


def dataset_report(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("reason", F.when(F.col("n_chars") < 200, "short").when(F.col("n_chars") > 8000, "long"))
    return rounded(reports.dataset_report(rows, "reason", ["n_chars"], ["lang", "source"]))


def _charts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.when(F.col("n_chars") > 8000, "long").alias("reason"))


def train_plan(spark, sf_dir):
    return reports.train_plan(_charts(spark, sf_dir), "doc_id", "doc_id", "n_chars", RATIOS, "reason", 16384, 1, 3, ["source", "n_chars"])


def eval_pool(spark, sf_dir):
    return reports.eval_pool(_charts(spark, sf_dir), "doc_id", "doc_id", RATIOS, "reason", 40, 3)


def journal_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return rounded(artifacts.latest(rows, ["o_custkey"], "o_orderkey"))


def merged_rows(spark, sf_dir):
    stored = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("n"))
    fresh = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("n"))
    return artifacts.merge_by_key(stored, fresh, ["doc_id"])


def incremental_rows(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    cache = files.filter("doc_id % 3 > 0").withColumn("n_chars", F.col("n_chars") + (F.col("doc_id") % 5 == 0).cast("long"))
    return ledger.recompute(files, cache, "doc_id", "n_chars")


def candidate_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("modes"), F.when(F.col("p_partkey") % 3 > 0, F.pmod("p_partkey", F.lit(8))).alias("lanes"))
    return rounded(ledger.candidates(rows, rows.filter("p_partkey % 10 = 0"), "p_partkey", "modes", 8, "lanes", 4))


def _statuses(df: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "signup", "skipped").otherwise("failed")
    return df.select((F.col("user_id") * 100 + F.floor(F.col("value"))).alias("key"), status.alias("status"), F.when((status == "failed") & (F.col("event_id") % 4 > 0), F.col("event_type")).alias("error"), F.col("event_id").alias("seq"))


def status_ledger(spark, sf_dir):
    return ledger.status_of(_statuses(table(spark, sf_dir, "events")), "key", "status", "seq", "error")


def event_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _flat(ledger.windowed(rows, "ts", "1 day", "16 hours", "4 hours", ["event_type"], "value"))


def event_sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _flat(ledger.sessions(rows, "ts", "1 day", "3 hours", ["user_id"]))


def _flat(df: DataFrame) -> DataFrame:
    times = {c: F.unix_micros(c) for c, kind in df.dtypes if kind == "timestamp"}
    return rounded(df.withColumns(times), 4)


def _stream(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(spark, stream: DataFrame, mode: str, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a stream over all there is into the shared folder and read what it gave."""
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{base}/out/epoch_{epoch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return merge(spark.read.parquet(f"{base}/out/*")).drop("epoch")


def _newest(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: artifacts.latest(df, keys, "epoch")


def stream_counts(spark, sf_dir):
    counts = ledger.running(_stream(spark, sf_dir), ["event_type"], {"total": F.col("value")})
    return rounded(_drained(spark, counts, "update", _newest(["event_type"])), 3)


def stream_windows(spark, sf_dir):
    out = ledger.windowed(_stream(spark, sf_dir), "ts", "1 day", "16 hours", "4 hours", ["event_type"], "value")
    return _flat(_drained(spark, out, "update", _newest(["start", "end", "event_type"])))


def stream_sessions(spark, sf_dir):
    out = ledger.sessions(_stream(spark, sf_dir), "ts", "1 day", "3 hours", ["user_id"])
    return _flat(_drained(spark, out, "complete", lambda df: df.filter(F.col("epoch") == df.agg(F.max("epoch")).first()[0])))


def stream_first_seen(spark, sf_dir):
    first = ledger.deduplicated(_stream(spark, sf_dir).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "40 days")
    return _drained(spark, first.select("user_id", "event_type"), "append", lambda df: df)


_STATUS = f"s AS (SELECT user_id * 100 + CAST(floor(value) AS BIGINT) AS key, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'skipped' ELSE 'failed' END AS status, CASE WHEN event_type NOT IN ('purchase', 'signup') AND event_id % 4 > 0 THEN event_type END AS error, event_id AS seq FROM {EVENTS})"
_SLIDES = "SELECT s AS start, s + 57600000000 AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest(range(epoch_us(ts) // 14400000000 * 14400000000 - 43200000000, epoch_us(ts) + 1, 14400000000)) AS s FROM events) GROUP BY ALL"
_SESSIONS = "WITH g AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events), k AS (SELECT *, sum(CASE WHEN d IS NULL OR d >= 10800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS s FROM g) SELECT min(t) AS start, max(t) + 10800000000 AS \"end\", user_id, count(*) AS n FROM k GROUP BY user_id, s"
SQL = {
    "summarize_records": f"""
WITH e AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'teacher' ELSE 'free' END AS mode, user_id, event_id % 3 AS seed, event_type, event_id % 4 AS lane, 1 - event_id // 3 % 2 AS p, event_id // 3 % 2 AS e FROM events),
counts AS (SELECT mode, user_id, seed, event_type, lane, sum(p) AS p, sum(e) AS e FROM e GROUP BY ALL), t AS (SELECT mode, user_id, seed, {_T} FROM counts GROUP BY ALL),
f AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM t), c AS (SELECT mode, user_id, avg(f1) AS f1, max(CASE WHEN tp + fn > 0 THEN 1 ELSE 0 END) AS has FROM f GROUP BY ALL),
m AS (SELECT mode, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, avg(f1) AS sample_f1, count(*) AS samples, count(DISTINCT user_id) AS charts FROM f GROUP BY ALL)
SELECT mode, tp, fp, fn, {_F1}, round(sample_f1, 6) AS sample_f1, round(x.chart_f1, 6) AS chart_f1, tp + fn AS support, x.h AS charts_with_reference, samples, charts FROM m JOIN (SELECT mode, avg(f1) AS chart_f1, CAST(sum(has) AS BIGINT) AS h FROM c GROUP BY ALL) x USING (mode)""",
    "compare_runs": "WITH r AS (SELECT l_returnflag, l_suppkey, avg(l_tax) - avg(l_discount) AS difference FROM lineitem GROUP BY ALL)"
    + bootstrap_sql("r", "l_returnflag", "l_suppkey", "difference")
    + "SELECT l_returnflag, n, round(mean, 6) AS mean, CASE WHEN n > 1 THEN round(low, 6) END AS low, CASE WHEN n > 1 THEN round(high, 6) END AS high FROM m JOIN b USING (l_returnflag)",
    "verify_archive": "WITH e AS (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS d FROM documents), j AS (SELECT doc_id, sha256(CAST(doc_id + toxic AS VARCHAR)) AS d FROM labels) SELECT doc_id, 'missing' AS problem FROM e WHERE doc_id NOT IN (SELECT doc_id FROM j) UNION ALL SELECT doc_id, 'unexpected' FROM j WHERE doc_id NOT IN (SELECT doc_id FROM e) UNION ALL SELECT doc_id, 'differs' FROM e JOIN j USING (doc_id) WHERE e.d <> j.d",
    "dataset_report": "WITH r AS (SELECT *, CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars > 8000 THEN 'long' END AS reason FROM documents) SELECT 'total' AS section, 'charts' AS key, count(*)::DOUBLE AS value FROM r UNION ALL SELECT 'reason', coalesce(reason, 'none'), count(*) FROM r GROUP BY ALL UNION ALL SELECT 'lang', coalesce(lang, 'none'), count(*) FROM r GROUP BY ALL UNION ALL SELECT 'source', coalesce(source, 'none'), count(*) FROM r GROUP BY ALL" + "".join(f" UNION ALL SELECT 'n_chars', '{n}', round(quantile_cont(n_chars, {p}), 6) FROM r" for n, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))),
    "journal_latest": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, max_by(o_orderstatus, o_orderkey) AS o_orderstatus, round(max_by(o_totalprice, o_orderkey), 6) AS o_totalprice FROM orders GROUP BY ALL",
    "merged_rows": "SELECT doc_id, coalesce(l.quality::BIGINT, n_chars) AS n FROM documents LEFT JOIN labels l USING (doc_id)",
    "incremental_rows": "SELECT doc_id, n_chars FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0",
    "candidate_filter": "SELECT p_partkey, CAST(p_size AS BIGINT) AS modes, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 8 END AS lanes FROM part WHERE p_partkey % 10 <> 0 AND (p_size & 8) > 0 AND (p_partkey % 3 = 0 OR p_partkey % 8 = 4)",
    "status_ledger": f"WITH {_STATUS}, u AS (SELECT * FROM s WHERE status <> 'failed' OR error IS NOT NULL) SELECT key, coalesce(max_by(status, seq) FILTER (WHERE status <> 'failed'), max_by(status, seq)) AS status, CASE WHEN count(*) FILTER (WHERE status <> 'failed') = 0 THEN max_by(error, seq) END AS error FROM u GROUP BY ALL",
    "event_windows": _SLIDES,
    "event_sessions": _SESSIONS,
    "stream_counts": "SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL",
    "stream_windows": _SLIDES,
    "stream_sessions": _SESSIONS,
    "stream_first_seen": "SELECT DISTINCT user_id, event_type FROM events",
}

QUERIES = {
    f.__name__: f
    for f in (
        summarize_records, compare_runs, verify_archive, dataset_report, train_plan, eval_pool, journal_latest, merged_rows, incremental_rows,
        candidate_filter, status_ledger, event_windows, event_sessions, stream_counts, stream_windows, stream_sessions, stream_first_seen,
    )
}
