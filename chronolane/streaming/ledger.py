"""Streams: journals merged by key, status ledgers, running counts and event-time windows.

State is bounded by keys and watermarks; what comes later than the watermark is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Which marks a status clears: completed and skipped are final, failed stays retryable.
FINAL = ("completed", "skipped")


def journal_batches(stream: DataFrame, keys: list[str], seq: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append a journal's new records, latest of each key in a batch; latest() over the folder is the journal."""

    def put(batch: DataFrame, epoch: int) -> None:
        from chronolane.sources.artifacts import latest

        latest(batch, keys, seq).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first record of each key inside the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def status_of(df: DataFrame, key: str, status: str, seq: str, error: str) -> DataFrame:
    """Batch form of the ledger: latest status of each key; a failure after a final status doesn't undo it."""
    final = F.max_by(F.struct(status, error), F.when(F.col(status).isin(*FINAL), F.col(seq)))
    last = F.max_by(F.struct(status, error), seq)
    chosen = F.coalesce(final, last)
    return df.filter((F.col(status) != "failed") | F.col(error).isNotNull()).groupBy(key).agg(chosen.alias("s")).select(key, F.col(f"s.{status}").alias(status), F.col(f"s.{error}").alias(error))


class LedgerState(StatefulProcessor):
    """One status a key, as status_of gives it; emits it when it changes.

    The state keeps the sequence that won, among final statuses and among the others: a late row of an older sequence
    loses to it, in whatever batch it comes. Rows of one sequence go by status and error.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ledger", "final_seq long, final_status string, final_error string, seq long, status string, error string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = tuple(self.state.get()) if self.state.exists() else (None,) * 6
        won = [x if x[0] is not None else None for x in (held[:3], held[3:])]
        before = won[0] or won[1]
        for part in rows:
            for seq, status, error in zip(part["seq"], part["status"], part["error"], strict=True):
                error = error if isinstance(error, str) else None
                if status == "failed" and error is None:
                    continue
                place, row = int(status not in FINAL), (int(seq), status, error)
                if won[place] is None or (row[0], row[1], row[2] or "") > (won[place][0], won[place][1], won[place][2] or ""):
                    won[place] = row
        self.state.update((won[0] or (None,) * 3) + (won[1] or (None,) * 3))
        now = won[0] or won[1]
        if now and (before is None or now[1:] != tuple(before[1:])):
            yield pd.DataFrame({"key": [key[0]], "status": [now[1]], "error": [now[2]]})

    def close(self) -> None:
        pass


def status_stream(stream: DataFrame) -> DataFrame:
    """Stream form over (key, status, error, seq); needs the RocksDB state store."""
    return stream.groupBy("key").transformWithStateInPandas(LedgerState(), "key long, status string, error string", "Update", "None")


def candidates(stream: DataFrame, known: DataFrame, key: str, modes: str, mode_bit: int, lanes: str, wanted: int) -> DataFrame:
    """Rows that aren't known, of a mode bit, and of the lane count or an unknown one; works on streams against a static table."""
    fits = F.col(modes).bitwiseAND(mode_bit) > 0
    return stream.join(known.select(key).distinct(), key, "left_anti").filter(fits & (F.col(lanes).isNull() | (F.col(lanes) == wanted)))


def recompute(files: DataFrame, cache: DataFrame, key: str, size: str) -> DataFrame:
    """Files whose size isn't the cached one, or that aren't cached."""
    return files.join(cache.select(key, size), [key, size], "left_anti")


def cached(spark: SparkSession, path: str, key: str, before: int | None = None) -> DataFrame | None:
    """The latest row of each key that incremental() wrote, in epochs before one if that is given; None if there is nothing."""
    try:
        rows = spark.read.parquet(path)
    except Exception as error:  # the reader says so in several ways
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise
    rows = rows if before is None else rows.filter(F.col("epoch") < before)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "epoch").alias("r")).select("r.*")


def incremental(stream: DataFrame, key: str, fingerprint: str, seq: str, compute: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Work out anew what a file stream brings under another fingerprint than the cached one; all there is now, then stop.

    A batch keeps the latest row of each key, drops those whose fingerprint is cached, and writes what ``compute`` makes
    of the rest, with key and fingerprint, as its own epoch: a batch that is repeated after a failure writes the same
    epoch again and is held against earlier ones only. cached() is the merged table.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), seq).alias("r")).select("r.*")
        there = cached(batch.sparkSession, path, key, epoch)
        todo = newest if there is None else newest.join(there.select(key, fingerprint), [key, fingerprint], "left_anti")
        compute(todo).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running(stream: DataFrame, by: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """Mergeable counts and sums, for update or complete output."""
    return stream.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()])


def windowed(df: DataFrame, ts: str, late: str, size: str, slide: str | None, by: list[str], value: str) -> DataFrame:
    """Counts and sums in tumbling or sliding windows of event time; a batch has the same windows."""
    rows = df.withWatermark(ts, late) if df.isStreaming else df
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(df: DataFrame, ts: str, late: str, gap: str, by: list[str]) -> DataFrame:
    """Runs of events no further apart than ``gap``, with their counts."""
    rows = df.withWatermark(ts, late) if df.isStreaming else df
    return rows.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def drain(query: StreamingQuery) -> None:
    """Wait until a query has taken all there is."""
    query.processAllAvailable()
    query.stop()


def to_table(stream: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    """Write all that a stream has now, once for each batch, and stop."""

    def put(batch: DataFrame, epoch: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
