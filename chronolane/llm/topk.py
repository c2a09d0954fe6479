"""Exact top-k search by distributed histogram selection.

Vectors are turned to whole numbers and written once. For a wave of queries every vector is scored, in blocks, and each
task counts its scores of each query in BINS bins of the range where that query's k-th score can lie. Bins are summed
over tasks, the one that holds the k-th score becomes the next range, and so on until a range is one value wide: that is
the k-th score. A last pass keeps what is above it and, of the equal ones, those of the smallest ids.

The first range follows from the vectors' norms (no inner product is larger than their product). A task leaves out the
bins below its own k-th score, as the k-th of all is no lower. Waves have WAVE queries, so that histograms, ranges and
the queries' own vectors are bounded; they alone reach the driver. Each wave reads the vectors a few times; scores never
leave the task but as counts, or as rows of the result.

Scores are exact: products are summed in doubles while every sum stays below 2**53, else in 64-bit integers, and values
whose scores don't fit these raise an error.

Defined cases: null vectors and those with null or non-finite components take no part; missing components of a shorter
vector count as 0; rows of one id are different vectors, each a query of its own and a candidate for the others; a null
id is no query and comes last among equals; with fewer candidates than k all are returned, and none for a sole row; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, write_cut

#: Queries of a wave, bins of a query, and rows and queries of a block of scores.
WAVE, BINS, BLOCK = 4096, 512, 1024
_LAST = np.iinfo(np.int64).max


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(row, vec_id, v): floor(scale * x) of every component of the rows that take part; written, as ``row`` follows the partitions."""
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    made = vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))
    return write_cut(made.select(F.monotonically_increasing_id().alias("row"), "*"), "vectors")


def _matrix(lists: pa.Array, width: int, kind: type) -> np.ndarray:
    out, ends = np.zeros((len(lists), width), kind), lists.offsets.to_numpy()
    flat, sizes = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], np.diff(ends)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


@dataclass
class Queries:
    """Queries of a wave and the ranges [low, high) of their k-th scores; ``need`` scores are still to be found there."""

    row: np.ndarray
    vec_id: np.ndarray
    v: np.ndarray
    low: np.ndarray
    high: np.ndarray
    need: np.ndarray
    bins: int

    @property
    def width(self) -> np.ndarray:
        return np.maximum(1, -(-(self.high - self.low) // self.bins))

    def scores(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[slice, pa.RecordBatch, np.ndarray, np.ndarray]]:
        """(queries, rows, scores, which count) by blocks; a query's own row doesn't."""
        order = np.argsort(self.row)
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(k, BLOCK)
                c = _matrix(rows.column("v"), self.v.shape[1], self.v.dtype)
                ids = rows.column("row").to_numpy()
                at = order[np.minimum(np.searchsorted(self.row, ids, sorter=order), len(order) - 1)]
                own = self.row[at] == ids
                for q in range(0, len(self.row), BLOCK):
                    part = slice(q, q + BLOCK)
                    s = self.v[part] @ c.T
                    counts = np.ones(s.shape, bool)
                    mine = own & (at >= q) & (at < q + BLOCK)
                    counts[at[mine] - q, np.flatnonzero(mine)] = False
                    yield part, rows, s, counts

    def histogram(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(q, bin, n) of a task's scores in the ranges, down to the bin of its own k-th score."""
        bins = self.bins
        n, width, floor = np.zeros((len(self.row), bins), np.int64), self.width, self.low.copy()
        for part, _, s, counts in self.scores(batches):
            q, c = np.nonzero(counts & (s >= floor[part, None]) & (s < self.high[part, None]))
            if len(q):
                b = (s[q, c].astype(np.int64) - self.low[part][q]) // width[part][q]
                n[part] += np.bincount(q * bins + b, minlength=n[part].size).reshape(-1, bins)
                enough = np.cumsum(n[part, ::-1], axis=1) >= self.need[part, None]
                least = bins - 1 - enough.argmax(axis=1)
                floor[part] = np.where(enough[:, -1], self.low[part] + least * width[part], floor[part])
        n[np.arange(bins)[None] < ((floor - self.low) // width)[:, None]] = 0
        q, b = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n[q, b])], ["q", "bin", "n"])

    def refined(self, found: list) -> Queries:
        """The ranges that (q, bin, above) name: in each the k-th score lies in ``bin``, with ``above`` scores in higher ones."""
        q, b, above = np.array(found, np.int64).reshape(-1, 3).T
        low, high, need, width = self.low.copy(), self.high.copy(), self.need.copy(), self.width
        low[q] = self.low[q] + b * width[q]
        high[q] = np.minimum(low[q] + width[q], self.high[q])
        need[q] -= above
        return Queries(self.row, self.vec_id, self.v, low, high, need, self.bins)

    def best(self, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        """(q, vec_id, score, row) of a task's scores from the k-th up, at most k of a query."""
        held = [np.empty((0, 4), np.int64)]
        for part, rows, s, counts in self.scores(batches):
            q, c = np.nonzero(counts & (s >= self.low[part, None]))
            if len(q):
                ids = rows.column("vec_id").fill_null(_LAST).to_numpy()
                held.append(np.stack([q + part.start, s[q, c].astype(np.int64), ids[c], rows.column("row").to_numpy()[c]], axis=1))
                if sum(map(len, held)) > 4 * k * len(self.row):
                    held = [_first(np.concatenate(held), k)]
        out = _first(np.concatenate(held), k)
        ids = pa.array(out[:, 2], mask=out[:, 2] == _LAST)
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0].astype(np.int32)), ids, pa.array(out[:, 1]), pa.array(out[:, 3])], ["q", "vec_id", "score", "row"])


def _first(rows: np.ndarray, k: int) -> np.ndarray:
    """The k first rows (q, score, id, row) of each q by falling score, id and row."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
    starts = np.searchsorted(rows[:, 0], rows[:, 0])
    return rows[np.arange(len(rows)) - starts < k]


def _select(vectors: DataFrame, wave: Queries, k: int) -> Queries:
    """Refine the histograms over all tasks until each query's k-th score is known."""
    spark = vectors.sparkSession
    down = W.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, W.currentRow)
    while len(wave.row) and int((wave.high - wave.low).max()) > 1:
        sent = spark.sparkContext.broadcast(wave)
        bins = vectors.mapInArrow(lambda batches, sent=sent: sent.value.histogram(batches), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        need = spark.createDataFrame([(int(i), int(x)) for i, x in enumerate(wave.need)], "q int, need long")
        upto = bins.withColumn("upto", F.sum("n").over(down)).join(F.broadcast(need), "q")  # WAVE rows at most
        found = upto.filter("upto >= need AND upto - n < need").select("q", "bin", F.expr("upto - n")).collect()
        wave = wave.refined([tuple(x) for x in found])
        sent.unpersist()
    return wave


def top_k(vectors: DataFrame, queries: Column, k: int, scale: int = 256, bins: int = BINS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each row that ``queries`` is true for, with all other rows."""
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, scale)
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    n, width, norm, asked = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square), F.count_if(queries)).first()
    norm = norm or 0.0
    if norm >= 2.0**62:
        raise ValueError(f"inner products up to {norm:g} don't fit 64 bits")
    kind = np.float64 if norm < 2.0**52 else np.int64
    waves, out = max(1, -(-asked // WAVE)), []
    # A row's own norm bounds its scores, a little more for rounding.
    mine = rows.filter(queries).withColumn("reach", (F.sqrt(square) * (norm**0.5) * (1 + 1e-9) + 2).cast("long"))
    for i in range(waves):
        x = mine.filter(F.pmod(F.xxhash64("row"), F.lit(waves)) == i).toArrow().combine_chunks()
        column = lambda c, x=x: x.column(c).combine_chunks()
        reach = column("reach").to_numpy()
        wave = Queries(column("row").to_numpy(), column("vec_id").to_numpy(), _matrix(column("v"), width or 0, kind), -reach, reach + 1, np.full(len(reach), min(k, n - 1), np.int64), bins)
        if n > 1:
            wave = _select(rows, wave, k)
        sent = spark.sparkContext.broadcast(wave)
        best = rows.mapInArrow(lambda batches, sent=sent: sent.value.best(batches, k), "q int, vec_id long, score long, row long")
        first = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
        best = best.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(j, int(v)) for j, v in enumerate(wave.vec_id)], "q int, query_id long")
        found = best.join(F.broadcast(names), "q").select("query_id", "rank", "vec_id", "score")  # WAVE rows at most
        out.append(found if waves == 1 else write_cut(found, "nearest"))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id, c.r, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST, r) AS rank FROM s) WHERE rank <= 5
"""
