"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time over an inverted index.

The index is a table of segments, each of up to SEGMENT documents with the postings of the terms that are asked for. A
segment's short lists are summed term at a time into accumulators. These are then one more list beside the long ones,
with bounds as they have: the largest value in each block of BLOCK documents. Blocks whose bounds together don't reach
the k-th score are skipped. In the others documents go from list to list, the list of the largest values first, and each
list is sought only for documents that can still reach the k-th score with what later lists hold at most. The k-th score
starts from the accumulators and from what the task found in earlier segments. Nothing else is left out, so the result is
exact; each task returns k documents an item, and a window keeps the k first of these.

Items are asked in waves of ITEM_BYTES of text, dealt by hash; their terms and document frequencies are all that reaches
the driver. Each wave reads the documents once and its index twice.

Scores are whole numbers: with N documents that hold a term, L terms in all of them, n terms in one, df documents with a
term and tf occurrences, a term weighs floor(1000 * ln((2N + 2) / (2df + 1))), a document's length counts as
m = 10 + 90nN div L, and each term of an item adds weight * (10**9 * tf div (1000tf + 8m)).

Defined cases: null or empty texts, and those without a term, are no documents and no items; repeated rows are documents
or items of their own; equal scores go by doc_id, null last, then by row; items without a match have no rows, nor has an
empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, table, write_cut

#: Documents and postings of a segment at most (and one document more), documents of a block.
SEGMENT, POSTINGS, BLOCK = 16384, 1 << 20, 64
#: A list is long from one posting in so many documents of its segment.
SHARE = 32
#: Text of the items of a wave.
ITEM_BYTES = 8 << 20
#: Bytes as they count in terms: A-Z lower-cased, all other ASCII but digits and letters a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LAST = np.iinfo(np.int64).max

INDEX = "segment long, doc_id array<long>, n array<long>, terms array<int>, sizes array<int>, docs array<int>, tf array<long>, documents long, total long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Segment:
    """Documents on their way into a segment."""

    def __init__(self, vocabulary: dict[bytes, int], most: int) -> None:
        self.most, self.vocabulary, self.doc_id, self.n, self.term, self.doc, self.tf = most, vocabulary, [], [], [], [], []
        self.documents = self.total = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        words = terms_of(text)
        if not words:
            return
        self.documents += 1
        self.total += len(words)
        known, at = self.vocabulary, len(self.term)
        for word, tf in Counter(words).items():
            if word in known:
                self.term.append(known[word])
                self.tf.append(tf)
        if found := len(self.term) - at:
            self.doc += [len(self.n)] * found
            self.doc_id.append(doc_id)
            self.n.append(len(words))

    def full(self) -> bool:
        return len(self.n) >= self.most or len(self.term) >= POSTINGS

    def batch(self, number: int) -> pa.RecordBatch:
        """One row; postings by term, then document."""
        term = np.array(self.term, np.int32)
        order = np.argsort(term, kind="stable")
        terms, sizes = np.unique(term, return_counts=True)
        lists = [self.doc_id, self.n, terms, sizes.astype(np.int32), np.array(self.doc, np.int32)[order], np.array(self.tf, np.int64)[order]]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind)) for x, kind in zip(lists, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([number]), *columns, pa.array([self.documents]), pa.array([self.total])], [c.split()[0] for c in INDEX.split(", ")])


def index(docs: DataFrame, vocabulary: dict[bytes, int], most: int = SEGMENT) -> DataFrame:
    """Segments of ``docs`` with the postings of a vocabulary, numbered in each task; write it, as it is read twice."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, number = Segment(sent.value, most), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                segment.add(doc_id, text or b"")
                if segment.full():
                    yield segment.batch(number)
                    segment, number = Segment(sent.value, most), number + 1
        yield segment.batch(number)

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


def impacts(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Lists:
    """A segment's postings with their scores, as an item's terms read them."""

    def __init__(self, row: dict, weights: dict[int, int], documents: int, total: int, share: int = SHARE) -> None:
        self.n_docs, self.share, sizes = len(row["n"]), share, row["sizes"]
        self.blocks = -(-self.n_docs // BLOCK)
        weight = np.array([weights[t] for t in row["terms"].tolist()], np.int64)
        m = 10 + (90 * row["n"] * documents) // total
        value = impacts(np.repeat(weight, sizes), row["tf"], m[row["docs"]])
        ends = np.cumsum(sizes)
        self.at = {int(t): (row["docs"][e - s : e], value[e - s : e]) for t, s, e, w in zip(row["terms"], sizes, ends, weight, strict=True) if w > 0}
        self.bounds: dict[int, np.ndarray] = {}

    def bound(self, term: int) -> np.ndarray:
        """The largest value of a list in each block."""
        if term not in self.bounds:
            docs, value = self.at[term]
            block, first = np.unique(docs // BLOCK, return_index=True)
            out = np.zeros(self.blocks, np.int64)
            out[block] = np.maximum.reduceat(value, first)
            self.bounds[term] = out
        return self.bounds[term]

    def search(self, terms: list[int], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that are among the k first of this segment, and maybe others; none below ``least``."""
        here = [t for t in terms if t in self.at]
        if not here:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        short = [t for t in here if len(self.at[t][0]) * self.share <= self.n_docs]
        long = sorted(set(here) - set(short), key=lambda t: -int(self.bound(t).max()))
        sums = np.zeros(self.blocks * BLOCK, np.int64)
        for t in short:  # term at a time
            docs, value = self.at[t]
            sums[docs] += value
        summed = np.flatnonzero(sums)
        if len(summed) >= k:
            least = max(least, int(np.partition(sums[summed], -k)[-k]))
        if not long:
            keep = summed[sums[summed] >= least]
            return keep, sums[keep]
        # Bounds of what lists i and later hold in each block; the accumulators come before all of them.
        later = np.zeros((len(long) + 1, self.blocks), np.int64)
        for i in range(len(long) - 1, -1, -1):
            later[i] = later[i + 1] + self.bound(long[i])
        alive = np.flatnonzero(sums.reshape(-1, BLOCK).max(axis=1) + later[0] >= least)
        docs_out, scores_out, best = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.empty(0, np.int64)
        step = 1
        while len(alive):
            blocks, alive = alive[:step], alive[step:]
            docs = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            docs = docs[docs < self.n_docs]
            score = sums[docs]
            for i, t in enumerate(long):
                able = score + later[i][docs // BLOCK] >= least
                docs, score = docs[able], score[able]
                if not len(docs):
                    break
                posted, value = self.at[t]
                place = np.minimum(np.searchsorted(posted, docs), len(posted) - 1)
                score = score + np.where(posted[place] == docs, value[place], 0)
            fine = score >= least
            docs_out.append(docs[fine])
            scores_out.append(score[fine])
            best = np.concatenate([best, score[fine]])
            if len(best) >= k:
                best = np.partition(best, -k)[-k:]
                least = max(least, int(best[0]))
                alive = alive[sums.reshape(-1, BLOCK)[alive].max(axis=1) + later[0][alive] >= least] if len(alive) else alive
            step = min(2 * step, 64)
        docs, scores = np.concatenate(docs_out), np.concatenate(scores_out)
        return docs[scores >= least], scores[scores >= least]


class Found:
    """The k first documents of an item so far, by falling score, doc_id and place."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, np.empty((0, 3), np.int64)

    @property
    def least(self) -> int:
        return max(1, int(self.rows[-1, 0])) if len(self.rows) >= self.k else 1

    def add(self, scores: np.ndarray, doc_ids: np.ndarray, places: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([scores, doc_ids, places], axis=1)])
        self.rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))][: self.k]


def _row(batch: pa.RecordBatch, i: int) -> dict[str, np.ndarray]:
    out = {c: batch.column(c)[i].values.to_numpy() for c in ("n", "terms", "sizes", "docs", "tf")}
    return out | {"doc_id": batch.column("doc_id")[i].values.fill_null(_LAST).to_numpy()}


def search(segments: DataFrame, items: list[list[int]], weights: dict[int, int], documents: int, total: int, k: int, share: int = SHARE) -> DataFrame:
    """(item, doc_id, score, place): up to k documents of each item from every task; items are lists of terms."""
    sent = segments.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        found, place = [Found(k) for _ in items], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = _row(batch, i)
                lists = Lists(row, weights, documents, total, share)
                for own, terms in zip(found, items, strict=True):
                    docs, scores = lists.search(terms, k, own.least)
                    if len(docs):
                        own.add(scores, row["doc_id"][docs], docs + place)
                place += len(row["n"])
        rows = np.concatenate([np.empty((0, 3), np.int64), *(x.rows for x in found)])
        item = np.repeat(np.arange(len(found), dtype=np.int32), [len(x.rows) for x in found])
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(rows[:, 1], mask=rows[:, 1] == _LAST), pa.array(rows[:, 0]), pa.array(rows[:, 2])], ["item", "doc_id", "score", "place"])

    return segments.mapInArrow(run, "item int, doc_id long, score long, place long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, segment: int = SEGMENT, share: int = SHARE) -> DataFrame:
    """(item_id, rank, doc_id, score): the k first documents of each item."""
    spark = docs.sparkSession
    asked = write_cut(items.filter("text IS NOT NULL").select("item_id", "text").withColumn("row", F.monotonically_increasing_id()), "items")
    waves = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES))
    first = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "place")
    out = []
    for i in range(waves):
        rows = asked.filter(F.pmod(F.xxhash64("row"), F.lit(waves)) == i).orderBy("row").collect()
        vocabulary: dict[bytes, int] = {}
        lists = [sorted({vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(r.text.encode())}) for r in rows]
        segments = write_cut(index(docs, vocabulary, segment), "segments")
        documents, total = segments.agg(F.sum("documents"), F.sum("total")).first()
        pairs = segments.select(F.explode(F.arrays_zip("terms", "sizes")).alias("p")).select("p.terms", "p.sizes")
        df = pairs.groupBy("terms").agg(F.sum("sizes")).collect()
        weights = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in df}
        best = search(segments, lists, weights, documents or 0, total or 1, k, share)
        best = best.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(j, r.item_id) for j, r in enumerate(rows)], f"item int, item_id {dict(items.dtypes)['item_id']}")
        found = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # ITEM_BYTES of items at most
        out.append(found if waves == 1 else write_cut(found, "ranked"))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), i AS (
  SELECT row_number() OVER () AS item, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark
), a AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0),
p AS (SELECT row, doc_id, len(t) AS n, unnest(t) AS term FROM d),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, a GROUP BY term, docs),
s AS (
  SELECT item, item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM i JOIN tf USING (term) JOIN w USING (term), a GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, row) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
