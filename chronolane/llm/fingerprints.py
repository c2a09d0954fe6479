"""Document fingerprints from prefix polynomial hashes.

The code points of a text are hashed into modular prefix arrays
``P[i] = sum(c[j] * B**j for j < i) mod p``. Any two spans are compared in constant
time, the longest common extension of two positions is found by binary search, and
a fingerprint keeps the hash of the whole text with the smallest hashes of its
windows.

Defined cases: a null text counts as empty; an empty text has the fingerprint
``0:...:`` without windows; a text shorter than a window is one window; equal texts
have equal fingerprints; repeated rows each give a row; an empty table gives no
rows; columns besides those named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, small_batches, table

#: The modulus is 2**31 - 1, so that a product fits in 64 bits; two bases give 62 bits together.
P = np.uint64((1 << 31) - 1)
BASES = (1_000_003_007 % int(P), 1_376_312_589 % int(P))
#: Code points in a window, and how many window hashes a fingerprint keeps.
WINDOW, KEEP = 12, 64
#: Text of a range of doc_ids, and how many ranges there are at most: their bounds go to every task.
RANGE_BYTES, RANGES = 8 << 20, 1 << 15


def _mod(x: np.ndarray) -> np.ndarray:
    """x mod 2**31 - 1 for x < 2**62."""
    x = (x & P) + (x >> np.uint64(31))
    return x - P * (x >= P)


class _Powers:
    """Powers of a base and of its inverse, grown to the longest text seen."""

    def __init__(self, base: int) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)
        self.base, self.inverse = base, pow(base, -1, int(P))

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, _mod(self.up * np.uint64(pow(self.base, k, int(P))))])
            self.down = np.concatenate([self.down, _mod(self.down * np.uint64(pow(self.inverse, k, int(P))))])
        return self.up, self.down


_POWERS = tuple(_Powers(b) for b in BASES)


class PrefixHash:
    """Prefix arrays of one text: ``span`` hashes, ``equal`` and ``lce`` answer queries on them."""

    def __init__(self, text: str | None) -> None:
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.n = len(points)
        self.prefix = []
        for powers in _POWERS:
            up, _ = powers(self.n + 1)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_mod((points + np.uint64(1)) * up[: self.n]), out=sums[1:])
            self.prefix.append(_mod(sums))

    def span(self, start, end) -> np.ndarray:
        """62-bit hash of [start, end), the same wherever the span stands; takes scalars or arrays."""
        start, end = np.asarray(start), np.asarray(end)
        out = np.uint64(0)
        for powers, prefix in zip(_POWERS, self.prefix, strict=True):
            _, down = powers(self.n + 1)
            out = (out << np.uint64(31)) | _mod(_mod(prefix[end] + P - prefix[start]) * down[start])
        return out

    def equal(self, start: int, other: PrefixHash, at: int, length: int) -> bool:
        if start + length > self.n or at + length > other.n:
            return False
        return bool(self.span(start, start + length) == other.span(at, at + length))

    def lce(self, start: int, other: PrefixHash, at: int) -> int:
        """Longest common extension to the right of ``start`` here and ``at`` there."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, at, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def fingerprint(self, window: int = WINDOW, keep: int = KEEP) -> str:
        """``length:whole hash:`` and the ``keep`` smallest mixed window hashes, 8 hex digits each."""
        head = f"{self.n}:{int(self.span(0, self.n)):016x}:"
        if not self.n:
            return head
        first = np.arange(max(1, self.n - window + 1))
        mixed = self.span(first, np.minimum(first + window, self.n)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed = (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
        few = mixed
        if self.n > 16 * keep:  # the smallest are among those below a bound that lets about 6 * keep pass
            few = mixed[mixed < np.uint64((6 * keep << 32) // self.n)]
        least = np.unique(few)
        if len(least) < keep and len(few) < len(mixed):
            least = np.unique(mixed)
        return head + least[:keep].astype(">u4").tobytes().hex()


def likeness(a: str, b: str, keep: int = KEEP) -> float:
    """Share of windows that two fingerprints have in common (Dice), from the smallest hashes of their union."""
    (n, whole_a, least_a), (m, whole_b, least_b) = a.split(":"), b.split(":")
    if (n, whole_a) == (m, whole_b):
        return 1.0
    x = {least_a[i : i + 8] for i in range(0, len(least_a), 8)}
    y = {least_b[i : i + 8] for i in range(0, len(least_b), 8)}
    if not x or not y:
        return 0.0
    union = sorted(x | y)[:keep]
    shared = sum(h in x and h in y for h in union) / len(union)
    return 2 * shared / (1 + shared)


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_chars, fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [PrefixHash(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.n for h in made], pa.int64()), pa.array([h.fingerprint() for h in made], pa.string())], ["key", "n_chars", "fingerprint"])

    kind = dict(df.dtypes)[key]
    return small_batches(df).select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_chars long, fingerprint string").withColumnRenamed("key", key)


def longest_common_extensions(df: DataFrame, left: str, right: str, left_at: str, right_at: str, out: str = "lce") -> DataFrame:
    """Add the length of the longest common extension of ``left[left_at:]`` and ``right[right_at:]`` to every row."""

    @F.pandas_udf("long")
    def run(a, b, i, j):
        import pandas as pd

        return pd.Series([PrefixHash(x).lce(int(p), PrefixHash(y), int(q)) for x, y, p, q in zip(a, b, i, j, strict=True)], dtype="int64")

    return df.withColumn(out, run(F.col(left), F.col(right), F.col(left_at), F.col(right_at)))


def _with_successor(df: DataFrame) -> DataFrame:
    """Deal (doc_id, text) into ranges of doc_id, sorted, each followed by the first rows of the next range.

    Range bounds come from quantiles, so that a range has about RANGE_BYTES of text and a partition of its own, or more
    text where RANGES of them don't do; a task reads its range as a sorted stream, so it needs no more memory. A range
    that is empty hands on to the one after it, and the last is followed by the first. The text is shuffled once,
    whatever its order in the files.
    """
    spark = df.sparkSession
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(2, min(RANGES, max(shuffle_partitions(spark), -(-size // RANGE_BYTES))))
    bounds = np.unique(np.array(df.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges), dtype=np.int64))
    low = np.iinfo(np.int64).min  # null sorts before every id

    def place(ids: pa.Array) -> np.ndarray:
        return np.searchsorted(bounds, ids.fill_null(low).to_numpy(zero_copy_only=False), side="right")

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place(batch.column(0)), pa.int64()), batch.column(0).fill_null(low)], ["place", "first"])

    least = sorted((r.place, r.first) for r in df.select("doc_id").mapInArrow(firsts, "place long, first long").groupBy("place").agg(F.min("first").alias("first")).collect())
    hands = {least[i][1]: least[i - 1][0] for i in range(len(least))}  # a first id goes to the range before its own too
    heads = np.array(sorted(hands), dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(low).to_numpy(zero_copy_only=False)
            again = np.flatnonzero(np.isin(ids, heads))
            rows = pa.array(np.concatenate([np.arange(len(ids)), again]))
            places = np.concatenate([place(batch.column(0)), np.array([hands[int(x)] for x in ids[again]], dtype=np.int64)])
            head = np.concatenate([np.zeros(len(ids), bool), np.ones(len(again), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(head), batch.column(0).take(rows), batch.column(1).take(rows)], ["place", "head", "doc_id", "text"])

    dealt = df.mapInArrow(deal, "place long, head boolean, doc_id long, text string")
    return dealt.repartitionById(len(bounds) + 1, F.col("place").cast("int")).sortWithinPartitions("place", "head", "doc_id", "text")


RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("lce_edited", pa.int64()), ("lce_next", pa.int64())])


def half_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint every text, and it with its second half replaced from the next document's beginning.

    ``near_edited`` and ``near_next`` compare fingerprints; ``lce_edited`` and ``lce_next`` are the common
    beginnings, by binary search. Ties of doc_id go by text; a single document follows itself.
    """
    df = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def judge(a, b) -> tuple:
        (doc_id, text, own, print_a), (_, after, other, print_b) = a, b
        half = own.n // 2
        edited = text[: own.n - half] + after[:half]
        changed = PrefixHash(edited)
        printed = changed.fingerprint()
        return doc_id, own.n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), print_a, printed, likeness(print_a, printed), likeness(print_a, print_b), own.lce(0, changed, 0), own.lce(0, other, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, at = None, None
        for batch in batches:
            out = []
            for place, head, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at == place and before is None:
                    continue  # more first rows of the next range: only the first follows
                made = PrefixHash(text)
                row = (doc_id, text, made, made.fingerprint())
                if at == place:
                    out.append(judge(before, row))
                before, at = None if head else row, place
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(RESULT), RESULT, strict=True)], schema=RESULT)

    return _with_successor(df).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, lce_edited long, lce_next long")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return half_edits(table(spark, sf_dir, "documents"))
