"""Benchmark decontamination: BM25 inverted index of test items, block-max WAND, question and answer overlap.

Test items are indexed; every passage of every document is a query. Items are in classes of length (32 words, 64, 128
and so on); for each class passages are windows of twice its length, half overlapping, so an item lies whole in one of
them, and no longer item changes what a shorter one is compared with. A term's weight in an item is its BM25 weight
over the item's score for itself; an item is retrieved when a passage gives it at least ``least`` of that score.
Postings are in blocks of items with the largest weight of each; a bound over blocks, for some passages of a document
at once, and the WAND pivot skip what can't reach the threshold, and nothing else is skipped. A retrieved item counts
when the passage holds enough of the word 4-grams of its question and of its answer.

The index is broadcast: up to INDEX_BYTES of test text at a time (about ten times that in a worker), items dealt by
hash, and more in further passes over the documents; hits don't depend on the number of passes. A task holds BOUND
sums of bounds at a time, however long a text is.

Defined cases: null or empty texts and items match nothing; an item without a question mark is split before its last
sentence, or in half if either side has under three words; repeated items and rows each give rows; a document without
a hit has none; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

K1, B = 1.2, 0.75
#: Share of an item's own score that retrieves it, and of 4-grams of question and answer that confirm it.
LEAST, OVERLAP, GRAM = 0.6, 0.6, 4
#: Items in a block of a posting list, and in one index.
BLOCK, ITEMS = 2, 1024
#: Test text that is sent to the tasks at once, and sums of bounds, or posting blocks added to them, held at once.
INDEX_BYTES, BOUND = 8 << 20, 1 << 20
#: Words of the shortest class of items.
SHORTEST = 32

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words before and after the last question mark, else before and in the last sentence, else halves."""
    text = text.strip()
    cut = text.rstrip(" ?\n\t").rfind("?") + 1 or max((m.end() for m in re.finditer(r"[.!?\n]\s+", text)), default=0)
    q, a = words_of(text[:cut]), words_of(text[cut:])
    if min(len(q), len(a)) < 3:
        w = q + a
        q, a = w[: (len(w) + 1) // 2], w[(len(w) + 1) // 2 :]
    return q, a


def grams(words: list, n: int = GRAM) -> set[tuple]:
    n = min(n, len(words))
    return set(zip(*[words[i:] for i in range(n)], strict=False)) if n else set()


def class_of(words: int) -> int:
    """Words of the class of items that one of so many words is in."""
    return SHORTEST * (1 << max(0, math.ceil(math.log2(max(1, words) / SHORTEST))))


class Index:
    """Postings of items of one class, in item order, with weights normalised by each item's own score."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n: int, mean_length: float, step: int) -> None:
        self.ids, self.step = [i for i, _ in items], step
        self.terms: dict[str, int] = {}
        code = lambda w: self.terms.setdefault(w, len(self.terms))
        self.parts = [tuple(np.array([code(w) for w in side], np.int32) for side in question_and_answer(t)) for _, t in items]
        term, item, weight = [], [], []
        for at, (_, text) in enumerate(items):
            counts = Counter(words_of(text))
            length = sum(counts.values())
            w = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean_length)) for t, f in counts.items()}
            own = sum(w.values())
            for t, x in w.items():
                term.append(code(t))
                item.append(at)
                weight.append(x / own)
        term, item, weight = np.array(term, np.int64), np.array(item, np.int64), np.array(weight, np.float64)
        order = np.lexsort((item, term))
        self.item, self.weight = item[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.weight, self.start[:-1]) if len(term) else np.zeros(0)
        # Blocks of each posting list, with the largest weight in each.
        self.blocks = -(-len(items) // BLOCK)
        key = term[order] * self.blocks + self.item // BLOCK
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.block = key[first] % max(1, self.blocks)
        self.block_most = np.maximum.reduceat(self.weight, first) if len(key) else np.zeros(0)
        self.block_start = np.searchsorted(key[first] // max(1, self.blocks), np.arange(len(self.terms) + 1))

    def codes(self, words: list[str]) -> np.ndarray:
        """Numbers of words; those that no item has share the one after the last."""
        return np.fromiter((self.terms.get(w, len(self.terms)) for w in words), np.int64, len(words))

    def bound(self, term: int, block: int) -> float:
        """Largest weight of a term in a block of items."""
        low, high = self.block_start[term], self.block_start[term + 1]
        at = low + int(np.searchsorted(self.block[low:high], block))
        return float(self.block_most[at]) if at < high and self.block[at] == block else 0.0

    def promising(self, codes: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
        """Passages (two steps long) that a block of items may be retrieved by, and those blocks."""
        none, step = len(self.terms), self.step
        known = np.flatnonzero(codes < none)
        if not len(known):
            return
        steps = -(-len(codes) // step)
        seen = np.unique(known // step * none + codes[known])
        step_of, code = seen // none, seen % none
        size = self.block_start[code + 1] - self.block_start[code]
        ends = np.searchsorted(step_of, np.arange(1, steps + 1))
        work = np.r_[0, np.cumsum(size)][ends]  # posting blocks up to the end of each step
        at, before = 0, np.zeros((0, self.blocks))
        while at < steps:
            base = work[at - 1] if at else 0
            upto = max(at + 1, min(at + BOUND // self.blocks, int(np.searchsorted(work, base + BOUND, side="right"))))
            rows = slice(ends[at - 1] if at else 0, ends[upto - 1])
            n = size[rows]
            posting = np.repeat(self.block_start[code[rows]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            cell = np.repeat(step_of[rows] - at, n) * self.blocks + self.block[posting]
            sums = np.bincount(cell, self.block_most[posting], (upto - at) * self.blocks).reshape(-1, self.blocks)
            sums = np.concatenate([before, sums])
            two = sums[:-1] + sums[1:] if steps > 1 else sums  # a text of one step is one passage
            passage, block = np.nonzero(two >= least - 1e-9)
            for p in np.unique(passage):
                yield int(p) + at - len(before), block[passage == p]
            before, at = sums[-1:], upto

    def retrieve(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All items to which the distinct ``terms`` give at least ``least``: WAND with block maxima."""
        lists = [[int(self.start[k]), k] for k in terms]  # position in the postings, term
        out, last = [], len(self.ids)
        end = {k: int(self.start[k + 1]) for k in terms}
        here = lambda c: int(self.item[c[0]]) if c[0] < end[c[1]] else last

        def seek(c: list[int], item: int) -> None:
            c[0] += int(np.searchsorted(self.item[c[0] : end[c[1]]], item))

        while True:
            lists = sorted((c for c in lists if here(c) < last), key=here)
            bound, pivot = 0.0, None
            for at, c in enumerate(lists):
                bound += self.most[c[1]]
                if bound >= least - 1e-9:
                    pivot = at
                    break
            if pivot is None:
                return out
            item = here(lists[pivot])
            while pivot + 1 < len(lists) and here(lists[pivot + 1]) == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.bound(c[1], block) for c in lists[: pivot + 1]) < least - 1e-9:
                # No item of this block can follow from these lists; go on behind it, or where the next list joins.
                after = min((block + 1) * BLOCK, here(lists[pivot + 1]) if pivot + 1 < len(lists) else last)
                for c in lists[: pivot + 1]:
                    seek(c, max(after, item + 1))
                continue
            for c in lists[:pivot]:
                if here(c) < item:
                    seek(c, item)
            score = sum(float(self.weight[c[0]]) for c in lists if here(c) == item)
            if score >= least - 1e-9:
                out.append((item, score))
            for c in lists:
                if here(c) == item:
                    c[0] += 1

    def with_blocks(self, terms: np.ndarray, blocks: np.ndarray) -> list[int]:
        """Those of ``terms`` that have a posting in one of ``blocks``; the others add nothing."""
        wanted = np.zeros(self.blocks, bool)
        wanted[blocks] = True
        return [int(t) for t in terms if wanted[self.block[self.block_start[t] : self.block_start[t + 1]]].any()]


def _indexes(items: DataFrame) -> Iterator[list[Index]]:
    """Indexes over all items, in lists of about INDEX_BYTES of text; document frequencies cover all items."""
    spark = items.sparkSession

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(w) for w in words], pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))], ["n", "terms"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.length(F.trim("text")) > 0)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    if not size:
        return
    words = rows.select("text").mapInArrow(split, "n long, terms array<string>")
    n, mean_length = words.agg(F.count("*"), F.avg("n")).first()
    passes = -(-size // INDEX_BYTES)
    placed = rows.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(passes)))
    for part in range(passes):
        texts = [(i, t) for _, t, i in sorted((r.item_id if r.item_id is not None else -1, r.text, r.item_id) for r in placed.filter(F.col("part") == part).collect())]
        mine = {w for _, t in texts for w in words_of(t)}
        if passes == 1:
            df = Counter(w for _, t in texts for w in set(words_of(t)))
        else:
            terms = spark.createDataFrame([(w,) for w in mine], "term string")
            df = {r.term: r["count"] for r in words.select(F.explode("terms").alias("term")).join(terms, "term", "left_semi").groupBy("term").count().collect()}
        classes: dict[int, list] = {}
        for i, t in texts:
            classes.setdefault(class_of(len(words_of(t))), []).append((i, t))
        yield [Index(found[k : k + ITEMS], df, n, max(1.0, mean_length), step) for step, found in sorted(classes.items()) for k in range(0, len(found), ITEMS)]


HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])


def _hits_in(words: list[str], indexes: list[Index], least: float, overlap: float) -> Iterator[tuple]:
    """(item_id, first word of the passage, score, question overlap, answer overlap), the best passage of each item."""
    for index in indexes:
        codes, step = index.codes(words), index.step
        best: dict[int, tuple] = {}
        for passage, blocks in index.promising(codes, least):
            start = passage * step
            here = np.unique(codes[start : start + 2 * step])
            found = [(i, s) for i, s in index.retrieve(index.with_blocks(here[here < len(index.terms)], blocks), least) if i // BLOCK in blocks]
            if found:
                run = codes[start : start + 2 * step].tolist()
                have = grams(run)
                for item, score in found:
                    shares = []
                    for part in index.parts[item]:
                        want = grams(part.tolist())
                        seen = have if len(part) >= GRAM else grams(run, len(part))  # too short for a 4-gram: as a run of words
                        shares.append(len(want & seen) / len(want) if want else 1.0)
                    if min(shares) >= overlap:
                        best[item] = max(best.get(item, (-1.0,)), (score, -start, *shares))
        for item, (score, start, q, a) in best.items():
            yield index.ids[item], -start, score, q, a


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, first_word, score, question_overlap, answer_overlap): every item that a document holds."""
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    columns = "doc_id long, item_id long, first_word long, score double, question_overlap double, answer_overlap double"
    out = None
    for indexes in _indexes(items):
        shared = rows.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = [(doc, *hit) for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) if text for hit in _hits_in(words_of(text), shared.value, least, overlap)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*hits, strict=True) if hits else [[]] * len(HITS), HITS, strict=True)], schema=HITS)

        found = rows.mapInArrow(run, columns)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else rows.sparkSession.createDataFrame([], columns)


def _leak_test(shared, least: float, overlap: float):
    @F.pandas_udf("boolean")
    def leaks(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(t) and any(True for _ in _hits_in(words_of(t), shared.value, least, overlap)) for t in texts], dtype=bool)

    return leaks


def without_leaks(docs: DataFrame, items: DataFrame, least: float = LEAST, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` that hold no item; judged row by row, so ids play no part."""
    for indexes in _indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)
        docs = small_batches(docs).filter(~_leak_test(shared, least, overlap)("text"))
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
