"""Hybrid ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest

from chronolane.llm import ranked
from chronolane.llm.ranked import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    bags = [(i, d, Counter(terms(t))) for i, (d, t) in enumerate(docs)]
    bags = [x for x in bags if x[2]]
    n, total = len(bags), sum(b.total() for _, _, b in bags)
    out = []
    for item_id, text in items:
        scored = []
        for row, d, bag in bags:
            m = 10 + 90 * bag.total() * n // total
            score = 0
            for t in set(terms(text)) & set(bag):
                df = sum(t in b for _, _, b in bags)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, row))
        out += [(item_id, r, None if none else d, -s) for r, (s, none, d, _) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k=3, **how):
    docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS n", "3 AS terms")
    items = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS row")
    return sorted((tuple(r) for r in ranked_search(docs, items, k, **how).collect()), key=str)


def corpus(seed, n, words, size):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{min(int(rng.paretovariate(0.7)), words)}" for _ in range(rng.randint(1, size)))) for i in range(n)]


@pytest.mark.parametrize(("segment", "share"), [(16384, 32), (16384, 4), (37, 1000), (200, 1)])
def test_random_corpus(spark, segment, share):
    docs, items = corpus(1, 300, 60, 40), corpus(2, 12, 60, 9)
    assert found(spark, docs, items, segment=segment, share=share) == brute(docs, items, 3)


def test_lists_are_skipped():
    """Documents of a block whose bound is too low are never looked at, and the result stays exact."""
    import numpy as np

    n = 64 * 40
    docs, tf = np.arange(n), np.ones(n, np.int64)
    tf[1000:1010] = 50
    row = {"n": np.full(n, 60), "terms": np.array([0, 1]), "sizes": np.array([n, 3]), "docs": np.concatenate([docs, [1001, 1005, 2000]]), "tf": np.concatenate([tf, [1, 1, 1]])}
    lists = ranked.Lists(row, {0: 700, 1: 6000}, n, 60 * n)
    docs, scores = lists.search([0, 1], 3, 1)
    top = docs[np.lexsort((docs, -scores))][:3]
    assert set(top[:2].tolist()) == {1001, 1005} and top[2] == 2000 and len(docs) < 64


def test_waves_of_items(spark, monkeypatch):
    monkeypatch.setattr(ranked, "ITEM_BYTES", 100)
    docs, items = corpus(3, 80, 40, 30), corpus(4, 20, 40, 8)
    assert found(spark, docs, items) == brute(docs, items, 3)


def test_ties_nulls_repeats_and_very_long_texts(spark):
    docs = [(i, "Über-Größe e-mail ÜBER x1 x1") for i in range(50, 0, -1)] + [(7, "x1"), (7, "x1"), (None, "x1 y"), (1, None), (2, ""), (3, "… –"), (4, "--- \t"), (9, "long " * 50_000 + "x1 größe")]
    items = [(1, "X1 größe"), (1, "X1 größe"), (2, None), (3, ""), (4, "nothing here"), (None, "über über LONG"), (5, "mail-y")]
    assert found(spark, docs, items) == brute(docs, items, 3)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []
