import random

import pytest

from chronolane.llm import jaccard

SCHEMA = "doc_id long, text string, n long, digest string"


def brute(rows, words, num, den):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]
            linked = shared and den * shared >= num * len(sets[i] | sets[j])
            if linked:
                links[i] += 1
                links[j] += 1
            if linked or same_id:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), min(x for x in groups[find(i)] if x is not None), links[i]) for i in range(len(rows)) if rows[i][0] is not None))


def corpus(seed, near):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    passage = [rng.choice(vocab) for _ in range(25)]
    for size in (1, 2, 3, 5, 8, 12, 20, 60, 150):
        for _ in range(3):
            base = [rng.choice(vocab) for _ in range(size)]
            for _ in range(near):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, size // 30))):
                    copy[rng.randrange(size)] = rng.choice(vocab)
                if rng.random() < 0.3:
                    copy += passage[: rng.randint(0, 3)]
                rows.append(" ".join(copy))
    rows += [None, "", " \n\t", "A b", "a B", "a\x0bb", "é É"]
    rows += [" ".join(passage + [rng.choice(vocab) for _ in range(20)]) for _ in range(20)]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("words,num,den", [(3, 90, 100), (5, 80, 100)])
def test_components_equal_brute_force(spark, words, num, den):
    rows = corpus(words, 6)
    out = jaccard.jaccard_components(spark.createDataFrame([(i, t, 5, "x") for i, t in rows], SCHEMA), words, num, den, count_links=True).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in out) == brute(rows, words, num, den)


def test_chain_of_near_copies_that_only_touch_neighbours(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)  # so that tiles and components have several blocks
    rng = random.Random(3)
    words = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(40):
        rows.append((1000 - i, " ".join(words)))
        for _ in range(2):
            words[rng.randrange(200)] = f"x{i}{rng.random()}"
    out = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100, count_links=True).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in out) == brute(rows, 3, 90, 100)


def test_two_texts_under_one_doc_id_lose_no_link(spark):
    rng = random.Random(8)
    rows = []
    for i in range(10):
        for k in range(2):
            words = [f"u{rng.randrange(5000)}" for _ in range(120)]
            rows.append((i, " ".join(words)))
            words[60] = "changed"
            rows.append((100 + 2 * i + k, " ".join(words)))
    rows += [(rows[0][0], rows[0][1]), (55, ""), (55, rows[4][1])]
    out = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100, count_links=True).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in out) == brute(rows, 3, 90, 100)
    assert {r.component_id for r in out if r.doc_id >= 100} <= set(range(10))


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100)])
def test_unrelated_sets_share_no_large_tile(num, den):
    from collections import Counter

    import numpy as np

    rng = np.random.default_rng(4)
    for n in (4, 6, 8, 10, 20, 50):
        tiles = Counter(s for _ in range(4000) for s in set(jaccard.signatures(np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)), num, den).tolist()))
        assert max(tiles.values(), default=0) <= 4


@pytest.mark.parametrize("near", [0.0, 1.0])
def test_links_of_blocks_equal_pairwise_comparison(near):
    import numpy as np

    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    draw = lambda: np.unique(np.r_[rng.permutation(base)[rng.integers(0, 30) :], rng.integers(0, 1 << 63, rng.integers(0, 30)).astype(np.uint64)] if rng.random() < near else rng.integers(0, 1 << 63, 300).astype(np.uint64))
    left, right = [draw() for _ in range(150)], [draw() for _ in range(120)]
    want = [[90 * len(np.union1d(a, b)) <= 100 * len(np.intersect1d(a, b)) for b in right] for a in left]
    assert jaccard.links_between(left, right, 90, 100).tolist() == want
    assert np.any(want) == bool(near)


def test_very_long_text_and_its_near_copy(spark):
    words = [f"w{i}" for i in range(120_000)]
    other = list(words)
    other[77_000] = "x"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:60_000]))]
    out = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100, count_links=True).collect()
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in out) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_signatures_of_linked_sets_always_share_a_tile():
    import numpy as np

    rng = np.random.default_rng(5)
    for num, den in ((90, 100), (80, 100)):
        for n in [*range(1, 60), 100, 333, 1000]:
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            for _ in range(5):
                most = len(a) * (den - num) // (den + num)
                gone, new = rng.integers(0, most + 1), rng.integers(0, most + 1)
                b = np.unique(np.r_[rng.permutation(a)[gone:], rng.integers(0, 1 << 63, new).astype(np.uint64) * np.uint64(2) + np.uint64(1)])
                shared = len(np.intersect1d(a, b))
                if len(b) and shared < max(len(a), len(b)) and den * shared >= num * (len(a) + len(b) - shared):  # equal sets are one class
                    assert set(jaccard.signatures(a, num, den).tolist()) & set(jaccard.signatures(b, num, den).tolist())


def test_empty_and_null_ids_and_repeated_rows(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e f g"), (7, "a b c d e f g"), (7, "a b c d e f g"), (None, "z"), (3, None)]
    out = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.component_id or 0) for r in out) == [(0, 0), (0, 7), (3, 3), (7, 7), (7, 7)]


def hidden_triple(words, num, den, seed):
    """L, X, Y: X and Y are linked, L with neither, and every tile of both X and Y has L in it, as its first member."""
    shingle, rng = jaccard.Shingler(words), random.Random(seed)
    linked = lambda a, b: den * len(a & b) >= num * len(a | b)
    for _ in range(20_000):
        n = rng.randint(30, 90)
        base = [f"a{rng.randrange(10**6)}" for _ in range(n)]
        tail = rng.randint(2, 12)
        shared = [f"b{rng.randrange(10**6)}" for _ in range(tail)]
        texts = [base]
        for k in range(2):
            own = list(base[: n - tail] + shared)
            own[n - rng.randint(1, 2)] = f"c{k}{rng.randrange(10**6)}"
            texts.append(own)
        hashes = [shingle(" ".join(t)) for t in texts]
        sets = [set(h.tolist()) for h in hashes]
        tiles = [set(jaccard.signatures(h, num, den).tolist()) for h in hashes]
        if linked(sets[1], sets[2]) and not linked(sets[0], sets[1]) and not linked(sets[0], sets[2]) and tiles[1] & tiles[2] <= tiles[0]:
            return [" ".join(t) for t in texts]
    raise AssertionError("no triple found")


@pytest.mark.parametrize(("words", "num", "den", "seed"), [(3, 90, 100, 1), (5, 80, 100, 2), (3, 90, 100, 3)])
def test_a_refused_first_pair_hides_no_linked_one(spark, words, num, den, seed):
    rows = list(enumerate(hidden_triple(words, num, den, seed)))
    out = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), words, num, den, count_links=True).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in out) == brute(rows, words, num, den)
    assert {r.doc_id: r.component_id for r in out} == {0: 0, 1: 1, 2: 1}


def test_tiles_are_gathered_in_passes_that_each_hold_a_part_of_the_offers(spark, monkeypatch):
    rows = corpus(5, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in (("PASS", 256), ("SPLIT", 4), ("BROADCAST_BYTES", 0)):
        monkeypatch.setattr(jaccard, name, value, raising=False)
    monkeypatch.setattr("chronolane.llm.common.BROADCAST_BYTES", 0)  # all sides shuffle
    sizes, write = [], jaccard.write_cut

    def noted(df, name):
        out = write(df, name)
        if name == "tiles":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "write_cut", noted)
    out = jaccard.jaccard_components(docs, 5, 80, 100, count_links=True).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in out) == brute(rows, 5, 80, 100)
    assert len(sizes) == 8 and max(sizes) < sum(sizes) / 4


def test_a_set_offers_each_key_in_one_slice(spark):
    import numpy as np

    rows = corpus(3, 2)
    made = jaccard.features(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    shingle = jaccard.Shingler(3)
    for r in made:
        slices = [r[f"sigs{k}"] for k in range(jaccard.SLICES)]
        assert sorted(s for part in slices for s in part) == sorted(jaccard.signatures(shingle(rows[r.doc_id][1]), 90, 100).view(np.int64).tolist())
        assert all(s % jaccard.SLICES == k for k, part in enumerate(slices) for s in part)


def test_only_what_the_result_reads_is_left(spark):
    from pathlib import Path

    from chronolane.llm.common import cuts, cuts_since

    mark = cuts()
    out = jaccard.jaccard_components(spark.createDataFrame(corpus(5, 3), "doc_id long, text string"))
    read = {Path(f).parent.name for f in out.inputFiles()}
    assert {path.rpartition("/")[2] for path in cuts_since(mark)} == read
    assert not any(name.startswith(("features", "tiles", "members", "arrays", "likely")) for name in read) and out.count()


def test_shuffle_files_go_when_a_cut_is_written(spark):
    import time

    from pyspark.sql import functions as F

    from chronolane.llm.common import SHUFFLE_CLEANUP, write_cut

    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    there, set_before = files(), spark.conf.get(SHUFFLE_CLEANUP)
    again = spark.range(20_000).withColumn("k", F.col("id") % 700).groupBy("k").agg(F.sum("id").alias("n"))
    out = write_cut(again, "sums")
    for _ in range(50):
        if not files() - there:
            break
        time.sleep(0.1)
    assert not files() - there and spark.conf.get(SHUFFLE_CLEANUP) == set_before
    assert out.count() == 700 and again.count() == 700
