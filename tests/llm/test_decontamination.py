import math
import random
from collections import Counter

import numpy as np
import pytest

from chronolane.llm import decontamination as d

DOCS, ITEMS = "doc_id long, text string, score double, item_id string", "item_id long, text string, answer string"


def world(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(600)] + ["the", "of", "and"] * 60
    sentence = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, f"{sentence(rng.randint(8, 25))}? {sentence(rng.randint(4, 9))}.", "x") for i in range(30)] + [(98, None, "x"), (99, "", "x"), (3, "w1 w2 w3", "x")]
    docs, planted = [], set()
    for k in range(60):
        parts = [sentence(rng.randint(0, 300))]
        if k % 3 == 0:
            i, text, _ = items[rng.randrange(30)]
            parts += [text.upper() if k % 2 else text, sentence(rng.randint(0, 200))]
            planted.add((k, i))
        docs.append((k, "\n".join(parts), 0.0, "x"))
    docs += [(900, None, 0.0, "x"), (901, "", 0.0, "x"), (902, "the of and " * 3000, 0.0, "x"), (0, docs[0][1], 0.0, "x")]
    return docs, items, planted


def test_planted_items_are_found_and_nothing_else(spark):
    docs, items, planted = world()
    out = d.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    long = {(r.doc_id, r.item_id) for r in out if r.item_id != 3 or (r.doc_id, 3) in planted}
    assert long == planted and len([r for r in out if r.doc_id == 0]) >= 2
    kept = {r.doc_id for r in d.without_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert not kept & {k for k, _ in planted} and {900, 901, 902} <= kept
    assert kept == {r[0] for r in docs} - {r.doc_id for r in out}


def test_wand_retrieves_what_full_scoring_does():
    docs, items, _ = world(2)
    items = [(i, t) for i, t, _ in items if t]
    df = Counter(w for _, t in items for w in set(d.words_of(t)))
    index = d.Index(items, df, len(items), np.mean([len(d.words_of(t)) for _, t in items]), 32)
    rng = random.Random(1)
    for least in (0.05, 0.2, 0.6):
        for _ in range(150):
            terms = sorted(rng.sample(range(len(index.terms)), rng.randint(1, 60)))
            full = np.zeros(len(items))
            for t in terms:
                full[index.item[index.start[t] : index.start[t + 1]]] += index.weight[index.start[t] : index.start[t + 1]]
            assert {i for i, _ in index.retrieve(terms, least)} == set(np.flatnonzero(full >= least - 1e-9).tolist())


@pytest.mark.parametrize("bound", [1 << 20, 40])
def test_bounds_never_drop_a_passage(monkeypatch, bound):
    monkeypatch.setattr(d, "BOUND", bound)
    docs, items, _ = world(3)
    items = [(i, t) for i, t, _ in items if t]
    df = Counter(w for _, t in items for w in set(d.words_of(t)))
    index = d.Index(items, df, len(items), np.mean([len(d.words_of(t)) for _, t in items]), 32)
    for _, text, *_ in docs:
        words = d.words_of(text)
        codes = index.codes(words)
        found = dict(index.promising(codes, 0.3))
        for p in range(max(1, math.ceil(len(words) / 32) - 1)):
            full = np.zeros(len(items))
            for t in set(codes[p * 32 : p * 32 + 64].tolist()) - {len(index.terms)}:
                full[index.item[index.start[t] : index.start[t + 1]]] += index.weight[index.start[t] : index.start[t + 1]]
            for i in np.flatnonzero(full >= 0.3):
                assert i // d.BLOCK in found[p]


def plain_hits(words, items, least, overlap):
    """Every item against every passage of its class, without index or bounds."""
    n, df = len(items), Counter(w for _, t in items for w in set(d.words_of(t)))
    mean = sum(len(d.words_of(t)) for _, t in items) / n
    out = set()
    for item_id, text in items:
        counts = Counter(d.words_of(text))
        length = sum(counts.values())
        weight = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean)) for t, f in counts.items()}
        step = 32
        while step < length:
            step *= 2
        for start in range(0, max(1, len(words) - step), step):
            run = words[start : start + 2 * step]
            if sum(weight[t] for t in set(run) & set(weight)) >= least * sum(weight.values()) - 1e-9:
                shares = []
                for part in d.question_and_answer(text):
                    k = min(4, len(part))
                    want = {tuple(part[i : i + k]) for i in range(len(part) - k + 1)} if k else set()
                    have = {tuple(run[i : i + k]) for i in range(len(run) - k + 1)} if k else set()
                    shares.append(len(want & have) / len(want) if want else 1.0)
                if min(shares) >= overlap:
                    out.add(item_id)
    return out


@pytest.mark.parametrize("passes", [1, 4])
def test_hits_equal_brute_force(spark, monkeypatch, passes):
    docs, items, _ = world(4)
    rng = random.Random(4)
    long = " ".join(f"l{rng.randrange(300)}" for _ in range(90))
    items = [(i, t, x) for i, t, x in items if t] + [(50, long + "? " + long[:40], "y")]
    edited = [w for w in items[5][1].split() if rng.random() > 0.1]
    docs += [(70, "w5 " * 40 + long + "? " + long[:40], 0.0, "x"), (71, "w7 " * 90 + " ".join(edited), 0.0, "x")]
    if passes > 1:
        monkeypatch.setattr(d, "INDEX_BYTES", sum(len(t) for _, t, _ in items) // passes)
    got = {(r.doc_id, r.item_id) for r in d.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    want = {(k, i) for k, t, *_ in docs if t for i in plain_hits(d.words_of(t), [(i, t) for i, t, _ in items], d.LEAST, d.OVERLAP)}
    assert got == want


def test_edited_items_are_still_found():
    """Recall of items with three words replaced, two in the question and the last one."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(30)) + "? " + " ".join(rng.choice(vocab) for _ in range(12)) + ".") for i in range(200)]
    df = Counter(w for _, t in items for w in set(d.words_of(t)))
    index = d.Index(items, df, len(items), 42.0, 64)
    found = 0
    for i, t in items:
        words = d.words_of(t)
        for k in (10, 22, len(words) - 1):
            words[k] = "changed"
        words = [rng.choice(vocab) for _ in range(100)] + words + [rng.choice(vocab) for _ in range(100)]
        found += any(hit[0] == i for hit in d._hits_in(words, [index], d.LEAST, d.OVERLAP))
    assert found >= 0.95 * len(items)


def test_memory_of_a_very_long_text():
    import tracemalloc

    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(28))) for i in range(1024)]
    df = Counter(w for _, t in items for w in set(d.words_of(t)))
    index = d.Index(items, df, len(items), 28.0, 32)
    codes = index.codes([rng.choice(vocab) for _ in range(400_000)])
    tracemalloc.start()
    assert sum(1 for _ in index.promising(codes, 0.6)) >= 0
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_question_and_answer_split():
    assert d.question_and_answer("What is it now? It is a cat.") == (["what", "is", "it", "now"], ["it", "is", "a", "cat"])
    assert d.question_and_answer("One two three four. Five six seven.")[1] == ["five", "six", "seven"]
    assert d.question_and_answer("a b c d. E.") == (["a", "b", "c"], ["d", "e"])


def test_several_index_passes_and_empty_tables(spark, monkeypatch):
    docs, items, planted = world()
    monkeypatch.setattr(d, "INDEX_BYTES", 900)
    out = {(r.doc_id, r.item_id) for r in d.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert planted <= out
    assert d.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).count() == 0
    assert d.contaminated(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0
