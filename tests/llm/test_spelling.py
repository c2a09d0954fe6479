"""Permuterm variants against comparing every two words."""

import random
import zlib
from collections import Counter

import pytest

from chronolane.llm import spelling
from chronolane.llm.spelling import misspelt, spelling_groups


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, seen, times):
    counts = {w: n for w, n in Counter(words).items() if n >= seen}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= times * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], counts.get(form[w]), root))
    return sorted(out)


def found(spark, words, seen=2, times=10):
    rows = spelling_groups(spark.createDataFrame([(w,) for w in words], "word string"), seen, times)
    return sorted(tuple(r) for r in rows.select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_random_words(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    words = [w for w in base for _ in range(rng.choice([1, 2, 3, 7, 20, 45, 200]))]
    assert found(spark, words, 2, 3) == brute(words, 2, 3)


def test_runs_of_one_letter_and_chains(spark):
    words = ["aab"] * 2 + ["aaab"] * 25 + ["aaaab"] * 300 + ["aaaaab"] * 4000 + ["zab"] * 4000 + ["ab"] * 4000
    want = brute(words, 2, 10)
    assert found(spark, words) == want
    assert {r[5] for r in want if r[0] == "aaab"} == {"aaaaab"} and {r[3] for r in want if r[0] == "aab"} == {"ab"}  # the tie goes by code point


def test_long_words_go_by_digest(spark, monkeypatch):
    long = "xy" * 60
    words = [long] * 40 + [long[:50] + long[51:]] * 2 + [long[:70] + "é" + long[71:]] * 3 + [long[::-1]] * 5
    assert found(spark, words) == brute(words, 2, 10)
    monkeypatch.setattr(spelling, "LONG", 3)
    short = ["abcdef"] * 30 + ["abcdf"] * 2 + ["abcdeg"] * 2 + ["bcdef"] * 3
    assert found(spark, short) == brute(short, 2, 10)


def test_letters_lost_by_hash(spark):
    rng = random.Random(5)
    rows = [(i if i % 7 else None, " ".join(rng.choice(["Erblest", "Übergrößen", "über-alles", "aaaaaaa", "été", "ÀÉÎÕÜØÞ", "日本語abcdefgh"]) for _ in range(40))) for i in range(60)] + [(5, None), (6, ""), (7, "…")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS word", "1 AS n", "text AS run")
    want = []
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "z" else c
                continue
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if run and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want += [run] if len(run) >= 7 else []
            run = ""
    assert Counter(r.word for r in misspelt(docs, 7, 31).collect()) == Counter(want)


def test_empty_and_refused(spark):
    assert found(spark, []) == [] and found(spark, ["alone"]) == []
    assert found(spark, ["twice", "twice"]) == [("twice", 2, 0, None, None, "twice")]
    with pytest.raises(ValueError):
        spelling_groups(spark.createDataFrame([], "word string"), 2, 1)
