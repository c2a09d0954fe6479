import hashlib
import random

import pytest

from chronolane.llm import fingerprints as module
from chronolane.llm.fingerprints import PrefixHash, fingerprints, half_edits, likeness, longest_common_extensions


def test_spans_and_extensions_against_slices():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ("".join(rng.choice("ab\x00\U0001f600") for _ in range(rng.randint(0, 40))) for _ in range(2))
        x, y = PrefixHash(a), PrefixHash(b)
        for _ in range(20):
            i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
            n = rng.randint(0, 8)
            assert x.equal(i, y, j, n) == (i + n <= len(a) and j + n <= len(b) and a[i : i + n] == b[j : j + n])
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            assert x.lce(i, y, j) == k


@pytest.mark.parametrize("most", [1, 3, 1 << 15])
def test_half_edits_against_brute_force(spark, monkeypatch, most):
    """However few ranges there are, one text of which is very long."""
    monkeypatch.setattr(module, "RANGES", most)
    rng = random.Random(4)
    texts = ["né " * 60_000] * (most == 3) + ["".join(rng.choice("abcde fghé") for _ in range(rng.choice([0, 1, 2, 15, 300]))) for _ in range(60)] + [None, "same", "same"]
    ids = rng.sample(range(-500, 5000), len(texts))
    rows = [(i, t, "x", 1) for i, t in zip(ids, texts, strict=True)]
    out = {r.doc_id: r for r in half_edits(spark.createDataFrame(rows, "doc_id long, text string, place string, head int")).collect()}
    order = sorted((i, t or "") for i, t, *_ in rows)
    assert len(out) == len(order)
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == PrefixHash(t).fingerprint() and r.edited_fingerprint == PrefixHash(edited).fingerprint()
        assert r.near_edited == likeness(r.fingerprint, r.edited_fingerprint) and r.near_next == likeness(r.fingerprint, PrefixHash(after).fingerprint())


def test_ties_one_row_and_no_row(spark):
    one = half_edits(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    tied = half_edits(spark.createDataFrame([(5, "ab"), (5, "ab"), (5, "zz"), (None, "q")], "doc_id long, text string"))
    assert tied.count() == 4
    assert half_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_likeness_of_half_and_other_texts():
    rng = random.Random(6)
    make = lambda: "".join(rng.choice("abcdefghij ") for _ in range(3000))
    a, b = make(), make()
    assert likeness(PrefixHash(a).fingerprint(), PrefixHash(a).fingerprint()) == 1.0
    assert 0.3 < likeness(PrefixHash(a).fingerprint(), PrefixHash(a[:1500] + b[:1500]).fingerprint()) < 0.7
    assert likeness(PrefixHash(a).fingerprint(), PrefixHash(b).fingerprint()) < 0.05


def test_frame_operators(spark):
    df = spark.createDataFrame([(1, "abcx", "zabcy", 0, 1), (2, None, "a", 0, 0)], "k long, a string, b string, i long, j long")
    assert [r.lce for r in longest_common_extensions(df, "a", "b", "i", "j").orderBy("k").collect()] == [3, 0]
    assert fingerprints(df, "k", "a").filter("k = 1").first().fingerprint == PrefixHash("abcx").fingerprint()
