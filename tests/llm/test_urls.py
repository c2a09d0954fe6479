import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronolane.llm.urls import ORDER, RULES, judge_urls

SCHEMA = "page_id long, url string, host string, url_host string"


def brute(url):
    m = re.match(r"^.*?://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    best = None
    for rule, _ in RULES:
        at, _, begins = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + begins) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


def urls():
    rng = random.Random(3)
    tlds, langs = ["com", "org", "net", "example.org", "EXAMPLE.ORG"], ["en", "es", "fr", "de"]
    out = [f"https://{rng.choice(['www.', '', 'm.', 'x.example.'])}{rng.choice(tlds)}/{rng.choice(langs)}/{rng.randint(1, 99)}{rng.choice(['', '?q=/x', '#t', '.html'])}" for _ in range(300)]
    return out + [None, "", "no scheme", "://", "a://B.Org", "http://org/", "http://forg/", "http://x.com?/fr/", "http://é.com/fr/é", "http://a://b.org/", "http://u@h.org:80/x\ny", "http://com/fr", "x" * 50000]


def test_rules_against_brute_force_and_every_url_judged(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(urls())]
    out = judge_urls(spark.createDataFrame(rows, SCHEMA)).collect()
    verdicts = dict(RULES)
    assert len(out) == len(rows)
    for r in out:
        host, path, rule = brute(r.url)
        assert (r.url_host, r.url_path, r.url_rule) == (host, path, rule)
        assert r.url_verdict in ("allow", "block") and (rule is None or r.url_verdict == verdicts[rule])


def test_method_carries_rules_over_to_like_urls(spark):
    good, bad = [f"http://site{i}.org/en/{i}" for i in range(150)], [f"http://casino{i}.com/de/win{i}" for i in range(150)]
    asked = [(9000 + i, f"http://site{i}.net/en/{i}") for i in range(20)] + [(9100 + i, f"http://casino{i}.net/de/win{i}") for i in range(20)]
    rows = [(i, u) for i, u in enumerate(good + bad)] + asked
    out = {r.page_id: r.url_verdict for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert sum(out[i] == "allow" for i in range(9000, 9020)) >= 18 and sum(out[i] == "block" for i in range(9100, 9120)) >= 18


def test_one_kind_of_rule_and_empty(spark):
    out = judge_urls(spark.createDataFrame([(1, "http://a.org/"), (2, "http://a.net/")], "page_id long, url string")).collect()
    assert {r.url_verdict for r in out} == {"allow"}
    assert judge_urls(spark.createDataFrame([], SCHEMA)).count() == 0


def exact_scores(urls, folds):
    """Scores of all urls by exact counts; ruled ones without the counts of their own fold."""
    verdicts, characters = dict(RULES), len({c for u in urls for c in u})
    side = {u: verdicts.get(brute(u)[2]) for u in urls}

    def likelihood(url, verdict, out):
        logs, text = 0.0, "\x02" * ORDER + url
        pairs = counted[verdict, out]
        for i in range(ORDER, len(text)):
            p = (pairs[""][text[i]] + 0.5) / (sum(pairs[""].values()) + 0.5 * characters)
            for k in range(1, ORDER + 1):
                seen = pairs.get(text[i - k : i], {})
                n = sum(seen.values())
                p = (seen.get(text[i], 0) + len(seen) * p) / (n + len(seen)) if n else p
            logs += math.log(p)
        return logs / len(url)

    counted = {}
    for verdict in ("allow", "block"):
        for out in {None, *folds.values()}:
            pairs = counted[verdict, out] = {"": Counter()}
            for u in urls:
                if side[u] == verdict and (out is None or folds[u] != out):
                    text = "\x02" * ORDER + u
                    for i in range(ORDER, len(text)):
                        for k in range(ORDER + 1):
                            pairs.setdefault(text[i - k : i], Counter())[text[i]] += 1
    out = {u: None if side[u] is None else folds[u] for u in urls}
    return {u: likelihood(u, "allow", out[u]) - likelihood(u, "block", out[u]) for u in urls}, side


@pytest.mark.parametrize("hot", [4096, 1])
def test_scores_and_cut_by_exact_counts_of_all_ruled_urls(spark, monkeypatch, hot):
    """Also with characters that share a code point modulo 256, and with all grams going through the join."""
    monkeypatch.setattr("chronolane.llm.urls.HOT", hot)
    rng = random.Random(4)
    urls = [f"http://{rng.choice('abc')}{rng.choice('xyaš')}{i % 7}.{rng.choice(['org/en/', 'com/de/', 'net/de/', 'net/en/'])}{rng.choice(['a', 'š', 'win', ''])}{i}" for i in range(240)]
    urls += urls[:40]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    folds = {r.url: r.f for r in df.select("url", F.expr("int(pmod(xxhash64(url), 5))").alias("f")).collect()}
    want, side = exact_scores(urls, folds)
    best, cut = -1.0, None
    for edge in sorted({math.floor(max(-2, min(2, want[u])) * 100) for u in urls if side[u]}):
        below = [u for u in urls if side[u] and math.floor(max(-2, min(2, want[u])) * 100) <= edge]
        right = sum(side[u] == "block" for u in below) / sum(side[u] == "block" for u in urls) - sum(side[u] == "allow" for u in below) / sum(side[u] == "allow" for u in urls)
        if right > best + 1e-12:
            best, cut = right, (edge + 1) / 100
    out = judge_urls(df).collect()
    assert len(out) == len(urls) and any(side[r.url] is None for r in out)
    for r in out:
        if side[r.url] is None:
            assert abs(r.url_score - want[r.url]) < 1e-7 and r.url_verdict == ("block" if want[r.url] < cut else "allow")
        else:
            assert r.url_score is None and r.url_verdict == side[r.url]
