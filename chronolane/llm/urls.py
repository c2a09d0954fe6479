"""URL filter: longest rule first, then a ratio of character language models.

Two smoothed variable-order Markov models over the characters of urls are counted, on all urls that a rule accepts and
on all that a rule blocks. A character's probability interpolates from order 0 up to ORDER, each order trusted by how
often its context was seen (Witten-Bell). A url's score is the log-likelihood difference per character, and the cut is
the score that best separates all ruled urls by balanced error. For the cut a ruled url is scored without the counts of
its own fold (FOLDS by hash), so every ruled url enters the counts and the cut.

Counts are exact and stay in Spark tables. As a character's value depends on it and the ORDER characters before it
alone, a gram of ORDER + 1 characters, values are worked out once for each distinct gram, from its own counts and the
value of the gram that is one character shorter. Urls are joined to the values by gram; grams in more than one of HOT
of the urls' distinct grams, HOT at most, go to the tasks and are summed where the urls are, so that no key of the join
is hot. Values are summed as whole numbers: the order of rows doesn't change a score.

Defined cases: a null url or one without :// has empty host and path and no rule; an empty or null url scores 0, which
the cut decides; without urls of both kinds every url that no rule decides is allowed; repeated rows each give a row;
an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, table, write_cut

#: (host/path, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
ORDER, FOLDS = 5, 5
#: What stands before a url's first character.
BEFORE = "\x02" * ORDER
BINS, HOT = 400, 4096
#: Values of grams are whole numbers of this fraction.
UNIT = 1 << 32


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits the host or a parent of it and starts the path; null if none does."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        at, _, begins = rule.partition("/")
        out = F.when(((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{begins}"), rule).otherwise(out)
    return out


def grams_of(url: str) -> Counter:
    """Each character of a url with the ORDER characters before it."""
    text = BEFORE + url
    return Counter(text[i : i + ORDER + 1] for i in range(len(url)))


def count_grams(urls: DataFrame) -> DataFrame:
    """(order, gram, seen, n0, n1, ...): in how many urls a gram stands, and its count in each kind, for order 0 to ORDER.

    ``urls`` has (url, kind, n): kind is side * FOLDS + fold, or -1 without a rule, and n the number of rows.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, counts = Counter(), Counter()
            for url, kind, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for gram, k in grams_of(url).items():
                    seen[gram, kind] += 1
                    counts[gram, kind] += k * n
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in seen], pa.string()), pa.array([k for _, k in seen], pa.int32()), pa.array(seen.values(), pa.int64()), pa.array([counts[key] for key in seen], pa.int64())], ["gram", "kind", "seen", "n"])

    rows = small_batches(urls).select("url", "kind", "n").mapInArrow(split, "gram string, kind int, seen long, n long")
    kinds = [f"n{j}" for j in range(2 * FOLDS)]
    longest = rows.groupBy("gram").agg(F.sum("seen").alias("seen"), *[F.sum(F.when(F.col("kind") == j, F.col("n")).otherwise(0)).alias(c) for j, c in enumerate(kinds)])
    each = longest.select(F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("order"), "gram", "seen", *kinds)
    each = each.withColumn("gram", F.col("gram").substr(F.lit(ORDER + 1) - F.col("order"), F.col("order") + 1))
    return each.groupBy("order", "gram").agg(*[F.sum(c).alias(c) for c in ("seen", *kinds)])


def _without(name: str) -> list[Column]:
    """Of counts by side and fold: for each side all of them, then all but each fold."""
    sides = [[F.col(f"{name}{side * FOLDS + fold}") for fold in range(FOLDS)] for side in range(2)]
    return [sum(side[1:], side[0]) - out for side in sides for out in (F.lit(0), *side)]


def gram_values(counts: DataFrame) -> DataFrame:
    """(gram, seen, value): log-likelihood of accepted minus blocked for a gram's last character, in UNITs.

    value[0] is that of all counts, value[1 + fold] that of all but a fold's. ``counts`` is count_grams(), written.
    """
    characters = counts.filter("order = 0").count()
    context = Window.partitionBy("order", "context")
    rows = counts.withColumn("context", F.expr("substring(gram, 1, order)"))
    rows = rows.select("order", "gram", "seen", *[c.alias(f"c{j}") for j, c in enumerate(_without("n"))], *[F.sum(f"n{j}").over(context).alias(f"t{j}") for j in range(2 * FOLDS)], "context")
    models = range(2 * (FOLDS + 1))
    rows = rows.select("order", "gram", "seen", *[f"c{j}" for j in models], *[c.alias(f"m{j}") for j, c in enumerate(_without("t"))], *[F.count_if(F.col(f"c{j}") > 0).over(context).alias(f"k{j}") for j in models])
    p = None
    for order in range(ORDER + 1):
        at = rows.filter(F.col("order") == order)
        if p is None:
            p = at.select("gram", "seen", *[((F.col(f"c{j}") + 0.5) / (F.col(f"m{j}") + 0.5 * characters)).alias(f"p{j}") for j in models])
            continue
        shorter = p.select(F.col("gram").alias("shorter"), *[F.col(f"p{j}").alias(f"q{j}") for j in models])
        c, m, k, q = ([F.col(f"{x}{j}") for j in models] for x in "cmkq")
        p = at.withColumn("shorter", F.col("gram").substr(2, order)).join(shorter, "shorter").select("gram", "seen", *[F.when(m[j] > 0, (c[j] + k[j] * q[j]) / (m[j] + k[j])).otherwise(q[j]).alias(f"p{j}") for j in models])
    ratios = [F.log(f"p{v}") - F.log(f"p{FOLDS + 1 + v}") for v in range(FOLDS + 1)]
    return p.select("gram", "seen", F.array(*[F.round(r * UNIT).cast("long") for r in ratios]).alias("value"))


def score_urls(urls: DataFrame, values: DataFrame) -> DataFrame:
    """(id, total): values of all characters of each url of (id, url, kind), by the counts without its own fold."""
    least = (values.agg(F.sum("seen")).first()[0] or 0) / HOT
    hot = F.col("seen") > least
    shared = urls.sparkSession.sparkContext.broadcast({r.gram: r.value for r in values.filter(hot).collect()})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows = []
            for key, url, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                model = 0 if kind < 0 else 1 + kind % FOLDS
                total = 0
                for gram, n in grams_of(url).items():
                    if gram in known:
                        total += n * known[gram][model]
                    else:
                        rows.append((key, model, gram, n, 0))
                # A key of its own, longer than any gram, that joins nothing.
                rows.append((key, model, f"{key:020d}", 0, total))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["id", "model", "gram", "n", "known"])

    rows = small_batches(urls).select("id", "url", "kind").mapInArrow(split, "id long, model int, gram string, n long, known long")
    joined = rows.join(values.filter(~hot).select("gram", "value"), "gram", "left")
    return joined.groupBy("id").agg(F.sum(F.col("known") + F.coalesce(F.col("n") * F.get("value", F.col("model")), F.lit(0))).alias("total"))


def judge_urls(pages: DataFrame, url: str = "url", rules: tuple = RULES) -> DataFrame:
    """Add url_host, url_path, url_rule, url_verdict, and url_score where no rule decides."""
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in r])
    ruled = pages.withColumn("url_host", host_of(F.col(url))).withColumn("url_path", path_of(F.col(url))).withColumn("url_rule", rule_of(F.col("url_host"), F.col("url_path"), rules))
    by_rule = F.element_at(verdicts, F.col("url_rule"))
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")
    distinct = pages.select(F.col(url).alias("url")).filter(F.length("url") > 0).groupBy("url").agg(F.count("*").alias("n"))
    distinct = distinct.withColumn("side", F.element_at(verdicts, rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)) == "block")
    kind = F.coalesce(F.col("side").cast("int") * FOLDS + fold, F.lit(-1))
    urls = write_cut(distinct.select(F.monotonically_increasing_id().alias("id"), "url", "n", kind.alias("kind")), "urls")
    if urls.filter("kind >= 0").select(F.floor(F.col("kind") / FOLDS)).distinct().count() < 2:
        return ruled.withColumn("url_score", F.lit(None).cast("double")).withColumn("url_verdict", F.coalesce(by_rule, F.lit("allow")))
    values = write_cut(gram_values(write_cut(count_grams(urls), "url-grams")), "url-values")
    scores = write_cut(urls.join(score_urls(urls, values), "id").select(F.col("url").alias("_url"), "n", "kind", (F.col("total") / UNIT / F.length("url")).alias("_score")), "url-scores")

    bins = scores.filter("kind >= 0").withColumn("bin", F.floor(F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("_score"))) * (BINS // 4)))
    held = bins.groupBy("bin").agg(F.sum(F.when(F.col("kind") >= FOLDS, F.col("n")).otherwise(0)).alias("blocked"), F.sum("n").alias("n")).collect()
    bad = sum(r.blocked for r in held)
    good = sum(r.n for r in held) - bad
    cut, best, below_bad, below_good = 0.0, -1.0, 0, 0
    for r in sorted(held, key=lambda r: r.bin):  # block what scores in this bin or below
        below_bad, below_good = below_bad + r.blocked, below_good + r.n - r.blocked
        right = below_bad / max(1, bad) + 1 - below_good / max(1, good)
        if right > best:
            best, cut = right, (r.bin + 1) / (BINS // 4)
    scored = ruled.join(scores.filter("kind < 0").select("_url", "_score"), ruled[url] == F.col("_url"), "left")
    scored = scored.withColumn("url_score", F.when(F.col("url_rule").isNull(), F.coalesce("_score", F.lit(0.0)))).drop("_url", "_score")
    return scored.withColumn("url_verdict", F.coalesce(by_rule, F.when(F.col("url_score") < cut, "block").otherwise("allow")))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"), F.col("url_score").alias("score"))
