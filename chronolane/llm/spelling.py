"""Spelling variants by permuterm rotations: words that differ by one inserted, deleted or replaced code point.

A word gets a number in order of falling count, then of code points, so the smallest number among its near words is its
likeliest spelling. It is marked with a terminator and turned to every rotation. A rotation that ends with the edited
character starts with all that two near words share, so an edit becomes a prefix range that skips one character: the
range holds, for each character, the one word that has it there, and the one word that has none. Ranges are dealt by
their prefix, sorted and scanned: each member gets the size of its range, less itself, and the smallest other number. No
range is larger than the alphabet, and no pairs are written. A character inserted into a run of its like could stand at
any place of the run; only the first counts.

Prefixes of more than LONG code points go by their sha256, so the bytes that move grow with a word's length and not with
its square; hashing still takes time in the square of it.

Forms: a word's form is its likeliest near word, if that has ``times`` its count; roots follow forms to the last. Counts
grow by ``times`` at each step, so the number of steps is known from the largest count, and doubling takes its logarithm.

Defined cases: a null text has no words; a null doc_id is one of no text where it is hashed; repeated rows count again;
words below ``seen`` are neither returned nor near to others; empty tables give no rows; other columns are ignored.
Words must not hold the terminator.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, write_cut

#: Letters of a word: Latin letters of ASCII and of the block after it.
LETTERS = "A-Za-zÀ-ÿ"
END = "$"
#: Prefixes of more code points are hashed.
LONG = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks of a member of a range, chosen so that only the last two differ in both bits.
_REPLACED, _DOUBLED, _SHORTER = 0, 1, 2


def letter_runs(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, run): every maximal run of at least ``least`` letters in whole texts, A-Z lower-cased."""
    found = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run")).withColumn("run", F.translate("run", _UPPER, _LOWER))


def numbered(words: DataFrame, seen: int) -> DataFrame:
    """(id, word, n) of the words that occur ``seen`` times, numbered by falling count and code points; written."""
    counts = words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= seen)
    return write_cut(counts.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spellings")


def _key(prefix: Column) -> Column:
    return F.when(F.length(prefix) > LONG, F.concat(F.lit("#"), F.sha2(prefix, 256))).otherwise(prefix)


def ranges(words: DataFrame) -> DataFrame:
    """(key, mark): the prefix ranges that each word is in; mark is 4 * id and how the word is in the range."""
    at, size = F.col("at"), F.length("word")
    turned = words.select("id", "word", F.explode(F.sequence(F.lit(0), size)).alias("at"))
    turned = turned.select("id", "at", F.concat(F.substring("word", at + 1, size), F.lit(END), F.substring("word", F.lit(1), at)).alias("turn"))
    cut = F.substring("turn", F.lit(1), F.length("turn") - 1)
    twice = F.substring("turn", -1, 1) == F.substring("turn", -2, 1)
    mark = lambda how: F.col("id") * 4 + how
    # Turned by nothing, a word ends with the terminator, which is no edit.
    both = F.array(F.struct(_key(F.col("turn")).alias("key"), mark(_SHORTER).alias("mark")), F.when(at > 0, F.struct(_key(cut).alias("key"), mark(F.when(twice, _DOUBLED).otherwise(_REPLACED)).alias("mark"))))
    return turned.select(F.explode(both).alias("r")).filter("r IS NOT NULL").select("r.key", "r.mark")


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best): number of near words of each word that has any, and the smallest id among them."""
    whole = W.partitionBy("key").orderBy("mark").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    met = ranges(words).repartition("key").withColumn("size", F.count("*").over(whole))
    # A doubled letter and the word without it meet in the range of the run's first letter.
    met = met.withColumn("apart", (F.sum(F.when(F.col("mark") % 4 > 0, 1)).over(whole) == 2).cast("int"))
    for i in (1, 2, 3):
        met = met.withColumn(f"m{i}", F.nth_value("mark", i).over(whole))
    met = met.filter("size > 1")
    pair = lambda m: (F.col(m).bitwiseXOR(F.col("mark"))) % 4 == 3
    others = [F.when((F.col(m) != F.col("mark")) & ~pair(m), F.col(m)) for m in ("m1", "m2", "m3")]
    near = F.col("size") - 1 - F.when(F.col("mark") % 4 > 0, F.col("apart")).otherwise(0)
    return met.select(F.expr("mark DIV 4").alias("id"), near.alias("near"), F.coalesce(*others).alias("best")).filter("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.expr("min(best) DIV 4").alias("best"))


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """(id, root): the end of each chain of at most ``steps`` forms."""
    now = forms.select("id", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(steps, 1)))):
        on = now.select(F.col("id").alias("root"), F.col("root").alias("further"))
        now = write_cut(now.join(on, "root", "left").select("id", F.coalesce("further", "root").alias("root")), "roots")
    return now


def spelling_groups(words: DataFrame, seen: int = 2, times: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words of a column ``word`` that occur ``seen`` times."""
    if times < 2:
        raise ValueError("forms must be more frequent by a factor of 2 at least")
    known = numbered(words, seen)
    near = write_cut(near_words(known), "near")
    most = known.agg(F.max("n")).first()[0] or 1
    of = lambda name: known.select(F.col("id").alias(name), F.col("word").alias(f"{name}_word"), F.col("n").alias(f"{name}_n"))
    forms = near.join(known.select("id", "n"), "id").join(of("best"), "best").filter(F.col("best_n") >= times * F.col("n"))
    forms = write_cut(forms.select("id", F.col("best").alias("form"), F.col("best_word").alias("form_word"), F.col("best_n").alias("form_n")), "forms")
    roots = _roots(forms, int(math.log(max(most / seen, 1), times) + 1e-9)).join(of("root").drop("root_n"), "root").drop("root")
    out = known.join(near.select("id", "n_near"), "id", "left").join(forms.drop("form"), "id", "left").join(roots, "id", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("form_word").alias("form"), "form_n", F.coalesce("root_word", "word").alias("root"))


def misspelt(docs: DataFrame, least: int, one_in: int) -> DataFrame:
    """(word): runs of at least ``least`` letters, after one in ``one_in`` by a hash of row and run lost a letter."""
    runs = letter_runs(docs, least)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    runs = runs.withColumn("h", h)
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % one_in == 0, less).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(misspelt(table(spark, sf_dir, "documents"), least=7, one_in=31), seen=2, times=10)


#: crc32 from its polynomial, near words by what is left when one code point is taken out, roots by walking forms.
OP11_SQL = r"""
WITH RECURSIVE one(i, c, k) AS (
  SELECT i, i::UBIGINT, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM one WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM one WHERE k = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), many AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (
  SELECT run, n, list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS UBIGINT)) AS b
  FROM (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM many)
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda c, y: xor(c >> 8, t[CAST(xor(c, y) & 255 AS INT) + 1])), 4294967295::UBIGINT) AS h FROM bytes, crc
), edited AS (
  SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed
), words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(0, length(word))) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word, n),
forms AS (SELECT word, other AS form, m AS form_n FROM best WHERE m >= 10 * n),
walk(word, last) AS (SELECT word, word FROM words UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.last),
roots AS (SELECT w.word, w.last AS root FROM walk w LEFT JOIN forms f ON f.word = w.last WHERE f.word IS NULL)
SELECT words.word, words.n, coalesce(best.n_near, 0) AS n_near, form, form_n, root
FROM words JOIN roots ON roots.word = words.word LEFT JOIN best ON best.word = words.word LEFT JOIN forms ON forms.word = words.word
"""
