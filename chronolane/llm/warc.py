"""Merkle fixity audit of WARC replicas.

A record's bytes are hashed; records are ordered by page id, and stand in files of 4096 ids at running offsets. Ordered
ranges of sixteen ids at a time form a tree: the hash of a range is that of its children in order, each with its offset
in the range, its length and its hash. Two replicas compare roots; only the children of ranges that differ are compared
next, down to the records. Offsets count from the range's start and ranges follow ids, so a lost or longer record
changes its own branch alone.

An id's digest is a hash over the sorted hashes of its records. They are hashed in groups by the first characters of
their hash, and these groups again, so an id with very many records needs no long list; every inner node has sixteen
children at most.

Defined cases: null url or html is empty text; records without a page_id are told apart by their content, in a range of
ids of their own that spreads them; repeated records count and must agree in number; a replica without records differs
in every branch of the other; two empty replicas agree and give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, write_cut

#: Bits of the id that a level of the tree takes: 16 children a node.
BITS = 4
#: Ids of a file, as bits: offsets count from the file's start.
FILE_BITS = 12
#: Ids up to this one stand for records without a page_id.
NAMELESS = -(1 << 62)
#: When the records were fetched, where nothing tells.
DATE = "1970-01-01T00:00:00Z"


def record(page_id: Column, url: Column, html: Column, date: str = DATE) -> Column:
    """A response record in WARC 1.1 form; its id is made of the page's, or of the body's hash."""
    html = F.coalesce(html, F.lit(""))
    head = F.format_string(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%s>\r\nWARC-Date: {date}\r\nWARC-Target-URI: %s\r\nContent-Length: %d\r\n\r\n", F.coalesce(page_id.cast("string"), F.sha2(html, 256)), F.coalesce(url, F.lit("")), F.octet_length(html))
    return F.concat(head, html, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame) -> DataFrame:
    """(id, sha256, length, copies, offset) of the records of (page_id, url, html), repeated ones once.

    Offsets are running sums inside a file of 4096 ids, over distinct records.
    """
    page_id = F.col("page_id").cast("long")
    rows = pages.select(page_id.alias("page_id"), record(page_id, F.col("url"), F.col("html")).alias("record"))
    hashed = rows.select("page_id", F.sha2("record", 256).alias("sha256"), F.octet_length("record").cast("long").alias("length"))
    id_ = F.coalesce("page_id", F.lit(NAMELESS) - F.pmod(F.xxhash64("sha256"), F.lit(1 << 61)))
    counted = hashed.withColumn("id", id_).groupBy("id", "sha256", "length").agg(F.count("*").alias("copies"))
    before = Window.partitionBy(F.shiftright("id", FILE_BITS)).orderBy("id", "sha256").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("offset", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0).cast("long")))


def digests(records: DataFrame) -> DataFrame:
    """(id, hash, start, end) of the ids: a hash over their records' hashes and counts, in groups by four and two characters."""
    joined = lambda items: F.sha2(F.array_join(F.array_sort(F.collect_list(items)), ","), 256)
    out = records.select("id", F.substring("sha256", 1, 4).alias("group"), F.concat_ws(":", "sha256", "copies").alias("hash"), F.col("offset").alias("start"), (F.col("offset") + F.col("length") * F.col("copies")).alias("end"))
    for characters in (4, 2, 0):
        out = out.groupBy("id", F.substring("group", 1, characters).alias("group")).agg(joined(F.concat_ws(":", "group", "hash")).alias("hash"), F.min("start").alias("start"), F.max("end").alias("end"))
    return out.drop("group")


def tree(records: DataFrame, levels: int) -> list[DataFrame]:
    """(id, hash, start, end) of each level; level 0 has the ids, the last one node or two (ids below 0)."""
    out = [write_cut(digests(records), "merkle-0")]
    for level in range(1, levels + 1):
        up = out[-1].withColumn("up", F.shiftright("id", BITS)).groupBy("up").agg(F.array_sort(F.collect_list(F.struct("id", "hash", "start", "end"))).alias("children"), F.min("start").alias("start"), F.max("end").alias("end"))
        joined = F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["id"], c["start"] - F.col("start"), c["end"] - c["start"], c["hash"])), ",")
        up = up.select(F.col("up").alias("id"), F.sha2(joined, 256).alias("hash"), "start", "end")
        out.append(write_cut(up, f"merkle-{level}"))
    return out


def _differing(a: DataFrame, b: DataFrame, under: DataFrame | None) -> DataFrame:
    """Ids whose hashes differ or are on one side alone; of the children of ``under`` if given."""
    sides = []
    for side, name in ((a, "hash_a"), (b, "hash_b")):
        if under is not None:
            side = side.withColumn("up", F.shiftright("id", BITS)).join(under.withColumnRenamed("id", "up"), "up", "left_semi")
        sides.append(side.select("id", F.col("hash").alias(name)))
    return sides[0].join(sides[1], "id", "full").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select("id")


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(page_id, state, sha256_a, sha256_b, offset_a, length_a, length_b) of every record in which replicas differ.

    ``a`` and ``b`` have page_id, url and html. state: changed, missing (from b) or extra (in b).
    """
    a, b = write_cut(leaves(a), "replica-a"), write_cut(leaves(b), "replica-b")
    widest = a.select("id").unionByName(b.select("id")).agg(F.max(F.greatest("id", -1 - F.col("id")))).first()[0]
    levels = 0 if widest is None else max(1, -(-int(widest).bit_length() // BITS))
    trees = tree(a, levels), tree(b, levels)
    under = None
    for level in range(levels, -1, -1):
        under = write_cut(_differing(trees[0][level], trees[1][level], under), f"differing-{level}")
    sides = []
    for side, name in ((a, "a"), (b, "b")):
        mine = side.join(under, "id", "left_semi")
        sides.append(mine.select("id", F.col("sha256").alias("key"), *[F.col(c).alias(f"{c}_{name}") for c in ("sha256", "offset", "length", "copies")]))
    # Records of one id that are equal and as many on both sides are sound; the others pair up in order of their hash.
    odd = sides[0].join(sides[1], ["id", "key"], "full").filter(~F.col("copies_a").eqNullSafe(F.col("copies_b")))
    place = Window.partitionBy("id").orderBy("key")
    left = odd.filter("sha256_a IS NOT NULL").withColumn("n", F.row_number().over(place)).select("id", "n", "sha256_a", "offset_a", "length_a")
    right = odd.filter("sha256_b IS NOT NULL").withColumn("n", F.row_number().over(place)).select("id", "n", "sha256_b", "length_b")
    state = F.when(F.col("sha256_b").isNull(), "missing").when(F.col("sha256_a").isNull(), "extra").otherwise("changed")
    return left.join(right, ["id", "n"], "full").select(F.when(F.col("id") > NAMELESS, F.col("id")).alias("page_id"), state.alias("state"), "sha256_a", "sha256_b", "offset_a", "length_a", "length_b")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known faults: of page_id modulo 97, 5 has one character changed, 11 the second half cut off, 23 is lost."""
    rest, half = F.pmod("page_id", F.lit(97)), F.floor(F.length("html") / 2).cast("int")
    html = F.when(rest == 5, F.concat(F.substr("html", F.lit(1), half), F.lit("#"), F.substr("html", half + 2))).when(rest == 11, F.substr("html", F.lit(1), half)).otherwise(F.col("html"))
    return pages.filter((rest != 23) | F.col("page_id").isNull()).withColumn("html", html)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, damaged(pages))


OP5_SQL = r"""
WITH a AS (
  SELECT page_id, url, coalesce(html, '') AS html, page_id % 97 AS rest, length(coalesce(html, '')) // 2 AS half FROM pages
), b AS (
  SELECT page_id, url, CASE WHEN rest = 5 THEN substr(html, 1, half) || '#' || substr(html, half + 2) WHEN rest = 11 THEN substr(html, 1, half) ELSE html END AS html FROM a WHERE rest <> 23
), ra AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM a
), rb AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM b
), ha AS (
  SELECT page_id, sha256(record) AS sha256_a, CAST(strlen(record) AS BIGINT) AS length_a,
    CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY page_id // 4096 ORDER BY page_id, sha256(record) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_a FROM ra
), hb AS (SELECT page_id, sha256(record) AS sha256_b, CAST(strlen(record) AS BIGINT) AS length_b FROM rb)
SELECT page_id, CASE WHEN sha256_b IS NULL THEN 'missing' WHEN sha256_a IS NULL THEN 'extra' ELSE 'changed' END AS state, sha256_a, sha256_b, offset_a, length_a, length_b
FROM ha FULL JOIN hb USING (page_id) WHERE sha256_a IS DISTINCT FROM sha256_b
"""
