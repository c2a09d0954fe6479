"""Splits, donors, samples, gates and coverage over customers, orders and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.functions import scalars
from chronolane.operators import splits

from .base import rounded, table

RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}


def _charts(spark, sf_dir) -> DataFrame:
    return splits.hash_split(table(spark, sf_dir, "customer"), "c_nationkey", RATIOS)


def hash_split(spark, sf_dir):
    return _charts(spark, sf_dir).select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"), "split")


def split_counts(spark, sf_dir):
    return splits.split_counts(_charts(spark, sf_dir), "c_nationkey")


def split_integrity(spark, sf_dir):
    by_key = splits.hash_split(table(spark, sf_dir, "customer"), "c_custkey", RATIOS)
    return splits.integrity(by_key, "c_nationkey", "c_mktsegment")


def split_drift(spark, sf_dir):
    now = table(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(2)).alias("flag"))
    then = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("flag")).unionByName(spark.range(1).select((-F.col("id") - 5).alias("doc_id"), F.lit(0).cast("long").alias("flag")))
    return splits.drift(now, then, "doc_id", ["flag"])


def key_difference(spark, sf_dir):
    diff = splits.difference(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return diff.select("side", "n", F.array_join("sample", ",").alias("sample"))


def require_subset(spark, sf_dir):
    return splits.require_subset(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents"), "doc_id")


def seeded_sample(spark, sf_dir):
    return splits.seeded_sample(table(spark, sf_dir, "customer"), "c_custkey", 50, 11)


def uniform_pick(spark, sf_dir):
    return rounded(splits.uniform_pick(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_custkey", 5))


def stratified_pick(spark, sf_dir):
    return rounded(splits.stratified_pick(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", "c_custkey", 10, 3, 3))


def donor_map(spark, sf_dir):
    return splits.donor_map(table(spark, sf_dir, "customer"), "c_custkey", 4)


def donor_join(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return rounded(splits.donor_join(rows, splits.donor_map(rows, "c_custkey", 4), rows, "c_custkey", ["c_acctbal", "c_nationkey"]), 4)


def _cases(spark, sf_dir) -> DataFrame:
    return splits.scenario_cases(table(spark, sf_dir, "customer"), "c_custkey", ["matched", "random"], {"greedy": 1, "sampled": 3})


def scenario_cases(spark, sf_dir):
    return _cases(spark, sf_dir)


def coverage_check(spark, sf_dir):
    journal = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit("matched").alias("scenario"), F.lit("sampled").alias("mode"), F.pmod("o_orderkey", F.lit(4)).alias("seed"))
    return splits.coverage(_cases(spark, sf_dir), journal, ["c_custkey", "scenario", "mode", "seed"])


def reuse_rows(spark, sf_dir):
    stored = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("flag"))
    wanted = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.pmod("doc_id", F.lit(2))).alias("flag"))
    reuse, make = splits.reusable(stored, wanted, ["doc_id", "flag"])
    return reuse.withColumn("action", F.lit("reuse")).unionByName(make.withColumn("action", F.lit("make")))


def universe_digest(spark, sf_dir):
    return splits.universe_digest(table(spark, sf_dir, "documents"), "doc_id")


def retain_last_and_best(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return rounded(splits.retain(rows, ["o_custkey"], "o_orderkey", "o_totalprice"))


def _gated(spark, sf_dir) -> DataFrame:
    reason = scalars.first_reason(("open", F.col("o_orderstatus") == "O"), ("cheap", F.col("o_totalprice") < 50000), ("late", F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")), ("low_priority", F.col("o_orderpriority").startswith("5")))
    return table(spark, sf_dir, "orders").withColumn("reason", reason)


def gate_reasons(spark, sf_dir):
    return _gated(spark, sf_dir).select("o_orderkey", "reason")


def reject_counts(spark, sf_dir):
    return _gated(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def range_select(spark, sf_dir):
    return rounded(table(spark, sf_dir, "part").filter(scalars.within_ranges({"p_size": (10, 20), "p_retailprice": (900.0, 1500.0)})).select("p_partkey", "p_size", "p_retailprice"))


def partial_mask(spark, sf_dir):
    fields = ["p_size", "p_retailprice", "p_brand"]
    present = {"p_size": F.col("p_size") > 10, "p_retailprice": F.col("p_retailprice").isNotNull(), "p_brand": F.col("p_brand").isNotNull()}
    mask = scalars.bernoulli_mask(fields, present, 0.5, 9, F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(mask, "").alias("mask"))


def train_mask(spark, sf_dir):
    fields = ["p_size", "p_retailprice", "p_brand"]
    present = {"p_size": F.col("p_size") > 10, "p_retailprice": F.col("p_retailprice").isNotNull(), "p_brand": F.col("p_brand").isNotNull()}
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(scalars.train_mask(fields, present, 9, F.col("p_partkey")), "").alias("mask"))


def augment_choice(spark, sf_dir):
    return rounded(table(spark, sf_dir, "part").select("p_partkey", scalars.augment_choice(2, F.col("p_partkey")).alias("a")).select("p_partkey", "a.mirror", "a.rate"))


def most_common(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(10)


def largest_gaps(spark, sf_dir):
    share = lambda flag: F.avg((F.col("l_returnflag") == flag).cast("double"))
    gaps = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((share("R") - share("A")).alias("gap"))
    return rounded(gaps.orderBy(F.desc(F.round(F.abs("gap"), 9)), "l_suppkey").limit(15))


def manifest_keys(spark, sf_dir):
    """Keyed append: stored labels stay, documents without one get a default."""
    stored = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    fresh = table(spark, sf_dir, "documents").select("doc_id").join(stored, "doc_id", "left_anti").withColumn("quality", F.lit(-1).cast("long"))
    return stored.unionByName(fresh)


def common_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


def bound_files(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("set_id", F.pmod("page_id", F.lit(25)))
    files = pages.filter("page_id % 3 > 0").select("set_id", F.upper("url").alias("file"))
    return splits.bound_sets(pages, files, "set_id", "url", "file")


_U = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
_POS = "(CAST('0x' || substr(sha256('0:' || {}), 1, 16) AS UBIGINT)::DECIMAL(20,0)::DOUBLE / 18446744073709551616.0)"
_SPLIT = "CASE WHEN {p} < 0.8 THEN 'train' WHEN {p} < 0.9 THEN 'val' ELSE 'test' END"
_BY = f"WITH s AS (SELECT *, {_SPLIT.format(p=_POS.format('c_nationkey'))} AS split FROM customer)"
_POOL = f"""
WITH p AS (SELECT c_custkey, {_U.format("'pool|' || c_custkey")} % 64 AS b FROM customer),
n AS (SELECT c_custkey, row_number() OVER (ORDER BY b, c_custkey) - 1 AS place, count(*) OVER () AS total FROM p),
d AS (SELECT a.c_custkey AS target, b.c_custkey AS donor FROM n a JOIN n b ON {_U.format("'4|' || a.c_custkey")} % a.total = b.place)
"""
_CASES = "c AS (SELECT c_custkey, scenario, mode, seed FROM customer, (VALUES ('matched'), ('random')) s(scenario), (VALUES ('greedy', 0::BIGINT), ('sampled', 0), ('sampled', 1), ('sampled', 2)) m(mode, seed))"
_GATE = "CASE WHEN o_orderstatus = 'O' THEN 'open' WHEN o_totalprice < 50000 THEN 'cheap' WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN 'late' WHEN o_orderpriority LIKE '5%' THEN 'low_priority' END"


def _unit(text: str) -> str:
    return f"({_U.format(text)} / 4294967296.0)"


_FIELDS = ("p_size", "p_retailprice", "p_brand")
_D = ", ".join(f"CASE WHEN {'p_size > 10' if f == 'p_size' else f + ' IS NOT NULL'} AND {_unit(f"'9|' || p_partkey || '|{f}'")} < 0.5 THEN 1 ELSE 0 END AS d{i}" for i, f in enumerate(_FIELDS))
SQL = {
    "hash_split": _BY + " SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, split FROM s",
    "split_counts": _BY + ", n(split) AS (VALUES ('train'), ('val'), ('test')) SELECT n.split, count(DISTINCT c_nationkey) AS groups, count(c_custkey) AS charts FROM n LEFT JOIN s USING (split) GROUP BY ALL",
    "split_integrity": f"WITH s AS (SELECT *, {_SPLIT.format(p=_POS.format('c_custkey'))} AS split FROM customer) SELECT 'group in several splits' AS rule, CAST(c_nationkey AS VARCHAR) AS what FROM s GROUP BY c_nationkey HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'repeated key', c_mktsegment FROM s GROUP BY c_mktsegment HAVING count(*) > 1 UNION ALL SELECT 'empty split', x FROM (VALUES ('train'), ('val'), ('test')) n(x) WHERE x NOT IN (SELECT split FROM s)",
    "split_drift": """
WITH a AS (SELECT doc_id, doc_id % 2 AS flag FROM documents), b AS (SELECT doc_id, quality::BIGINT AS flag FROM labels UNION ALL SELECT -5, 0),
j AS (SELECT a.doc_id AS x, b.doc_id AS y, a.flag AS fa, b.flag AS fb FROM a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT CASE WHEN y IS NULL THEN 'extra' WHEN x IS NULL THEN 'missing' ELSE 'changed_flag' END AS kind, coalesce(x, y) AS key FROM j WHERE x IS NULL OR y IS NULL OR fa IS DISTINCT FROM fb""",
    "key_difference": """
WITH l AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), r AS (SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
SELECT 'left_only' AS side, (SELECT count(*) FROM l) AS n, coalesce((SELECT string_agg(doc_id, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM l ORDER BY doc_id LIMIT 20)), '') AS sample
UNION ALL SELECT 'right_only', (SELECT count(*) FROM r), coalesce((SELECT string_agg(doc_id, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM r ORDER BY doc_id LIMIT 20)), '')""",
    "require_subset": "SELECT doc_id FROM labels",
    "seeded_sample": "SELECT c_custkey FROM customer ORDER BY md5('11|' || c_custkey), c_custkey LIMIT 50",
    "uniform_pick": "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, min_by(c_custkey, md5('5|' || c_custkey)) AS c_custkey, count(*) AS matches FROM customer GROUP BY ALL",
    "stratified_pick": """
WITH g AS (SELECT c_nationkey FROM (SELECT DISTINCT c_nationkey FROM customer) ORDER BY md5('3|' || c_nationkey), c_nationkey LIMIT 10),
p AS (SELECT c_nationkey, min_by(c_mktsegment, md5('3|' || c_mktsegment)) AS c_mktsegment FROM customer SEMI JOIN g USING (c_nationkey) GROUP BY ALL),
r AS (SELECT c_nationkey, c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('3|' || c_custkey), c_custkey) AS n FROM customer JOIN p USING (c_nationkey, c_mktsegment))
SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment, c_custkey FROM r WHERE n <= 3""",
    "donor_map": _POOL + "SELECT target, donor FROM d",
    "donor_join": _POOL + "SELECT target, donor, round(x.c_acctbal, 4) AS target_c_acctbal, CAST(x.c_nationkey AS BIGINT) AS target_c_nationkey, round(y.c_acctbal, 4) AS donor_c_acctbal, CAST(y.c_nationkey AS BIGINT) AS donor_c_nationkey FROM d JOIN customer x ON target = x.c_custkey JOIN customer y ON donor = y.c_custkey",
    "scenario_cases": "WITH " + _CASES + " SELECT * FROM c",
    "coverage_check": "WITH " + _CASES + ", j AS (SELECT DISTINCT o_custkey AS c_custkey, 'matched' AS scenario, 'sampled' AS mode, o_orderkey % 4 AS seed FROM orders) SELECT c_custkey, scenario, mode, seed, 'missing' AS problem FROM c ANTI JOIN j USING (c_custkey, scenario, mode, seed) UNION ALL SELECT c_custkey, scenario, mode, seed, 'unexpected' FROM j ANTI JOIN c USING (c_custkey, scenario, mode, seed)",
    "reuse_rows": """
WITH s AS (SELECT doc_id, quality::BIGINT AS flag FROM labels), w AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN doc_id % 2 END AS flag FROM documents)
SELECT doc_id, flag, 'reuse' AS action FROM s WHERE EXISTS (SELECT 1 FROM w WHERE w.doc_id = s.doc_id AND w.flag IS NOT DISTINCT FROM s.flag)
UNION ALL SELECT doc_id, flag, 'make' FROM w WHERE NOT EXISTS (SELECT 1 FROM s WHERE w.doc_id = s.doc_id AND w.flag IS NOT DISTINCT FROM s.flag)""",
    "universe_digest": "WITH k AS (SELECT DISTINCT sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents WHERE doc_id IS NOT NULL), s AS (SELECT count(*) AS n, " + ", ".join(f"sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS UBIGINT)) AS s{i}" for i in range(8)) + " FROM k) SELECT sha256(concat_ws('|', n, " + ", ".join(f"CAST(coalesce(s{i}, 0) AS VARCHAR)" for i in range(8)) + ")) AS digest, n FROM s",
    "retain_last_and_best": "WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS l, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1 AS best FROM orders) SELECT o_custkey, o_orderkey, round(o_totalprice, 6) AS o_totalprice, best FROM r WHERE l <= 3 OR best",
    "gate_reasons": f"SELECT o_orderkey, {_GATE} AS reason FROM orders",
    "reject_counts": f"SELECT coalesce({_GATE}, 'kept') AS reason, count(*) AS n FROM orders GROUP BY ALL",
    "range_select": "SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, round(p_retailprice, 6) AS p_retailprice FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 900 AND 1500",
    "partial_mask": f"""
WITH d AS (SELECT *, {_D}, CASE WHEN p_size > 10 THEN 1 ELSE 0 END + CASE WHEN p_retailprice IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN p_brand IS NOT NULL THEN 1 ELSE 0 END AS n, CASE WHEN p_size > 10 THEN 0 WHEN p_retailprice IS NOT NULL THEN 1 WHEN p_brand IS NOT NULL THEN 2 END AS f FROM part),
k AS (SELECT *, d0 + d1 + d2 AS k FROM d)
SELECT p_partkey, """ + " || ".join(f"CASE WHEN n >= 2 AND k = 0 AND f = {i} THEN '1' WHEN n >= 2 AND k = n AND f = {i} THEN '0' ELSE CAST(d{i} AS VARCHAR) END" for i in range(3)) + " AS mask FROM k",
    "train_mask": f"WITH d AS (SELECT *, {_D}, {_unit("'9|' || p_partkey || '|mode'")} AS m FROM part) SELECT p_partkey, " + " || ".join(f"CASE WHEN NOT ({'p_size > 10' if f == 'p_size' else f + ' IS NOT NULL'}) OR m BETWEEN 0.1 AND 0.2 THEN '0' WHEN m < 0.1 THEN '1' ELSE CAST(d{i} AS VARCHAR) END" for i, f in enumerate(_FIELDS)) + " AS mask FROM d",
    "augment_choice": f"SELECT p_partkey, {_unit("'2|' || p_partkey || '|mirror'")} < 0.5 AS mirror, round(CASE WHEN {_unit("'2|' || p_partkey || '|change'")} < 0.2 THEN 1 + 0.5 * {_unit("'2|' || p_partkey || '|rate'")} ELSE 1.0 END, 6)::DOUBLE AS rate FROM part",
    "most_common": "SELECT p_brand, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, p_brand LIMIT 10",
    "largest_gaps": "WITH g AS (SELECT l_suppkey, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) - avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0 END) AS gap FROM lineitem GROUP BY ALL) SELECT l_suppkey, round(gap, 6) AS gap FROM g ORDER BY round(abs(gap), 9) DESC, l_suppkey LIMIT 15",
    "manifest_keys": "SELECT doc_id, quality::BIGINT AS quality FROM labels UNION ALL SELECT doc_id, -1 FROM documents ANTI JOIN labels USING (doc_id)",
    "common_keys": "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels",
    "bound_files": """
WITH p AS (SELECT page_id % 25 AS set_id, page_id, lower(regexp_extract(url, '([^/]*)$', 1)) AS b FROM pages), f AS (SELECT DISTINCT set_id, b FROM p WHERE page_id % 3 > 0)
SELECT p.set_id, count(*) AS charts, count(f.b) AS bound, bool_and(f.b IS NOT NULL) AS complete FROM p LEFT JOIN f ON p.set_id = f.set_id AND p.b = f.b GROUP BY ALL""",
}

QUERIES = {
    f.__name__: f
    for f in (
        hash_split, split_counts, split_integrity, split_drift, key_difference, require_subset, seeded_sample, uniform_pick, stratified_pick, donor_map,
        donor_join, scenario_cases, coverage_check, reuse_rows, universe_digest, retain_last_and_best, gate_reasons, reject_counts, range_select,
        partial_mask, train_mask, augment_choice, most_common, largest_gaps, manifest_keys, common_keys, bound_files,
    )
}
