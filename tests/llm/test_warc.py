import random

from pyspark.sql import functions as F

from chronolane.llm.warc import audit, damaged, leaves, tree

SCHEMA = "page_id long, url string, html string, sha256 string"


def pages(n=300):
    return [(i * 7, f"http://x/{i}", f"<p>{'é' * (i % 40)}{i}</p>", "x") for i in range(n)]


def test_locates_every_fault_and_nothing_else(spark):
    a = spark.createDataFrame(pages() + [(None, None, None, None), (14, "http://x/2", "<p>éé2</p>", "x")], SCHEMA)
    b = damaged(a).unionByName(spark.createDataFrame([(3, "u", "extra", "x")], SCHEMA))
    out = {(r.page_id, r.state) for r in audit(a, b).collect()}
    want = {(i, "missing" if i % 97 == 23 else "changed") for i, *_ in pages() if i % 97 in (5, 11, 23)} | {(3, "extra")}
    assert out == want


def test_equal_replicas_in_any_order_have_equal_roots(spark):
    df = spark.createDataFrame(pages(), SCHEMA)
    other = df.orderBy("html").repartition(5)
    assert audit(df, other).count() == 0
    roots = [tree(leaves(d), 4)[-1].collect() for d in (df, other)]
    assert roots[0] == roots[1] and len(roots[0]) == 1


def test_repeats_must_agree_in_number_and_empty_replicas(spark):
    one = spark.createDataFrame([(1, "u", "h", "x")], SCHEMA)
    assert [(r.page_id, r.state) for r in audit(one.unionByName(one), one).collect()] == [(1, "changed")]
    none = spark.createDataFrame([], SCHEMA)
    assert audit(none, none).count() == 0
    assert [r.state for r in audit(one, none).collect()] == ["missing"]


def test_offsets_add_up(spark):
    rows = sorted(leaves(spark.createDataFrame(pages(50), SCHEMA)).collect(), key=lambda r: r.id)
    at = 0
    for r in rows:
        assert r.offset == at
        at += r.length * r.copies


def test_random_corruption_against_a_plain_comparison(spark):
    """Records of two replicas, some without an id, some repeated; each side loses, changes and gains at random."""
    rng = random.Random(4)
    rows = [(rng.choice([None, i, i * 5000, i]), f"u{i}", "h" * rng.randint(0, 90) + str(rng.randint(0, 30)), "x") for i in range(150)]
    rows += rng.sample(rows, 20)
    other = [(i, u, h + rng.choice(["", "", "", "!"]), x) for i, u, h, x in rows if rng.random() > 0.1] + [(777, "new", "body", "x")]
    left, right = (spark.createDataFrame(side, SCHEMA) for side in (rows, other))
    out = audit(left, right).collect()
    count = lambda side: {(r.id, r.sha256): r.copies for r in leaves(side).collect()}
    a, b = count(left), count(right)
    gone, more = [k for k in a if a[k] != b.get(k)], [k for k in b if b[k] != a.get(k)]
    assert sorted(r.sha256_a for r in out if r.sha256_a) == sorted(s for _, s in gone)
    assert sorted(r.sha256_b for r in out if r.sha256_b) == sorted(s for _, s in more)
    assert all((r.state == "missing") == (r.sha256_b is None) and (r.state == "extra") == (r.sha256_a is None) for r in out)


def test_offsets_are_part_of_a_nodes_hash(spark):
    df = leaves(spark.createDataFrame(pages(60), SCHEMA))
    moved = df.withColumn("offset", F.col("offset") + F.col("id") % 2 * 3)
    assert tree(df, 1)[-1].select("hash").exceptAll(tree(moved, 1)[-1].select("hash")).count() > 0


def test_long_record(spark):
    rows = [(1, "u", "é" * 2_000_000, "x"), (2, "u", "z", "x")]
    out = audit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, "u", "é" * 1_999_999 + "e", "x"), rows[1]], SCHEMA)).collect()
    assert [(r.page_id, r.state) for r in out] == [(1, "changed")]
