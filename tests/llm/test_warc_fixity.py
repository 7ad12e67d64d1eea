import hashlib

from conftest_llm import clashing
from pyspark.sql import functions as F

from cohortlens.llm import warc_fixity as W

SCHEMA = "page_id long, url string, html string"


def _pages(rng, n=400):
    return [(k, f"http://x/{k}", "<p>é" + "y" * rng.randint(0, 900)) for k in range(n)] + [(None, None, None), (None, "u", ""), (3, "again", "z" * 70_000), (3, "again", "z" * 70_000)]


def _tree(records):
    return W.tree(records, range_bytes=2048, fanout=4)


def test_layout(spark, rng):
    rows = W.records(clashing(spark, _pages(rng), SCHEMA), per_segment=50, keep_content=True).collect()
    by = {}
    for r in rows:
        assert r.length == len(r.content) and r.digest == hashlib.sha256(r.content).hexdigest()
        by.setdefault(r.segment, []).append(r)
    assert len(rows) == 404 and len(by) == 9
    for records in by.values():
        at = 0
        for r in sorted(records, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length


def test_equal_replicas_have_equal_roots(spark, rng):
    pages = spark.createDataFrame(_pages(rng, 60), SCHEMA)
    one, two = _tree(W.records(pages, per_segment=10)), _tree(W.records(pages.orderBy(F.rand(1)), per_segment=10))
    a, b = W.roots(one, two)
    assert a == b and a is not None
    assert W.audit(one, two, 2048, 4).collect() == []


def test_damage_is_found_exactly(spark, rng):
    pages = spark.createDataFrame(_pages(rng), SCHEMA)
    first = W.records(pages, per_segment=50)
    bad = F.col("page_id").isin(7, 130, 131, 399)
    second = (first.withColumn("digest", F.when(bad, F.reverse("digest")).otherwise(F.col("digest")))
              .filter("page_id is null or page_id not in (20, 256)"))
    found = W.audit(_tree(first.filter("page_id is null or page_id <> 77")), _tree(second), 2048, 4).collect()
    assert sorted((r.page_id, r.status) for r in found) == [(7, "corrupt"), (20, "missing"), (77, "additional"), (130, "corrupt"), (131, "corrupt"), (256, "missing"), (399, "corrupt")]


def test_empty_replicas(spark, rng):
    pages = spark.createDataFrame(_pages(rng, 5), SCHEMA)
    full, none = _tree(W.records(pages)), _tree(W.records(pages.limit(0)))
    assert {r.status for r in W.audit(full, none, 2048, 4).collect()} == {"missing"}
    assert W.audit(none, none, 2048, 4).collect() == [] and W.roots(none) == [None]
