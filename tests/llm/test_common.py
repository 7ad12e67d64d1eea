from pyspark.sql import functions as F

from cohortlens.llm.common import smallest


def test_smallest_hashes_are_those_of_a_full_sort(spark):
    rows = spark.range(20_000).withColumn("h", F.xxhash64("id"))
    for most in (1, 7, 100, 5000, 30_000):
        want = sorted(r.h for r in rows.collect())[:most]
        assert [r.h for r in smallest(rows, "h", most, "id").collect()] == want
