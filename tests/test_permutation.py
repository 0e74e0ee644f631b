"""Keyed permutations of ranks, and profiles in one reading."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import audit, permutation


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 100, 997, 3000])
def test_bijection(spark, size):
    places = [r[0] for r in spark.range(size).select(permutation.permuted(F.col("id"), size, 7)).collect()]
    assert sorted(places) == list(range(size))
    height, width = permutation.sides(size)
    assert size <= height * width < size + height
    if size >= 100:  # neither in order nor near it
        assert sum(a < b for a, b in zip(places, places[1:])) < 0.6 * size and sum(k == p for k, p in enumerate(places)) < 8


def test_order_depends_on_seed_and_keys_only(spark):
    df = spark.createDataFrame([(f"k{k:03d}", k) for k in range(500)], "key string, place0 int")
    order = lambda d, seed: {r["key"]: r["place"] for r in permutation.in_seeded_order(d, [F.col("key")], seed).collect()}
    one = order(df.repartition(7), 1)
    assert one == order(df.orderBy(F.desc("key")).coalesce(2), 1) != order(df, 2)
    small, large = ({r["key"] for r in permutation.seeded_sample(df, [F.col("key")], n, 1).collect()} for n in (50, 80))
    assert len(small) == 50 and len(large) == 80 and small < large
    assert permutation.in_seeded_order(df.limit(0), [F.col("key")], 1).count() == 0


def test_profile(spark):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("b", 1, "y"), (None, 1, "y"), (None, None, None)]
    df = spark.createDataFrame(rows, "g string, n int, axis string")
    out = audit.profile(df, {"group": F.col("g"), "number": F.col("n")}, {"texts": F.col("axis")})
    got = {(r["axis"], r["bucket"]): (r["n"], round(r["share"], 3), r["texts"]) for r in out.collect()}
    assert got == {
        ("all", None): (5, 1.0, 2), ("group", "a"): (2, 0.4, 1), ("group", "b"): (1, 0.2, 1), ("group", None): (2, 0.4, 1), ("number", "1"): (3, 0.6, 2), ("number", "2"): (1, 0.2, 1), ("number", None): (1, 0.2, 0),
    }
    assert audit.profile(df.limit(0), {"group": F.col("g")}, {}).count() == 0


def test_profile_reads_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id % 3 AS a", "id % 5 AS b", "id % 7 AS c").write.parquet(path)
    df = spark.read.parquet(path)
    counted = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            counted.add(batch.num_rows)
            yield batch

    audit.profile(df.mapInArrow(passed, df.schema), {x: F.col(x) for x in "abc"}, {"d": F.col("a")}).collect()
    assert counted.value == 100


def test_provenance(spark):
    df = spark.createDataFrame([(2, "m2", "v"), (1, "m1", "v"), (3, None, "v")], "id int, model string, version string")
    assert sorted(map(tuple, audit.provenance(df, ["model", "version"], F.col("id")).collect())) == [("model", "m1", 2), ("version", "v", 1)]
