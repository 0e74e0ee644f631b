"""The audit against loops over documents, orders and steps."""

import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from millrace.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, mask int, first string, n string"


def expected(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        conditions = (
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)),
            i is not None and any(j is not None and j < i and (u or "") == text for j, u, _ in rows),
        )
        fails.append((i, part or "", {f for f, c in zip("ABCDE", conditions, strict=True) if c}))
    out = {}
    shapley = Counter()
    for order in permutations("ABCDE"):
        for i, part, failed in fails:
            first = next((f for f in order if f in failed), None)
            shapley[part, first] += 1
            for step, f in enumerate(order, 1):
                row = out.setdefault((part, "".join(order), step), [0] * 6)
                row[0] += not failed & set(order[:step])
                row[1] += f == first
                row[2] += f in failed and f != first
                row[3] += failed == {f}
                row[4] += f == first and i in good
                row[5] += f == first and i in toxic
    return sorted((part, order, step, *values, shapley[part, order[step - 1]]) for (part, order, step), values in out.items())


def words(k, n):
    return " ".join(f"w{(k * 7 + j) % 61}x" for j in range(n))


ROWS = [
    (1, words(1, 60), "s"), (2, words(1, 60), "s"), (2, words(1, 60), "s"), (None, words(1, 60), "s"), (3, words(1, 60), None), (4, None, "s"), (5, "", "s"), (6, None, None),
    (7, "A" * 5 + "b" * 95, "t"), (8, "A" * 6 + "b" * 94, "t"), (9, "x # y", "t"), (10, words(2, 200), "t"), (11, "äÄ É " * 60, "t"), (12, words(3, 49), "t"), (13, words(4, 50) + " |", "u"),
    (14, "one\x0btwo\x0cthree four five", "u"), (15, "AB " * 40000, "u"), (16, "AB " * 40000, "u"), (17, " ", "u"), (None, None, "u"), *((100 + k, words(5, 70), "hot") for k in range(60)),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 1), (8, 0, 1), (10, 1, 1), (16, 1, None), (None, 1, 1), (9999, 1, 1), *((100 + k, k % 2, k % 3) for k in range(60))]


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_as_by_loops(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*r, 5, "f", "n") for r in ROWS], SCHEMA).repartition(3)
        labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
        assert sorted(map(tuple, filter_audit.audit(df, labels).collect())) == expected(ROWS, LABELS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_tables_without_rows(spark):
    df, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(df, labels).count() == 0
    one = spark.createDataFrame([(1, "x", "s", 1, "", "")], SCHEMA)
    assert sorted(map(tuple, filter_audit.audit(one, labels).collect())) == expected([(1, "x", "s")], [])


def test_query_equals_sql(spark, sf_dir):
    from millrace.llm import queries

    duck = duckdb.connect()
    for name in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    got = queries.op12_filter_audit(spark, sf_dir).toPandas()
    want = duck.execute(queries.oracle_sql()["op12_filter_audit"]).df()[list(got.columns)]
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False)))
