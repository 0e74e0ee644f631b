"""Exact groups against grouping the normalised texts themselves."""

import hashlib
import re
from collections import defaultdict

from millrace.llm import exact_dedup


def expected(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for i, t, *_ in rows:
        norm = re.sub("[\x20\x09-\x0d]", "", t or "")
        keep = min(groups[norm], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows_and_shared_starts(spark):
    long = "x" * 100
    rows = [(1, "a b", 1), (2, "ab ", 1), (3, "a  b", 1), (4, None, 1), (5, "", 1), (6, " \n", 1), (None, "ab\t ", 1), (7, long + "1", 1), (8, long + "2", 1), (9, long + " 1", 1), (10, "ba", 1), (9, long + " 1", 1), (11, "é " * 30000, 1), (12, "é" * 30000, 1), (13, "a b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = exact_dedup.exact_groups(df, digest=True)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
    lazy = exact_dedup.exact_groups(df).collect()
    assert {r["doc_id"] for r in lazy if r["text_sha256"] is None} == {10}  # only its length is shared
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0
    assert sorted(r["doc_id"] or 0 for r in exact_dedup.drop_exact_duplicates(df).collect()) == [3, 6, 8, 9, 9, 10, 11]
    same = spark.createDataFrame([(1, "a"), (1, "b"), (0, "b "), (2, "b")], "doc_id long, text string")  # an id with two texts
    assert sorted(map(tuple, exact_dedup.drop_exact_duplicates(same).collect())) == [(0, "b "), (1, "a")]


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, exact_dedup.exact_groups(docs, digest=True).collect()), key=str) == expected(list(map(tuple, docs.collect())))
