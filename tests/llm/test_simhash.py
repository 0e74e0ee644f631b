"""SimHash against a plain version that compares all pairs of fingerprints."""

import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from millrace.llm import simhash


def plain_fingerprint(text):
    import re

    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", text)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """id -> least id of the component, over (id, fingerprint) pairs."""
    parent = {i: i for i, _ in prints}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, f) in enumerate(prints):
        for j, g in prints[:x]:
            if (f ^ g).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i, _ in prints}


def test_documents_match_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = [(i, plain_fingerprint(t)) for i, t in texts.items()]
    want = plain_components(prints)
    got = simhash.near_groups(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{f:016x}", want[i]) for i, f in prints}
    assert len(got) == len(prints)


def test_links_with_and_without_crowded_buckets(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {0, (1 << 64) - 1}
    for b in base:
        for _ in range(40):
            f = b
            for _ in range(rng.randint(0, 6)):
                f ^= 1 << rng.randrange(64)
            prints.add(f)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in prints}
    want = plain_components([(s, f) for f, s in signed.items()])
    table = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    for bucket in (256, 3):
        from millrace.llm.components import components

        roots = {r["node"]: r["root"] for r in components(simhash.links(table, bucket)).collect()}
        assert {s: roots.get(s, s) for s in signed.values()} == want
    every = {(min(a, b), max(a, b)) for x, a in signed.items() for y, b in signed.items() if a < b and (x ^ y).bit_count() <= 3}
    assert {(r["a"], r["b"]) for r in simhash.links(table).collect()} == every


def test_no_exploded_keys_are_broadcast(spark):
    """Fingerprints may be few enough to be broadcast where their 68 keys, or 2081 points, are not."""
    rng = random.Random(6)
    table = spark.createDataFrame([(rng.getrandbits(63),) for _ in range(2000)], "fp long").distinct()
    for found in (simhash.links(table), simhash._ball_links(table)):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan.split("Initial Plan")[0]


def test_odd_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (3, " \t", 7), (None, "a b", 7), (5, "A  B", 7), (5, "A  B", 7), (6, "x " * 70000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_groups(df).collect())
    assert got == Counter({(1, 1): 1, (2, 1): 1, (3, 1): 1, (None, 5): 1, (5, 5): 2, (6, 6): 1})
    assert simhash.near_groups(df.limit(0)).count() == 0
    assert simhash.fingerprint("x " * 70000) == simhash.fingerprint("x x x")
    assert df.where(F.col("fp") == 7).count() == 7


def test_pigeonring_keeps_what_is_within_the_budget(spark):
    rng = random.Random(8)
    diffs = [sum(1 << b for b in rng.sample(range(64), rng.randint(0, 40))) for _ in range(4000)]
    rows = spark.createDataFrame([(d - (1 << 64) if d >> 63 else d,) for d in diffs], "d long")
    got = rows.select(F.bit_count("d").alias("n"), simhash.pigeonring(F.col("d"), 24).alias("kept")).collect()
    assert all(r["kept"] for r in got if r["n"] <= 24)
    assert sum(not r["kept"] for r in got if r["n"] > 30) > 100


def test_sign_bits_are_those_of_the_fingerprint():
    words = [f"w{k}" for k in range(200)]
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(198)], np.uint64).view(np.int64)
    assert simhash.sign_bits(hashes) % (1 << 64) == simhash.fingerprint(" ".join(words))
