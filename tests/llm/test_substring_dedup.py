"""Removed windows against a plain version over all windows."""

import hashlib
import random

from millrace.llm import substring_dedup as sd


def expected(rows, window):
    first, out = {}, []
    words = [((i is None, i or 0), (t or "").encode().split()) for i, t, *_ in rows]
    for i, w in words:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, (i, s)), (i, s))
    for (i, w), (doc, *_) in zip(words, rows, strict=True):
        gone = {s + k for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < (i, s) for k in range(window)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def run(df, **more):
    window = more.get("window", sd.WINDOW)
    return sorted(map(tuple, sd.kept_digests(sd.repeated_windows(df, **more), window=window).collect()), key=str)


def rows_with_repeats():
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "the", "Über", "x."])
    shared = [" ".join(word() for _ in range(9)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 9))) for _ in range(4)]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(parts), 1))
    rows += [(100, "a b " * 12, 1), (101, "a " * 30, 1), (102, None, 1), (103, "", 1), (None, shared[0] + " q", 1), (None, shared[1], 1)]
    return rows + [(7, "other " + shared[2], 1), (7, "other " + shared[2], 1), (104, " ".join(shared) + " z" * 20000, 1)]


def test_small_windows_with_ties_repeats_and_nulls(spark):
    rows = rows_with_repeats()
    df = spark.createDataFrame(rows, "doc_id long, text string, starts int").repartition(4)
    want = expected(rows, 6)
    assert sum(r[2] for r in want) > 50
    assert run(df, window=6, gram=3) == want
    assert run(df, window=6, gram=3, hot=4) == want  # hot cells in salted parts
    assert run(df.limit(0)) == []


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert run(docs) == expected(list(map(tuple, docs.collect())), 20)
