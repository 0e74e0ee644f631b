"""Suffix arrays against sorting, and removed bytes against a plain version over all windows."""

import hashlib
import random
from unittest import mock

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import sketch, suffix_dedup
from millrace.llm.suffix_array import suffix_array


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40))
def test_suffix_array(symbols):
    text = [*symbols, 0]
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def expected(rows, length):
    first, out = {}, []
    last = float("inf")
    texts = [(last if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    for i, t in texts:
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            first[w] = min(first.get(w, last), i)
    for (i, t), (doc, *_) in zip(texts, rows, strict=True):
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if first[t[s : s + length]] < i:
                gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, **more):
    return sorted(map(tuple, suffix_dedup.kept_digests(suffix_dedup.repeated_bytes(df, **more)).collect()), key=str)


def test_small_windows_with_repeats_and_nulls(spark):
    rng = random.Random(3)
    shared = ["".join(rng.choice("ab é") for _ in range(20)) for _ in range(4)]
    rows = []
    for i in range(80):
        rows.append((i, "".join(rng.choice(shared)[rng.randrange(9) :] if rng.random() < 0.5 else "".join(rng.choice("abc\0 ") for _ in range(rng.randint(0, 12))) for _ in range(5)), 1))
    rows += [(100, "ab" * 30, 1), (101, "ab" * 20, 1), (102, None, 1), (103, "", 1), (None, shared[0] + "q", 1), (None, shared[1], 1)]
    rows += [(104, "x" * 30000 + shared[2], 1), (7, shared[2] + "other", 1), (7, shared[2] + "other", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int").repartition(4)
    want = expected(rows, 10)
    assert sum(r[2] for r in want) > 500
    assert run(df, length=10, gram=4) == want
    assert run(df.limit(0)) == []


def test_blocks_of_one_sequence():
    rng = random.Random(8)
    gram = "the common sequence."
    contexts = list({("".join(rng.choice("ab") for _ in range(6)) + gram + "".join(rng.choice("ab") for _ in range(6))).encode() for _ in range(500)})
    ids = np.array(rng.sample(range(10_000), len(contexts)))
    want: dict[bytes, int] = {}
    windows = [(c[k : k + 24], i) for c, i in zip(contexts, ids.tolist(), strict=True) for k in range(len(c) - 23)]
    for w, i in windows:
        want[w] = min(want.get(w, i), i)
    for block in (1 << 17, 1 << 10):
        with mock.patch.object(suffix_dedup, "BLOCK", block):
            least, _, parted = suffix_dedup.least_ids(contexts, np.zeros(len(contexts), np.int32), ids, 24)
        assert parted.all() or block > 1 << 10
        # windows in different arrays are settled by the shuffle that comes after
        lowest = {}
        for (w, _), low in zip(windows, least.tolist(), strict=True):
            lowest[w] = min(low, lowest.get(w, low))
        assert [lowest[w] for w, _ in windows] == [want[w] for w, _ in windows]
        assert parted.any() or least.tolist() == [want[w] for w, _ in windows]


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert run(docs) == expected(list(map(tuple, docs.collect())), 50)


def test_a_sequence_in_many_differing_contexts(spark, monkeypatch):
    """One 20-byte sequence in all texts, dealt in parts and over several suffix arrays; texts longer than a slice."""
    for name, value in (("HOT", 40), ("BLOCK", 1 << 11), ("SLICE", 1 << 12)):
        monkeypatch.setattr(suffix_dedup, name, value)
    monkeypatch.setattr(sketch, "SHARD", 1 << 12)
    rng = random.Random(4)
    gram, near = "0" * 20, ["".join(rng.choice("ab") for _ in range(40)) for _ in range(12)]
    rows = [(i, f"{i:06d}{rng.choice(near)}{gram}{rng.choice(near)}{'x' * (i % 3)}") for i in range(1500)]
    rows += [(5000 + k, "".join(f"{gram}{rng.choice(near)[: rng.randint(5, 40)]}{j}" for j in range(200))) for k in range(3)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = expected(rows, 50)
    assert sum(r[2] > 0 for r in want) > 1000
    assert run(df) == want


def test_a_long_text(spark):
    """A text of several slices, part of which stands in an earlier one, across the edges of slices."""
    rng = random.Random(6)
    long = "".join(f"{rng.getrandbits(40):x} " for _ in range(350_000))
    at = suffix_dedup.SLICE - 100
    df = spark.createDataFrame([(1, long[at : at + 300]), (2, long), (3, long[-60:])], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.kept_digests(suffix_dedup.repeated_bytes(df)).collect()}
    assert got == {1: (300, 0, 0), 2: (len(long), 300, 1), 3: (60, 60, 1)}
