"""Packing: the pieces against the tokenizer library, the sequences against their definition and plain best fit."""

import bisect
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, g in enumerate(gaps) if g >= n]
        if fits:
            k = min(fits, key=lambda k: gaps[k])
            gaps[k] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_rounds_place_every_piece_without_overlap(lengths):
    counts = Counter(lengths)
    matches, opened = packing.match_rounds(counts, 50)
    filled = defaultdict(list)
    for n, count in counts.items():
        own = matches[matches[:, 0] == n]
        for rank in range(count):
            _, first, each, sequence, offset = own[np.searchsorted(own[:, 1], rank, "right") - 1].tolist()
            filled[sequence + (rank - first) // each].append((offset + (rank - first) % each * n, n))
    assert sorted(filled) == list(range(opened))
    for places in filled.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 50
    assert opened == best_fit_decreasing(lengths, 50)


@pytest.mark.parametrize(("mean", "deviation", "count"), [(5.5, 1.2, 3000), (6.3, 0.8, 10_000), (7.0, 1.0, 20_000)])
def test_rounds_need_no_more_than_best_fit(mean, deviation, count):
    rng = random.Random(1)
    lengths = [n for n in (int(rng.lognormvariate(mean, deviation)) + 1 for _ in range(count)) if n <= 2048]
    _, opened = packing.match_rounds(Counter(lengths), 2048)
    gaps = []  # sorted
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, n)
        left = gaps.pop(k) - n if k < len(gaps) else 2048 - n
        bisect.insort(gaps, left)
    assert opened == len(gaps)


def test_rounds_over_a_million_lengths_stay_near_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.minimum(2048, rng.lognormal(6.3, 1.0, 1_000_000).astype(int) + 1)
    matches, opened = packing.match_rounds(Counter(lengths.tolist()), 2048)
    assert opened <= -(-int(lengths.sum()) // 2048) * 1.001
    assert len(matches) < 50_000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("aB 'séÉ\n\t\x1c　.<|>1ΣİŹ", max_size=40)), max_size=4))
def test_any_text_as_the_library(texts):
    for text, ids in zip(texts, packing.encode_by_words(texts, PATH), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_words_that_a_worker_holds_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5000)
    packing._words.cache_clear()
    texts = [" ".join(["The", "lot", *(f"q{k}x{j}" for j in range(400))]) for k in range(500)]
    tracemalloc.start()
    lengths = [len(ids) // 4 for ids in packing.encode_by_words(texts, PATH)]
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    packing._words.cache_clear()
    assert peak < 35e6
    assert lengths[::99] == [len(LIBRARY.encode(t, add_special_tokens=False).ids) for t in texts[::99]]


def test_words_come_back_out_of_the_older_generation(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    monkeypatch.setattr(packing, "SLICE", 1)
    packing._words.cache_clear()
    texts = ["a b", "c a", "d a <|endoftext|>", "E,f A", "a <|EndOfText|> <|startoftext|>x", "", "b c d e's", "a b"] * 3
    for text, ids in zip(texts, packing.encode_by_words(texts, PATH), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    packing._words.cache_clear()


def check(rows, got, capacity):
    want = Counter()
    for i, text, _ in rows:
        ids = np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for p, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want[(i, p, a, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in filled.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(filled)


def test_documents_and_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"], 1) for r in docs]
    rows += [(None, None, 1), (9000, "", 1), (9001, " \n", 1), (9002, "a <|endoftext|>b <|ENDOFTEXT|> İstanbul", 1), (9003, "word, " * 4000, 1), (9003, "word, " * 4000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(5)
    got = packing.pack(df, PATH).collect()
    used = check(rows, got, 2048)
    assert used <= best_fit_decreasing([r["length"] for r in got], 2048)
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_plain_words_are_cut_here_and_only_merged_by_the_library(monkeypatch):
    table = packing._Words(PATH)
    full, asked = packing._Words._encoded, []
    monkeypatch.setattr(packing._Words, "_encoded", lambda self, texts: asked.extend(texts) or full(self, texts))
    rng = random.Random(3)
    parts = ["th", "Er", "'s", "'LL", "'", "1", "²½", "é", "ß", "ÀÖ", "ǆ", "ɏ", "&&", "_", "|", "ª", "µ", "×", "</w>", "<", "ĳ"]
    words = list({"".join(rng.choices(parts, k=rng.randint(1, 9))).replace("<|", "") for _ in range(5000)} - {""})
    table.learn({w.encode() for w in words})
    assert not asked  # neither the library's normalizer nor its pattern
    # every character by itself and between letters; some are no plain ones, and some become so when lower-cased
    words += [w for c in map(chr, [*range(33, 0xD800), *range(0xE000, 0x10000, 7), 0x1F600]) if not c.isspace() for w in (c, f"a{c}B")]
    table.learn({w.encode() for w in words})
    for w, code in zip(words, table.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
        assert np.frombuffer(table.newer[w.encode()], "<u4").tolist() == code.ids, w
