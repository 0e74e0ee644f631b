"""Alignment of two tokenizers against plain loops over byte ranges."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm import alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def spans(text):
    """(id, start, end) of both sides in bytes, or two empty lists; A's entries are decoded one byte at a time by the library."""
    if not text:
        return [], []
    whole, sides = (" " + text).encode(), []
    a_bytes = []
    byte_chars = {c: b for b, c in bytes_to_chars().items()}
    for k in A.encode(" " + text, add_special_tokens=False).ids:
        a_bytes.append((k, bytes(byte_chars[c] for c in A.id_to_token(k))))
    b_bytes = [(k, bytes([int(B.id_to_piece(k)[3:5], 16)]) if B.is_byte(k) else B.id_to_piece(k).replace("▁", " ").encode()) for k in B.encode(text)]
    for side in (a_bytes, b_bytes):
        if b"".join(x for _, x in side) != whole:
            return [], []
        at, out = 0, []
        for k, x in side:
            out.append((k, at, at + len(x)))
            at += len(x)
        sides.append(out)
    return sides


def bytes_to_chars():
    """Read back from the library: what each byte becomes."""
    from tokenizers import pre_tokenizers

    shown = {}
    for b in range(256):
        data = bytes([b]) if b < 128 else None
        if data is None:
            continue
        shown[b] = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(data.decode())[0][0]
    for c in range(128, 0x800):  # two bytes: both seen
        two = chr(c).encode()
        chars = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0]
        shown[two[0]], shown[two[1]] = chars
    for text in ("ࠀ", "￿", "\U00010000", "\U0010ffff", *(chr(k << 12) for k in range(1, 16) if k != 13), *(chr(k << 18) for k in range(1, 4))):
        chars = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(text)[0][0]
        shown.update(zip(text.encode(), chars, strict=True))
    return shown


def expected(rows):
    each, counts = [], Counter()
    for i, text in rows:
        a, b = spans(text)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, before = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(k) for k, s, e in side if before <= s < cut) for side in (a, b)))
            before = cut
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        each.append((i, len(a), len(b), len(cuts), links, digest))
        counts.update(links)
    most_a, most_b = defaultdict(int), defaultdict(int)
    for (x, y), n in counts.items():
        most_a[x], most_b[y] = max(most_a[x], n), max(most_b[y], n)
    return [
        (i, n_a, n_b, n_groups, len(links), sum(counts[p] == most_b[p[1]] for p in links), sum(counts[p] for p in links), digest, sum(counts[p] == most_a[p[0]] for p in links))
        for i, n_a, n_b, n_groups, links, digest in each
    ]


ODD = [None, "", " ", "\n\n", "a▁b", "<|endoftext|>", "<s> </s> <unk> <0x41>", "日本語 naïve ☃🙂", "x" * 700, "tab\tnew\r\nline  two", "the the the cat", "\u0000 nul", "é"]


def rows_of(spark, sf_dir):
    docs = [(r["doc_id"], r["text"][:600]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    return [*docs, *((9000 + k, t) for k, t in enumerate(ODD)), (None, "null id"), (9000, "again"), (9000, "again")]


@pytest.mark.parametrize("chunk", [alignment.CHUNK, 500])
def test_statistics_as_by_loops(spark, sf_dir, chunk):
    rows = rows_of(spark, sf_dir)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, id string, chunk int").repartition(5)
    got = [tuple(r) for r in alignment.link_statistics(df, A_PATH, B_PATH, chunk_chars=chunk).collect()]
    assert sorted(got, key=repr) == sorted(expected(rows), key=repr)


def test_groups_and_links_of_rows(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id int, text string")
    for row in alignment.alignments(df, A_PATH, B_PATH).collect():
        a, b = spans(ODD[row["id"]])
        assert row["a"] == [x[0] for x in a] and row["b"] == [x[0] for x in b]
        assert list(zip(row["link_a"], row["link_b"], strict=True)) == [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        assert row["a_ends"] == [sum(x[2] <= c for x in a) for c in cuts] and row["b_ends"] == [sum(x[2] <= c for x in b) for c in cuts]


def test_tables_without_tokens_or_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.link_statistics(empty, A_PATH, B_PATH).count() == 0 and alignment.alignments(empty, A_PATH, B_PATH).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.link_statistics(blank, A_PATH, B_PATH).collect())) == [(1, 0, 0, 0, 0, 0, 0, "", 0), (2, 0, 0, 0, 0, 0, 0, "", 0)]
