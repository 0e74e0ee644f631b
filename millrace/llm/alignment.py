"""Two tokenizers over the same texts: which of their tokens cover the same bytes, and how often over the whole corpus.

Both token sequences of a text are cut at the same bytes, so their cumulative ends are merged with two pointers, one a
side. Each merged end closes one link, the tokens on which both pointers stand; ends that both sides share close a group.
This runs inside ``mapInPandas``, which takes texts in chunks of bounded size and gives a row a chunk: the numbers of its
documents, the distinct id pairs linked in it, how often, and which documents hold them. Pairs therefore move once a chunk
and not once a document. Spark adds up the pairs of all chunks, takes the maxima of both sides, joins both to the pairs and
sends them back to the chunks, where each document sums its own.

Ids of A are those of a byte-level tokenizer file, whose entries are decoded to bytes, and ids of B those of a SentencePiece
model with byte fallback, which puts a space in front. Both work on a space and the text. A text whose joined token bytes
differ from these on either side has no tokens here, as has a null or an empty one.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe import MASK, PATTERN, slices, vocabulary
from millrace.llm.common import checkpointed

#: Characters of text in a chunk; a longer text is a chunk of its own.
CHUNK = 4_000_000
#: Characters of text whose tokens are held at once.
AT_ONCE = 1 << 18
#: Stand-in for the space in pieces (fixed value).
MARK = "▁"


class Tokens(NamedTuple):
    """Ids of both sides of a text, and the number of tokens of each side up to the end of each group."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    links: np.ndarray  # positions in a and in b, one column a link


NONE = Tokens(*[np.zeros(0, np.int64)] * 4, np.zeros((2, 0), np.int64))


#: Characters about which versions of Unicode may differ are all but these; white space that is too long for the faster library.
_OTHER, _BLANKS = re.compile("[^\0-\u024f\u2010-\u2027]"), re.compile(r"\s{1000}")


def byte_level(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Encodes texts by a byte-level tokenizer file, added tokens as plain text.

    Where ids go by the rank of their merge, merging what gives the least id is merging by rank, so texts in whose characters
    no two versions of Unicode differ can go to the faster of two libraries; the others go to the tokenizer's own.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    own.encode_special_tokens = True
    vocab = vocabulary(path)
    ranks = {x: k for x, k in vocab.ids.items() if k not in vocab.added.values()}
    merges = [v & MASK for _, v in sorted(vocab.pairs.items(), key=lambda x: x[1])]
    by_rank = merges == sorted(set(merges)) and {*merges, *vocab.bytes} == {*ranks.values()}
    fast = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if by_rank else None

    def encode(texts: list[str]) -> list[list[int]]:
        easy = [fast is not None and not _OTHER.search(t) and not _BLANKS.search(t) for t in texts]
        others = iter([e.ids for e in own.encode_batch_fast([t for t, x in zip(texts, easy, strict=True) if not x], add_special_tokens=False)])
        return [fast.encode_ordinary(t) if x else next(others) for t, x in zip(texts, easy, strict=True)]

    return encode


class _Pair:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece

        b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a, self.b = byte_level(a_path), partial(b.encode, num_threads=1)
        texts = vocabulary(a_path).texts
        self.a_bytes = [texts.get(k, b"") for k in range(max(texts) + 1)]
        pieces = [b.id_to_piece(k) for k in range(b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if b.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        # the decimal of each id with each of the marks that can follow it
        self.written = np.array([f"{k}{mark}".encode() for k in range(max(len(self.a_bytes), len(self.b_bytes))) for mark in ",|;"], object)

    def align(self, texts: list[str]) -> Iterator[Tokens]:
        """The merged tokens of each text."""
        full = [" " + t for t in texts]
        for text, a, b in zip(full, self.a(full), self.b(texts), strict=True):
            data = text.encode()
            same = all(b"".join(map(table.__getitem__, ids)) == data for table, ids in ((self.a_bytes, a), (self.b_bytes, b)))
            yield merged(*(np.frombuffer(array("I", x), np.uint32).astype(np.int64) for x in (a, b)), self.a_sizes, self.b_sizes) if same and len(text) > 1 else NONE

    def groups_digest(self, tokens: Tokens) -> str:
        """Hash of the groups as ``a1,a2|b1;a3|b2,b3``; an empty string without tokens."""
        if not len(tokens.a):
            return ""
        a_from, b_from = (np.concatenate([[0], ends[:-1]]) for ends in (tokens.a_ends, tokens.b_ends))
        out = np.empty(len(tokens.a) + len(tokens.b), object)
        a_marks, b_marks = 3 * tokens.a, 3 * tokens.b
        a_marks[tokens.a_ends - 1] += 1
        b_marks[tokens.b_ends - 1] += 2
        out[np.arange(len(tokens.a)) + np.repeat(b_from, tokens.a_ends - a_from)] = self.written[a_marks]
        out[np.arange(len(tokens.b)) + np.repeat(tokens.a_ends, tokens.b_ends - b_from)] = self.written[b_marks]
        return hashlib.sha256(b"".join(out.tolist())[:-1]).hexdigest()


def merged(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> Tokens:
    """Links and groups of two token sequences that cover the same bytes; no token is empty."""
    a_at, b_at = a_sizes[a].cumsum(), b_sizes[b].cumsum()
    ending = np.zeros(int(a_at[-1]) + 1, np.uint8)  # for each byte, which sides end there
    ending[a_at] = 1
    ending[b_at] |= 2
    ending = ending[ending > 0]
    steps = np.stack([ending & 1, ending >> 1]).astype(np.int64)
    moved = steps.cumsum(axis=1)  # both pointers after each end
    shared = moved[:, ending == 3]
    return Tokens(a, b, shared[0], shared[1], moved - steps)


@lru_cache(maxsize=2)
def _pair(a_path: str, b_path: str) -> _Pair:
    return _Pair(a_path, b_path)


def _rows(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows, rows.schema["id"].dataType.simpleString()


def alignments(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, the ids ``a`` and ``b`` of each row's text, the ends ``a_ends`` and ``b_ends`` of its groups as numbers of tokens,
    and its links as positions ``link_a`` and ``link_b`` in the ids.

    Texts without tokens have empty arrays. Repeated rows come back as often as they were; null ids are kept; an empty table
    gives an empty one. Other columns of ``df`` may have any names. A text is held whole in its task.
    """
    rows, kind = _rows(df, id_col, text_col)

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = _pair(a_path, b_path)
        for batch in batches:
            ids, texts = batch["id"].astype(object).where(batch["id"].notna(), None).tolist(), [t or "" for t in batch["text"]]
            for start, end in slices(texts, AT_ONCE):
                out = [(i, t.a, t.b, t.a_ends, t.b_ends, *t.links) for i, t in zip(ids[start:end], pair.align(texts[start:end]), strict=True)]
                yield pd.DataFrame(out, columns=["id", "a", "b", "a_ends", "b_ends", "link_a", "link_b"])

    arrays = ", ".join(f"{x} array<int>" for x in ("a", "b", "a_ends", "b_ends", "link_a", "link_b"))
    return rows.mapInPandas(aligned, f"id {kind}, {arrays}")


def chunk_rows(df: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, chunk_chars: int) -> DataFrame:
    """A row for each chunk of texts: the numbers of its documents, its distinct pairs (a * 2^32 + b) and their numbers of links,
    and for each document how many of these pairs it holds (``held``), which (``codes``) and how often (``times``)."""
    rows, kind = _rows(df, id_col, text_col)
    names = ["chunk", "ids", "n_a", "n_b", "n_groups", "n_links", "digests", "held", "codes", "times", "pairs", "counts"]

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, part, nth = _pair(a_path, b_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch["id"].astype(object).where(batch["id"].notna(), None).tolist(), [t or "" for t in batch["text"]]
            for first, last in slices(texts, chunk_chars):
                numbers, digests, pairs, times = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for start, end in slices(texts[first:last], AT_ONCE):
                    for t in pair.align(texts[first + start : first + end]):
                        keys, often = np.unique((t.a[t.links[0]] << 32) | t.b[t.links[1]], return_counts=True)
                        numbers.append((len(t.a), len(t.b), len(t.a_ends), t.links.shape[1], len(keys)))
                        digests.append(pair.groups_digest(t))
                        pairs.append(keys)
                        times.append(often)
                distinct, codes = np.unique(np.concatenate(pairs), return_inverse=True)
                times = np.concatenate(times)
                counts = np.zeros(len(distinct), np.int64)
                np.add.at(counts, codes, times)
                n_a, n_b, n_groups, n_links, held = map(list, zip(*numbers, strict=True))
                packed = [codes.astype("<u4").tobytes(), times.astype("<u4").tobytes()]
                yield pd.DataFrame([[(part << 32) + nth, ids[first:last], n_a, n_b, n_groups, n_links, digests, held, *packed, distinct, counts]], columns=names)
                nth += 1

    numbers = ", ".join(f"{x} array<long>" for x in ("n_a", "n_b", "n_groups", "n_links"))
    return rows.mapInPandas(
        counted, f"chunk long, ids array<{kind}>, {numbers}, digests array<string>, held array<int>, codes binary, times binary, pairs array<long>, counts array<long>"
    )


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Of all rows (pair, n): ``n`` links of each pair, and whether that is the most of its A id (``best_a``) and its B id (``best_b``)."""
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", 32)).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    counts = checkpointed(counts)
    for side in ("a", "b"):
        counts = counts.join(counts.groupBy(side).agg(F.max("n").alias(f"most_{side}")), side)
    return counts.select("pair", "n", (F.col("n") == F.col("most_a")).alias("best_a"), (F.col("n") == F.col("most_b")).alias("best_b"))


def link_statistics(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK) -> DataFrame:
    """For each row: its id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose count over all rows is the highest of their
    B id, ties included), ``count_sum`` (over its links), ``groups_sha256`` (see ``groups_digest``) and ``n_best_a`` (as n_best, of the A id).

    Texts without tokens count zeros and an empty digest. Repeated rows come back, and count, as often as they were; null ids
    are kept; an empty table gives an empty one. Other columns of ``df`` may have any names. A text is held whole in its task.
    """
    rows, kind = _rows(df, id_col, text_col)
    chunks = checkpointed(chunk_rows(df, a_path, b_path, id_col, text_col, chunk_chars))
    pairs = chunks.select(F.col("chunk").alias("of"), F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("of", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    back = pairs.select("of", "pair").join(pair_counts(pairs), "pair")
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_a"]

    def summed(chunk: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """Numbers of the documents of one chunk from those of its pairs; codes are ranks of its pairs."""
        if not len(chunk):
            return pd.DataFrame(columns=names)
        row, known = chunk.iloc[0], known.sort_values("pair")
        held = np.asarray(row["held"], np.int64)
        doc, codes, times = np.repeat(np.arange(len(held)), held), np.frombuffer(row["codes"], "<u4"), np.frombuffer(row["times"], "<u4").astype(np.int64)

        def total(values: pd.Series) -> np.ndarray:
            out = np.zeros(len(held), np.int64)
            np.add.at(out, doc, times * values.to_numpy().astype(np.int64)[codes])
            return out

        sums = [total(known[x]) for x in ("best_b", "n")]
        return pd.DataFrame(dict(zip(names, [row["ids"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], *sums, row["digests"], total(known["best_a"])], strict=True)))

    longs = ", ".join(f"{x} long" for x in names[1:7])
    return (
        chunks.select("chunk", "ids", "n_a", "n_b", "n_groups", "n_links", "digests", "held", "codes", "times")
        .groupBy("chunk").cogroup(back.groupBy("of")).applyInPandas(summed, f"`{id_col}` {kind}, {longs}, groups_sha256 string, n_best_a long")
    )
