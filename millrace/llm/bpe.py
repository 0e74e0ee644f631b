"""Byte-level BPE encoding and decoding with a lexicon of frequent words.

A text falls into words (a run of characters other than white space with a space before it, or white space) at whose
edges no token of the vocabulary can reach across, as the pre-tokenizer's pattern cuts there too. The frequent words of
the corpus are found with mergeable summaries, encoded once on the driver, whose work is bounded by their number, and
compiled into a transducer that is shipped to every machine. Other words are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed
from millrace.llm.lexicon import Lexicon, compile_lexicon

#: Frequent words in the lexicon, and entries of a summary: every word that makes up more than one in SUMMARY is found.
LEXICON_WORDS, SUMMARY = 1 << 16, 1 << 17
#: Bytes of a word beyond which it is never in the lexicon.
LONGEST = 256
#: Characters of texts that are handled at once, and rows at most; unseen words that a worker remembers.
SLICE, ROWS, REMEMBERED = 1 << 19, 512, 400_000
#: Bytes beyond which a pre-token is merged with a heap.
LONG = 200
#: Bytes of a pre-token, and pre-tokens, up to which those of about one length are merged in step.
SHORT, TOGETHER = 64, 2048
BITS = 17
MASK, NONE = (1 << BITS) - 1, 1 << 62
# The characters of the Unicode property White_Space (fixed values).
_WS = "\t-\r \x85\xa0  -     　"
_WORD = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
# The pattern of the public byte-level vocabulary's pre-tokenizer (fixed value).
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
_TOKEN = regex.compile(PATTERN)


def _byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file, by character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Vocabulary:
    """Ids, merges and added tokens of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = _byte_characters()
        as_bytes = lambda token: bytes(back[c] for c in token)
        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        # the ids of a pair -> its rank and the id of the two together, in one number that sorts by rank
        ids = spec["model"]["vocab"]
        self.pairs = {ids[a] << BITS | ids[b]: k << BITS | ids[a + b] for k, (a, b) in enumerate(pairs)}
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.values = np.array([self.pairs[k] for k in self.keys.tolist()], np.int64)
        self.bytes = [self.ids[bytes([b])] for b in range(256)]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def merge(self, token: bytes) -> list[int]:
        """The ids of one pre-token: the pair of lowest rank, leftmost first, is merged until none is left."""
        if len(token) > LONG:
            return self._merge_long(token)
        single, get = self.bytes, self.pairs.get
        parts = [single[b] for b in token]
        found = [get(a << BITS | b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while found:
            best = min(found)
            if best == NONE:
                break
            at = found.index(best)
            parts[at : at + 2] = [best & MASK]
            del found[at]
            if at:
                found[at - 1] = get(parts[at - 1] << BITS | parts[at], NONE)
            if at < len(found):
                found[at] = get(parts[at] << BITS | parts[at + 1], NONE)
        return parts

    def _merge_long(self, token: bytes) -> list[int]:
        """The same with a heap of pairs, for tokens in which looking for the least each time would take long."""
        get = self.pairs.get
        parts: list[int | None] = [self.bytes[b] for b in token]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(v, k) for k in range(len(parts) - 1) if (v := get(parts[k] << BITS | parts[k + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            value, k = heapq.heappop(heap)
            n = after[k] if parts[k] is not None else len(parts)
            if n >= len(parts) or get(parts[k] << BITS | parts[n], NONE) != value:
                continue  # one of the two has been merged since
            parts[k], parts[n] = value & MASK, None
            after[k] = after[n]
            if after[k] < len(parts):
                before[after[k]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < len(parts) and (v := get(parts[left] << BITS | parts[right], NONE)) != NONE:
                    heapq.heappush(heap, (v, left))
        return [p for p in parts if p is not None]

    def _found(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The entries of many pairs."""
        if not len(self.keys):
            return np.full(len(a), NONE)
        pairs = a << BITS | b
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.values[at], NONE)

    def merge_all(self, tokens: list[bytes]) -> list[bytes]:
        """``merge`` of many pre-tokens, as little-endian unsigned 32-bit integers; short ones take each step together."""
        out = [b""] * len(tokens)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        for k in np.flatnonzero(sizes > SHORT).tolist():
            out[k] = np.array(self.merge(tokens[k]), "<u4").tobytes()
        order = np.argsort(sizes, kind="stable")[: np.count_nonzero(sizes <= SHORT)]
        for a in range(0, len(order), TOGETHER):
            self._merge_step_by_step(tokens, order[a : a + TOGETHER], sizes, out)
        return out

    def _merge_step_by_step(self, tokens: list[bytes], own: np.ndarray, sizes: np.ndarray, out: list[bytes]) -> None:
        n = sizes[own]
        column = np.arange(max(1, n.max()))
        inside = column < n[:, None]
        parts, found = np.zeros(inside.shape, np.int64), np.full(inside.shape, NONE)
        parts[inside] = np.array(self.bytes, np.int64)[np.frombuffer(b"".join(tokens[k] for k in own.tolist()), np.uint8)]
        pair = inside[:, 1:]
        found[:, :-1][pair] = self._found(parts[:, :-1][pair], parts[:, 1:][pair])
        while len(own):
            at = found.argmin(axis=1)  # the lowest rank, leftmost first
            best = found[np.arange(len(own)), at]
            ended = best == NONE
            if ended.any():
                data = parts[ended][column < n[ended][:, None]].astype("<u4").tobytes()
                ends = (4 * np.cumsum(n[ended])).tolist()
                for k, x, y in zip(own[ended].tolist(), [0, *ends], ends, strict=False):
                    out[k] = data[x:y]
                own, n, at, best, parts, found = (x[~ended] for x in (own, n, at, best, parts, found))
            row, last = np.arange(len(own)), len(column) - 1
            parts = np.take_along_axis(parts, np.minimum(column + (column > at[:, None]), last), 1)
            found = np.take_along_axis(found, np.minimum(column + (column >= at[:, None]), last), 1)
            parts[row, at] = best & MASK
            n = n - 1
            left, right = row[at > 0], row[at < n - 1]
            found[left, at[left] - 1] = self._found(parts[left, at[left] - 1], parts[left, at[left]])
            found[right, at[right]] = self._found(parts[right, at[right]], parts[right, at[right] + 1])

    def encode_words(self, words: list[str]) -> list[bytes]:
        """``encode_word`` of many words, as little-endian unsigned 32-bit integers."""
        split = [[w] if w.isalpha() or (w[:1] == " " and w[1:].isalpha()) else _TOKEN.findall(w) for w in words]
        tokens = list({t for part in split for t in part})
        merged = dict(zip(tokens, self.merge_all([t.encode() for t in tokens]), strict=True))
        return [b"".join(map(merged.__getitem__, part)) for part in split]

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word, merged exactly."""
        if word.isalpha() or (word[:1] == " " and word[1:].isalpha()):  # letters only: one pre-token
            return self.merge(word.encode())
        return [i for token in _TOKEN.findall(word) for i in self.merge(token.encode())]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def _lexicon(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


class _Memory(dict):
    """Words that a worker has met and their ids; emptied when full."""

    def learn(self, words: set[str], vocab: Vocabulary, lexicon: Lexicon) -> None:
        missing = list(words - self.keys())
        if len(self) + len(missing) > REMEMBERED:
            self.clear()
            self.update({t: np.array([i], "<u4").tobytes() for t, i in vocab.added.items()})
            missing = list(words - self.keys())
        places = lexicon.places([w.encode() for w in missing])
        known = np.flatnonzero(places >= 0)
        self.update(zip((missing[k] for k in known), lexicon.outputs(places[known]), strict=True))
        new = [missing[k] for k in np.flatnonzero(places < 0)]
        self.update(zip(new, vocab.encode_words(new), strict=True))


@lru_cache(maxsize=1)
def _memory(vocab_path: str) -> _Memory:
    memory = _Memory()
    memory.update({t: np.array([i], "<u4").tobytes() for t, i in vocabulary(vocab_path).added.items()})
    return memory


def pieces(text: str, vocab: Vocabulary) -> list[str]:
    """The words of a text and the added tokens in it, which concatenate to the text."""
    if vocab.split is None or not any(t in text for t in vocab.added):
        return _WORD.findall(text)
    out = []
    for k, part in enumerate(vocab.split.split(text)):
        out += [part] if k % 2 else _WORD.findall(part)
    return out


def slices(texts: list, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``limit`` characters or bytes; a longer text is a run of its own."""
    start = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, k
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``ROWS``, so that a worker does not hold all texts of a batch a second time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode_texts(texts: list[str], vocab_path: str, lexicon: Lexicon) -> Iterator[bytes]:
    """The ids of each text, as little-endian unsigned 32-bit integers."""
    vocab, memory = vocabulary(vocab_path), _memory(vocab_path)
    for start, end in slices(texts):
        parts = [pieces(t, vocab) for t in texts[start:end]]
        memory.learn(set().union(*parts), vocab, lexicon)
        for words in parts:
            yield b"".join(map(memory.__getitem__, words))


def decode_ids(ids: bytes, vocab_path: str) -> str:
    """The text of ids, added tokens included; bytes that are no UTF-8 become U+FFFD."""
    texts = vocabulary(vocab_path).texts
    return b"".join(map(texts.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def frequent_words(df: DataFrame, text_col: str, vocab_path: str, count: int = LEXICON_WORDS, summary: int = SUMMARY) -> list[str]:
    """The most frequent words of all texts, whole levels of frequency of them as far as ``count`` goes.

    Each task keeps a summary of at most ``summary`` counters (when there are more, the excess count is taken off all),
    and the summaries are added up; memory and result are bounded, and all rows are read.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        counts: Counter[str] = Counter()
        for batch in bounded(batches):
            for text in batch.column(0).to_pylist():
                counts.update(pieces(text or "", vocab))
                if len(counts) > 2 * summary:
                    counts = _reduced(counts, summary)
        counts = _reduced(counts, summary)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    found = df.select(F.col(text_col).alias("text")).mapInArrow(summed, "word string, n long").where(F.octet_length("word") <= LONGEST)
    # eight levels for each power of two: a few hundred rows tell how far down the words are few enough
    counts = checkpointed(found.groupBy("word").agg(F.sum("n").alias("n")).withColumn("level", F.floor(8 * F.log2("n")).cast("int")))
    least, total = None, 0
    for level, n in sorted(((r["level"], r["n"]) for r in counts.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True):
        total += n
        if total > count:
            break
        least = level
    if least is None:
        return []
    return [r["word"] for r in counts.where(F.col("level") >= least).select("word").collect()]  # at most count words


def _reduced(counts: Counter[str], size: int) -> Counter[str]:
    if len(counts) <= size:
        return counts
    excess = int(np.partition(np.fromiter(counts.values(), np.int64, len(counts)), -size - 1)[-size - 1])
    return Counter({w: n - excess for w, n in counts.items() if n > excess})


def ship_lexicon(df: DataFrame, words: list[str], vocab_path: str) -> str:
    """Compile the lexicon of ``words`` and send its file to every machine; its name there is returned."""
    vocab = vocabulary(vocab_path)
    entries = {w.encode(): vocab.encode_word(w) for w in words if w not in vocab.added}
    folder = os.path.realpath(tempfile.mkdtemp())
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    compile_lexicon(entries, f"{folder}/{name}")
    df.sparkSession.sparkContext.addFile(f"{folder}/{name}")
    return name


def _encoded(batches: Iterator[pa.RecordBatch], vocab_path: str, lexicon_name: str) -> Iterator[pa.RecordBatch]:
    """``id`` and ``ids`` of batches of ``id`` and ``text``."""
    lexicon = _lexicon(lexicon_name)
    for batch in bounded(batches):
        texts = [t or "" for t in batch["text"].to_pylist()]
        for start, end in slices(texts):
            ids = list(encode_texts(texts[start:end], vocab_path, lexicon))
            yield pa.RecordBatch.from_arrays([batch["id"].slice(start, end - start), pa.array(ids, pa.binary())], names=["id", "ids"])


def encode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """``id`` and ``ids`` (binary, little-endian unsigned 32-bit) of each row's text.

    Null and empty texts have no ids. Added tokens inside a text are encoded as such, as the tokenizer library does.
    Repeated rows come back as often as they were; null ids are kept; an empty table gives an empty one. Other columns
    of ``df`` may have any names.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    name = ship_lexicon(df, frequent_words(df, text_col, vocab_path, lexicon_words), vocab_path)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _encoded(batches, vocab_path, name), f"id {kind}, ids binary")


def decode(df: DataFrame, vocab_path: str) -> DataFrame:
    """``id`` and ``text`` of the rows of ``encode``."""
    kind = df.schema["id"].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(x.as_py(), vocab_path) for x in batch["ids"]]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(texts, pa.string())], names=["id", "text"])

    return df.mapInArrow(decoded, f"id {kind}, text string")


def round_trip_digests(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``n_tokens`` and the hashes ``ids_sha256`` and ``decoded_sha256`` of each row.

    The ids are those of ``encode``, hashed in the worker that makes them: a second step in Python would have a worker of its
    own, with the vocabulary, in each task.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    name = ship_lexicon(df, frequent_words(df, text_col, vocab_path), vocab_path)
    kind = rows.schema["id"].dataType.simpleString()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _encoded(batches, vocab_path, name):
            ids = [x.as_py() for x in batch["ids"]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"],
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(decode_ids(x, vocab_path).encode()).hexdigest() for x in ids], pa.string()),
                ],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(digested, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
