"""Removal of word windows that stand earlier in the corpus, with a count-min prefilter.

Every window of words is counted through one word sequence inside it, the one of least hash: equal windows have it at
the same place, so that what the sketch holds of the sequence overestimates the count of the window. Slices of texts count
the sequences, and shards add the counts up in count-min sketches of ``WIDTH`` cells and two rows (``sketch.py``); windows
whose sequence is estimated to stand once stand once, and are out. A second pass sends the other windows, consecutive ones
with the same least sequence as one stretch of text, to where their sequence is grouped, and groups them by their words.

Shards are as many as the bytes of texts ask for, each with a sketch of fixed width. Windows of sequences that stand more than ``HOT`` times are grouped in
salted parts first, of which the first windows meet. Texts are shuffled once, by a key that both passes join on; of long
texts, pieces that overlap by a window are worked on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.bpe import slices
from millrace.llm.common import let
from millrace.llm.sketch import Dealt, cell_of, repeated_cells, shards_for
from millrace.llm.windows import prefix_sums, run_hashes, sliding_min, span_hashes, word_spans

WINDOW, GRAM = 20, 8
#: Cells of a row of a shard's sketch.
WIDTH = 1 << 22
#: Bytes of texts that are handled at once, and of a text from which on it is handled in pieces; words of a piece.
SLICE, PIECE_WORDS = 1 << 22, 1 << 17
#: Occurrences beyond which a sequence's windows are salted, into parts of about as many; sequences so dealt at most: if there are
#: more, the most frequent, in whole levels of frequency.
HOT, HOTTEST = 2_000, 1 << 20


def _pieces(texts: list[bytes], window: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The texts, long ones as pieces that share ``window`` - 1 words with the next; of each piece the text and its first word there."""
    parts, owner, offset = [], [], []
    for k, text in enumerate(texts):
        if len(text) <= SLICE:
            parts.append(text)
            owner.append(k)
            offset.append(0)
            continue
        starts, ends = word_spans(np.frombuffer(text + b"\n", np.uint8))
        for at in range(0, max(1, len(starts) - window + 1), PIECE_WORDS):
            last = min(len(starts), at + PIECE_WORDS + window - 1) - 1
            parts.append(text[starts[at] : ends[last]] if len(starts) else b"")
            owner.append(k)
            offset.append(at)
    return parts, np.array(owner, np.int64), np.array(offset, np.int64)


def _cells(texts: list[bytes], window: int, gram: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The sequence's hash, text and first word (in its text) of each window of the texts; then the hash and text of each
    occurrence of a sequence that is the least of a window. A window's own occurrence is among them, so that windows that
    stand twice have two."""
    data = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    starts, ends = word_spans(data)
    none, no_hash = np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(starts) < window:
        return (no_hash, none, none), (no_hash, none)
    edges = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(starts, edges)  # the first word of each text
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    grams = run_hashes(span_hashes(prefix_sums(data), starts, ends), gram)
    span = window - gram + 1
    least = sliding_min(grams, span)
    inside = text[: len(least)] == text[window - 1 :]
    at = np.flatnonzero(inside)
    # the greatest of the least of the windows around a sequence is the sequence itself if it is the least of one
    pad = np.zeros(span - 1, np.uint64)
    around = ~sliding_min(~np.concatenate([pad, np.where(inside, least, np.uint64(0)), pad]), span)
    own = np.flatnonzero(around == grams)
    return (least[at], text[at], at - first[text[at]]), (grams[own], text[own])


def _stretches(texts: list[bytes], text: np.ndarray, start: np.ndarray, count: np.ndarray, window: int) -> list[str]:
    """The words of runs of windows, each run as one text with single spaces."""
    out = []
    for k, a, n in zip(text.tolist(), start.tolist(), count.tolist(), strict=True):
        if not out or k != last:
            last, words = k, texts[k].split()
        out.append(b" ".join(words[a : a + n + window - 1]).decode())
    return out


def _windows(stretch: Column, window: int) -> Column:
    """The windows of a stretch of text."""
    return let(F.split(stretch, " "), lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda k: F.array_join(F.slice(w, k, F.lit(window)), " ")))


def repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, width: int = WIDTH) -> DataFrame:
    """``id``, ``text`` and ``starts`` of each row of ``df``: the first words (from 0, sorted) of its windows that stand earlier.

    Words are runs of characters other than white space, compared unchanged. A window stands earlier if its words also
    do in a row with a smaller id (nulls last), or from a smaller word on in a row with the same id. ``starts`` is null
    for rows without such windows, among them null, empty and short texts. Rows that are equal in id and text have the
    same starts. An empty table gives an empty one. Other columns of ``df`` may have any names. A ``width`` too small for
    the corpus makes more work, but loses nothing. Of a text of any length, pieces are worked on; the text itself is held.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    unique = docs.groupBy("id").count().where("count > 1 OR id IS NULL").isEmpty()
    # a second key where ids do not tell rows apart
    docs = docs.withColumn("print", F.lit(0).cast("long") if unique else F.xxhash64("text")).withColumn("key", F.xxhash64("id", "print"))

    def found(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        parts, owner, _ = _pieces(texts, window)
        for a, b in slices(parts, SLICE):
            grams, text = _cells(parts[a:b], window, gram)[1]
            yield grams, owner[a:b][text]

    suspects, parts = repeated_cells(docs.select("text", "key"), found, shards_for(docs), hot, HOTTEST, width)
    dealt = Dealt(parts)
    kind = docs.schema["id"].dataType.simpleString()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of windows with the same suspected sequence, each as a stretch of text."""
        for batch in batches:
            texts, owner, offset = _pieces([(t or "").encode() for t in batch["text"].to_pylist()], window)
            prints, keys = batch["print"].to_numpy(), batch["key"].to_numpy()
            for a, b in slices(texts, SLICE):
                marked = np.unique(batch["cells"].slice(owner[a], owner[b - 1] - owner[a] + 1).flatten().to_numpy())
                grams, text, start = _cells(texts[a:b], window, gram)[0]
                keep = np.flatnonzero(np.isin(cell_of(grams), marked))
                grams, text, start = grams[keep], text[keep], start[keep]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1) | (grams[1:] != grams[:-1])
                first = np.flatnonzero(new)
                own = owner[a:b][text[first]]
                salt = dealt.salts(cell_of(grams[first]), keys[own])
                salt = np.where(dealt.has(cell_of(grams[first])), salt.astype(np.int64) + 1, 0)
                held = _stretches(texts[a:b], text[first], start[first], np.diff(np.append(first, len(text))), window)
                columns = [pa.array(x) for x in (prints[own], salt, grams[first].view(np.int64), start[first] + offset[a:b][text[first]])]
                yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(own)), *columns, pa.array(held, pa.string())], names=["id", "print", "salt", "cell", "start", "stretch"])

    runs = docs.join(suspects, "key").select("id", "print", "key", "text", "cells")
    runs = runs.mapInArrow(windows, f"id {kind}, print long, salt long, cell long, start long, stretch string").repartition("cell", "salt")
    every = runs.select("id", "print", "salt", "cell", "start", F.posexplode(_windows(F.col("stretch"), window)).alias("k", "h"))
    every = every.select("id", "print", "salt", "cell", "h", (F.col("start") + F.col("k")).alias("start"))
    # the least place by a window, not a rank, of which only the first rows would be asked for below: so both uses share one shuffle
    place = F.struct(F.col("id").isNull().alias("none"), "id", "start")
    placed = every.withColumn("place", place).withColumn("least", F.min("place").over(Window.partitionBy("cell", "salt", "h")))
    later = placed.where(F.col("place") != F.col("least")).select("id", "print", "start")
    if parts:
        # one condition, which cannot be asked for before the shuffle; no join, whose sides would each shuffle the runs
        firsts = placed.where(F.when(F.col("place") == F.col("least"), F.col("salt")).otherwise(0) > 0)
        beaten = firsts.withColumn("top", F.min("place").over(Window.partitionBy("cell", "h"))).where(F.col("place") != F.col("top"))
        later = later.unionByName(beaten.select("id", "print", "start"))
    removed = later.groupBy("id", "print").agg(F.array_sort(F.collect_set("start")).alias("starts"))
    # joined by the key alone, as the suspects are, so that the texts are shuffled once
    owned = removed.groupBy(F.xxhash64("id", "print").alias("key")).agg(F.collect_list(F.struct("id", "print", "starts")).alias("owned"))
    own = F.filter("owned", lambda o: o["id"].eqNullSafe(F.col("id")) & (o["print"] == F.col("print")))
    return docs.join(owned, "key", "left").select("id", "text", F.get(own, F.lit(0))["starts"].alias("starts"))


def kept_mask(n_words: int, starts: list[int] | None, window: int = WINDOW) -> np.ndarray:
    """Which of a text's words stay."""
    if not starts:
        return np.ones(n_words, bool)
    change = np.zeros(n_words + 1, np.int64)
    at = np.array(starts)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return np.cumsum(change[:-1]) == 0


def kept_digests(rows: DataFrame, id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """The id, ``n_words``, ``n_removed`` and ``kept_sha256`` (the words that stay, joined by one space) of the rows of ``repeated_windows``."""
    kind = rows.schema["id"].dataType.simpleString()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts in zip(batch["text"].to_pylist(), batch["starts"].to_pylist(), strict=True):
                words = (text or "").encode().split()
                mask = kept_mask(len(words), starts, window)
                kept = words if mask.all() else [words[k] for k in np.flatnonzero(mask).tolist()]
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([batch["id"], *columns], names=[id_col, "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(digests, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), wins AS (
  SELECT doc_id, unnest(range(len(w) - 19)) AS i, w FROM t WHERE len(w) >= 20
), hashed AS (
  SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 20], ' ')) AS h FROM wins
), later AS (
  SELECT doc_id, i FROM hashed QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM later, range(20) AS r(k)
), words AS (
  SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS word FROM t
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS s, count(*) AS n
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p WHERE gone.p IS NULL GROUP BY words.doc_id
)
SELECT t.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""
