"""Removal of byte strings that start in an earlier document, by suffix arrays over candidate contexts.

Every window of ``length`` bytes is looked for where its sequence of least hash stands (of ``gram`` bytes, inside it), so
that equal windows meet under the same sequence. Sequences in one document only are out: they are counted in shards of
a shuffle, as packed 32-bit cells. Around each other sequence stands a context, the run of windows that it is the least
of. Contexts meet by sequence; equal ones become one, with the least id among their documents; and where a sequence has
contexts that differ, the stretches in which windows recur by hash go into a suffix array, in whose order equal windows
are neighbours and are compared byte by byte.

A sequence in more than ``HOT`` documents is dealt in parts, by document: each part has suffix arrays of its own, and the
least id of a window in each part goes on to one more shuffle, by the bytes of the window, in which the least of all parts
is found. The same settles a sequence whose contexts fill more than one suffix array. Shards are as many as shuffle
partitions, or as the bytes of texts ask for, so that a task's memory does not grow with the data. Long texts are handled in
pieces that overlap by a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.bpe import slices
from millrace.llm.sketch import Dealt, cell_of, lists, repeated_cells, shard_of, shards_for
from millrace.llm.suffix_array import suffix_array
from millrace.llm.windows import mixed, prefix_sums, sliding_min, span_hashes

LENGTH, GRAM = 50, 20
#: Bytes of texts that are handled at once, of contexts that fill one suffix array, and at most go into one.
SLICE, BATCH, BLOCK = 1 << 20, 1 << 15, 1 << 17
#: Documents that hold a sequence beyond which it is dealt in parts, and sequences so dealt at most: if there are more, the most
#: frequent, in whole levels of frequency.
HOT, HOTTEST = 2_000, 1 << 20
_LAST = (1 << 63) - 1


def _runs(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one text with the same least sequence: its hash, the text, the first window's start in the text
    and the number of windows."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    sums, powers = prefix_sums(data)
    grams = mixed((sums[gram:] - sums[:-gram]) * powers[: len(data) - gram + 1])
    del sums, powers
    least = sliding_min(grams, length - gram + 1)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    at = np.flatnonzero(text[: len(least)] == text[length - 1 :])
    if not len(at):
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    least, text = least[at], text[at].astype(np.int64)
    own = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])]))
    edges = np.cumsum(sizes) - sizes
    return least[own], text[own], at[own] - edges[text[own]], np.diff(np.append(own, len(at)))


def _pieces(texts: list[bytes], length: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The texts, long ones as pieces that share ``length`` - 1 bytes with the next; of each piece the text and its start there."""
    parts, owner, offset = [], [], []
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), SLICE):
            parts.append(text[at : at + SLICE + length - 1] if len(text) > SLICE else text)
            owner.append(k)
            offset.append(at)
    return parts, np.array(owner, np.int64), np.array(offset, np.int64)


def _packed(contexts: list[bytes]) -> bytes:
    """Contexts as one compressed block, each with its size before it."""
    return zstandard.compress(b"".join(len(c).to_bytes(4, "little") + c for c in contexts), 3)


def _unpacked(block: bytes) -> list[bytes]:
    data, at, out = zstandard.decompress(block), 0, []
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out


def _contexts(docs: DataFrame, shards: int, length: int, gram: int, unique: bool, dealt: Dealt) -> DataFrame:
    """Contexts of shared sequences, packed by slice of texts and shard: each different one, and where it stands.

    Where ids are ``unique`` they are the keys, and ``keys`` is empty. """

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, owner, offset = _pieces([(t or "").encode() for t in batch["text"].to_pylist()], length)
            keys, ids = batch["key"].to_numpy()[owner], batch["id"].to_numpy()[owner]
            for a, b in slices(texts, SLICE):
                listed = np.unique(batch["cells"].slice(owner[a], owner[b - 1] - owner[a] + 1).flatten().to_numpy())
                grams, text, start, windows = _runs(texts[a:b], length, gram)
                if not len(grams) or not len(listed):
                    continue
                own = cell_of(grams)
                keep = np.flatnonzero(listed[np.minimum(np.searchsorted(listed, own), len(listed) - 1)] == own)
                if not len(keep):
                    continue
                salt = dealt.salts(own[keep], keys[a:b][text[keep]])
                to = np.where(salt > 0, mixed(grams[keep] + salt), grams[keep])
                shard = shard_of(to, shards)
                order = np.argsort(shard, kind="stable")
                keep, shard = keep[order], shard[order]
                cells, text, start, windows = own[keep], text[keep], start[keep], windows[keep]
                bounds = np.append(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), len(shard)).tolist()
                rows: dict[str, list] = {"shard": [], "cells": [], "contexts": [], "refs": []}
                for lo, hi in zip(bounds, bounds[1:], strict=False):
                    different: dict[bytes, int] = {}
                    of, refs = [], []
                    for k, (t, s, n) in enumerate(zip(text[lo:hi].tolist(), start[lo:hi].tolist(), windows[lo:hi].tolist(), strict=True)):
                        context = texts[a + t][s : s + n + length - 1]
                        ref = different.setdefault(context, len(different))
                        if ref == len(of):
                            of.append(lo + k)
                        refs.append(ref)
                    rows["shard"].append(int(shard[lo]))
                    rows["cells"].append(cells[of])
                    rows["contexts"].append(_packed(list(different)))
                    rows["refs"].append(refs)
                at = np.array(bounds[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows["shard"], pa.int32()), pa.array(rows["cells"], pa.list_(pa.int32())), pa.array(rows["contexts"], pa.binary()),
                        pa.array(rows["refs"], pa.list_(pa.int32())), lists(pa.array(keys[:0]), at * 0) if unique else lists(pa.array(keys[a:b][text]), at),
                        lists(pa.array(ids[a:b][text]), at), lists(pa.array(start + offset[a:b][text], pa.int32()), at),
                    ],
                    names=["shard", "cells", "contexts", "refs", "keys", "ids", "starts"],
                )

    schema = "shard int, cells array<int>, contexts binary, refs array<int>, keys array<long>, ids array<long>, starts array<int>"
    return docs.select("id", "key", "text", "cells").mapInArrow(sent, schema)


def least_ids(contexts: list[bytes], cells: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of different contexts the least id among the contexts of its sequence that hold it; the first
    window of each context; and the contexts whose sequence fills more than one suffix array, so that the least ids are
    those of an array. ``ids``: the least id of each context."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    windows = sizes - length + 1
    first = np.cumsum(windows) - windows
    least = np.repeat(ids, windows)
    parted = np.zeros(len(contexts), bool)
    order = np.argsort(cells, kind="stable")
    cells = cells[order]
    _, begin, count = np.unique(cells, return_index=True, return_counts=True)
    several = order[np.repeat(count > 1, count)]  # contexts of sequences with more than one, by sequence
    if not len(several):
        return least, first, parted
    # stretches in which windows recur, by hash, in other contexts
    data = np.frombuffer(b"".join(contexts[k] for k in several.tolist()), np.uint8)
    edges = np.cumsum(sizes[several]) - sizes[several]
    owner = np.repeat(np.arange(len(several)), windows[several])
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows[several]) - windows[several], windows[several])
    at = edges[owner] + inside
    hashes = span_hashes(prefix_sums(data), at, at + length)
    _, same = np.unique(hashes, return_inverse=True)
    low = np.full(same.max() + 1, len(several))
    high = np.full(same.max() + 1, -1)
    np.minimum.at(low, same, owner)
    np.maximum.at(high, same, owner)
    recurs = low[same] < high[same]
    begin = np.full(len(several), -1)
    end = np.full(len(several), -1)
    marked = np.flatnonzero(recurs)
    begin[owner[marked][::-1]] = inside[marked][::-1]
    end[owner[marked]] = inside[marked] + length
    group = cells[np.repeat(count > 1, count)]
    marked = np.flatnonzero(begin >= 0)
    width = (end - begin)[marked]
    bounds = np.append(np.flatnonzero(np.concatenate([[True], group[marked][1:] != group[marked][:-1]])), len(marked)).tolist() if len(marked) else [0]
    batch: list[int] = []
    size = 0
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        if int(width[lo:hi].sum()) > BLOCK:
            parted[several[marked[lo:hi]]] = True
        for k in range(lo, hi):
            batch.append(int(marked[k]))
            size += int(width[k])
            if size > (BLOCK if k + 1 < hi else BATCH):
                _settle(batch, contexts, several, begin, end, least, first, length)
                batch, size = [], 0
    if batch:
        _settle(batch, contexts, several, begin, end, least, first, length)
    return least, first, parted


def _settle(batch: list[int], contexts: list[bytes], several: np.ndarray, begin: np.ndarray, end: np.ndarray, least: np.ndarray, first: np.ndarray, length: int) -> None:
    """Lower ``least`` to the least id of equal windows among the stretches of the batch."""
    parts, window = [], []
    for k in batch:
        own, a, b = int(several[k]), int(begin[k]), int(end[k])
        parts += [np.frombuffer(contexts[own][a:b], np.uint8).astype(np.int32) + 2, np.ones(1, np.int32)]
        window += [first[own] + np.arange(a, b - length + 1), np.full(length, -1)]  # the separator, too, has none
    text = np.concatenate([*parts, np.zeros(1, np.int32)])
    window = np.concatenate([*window, np.full(1, -1)])
    order = np.array(suffix_array(text.tolist()))
    order = order[window[order] >= 0]
    new = np.ones(len(order), bool)
    for k in range(1, len(order), 1 << 13):  # neighbours in blocks, to bound the memory
        held = text[order[k - 1 : k + (1 << 13), None] + np.arange(length)]
        new[k : k + (1 << 13)] = (held[1:] != held[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    places = window[order]
    lowest = np.minimum.reduceat(least[places], starts)
    least[places] = np.repeat(lowest, np.diff(np.append(starts, len(order))))


def _fixed(values: np.ndarray) -> pa.Array:
    """Numbers as binary values of eight bytes."""
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(8 * np.arange(len(values) + 1, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _removed(batches: Iterator[pa.RecordBatch], length: int, dealt: Dealt) -> Iterator[pa.RecordBatch]:
    """Spans of a shard's contexts whose windows stand in a document with a smaller id; and, as ``open``, each window that has
    the least id here, but may have a smaller one in another part or suffix array, with its bytes as ``w``. Spans have their key there."""
    index: dict[bytes, int] = {}
    contexts: list[bytes] = []
    cells: list[np.ndarray] = []
    refs, keys, ids, starts = [], [], [], []
    ids_of = lambda batch, k: batch["ids"][k].values.to_numpy()
    for batch in batches:
        for k in range(batch.num_rows):
            own, of = _unpacked(batch["contexts"][k].as_py()), []
            sent = batch["cells"][k].values.to_numpy()
            for j, context in enumerate(own):
                ref = index.setdefault(context, len(contexts))
                if ref == len(contexts):
                    contexts.append(context)
                    cells.append(sent[j])
                of.append(ref)
            refs.append(np.array(of)[batch["refs"][k].values.to_numpy()])
            for into, name in ((keys, "keys"), (ids, "ids"), (starts, "starts")):
                held = batch[name][k].values.to_numpy()
                into.append(held if len(held) else ids_of(batch, k))
    if not contexts:
        return
    ref, key, doc, start = (np.concatenate(x) for x in (refs, keys, ids, starts))
    lowest = np.full(len(contexts), _LAST)
    np.minimum.at(lowest, ref, doc)
    least, first, parted = least_ids(contexts, np.array(cells), lowest, length)
    parted |= dealt.has(np.array(cells))
    windows = np.array([len(c) for c in contexts], np.int64) - length + 1
    for a in range(0, len(ref), 50_000):
        r, d, s, k = ref[a : a + 50_000], doc[a : a + 50_000], start[a : a + 50_000], key[a : a + 50_000]
        owner = np.repeat(np.arange(len(r)), windows[r])
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows[r]) - windows[r], windows[r])
        gone = least[first[r][owner] + inside] < d[owner]
        names = ["w", "key", "id", "start", "stop", "open"]
        if len(at := np.flatnonzero(gone)):
            new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])])
            head, tail = at[new], at[np.concatenate([new[1:], [True]])]
            o = owner[head]
            columns = [_fixed(k[o]), *map(pa.array, (k[o], d[o], s[o] + inside[head], s[o] + inside[tail] + length, np.zeros(len(o), bool)))]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        at = np.flatnonzero(~gone & parted[r][owner])
        for x in range(0, len(at), 50_000):
            part = at[x : x + 50_000]
            o, i = owner[part], inside[part]
            held = [contexts[c][j : j + length] for c, j in zip(r[o].tolist(), i.tolist(), strict=True)]
            columns = [pa.array(held, pa.binary()), *map(pa.array, (k[o], d[o], s[o] + i, s[o] + i + length, np.ones(len(o), bool)))]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``id``, ``text`` and ``spans`` of each row of ``df``: stretches of its UTF-8 bytes (start, stop) that windows of
    ``length`` bytes cover which also start in a row with a smaller id. Stretches may overlap and have no order.

    Ids are whole numbers; null ids count as larger than all others, and come back as null. Rows with the same id take
    nothing from each other. ``spans`` is null for rows without such windows, among them null, empty and short texts.
    An empty table gives an empty one. Other columns of ``df`` may have any names. Of a text of any length, pieces of
    ``SLICE`` bytes are worked on; the text itself is held in memory.
    """
    if not isinstance(df.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError("ids have to be whole numbers")
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.col(text_col).alias("text"))
    shards = shards_for(docs)
    unique = docs.groupBy("id").count().where("count > 1").isEmpty()
    docs = docs.withColumn("key", F.col("id") if unique else F.xxhash64("id", "text"))

    def found(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        parts, owner, _ = _pieces(texts, length)
        for a, b in slices(parts, SLICE):
            grams, text, _, _ = _runs(parts[a:b], length, gram)
            yield grams, owner[a:b][text]

    cells, parts = repeated_cells(docs, found, shards, HOT, HOTTEST, once=True)
    dealt = Dealt(parts)
    packed = _contexts(docs.join(cells, "key"), shards, length, gram, unique, dealt).repartitionById(shards, "shard")
    spans = packed.mapInArrow(lambda batches: _removed(batches, length, dealt), "w binary, key long, id long, start long, stop long, open boolean")
    # a window's rows are one for each part; the others' are those of their document
    spans = spans.withColumn("low", F.min("id").over(Window.partitionBy("w"))).where("NOT open OR low < id")
    removed = spans.groupBy("key").agg(F.collect_list(F.struct("id", "start", "stop")).alias("all"))
    # joined by the key alone, as the cells are, so that the texts are shuffled once
    own = F.transform(F.filter("all", lambda s: s["id"] == F.col("id")), lambda s: F.struct(s["start"], s["stop"]))
    joined = docs.join(removed, "key", "left").select("id", "text", F.when(F.size(own) > 0, own).alias("spans"))
    return joined.withColumn("id", F.when(F.col("id") != _LAST, F.col("id")))


def kept_bytes(text: str | None, spans: list | None) -> tuple[bytes, int, int]:
    """The bytes that stay, the number of bytes removed and of maximal removed runs."""
    data = (text or "").encode()
    out, at, runs, reached = [], 0, 0, -1
    for start, stop in sorted(spans or []):
        if start > reached:
            runs += 1
        if start > at:
            out.append(data[at:start])
        at = reached = max(at, stop)
    out.append(data[at:])
    kept = b"".join(out)
    return kept, len(data) - len(kept), runs


def kept_digests(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of the rows of ``repeated_bytes``."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                kept, removed, runs = kept_bytes(text, [(s["start"], s["stop"]) for s in spans or []])
                out.append((len(kept) + removed, removed, runs, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(digests, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
