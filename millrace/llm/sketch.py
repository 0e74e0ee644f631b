"""Which hashes occur twice or more in a corpus, by sketches that slices of texts fill and shards of a shuffle add up.

Each slice of texts counts its hashes and sends the counts to the shards of the hashes, packed as 32-bit cells. A shard
adds them up, in a count-min sketch of fixed width or exactly, and answers to the texts. Of a hash that several texts of a
slice hold, one entry goes to its shard and the others, known to be repeated, straight to the shards of their texts, so
that a hash in a third of all texts is not a third of all entries in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed
from millrace.llm.windows import mixed

#: Bytes of texts to a shard.
SHARD = 1 << 25
#: Rows of a count-min sketch.
ROWS = 2

Found = Callable[[list[bytes]], Iterator[tuple[np.ndarray, np.ndarray]]]


def shards_for(docs: DataFrame) -> int:
    """As many as shuffle partitions, or as the bytes of the texts ask for."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD))


def cell_of(hashes: np.ndarray) -> np.ndarray:
    """The cell of a hash in its shard."""
    return (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)


def lists(values: pa.Array, starts: np.ndarray) -> pa.Array:
    """The values as lists that begin at ``starts``."""
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


def edges(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)


def estimates(cells: np.ndarray, counts: np.ndarray, width: int | None) -> np.ndarray:
    """For each entry the count of its cell over all entries: the least of the sketch's rows, never too small; exact without
    a width."""
    if width is None:
        _, place = np.unique(cells, return_inverse=True)
        return np.bincount(place, weights=counts)[place].astype(np.int64) if len(cells) else counts
    out = np.full(len(cells), np.iinfo(np.int64).max)
    for row in range(ROWS):
        place = (mixed(cells.view(np.uint32).astype(np.uint64) + np.uint64((row + 1) << 32)) % np.uint64(width)).astype(np.int64)
        out = np.minimum(out, np.bincount(place, weights=counts, minlength=width).astype(np.int64)[place])
    return out


def repeated_cells(docs: DataFrame, found: Found, shards: int, hot: int, hottest: int, width: int | None = None, once: bool = False) -> tuple[DataFrame, dict[int, int]]:
    """``key`` and ``cells`` of the texts (columns key and text) with hashes that occur twice or more; and the number of parts,
    of about ``hot`` occurrences, in which to deal the cells of more: at most ``hottest``, the most frequent in whole levels
    of frequency.

    ``found`` gives hashes and the index of their text, a slice at a time. With ``once`` a hash counts once a text. A
    ``width`` makes the counts those of a sketch, which may take a hash for repeated, but never misses one.
    """

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["key"].to_numpy()
            for hashes, text in found([(t or "").encode() for t in batch["text"].to_pylist()]):
                order = np.lexsort((text, hashes))
                hashes, text = hashes[order], text[order]
                new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])])) if len(hashes) else np.empty(0, np.int64)
                if not len(new):
                    continue
                times = np.ones(len(new), np.int64) if once else np.diff(np.append(new, len(hashes)))
                hashes, text = hashes[new], text[new]
                starts = edges(hashes)
                # the slice's count of the hash at its first text; 0: known from the first to occur twice
                count = np.zeros(len(hashes), np.int32)
                count[starts] = np.add.reduceat(times, starts)
                own = keys[text]
                first = np.zeros(len(hashes), bool)
                first[starts] = True
                shard = np.where(first, shard_of(hashes, shards), shard_of(mixed(own.view(np.uint64)), shards))
                order = np.lexsort((text, shard))
                at = edges(shard[order])
                columns = (pa.array(cell_of(hashes)[order]), pa.array(own[order]), pa.array(count[order]))
                yield pa.RecordBatch.from_arrays([pa.array(shard[order][at]), *(lists(c, at) for c in columns)], names=["shard", "cells", "keys", "counts"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(batch[c].flatten().to_numpy() for c in ("cells", "keys", "counts")) for batch in batches]
        if not held:
            return
        cells, keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        counted = np.flatnonzero(counts > 0)
        n = estimates(cells[counted], counts[counted], width)
        most, at = np.unique(cells[counted][n > hot], return_index=True)
        often = n[n > hot][at]
        keep = counts == 0
        keep[counted] = n > 1
        cells, keys = cells[keep], keys[keep]
        bucket = shard_of(mixed(keys.view(np.uint64)), shards)
        order = np.argsort(bucket, kind="stable")
        at = edges(bucket[order])
        yield pa.RecordBatch.from_arrays([pa.array(bucket[order][at]), lists(pa.array(keys[order]), at), lists(pa.array(cells[order]), at)], names=["bucket", "keys", "cells"])
        if len(most):  # with their counts in place of keys
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([often]), pa.array([most])], names=["bucket", "keys", "cells"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(batch[c].flatten().to_numpy() for c in ("keys", "cells")) for batch in batches]
        if not held:
            return
        keys, cells = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, cells = keys[order], cells[order]
        starts = edges(keys)
        for k in range(0, len(starts), 10_000):
            part = starts[k : k + 10_000]
            end = starts[k + 10_000] if k + 10_000 < len(starts) else len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys[part]), lists(pa.array(cells[part[0] : end]), part - part[0])], names=["key", "cells"])

    packed = docs.select("text", "key").mapInArrow(sent, "shard int, cells array<int>, keys array<long>, counts array<int>")
    shared = checkpointed(packed.repartitionById(shards, "shard").mapInArrow(answered, "bucket int, keys array<long>, cells array<int>"))
    often = shared.where("bucket < 0").select(F.inline(F.arrays_zip(F.col("keys").alias("n"), F.col("cells").alias("cell"))))
    often = often.withColumn("level", F.floor(8 * F.log2("n")).cast("int"))
    least, total = None, 0
    for level, n in sorted(((r["level"], r["n"]) for r in often.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True):
        total += n
        if total > hottest:
            break
        least = level
    rows = often.where(F.col("level") >= least).groupBy("cell").agg(F.max("n").alias("n")).collect() if least is not None else []  # hottest at most
    cells = shared.where("bucket >= 0").repartitionById(shards, "bucket").mapInArrow(listed, "key long, cells array<int>")  # one row a text
    return cells, {r["cell"]: -(-r["n"] // hot) for r in rows}


class Dealt:
    """The parts in which cells are dealt, for lookups of many at once."""

    def __init__(self, parts: dict[int, int]) -> None:
        self.cells = np.array(sorted(parts), np.int32)
        self.parts = np.array([parts[c] for c in sorted(parts)], np.uint64)

    def salts(self, cells: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The part that each cell's entry goes to, by the key of its text; 0 for cells that are not dealt."""
        if not len(self.cells):
            return np.zeros(len(cells), np.uint64)
        at = np.minimum(np.searchsorted(self.cells, cells), len(self.cells) - 1)
        return mixed(keys.view(np.uint64) + np.uint64(1)) % np.where(self.cells[at] == cells, self.parts[at], np.uint64(1))

    def has(self, cells: np.ndarray) -> np.ndarray:
        return np.isin(cells, self.cells)
