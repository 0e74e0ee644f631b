"""Exact and near-duplicates of texts, the first of equals kept."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import content_hash
from millrace.operators.similarity import candidates, classes, frequent, sampled, shared_counts, small
from millrace.session import BROADCAST_TERMS, checkpointed

#: Similarity from which two texts are near-duplicates.
NEAR = 0.72
#: Tokens of a lower-cased text, as ``functions.text: tokens``, and the seed of Spark's own hash.
TOKEN, SEED = re.compile(rb"[a-z0-9_]+"), 42
#: Runs of words that are hashed at once, and hashes that are sent at once.
BLOCK = 1 << 16


def first_of_equal(df: DataFrame, id_col: str, *parts: Column) -> DataFrame:
    """``df`` with ``content_hash``, ``first_id`` (least id with this hash) and ``kept``."""
    hashed = df.withColumn("content_hash", content_hash(*parts))
    first = hashed.groupBy("content_hash").agg(F.min(id_col).alias("first_id"))
    return hashed.join(first, "content_hash").withColumn("kept", F.col(id_col) == F.col("first_id"))


def _hashes(text: bytes, size: int) -> np.ndarray:
    """Different hashes of the runs of ``size`` tokens, sorted; fewer tokens are one run, none give none."""
    words, parts = TOKEN.findall(text), []
    n = max(1, len(words) - size + 1) if words else 0
    for at in range(0, n, BLOCK):
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + size]), SEED) for k in range(at, min(n, at + BLOCK))]
        parts.append(np.unique(np.array(hashes, np.uint64).view(np.int64)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate([np.empty(0, np.int64), *parts]))


def shingle_sets(df: DataFrame, id_col: str, text: Column, size: int = 4, every: bool = False, **more: Column) -> DataFrame:
    """``id`` and ``shingles`` (hashes of its word runs) of each row that has any (``every``: of all rows), and ``more`` columns."""
    rows = df.select(F.col(id_col).alias("id"), F.lower(F.coalesce(text, F.lit(""))).cast("binary").alias("_text"), *[c.alias(name) for name, c in more.items()])
    kinds = rows.drop("_text").schema
    kinds = T.StructType([kinds[0], T.StructField("shingles", T.ArrayType(T.LongType())), *kinds.fields[1:]])
    names, others = kinds.fieldNames(), list(more)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, held, total = 0, [], 0
            for k, t in enumerate(batch["_text"]):
                held.append(_hashes(t.as_py(), size))
                total += len(held[-1])
                if total > 8 * BLOCK or k + 1 == batch.num_rows:
                    part = batch.slice(a, k + 1 - a)
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, held)]), pa.int32()), pa.array(np.concatenate(held)))
                    yield pa.RecordBatch.from_arrays([part["id"], lists, *(part[name] for name in others)], names=names)
                    a, held, total = k + 1, [], 0

    sets = rows.mapInArrow(made, kinds)
    return sets if every else sets.where(F.size("shingles") > 0)


def sample_sets(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``shingle_sets`` of the texts at which ``frequent`` looks."""
    return shingle_sets(sampled(df, id_col), id_col, text)


def _firsts_only(sets: DataFrame, keys: DataFrame, firsts: DataFrame) -> DataFrame:
    """The ``sets`` whose id is in ``firsts``; ``keys`` has all ids. If the others are few, these are looked up, so that sets stay where they are."""
    ids = firsts.select("id")
    others = checkpointed(keys.select("id").join(small(ids, BROADCAST_TERMS), "id", "left_anti").distinct())
    if others.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        return sets.where("id IS NOT NULL").join(F.broadcast(others), "id", "left_anti").select("id", "shingles")
    return sets.join(small(ids, BROADCAST_TERMS), "id", "left_semi").select("id", "shingles")


def similar_pairs(sets: DataFrame, threshold: float = NEAR, sample: DataFrame | None = None) -> DataFrame:
    """Pairs ``i`` < ``j`` of sets with a Jaccard similarity of ``threshold`` or more, and ``similarity``.

    Exact: a set's first shingles in an order of all, one more than may be missing, have one in common with those of any similar set. Equal
    sets are compared as one, and every pair of theirs comes back. Sets are written once and read again; given ``sample``, the sets of
    ``sampled`` rows, they are made again from their texts where they are needed, which takes no disk.
    """
    sets = checkpointed(sets) if sample is None else sets
    keys = checkpointed(classes(sets).select("id", "key"))
    firsts = checkpointed(keys.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    pairs = checkpointed(_scored(_firsts_only(sets, keys, firsts), threshold, sample))
    several = small(firsts.where("copies > 1").select("key", F.col("id").alias("first")), BROADCAST_TERMS)
    members = checkpointed(keys.join(several, "key").select("first", "id"))
    as_first = lambda end: members.select(F.col("first").alias(end), F.col("id").alias(f"own_{end}"))
    of = lambda end: F.coalesce(F.col(f"own_{end}"), F.col(end))
    every = pairs.join(as_first("i"), "i", "left").join(as_first("j"), "j", "left").select(F.least(of("i"), of("j")).alias("i"), F.greatest(of("i"), of("j")).alias("j"), "similarity")
    equal = members.select("first", F.col("id").alias("i")).join(members.select("first", F.col("id").alias("j")), "first").where("i < j")
    return every.unionByName(equal.select("i", "j", F.lit(1.0).alias("similarity")))


def _scored(sets: DataFrame, threshold: float, sample: DataFrame | None) -> DataFrame:
    """``similar_pairs`` of sets that are all different."""
    pairs = checkpointed(candidates(sets, None, threshold, None if sample is None else frequent(sample)))
    wanted = checkpointed(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    sets = checkpointed(sets.join(small(wanted, BROADCAST_TERMS), "id", "left_semi"))
    scored = shared_counts(pairs, sets, sets).withColumn("similarity", F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")))
    return scored.where(F.col("similarity") >= threshold).select(F.col("a").alias("i"), F.col("b").alias("j"), "similarity")


def keep_first(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id`` and ``kept``: in the order of ids, a node is dropped if it is paired with an earlier one that is kept.

    The verdicts are found in rounds: nodes whose earlier neighbours are all dropped are kept, and the later neighbours
    of kept ones are dropped, until all are decided.
    """
    pairs = checkpointed(pairs.select("i", "j"))
    state = checkpointed(nodes.select("id").withColumn("kept", F.lit(None).cast("boolean")))
    while True:
        earlier = pairs.join(state.select(F.col("id").alias("i"), F.col("kept").alias("first")), "i")
        seen = earlier.groupBy(F.col("j").alias("id")).agg(F.max(F.coalesce("first", F.lit(False))).alias("beaten"), F.max(F.col("first").isNull()).alias("open"))
        decided = (
            F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("beaten", F.lit(False)), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True))
        )
        state = checkpointed(state.join(seen, "id", "left").select("id", decided.alias("kept")))
        if state.where("kept IS NULL").isEmpty():
            return state


def deduplicate(df: DataFrame, id_col: str, text_col: str, threshold: float = NEAR, reread: bool = False) -> DataFrame:
    """``id`` and ``kept`` of each row: greedy removal of equal and similar texts, the first of them kept.

    Texts with equal sets of shingles, as equal texts have, are decided with the first of them, so that only first ones are compared: the
    others have the same neighbours, or the first itself, before them, and are dropped. Without shingles equal texts are. Sets are written
    once, or with ``reread``, for tables that cost little to read, made again from the texts where they are needed.
    """
    text = F.col(text_col)
    halves = F.struct(*[F.substring(content_hash(text), at, 32).alias(name) for at, name in ((1, "x"), (33, "y"))])
    blank = ~F.lower(F.coalesce(text, F.lit(""))).rlike("[a-z0-9_]")
    sets = shingle_sets(df, id_col, text, every=True, hash=F.when(blank, halves))
    rows = classes(sets).withColumn("key", F.when(F.size("shingles") > 0, F.struct(F.col("key.x").cast("string").alias("x"), F.col("key.y").cast("string").alias("y"))).otherwise(F.col("hash")))
    if reread:
        rows, sets, sample = checkpointed(rows.select("id", "key")), shingle_sets(df, id_col, text), sample_sets(df, id_col, text)
    else:
        rows = checkpointed(rows.select("id", "key", "shingles"))
        sets, sample = rows.where(F.size("shingles") > 0), None
    firsts = checkpointed(rows.groupBy("key").agg(F.min("id").alias("id")).select("id"))
    verdicts = keep_first(firsts, _scored(_firsts_only(sets, rows, firsts), threshold, sample))
    return rows.select("id").join(verdicts, "id", "left").select("id", F.coalesce("kept", F.lit(False)).alias("kept"))
