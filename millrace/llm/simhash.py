"""Near-duplicates by SimHash fingerprints, with candidates from the pigeonring principle.

A fingerprint has four segments on a ring. If two differ in at most three bits, then from some segment on every chain
of 1, 2, 3 and 4 consecutive segments differs in at most 0, 1, 2 and 3 bits (its share of the budget). The join asks
for the first two chains at once: one segment equal, the next with at most one bit flipped, which makes a key of 32
bits. The third chain prunes the pairs before the full Hamming distance is taken.

Buckets of more than ``max_bucket`` different fingerprints are not paired. For their members, every point that differs
from a member in at most two bits is listed. Members within one bit of a point are within two of each other, and those
within two of it are within three of the former; linking all of a point's members to its least member within one bit
gives just the links of the definition that connect the members, in a number of rows linear in the members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed
from millrace.llm.components import components

#: Bits that may differ, and segments of the fingerprint.
DISTANCE, SEGMENTS, WIDTH = 3, 4, 16
SHINGLE, SEED = 3, 42
MAX_BUCKET = 256
#: Shingles that are hashed at once, to bound the memory for very long texts.
BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Bit k is set if it is set in over half of the hashes of the shingles of three words, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(x) for x in zip(*(words[k:] for k in range(SHINGLE)), strict=False)]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(shingles), BLOCK):
        hashes = np.array([digest(s, SEED) for s in shingles[at : at + BLOCK]], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(shingles)).tobytes(), "big")


def sign_bits(hashes: np.ndarray) -> int:
    """The SimHash of 64-bit hashes as a signed number: bit k is set if it is set in over half of them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = np.ascontiguousarray(hashes[at : at + BLOCK].astype(">i8"))
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``fp`` (the fingerprint's bits as a signed long) of each row."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x.as_py()) for x in batch["text"]], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(prints.view(np.int64))], names=["id", "fp"])

    return rows.mapInArrow(hashed, f"id {kind.simpleString()}, fp long")


def _segment(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * (k % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _chain(diff: Column, start: Column, length: int) -> Column:
    """Bits set in the segments start, start + 1, ... of ``diff``, of which there are ``length``."""
    total = F.lit(0)
    for k in range(length):
        at = ((start + k) % SEGMENTS * WIDTH).cast("int")
        total += F.bit_count(F.call_function("shiftrightunsigned", diff, at).bitwiseAND(F.lit((1 << WIDTH) - 1)))
    return total


def pigeonring(diff: Column, budget: int) -> Column:
    """Whether from some segment of ``diff`` on every chain of segments has at most its share of ``budget`` bits set; true of
    all ``diff`` with at most ``budget`` bits."""
    bits = [F.bit_count(_segment(diff, k)) for k in range(SEGMENTS)]
    passes = F.lit(False)
    for k in range(SEGMENTS):
        chain, total = F.lit(True), F.lit(0)
        for n in range(1, SEGMENTS):
            total = total + bits[(k + n - 1) % SEGMENTS]
            chain = chain & (SEGMENTS * total <= n * budget)
        passes = passes | chain
    return passes


def links(distinct: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links ``a``, ``b`` between the fingerprints ``fp`` of a table without repeats.

    They are all pairs at a distance of at most three bits, but for pairs within a bucket of more than ``max_bucket``
    fingerprints, which are connected by links of the definition instead of being listed.

    Spark sizes a table as if an explode made one row of each, so that joins of keys are told to sort and merge: 68 rows a
    fingerprint would be broadcast where the fingerprints themselves are small enough.
    """
    fp = F.col("fp")
    # as many partitions as shuffles have, not fewer for the few bytes of fingerprints: each makes 68 keys
    distinct = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")

    def key(k: int, flip: int) -> Column:
        return F.struct(
            F.lit(k).alias("k"),
            F.shiftleft(_segment(fp, k), WIDTH).bitwiseOR(_segment(fp, k + 1).bitwiseXOR(F.lit(flip))).alias("v"),
        )

    flips = [0, *(1 << b for b in range(WIDTH))]
    index = distinct.select("fp", F.inline(F.array(*[key(k, 0) for k in range(SEGMENTS)])))
    probe = distinct.select(F.col("fp").alias("other"), F.inline(F.array(*[key(k, x) for k in range(SEGMENTS) for x in flips])))
    full = checkpointed(index.groupBy("k", "v").count().where(F.col("count") > max_bucket).select("k", "v"))
    crowded = not full.isEmpty()
    if crowded:
        hot = probe.join(full, ["k", "v"], "left_semi").select(F.col("other").alias("fp")).distinct()
        index = index.join(full, ["k", "v"], "left_anti")
    diff = F.col("fp").bitwiseXOR(F.col("other"))
    near = (
        index.hint("merge").join(probe.hint("merge"), ["k", "v"])
        .where("fp < other")
        .where(_chain(diff, F.col("k"), 3) <= 2)
        .where(F.bit_count(diff) <= DISTANCE)
        .select(F.col("fp").alias("a"), F.col("other").alias("b"))
    )
    return near.unionByName(_ball_links(checkpointed(hot))) if crowded else near


def _ball_links(hot: DataFrame) -> DataFrame:
    bits = [1 << b if b < 63 else -(1 << 63) for b in range(64)]
    masks = [0, *bits, *(x ^ y for i, x in enumerate(bits) for y in bits[:i])]
    points = hot.select("fp", F.explode(F.lit(masks)).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"), (F.bit_count("mask") <= 1).alias("close")
    )
    centres = points.groupBy("point").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("centre"), F.count("*").alias("n"))
    centres = centres.where("n > 1 AND centre IS NOT NULL").drop("n")
    return points.hint("merge").join(centres.hint("merge"), "point").where("fp <> centre").select(F.col("centre").alias("a"), F.col("fp").alias("b")).distinct()


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bucket: int = MAX_BUCKET) -> DataFrame:
    """For each row its id, ``fingerprint`` (16 hex digits) and ``component_id``, the least id of its component.

    Rows are linked if their fingerprints differ in three bits or fewer; texts without words (null, empty, blank) have
    fingerprint zero and are linked like any other. Null ids are passed over when the least id is taken; a component
    of null ids only has a null one. Repeated rows come back as often as they were. An empty table gives an empty one.
    Other columns of ``df`` may have any names.
    """
    rows = checkpointed(fingerprints(df, id_col, text_col))  # two numbers a row
    least = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(least.select("fp"), max_bucket)).withColumnRenamed("node", "fp")
    rooted = checkpointed(least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    tops = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(tops, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
