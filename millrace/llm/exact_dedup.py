"""Exact deduplication by progressive refinement.

Rows are compared by the length of their normalised text first; rows whose length is shared, by a hash of the text's
start; rows whose length and start are shared, by the hash of the whole text. The whole text is hashed for rows of the
last kind only. Groups are pre-aggregated to one row before they meet their members again, so that a group of any
size is a small row on one side of a join and plain rows, which can be split, on the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, let, squeezed, text_key, without_rows
from millrace.session import BROADCAST_ROWS

#: Code points of the normalised text that the second refinement hashes.
PREFIX = 64


def exact_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, digest: bool = False, keys: bool = False
) -> DataFrame:
    """For each row of ``df`` the group of equal texts that it is in.

    Texts are equal when identical without white space (``[\\x20\\x09-\\x0D]``); null counts as empty, so null, empty
    and blank texts are equal to each other. Of a group, the row with the most code points in its original text stays;
    of those, the one with the smallest id (nulls last). Rows of a group that share even their id have one verdict.

    Columns: the id, ``keep_id`` (id of the row that stays), ``group_size``, ``kept`` and ``text_sha256``, null where
    the refinement did not need it unless ``digest`` asks for it in each row; with ``keys`` the text's key
    ``_key`` as well. An empty table gives an empty one. Other columns of ``df`` may have any names.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    facts = lambda t: F.struct(F.length(t).alias("_len"), F.xxhash64(F.substring(t, 1, prefix)).alias("_start"), *([F.sha2(t, 256).alias("_sha")] if digest else []))
    rows = rows.withColumn("_facts", let(squeezed(F.col("_text")), facts))
    own = ["_id", "_facts.*", F.length(F.coalesce("_text", F.lit(""))).alias("_points"), text_key(F.col("_text")).alias("_key")]
    if digest:  # in each row, so that no text has to move
        rows = checkpointed(rows.select(*own))
    else:
        rows = rows.select(*own, "_text")
    starts = rows.groupBy("_len", "_start").agg(F.count("*").alias("_n"))
    lengths = starts.groupBy("_len").agg(F.sum("_n").alias("_rows")).where("_rows > 1").select("_len")
    whole = checkpointed(starts.join(lengths, "_len", "left_semi").where("_n > 1").select("_len", "_start", F.lit(True).alias("_whole")))
    if whole.count() <= BROADCAST_ROWS:  # no text has to move to its key
        whole = F.broadcast(whole)
    sha = F.col("_sha") if digest else F.when(F.col("_whole"), F.sha2(squeezed(F.col("_text")), 256)).alias("_sha")
    # written out, so that both sides of the join below are plain rows whose hot keys Spark can split
    hashed = checkpointed(rows.join(whole, ["_len", "_start"], "left").select("_id", "_len", "_points", "_key", F.coalesce("_whole", F.lit(False)).alias("_whole"), sha))
    best: Column = F.min(F.struct(-F.col("_points"), F.col("_id").isNull(), F.col("_id").alias("id")))
    groups = hashed.where("_whole").groupBy("_len", "_sha").agg(best.getField("id").alias("_keep"), F.count("*").alias("_size"))
    groups = checkpointed(groups.where("_size > 1").withColumn("_found", F.lit(True)))
    joined = hashed.join(groups, ["_len", "_sha"], "left")
    keep = F.when(F.col("_found"), F.col("_keep")).otherwise(F.col("_id"))
    return joined.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *([F.col("_key")] if keys else []),
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with their columns unchanged. Rows of a group that have the id of the one that stays
    stay as well."""
    groups = exact_groups(df, id_col, text_col, keys=True)
    return without_rows(df, groups.where("NOT kept").select(F.col(id_col).alias("_id"), "_key"), id_col, text_col)
