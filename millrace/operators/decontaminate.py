"""Overlap between a corpus and an evaluation set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import content_hash
from millrace.operators.dedupe import shingle_sets
from millrace.operators.similarity import anchors, candidates, classes, frequent, shared_counts, small
from millrace.session import BROADCAST_TERMS, checkpointed

NEAR = 0.60


def exact_overlap(corpus: DataFrame, evaluation: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Rows of ``corpus`` whose normalised text is in ``evaluation``."""
    hashes = checkpointed(evaluation.select(content_hash(F.col(text_col)).alias("_hash")).distinct())  # counted, then joined
    return corpus.withColumn("_hash", content_hash(F.col(text_col))).join(small(hashes), "_hash", "left_semi").drop("_hash")


def _sides(corpus: DataFrame, evaluation: DataFrame, id_col: str, eval_id: str, text_col: str) -> list[DataFrame]:
    """Sets of either side (id, shingles, key), and of either the first of those that are equal (id, key)."""
    sides = [checkpointed(classes(shingle_sets(df, name, F.col(text_col)))) for df, name in ((corpus, id_col), (evaluation, eval_id))]
    return sides + [checkpointed(side.groupBy("key").agg(F.min("id").alias("id"))) for side in sides]


def near_overlap(corpus: DataFrame, evaluation: DataFrame, id_col: str, eval_id: str, text_col: str = "text", threshold: float = NEAR) -> DataFrame:
    """``id``, ``eval_id`` and ``similarity`` of each corpus row's most similar evaluation text at ``threshold`` or more (ties: least id).

    Equal sets are compared as one. Those that the evaluation has, too, have found their text; the others meet by their prefixes, and the sets
    of pairs that may be similar are compared in groups.
    """
    ours, theirs, our_firsts, their_firsts = _sides(corpus, evaluation, id_col, eval_id, text_col)
    equal = our_firsts.join(their_firsts.select("key", F.col("id").alias("eval_id")), "key").select("id", "eval_id", F.lit(1.0).alias("similarity"))
    open_ = our_firsts.join(their_firsts.select("key"), "key", "left_anti").select("id")
    left, right = ours.join(small(open_, BROADCAST_TERMS), "id", "left_semi"), theirs.join(small(their_firsts.select("id"), BROADCAST_TERMS), "id", "left_semi")
    pairs = shared_counts(candidates(left, right, threshold), ours, theirs)
    scored = pairs.withColumn("similarity", F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).where(F.col("similarity") >= threshold)
    best = scored.groupBy("a").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("b").alias("eval_id"))).alias("b"))
    found = equal.unionByName(best.select(F.col("a").alias("id"), "b.eval_id", (-F.col("b.s")).alias("similarity")))
    named = found.join(our_firsts, "id").drop("id")
    return ours.select("id", "key").join(small(checkpointed(named)), "key").select("id", "eval_id", "similarity")


def contained(corpus: DataFrame, evaluation: DataFrame, id_col: str, eval_id: str, text_col: str = "text", share: float = 1.0) -> DataFrame:
    """``id`` and ``eval_id`` where at least ``share`` of an evaluation text's shingles are in a corpus row.

    A row that holds so many of them holds one of the text's prefix, so that only rows of rare shingles are compared; equal sets are compared as one.
    """
    ours, theirs, our_firsts, their_firsts = _sides(corpus, evaluation, id_col, eval_id, text_col)
    rare = anchors(theirs.join(small(their_firsts.select("id"), BROADCAST_TERMS), "id", "left_semi"), frequent(ours), share)
    rare = small(checkpointed(rare.select(F.col("id").alias("b"), F.col("n").alias("m"), "s")), BROADCAST_TERMS)
    met = ours.select(F.col("id").alias("a"), F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("s")).join(rare, "s")
    pairs = met.where(F.col("n") >= share * F.col("m")).select("a", "b", "n", "m").distinct()
    pairs = pairs.join(small(our_firsts.select(F.col("id").alias("a")), BROADCAST_TERMS), "a", "left_semi")
    found = shared_counts(pairs, ours, theirs).where(F.col("shared") >= share * F.col("m"))
    keyed = found.join(our_firsts.select(F.col("id").alias("a"), F.col("key").alias("x")), "a").join(their_firsts.select(F.col("id").alias("b"), F.col("key").alias("y")), "b").select("x", "y")
    every = keyed.join(ours.select(F.col("key").alias("x"), "id"), "x").join(theirs.select(F.col("key").alias("y"), F.col("id").alias("eval_id")), "y")
    return every.select("id", "eval_id")


def split_contaminated(corpus: DataFrame, overlap: DataFrame, id_col: str) -> DataFrame:
    """``corpus`` with ``contaminated``: whether its id is in ``overlap``."""
    ids = overlap.select(F.col("id").alias("_hit")).distinct().withColumn("_found", F.lit(True))
    return corpus.join(ids, corpus[id_col] == F.col("_hit"), "left").withColumn("contaminated", F.coalesce("_found", F.lit(False))).drop("_hit", "_found")
