"""The test tables, and views of them in the form that the operators want."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.errors import error_kind
from millrace.functions.text import question_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their label, null where there is none."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and labels as evaluation records: toxic texts stand for errors, missing labels for missing verdicts."""
    n, toxic = F.col("n_chars"), F.col("toxic") == 1
    pressure = F.when(n < 400, "normal").when(n < 1500, "time_pressure").when(n < 4000, "frustrated").otherwise("solved")
    reasons = F.array_compact(
        F.array(F.when(toxic, F.lit("SOLUTION_LEAK")), F.when(F.col("quality") == 0, F.lit("LOW_QUALITY")), F.when(question_count(F.col("text")) > 1, F.lit("MULTIPLE_HINTS")))
    )
    return labelled(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.col("source").alias("model"), F.substring("source", 1, 4).alias("family"), F.col("lang").alias("strategy"), pressure.alias("pressure"),
        F.col("lang").alias("category"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("passed"), reasons.alias("reasons"), error_kind(F.when(toxic, F.col("text"))).alias("error_kind"),
        "text", F.col("quality").cast("double").alias("adherence"), (1 - F.col("toxic")).cast("double").alias("robustness"), F.when(F.col("quality").isNotNull(), F.least(F.lit(1.0), n / 1024)).alias("relevance"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of calls: those of type error failed for reasons of infrastructure."""
    kind = F.when(F.col("event_type") == "error", "infrastructure").otherwise("none")
    return table(spark, sf_dir, "events").withColumn("kind", kind).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def turn_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as candidates: the user's message before, code and fix before that, and the turns before as history."""
    before = Window.partitionBy("conv_id").orderBy("turn")
    text = F.coalesce("text", F.lit(""))
    told = F.collect_list(F.struct("role", text.alias("content"))).over(before.rowsBetween(Window.unboundedPreceding, -2))
    rows = table(spark, sf_dir, "conversations").withColumns(
        {name: F.coalesce(F.lag(text, k).over(before), F.lit("")) for k, name in ((1, "message"), (2, "code"), (3, "fix"))} | {"history": told}
    )
    language = F.when(F.col("conv_id") % 2 == 0, "python").otherwise("javascript")
    return rows.where("role = 'assistant'").select("conv_id", "turn", text.alias("response"), "message", "code", "fix", F.col("message").alias("bug"), "history", language.alias("language"), (F.col("turn") >= 3).alias("solved"))


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items, and documents whose id is divisible by 20, spaced otherwise or with a sentence more, with negative ids."""
    text = F.when(F.col("doc_id") % 40 == 0, F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\n"))).otherwise(F.concat("text", F.lit(" One more sentence at the end.")))
    known = table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select((-1 - F.col("doc_id")).alias("item_id"), text.alias("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", "text").unionByName(known)
