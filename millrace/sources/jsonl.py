"""JSON lines: strict, permissive and lenient readers with explicit schemas, and what a table's ids have to satisfy.

Blank lines and lines that begin with ``//`` are comments. Files of a path are read as they come, in splits; where order
matters a record has its file, its split and a number that goes up within it. Problems are told by path and line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.judging import is_mock
from millrace.functions.text import grade
from millrace.operators.metrics import agreement
from millrace.operators.resume import first_of
from millrace.session import path_exists

CORRUPT = "_corrupt"
#: Problems that an error tells of.
SHOWN = 5


class InvalidRecords(ValueError):
    """Records that a strict reader refuses."""


def _scanned(spark: SparkSession, path: str) -> DataFrame:
    """All lines with their file, where the split that they are in begins, and a number that goes up within it by one a line."""
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    return spark.read.text(path).select("value", *place, F.monotonically_increasing_id().alias("_ordinal"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return _scanned(spark, path).where(~F.col("value").rlike(r"^\s*(?://.*)?$"))


def _line_numbers(scanned: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` of a scan (with ``_file``, ``_block`` and ``_ordinal``) with ``_line``, from 1 in each file, comments and blank lines counted.

    Splits of a file are read apart. How many lines each has is counted in one pass, and added up over the splits before; a
    line's place in its own split is known from its ordinal. Only files that ``rows`` is about are counted.
    """
    about = scanned.join(rows.select("_file").distinct(), "_file", "left_semi")
    blocks = about.groupBy("_file", "_block").agg(F.min("_ordinal").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_block")) - F.col("_n")
    starts = blocks.select("_file", "_block", (before - F.col("_first") + 1).alias("_shift"))
    return rows.join(starts, ["_file", "_block"]).withColumn("_line", F.col("_ordinal") + F.col("_shift")).drop("_shift")


def read_permissive(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All records, with ``_corrupt`` (the line, where it is no JSON object of the schema), ``_file``, ``_block`` and ``_ordinal``."""
    full = f"{schema}, {CORRUPT} string"
    parsed = _lines(spark, path).withColumn("_r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    return parsed.select("_r.*", "_file", "_block", "_ordinal")


def read_numbered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All records with ``_corrupt``, ``_file`` and ``_line``, the line's number in its file."""
    return _line_numbers(_scanned(spark, path), read_permissive(spark, path, schema)).drop("_block", "_ordinal")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of ``read_lenient``; none if there is no such path."""
    if path_exists(spark, path):
        return read_lenient(spark, path, schema)
    return spark.createDataFrame([], f"{schema}, _file string, _block bigint, _ordinal bigint")


def read_candidates(spark: SparkSession, path: str, schema: str, id_col: str = "id") -> DataFrame:
    """The first record of each id, in the order of files and lines; malformed lines are passed over, a missing path is empty."""
    rows = read_or_empty(spark, path, schema).where(F.col(id_col).isNotNull())
    return first_of(rows, [id_col], F.col("_file"), F.col("_block"), F.col("_ordinal")).drop("_file", "_block", "_ordinal")


def read_records(spark: SparkSession, path: str, schema: str, model: str = "model") -> DataFrame:
    """The records that no test double made; refused if there is none. Failures of infrastructure stay."""
    rows = read_or_empty(spark, path, schema).where(~is_mock(F.col(model)))
    if rows.isEmpty():
        raise InvalidRecords(f"{path}: no records of real models")
    return rows.drop("_file", "_block", "_ordinal")


def read_agreement(spark: SparkSession, path: str, own: str, human: str) -> DataFrame:
    """Agreement between two columns of a graded sheet; rows whose spelling is no grade count for neither side."""
    sheet = read_sheet(spark, path)
    return agreement(sheet, grade(F.col(own)), grade(F.col(human)))


def read_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records that can be read; other lines are passed over."""
    return read_permissive(spark, path, schema).where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def line_counts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row: ``lines`` and ``malformed``."""
    return read_permissive(spark, path, schema).agg(F.count("*").alias("lines"), F.count(CORRUPT).alias("malformed"))


def read_strict(spark: SparkSession, path: str, schema: str, problems: Column | None = None, id_col: str | None = "id") -> DataFrame:
    """The records, refused as a whole if a line is malformed, a record has ``problems`` (an array), an id repeats or there is no record."""
    rows = read_permissive(spark, path, schema)
    bad = F.array_compact(F.array(F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed"))))
    rows = rows.withColumn("_bad", bad if problems is None else F.when(F.size(bad) > 0, bad).otherwise(problems))
    wrong = rows.where(F.size("_bad") > 0).select("_file", "_block", "_ordinal", "_bad").limit(SHOWN)
    if not wrong.isEmpty():
        places = _line_numbers(_scanned(spark, path), wrong).orderBy("_file", "_line").collect()  # at most SHOWN rows
        raise InvalidRecords("; ".join(f"{r['_file']}:{r['_line']}: {', '.join(r['_bad'])}" for r in places))
    if rows.isEmpty():
        raise InvalidRecords(f"{path}: no records")
    if id_col:
        twice = repeated_ids(rows, id_col).limit(5).collect()
        if twice:
            raise InvalidRecords("ids repeat: " + ", ".join(str(r[0]) for r in twice))
    return rows.drop(CORRUPT, "_bad", "_block")


def repeated_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """``id`` and ``n`` of ids that stand twice or more, in one table or a union of several."""
    return df.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).where("n > 1")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A graded sheet: CSV with a header, quoted fields with line breaks and doubled quotes."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """A file that is one JSON document."""
    return spark.read.json(path, multiLine=True)


def passed_column(df: DataFrame) -> DataFrame:
    """``df`` with the two spellings of ``pass`` as one column ``passed``."""
    return df.withColumn("passed", F.coalesce("pass", "passed")).drop("pass")
