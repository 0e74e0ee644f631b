"""Evaluation of responses as one operator, and candidates out of a teacher's payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.criteria import CRITERIA, OVER_LONG, integrity_codes, static_codes
from millrace.functions.errors import error_kind
from millrace.functions.judging import answer_warnings, unavailable
from millrace.functions.text import let
from millrace.functions.verdicts import combined, verdict

# What a teacher's payload has to have.
REQUIRED = ("code", "student_message", "expected_bug", "expected_fix", "tutor_response")
_STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def evaluated(df: DataFrame, response: Column, solved: Column, answer: Column, error: Column, leaked: Column | None = None) -> DataFrame:
    """``df`` with ``passed``, ``failure_reasons``, ``error_kind`` and ``warnings`` of each response.

    ``answer`` is what the judge wrote (null: could not be asked), ``error`` what the provider said (null: nothing). A
    response with an error is not judged.
    """
    solved = F.coalesce(solved, F.lit(False))
    open_ = F.array(*[F.lit(c.code) for c in CRITERIA if c.blocking and c.state != "solved"])
    closed = F.array(*[F.lit(c.code) for c in CRITERIA if c.blocking and c.state != "unsolved"])
    judged = F.when(error.isNull(), answer)
    row = F.struct(static_codes(response, solved, leaked).alias("checks"), verdict(judged).alias("verdict"))

    def result(r: Column) -> Column:
        c, v = r["checks"], r["verdict"]
        both = combined(error, c["violations"], c["blocking"], v["passed"], v["spec_adherence"], v["failure_reasons"], F.when(solved, closed).otherwise(open_))
        return F.struct(both["passed"].alias("passed"), both["failure_reasons"].alias("failure_reasons"), error_kind(error).alias("error_kind"), F.when(error.isNull(), answer_warnings(judged)).alias("warnings"))

    return df.withColumn("_result", let(row, result)).select(*df.columns, "_result.*")


def unjudged(warnings: Column) -> Column:
    """Whether a row waits for a judge that could not be reached."""
    return unavailable(warnings)


def static_screen(response: Column, solved: Column, integrity: Column, leaked: Column | None = None) -> Column:
    """Distinct codes that keep a candidate out of training data: of its integrity, of blocking criteria, and of too long an
    answer, which is no reason elsewhere. ``leaked``: a column that says whether the fix was given away."""
    checks = static_codes(response, solved, leaked)
    return let(checks, lambda c: F.array_distinct(F.concat(integrity, c["blocking"], F.filter(c["violations"], lambda x: x == OVER_LONG))))


def candidate_integrity(df: DataFrame, parses: Column) -> Column:
    """``integrity_codes`` over the columns of a candidate: code, language, response, solved, fix, bug, message and history."""
    names = ("code", "language", "response", "solved", "fix", "bug", "message", "history")
    return integrity_codes(parses=parses, **{n: df[n] for n in names})


def built(df: DataFrame, payload: Column, turns: Column) -> DataFrame:
    """``df`` with ``candidate`` (the fields of a payload, stripped, the code without a fence around it) and ``problems`` (codes;
    empty for a candidate that can be used). ``turns``: exchanges that its history has to have.
    """
    schema = f"{', '.join(f'{n} string' for n in REQUIRED)}, conversation_history string"
    doc = F.from_json(payload, schema)
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), _STRIP, "")
    bare = lambda c: strip(F.coalesce(F.nullif(F.regexp_extract(strip(c), r"(?s)^```[a-zA-Z]*\n(.*?)```\z", 1), F.lit("")), strip(c)))
    history = F.from_json(F.col("_doc.conversation_history"), "array<struct<role:string,content:string>>")
    said = F.transform(history, lambda m: F.struct(F.lower(strip(m["role"])).alias("role"), strip(m["content"]).alias("content")))
    rows = df.withColumn("_doc", doc).withColumn("_said", F.coalesce(said, F.array().cast("array<struct<role:string,content:string>>")))
    raw = F.coalesce(F.col("_doc.conversation_history"), F.lit(""))
    rules = {
        "no_object": F.col("_doc").isNull(),
        **{f"missing_{n}": F.col("_doc").isNotNull() & (strip(F.col(f"_doc.{n}")) == "") for n in REQUIRED},
        "history_missing": (turns > 0) & (F.size("_said") == 0) & raw.isin("", "[]"),
        "history_no_list": ~raw.isin("", "[]") & (F.size("_said") == 0),
        "history_bad_turn": F.exists("_said", lambda m: ~F.coalesce(m["role"].isin("user", "assistant"), F.lit(False)) | (m["content"] == "")),
        "history_incomplete": F.size("_said") % 2 != 0,
    }
    problems = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    fields = [bare(F.col("_doc.code")).alias("code"), *[strip(F.col(f"_doc.{n}")).alias(n) for n in REQUIRED[1:]], F.col("_said").alias("history")]
    return rows.select(*df.columns, F.when(F.size(problems) == 0, F.struct(*fields)).alias("candidate"), problems.alias("problems"))
