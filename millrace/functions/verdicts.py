"""Verdicts out of a judge's answers, which are JSON of varying form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import let, unit_interval

# The closed vocabulary of failures.
FAILURE_CODES = (
    "EMPTY_RESPONSE", "SOLUTION_LEAK", "EXPLICIT_FINAL_DIAGNOSIS", "MULTIPLE_HINTS", "IRRELEVANT_HINT", "INCORRECT_DIAGNOSIS", "OVER_EXPLANATION",
    "PREMATURE_CONFIRMATION", "FAILED_TO_ADAPT", "WITHHELD_AFTER_SOLVED", "INSTRUCTION_OVERRIDE", "LOW_QUALITY", "DUPLICATE", "INVALID_SCHEMA",
)


def json_object(answer: Column) -> Column:
    """The first of a fenced object, the whole answer and its outermost braces that is a JSON object; null if none is."""
    fenced = F.nullif(F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.lit(""))
    valid = lambda text: let(text, lambda c: F.when(F.trim(c).startswith("{") & F.get_json_object(c, "$").isNotNull(), F.trim(c)))
    return F.coalesce(valid(fenced), valid(answer), valid(braces))


def verdict(answer: Column) -> Column:
    """A struct of the scores (clamped to 0..1; 0 where missing or no number), ``passed`` and the known ``failure_reasons``.

    Null if the answer holds no object, which is looked for once. Spellings of codes are upper-cased with underscores; unknown ones go.
    """
    return let(json_object(answer), _verdict)


def _verdict(doc: Column) -> Column:
    field = lambda name: F.get_json_object(doc, f"$.{name}")
    score = lambda name: F.coalesce(unit_interval(field(name)), F.lit(0.0)).alias(name)
    listed = F.from_json(field("failure_reasons"), "array<string>")
    reasons = F.coalesce(listed, F.when(field("failure_reasons").isNotNull(), F.array(field("failure_reasons"))), F.array().cast("array<string>"))
    spelled = F.transform(reasons, lambda c: F.replace(F.upper(F.trim(c)), F.lit(" "), F.lit("_")))
    passed = F.lower(F.coalesce(field("pass"), field("passed"), F.lit("false")))
    return F.when(
        doc.isNotNull(),
        F.struct(
            score("spec_adherence"), score("robustness"), score("hint_relevance"),
            (~passed.isin("false", "null", "0", "", "[]", "{}")).alias("passed"), F.array_distinct(F.filter(spelled, lambda c: c.isin(*FAILURE_CODES))).alias("failure_reasons"),
        ),
    )


def combined(error: Column, violations: Column, blocking: Column, passed: Column, adherence: Column, reasons: Column, judge_blocking: Column, least: float = 0.80) -> Column:
    """A struct of ``passed`` and ``failure_reasons`` of a record.

    An error decides first, then blocking violations, then the lack of a verdict (null ``passed``), then the verdict: its
    ``passed``, its adherence and whether it gives a code of ``judge_blocking``. Violations come before the judge's reasons.
    """
    none = F.array().cast("array<string>")
    violations, blocking, reasons = F.coalesce(violations, none), F.coalesce(blocking, none), F.coalesce(reasons, none)
    result = lambda ok, codes: F.struct(ok.alias("passed"), F.array_distinct(codes).alias("failure_reasons"))
    holds = F.coalesce(passed & (adherence >= least), F.lit(False)) & ~F.arrays_overlap(reasons, judge_blocking)
    return (
        F.when(error.isNotNull(), result(F.lit(False), F.array(F.lit("MODEL_ERROR"))))
        .when(F.size(blocking) > 0, result(F.lit(False), violations))
        .when(passed.isNull(), result(F.lit(False), F.concat(violations, F.array(F.lit("LOW_QUALITY")))))
        .otherwise(result(holds, F.concat(violations, reasons)))
    )
