"""What judges are asked, who they are, and what their answers and a provider's errors say about themselves, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.errors import INFRASTRUCTURE
from millrace.functions.text import is_blank, let, unit_interval
from millrace.functions.verdicts import FAILURE_CODES, json_object

# Prefixes of models that are test doubles, markers of provider errors with their verdicts, words of code
# that say nothing about it, the relevance of answers without evidence, and how a dialogue is written for a judge.
MOCKS = ("mock:", "scripted:", "failing:")
DIAGNOSES = (
    ("insufficient_quota", "NO_QUOTA"), ("credit balance is too low", "NO_QUOTA"), ("billing", "BILLING"), ("authentication_error", "BAD_CREDENTIAL"),
    ("invalid_api_key", "BAD_CREDENTIAL"), ("invalid x-api-key", "BAD_CREDENTIAL"), ("permission_error", "NO_PERMISSION"), ("not_found_error", "BAD_MODEL"),
    ("model_not_found", "BAD_MODEL"), ("does not exist", "BAD_MODEL"), ("rate_limit", "RATE_LIMITED"),
)
STOP = (
    "the", "and", "that", "this", "with", "from", "for", "not", "but", "are", "was", "were", "has", "have", "its", "their", "which", "when", "where",
    "code", "function", "value", "values", "should", "instead", "because",
)
NEUTRAL, UNCLEAR = 0.8, 0.5
NO_TURNS = "(no prior turns — this is the learner's first message)"
SPEAKERS = {"user": "LEARNER", "assistant": "TUTOR"}
SCORES = ("spec_adherence", "robustness", "hint_relevance")


def is_mock(model: Column) -> Column:
    """Whether a model is a test double."""
    low = F.lower(F.coalesce(model, F.lit("")))
    hit = F.lit(False)
    for prefix in MOCKS:
        hit |= low.startswith(prefix)
    return hit


def diagnosis(error: Column) -> Column:
    """What to do about a provider's error: the verdict of the first marker in it; null for null."""
    low, out = F.lower(error), F.when(error.isNull(), None)
    for marker, verdict in DIAGNOSES:
        out = out.when(F.contains(low, F.lit(marker)), verdict)
    transient = F.lit(False)
    for marker in INFRASTRUCTURE:
        transient |= F.contains(low, F.lit(marker))
    return out.when(transient, "INFRASTRUCTURE").otherwise("UNKNOWN_ERROR")


def judge_family(family: Column, model: Column) -> Column:
    """The family of a judge: as recorded, else what stands before the colon of its name, else ``deterministic`` or ``unknown``."""
    recorded = F.when(~F.coalesce(family, F.lit("")).isin("", "unknown"), family)
    named = F.when(F.contains(model, F.lit(":")), F.split_part(model, F.lit(":"), F.lit(1))).when(model.startswith("deterministic"), "deterministic")
    return F.coalesce(recorded, named, F.lit("unknown"))


def self_judged(family: Column, subject_family: Column) -> Column:
    """Whether judge and subject are of one family; null where the judge's family says nothing."""
    return F.when(~family.isin("unknown", "deterministic"), family == subject_family)


def answer_warnings(answer: Column) -> Column:
    """Codes of what had to be put right in a judge's answer; ``judge_unavailable`` if there is none."""
    return F.when(answer.isNull(), F.array(F.lit("judge_unavailable"))).otherwise(let(json_object(answer), _doc_warnings))


def _doc_warnings(doc: Column) -> Column:
    field = lambda name: F.get_json_object(doc, f"$.{name}")
    codes = []
    for name in SCORES:
        value, number = field(name), field(name).try_cast("double")
        codes.append(F.when(value.isNotNull() & number.isNull(), f"{name}: no number").when(~number.between(0, 1), f"{name}: out of range"))
    listed = F.coalesce(F.from_json(field("failure_reasons"), "array<string>"), F.array().cast("array<string>"))
    spelled = F.transform(listed, lambda c: F.replace(F.upper(F.trim(c)), F.lit(" "), F.lit("_")))
    unknown = F.transform(F.filter(spelled, lambda c: ~c.isin(*FAILURE_CODES) & (c != "")), lambda c: F.concat(F.lit("unknown code: "), c))
    coerced = F.when(~F.coalesce(field("pass"), field("passed"), F.lit("")).isin("true", "false"), F.lit("pass: no boolean"))
    return F.when(doc.isNull(), F.array(F.lit("no object"))).otherwise(F.concat(F.array_compact(F.array(*codes, coerced)), unknown))


def unavailable(warnings: Column) -> Column:
    """Whether a verdict only stands in for one that could not be had."""
    return F.coalesce(F.array_contains(warnings, "judge_unavailable"), F.lit(False))


def static_relevance(response: Column, code: Column) -> Column:
    """0 for a blank response; without words in the code neutral; neutral if it mentions one of them, else unclear."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(code, F.lit(""))), F.lit("([a-z_][a-z0-9_]{2,})"), F.lit(1)), lambda w: ~w.isin(*STOP)))
    low = F.lower(response)
    return F.when(is_blank(response), 0.0).when((F.size(words) == 0) | F.exists(words, lambda w: F.contains(low, w)), NEUTRAL).otherwise(UNCLEAR)


def dialogue(history: Column) -> Column:
    """A history (structs of role and content) as learner and tutor speaking in turn."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    turn = lambda m: F.concat(F.when(m["role"] == "user", SPEAKERS["user"]).otherwise(SPEAKERS["assistant"]), F.lit(": "), strip(m["content"]))
    return F.when(F.coalesce(F.size(history), F.lit(0)) <= 0, NO_TURNS).otherwise(F.array_join(F.transform(history, turn), "\n\n"))


def prompt(template: str, **fields: Column) -> Column:
    """A template with ``{name}`` places filled; a null field counts as empty."""
    parts, rest = [], template
    while rest:
        at = min((k for k in (rest.find("{" + name + "}") for name in fields) if k >= 0), default=len(rest))
        if at:
            parts.append(F.lit(rest[:at]))
        rest = rest[at:]
        for name, column in fields.items():
            if rest.startswith("{" + name + "}"):
                parts.append(F.coalesce(column.cast("string"), F.lit("")))
                rest = rest[len(name) + 2 :]
                break
    return F.concat(*parts) if parts else F.lit("")


def clamped(value: Column) -> Column:
    """A score within 0..1, 0 where it is no number."""
    return F.coalesce(unit_interval(value), F.lit(0.0))
