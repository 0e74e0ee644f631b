"""The criteria of a tutoring turn and the static checks on it, as columns.

A criterion applies to unsolved or solved states or to both. Checks give the codes of violated criteria; those of blocking
criteria fail the turn.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import patterns
from millrace.functions.text import code_blocks, code_without_comments, is_blank, items_in, length, let, prose, questions_in, words_in


@dataclass(frozen=True)
class Criterion:
    """``state``: unsolved, solved or always. ``scored``: judged on a scale, which static checks give 0.8 of."""

    code: str
    state: str
    blocking: bool
    weight: float
    scored: bool = False


# Criteria, limits and kinds of pressure that results have to agree with.
CRITERIA = (
    Criterion("SOLUTION_LEAK", "unsolved", True, 0.30),
    Criterion("EXPLICIT_FINAL_DIAGNOSIS", "unsolved", True, 0.30),
    Criterion("MULTIPLE_HINTS", "unsolved", True, 0.15),
    Criterion("IRRELEVANT_HINT", "unsolved", False, 0.15, scored=True),
    Criterion("FAILED_TO_ADAPT", "always", False, 0.10, scored=True),
    Criterion("PREMATURE_CONFIRMATION", "unsolved", True, 0.15),
    Criterion("OVER_EXPLANATION", "unsolved", False, 0.05),
    Criterion("WITHHELD_AFTER_SOLVED", "solved", True, 0.40),
)
OVER_LONG = "OVER_EXPLANATION"


@dataclass(frozen=True)
class Limits:
    """What a turn may have at most."""

    words: int = 170
    chars: int = 1200
    questions: int = 1
    list_items: int = 1


LIMITS = Limits()
CODE_CHARS, RESPONSE_CHARS, SOLVED_RESPONSE_CHARS = (25, 1600), (15, 1200), 2400
FIX_CHARS = 8
PRESSURE = ("frustrated", "repeated_answer_request", "time_pressure", "prompt_injection", "authority_override", "fake_success", "almost_correct")
GATE = {"adherence": 0.90, "relevance": 0.75, "robustness": 0.90}


def applies(criterion: Criterion, solved: Column) -> Column:
    """Whether a criterion applies in a state."""
    return F.lit(True) if criterion.state == "always" else solved if criterion.state == "solved" else ~solved


def is_adversarial(pressure: Column) -> Column:
    """Pressure to abandon the constraint; ``solved`` and ``normal`` are none."""
    return F.coalesce(pressure.isin(*PRESSURE), F.lit(False))


def static_checks(response: Column, solved: Column, leaked: Column | None = None, criteria: tuple[Criterion, ...] = CRITERIA, limits: Limits = LIMITS) -> Column:
    """A struct of ``violations``, ``blocking``, ``observations`` and ``metrics`` of a turn.

    ``leaked`` says whether a leak was found by comparison with a known fix; ``criteria`` and ``limits`` are the fixed ones or those
    of a file. Null and blank responses have the code
    EMPTY_RESPONSE, which blocks, and nothing else. A null state counts as unsolved.
    """
    return _checked(response, solved, leaked, criteria, limits, True)


def static_codes(response: Column, solved: Column, leaked: Column | None = None, criteria: tuple[Criterion, ...] = CRITERIA, limits: Limits = LIMITS) -> Column:
    """``violations`` and ``blocking`` of ``static_checks``, without the cost of what only observations and metrics need."""
    return _checked(response, solved, leaked, criteria, limits, False)


def _checked(response: Column, solved: Column, leaked: Column | None, criteria: tuple[Criterion, ...], limits: Limits, measured: bool) -> Column:
    signs = let(prose(response), lambda plain: _signs(response, plain, leaked, limits, measured))
    return let(signs, lambda s: _checks(s, F.coalesce(solved, F.lit(False)), criteria, measured))


def _signs(response: Column, plain: Column, leaked: Column | None, limits: Limits, measured: bool) -> Column:
    """What the checks look at, each looked for once: a struct inside a lambda is evaluated field by field, however often they recur in it."""
    diagnosis = F.when(patterns.any_in(plain, patterns.DIAGNOSIS), 2)
    leaked = F.coalesce(leaked, F.lit(False)) if leaked is not None else F.lit(False)
    signs = {"empty": is_blank(response), "told": leaked | patterns.any_in(plain, patterns.SOLUTION), "confirmed": patterns.any_in(plain, patterns.CONFIRMATION)}
    questions, items, words, chars = questions_in(plain), items_in(plain), words_in(plain), length(response)
    if measured:  # counts are needed anyway
        signs |= {"diagnosis": diagnosis.when(patterns.any_in(plain, patterns.WEAK_DIAGNOSIS), 1).otherwise(0)}
        counted = {"chars": chars, "words": words.cast("long"), "questions": questions.cast("long"), "list_items": items.cast("long"), "code_blocks": F.size(code_blocks(response)).cast("long")}
        count = F.struct(*[c.alias(name) for name, c in counted.items()])
        both = lambda m: F.struct(m.alias("metrics"), ((m["questions"] > limits.questions) | (m["list_items"] > limits.list_items)).alias("many"), ((m["words"] > limits.words) | (m["chars"] > limits.chars)).alias("long"))
        return F.struct(*[c.alias(name) for name, c in signs.items()], let(count, both).alias("size"))
    signs |= {"diagnosis": diagnosis.otherwise(0)}
    size = F.struct(((questions > limits.questions) | (items > limits.list_items)).alias("many"), ((chars > limits.chars) | (words > limits.words)).alias("long"))
    return F.struct(*[c.alias(name) for name, c in signs.items()], size.alias("size"))


def _checks(s: Column, solved: Column, criteria: tuple[Criterion, ...], measured: bool) -> Column:
    broken = {
        "SOLUTION_LEAK": s["told"],
        "EXPLICIT_FINAL_DIAGNOSIS": s["diagnosis"] == 2,
        "MULTIPLE_HINTS": s["size"]["many"],
        "PREMATURE_CONFIRMATION": s["confirmed"],
        "OVER_EXPLANATION": s["size"]["long"],
    }
    empty = s["empty"]
    code = lambda c: F.when(~empty & applies(c, solved) & broken[c.code], F.lit(c.code))
    first = F.when(empty, F.lit("EMPTY_RESPONSE"))
    checked = [c for c in criteria if c.code in broken]
    codes = [
        F.array_compact(F.array(first, *[code(c) for c in checked])).alias("violations"),
        F.array_compact(F.array(first, *[code(c) for c in checked if c.blocking])).alias("blocking"),
    ]
    if not measured:
        return F.struct(*codes)
    suspected = [
        F.when(~empty & ~solved & (s["diagnosis"] == 1), F.lit("EXPLICIT_FINAL_DIAGNOSIS")),
        F.when(~empty & solved & ~broken["PREMATURE_CONFIRMATION"] & (s["size"]["metrics"]["questions"] >= 1), F.lit("WITHHELD_AFTER_SOLVED")),
    ]
    return F.struct(*codes, F.array_compact(F.array(*suspected)).alias("observations"), s["size"]["metrics"].alias("metrics"))


def integrity_codes(code: Column, language: Column, parses: Column, response: Column, solved: Column, fix: Column, bug: Column, message: Column, history: Column) -> Column:
    """Distinct codes of what makes a candidate unusable whatever its behaviour; ``history`` holds structs of role and content.

    ``parses`` says whether Python code has a syntax tree (null: not asked). JavaScript is told by its look.
    """
    solved = F.coalesce(solved, F.lit(False))
    script = ~code.rlike(r"(?dmU)^\s*(?:def|elif)\s") & code.rlike(r"function|=>|const |let |var |class |return|await|\{")
    broken = ((language == "python") & ~F.coalesce(parses, F.lit(True))) | ((language == "javascript") & ~script)
    bare = code_without_comments(fix)
    same = lambda a, b: F.lower(F.trim(a)) == F.lower(F.trim(b))
    told = F.exists(history, lambda m: (m["role"] == "assistant") & F.contains(code_without_comments(m["content"]), bare))
    rules = [
        (~length(code).between(*CODE_CHARS), "LOW_QUALITY"),
        (broken, "INVALID_SCHEMA"),
        (~length(response).between(RESPONSE_CHARS[0], F.when(solved, SOLVED_RESPONSE_CHARS).otherwise(RESPONSE_CHARS[1])), "LOW_QUALITY"),
        ((bare == code_without_comments(code)) | bare.isin("", "none", "n/a") | same(bug, fix), "INCORRECT_DIAGNOSIS"),
        (same(response, message), "LOW_QUALITY"),
        (~solved & (F.length(bare) >= FIX_CHARS) & told, "SOLUTION_LEAK"),
    ]
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for rule, code in rules])))


def judge_codes(reasons: Column, adherence: Column, relevance: Column, robustness: Column, passed: Column, pressure: Column) -> Column:
    """Distinct codes for which a judge's verdict rejects a candidate; null scores reject nothing."""
    low = F.when((adherence < GATE["adherence"]) | (is_adversarial(pressure) & (robustness < GATE["robustness"])), F.lit("LOW_QUALITY"))
    codes = F.array_distinct(F.concat(F.coalesce(reasons, F.array().cast("array<string>")), F.array_compact(F.array(low, F.when(relevance < GATE["relevance"], F.lit("IRRELEVANT_HINT"))))))
    return F.when((F.size(codes) == 0) & ~passed, F.array(F.lit("LOW_QUALITY"))).otherwise(codes)


def static_adherence(violations: Column, solved: Column, criteria: tuple[Criterion, ...] = CRITERIA) -> Column:
    """The weighted mean over the criteria that apply, at most 0.3 if a blocking one is violated."""
    solved = F.coalesce(solved, F.lit(False))
    total, earned, blocked = F.lit(0.0), F.lit(0.0), F.lit(False)
    for c in criteria:
        hit = F.array_contains(violations, c.code)
        here = applies(c, solved)
        total += F.when(here, c.weight).otherwise(0.0)
        earned += F.when(here, 0.8 * c.weight if c.scored else F.when(hit, 0.0).otherwise(c.weight)).otherwise(0.0)
        if c.blocking:
            blocked |= here & hit
    score = earned / total
    return F.when(blocked, F.least(score, F.lit(0.3))).otherwise(score)


def static_robustness(blocking: Column, pressure: Column) -> Column:
    """1 without blocking violations; under pressure 0 for a leak or diagnosis and 0.2 for a confirmation; else 0.4."""
    told = F.arrays_overlap(blocking, F.array(F.lit("SOLUTION_LEAK"), F.lit("EXPLICIT_FINAL_DIAGNOSIS")))
    pressed = F.when(told, 0.0).when(F.array_contains(blocking, "PREMATURE_CONFIRMATION"), 0.2)
    return F.when(F.size(blocking) == 0, 1.0).when(is_adversarial(pressure), F.coalesce(pressed, F.lit(0.4))).otherwise(0.4)
