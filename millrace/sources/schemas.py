"""Schemas of the records on disk, and what makes a record invalid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import is_blank
from millrace.operators.records import alternates

MESSAGES = "array<struct<role:string,content:string>>"
SCENARIO = (
    "id string, language string, bug_category string, difficulty string, code string, conversation_history " + MESSAGES + ", student_message string, "
    "expected_bug string, expected_fix string, student_has_solved boolean, pressure_type string, source string, split string, notes string"
)
JUDGE = (
    "struct<spec_adherence:double,robustness:double,hint_relevance:double,pass:boolean,passed:boolean,failure_reasons:array<string>,reasoning:string,"
    "judge_model:string,judge_model_family:string,judge_prompt_version:string,parse_warnings:array<string>,raw_response:string>"
)
CHECKS = "struct<pass:boolean,passed:boolean,violations:array<string>,details:string,checks_version:string>"
CANDIDATE = (
    f"id string, scenario struct<{', '.join(f'{n}:{t}' for n, t in (x.split(' ', 1) for x in SCENARIO.split(', ')))}>, tutor_response string, "
    "dimensions struct<language:string,bug_category:string,difficulty:string,pressure_type:string,conversation_turns:int,learner_competence:string,"
    "learner_frustration:string,hint_strength:string,student_progress:string>, "
    "provenance struct<teacher_model:string,teacher_revision:string,generation_prompt_version:string,generation_prompt_sha256:string,template_id:string,"
    "generation_seed:bigint,dataset_version:string,behavior_spec_version:string,behavior_spec_sha256:string,timestamp:string>, "
    f"accepted boolean, rejection_codes array<string>, deterministic {CHECKS}, judge {JUDGE}, duplicate_of string, gate_notes string"
)
EVALUATION = (
    "scenario_id string, scenario_split string, pressure_type string, language string, bug_category string, difficulty string, student_has_solved boolean, "
    "model string, model_family string, model_revision string, prompt_strategy string, prompt_version string, input_messages " + MESSAGES + ", model_response string, "
    f"deterministic {CHECKS}, judge {JUDGE}, failure_reasons array<string>, pass boolean, passed boolean, behavior_spec_version string, "
    "behavior_spec_sha256 string, generation_params map<string,string>, error string, error_kind string, timestamp string"
)
CHAT = f"messages {MESSAGES}, meta map<string,string>"

# Closed vocabularies.
LANGUAGES, DIFFICULTIES = ("python", "javascript"), ("easy", "medium", "hard")
PRESSURES = ("normal", "frustrated", "repeated_answer_request", "time_pressure", "prompt_injection", "authority_override", "fake_success", "almost_correct", "solved")
SPLITS = ("clean", "adversarial", "heldout", "train")
SLUG = r"^[a-z0-9]+(?:[_-][a-z0-9]+)*$"


def _in(column: str, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def scenario_problems() -> Column:
    """Codes of what is wrong with a scenario; an array, empty for a valid one."""
    history = F.coalesce(F.col("conversation_history"), F.array().cast(MESSAGES))
    solved, pressure = F.coalesce("student_has_solved", F.lit(False)), F.col("pressure_type")
    blank = F.lit(False)
    for c in ("bug_category", "code", "student_message", "expected_bug", "expected_fix"):
        blank |= is_blank(F.col(c))
    rules = {
        "bad_id": ~F.coalesce(F.col("id").rlike(SLUG), F.lit(False)),
        "blank_text": blank,
        "unknown_value": ~(_in("language", LANGUAGES) & _in("difficulty", DIFFICULTIES) & _in("pressure_type", PRESSURES)),
        "bad_history": ~alternates(history) | F.exists(history, lambda m: is_blank(m["content"])),
        "state_contradicts_pressure": ((pressure == "solved") & ~solved) | ((pressure == "fake_success") & solved) | (solved & ~_in("pressure_type", ("solved", "normal"))),
    }
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def judge_problems(judge: Column) -> Column:
    """Codes of what is wrong with a verdict; null verdicts are fine."""
    outside = F.lit(False)
    for c in ("spec_adherence", "robustness", "hint_relevance"):
        outside |= ~F.coalesce(judge[c].between(0.0, 1.0), F.lit(False))
    return F.array_compact(F.array(F.when(judge.isNotNull() & outside, F.lit("score_out_of_range"))))
