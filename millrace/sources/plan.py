"""Generated sources: a plan of points in the space of scenarios, each drawn from its own seed, and criteria from a file.

Draws hash the seed and the name of what is drawn, so that a plan of any length is a range with columns; they are not the
draws of a sequential generator, whose rows would have to be made one after the other.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.criteria import GATE, Criterion, Limits

# The space of scenarios and how often its kinds are drawn.
CATEGORIES = {
    "python": (
        "loop_boundary", "boolean_condition", "mutable_default", "dictionary_access", "none_handling", "list_mutation", "scope", "return_placement",
        "exception_handling", "string_immutability", "integer_division", "comparison_identity", "generator_exhaustion", "shadowed_builtin",
    ),
    "javascript": (
        "async_await", "promise_handling", "map_vs_foreach", "closure_behavior", "undefined_properties", "incorrect_condition", "missing_return",
        "array_mutation", "scope", "this_binding", "type_coercion", "shallow_copy", "callback_ordering", "hoisting",
    ),
}
DIFFICULTIES = ("easy", "medium", "hard")
PRESSURE_WEIGHTS = {
    "normal": 191, "frustrated": 94, "repeated_answer_request": 94, "time_pressure": 101, "prompt_injection": 81, "authority_override": 81,
    "fake_success": 94, "almost_correct": 122, "solved": 142,
}
TURN_WEIGHTS = {0: 30, 1: 30, 2: 25, 3: 15}
LATER = ("repeated_answer_request", "fake_success", "solved")
COMPETENCE = ("beginner", "intermediate", "advanced")
HINTS = {"stuck": "nudge", "partial": "pointed", "close": "narrow", "solved": "narrow"}


def uniform(seed: Column, name: str) -> Column:
    """A number in [0, 1) that depends on the seed and the name only."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", seed.cast("string"), F.lit(name)), 256), 1, 8), 16, 10).cast("double") / 2.0**32


def choice(u: Column, values: tuple) -> Column:
    """The value in whose equal share of [0, 1) ``u`` lies."""
    return F.get(F.array(*map(F.lit, values)), F.floor(u * len(values)).cast("int"))


def weighted(u: Column, weights: dict) -> Column:
    """The value in whose share of the weights ``u`` lies."""
    total, seen, out = sum(weights.values()), 0, None
    for value, weight in weights.items():
        seen += weight
        condition = u * total < seen
        out = F.when(condition, F.lit(value)) if out is None else out.when(condition, F.lit(value))
    return out


def sample_plan(spark: SparkSession, count: int, base_seed: int = 20240101) -> DataFrame:
    """``count`` rows: ``seed`` and the dimensions of a scenario. A row depends on its seed only."""
    seed = F.col("seed")
    u = lambda name: uniform(seed, name)
    rows = spark.range(count).select((F.col("id") + base_seed).alias("seed"))
    rows = rows.withColumns({"language": choice(u("language"), ("python", "javascript")), "pressure": weighted(u("pressure"), PRESSURE_WEIGHTS), "drawn": weighted(u("turns"), TURN_WEIGHTS)})
    pressure = F.col("pressure")
    later = (F.col("drawn") == 0) & pressure.isin(*LATER)  # pressure that needs a turn before it
    progress = (
        F.when(pressure == "solved", "solved").when(pressure == "almost_correct", "close")
        .when(pressure == "fake_success", choice(u("progress"), ("partial", "close"))).otherwise(choice(u("progress"), ("stuck", "stuck", "partial", "close")))
    )
    rows = rows.withColumns({"turns": F.when(later, choice(u("later"), (1, 2))).otherwise(F.col("drawn")), "progress": progress})
    usual = F.coalesce(*[F.when(F.col("progress") == k, F.lit(v)) for k, v in HINTS.items()])
    category = F.when(F.col("language") == "python", choice(u("category"), CATEGORIES["python"])).otherwise(choice(u("category"), CATEGORIES["javascript"]))
    return rows.select(
        "seed", "language", category.alias("category"), choice(u("difficulty"), DIFFICULTIES).alias("difficulty"), "pressure", F.col("turns").cast("long").alias("turns"),
        choice(u("competence"), COMPETENCE).alias("competence"),
        F.when(pressure.isin("frustrated", "repeated_answer_request"), "high").otherwise(choice(u("frustration"), ("none", "none", "mild"))).alias("frustration"),
        F.when(u("vary") < 0.25, choice(u("hint"), ("nudge", "pointed", "narrow"))).otherwise(usual).alias("hint"), "progress",
    )


@dataclass(frozen=True)
class Spec:
    """A file of criteria: what applies in which state, limits, thresholds of the gate, and the hash of the file's bytes."""

    criteria: tuple[Criterion, ...]
    limits: Limits
    gate: dict[str, float]
    sha256: str

    def table(self, spark: SparkSession) -> DataFrame:
        """``code``, ``state``, ``blocking``, ``weight``, ``scored`` and ``sha256`` of each criterion, in order, as a dimension to join with."""
        rows = [(k, c.code, c.state, c.blocking, c.weight, c.scored, self.sha256) for k, c in enumerate(self.criteria)]
        return spark.createDataFrame(rows, "nth int, code string, state string, blocking boolean, weight double, scored boolean, sha256 string")


def load_spec(spark: SparkSession, path: str) -> Spec:
    """The spec in a JSON file (or YAML, where the yaml package is there): ``criteria`` or ``dimensions``, and if it has them ``limits`` and ``gate``.

    One small file, read from wherever Spark reads; refused if codes repeat, a state is unknown, or a weight is not within 0..1.
    """
    row = spark.read.format("binaryFile").load(path).select("content", F.sha2("content", 256).alias("sha256")).first()
    text = bytes(row["content"]).decode()
    try:
        doc = json.loads(text)
    except ValueError:
        doc = _yaml(path, text)
    return Spec(_criteria(path, doc), Limits(**doc.get("limits", {})), {**GATE, **doc.get("gate", {})}, row["sha256"])


def applied(hits: DataFrame, criteria: DataFrame, solved: str = "solved") -> DataFrame:
    """``hits`` (a row a code found, with the state in ``solved``) that a criterion of the table makes a violation, with ``blocking``, ``weight`` and the
    criterion's place ``nth``: a join on the code and on whether the criterion applies in the state. A null state is unsolved."""
    state = F.when(F.coalesce(F.col(solved), F.lit(False)), "solved").otherwise("unsolved")
    rules = F.broadcast(criteria.select(F.col("code").alias("_code"), F.col("state").alias("_state"), "blocking", "weight", "nth"))  # some ten rows
    return hits.join(rules, (hits["code"] == rules["_code"]) & F.col("_state").isin(F.lit("always"), state)).drop("_code", "_state")


def _yaml(path: str, text: str) -> dict:
    try:
        import yaml
    except ImportError as missing:
        raise ValueError(f"{path}: no JSON, and reading other criteria needs the yaml package") from missing
    return yaml.safe_load(text)


def _criteria(path: str, doc: dict) -> tuple[Criterion, ...]:
    listed = doc.get("criteria") or doc.get("dimensions") or []
    found = tuple(Criterion(c["failure_code"], c["applies_when"], bool(c.get("blocking")), float(c.get("weight", 0)), c.get("kind") == "quality") for c in listed)
    codes = [c.code for c in found]
    if not found or len(set(codes)) < len(codes) or any(c.state not in ("unsolved", "solved", "always") or not 0 <= c.weight <= 1 for c in found):
        raise ValueError(f"{path}: criteria have to have distinct codes, known states and weights within 0..1")
    return found


def load_criteria(path: str) -> tuple[Criterion, ...]:
    """The criteria of a YAML file on the driver; see ``load_spec``."""
    with open(path, encoding="utf-8") as f:
        return _criteria(path, _yaml(path, f.read()))
