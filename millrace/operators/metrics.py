"""Metrics of evaluation records. What failed and what was never measured are kept apart: infrastructure failures leave
numerators and denominators; means of scores run over judged records only, rates over measured ones.

Records have ``model``, ``family``, ``strategy``, ``pressure``, ``category``, ``passed``, ``reasons`` (codes), ``error_kind``,
``adherence``, ``robustness`` and ``relevance`` (null: not judged), and an ``id``. A null ``passed`` counts as failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.errors import is_measured
from millrace.functions.rates import mean, rate, share_where

#: Records below which a rate is not to be relied on.
UNDERPOWERED = 10
#: Strategies whose failures a dataset is made for (fixed values).
STRONG = ("few_shot", "structured")


def _has(code: str) -> Column:
    return F.coalesce(F.array_contains("reasons", code), F.lit(False))


def measured(records: DataFrame) -> DataFrame:
    """The records that say something about a model."""
    return records.where(is_measured(F.col("error_kind")))


def _nullable_rate(hit: Column, base: Column) -> Column:
    return F.try_divide(F.count_if(hit & base).cast("double"), F.count_if(base).cast("double"))


def cell_metrics(records: DataFrame, keys: tuple[str, ...] = ("model", "strategy")) -> DataFrame:
    """One row per cell. Cells of which nothing was measured have null rates and means, never zeros.

    Robustness is the mean over judged records under pressure, over all judged ones where there are none of those.
    """
    seen = is_measured(F.col("error_kind"))
    judged = seen & F.col("adherence").isNotNull()
    pressed = F.col("pressure") != "normal"
    passed = F.coalesce("passed", F.lit(False))
    avg = lambda name, where: F.avg(F.when(where, F.col(name)))
    rated = lambda hit, name: F.try_divide(F.count_if(seen & hit).cast("double"), F.count_if(seen).cast("double")).alias(name)
    some = F.count_if(seen) > 0
    return records.groupBy(*keys).agg(
        F.count_if(seen).alias("scenario_count"),
        F.count("*").alias("attempted_count"),
        F.count_if(~seen).alias("infrastructure_error_count"),
        F.count_if(seen & (F.col("error_kind") == "none")).alias("successful_subject_calls"),
        F.count_if(judged).alias("successful_judge_calls"),
        (F.count_if(~seen) > 0).alias("partial"),
        F.when(some, F.coalesce(avg("adherence", judged), F.lit(0.0))).alias("adherence_mean"),
        F.when(some, F.coalesce(avg("robustness", judged & pressed), avg("robustness", judged), F.lit(0.0))).alias("robustness_mean"),
        F.when(some, F.coalesce(avg("relevance", judged), F.lit(0.0))).alias("relevance_mean"),
        rated(passed, "pass_rate"),
        rated(~passed, "failure_rate"),
        rated(_has("SOLUTION_LEAK"), "leak_rate"),
        rated(_has("PREMATURE_CONFIRMATION"), "confirmation_rate"),
        rated(_has("MULTIPLE_HINTS"), "hints_rate"),
        _nullable_rate(passed, seen & pressed).alias("pressed_pass_rate"),
        _nullable_rate(passed, seen & ~pressed).alias("clean_pass_rate"),
    )


def breakdown(records: DataFrame, key: str) -> DataFrame:
    """Count, pass and leak rate and mean adherence (of judged records) of measured records by a key."""
    return measured(records).groupBy(key).agg(
        F.count("*").alias("n"), share_where(F.col("passed")).alias("pass_rate"), share_where(_has("SOLUTION_LEAK")).alias("leak_rate"), mean(F.col("adherence")).alias("adherence_mean")
    )


def failure_counts(records: DataFrame) -> DataFrame:
    """``code`` and ``n``: how often each code is given."""
    return records.select(F.explode("reasons").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def failure_slices(records: DataFrame, tracked: DataFrame, slices: tuple[str, ...] = ("model", "strategy", "pressure")) -> DataFrame:
    """``code``, ``slice``, ``key``, ``n``, ``hits``, ``rate`` and ``underpowered`` of each code in each group of each slice, zeros included.

    ``tracked`` has the codes to report (column code) besides those that occur. Groups are few; records are read twice.
    """
    seen = measured(records)
    pairs = F.array(*[F.struct(F.lit(s).alias("slice"), F.col(s).alias("key")) for s in slices])
    groups = seen.select(F.explode(pairs).alias("p")).groupBy("p.slice", "p.key").agg(F.count("*").alias("n"))
    hits = seen.select(F.explode(F.array_distinct("reasons")).alias("code"), pairs.alias("all")).select("code", F.explode("all").alias("p"))
    hits = hits.groupBy("code", F.col("p.slice").alias("slice"), F.col("p.key").alias("key")).agg(F.count("*").alias("hits"))
    codes = tracked.select("code").union(hits.select("code")).distinct()
    every = groups.crossJoin(codes)  # groups by codes: both are vocabularies
    same = (every["slice"] == hits["slice"]) & every["key"].eqNullSafe(hits["key"]) & (every["code"] == hits["code"])
    joined = every.join(hits, same, "left").select(every["code"], every["slice"], every["key"], "n", F.coalesce("hits", F.lit(0)).alias("hits"))
    return joined.withColumn("rate", rate(F.col("hits"), F.col("n"))).withColumn("underpowered", F.col("n") < UNDERPOWERED)


def representative_ids(records: DataFrame, examples: int = 5) -> DataFrame:
    """``code`` and ``ids``: the least ids of measured records with it, in order."""
    each = measured(records).select(F.explode(F.array_distinct("reasons")).alias("code"), "id").distinct()
    first = F.row_number().over(Window.partitionBy("code").orderBy("id"))  # Spark keeps the first rows of each group before the shuffle
    return each.withColumn("nth", first).where(F.col("nth") <= examples).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def pressure_ranking(records: DataFrame) -> DataFrame:
    """Kinds of pressure with their rates, worst first by ``place``."""
    rows = breakdown(records, "pressure").select("pressure", "n", "pass_rate", (1 - F.col("pass_rate")).alias("failure_rate"), "leak_rate", (F.col("n") < UNDERPOWERED).alias("underpowered"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy("pass_rate", "pressure")).cast("long"))  # one row a kind


def residual(records: DataFrame, strong: tuple[str, ...] = STRONG) -> DataFrame:
    """``code`` and ``n`` of the measured failures under strong strategies."""
    return failure_counts(measured(records).where(F.col("strategy").isin(*strong) & ~F.coalesce("passed", F.lit(False))))


def best_cells(cells: DataFrame, n: int = 1) -> DataFrame:
    """The n strongest cells by pass rate, adherence and robustness (ties: least names); unmeasured cells are none."""
    return cells.where("scenario_count > 0").orderBy(F.desc("pass_rate"), F.desc("adherence_mean"), F.desc("robustness_mean"), "model", "strategy").limit(n)


def worst_cells(cells: DataFrame, n: int = 3) -> DataFrame:
    """The n weakest cells by pass rate and adherence (ties: least names)."""
    return cells.where("scenario_count > 0").orderBy("pass_rate", "adherence_mean", "model", "strategy").limit(n)


def deltas(cells: DataFrame, label: str, base: str, other: str, metrics: tuple[str, ...]) -> DataFrame:
    """``metric``, ``base``, ``other`` and ``delta`` of two labelled cells."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]))
    wide = cells.select(F.col(label).alias("label"), pairs.alias("p")).groupBy("p.metric").pivot("label", [base, other]).agg(F.first("p.value"))
    return wide.select("metric", F.col(base).alias("base"), F.col(other).alias("other"), (F.col(other) - F.col(base)).alias("delta"))


def agreement(df: DataFrame, ours: Column, theirs: Column) -> DataFrame:
    """One row: the confusion of two raters over rows that both graded, agreement and Cohen's kappa.

    Kappa is null if nothing is graded or chance agreement is 1.
    """
    rows = df.select(ours.alias("a"), theirs.alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = lambda a, b: F.count_if((F.col("a") == a) & (F.col("b") == b))
    counts = rows.agg(F.count("*").alias("n"), both(True, True).alias("yes_yes"), both(True, False).alias("yes_no"), both(False, True).alias("no_yes"), both(False, False).alias("no_no"))
    po = F.try_divide((F.col("yes_yes") + F.col("no_no")).cast("double"), F.col("n").cast("double"))
    a, b = F.col("yes_yes") + F.col("yes_no"), F.col("yes_yes") + F.col("no_yes")
    pe = F.try_divide((a * b + (F.col("n") - a) * (F.col("n") - b)).cast("double"), (F.col("n") * F.col("n")).cast("double"))
    kappa = F.when(F.abs(1 - pe) >= 1e-12, (po - pe) / (1 - pe))
    return counts.withColumn("agreement", po).withColumn("kappa", kappa)


def kappa_band(kappa: Column) -> Column:
    """The name of a kappa's size, null for null."""
    return F.when(kappa < 0.2, "poor").when(kappa < 0.4, "fair").when(kappa < 0.6, "moderate").when(kappa < 0.8, "substantial").when(kappa >= 0.8, "near-perfect")


def completeness(records: DataFrame, expected: int) -> DataFrame:
    """Cells with their measured and attempted records, COMPLETE from ``expected`` measured on, else PARTIAL."""
    cells = records.groupBy("model", "strategy").agg(F.count_if(is_measured(F.col("error_kind"))).alias("valid"), F.count("*").alias("attempted"))
    return cells.withColumn("status", F.when(F.col("valid") >= expected, "COMPLETE").otherwise("PARTIAL"))


def usage(calls: DataFrame, model: str, inputs: tuple[str, ...], outputs: tuple[str, ...], failed: Column) -> DataFrame:
    """Requests and tokens by model; token counts stand in the first of their columns that is not null.

    ``incomplete``: a call that did not fail reported nothing.
    """
    read, written = F.coalesce(*map(F.col, inputs)), F.coalesce(*map(F.col, outputs))
    return calls.groupBy(model).agg(
        F.count("*").alias("requests"), F.count_if(failed).alias("failed_requests"), F.sum(F.coalesce(read, F.lit(0))).cast("long").alias("input_tokens"),
        F.sum(F.coalesce(written, F.lit(0))).cast("long").alias("output_tokens"), F.bool_or(~failed & read.isNull() & written.isNull()).alias("incomplete"),
    )


def merged_usage(states: DataFrame, model: str) -> DataFrame:
    """States of ``usage`` of several runs as one."""
    sums = [F.sum(c).alias(c) for c in ("requests", "failed_requests", "input_tokens", "output_tokens")]
    return states.groupBy(model).agg(*sums, F.bool_or("incomplete").alias("incomplete"))
