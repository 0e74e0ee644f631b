"""Independent checks of a dataset and of reports about it: audits, status, drift, nesting and recomputed metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import content_hash, is_blank
from millrace.operators.decontaminate import exact_overlap, near_overlap
from millrace.operators.dedupe import deduplicate, first_of_equal
from millrace.operators.review import ANSWER_SEEKING, INJECTION_AUTHORITY
from millrace.operators.select import distribution
from millrace.session import checkpointed

# Names of the pipeline's own fields and codes, which no model should see.
MARKERS = (
    "judge_spec_adherence", "judge_hint_relevance", "judge_robustness", "automatic_pass", "human_pass", "failure_reasons", "SOLUTION_LEAK",
    "PREMATURE_CONFIRMATION", "WITHHELD_AFTER_SOLVED", "EXPLICIT_FINAL_DIAGNOSIS", "dataset_version", "teacher_model",
)
MAX_SYSTEM_CHARS, MIN_CEILING = 400, 30


def _line(df: DataFrame, section: str, key: str | Column, n: Column, share: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), (F.lit(key) if isinstance(key, str) else key).alias("key"), n.cast("long").alias("n"), share.cast("double").alias("share"))


def dataset_audit(rows: DataFrame, evaluation: DataFrame, axes: list[str], id_col: str, text_col: str, eval_id: str) -> DataFrame:
    """``section``, ``key``, ``n`` and ``share`` of what a dataset holds.

    ``rows`` has status (accepted, rejected, unjudged), codes, pressure, the axes and the texts. Duplicates and overlaps are
    looked for anew among the accepted rows, whatever the gate said. Shares are of the accepted rows, those of counts and
    rejections of all.
    """
    n = F.count("*")
    total = rows.count()
    whole = F.nullif(F.lit(float(total)), F.lit(0.0))
    accepted = rows.where("status = 'accepted'")
    kept = accepted.count()
    of = lambda c: c / F.nullif(F.lit(float(kept)), F.lit(0.0))
    counts = _line(rows.groupBy("status").agg(n.alias("n")), "counts", F.col("status"), F.col("n"), F.col("n") / whole)
    shares = distribution(accepted, axes)
    parts = [counts, _line(shares, "distribution", F.concat_ws("=", "axis", F.coalesce("bucket", F.lit(""))), F.col("n"), F.col("share"))]
    seeking, injected = F.count_if(F.col("pressure").isin(*ANSWER_SEEKING)), F.count_if(F.col("pressure").isin(*INJECTION_AUTHORITY))
    coverage = accepted.agg(seeking.alias("a"), injected.alias("b"))
    parts += [_line(coverage, "coverage", "answer_seeking", F.col("a"), of(F.col("a"))), _line(coverage, "coverage", "injection_or_authority", F.col("b"), of(F.col("b")))]
    codes = rows.where("status = 'rejected'").select(F.explode("codes").alias("code")).groupBy("code").agg(n.alias("n"))
    parts.append(_line(codes, "rejections", F.col("code"), F.col("n"), F.col("n") / whole))
    texts = accepted.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = first_of_equal(texts, "id", F.col("text")).select("id", F.col("kept").alias("first"))
    marks = marks.join(deduplicate(texts, "id", "text"), "id")
    twice = checkpointed(marks.agg(F.count_if(~F.col("first")).alias("a"), F.count_if(F.col("first") & ~F.col("kept")).alias("b"), F.count_if("first").alias("c")))
    for key, name in (("exact_duplicates", "a"), ("near_duplicates", "b"), ("distinct_texts", "c")):
        parts.append(_line(twice, "diversity", key, F.col(name), of(F.col(name))))
    exact = exact_overlap(texts, evaluation, "id", "text").agg(n.alias("n"))
    near = near_overlap(texts, evaluation, "id", eval_id, "text").agg(n.alias("n"))
    parts += [_line(exact, "contamination", "exact_overlaps", F.col("n"), of(F.col("n"))), _line(near, "contamination", "near_overlaps", F.col("n"), of(F.col("n")))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def reclassified(rows: DataFrame, unavailable: Column) -> DataFrame:
    """Rejected rows whose judge could not be reached wait for one instead: status unjudged, no codes."""
    moved = (F.col("status") == "rejected") & F.coalesce(unavailable, F.lit(False))
    return rows.withColumns({"status": F.when(moved, "unjudged").otherwise(F.col("status")), "codes": F.when(moved, F.array().cast("array<string>")).otherwise(F.col("codes"))})


def gate_status(rows: DataFrame) -> DataFrame:
    """One row: counts by status, whether all are judged, the acceptance rate of the judged rows, and whether the counts
    add up to the rows."""
    counts = rows.agg(F.count("*").alias("candidates"), *[F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "rejected", "unjudged")])
    judged = F.col("candidates") - F.col("unjudged")
    return counts.select(
        "*", judged.alias("judged"), (F.col("unjudged") == 0).alias("complete"), F.round(F.coalesce(F.try_divide(F.col("accepted").cast("double"), judged.cast("double")), F.lit(0.0)), 4).alias("acceptance_rate"),
        (F.col("accepted") + F.col("rejected") + F.col("unjudged") == F.col("candidates")).alias("conserved"),
    )


def subset_drift(ranked: DataFrame, axis: str, sizes: list[int], rank: str = "rank") -> DataFrame:
    """``subset``, ``bucket``, ``share``, ``full_share``, ``drift`` and the subset's largest drift ``max_drift``, in one pass.

    A subset of n has the rows with a rank up to n; a bucket that it lacks has share 0.
    """
    counts = ranked.groupBy(F.col(axis).alias("bucket")).agg(F.count("*").alias("full"), *[F.count_if(F.col(rank) <= n).alias(f"n{n}") for n in sizes])
    each = counts.select("bucket", "full", F.inline(F.array(*[F.struct(F.lit(n).cast("long").alias("subset"), F.col(f"n{n}").alias("n")) for n in sizes])))
    of = Window.partitionBy("subset")  # one row a bucket
    share, full = F.col("n") / F.nullif(F.sum("n").over(of), F.lit(0)), F.col("full") / F.sum("full").over(of)
    rows = each.select("subset", "bucket", share.alias("share"), full.alias("full_share")).withColumn("drift", F.col("share") - F.col("full_share"))
    return rows.withColumn("max_drift", F.max(F.abs("drift")).over(of))


def nesting_checks(members: DataFrame, sizes: list[int]) -> DataFrame:
    """``smaller``, ``larger``, ``is_subset`` and ``is_prefix`` of each two neighbouring subsets of ``members`` (subset, id, place)."""
    after = dict(zip(sorted(sizes), sorted(sizes)[1:], strict=False))
    small = members.where(F.col("subset").isin(*after)).withColumn("larger", F.coalesce(*[F.when(F.col("subset") == a, F.lit(b).cast("long")) for a, b in after.items()]))
    large = members.select(F.col("subset").alias("larger"), "id", F.col("place").alias("there"))
    found = small.join(large, ["larger", "id"], "left")
    checks = found.groupBy(F.col("subset").alias("smaller"), "larger").agg(F.bool_and(F.col("there").isNotNull()).alias("is_subset"), F.bool_and(F.coalesce(F.col("there") == F.col("place"), F.lit(False))).alias("is_prefix"))
    return checks


def training_checks(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``check``, ``passed`` and ``bad`` (conversations or messages that break it) over the chat records of a training set.

    Conversations are looked at by aggregates over their turns; none is gathered.
    """
    text, at = F.coalesce("text", F.lit("")), F.col(turn)
    leak = F.lit(False)
    for marker in MARKERS:
        leak |= F.contains(text, F.lit(marker))
    each = turns.groupBy(conv).agg(
        F.count("*").alias("n"), F.min_by("role", at).alias("first"), F.max_by("role", at).alias("last"), F.min_by(text, at).alias("system"),
        F.count_if(~F.coalesce(F.col("role").isin("system", "user", "assistant"), F.lit(False))).alias("strange"), F.count_if(is_blank(F.col("text"))).alias("blank"), F.count_if(leak).alias("leaks"),
    )
    counts = checkpointed(
        each.agg(
            F.count_if(F.expr("n < 3")).alias("record_shape"),
            F.count_if(~F.coalesce((F.col("first") == "system") & (F.col("last") == "assistant"), F.lit(False))).alias("role_order"),
            F.coalesce(F.sum("strange"), F.lit(0)).alias("roles_known"),
            F.count_if(F.expr("blank > 0")).alias("no_empty_messages"),
            F.greatest(F.count_distinct("system") - 1, F.lit(0)).alias("single_system_prompt"),
            F.count_if(F.length("system") > MAX_SYSTEM_CHARS).alias("weak_prompt"),
            F.coalesce(F.sum("leaks"), F.lit(0)).alias("no_metadata_leak"),
        )
    )
    lines = F.array(*[F.struct(F.lit(c).alias("check"), (F.col(c) == 0).alias("passed"), F.col(c).cast("long").alias("bad")) for c in counts.columns])
    return counts.select(F.inline(lines))


def metric_differences(published: DataFrame, recomputed: DataFrame, keys: list[str], metric: str, tolerance: float = 1e-4) -> DataFrame:
    """``keys``, ``published``, ``recomputed`` and ``matches`` of each cell that either table has."""
    both = published.select(*keys, F.col(metric).alias("published")).join(recomputed.select(*keys, F.col(metric).alias("recomputed")), keys, "full")
    return both.withColumn("matches", F.coalesce(F.abs(F.col("published") - F.col("recomputed")) <= tolerance, F.lit(False)))


def scenario_invariants(scenarios: DataFrame, id_col: str, split: Column, *parts: Column) -> DataFrame:
    """One row: ids that repeat, texts that held-out rows share with others, rows that are not held out, and whether the
    set is ``sound``: neither of the former, and enough of the latter."""
    rows = scenarios.select(F.col(id_col).alias("id"), (split == "heldout").alias("out"), content_hash(*parts).alias("h"))
    ids = rows.groupBy("id").count().agg(F.count_if(F.expr("count > 1")).alias("repeated_ids"))
    shared = rows.groupBy("h").agg(F.bool_or("out").alias("a"), F.bool_or(~F.col("out")).alias("b")).agg(F.count_if(F.expr("a AND b")).alias("shared_texts"))
    size = rows.agg(F.count_if(~F.col("out")).alias("ceiling_rows"))
    one = ids.join(F.broadcast(shared)).join(F.broadcast(size))  # one row each
    return one.withColumn("sound", (F.col("repeated_ids") == 0) & (F.col("shared_texts") == 0) & (F.col("ceiling_rows") >= MIN_CEILING))


def config_problems(prior: DataFrame, now: DataFrame, keys: DataFrame | tuple[str, ...] = ("base_seed", "generation_prompt_sha256", "dataset_version")) -> DataFrame:
    """``key``, ``prior`` and ``now`` of settings (tables of key and value) that both runs have and that differ; ``keys``, names or a table of
    them (column key), says which settings matter."""
    chosen = (lambda df: df.where(F.col("key").isin(*keys))) if isinstance(keys, tuple) else (lambda df: df.join(keys.select("key"), "key", "left_semi"))
    one = lambda df, name: chosen(df).select("key", F.col("value").alias(name))
    return one(prior, "prior").join(one(now, "now"), "key").where(~F.col("prior").eqNullSafe(F.col("now")))


def version_status(reports: DataFrame, freezes: DataFrame, rejections: DataFrame, top: int = 5) -> DataFrame:
    """One row per dataset version: the frozen hash where there is one, else that of the accepted pool, and its most frequent
    rejections. ``rejections`` has version, code and n."""
    place = F.row_number().over(Window.partitionBy("version").orderBy(F.desc("n"), "code"))  # codes are few
    named = F.transform(F.array_sort(F.collect_list(F.struct("place", "code", "n"))), lambda x: F.concat_ws("=", x["code"], x["n"].cast("string")))
    most = rejections.withColumn("place", place).where(F.col("place") <= top).groupBy("version").agg(F.array_join(named, ";").alias("top_rejections"))
    joined = reports.join(freezes.select("version", F.col("hash").alias("frozen_hash"), "selected_count"), "version", "left").join(most, "version", "left")
    return joined.select(
        "version", F.coalesce("frozen_hash", "hash").alias("dataset_hash"), F.col("frozen_hash").isNotNull().alias("frozen"), "selected_count", F.col("hash").alias("accepted_pool_hash"),
        "candidate_count", "accepted_count", F.coalesce("top_rejections", F.lit("")).alias("top_rejections"),
    )


def profile(df: DataFrame, axes: dict[str, Column], distinct: dict[str, Column]) -> DataFrame:
    """``axis``, ``bucket`` (as text), ``n``, ``share`` and a number of different values for each of ``distinct``, of every value of every axis, and of
    all rows (axis ``all``, bucket null): grouping sets, so that the table is read once however many axes there are.

    Null values are a bucket. An empty table gives an empty one.
    """
    rows = df.select(*[c.cast("string").alias(f"a{k}") for k, c in enumerate(axes.values())], *[c.alias(f"d{k}") for k, c in enumerate(distinct.values())])
    names = [f"a{k}" for k in range(len(axes))]
    grouped = rows.groupingSets([[F.col(n)] for n in names] + [[]], *map(F.col, names))
    counted = grouped.agg(
        F.coalesce(*[F.when(F.grouping(n) == 0, F.lit(axis)) for n, axis in zip(names, axes, strict=True)], F.lit("all")).alias("axis"), F.coalesce(*names).alias("bucket"),
        F.count("*").alias("n"), *[F.count_distinct(f"d{k}").alias(name) for k, name in enumerate(distinct)],
    )
    counted = checkpointed(counted.select("axis", "bucket", "n", *distinct))  # a row a bucket: the total is looked up without reading the table again
    total = counted.where("axis = 'all'").select(F.col("n").alias("_total"))
    return counted.join(F.broadcast(total)).withColumn("share", F.try_divide(F.col("n").cast("double"), F.col("_total").cast("double"))).drop("_total")


def provenance(df: DataFrame, fields: list[str], *order: Column) -> DataFrame:
    """``field``, ``first`` (of the first row by ``order``, as text) and ``different`` (values of it, null not counted): where a dataset comes from,
    and whether that holds for all of it."""
    first = F.min_by(F.struct(*[F.col(f).cast("string").alias(f) for f in fields]), F.struct(*order)).alias("first")
    row = df.agg(first, *[F.count_distinct(f).alias(f"n_{f}") for f in fields])
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"first.{f}").alias("first"), F.col(f"n_{f}").alias("different")) for f in fields])).alias("x")).select("x.*")
