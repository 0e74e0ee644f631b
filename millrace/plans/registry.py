"""Registry of the queries over the reference's operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import criteria, verdicts
from millrace.functions.leaks import with_leak_signals
from millrace.functions.text import code_blocks, content_hash, inline_code, is_blank, items_in, length, let, prose, questions_in, tokens, trailing_index, words_in
from millrace.operators import balance, decontaminate, dedupe, gates, metrics, ranking, records, resume, review, select
from millrace.operators.similarity import small
from millrace.plans import curation, curation_sql, oracle, quality_gate, tutoring, views
from millrace.plans.views import table
from millrace.session import BROADCAST_TERMS, checkpointed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Register a query under its name."""
    QUERIES[f.__name__] = f
    return f


# Texts


@query
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First of equal normalised texts."""
    return dedupe.first_of_equal(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", F.col("text")).drop("text")


@query
def dataset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of all documents in whatever order."""
    return records.set_fingerprint(table(spark, sf_dir, "documents"), content_hash(F.col("text")))


@query
def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over each text."""
    t = F.col("text")
    of_prose = let(prose(t), lambda p: F.struct(words_in(p).cast("long").alias("words"), questions_in(p).cast("long").alias("questions"), items_in(p).cast("long").alias("list_items")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", length(t).alias("chars"), of_prose.alias("p"), F.size(code_blocks(t)).cast("long").alias("code_blocks"), F.size(inline_code(t)).cast("long").alias("inline_codes"), F.size(tokens(t)).cast("long").alias("tokens")
    ).select("doc_id", "chars", "p.*", "code_blocks", "inline_codes", "tokens")


@query
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with a Jaccard similarity of 0.72 or more; of equal texts the first stands for all."""
    copies = checkpointed(exact_dedup(spark, sf_dir).where("NOT kept").select("doc_id"))  # few: then texts stay where they are
    firsts = table(spark, sf_dir, "documents").select("doc_id", "text").join(small(copies, BROADCAST_TERMS), "doc_id", "left_anti")
    return dedupe.similar_pairs(dedupe.shingle_sets(firsts, "doc_id", F.col("text")), sample=dedupe.sample_sets(firsts, "doc_id", F.col("text")))


@query
def near_dup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy removal of equal and similar documents."""
    return dedupe.deduplicate(table(spark, sf_dir, "documents"), "doc_id", "text", reread=True).withColumnRenamed("id", "doc_id")


@query
def decontam_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are benchmark items."""
    return decontaminate.exact_overlap(table(spark, sf_dir, "documents").select("doc_id", "text"), views.evaluation(spark, sf_dir), "doc_id").select("doc_id")


@query
def decontam_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents similar to a benchmark item."""
    return decontaminate.near_overlap(table(spark, sf_dir, "documents"), views.evaluation(spark, sf_dir), "doc_id", "item_id")


@query
def decontam_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have all word runs of a benchmark item."""
    return decontaminate.contained(table(spark, sf_dir, "documents"), views.evaluation(spark, sf_dir), "doc_id", "item_id")


# Distributions, balance and selection


@query
def axis_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and shares of the values of two axes."""
    return select.distribution(table(spark, sf_dir, "documents"), ["lang", "source"])


@query
def balance_single_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of each language, up to 30 % of all."""
    return select.cap_axis(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 0.3, [F.col("doc_id")])


@query
def balance_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy balance over three axes."""
    rows = views.records(spark, sf_dir).select(F.col("id").alias("doc_id"), F.col("strategy").alias("lang"), "pressure", F.col("model").alias("source"))
    return balance.greedy_balance(rows, "doc_id", {"lang": 0.5, "pressure": 0.28, "source": 0.1})


@query
def quota_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 documents by language in proportion to the languages' shares, sources taking turns."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    shares = select.distribution(docs, ["lang"]).select(F.col("bucket").alias("lang"), "share")
    quotas = select.largest_remainder(shares, "lang", 200)
    return select.select_balanced(docs, "lang", "source", quotas, [F.sha2(F.col("doc_id").cast("string"), 256)]).select("doc_id", "lang", "source")


@query
def nested_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each document in the order of content, and the subset that it is in first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("h"))
    return select.nested(docs, [F.col("h"), F.col("doc_id")], [125, 250, 500, 1000]).select("doc_id", "rank", F.col("subset").cast("long").alias("subset"))


@query
def train_validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents validates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("h"))
    return select.split(docs, [F.col("h"), F.col("doc_id")]).select("doc_id", "split")


@query
def validation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 records to grade, strata taking turns."""
    rows = metrics.measured(views.records(spark, sf_dir)).select("id", F.coalesce("passed", F.lit(False)).alias("passed"), "family", "strategy", "pressure")
    return review.depth_first_sample(rows, ["passed", "family", "strategy", "pressure"], 40, 20260817, "id").select(F.col("id").alias("doc_id"), "row_id")


@query
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 records by shares of kinds."""
    rows = views.records(spark, sf_dir).select("id", "pressure")
    kind = review.review_kind(F.col("pressure") == "solved", F.col("pressure"))
    return review.quota_sample(rows, kind, 40, 20260818, "id").select(F.col("id").alias("doc_id"), "pressure", "backfilled")


# Metrics


@query
def cell_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each model and strategy."""
    return metrics.cell_metrics(views.records(spark, sf_dir))


@query
def pressure_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by pressure, and their ranking."""
    return metrics.pressure_ranking(views.records(spark, sf_dir))


@query
def category_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by category."""
    return metrics.breakdown(views.records(spark, sf_dir), "category")


@query
def failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each code is given."""
    return metrics.failure_counts(metrics.measured(views.records(spark, sf_dir)))


@query
def failure_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of each code in each group."""
    tracked = spark.createDataFrame([("SOLUTION_LEAK",), ("PREMATURE_CONFIRMATION",)], "code string")
    return metrics.failure_slices(views.records(spark, sf_dir), tracked)


@query
def representative_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least ids of each code."""
    return metrics.representative_ids(views.records(spark, sf_dir)).select("code", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"))


@query
def residual_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures left under two strategies."""
    return metrics.residual(views.records(spark, sf_dir), ("en", "de"))


@query
def best_and_worst_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest cell and the three weakest."""
    cells = metrics.cell_metrics(views.records(spark, sf_dir))
    best, worst = metrics.best_cells(cells), metrics.worst_cells(cells)
    pick = lambda df, kind: df.select(F.lit(kind).alias("kind"), "model", "strategy", "pass_rate")
    return pick(best, "best").unionByName(pick(worst, "worst"))


@query
def base_vs_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of metrics between two strategies."""
    cells = metrics.cell_metrics(views.records(spark, sf_dir), ("strategy",))
    return metrics.deltas(cells, "strategy", "en", "de", ("pass_rate", "adherence_mean", "leak_rate"))


@query
def ceiling_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best cell against the thresholds."""
    rows = gates.ceiling_gate(metrics.cell_metrics(views.records(spark, sf_dir), ("model", "family", "strategy")))
    return rows.withColumn("shortfalls", F.concat_ws(",", "shortfalls")).withColumn("caveats", F.concat_ws(",", "caveats"))


@query
def minimum_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least size of a cell of a model and a strategy that meets the thresholds."""
    return gates.minimum_size(metrics.cell_metrics(views.records(spark, sf_dir)), "scenario_count")


@query
def training_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a training set by the failures under pressure."""
    rates = metrics.pressure_ranking(views.records(spark, sf_dir)).select("pressure", "failure_rate")
    return gates.training_shares(rates, cap=0.5).select("pressure", F.round("share", 9).alias("share"))


@query
def kappa_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two binary labels."""
    rows = metrics.agreement(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 0)
    return rows.withColumn("band", metrics.kappa_band(F.col("kappa")))


@query
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that have ten measured records or more."""
    return metrics.completeness(views.records(spark, sf_dir), 10)


@query
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by user."""
    kind = F.col("event_type")
    calls = views.log(spark, sf_dir).select(
        F.col("user_id").alias("model"), kind, F.when(kind == "click", F.col("k")).alias("a"), F.when(kind.isin("view", "purchase"), F.col("k")).alias("b"), F.when(kind == "purchase", F.floor("value")).alias("o")
    )
    return metrics.usage(calls, "model", ("a", "b"), ("o",), kind == "error")


# Resuming


@query
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type."""
    return resume.last_of(views.log(spark, sf_dir).select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], F.col("ts"), F.col("event_id"))


@query
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type."""
    return resume.first_of(views.log(spark, sf_dir).select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], F.col("ts"), F.col("event_id"))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.log(spark, sf_dir).select(F.col("user_id").alias("c_custkey"), "event_id", "ts", "kind")
    return resume.resume_index(rows, ["c_custkey"], F.col("kind"), F.col("ts"), F.col("event_id"))


@query
def resume_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reusable record of each user, and whether to try again."""
    return _index(spark, sf_dir).select("c_custkey", F.col("reusable.event_id").alias("event_id"), "retry")


@query
def resume_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a reusable record."""
    return resume.done(table(spark, sf_dir, "customer").select("c_custkey"), _index(spark, sf_dir), ["c_custkey"])


@query
def resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without one."""
    return resume.todo(table(spark, sf_dir, "customer").select("c_custkey"), _index(spark, sf_dir), ["c_custkey"])


@query
def pending_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers up to the last document without a label."""
    top = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] or 0
    ids = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return resume.pending(spark.range(top + 1), table(spark, sf_dir, "labels"), trailing_index(ids))


@query
def merge_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First events of users, replaced by their last purchase where there is one."""
    events = views.log(spark, sf_dir).select("user_id", "event_id", "ts", "event_type")
    old = resume.first_of(events, ["user_id"], F.col("ts"), F.col("event_id"))
    fresh = resume.last_of(events.where("event_type = 'purchase'"), ["user_id"], F.col("ts"), F.col("event_id"))
    return resume.merge_fresh(old, fresh, ["user_id"])


@query
def experiment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region and nation with each benchmark item."""
    models = table(spark, sf_dir, "region").select(F.col("r_name").alias("model"))
    strategies = table(spark, sf_dir, "nation").select(F.col("n_name").alias("strategy"))
    return resume.matrix(models, strategies, table(spark, sf_dir, "benchmark").select("item_id"))


# Records and checks


@query
def conversation_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns and problems of each conversation."""
    rows = records.conversations(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", records.user_turns(F.col("messages")).alias("user_turns"), F.concat_ws(",", records.shape_problems(F.col("messages"))).alias("problems"))


@query
def turn_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by their number of user turns."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("user_turns"))
    return turns.groupBy("user_turns").agg(F.count("*").alias("n"))


@query
def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash and text of each conversation as a chat record."""
    rows = records.conversations(table(spark, sf_dir, "conversations"))
    text = records.conversation_text(records.without_system(F.col("messages")))
    return rows.select("conv_id", F.sha2(records.canonical_json(F.col("messages")), 256).alias("json_sha256"), F.sha2(text, 256).alias("text_sha256"), records.system_text(F.col("messages")).alias("system"))


@query
def turn_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static checks of each assistant turn as an unsolved one."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    checks = rows.select("conv_id", "turn", criteria.static_checks(F.col("text"), F.lit(False)).alias("c"))
    violations = F.col("c.violations")
    return checks.select(
        "conv_id", "turn", F.concat_ws(",", violations).alias("violations"), F.concat_ws(",", "c.blocking").alias("blocking"), "c.metrics.words", "c.metrics.questions",
        F.round(criteria.static_adherence(violations, F.lit(False)), 9).alias("adherence"), criteria.static_robustness(F.col("c.blocking"), F.lit("time_pressure")).alias("robustness"),
    )


@query
def judge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as a judge's answers and read back."""
    doc = F.format_string(
        'Verdict:\n```json\n{"spec_adherence": %d, "robustness": "0.%d", "hint_relevance": 7, "pass": %s, "failure_reasons": ["solution leak", "whatever"]}\n```',
        F.col("quality"), F.col("toxic"), (F.col("toxic") == 0).cast("string"),
    )
    rows = table(spark, sf_dir, "labels").select("doc_id", verdicts.verdict(doc).alias("v"))
    return rows.select("doc_id", "v.spec_adherence", "v.robustness", "v.hint_relevance", "v.passed", F.concat_ws(",", "v.failure_reasons").alias("reasons"))


@query
def combined_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static checks and labels combined into a verdict on each document."""
    none = F.array().cast("array<string>")
    # checked where the texts are read, so that they do not move to the labels
    checked = table(spark, sf_dir, "documents").select("doc_id", criteria.static_codes(F.col("text"), F.lit(False)).alias("c"))
    rows = checked.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    passed, reasons = F.col("quality") == 1, F.when(F.col("toxic") == 1, F.array(F.lit("SOLUTION_LEAK"))).otherwise(none)
    blocking = F.array(*[F.lit(c.code) for c in criteria.CRITERIA if c.blocking and c.state != "solved"])
    both = verdicts.combined(F.lit(None).cast("string"), F.col("c.violations"), F.col("c.blocking"), passed, F.col("quality").cast("double"), reasons, blocking)
    return rows.select("doc_id", both.alias("b")).select("doc_id", "b.passed", F.concat_ws(",", "b.failure_reasons").alias("reasons"))


@query
def solution_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns that give away what the user wrote just before."""
    before = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("fix", F.lag("text").over(before)).withColumn("code", F.lag("text", 2).over(before))
    rows = with_leak_signals(rows.where("role = 'assistant'"), F.col("text"), F.col("fix"), F.col("code"))
    return rows.select("conv_id", "turn", F.col("leak.leaked").alias("leaks"))


# The gate


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.labelled(spark, sf_dir).select("doc_id", "text", "lang", "n_chars", "quality", "toxic")
    none = F.array().cast("array<string>")
    size = F.when(~length(F.col("text")).between(25, 16000) | is_blank(F.col("text")), F.array(F.lit("LOW_QUALITY"))).otherwise(none)
    static = F.concat(size, criteria.static_codes(F.col("text"), F.lit(False))["blocking"])
    reasons = F.when(F.col("toxic") == 1, F.array(F.lit("SOLUTION_LEAK"))).otherwise(none)
    passed = (F.col("quality") == 1) & (F.col("toxic") == 0)
    judge = criteria.judge_codes(reasons, F.col("quality").cast("double"), F.least(F.lit(1.0), F.col("n_chars") / 64), (1 - F.col("toxic")).cast("double"), passed, F.lit("normal"))
    gate = quality_gate.Gate(static, judge, F.col("quality").isNull(), {"lang": 0.5})
    return quality_gate.run(rows, views.evaluation(spark, sf_dir), gate, "doc_id", "text", "item_id")


@query
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, stage and codes of each document."""
    return _gated(spark, sf_dir).select("doc_id", "status", "stage", F.concat_ws(",", "codes").alias("codes"))


@query
def gate_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the stage that decided."""
    return quality_gate.funnel(_gated(spark, sf_dir))


@query
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status and the acceptance rate."""
    return quality_gate.report(_gated(spark, sf_dir))


@query
def global_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each event of a user by time."""
    return ranking.with_rank(views.log(spark, sf_dir).select("event_id", "user_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("event_id", "user_id", "rank")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that a smoke test runs."""
    return gate_funnel(spark, sf_dir)


def queries() -> dict[str, Query]:
    return QUERIES | curation.queries() | tutoring.queries()


def oracle_sql() -> dict[str, str]:
    return oracle.sql() | curation_sql.sql() | tutoring.sql()
