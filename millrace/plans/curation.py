"""Queries over candidates, judges, audits and reports, each over whole tables; their SQL is in ``curation_sql``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import criteria, judging
from millrace.functions.text import code_without_comments, code_words, content_hash, grade, length
from millrace.operators import audit, decontaminate, evaluate, gates, metrics, permutation, ranking, records, resume, review, select
from millrace.plans import views
from millrace.plans.views import table
from millrace.session import shared_folder
from millrace.sources import jsonl, plan, seeded, versions
from millrace.streaming import journal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SIZES = [125, 250, 500, 1000]


def query(f: Query) -> Query:
    """Register a query under its name."""
    QUERIES[f.__name__] = f
    return f


def _codes(c: str | Column) -> Column:
    return F.concat_ws(",", c)


# Candidates


@query
def candidate_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What makes an assistant turn unusable as a candidate."""
    rows = views.turn_candidates(spark, sf_dir)
    codes = evaluate.candidate_integrity(rows, F.lit(None).cast("boolean"))
    return rows.select("conv_id", "turn", _codes(codes).alias("codes"))


@query
def static_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All codes that keep an assistant turn out of training data."""
    rows = views.turn_candidates(spark, sf_dir)
    integrity = evaluate.candidate_integrity(rows, F.lit(None).cast("boolean"))
    return rows.select("conv_id", "turn", _codes(evaluate.static_screen(F.col("response"), F.lit(False), integrity)).alias("codes"))


@query
def identity_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes that identify a scenario, a candidate and a verdict."""
    rows = views.turn_candidates(spark, sf_dir).withColumn("scenario", records.scenario_hash(F.col("code"), F.col("message"), F.col("history")))
    return rows.select("conv_id", "turn", "scenario", records.candidate_hash(F.col("scenario"), F.col("response")).alias("candidate"), records.verdict_key(F.col("scenario"), F.col("response")).alias("verdict"))


@query
def code_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each text as code without comments and white space, and its different words."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", length(code_without_comments(t)).alias("bare_chars"), F.size(code_words(t)).cast("long").alias("words"), F.sha2(code_without_comments(t), 256).alias("bare_sha256"))


@query
def training_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn as a chat record with a system prompt, the code fenced in the first user turn."""
    rows = views.turn_candidates(spark, sf_dir)
    said = records.rendered_conversation(F.col("history"), F.col("message"), F.col("code"), F.col("language"))
    record = records.chat_record(F.lit("Help without telling."), said, F.col("response"))
    return rows.select("conv_id", "turn", F.size(record).cast("long").alias("messages"), F.sha2(records.conversation_text(record), 256).alias("text_sha256"))


@query
def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of what a judge is asked about each assistant turn."""
    rows = views.turn_candidates(spark, sf_dir)
    text = judging.prompt("CONVERSATION\n{told}\n\nMESSAGE\n{message}\n\nRESPONSE\n{response}\n", told=judging.dialogue(F.col("history")), message=F.col("message"), response=F.col("response"))
    return rows.select("conv_id", "turn", F.sha2(text, 256).alias("prompt_sha256"))


@query
def built_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads made of assistant turns, parsed back into candidates; some lack a field or a turn."""
    rows = views.turn_candidates(spark, sf_dir)
    fenced = F.concat(F.lit(" ```python\n"), F.regexp_replace("code", "`", ""), F.lit("\n```"))
    fields = [F.when(F.col("code") != "", fenced).alias("code"), F.col("message").alias("student_message"), F.lit(" a bug ").alias("expected_bug"), F.when(F.col("turn") != 5, "a fix").alias("expected_fix"), F.col("response").alias("tutor_response"), F.col("history").alias("conversation_history")]
    made = evaluate.built(rows.withColumn("payload", F.to_json(F.struct(*fields))), F.col("payload"), F.floor(F.col("turn") / 2).cast("int"))
    return made.select("conv_id", "turn", _codes("problems").alias("problems"), F.sha2("candidate.code", 256).alias("code_sha256"), F.col("candidate.expected_bug").alias("bug"))


@query
def malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as JSON lines, a file for each thousand of them, with comments, blank and torn lines; where the torn ones stand."""
    key, line = F.col("c_custkey"), F.to_json(F.struct("c_custkey", "c_name"))
    lines = F.when(key % 7 == 3, F.array(F.lit("// a comment"), F.lit(""), line)).when(key % 11 == 5, F.array(F.substring(line, 1, 9))).otherwise(F.array(line))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.floor(key / 1000).alias("part"), F.posexplode(lines).alias("place", "value"))
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    rows.repartition("part").sortWithinPartitions("part", "c_custkey", "place").select("part", "value").write.partitionBy("part").text(folder)
    found = jsonl.read_numbered(spark, folder, "c_custkey long, c_name string").where("_corrupt IS NOT NULL")
    return found.select(F.regexp_extract("_file", "part=([0-9]+)", 1).cast("long").alias("part"), F.col("_line").cast("long").alias("line"), F.col("_corrupt").alias("torn"))


# Judges


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    score = F.when(F.col("conv_id") % 3 == 0, "0.5").when(F.col("conv_id") % 3 == 1, "0.95").otherwise('"1.5"')
    answer = F.concat(F.lit('{"spec_adherence": '), score, F.lit(', "robustness": 1, "hint_relevance": "x", "pass": '), F.when(F.col("turn") == 3, "1").otherwise("true"), F.lit(', "failure_reasons": ["low quality", "odd one"]}'))
    return rows.select("conv_id", "turn", "text", F.when(F.col("conv_id") % 5 != 4, answer).alias("answer"), F.when(F.col("turn") == 5, "upstream error 503").alias("error"))


@query
def evaluated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static checks, the judge's answer and the provider's error of each assistant turn as one verdict."""
    out = evaluate.evaluated(_answers(spark, sf_dir), F.col("text"), F.lit(False), F.col("answer"), F.col("error"))
    return out.select("conv_id", "turn", "passed", _codes("failure_reasons").alias("reasons"), "error_kind", evaluate.unjudged(F.col("warnings")).alias("unjudged"))


@query
def judge_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What had to be put right in the judges' answers."""
    return _answers(spark, sf_dir).select("conv_id", "turn", F.concat_ws("; ", judging.answer_warnings(F.col("answer"))).alias("warnings"))


@query
def static_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an assistant turn has to do with the turn that stands for the code."""
    return views.turn_candidates(spark, sf_dir).select("conv_id", "turn", judging.static_relevance(F.col("response"), F.col("code")).alias("relevance"))


@query
def judge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge's family of each record, and whether it judged its own."""
    model = F.when(F.col("strategy") == "en", F.concat("family", F.lit(":large"))).when(F.col("strategy") == "fr", "deterministic-1").otherwise("other")
    rows = views.records(spark, sf_dir).withColumn("judge", F.when(F.col("adherence").isNotNull(), model))
    family = judging.judge_family(F.when(F.col("judge").isNotNull() & (F.col("strategy") == "de"), "src1"), F.col("judge"))
    return rows.withColumn("judge_family", family).select("id", F.coalesce("judge", F.lit("unknown")).alias("judge_model"), "judge_family", F.coalesce(judging.self_judged(F.col("judge_family"), F.col("family")).cast("string"), F.lit("unknown")).alias("self_judged"))


@query
def real_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of models that are no test doubles, counted by pressure."""
    model = F.when(F.col("strategy") == "fr", F.concat(F.lit("Mock:"), F.col("model"))).otherwise(F.col("model"))
    return views.records(spark, sf_dir).where(~judging.is_mock(model)).groupBy("pressure").agg(F.count("*").alias("n"))


@query
def error_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on errors, made of the types of events."""
    kind = F.col("event_type")
    error = F.when(kind == "error", F.concat(F.lit("Error code: 429 rate_limit exceeded for "), F.col("user_id").cast("string"))).when(kind == "signup", "CONNECTION RESET by peer").when(kind == "purchase", "Billing hard limit").when(kind == "view", "odd")
    return table(spark, sf_dir, "events").select(judging.diagnosis(error).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query
def cached_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the verdict on the first labelled document of the same text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("key"))
    cache = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("key", "quality", "doc_id")
    return resume.with_cached(docs, cache, "key", "quality", F.col("doc_id")).select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query
def graded_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of labels with a grader's spellings, some of which are no grade."""
    odd = F.col("doc_id") % 3 == 0
    label = F.when(F.col("toxic") == 0, F.when(F.col("doc_id") % 2 == 0, "Yes").otherwise(" pass")).otherwise(F.when(odd, "maybe").otherwise("FAIL"))
    return metrics.agreement(table(spark, sf_dir, "labels"), F.col("quality") == 1, grade(label))


# Audits and reports


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = F.col("passed")
    status = F.when(passed, "accepted").when(passed.isNull(), "unjudged").otherwise("rejected")
    return views.records(spark, sf_dir).withColumns({"status": status, "codes": F.col("reasons"), "lang": F.col("strategy"), "source": F.col("model")})


@query
def dataset_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distributions, rejections, duplicates and overlaps of the documents that labels accept."""
    return audit.dataset_audit(_decided(spark, sf_dir), views.evaluation(spark, sf_dir), ["lang", "source", "pressure"], "id", "text", "item_id")


@query
def audit_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by each of ten axes, with the different texts and models of each value, in one reading."""
    rows = views.records(spark, sf_dir)
    state = records.learner_state(F.col("pressure") == "solved", F.when(F.col("pressure") == "frustrated", "almost_correct").otherwise(F.col("pressure")))
    by_name = {n: F.col(n) for n in ("model", "family", "strategy", "pressure", "error_kind")} | {"passed": F.coalesce("passed", F.lit(False))}
    size = F.floor(F.log10(F.length("text") + 1)).cast("long")
    made = {"state": state, "digits": size, "judged": F.col("adherence").isNotNull(), "reasons": F.size("reasons")}
    return audit.profile(rows, by_name | made, {"texts": content_hash(F.col("text")), "models": F.col("model")})


@query
def audit_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the records come from: values of the first, and how many there are."""
    return audit.provenance(views.records(spark, sf_dir), ["model", "family", "strategy", "error_kind"], F.col("id"))


@query
def seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in a seeded order of their ids, which no second sort makes."""
    return permutation.in_seeded_order(table(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")], 20260817)


@query
def frozen_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged records of each of four languages frozen as a version, one of them twice, and one not as some are unjudged."""
    rows = _decided(spark, sf_dir).select("id", "text", "lang", F.when(F.col("adherence").isNull(), "unjudged").otherwise(F.col("status")).alias("status"))
    folder = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    logs = {lang: versions.VersionLog(spark, f"{folder}/{lang}") for lang in ("de", "en", "es", "fr")}
    for lang, log in logs.items():
        own = rows.where(F.col("lang") == lang)
        judged = own if lang == "fr" else own.where("status <> 'unjudged'")
        try:
            versions.freeze(log, judged, content_hash(F.col("text")), "id")
            if lang == "de":
                versions.freeze(log, judged.where("id % 2 = 0"), content_hash(F.col("text")), "id", refreeze=True)
        except versions.Refused:
            continue
    return versions.manifest(logs).fillna({"number": 0, "accepted_count": 0, "dataset_hash": ""})


@query
def journaled_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels dropped twice as verdicts; of the toxic ones the first drop has no verdict."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").cast("long").alias("at"), "toxic")
    folder = f"{shared_folder(spark)}/journal-{uuid.uuid4().hex}"
    for drop in ("first", "second"):
        verdict = F.when((F.col("toxic") == 1) & F.lit(drop == "first"), "judge_unavailable").otherwise(drop)
        labels.select("key", F.coalesce("at", F.lit(0)).alias("at"), verdict.alias("verdict")).write.mode("append").json(f"{folder}/drop")
        journal.journal(spark, f"{folder}/drop", f"{folder}/kept", f"{folder}/state", "key long, at long, verdict string", "key", "at", F.col("verdict") == "judge_unavailable")
    return spark.read.schema("key long, at long, verdict string").parquet(f"{folder}/kept").select("key", "verdict")


@query
def gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of a gate that rejected what nobody had judged, put right."""
    rows = _decided(spark, sf_dir).withColumn("waits", F.col("passed").isNull()).withColumn("status", F.when(F.col("status") == "unjudged", "rejected").otherwise(F.col("status")))
    return audit.gate_status(audit.reclassified(rows, F.col("waits")))


@query
def training_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of the conversations as a training set."""
    return audit.training_checks(table(spark, sf_dir, "conversations"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", content_hash(F.col("text")).alias("h"))
    return ranking.with_rank(docs, [], [F.col("h"), F.col("doc_id")])


@query
def subset_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the languages of nested subsets are from those of all documents."""
    return audit.subset_drift(_ranked(spark, sf_dir), "lang", SIZES)


@query
def nesting_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each subset is in the next, and its beginning; in one, a document is out of place."""
    ranked = _ranked(spark, sf_dir)
    each = ranked.select(F.explode(F.array(*[F.lit(n).cast("long") for n in SIZES])).alias("subset"), F.col("doc_id").alias("id"), F.col("rank").alias("place")).where("place <= subset")
    swapped = F.when((F.col("subset") == 500) & (F.col("place") == 7), F.lit(0)).otherwise(F.col("place"))
    return audit.nesting_checks(each.withColumn("place", swapped), SIZES)


@query
def published_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass rates as published (some of them wrong) against those of the records."""
    cells = metrics.cell_metrics(views.records(spark, sf_dir), ("strategy",))
    wrong = F.when(F.col("strategy") == "fr", 0.01).otherwise(0.0)
    published = cells.select("strategy", (F.round("pass_rate", 4) + wrong).alias("pass_rate"))
    return audit.metric_differences(published, metrics.breakdown(views.records(spark, sf_dir), "strategy"), ["strategy"], "pass_rate").select("strategy", F.round("published", 9).alias("published"), F.round("recomputed", 9).alias("recomputed"), "matches")


@query
def scenario_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether documents in English, held out, share texts with the others."""
    split = F.when(F.col("lang") == "en", "heldout").otherwise("clean")
    return audit.scenario_invariants(table(spark, sf_dir, "documents"), "doc_id", split, F.col("text"))


@query
def config_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of two runs that differ; nations with their regions stand for settings."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").alias("region"), "n_nationkey")
    now = nations.where("n_nationkey <> 3").withColumn("region", F.when(F.col("n_nationkey") % 5 == 0, F.col("region") + 1).otherwise(F.col("region")))
    as_text = lambda df: df.select("key", F.col("region").cast("string").alias("value"))
    return audit.config_problems(as_text(nations), as_text(now), nations.select("key"))


@query
def version_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of dataset versions; languages stand for versions."""
    rows = _decided(spark, sf_dir).withColumn("version", F.col("lang"))
    reports = rows.groupBy("version").agg(F.count("*").alias("candidate_count"), F.count_if(F.col("status") == "accepted").alias("accepted_count")).withColumn("hash", F.sha2("version", 256))
    freezes = reports.where("version IN ('en', 'de')").select("version", F.concat(F.lit("f-"), F.col("version")).alias("hash"), F.floor(F.col("accepted_count") / 2).alias("selected_count"))
    rejections = rows.where("status = 'rejected'").select("version", F.explode("codes").alias("code")).groupBy("version", "code").agg(F.count("*").alias("n"))
    return audit.version_status(reports, freezes, rejections).withColumn("selected_count", F.coalesce("selected_count", F.lit(-1)))


@query
def top_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two most frequent codes of failure."""
    return metrics.failure_counts(views.records(spark, sf_dir)).orderBy(F.desc("n"), "code").limit(2)


@query
def clean_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with whether they are similar to an evaluation text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    near = decontaminate.near_overlap(docs, views.evaluation(spark, sf_dir), "doc_id", "item_id")
    return decontaminate.split_contaminated(docs, near, "doc_id").select("doc_id", "contaminated")


# Selection, plans and resuming


@query
def examples_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two records of each kind of pressure, and of those that failed."""
    rows = views.records(spark, sf_dir).select("id", "pressure", "passed")
    strata = F.array_compact(F.array("pressure", F.when(~F.col("passed"), F.lit("failed"))))
    return review.examples_by_stratum(rows, strata, 2, "id").select("stratum", "nth", "id")


@query
def first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 records in their order, as a run with a limit takes them."""
    return ranking.with_rank(views.records(spark, sf_dir).select("id", "model"), [], [F.col("id")]).where("rank <= 25")


@query
def cell_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the cells of nations and regions."""
    pairs = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return pairs.select("n_nationkey", records.slug(F.col("n_name"), F.lit(" _ "), F.col("r_name")).alias("cell"))


@query
def learner_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of learners by pressure."""
    state = records.learner_state(F.col("pressure") == "solved", F.when(F.col("pressure") == "frustrated", "almost_correct").otherwise(F.col("pressure")))
    return views.records(spark, sf_dir).groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query
def generation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of 2000 scenarios."""
    return plan.sample_plan(spark, 2000)


@query
def plan_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of pressure in a plan as long as the table of orders."""
    count = table(spark, sf_dir, "orders").count()
    return select.distribution(plan.sample_plan(spark, count, 7), ["pressure", "language"])


@query
def seeded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the language and pressure that the generator of their number draws, with their turns."""
    rows = seeded.with_dimensions(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id") + 20240101)
    return rows.groupBy("language", "pressure").agg(F.count("*").alias("n"), F.sum("turns").alias("turns"))


@query
def resume_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a log of calls."""
    return resume.resume_stats(views.log(spark, sf_dir), ["user_id"], F.col("kind"))


@query
def merged_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First events, replaced by last purchases, with their customers' ordinals."""
    events = views.log(spark, sf_dir).select("user_id", "event_id", "ts", "event_type")
    old = resume.first_of(events, ["user_id"], F.col("ts"), F.col("event_id"))
    fresh = resume.last_of(events.where("event_type = 'purchase'"), ["user_id"], F.col("ts"), F.col("event_id"))
    owed = ranking.with_rank(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), [], [F.desc("c_name")], "ordinal")
    return resume.in_order(resume.merge_fresh(old, fresh, ["user_id"]), owed, ["user_id"], "ordinal").select("user_id", "event_id", "ordinal")


@query
def usage_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of two runs put together: events before and after the middle of January."""
    kind = F.col("event_type")
    calls = views.log(spark, sf_dir).select(
        F.col("user_id").alias("model"), kind, F.when(kind == "click", F.col("k")).alias("a"), F.when(kind.isin("view", "purchase"), F.col("k")).alias("b"), F.when(kind == "purchase", F.floor("value")).alias("o"), "ts"
    )
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    runs = [metrics.usage(calls.where(part), "model", ("a", "b"), ("o",), kind == "error") for part in (early, ~early)]
    return metrics.merged_usage(runs[0].unionByName(runs[1]), "model")


@query
def quota_shortfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages with fewer documents than a quota of nearly a third of all each."""
    docs = table(spark, sf_dir, "documents").select("lang")
    langs = docs.distinct().join(F.broadcast(docs.agg(F.floor(F.count("*") * 0.3).alias("quota"))))
    return select.shortfalls(docs, "lang", langs)


@query
def minimum_size_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why no size of a cell, or which, meets the thresholds."""
    return gates.minimum_size_reason(metrics.cell_metrics(views.records(spark, sf_dir)), "scenario_count").fillna(-1)


@query
def size_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a sweep over the documents, and candidates to ask for so that as many are accepted again."""
    row = views.labelled(spark, sf_dir).agg(F.count("*").alias("n"), F.count("quality").alias("judged"), F.count_if(F.expr("quality = 1")).alias("good")).first()  # one row
    more = gates.top_up(row["n"], row["good"], row["good"] / row["judged"] if row["judged"] else 1.0)
    sizes = ",".join(map(str, gates.sweep_sizes(row["n"])))
    return spark.createDataFrame([(row["n"], more, sizes)], "n long, top_up long, sweep string")


@query
def scored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes for which a judge's verdict on a labelled document rejects it, with the mean relevance."""
    rows = views.records(spark, sf_dir).where("passed IS NOT NULL")
    codes = criteria.judge_codes(F.filter("reasons", lambda c: c == "SOLUTION_LEAK"), F.col("adherence"), F.col("relevance"), F.col("robustness"), F.col("passed"), F.col("pressure"))
    return rows.groupBy(_codes(codes).alias("codes")).agg(F.count("*").alias("n"), F.round(F.avg("relevance"), 9).alias("relevance"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)
