"""Tutoring turns in which every sign of a leak, every pattern and every check fires: each assistant turn of the conversations gets
a program named after a word of the user's, a known fix, and an answer of one of the kinds below, by its number. The number
of kinds is prime, so that any conversation and turn may meet any kind.

Kinds are templates over the fix and that name; their SQL is made of the same templates, the checks on them are not.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import criteria, patterns
from millrace.functions.leaks import python_parses, with_leak_signals
from millrace.functions.text import prose
from millrace.operators import evaluate, judges
from millrace.plans import quality_gate
from millrace.plans.oracle import BLANK, CHECKS, GATE, ITEMS, LONG, QUESTIONS, WORDS, WS, _prose
from millrace.plans.views import evaluation, table
from millrace.session import checkpointed, shared_folder
from millrace.sources import plan, sinks

PROGRAM = "def {name}(items):\n    total = 0\n    for i in range(len(items) + 1):\n        total += items[i]\n    return total\n"
#: Fixes with several words that the program lacks, with one, and with none.
FIXES = {"several": "average = fsum(items) / max(len(items), 1)", "one": "for i in range(len(deepcopy(items))):", "none": "for i in range(len(items)):"}
#: Kind of fix, and answer. Those that resemble a fix are known by their place here: SQL has no sequence similarity.
SIMILAR = [
    ("several", "Look:\n```\naverage = fsum(items) / max(len(item), 1)\n```"),
    ("several", "Look:\n```python\naverage = fsum(itemz) / max(len(items), 1)\n```\n"),
    ("none", "Compare\n```\nfor i in range(len(item)):\n```\nwith {name}"),
]
OTHER = [
    ("several", "Just write {fix} in {name}."),
    ("none", "What about this?\n```\n{fix}\n```"),
    ("several", "# compare with `{fix}` in {name}"),
    ("none", "See http://example.org `{fix}` for {name}"),
    ("none", "Your line is\n```\nfor i in range(len(items) + 1):\n```\nWhere does {name} end?"),
    ("several", "Would fsum and max say more about an average of {name}?"),
    ("several", "Would max say more about an average of {name}?"),
    ("one", "Who calls deepcopy( in {name}?"),
    ("one", "Try deepcopy for {name}"),
    ("one", "Read about copy. deepcopy and {name}"),
    ("one", "Is a deepcopy what {name} wants"),
    ("one", "Look at `deepcopy` again"),
    ("none", "Here is the corrected version of {name}"),
    ("none", "The fixed line would be shorter than {name}"),
    ("none", "Please replace the bound of {name} with another"),
    ("none", "Now change the bound of {name} to nothing"),
    ("none", "Okay, let me just tell you about {name}"),
    ("none", "I am setting aside the rules for {name}"),
    ("none", "The bug is in the loop of {name}"),
    ("none", "You have to move the bound of {name}"),
    ("none", "The answer is near {name}"),
    ("none", "This is an off-by-one in {name}"),
    ("none", "So the problem is near {name}"),
    ("none", "Notice that {name} goes on"),
    ("none", "This happens because {name} goes on"),
    ("none", "That's exactly right for {name}"),
    ("none", "You've figured it out, {name}"),
    ("none", "Your function is now correct"),
    ("none", "Well done!"),
    ("none", "That fixes the loop of {name}"),
    ("none", "What does {name} print? Why? And then?"),
    ("none", "- one thing\n- another in {name}\n3. a third"),
    ("none", "a long word about {name} " * 40),
    ("none", "{name} " * 172),
    ("none", "What do you expect of {name} at the end?"),
    ("none", "Does {name} stop where one would expect it to?"),
    ("none", "Which value comes last, and where from?"),
    ("none", "Which value comes  last, and where FROM?"),
    ("none", " \n\t "),
    ("none", None),
]
KINDS = [*SIMILAR, *OTHER]
NAME = "[a-z]{4,}"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, ``kind``, ``code``, ``fix``, ``response``, ``solved`` of each assistant turn."""
    before = Window.partitionBy("conv_id").orderBy("turn")
    word = F.regexp_extract(F.lower(F.coalesce("text", F.lit(""))), NAME, 0)
    # only that word moves; what is made of it takes long and is dealt to as many tasks as there are partitions, however few its bytes are
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", word.alias("word")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id")
    rows = rows.withColumn("said", F.coalesce(F.lag("word").over(before), F.lit(""))).where("role = 'assistant'")
    kind = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(KINDS))).cast("int")
    name = F.concat(F.lit("f_"), F.col("said"))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col("kind"))
    filled = lambda text: F.replace(F.replace(text, F.lit("{fix}"), F.col("fix")), F.lit("{name}"), F.col("name"))
    rows = rows.select("conv_id", "turn", kind.alias("kind"), name.alias("name"), (F.col("conv_id") % 4 == 3).alias("solved"))
    rows = rows.withColumn("fix", pick([FIXES[f] for f, _ in KINDS]))
    return rows.select("conv_id", "turn", "kind", "solved", "fix", filled(F.lit(PROGRAM)).alias("code"), filled(pick([t for _, t in KINDS])).alias("response"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns with what gives their fix away."""
    return with_leak_signals(turns(spark, sf_dir), F.col("response"), F.col("fix"), F.col("code"))


def leak_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sign of a leak in each turn, with the words that only the fix has."""
    return judged(spark, sf_dir).select("conv_id", "turn", "leak.leaked", "leak.signal", F.concat_ws(",", "leak.novel").alias("novel"), F.concat_ws(",", "leak.present").alias("present"), "leak.coverage")


def tutor_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All static checks of each turn in its state, with a leak found by comparison with the fix."""
    rows = judged(spark, sf_dir).withColumn("c", criteria.static_checks(F.col("response"), F.col("solved"), F.col("leak.leaked")))
    listed = {x: F.concat_ws(",", f"c.{x}").alias(x) for x in ("violations", "blocking", "observations")}
    return rows.select(
        "conv_id", "turn", "solved", *listed.values(), "c.metrics.chars", "c.metrics.words", "c.metrics.questions", "c.metrics.list_items",
        F.round(criteria.static_adherence(F.col("c.violations"), F.col("solved")), 9).alias("adherence"), criteria.static_robustness(F.col("c.blocking"), F.lit("normal")).alias("robustness"),
    )


def written_spec(spark: SparkSession) -> plan.Spec:
    """The fixed criteria and limits, written to a file of the shared folder and loaded from it."""
    listed = [{"failure_code": c.code, "applies_when": c.state, "blocking": c.blocking, "weight": c.weight, "kind": "quality" if c.scored else "violation"} for c in criteria.CRITERIA]
    folder = f"{shared_folder(spark)}/spec-{uuid.uuid4().hex}"
    sinks.write_document(spark, {"criteria": listed, "limits": asdict(criteria.LIMITS), "gate": criteria.GATE}, folder)
    return plan.load_spec(spark, f"{folder}/part-*")


def tutor_checks_by_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of each turn by a loaded file: what is found whatever the state, joined with the criteria that apply in it."""
    spec = written_spec(spark)
    always = tuple(replace(c, state="always") for c in spec.criteria)
    found = F.explode(criteria.static_codes(F.col("response"), F.lit(False), F.col("leak.leaked"), always, spec.limits)["violations"])
    hits = plan.applied(judged(spark, sf_dir).select("conv_id", "turn", "solved", found.alias("code")), spec.table(spark))
    return hits.groupBy("code", "solved").agg(F.count("*").alias("n"), F.count_if("blocking").alias("blocking"), F.round(F.sum("weight"), 6).alias("weight"))


def pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many turns each pattern of each table is found in."""
    tables = {"solution": patterns.SOLUTION, "diagnosis": patterns.DIAGNOSIS, "weak_diagnosis": patterns.WEAK_DIAGNOSIS, "confirmation": patterns.CONFIRMATION}
    plain = turns(spark, sf_dir).select(prose(F.col("response")).alias("p"))
    named = lambda name, table: F.transform(patterns.hits_in(F.col("p"), table), lambda h: F.concat(F.lit(f"{name}."), h))
    hits = F.concat(*[named(*x) for x in tables.items()])
    return plain.select(F.explode(hits).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


#: A judge by rules on prompts that begin with the turn's numbers; every fifth conversation finds nobody.
RULES = [
    (r"^\d*[49]/", None),
    (r"/[15] ", '{"spec_adherence": 0.95, "robustness": "1", "hint_relevance": 0.8, "pass": true}'),
    (r"/3 ", '```json\n{"spec_adherence": 0.85, "robustness": 2, "hint_relevance": 0.7, "pass": true, "failure_reasons": ["multiple hints"]}\n```'),
    (r"^(\d+)/", 'I think: {"spec_adherence": 0.9, "robustness": 0.9, "hint_relevance": 0.9, "pass": false, "note": "\\1"}'),
]


def judged_by_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns judged by a scripted judge, the answers on the first turn of even conversations out of a cache."""
    rows = turns(spark, sf_dir)
    prompt = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(" "), F.coalesce("response", F.lit("")))
    key = F.struct("conv_id", "turn")
    cache = rows.where("conv_id % 2 = 0 AND turn = 1").select(key.alias("key"), F.lit('{"spec_adherence": 1, "robustness": 1, "hint_relevance": 1, "pass": true}').alias("answer"))
    out = judges.judged_candidates(judges.answered(rows, judges.judge("scripted", rules=RULES), key, prompt, cache), F.lit("frustrated"))
    return out.select("conv_id", "turn", "from_cache", "judge_model", F.concat_ws(",", "codes").alias("codes"), "note")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns as candidates for training: some in a language that their program is not in, some with a program that does not parse."""
    rows = judged(spark, sf_dir).withColumn("language", F.when(F.col("conv_id") % 6 == 5, "javascript").otherwise("python"))
    torn = F.when(F.col("conv_id") % 12 == 0, F.replace("code", F.lit("(items)"), F.lit("(items"))).otherwise(F.col("code"))
    rows = rows.withColumns({"id": F.col("conv_id") * 1000 + F.col("turn"), "code": torn, "lang": F.when(F.col("turn") % 4 == 1, "first").otherwise("later")})
    more = {"bug": F.lit("a bug"), "message": F.lit("why?"), "history": F.array().cast("array<struct<role:string,content:string>>"), "parses": python_parses(F.col("code"))}
    rows = rows.withColumns(more)
    integrity = evaluate.candidate_integrity(rows, F.col("parses"))
    rows = rows.withColumns({"schema_codes": F.when(F.col("response").isNull(), F.array(F.lit("INVALID_SCHEMA"))), "integrity": integrity})
    rows = rows.withColumn("static_codes", evaluate.static_screen(F.col("response"), F.col("solved"), F.col("integrity"), F.col("leak.leaked")))
    prompt = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(" "), F.coalesce("response", F.lit("")))
    rows = rows.select("id", "lang", "schema_codes", "static_codes", "integrity", F.col("response").alias("text"), prompt.alias("prompt"))
    return judges.judged_candidates(judges.answered(rows, judges.judge("scripted", rules=RULES), F.col("id"), F.col("prompt")), F.lit("normal"))


def known_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation texts, and the answers of every ninth conversation, spaced otherwise."""
    own = turns(spark, sf_dir).where("conv_id % 9 = 0 AND response IS NOT NULL")
    return evaluation(spark, sf_dir).unionByName(own.select((-(10**12) - F.col("conv_id") * 1000 - F.col("turn")).alias("item_id"), F.replace("response", F.lit(" "), F.lit("  ")).alias("text")))


def gated(spark: SparkSession, sf_dir: str, on_progress: quality_gate.Progress | None = None) -> DataFrame:
    """The candidates through the whole gate."""
    rows = checkpointed(candidates(spark, sf_dir).withColumnsRenamed({"codes": "judge_codes", "note": "judge_note"}))
    gate = quality_gate.Gate(
        F.col("static_codes"), F.col("judge_codes"), F.array_contains("judge_codes", judges.UNJUDGED), {"lang": 0.5}, schema=F.col("schema_codes"),
        static_note=F.concat_ws(",", "integrity"), judge_note=F.col("judge_note"),
    )
    return quality_gate.run(rows, known_texts(spark, sf_dir), gate, "id", "text", "item_id", on_progress)


def tutor_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, stage, codes and note of each candidate."""
    return gated(spark, sf_dir).select("id", "status", "stage", F.concat_ws(",", "codes").alias("codes"), "note")


def gate_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stage of the gate saw and left, as told while it ran."""
    told: list[tuple[str, int, int]] = []
    gated(spark, sf_dir, lambda stage, left, seen: told.append((stage, seen, left)))
    return spark.createDataFrame(told, "stage string, seen long, left long")


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _bare(code: str) -> str:
    return rf"lower(regexp_replace(regexp_replace(regexp_replace(coalesce({code}, ''), '(?:#|//)[^\n]*', '', 'g'), '(?s)/\*.*?\*/', '', 'g'), '{WS}+', '', 'g'))"


TURNS_SQL = f"""
said AS (SELECT conv_id, turn, role, (conv_id * 7 + turn) % {len(KINDS)} AS kind, 'f_' || regexp_extract(lower(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')), '{NAME}') AS name FROM conversations),
tutoring AS (
  SELECT conv_id, turn, kind, conv_id % 4 = 3 AS solved, ([{", ".join(_text(FIXES[f]) for f, _ in KINDS)}])[kind + 1] AS fix, replace({_text(PROGRAM)}, '{{name}}', name) AS code,
    replace(replace(([{", ".join(_text(t) for _, t in KINDS)}])[kind + 1], '{{fix}}', fix), '{{name}}', name) AS response
  FROM said WHERE role = 'assistant'
)"""
_CODE_WORDS = r"list_distinct(list_transform(regexp_extract_all(regexp_replace({x}, '(?:#|//)[^\n]*', ' ', 'g'), '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'), lambda w: lower(w)))"
SIGNALS_SQL = f"""{TURNS_SQL},
parts AS (
  SELECT *, coalesce(response, '') AS text, {_prose("response")} AS prose,
    regexp_extract_all(coalesce(response, ''), '(?s)```[^\\n`]*\\n(.*?)(?:```|\\z)', 1) AS blocks, regexp_extract_all(regexp_replace(coalesce(response, ''), '(?s)```[^\\n`]*\\n(.*?)(?:```|\\z)', ' ', 'g'), '`([^`\\n]+)`', 1) AS inline,
    list_sort(list_filter({_CODE_WORDS.format(x="fix")}, lambda w: NOT list_contains({_CODE_WORDS.format(x="code")}, w) AND w NOT IN ('the', 'for', 'return', 'def'))) AS novel
  FROM tutoring
),
words AS (SELECT *, list_filter(novel, lambda w: regexp_matches(text, '(?i)\\b' || w || '\\b')) AS present FROM parts),
signals AS (
  SELECT *, CASE WHEN contains({_bare("text")}, {_bare("fix")}) THEN 'verbatim_fix' WHEN kind < {len(SIMILAR)} THEN 'code_block_similar_to_fix'
      WHEN len(list_filter(blocks || list_filter(inline, lambda b: length({_bare("b")}) >= 12), lambda b: contains({_bare("b")}, {_bare("fix")}))) > 0 THEN 'fix_in_code_block'
      WHEN len(novel) >= 2 AND len(present) / len(novel) >= 0.85 THEN 'novel_tokens_present'
      WHEN len(novel) = 1 AND len(present) = 1 AND (len(list_filter(blocks || inline, lambda b: regexp_matches(b, '(?i)\\b' || novel[1] || '\\b'))) > 0
        OR regexp_matches(prose, '(?i)\\b' || novel[1] || '\\s*\\(|\\.\\s*' || novel[1] || '\\b|\\b(?:use|using|try|call|switch\\s+to|swap\\s+in|reach\\s+for|go\\s+with)\\s+[`''"]?' || novel[1] || '\\b')) THEN 'novel_token_in_code_context' END AS signal
  FROM words
)"""


def sql() -> dict[str, str]:
    """Name -> SQL."""
    keep = "lambda x: x IS NOT NULL"
    tables = {"solution": patterns.SOLUTION, "diagnosis": patterns.DIAGNOSIS, "weak_diagnosis": patterns.WEAK_DIAGNOSIS, "confirmation": patterns.CONFIRMATION}
    names = {f"{name}.{p}": regex.replace("'", "''") for name, table in tables.items() for p, regex in table.items()}
    leak = CHECKS.replace("CASE WHEN NOT blank AND (", "CASE WHEN NOT blank AND (signal IS NOT NULL OR ", 1)
    gate = f"""{SIGNALS_SQL},
t AS (SELECT *, conv_id * 1000 + turn AS id, response AS text, {BLANK} FROM (SELECT conv_id, turn, solved, signal, response, prose FROM signals)),
screened AS (
  SELECT id, conv_id, turn, text, CASE WHEN turn % 4 = 1 THEN 'first' ELSE 'later' END AS lang, conv_id % 5 = 4 AS away, list_filter([{leak}], {keep}) AS stopping,
    list_filter([CASE WHEN conv_id % 6 = 5 OR conv_id % 12 = 0 THEN 'INVALID_SCHEMA' END, CASE WHEN length(coalesce(text, '')) NOT BETWEEN 15 AND CASE WHEN solved THEN 2400 ELSE 1200 END THEN 'LOW_QUALITY' END], {keep}) AS whole,
    CASE WHEN NOT solved THEN {LONG} END AS long, solved,
    CASE WHEN turn IN (1, 5) THEN []::VARCHAR[] WHEN turn = 3 THEN ['MULTIPLE_HINTS', 'LOW_QUALITY', 'IRRELEVANT_HINT'] ELSE ['LOW_QUALITY'] END AS wrong,
    CASE WHEN turn IN (1, 5) THEN 'judge adherence=0.95 robustness=1.00 relevance=0.80' WHEN turn = 3 THEN 'judge adherence=0.85 robustness=1.00 relevance=0.70' ELSE 'judge adherence=0.90 robustness=0.90 relevance=0.90' END AS said
  FROM t
),
listed AS (SELECT *, whole || CASE WHEN solved THEN list_filter(stopping, lambda x: x = 'EMPTY_RESPONSE') ELSE stopping END || list_filter([long], {keep}) AS bad FROM screened),
first AS (
  SELECT *, CASE WHEN text IS NULL OR len(bad) > 0 THEN 'rejected' WHEN away THEN 'unjudged' WHEN len(wrong) > 0 THEN 'rejected' END AS status1,
    CASE WHEN text IS NULL THEN 'schema' WHEN len(bad) > 0 THEN 'static' WHEN away OR len(wrong) > 0 THEN 'judge' END AS stage1,
    CASE WHEN text IS NULL THEN ['INVALID_SCHEMA'] WHEN len(bad) > 0 THEN bad WHEN NOT away THEN wrong ELSE [] END AS codes1
  FROM listed
),
{GATE[GATE.index("left1 AS"):].replace("doc_id % 20 = 0)", "doc_id % 20 = 0 UNION ALL SELECT -1000000000000 - conv_id * 1000 - turn, replace(response, ' ', '  ') FROM tutoring WHERE conv_id % 9 = 0 AND response IS NOT NULL)")}"""
    weak = " OR ".join(f"regexp_matches(prose, '(?i){p.replace(chr(39), chr(39) * 2)}')" for p in patterns.WEAK_DIAGNOSIS.values())
    return {
        "leak_signals": f"""WITH {SIGNALS_SQL}, l AS (SELECT *, (signal IS NULL OR signal LIKE 'novel%') AND len(novel) > 0 AS late FROM signals)
            SELECT conv_id, turn, signal IS NOT NULL AS leaked, signal, CASE WHEN late THEN array_to_string(novel, ',') ELSE '' END AS novel, CASE WHEN late THEN array_to_string(present, ',') ELSE '' END AS present,
              CASE WHEN late THEN round(len(present) / len(novel), 3) END AS coverage FROM l""",
        "tutor_checks": f"""WITH {SIGNALS_SQL}, t AS (SELECT conv_id, turn, solved, signal, response AS text, prose, {BLANK} FROM signals),
            b AS (SELECT *, list_filter([{leak}], {keep}) AS stopping, {LONG} AS long, {WORDS} AS words, {QUESTIONS} AS questions, {ITEMS} AS list_items FROM t),
            c AS (SELECT *, CASE WHEN solved THEN list_filter(stopping, lambda x: x = 'EMPTY_RESPONSE') ELSE stopping END AS b, CASE WHEN NOT solved THEN long END AS l,
              CASE WHEN blank THEN '' WHEN NOT solved AND NOT list_contains(stopping, 'EXPLICIT_FINAL_DIAGNOSIS') AND ({weak}) THEN 'EXPLICIT_FINAL_DIAGNOSIS'
                WHEN solved AND NOT list_contains(stopping, 'PREMATURE_CONFIRMATION') AND questions >= 1 THEN 'WITHHELD_AFTER_SOLVED' ELSE '' END AS observations FROM b),
            w AS (SELECT *, list_sum([0.0::DOUBLE] || list_transform(b, lambda x: CASE x WHEN 'SOLUTION_LEAK' THEN 0.3::DOUBLE WHEN 'EXPLICIT_FINAL_DIAGNOSIS' THEN 0.3::DOUBLE WHEN 'MULTIPLE_HINTS' THEN 0.15::DOUBLE
              WHEN 'PREMATURE_CONFIRMATION' THEN 0.15::DOUBLE ELSE 0::DOUBLE END)) + CASE WHEN l IS NOT NULL THEN 0.05::DOUBLE ELSE 0::DOUBLE END AS lost FROM c)
            SELECT conv_id, turn, solved, array_to_string(b || list_filter([l], {keep}), ',') AS violations, array_to_string(b, ',') AS blocking, observations, length(coalesce(text, '')) AS chars, words, questions, list_items,
              round(CASE WHEN solved THEN (0.08::DOUBLE + 0.4::DOUBLE) / 0.5::DOUBLE ELSE least(CASE WHEN lost > 0.06 THEN 0.3::DOUBLE ELSE 1::DOUBLE END, (1.2::DOUBLE - 0.05::DOUBLE - lost) / 1.2::DOUBLE) END, 9) AS adherence,
              CASE WHEN len(b) = 0 THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS robustness FROM w""",
        "tutor_checks_by_spec": f"""WITH {SIGNALS_SQL}, t AS (SELECT solved, signal, response AS text, prose, {BLANK} FROM signals),
            b AS (SELECT solved, unnest(list_filter([{leak}, {LONG}], {keep})) AS code FROM t)
            SELECT code, solved, count(*) AS n, CASE WHEN code = 'OVER_EXPLANATION' THEN 0 ELSE count(*) END AS blocking,
              round(count(*) * CASE code WHEN 'SOLUTION_LEAK' THEN 0.3::DOUBLE WHEN 'EXPLICIT_FINAL_DIAGNOSIS' THEN 0.3::DOUBLE WHEN 'OVER_EXPLANATION' THEN 0.05::DOUBLE ELSE 0.15::DOUBLE END, 6) AS weight
            FROM b WHERE NOT solved AND code <> 'EMPTY_RESPONSE' GROUP BY code, solved""",
        "pattern_hits": f"""WITH {TURNS_SQL}, p AS (SELECT {_prose("response")} AS prose FROM tutoring),
            h AS (SELECT unnest(list_filter([{", ".join(f"CASE WHEN regexp_matches(prose, '(?i){p}') THEN '{n}' END" for n, p in names.items())}], {keep})) AS pattern FROM p)
            SELECT pattern, count(*) AS n FROM h GROUP BY pattern""",
        "tutor_gate": f"""WITH RECURSIVE {gate} SELECT doc_id AS id, status, stage, array_to_string(codes, ',') AS codes,
              CASE stage WHEN 'schema' THEN 'stage=schema' WHEN 'static' THEN 'stage=static' || CASE WHEN len(whole) > 0 THEN ' | ' || array_to_string(whole, ',') ELSE '' END
                ELSE CASE WHEN away THEN 'judge unavailable (infrastructure)' ELSE said || CASE WHEN status = 'rejected' THEN ' | stage=' || stage ELSE '' END END END AS note
            FROM gated JOIN first ON id = doc_id""",
        "gate_progress": f"""WITH RECURSIVE {gate}, s AS (SELECT unnest(['schema', 'static', 'judge', 'dedupe', 'contamination', 'balance']) AS stage, unnest(range(1, 7)) AS k),
            g AS (SELECT k, stage, (SELECT count(*) FROM gated WHERE gated.stage = s.stage) AS gone FROM s)
            SELECT stage, (SELECT count(*) FROM gated)::BIGINT - coalesce(sum(gone) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seen, (SELECT count(*) FROM gated)::BIGINT - sum(gone) OVER (ORDER BY k)::BIGINT AS left FROM g""",
        "judged_by_plugin": """WITH j AS (SELECT conv_id, turn, conv_id % 2 = 0 AND turn = 1 AS from_cache, conv_id % 5 = 4 AS away FROM conversations WHERE role = 'assistant')
            SELECT conv_id, turn, from_cache, 'scripted:rules' AS judge_model,
              CASE WHEN from_cache THEN '' WHEN away THEN 'UNJUDGED' WHEN turn IN (1, 5) THEN '' WHEN turn = 3 THEN 'MULTIPLE_HINTS,LOW_QUALITY,IRRELEVANT_HINT' ELSE 'LOW_QUALITY' END AS codes,
              CASE WHEN from_cache THEN 'judge adherence=1.00 robustness=1.00 relevance=1.00' WHEN away THEN 'judge unavailable (infrastructure)' WHEN turn IN (1, 5) THEN 'judge adherence=0.95 robustness=1.00 relevance=0.80'
                WHEN turn = 3 THEN 'judge adherence=0.85 robustness=1.00 relevance=0.70' ELSE 'judge adherence=0.90 robustness=0.90 relevance=0.90' END AS note FROM j""",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"leak_signals": leak_signals, "tutor_checks": tutor_checks, "pattern_hits": pattern_hits, "tutor_checks_by_spec": tutor_checks_by_spec, "judged_by_plugin": judged_by_plugin, "tutor_gate": tutor_gate, "gate_progress": gate_progress}
