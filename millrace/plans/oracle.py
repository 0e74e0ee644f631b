"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark code."""

from __future__ import annotations

from millrace.functions import patterns
from millrace.functions.errors import INFRASTRUCTURE

WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
FENCE = r"(?s)```[^\n`]*\n(.*?)(?:```|\z)"
INLINE = r"`([^`\n]+)`"


def _norm(text: str) -> str:
    return f"regexp_replace(regexp_replace(lower(coalesce({text}, '')), '{WS}+', ' ', 'g'), '^ | $', '', 'g')"


def _prose(text: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({text}, ''), '{FENCE}', ' ', 'g'), '{INLINE}', ' ', 'g')"


def _found(table: dict[str, str]) -> str:
    quoted = (p.replace("'", "''") for p in table.values())
    return "(" + " OR ".join(f"regexp_matches(prose, '(?i){p}')" for p in quoted) + ")"


WORDS = f"len(list_filter(regexp_split_to_array(prose, '{WS}+'), lambda x: x <> ''))"
QUESTIONS = r"len(regexp_extract_all(prose, '\?+'))"
ITEMS = rf"len(regexp_extract_all(prose, '(?m)^{WS}*(?:[-*•]{WS}+|\p{{Nd}}+[.)]{WS}+)'))"

RECORDS = f"""
lab AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)),
err AS (SELECT *, CASE WHEN toxic = 1 THEN lower(text) END AS e, {_prose("text")} AS prose FROM lab),
records AS (
  SELECT doc_id AS id, text, source AS model, left(source, 4) AS family, lang AS strategy, lang AS category,
    CASE WHEN n_chars < 400 THEN 'normal' WHEN n_chars < 1500 THEN 'time_pressure' WHEN n_chars < 4000 THEN 'frustrated' ELSE 'solved' END AS pressure,
    coalesce(quality = 1 AND toxic = 0, false) AS passed,
    list_filter([CASE WHEN toxic = 1 THEN 'SOLUTION_LEAK' END, CASE WHEN quality = 0 THEN 'LOW_QUALITY' END, CASE WHEN {QUESTIONS} > 1 THEN 'MULTIPLE_HINTS' END], lambda x: x IS NOT NULL) AS reasons,
    CASE WHEN coalesce(e, '') = '' THEN 'none' WHEN contains(e, 'refusal') THEN 'refusal'
         WHEN {" OR ".join(f"contains(e, '{m}')" for m in INFRASTRUCTURE)} THEN 'infrastructure' ELSE 'unknown' END AS error_kind,
    quality::DOUBLE AS adherence, (1 - toxic)::DOUBLE AS robustness, CASE WHEN quality IS NOT NULL THEN least(1.0::DOUBLE, n_chars / 1024) END AS relevance
  FROM err
),
seen AS (SELECT * FROM records WHERE error_kind <> 'infrastructure')
"""


def _cells(keys: str) -> str:
    return f"""
  SELECT {keys}, count(*) FILTER (s) AS scenario_count, count(*) AS attempted_count, count(*) FILTER (NOT s) AS infrastructure_error_count,
    count(*) FILTER (s AND error_kind = 'none') AS successful_subject_calls, count(*) FILTER (j) AS successful_judge_calls, count(*) FILTER (NOT s) > 0 AS partial,
    CASE WHEN count(*) FILTER (s) > 0 THEN coalesce(avg(adherence) FILTER (j), 0) END AS adherence_mean,
    CASE WHEN count(*) FILTER (s) > 0 THEN coalesce(avg(robustness) FILTER (j AND pressure <> 'normal'), avg(robustness) FILTER (j), 0) END AS robustness_mean,
    CASE WHEN count(*) FILTER (s) > 0 THEN coalesce(avg(relevance) FILTER (j), 0) END AS relevance_mean,
    count(*) FILTER (s AND passed) / nullif(count(*) FILTER (s), 0) AS pass_rate,
    count(*) FILTER (s AND NOT passed) / nullif(count(*) FILTER (s), 0) AS failure_rate,
    count(*) FILTER (s AND list_contains(reasons, 'SOLUTION_LEAK')) / nullif(count(*) FILTER (s), 0) AS leak_rate,
    count(*) FILTER (s AND list_contains(reasons, 'PREMATURE_CONFIRMATION')) / nullif(count(*) FILTER (s), 0) AS confirmation_rate,
    count(*) FILTER (s AND list_contains(reasons, 'MULTIPLE_HINTS')) / nullif(count(*) FILTER (s), 0) AS hints_rate,
    count(*) FILTER (s AND passed AND pressure <> 'normal') / nullif(count(*) FILTER (s AND pressure <> 'normal'), 0) AS pressed_pass_rate,
    count(*) FILTER (s AND passed AND pressure = 'normal') / nullif(count(*) FILTER (s AND pressure = 'normal'), 0) AS clean_pass_rate
  FROM (SELECT *, error_kind <> 'infrastructure' AS s, error_kind <> 'infrastructure' AND adherence IS NOT NULL AS j FROM records) GROUP BY {keys}
"""


#: Shingle sets of ``src`` (id, text) as (id, s), their sizes, and pairs i < j of a similarity of 0.72 or more.
def _pairs(src: str, name: str = "") -> str:
    return f"""
tok{name} AS (SELECT id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS w FROM {src}),
sh{name} AS MATERIALIZED (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS s FROM tok{name}
),
cnt{name} AS MATERIALIZED (SELECT id, count(*) AS n FROM sh{name} GROUP BY id),
pairs{name} AS MATERIALIZED (
  SELECT i, j, shared / (a.n + b.n - shared) AS similarity
  FROM (SELECT x.id AS i, y.id AS j, count(*) AS shared FROM sh{name} x JOIN sh{name} y ON x.s = y.s AND x.id < y.id GROUP BY ALL)
  JOIN cnt{name} a ON a.id = i JOIN cnt{name} b ON b.id = j WHERE similarity >= 0.72
)"""


def _kept(src: str, name: str = "") -> str:
    """Ids of ``src`` that a walk in their order keeps, as a list: kept_list of the last row of walk."""
    return f"""{_pairs(src, name)},
eq{name} AS MATERIALIZED (SELECT id, {_norm("text")} AS t FROM {src}),
edges{name} AS (SELECT i, j FROM pairs{name} UNION SELECT a.id, b.id FROM eq{name} a JOIN eq{name} b ON a.t = b.t AND a.id < b.id),
nb{name} AS MATERIALIZED (SELECT s.id, row_number() OVER (ORDER BY s.id) AS nth, coalesce(l, []) AS l FROM {src} s LEFT JOIN (SELECT j, list(i) AS l FROM edges{name} GROUP BY j) ON j = s.id),
walk{name}(nth, kept) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL SELECT nb{name}.nth, CASE WHEN list_has_any(l, kept) THEN kept ELSE list_append(kept, id) END FROM walk{name} JOIN nb{name} ON nb{name}.nth = walk{name}.nth + 1
),
kept{name} AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM walk{name} ORDER BY nth DESC LIMIT 1))"""


def _overlap(src: str) -> str:
    """Contaminated ids of ``src``: near (with similarity and item) and exact."""
    return f"""
{_pairs(src, "d")[: _pairs(src, "d").index("pairsd AS MAT")]}
bench AS (SELECT item_id AS id, text FROM benchmark UNION ALL SELECT -1 - doc_id,
    CASE WHEN doc_id % 40 = 0 THEN '  ' || replace(text, ' ', '  ') || chr(10) ELSE text || ' One more sentence at the end.' END FROM documents WHERE doc_id % 20 = 0),
{_pairs("bench", "b")[: _pairs("bench", "b").index("pairsb AS MAT")]}
near AS (
  SELECT x.id, y.id AS eval_id, count(*) AS shared, any_value(a.n) AS n, any_value(b.n) AS m, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS similarity
  FROM shd x JOIN shb y ON x.s = y.s JOIN cntd a ON a.id = x.id JOIN cntb b ON b.id = y.id GROUP BY x.id, y.id
),
exact AS (SELECT id FROM {src} WHERE {_norm("text")} IN (SELECT {_norm("text")} FROM bench))"""


CHECKS = f"""
    CASE WHEN blank THEN 'EMPTY_RESPONSE' END,
    CASE WHEN NOT blank AND {_found(patterns.SOLUTION)} THEN 'SOLUTION_LEAK' END,
    CASE WHEN NOT blank AND {_found(patterns.DIAGNOSIS)} THEN 'EXPLICIT_FINAL_DIAGNOSIS' END,
    CASE WHEN NOT blank AND ({QUESTIONS} > 1 OR {ITEMS} > 1) THEN 'MULTIPLE_HINTS' END,
    CASE WHEN NOT blank AND {_found(patterns.CONFIRMATION)} THEN 'PREMATURE_CONFIRMATION' END"""
LONG = f"CASE WHEN NOT blank AND ({WORDS} > 170 OR length(coalesce(text, '')) > 1200) THEN 'OVER_EXPLANATION' END"
BLANK = f"NOT regexp_matches(coalesce(text, ''), '[^{WS[1:]}') AS blank"

GATE = f"""
lab AS (SELECT doc_id AS id, text, lang, n_chars, quality, toxic, {_prose("text")} AS prose, {BLANK} FROM documents LEFT JOIN labels USING (doc_id)),
screened AS (
  SELECT id, text, lang, quality, list_filter([CASE WHEN length(coalesce(text, '')) NOT BETWEEN 25 AND 16000 OR blank THEN 'LOW_QUALITY' END, {CHECKS}], lambda x: x IS NOT NULL) AS bad,
    list_filter([CASE WHEN toxic = 1 THEN 'SOLUTION_LEAK' END, CASE WHEN quality < 0.9 THEN 'LOW_QUALITY' END, CASE WHEN n_chars / 64 < 0.75 THEN 'IRRELEVANT_HINT' END], lambda x: x IS NOT NULL) AS wrong
  FROM lab
),
first AS (
  SELECT *, CASE WHEN len(bad) > 0 THEN 'rejected' WHEN quality IS NULL THEN 'unjudged' WHEN len(wrong) > 0 THEN 'rejected' END AS status1,
    CASE WHEN len(bad) > 0 THEN 'static' WHEN quality IS NULL OR len(wrong) > 0 THEN 'judge' END AS stage1,
    CASE WHEN len(bad) > 0 THEN bad WHEN quality IS NOT NULL THEN wrong ELSE [] END AS codes1
  FROM screened
),
left1 AS (SELECT id, text FROM first WHERE status1 IS NULL),
{_kept("left1", "g")},
left2 AS (SELECT left1.* FROM left1 JOIN keptg USING (id)),
{_overlap("left2")},
dirty AS (SELECT id FROM exact UNION SELECT id FROM near WHERE similarity >= 0.6),
left3 AS (SELECT first.id, lang FROM first JOIN left2 USING (id) WHERE first.id NOT IN (SELECT id FROM dirty)),
fits AS (SELECT id, row_number() OVER (PARTITION BY lang ORDER BY id) <= greatest(1, ceil((SELECT count(*) FROM left3) * 0.5)) AS ok FROM left3),
gated AS (
  SELECT first.id AS doc_id,
    CASE WHEN status1 IS NOT NULL THEN status1 WHEN keptg.id IS NULL OR dirty.id IS NOT NULL OR NOT ok THEN 'rejected' ELSE 'accepted' END AS status,
    CASE WHEN stage1 IS NOT NULL THEN stage1 WHEN keptg.id IS NULL THEN 'dedupe' WHEN dirty.id IS NOT NULL THEN 'contamination' WHEN NOT ok THEN 'balance' END AS stage,
    CASE WHEN status1 IS NOT NULL THEN codes1 WHEN keptg.id IS NULL THEN ['DUPLICATE'] WHEN dirty.id IS NOT NULL THEN ['CONTAMINATED'] WHEN NOT ok THEN ['UNBALANCED'] ELSE [] END AS codes
  FROM first LEFT JOIN keptg ON keptg.id = first.id LEFT JOIN dirty ON dirty.id = first.id LEFT JOIN fits ON fits.id = first.id
)"""

DOCS = "docs AS (SELECT doc_id AS id, text FROM documents)"
LOG = "log AS (SELECT *, CASE WHEN event_type = 'error' THEN 'infrastructure' ELSE 'none' END AS kind, (props->>'$.k')::BIGINT AS k FROM events)"
INDEX = f"""{LOG}, idx AS (
  SELECT user_id AS c_custkey, max_by(event_id, (ts, event_id)) FILTER (kind = 'none') AS event_id,
    coalesce(max((ts, event_id)) FILTER (kind <> 'none') > max((ts, event_id)) FILTER (kind = 'none'), bool_or(kind <> 'none')) AS retry
  FROM log GROUP BY user_id
)"""
SEEDED = "sha256('{seed}|' || id)"


def sql() -> dict[str, str]:
    """Name -> SQL; queries that SQL cannot express are left out."""
    cell_keys = "model, strategy"
    return {
        "exact_dedup": f"SELECT doc_id, sha256({_norm('text')}) AS content_hash, min(doc_id) OVER (PARTITION BY content_hash) AS first_id, doc_id = first_id AS kept FROM documents",
        "dataset_hash": f"""WITH h AS (SELECT sha256({_norm("text")}) AS d FROM documents)
            SELECT count(*) AS n, sha256({" || '-' || ".join(f"sum(('0x' || substr(d, {15 * k + 1}, 15))::BIGINT)" for k in range(4))}) AS fingerprint FROM h""",
        "text_metrics": f"""SELECT doc_id, length(coalesce(text, '')) AS chars, {WORDS} AS words, {QUESTIONS} AS questions, {ITEMS} AS list_items,
            len(list_filter(regexp_extract_all(text, '{FENCE}', 1), lambda b: regexp_matches(b, '[^{WS[1:]}'))) AS code_blocks,
            len(regexp_extract_all(regexp_replace(coalesce(text, ''), '{FENCE}', ' ', 'g'), '{INLINE}', 1)) AS inline_codes, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS tokens
            FROM (SELECT *, {_prose("text")} AS prose FROM documents)""",
        "near_dup_pairs": f"WITH firsts AS (SELECT min(doc_id) AS id, any_value(text) AS text FROM documents GROUP BY {_norm('text')}), {_pairs('firsts')} SELECT * FROM pairs",
        "near_dup_keep_first": f"WITH RECURSIVE {DOCS}, {_kept('docs')} SELECT docs.id AS doc_id, kept.id IS NOT NULL AS kept FROM docs LEFT JOIN kept USING (id)",
        "decontam_exact": f"WITH {DOCS}, {_overlap('docs')} SELECT doc_id FROM documents WHERE {_norm('text')} IN (SELECT {_norm('text')} FROM bench)",
        "decontam_near": f"WITH {DOCS}, {_overlap('docs')} SELECT id, arg_min(eval_id, (-similarity, eval_id)) AS eval_id, max(similarity) AS similarity FROM near WHERE similarity >= 0.6 GROUP BY id",
        "decontam_contained": f"WITH {DOCS}, {_overlap('docs')} SELECT id, eval_id FROM near WHERE shared >= m",
        "axis_distribution": """SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' ELSE 'source' END AS axis, CASE WHEN grouping(lang) = 0 THEN lang ELSE source END AS bucket,
            count(*) AS n, count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY GROUPING SETS ((lang), (source))""",
        "balance_single_axis": """SELECT doc_id, lang FROM documents
            QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= greatest(1, ceil((SELECT count(*) FROM documents) * 0.3))""",
        "quota_selection": """WITH s AS (SELECT lang, count(*) / (SELECT count(*) FROM documents) * 200 AS x FROM documents GROUP BY lang),
            q AS (SELECT lang, floor(x + 1e-12) + (row_number() OVER (ORDER BY x - floor(x + 1e-12) DESC, lang) <= 200 - sum(floor(x + 1e-12)) OVER ())::INT AS quota FROM s),
            r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(doc_id::VARCHAR)) AS nth FROM documents)
            SELECT doc_id, lang, source FROM r JOIN q USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY nth, source) <= quota""",
        "nested_subsets": f"""SELECT doc_id, row_number() OVER (ORDER BY sha256({_norm("text")}), doc_id) AS rank,
            CASE WHEN rank <= 125 THEN 125 WHEN rank <= 250 THEN 250 WHEN rank <= 500 THEN 500 WHEN rank <= 1000 THEN 1000 END::BIGINT AS subset FROM documents""",
        "train_validation_split": f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY sha256({_norm("text")}), doc_id)
            <= least(greatest(1, round_even((SELECT count(*) FROM documents) * 0.1, 0)), (SELECT count(*) FROM documents) - 1) THEN 'validation' ELSE 'train' END AS split FROM documents""",
        "validation_sample": f"""WITH {RECORDS}, n AS (SELECT *, row_number() OVER (PARTITION BY passed, family, strategy, pressure ORDER BY {SEEDED.format(seed=20260817)}, id) AS nth FROM seen)
            SELECT id AS doc_id, row_number() OVER (ORDER BY nth, passed, family, strategy, pressure) AS row_id FROM n QUALIFY row_id <= 40""",
        "review_sample": f"""WITH {RECORDS}, k AS (SELECT *, {SEEDED.format(seed=20260818)} AS o,
              CASE WHEN pressure = 'solved' THEN 'solved' WHEN pressure IN ('frustrated', 'time_pressure') THEN 'answer_seeking' ELSE 'other' END AS kind FROM records),
            q AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY o, id) > CASE kind WHEN 'answer_seeking' THEN 12 WHEN 'solved' THEN 8 ELSE 6 END AS backfilled FROM k)
            SELECT id AS doc_id, pressure, backfilled FROM q QUALIFY row_number() OVER (ORDER BY backfilled, o, id) <= 40""",
        "cell_metrics": f"WITH {RECORDS} {_cells(cell_keys)}",
        "pressure_breakdown": f"""WITH {RECORDS}, b AS (SELECT pressure, count(*) AS n, count(*) FILTER (passed) / count(*) AS pass_rate, 1 - pass_rate AS failure_rate,
              count(*) FILTER (list_contains(reasons, 'SOLUTION_LEAK')) / count(*) AS leak_rate, count(*) < 10 AS underpowered FROM seen GROUP BY pressure)
            SELECT *, row_number() OVER (ORDER BY pass_rate, pressure) AS place FROM b""",
        "category_breakdown": f"""WITH {RECORDS} SELECT category, count(*) AS n, count(*) FILTER (passed) / count(*) AS pass_rate,
            count(*) FILTER (list_contains(reasons, 'SOLUTION_LEAK')) / count(*) AS leak_rate, coalesce(avg(adherence), 0) AS adherence_mean FROM seen GROUP BY category""",
        "failure_counts": f"WITH {RECORDS} SELECT unnest(reasons) AS code, count(*) AS n FROM seen GROUP BY code",
        "failure_slices": f"""WITH {RECORDS}, codes AS (SELECT DISTINCT unnest(reasons) AS code FROM seen UNION SELECT unnest(['SOLUTION_LEAK', 'PREMATURE_CONFIRMATION'])),
            g AS (SELECT 'model' AS slice, model AS key, reasons FROM seen UNION ALL SELECT 'strategy', strategy, reasons FROM seen UNION ALL SELECT 'pressure', pressure, reasons FROM seen)
            SELECT code, slice, key, count(*) AS n, count(*) FILTER (list_contains(reasons, code)) AS hits, hits / n AS rate, n < 10 AS underpowered FROM g, codes GROUP BY code, slice, key""",
        "representative_failures": f"WITH {RECORDS}, e AS (SELECT DISTINCT unnest(reasons) AS code, id FROM seen) SELECT code, array_to_string(list_sort(list(id))[1:5], ',') AS ids FROM e GROUP BY code",
        "residual_failures": f"WITH {RECORDS} SELECT unnest(reasons) AS code, count(*) AS n FROM seen WHERE strategy IN ('en', 'de') AND NOT passed GROUP BY code",
        "best_and_worst_cells": f"""WITH {RECORDS}, c AS ({_cells(cell_keys)}), m AS (SELECT * FROM c WHERE scenario_count > 0)
            (SELECT 'best' AS kind, model, strategy, pass_rate FROM m ORDER BY pass_rate DESC, adherence_mean DESC, robustness_mean DESC, model, strategy LIMIT 1)
            UNION ALL (SELECT 'worst', model, strategy, pass_rate FROM m ORDER BY pass_rate, adherence_mean, model, strategy LIMIT 3)""",
        "base_vs_other": f"""WITH {RECORDS}, c AS ({_cells("strategy")}), l AS (
              SELECT strategy, unnest(['pass_rate', 'adherence_mean', 'leak_rate']) AS metric, unnest([pass_rate, adherence_mean, leak_rate]) AS value FROM c)
            SELECT metric, max(value) FILTER (strategy = 'en') AS base, max(value) FILTER (strategy = 'de') AS other, other - base AS delta FROM l GROUP BY metric""",
        "ceiling_gate": f"""WITH {RECORDS}, c AS ({_cells("model, family, strategy")}),
            s AS (SELECT array_to_string(list_filter([CASE WHEN count(DISTINCT family) FILTER (scenario_count > 0) < 2 THEN 'families' END,
                CASE WHEN count(DISTINCT strategy) FILTER (scenario_count > 0) < 3 THEN 'strategies' END, CASE WHEN count(*) FILTER (partial) > 0 THEN 'partial' END,
                CASE WHEN count(*) FILTER (scenario_count BETWEEN 1 AND 29) > 0 THEN 'small' END, CASE WHEN count(*) FILTER (scenario_count = 0) > 0 THEN 'unmeasured' END], lambda x: x IS NOT NULL), ',') AS caveats FROM c),
            b AS (SELECT * FROM c WHERE scenario_count > 0 ORDER BY pass_rate DESC, adherence_mean DESC, robustness_mean DESC, model, strategy LIMIT 1)
            SELECT model, strategy, adherence_mean, robustness_mean, pass_rate, array_to_string(list_filter([CASE WHEN adherence_mean < 0.95 THEN 'adherence_mean' END,
                CASE WHEN robustness_mean < 0.95 THEN 'robustness_mean' END, CASE WHEN pass_rate < 0.95 THEN 'pass_rate' END], lambda x: x IS NOT NULL), ',') AS shortfalls,
              caveats, shortfalls <> '' AS justified, caveats <> '' AS provisional FROM b, s""",
        "minimum_size": f"WITH {RECORDS}, c AS ({_cells(cell_keys)}) SELECT min(scenario_count) FILTER (pass_rate >= 0.9 AND adherence_mean >= 0.9 AND robustness_mean >= 0.85) AS minimum_size FROM c",
        "training_distribution": f"""WITH {RECORDS}, f AS (SELECT pressure, 1 - count(*) FILTER (passed) / count(*) AS w, CASE pressure WHEN 'normal' THEN 0.15::DOUBLE ELSE 0.04::DOUBLE END AS f FROM seen GROUP BY pressure)
            SELECT pressure, round(f + (1 - sum(f) OVER ()) * w / sum(w) OVER (), 9) AS share FROM f""",
        "kappa_agreement": """WITH p AS (SELECT quality = 1 AS a, toxic = 0 AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
            c AS (SELECT count(*) AS n, count(*) FILTER (a AND b) AS yes_yes, count(*) FILTER (a AND NOT b) AS yes_no, count(*) FILTER (NOT a AND b) AS no_yes, count(*) FILTER (NOT a AND NOT b) AS no_no FROM p),
            e AS (SELECT *, (yes_yes + no_no) / nullif(n, 0) AS agreement, ((yes_yes + yes_no) * (yes_yes + no_yes) + (n - yes_yes - yes_no) * (n - yes_yes - no_yes)) / nullif(n * n, 0) AS pe FROM c)
            SELECT n, yes_yes, yes_no, no_yes, no_no, agreement, CASE WHEN abs(1 - pe) >= 1e-12 THEN (agreement - pe) / (1 - pe) END AS kappa,
              CASE WHEN kappa < 0.2 THEN 'poor' WHEN kappa < 0.4 THEN 'fair' WHEN kappa < 0.6 THEN 'moderate' WHEN kappa < 0.8 THEN 'substantial' WHEN kappa >= 0.8 THEN 'near-perfect' END AS band FROM e""",
        "completeness": f"""WITH {RECORDS} SELECT model, strategy, count(*) FILTER (error_kind <> 'infrastructure') AS valid, count(*) AS attempted,
            CASE WHEN valid >= 10 THEN 'COMPLETE' ELSE 'PARTIAL' END AS status FROM records GROUP BY model, strategy""",
        "usage_rollup": f"""WITH {LOG}, c AS (SELECT user_id AS model, event_type = 'error' AS f, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN k END AS i, CASE WHEN event_type = 'purchase' THEN floor(value)::BIGINT END AS o FROM log)
            SELECT model, count(*) AS requests, count(*) FILTER (f) AS failed_requests, sum(coalesce(i, 0))::BIGINT AS input_tokens, sum(coalesce(o, 0))::BIGINT AS output_tokens,
              bool_or(NOT f AND i IS NULL AND o IS NULL) AS incomplete FROM c GROUP BY model""",
        "latest_wins": "SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
        "first_wins": "SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
        "resume_index": f"WITH {INDEX} SELECT c_custkey, event_id, retry FROM idx",
        "resume_done": f"WITH {INDEX} SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT c_custkey FROM idx WHERE event_id IS NOT NULL)",
        "resume_todo": f"WITH {INDEX} SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM idx WHERE event_id IS NOT NULL)",
        "pending_indices": "SELECT unnest(range((SELECT max(doc_id) + 1 FROM documents))) AS id EXCEPT SELECT doc_id FROM labels",
        "merge_fresh": """WITH f AS (SELECT user_id, event_id, ts, event_type FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
            o AS (SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1)
            SELECT * FROM f UNION ALL SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM f)""",
        "experiment_matrix": "SELECT r_name AS model, n_name AS strategy, item_id FROM region, nation, benchmark",
        "conversation_shapes": f"""WITH t AS (SELECT conv_id, turn, role, text, {BLANK}, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
            h AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth, role, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role <> 'system'),
            a AS (SELECT conv_id, bool_or(role <> CASE WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END) OR any_value(n) % 2 = 1 AS bad FROM h GROUP BY conv_id)
            SELECT conv_id, count(*) FILTER (role = 'user') AS user_turns, array_to_string(list_filter([
                CASE WHEN count(*) < 3 THEN 'too_few_messages' END, CASE WHEN bool_or(nth = 1 AND role <> 'system') THEN 'system_not_first' END, CASE WHEN bool_or(nth = n AND role <> 'assistant') THEN 'assistant_not_last' END,
                CASE WHEN bool_or(role NOT IN ('system', 'user', 'assistant')) THEN 'unknown_role' END, CASE WHEN bool_or(blank) THEN 'blank_message' END, CASE WHEN count(*) FILTER (role = 'system') > 1 THEN 'several_system_messages' END,
                CASE WHEN bool_or(role = 'system' AND length(text) > 400) THEN 'long_system_message' END, CASE WHEN any_value(bad) THEN 'roles_do_not_alternate' END], lambda x: x IS NOT NULL), ',') AS problems
            FROM t LEFT JOIN a USING (conv_id) GROUP BY conv_id""",
        "turn_histogram": "SELECT user_turns, count(*) AS n FROM (SELECT conv_id, count(*) FILTER (role = 'user') AS user_turns FROM conversations GROUP BY conv_id) GROUP BY user_turns",
        "chat_records": """SELECT conv_id, sha256('[' || string_agg('{"content": ' || to_json(coalesce(text, '')) || ', "role": ' || to_json(role) || '}', ', ' ORDER BY turn) || ']') AS json_sha256,
            sha256(coalesce(string_agg('[' || role || '] ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) FILTER (role <> 'system'), '')) AS text_sha256,
            coalesce(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) FILTER (role = 'system'), '') AS system FROM conversations GROUP BY conv_id""",
        "turn_checks": f"""WITH t AS (SELECT conv_id, turn, text, {_prose("text")} AS prose, {BLANK} FROM conversations WHERE role = 'assistant'),
            c AS (SELECT conv_id, turn, list_filter([{CHECKS}], lambda x: x IS NOT NULL) AS b, {LONG} AS long, {WORDS} AS words, {QUESTIONS} AS questions FROM t)
            SELECT conv_id, turn, array_to_string(b || list_filter([long], lambda x: x IS NOT NULL), ',') AS violations, array_to_string(b, ',') AS blocking, words, questions,
              round(least(CASE WHEN len(list_filter(b, lambda x: x <> 'EMPTY_RESPONSE')) > 0 THEN 0.3::DOUBLE ELSE 1::DOUBLE END, (1::DOUBLE - list_sum([0.0::DOUBLE] || list_transform(b, lambda x: CASE x WHEN 'SOLUTION_LEAK' THEN 0.3::DOUBLE WHEN 'EXPLICIT_FINAL_DIAGNOSIS' THEN 0.3::DOUBLE
                WHEN 'MULTIPLE_HINTS' THEN 0.15::DOUBLE WHEN 'PREMATURE_CONFIRMATION' THEN 0.15::DOUBLE ELSE 0::DOUBLE END)) - CASE WHEN long IS NOT NULL THEN 0.05::DOUBLE ELSE 0::DOUBLE END + 0.2::DOUBLE - 0.05::DOUBLE) / 1.2::DOUBLE), 9) AS adherence,
              CASE WHEN len(b) = 0 THEN 1.0::DOUBLE WHEN list_has_any(b, ['SOLUTION_LEAK', 'EXPLICIT_FINAL_DIAGNOSIS']) THEN 0.0::DOUBLE WHEN list_contains(b, 'PREMATURE_CONFIRMATION') THEN 0.2::DOUBLE ELSE 0.4::DOUBLE END AS robustness FROM c""",
        "judge_verdicts": "SELECT doc_id, quality::DOUBLE AS spec_adherence, toxic / 10 AS robustness, 1.0::DOUBLE AS hint_relevance, toxic = 0 AS passed, 'SOLUTION_LEAK' AS reasons FROM labels",
        "combined_verdicts": f"""WITH t AS (SELECT doc_id, text, quality, toxic, {_prose("text")} AS prose, {BLANK} FROM documents LEFT JOIN labels USING (doc_id)),
            c AS (SELECT *, list_filter([{CHECKS}], lambda x: x IS NOT NULL) AS b, list_filter([{LONG}], lambda x: x IS NOT NULL) AS l FROM t)
            SELECT doc_id, len(b) = 0 AND quality IS NOT NULL AND quality = 1 AND coalesce(toxic, 0) <> 1 AS passed,
              array_to_string(CASE WHEN len(b) > 0 THEN b || l WHEN quality IS NULL THEN l || ['LOW_QUALITY'] WHEN toxic = 1 THEN l || ['SOLUTION_LEAK'] ELSE l END, ',') AS reasons FROM c""",
        "gate_verdicts": f"WITH RECURSIVE {GATE} SELECT doc_id, status, stage, array_to_string(codes, ',') AS codes FROM gated",
        "gate_funnel": f"WITH RECURSIVE {GATE} SELECT coalesce(stage, 'accepted') AS stage, status, count(*) AS n FROM gated GROUP BY ALL",
        "gate_report": f"""WITH RECURSIVE {GATE} SELECT count(*) AS candidates, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected,
            count(*) FILTER (status = 'unjudged') AS unjudged, accepted / nullif(accepted + rejected, 0) AS acceptance_rate FROM gated""",
        "global_ranks": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events",
    }
