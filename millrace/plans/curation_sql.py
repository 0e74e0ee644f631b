"""DuckDB SQL for the queries of ``curation``, written from the definitions and not from the Spark code."""

from __future__ import annotations

from millrace.functions.errors import INFRASTRUCTURE
from millrace.functions.judging import DIAGNOSES, STOP
from millrace.operators.audit import MARKERS
from millrace.plans.oracle import BLANK, CHECKS, DOCS, LOG, LONG, RECORDS, WS, _cells, _kept, _norm, _overlap, _prose
from millrace.sources.plan import CATEGORIES, PRESSURE_WEIGHTS, TURN_WEIGHTS

FULL = "lambda x: x IS NOT NULL"
TURNS = """
turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, coalesce(lag(text, 1) OVER w, '') AS message, coalesce(lag(text, 2) OVER w, '') AS code, coalesce(lag(text, 3) OVER w, '') AS fix,
    CASE WHEN conv_id % 2 = 0 THEN 'python' ELSE 'javascript' END AS language, turn >= 3 AS solved,
    coalesce(list({'role': role, 'content': coalesce(text, '')}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), []) AS history
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
),
cand AS (SELECT * FROM turns WHERE role = 'assistant')"""
DECIDED = f"{RECORDS}, decided AS (SELECT *, CASE WHEN judged IS NULL THEN 'unjudged' WHEN passed THEN 'accepted' ELSE 'rejected' END AS status FROM (SELECT records.*, labels.quality AS judged FROM records LEFT JOIN labels ON doc_id = id))"


def _bare(code: str) -> str:
    return rf"lower(regexp_replace(regexp_replace(regexp_replace(coalesce({code}, ''), '(?:#|//)[^\n]*', '', 'g'), '(?s)/\*.*?\*/', '', 'g'), '{WS}+', '', 'g'))"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


INTEGRITY = f"""list_distinct(list_filter([
    CASE WHEN length(code) NOT BETWEEN 25 AND 1600 THEN 'LOW_QUALITY' END,
    CASE WHEN language = 'javascript' AND (regexp_matches(code, '(?m)^{WS}*(?:def|elif){WS}') OR NOT regexp_matches(code, 'function|=>|const |let |var |class |return|await|\\{{')) THEN 'INVALID_SCHEMA' END,
    CASE WHEN length(text) NOT BETWEEN 15 AND CASE WHEN solved THEN 2400 ELSE 1200 END THEN 'LOW_QUALITY' END,
    CASE WHEN {_bare("fix")} = {_bare("code")} OR {_bare("fix")} IN ('', 'none', 'n/a') OR lower(trim(message)) = lower(trim(fix)) THEN 'INCORRECT_DIAGNOSIS' END,
    CASE WHEN lower(trim(text)) = lower(trim(message)) THEN 'LOW_QUALITY' END,
    CASE WHEN NOT solved AND length({_bare("fix")}) >= 8 AND len(list_filter(history, lambda h: h.role = 'assistant' AND contains({_bare("h.content")}, {_bare("fix")}))) > 0 THEN 'SOLUTION_LEAK' END
  ], {FULL}))"""


def _sorted(codes: str) -> str:
    return f"array_to_string({codes}, ',')"


def _u(name: str) -> str:
    return f"(('0x' || substr(sha256(seed || '|{name}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _choice(name: str, values: tuple) -> str:
    listed = ", ".join(repr(v) for v in values)
    return f"([{listed}])[1 + floor({_u(name)} * {len(values)})::INT]"


def _weighted(name: str, weights: dict) -> str:
    seen, out = 0, "CASE"
    for value, weight in weights.items():
        seen += weight
        out += f" WHEN {_u(name)} * {sum(weights.values())} < {seen} THEN {value!r}"
    return out + " END"


def _plan(count: str, base: int) -> str:
    return f"""
plan1 AS (SELECT {base} + unnest(range({count})) AS seed),
plan2 AS (SELECT seed, {_choice("language", ("python", "javascript"))} AS language, {_weighted("pressure", PRESSURE_WEIGHTS)} AS pressure, {_weighted("turns", TURN_WEIGHTS)} AS drawn FROM plan1),
plan3 AS (
  SELECT *, CASE WHEN drawn = 0 AND pressure IN ('repeated_answer_request', 'fake_success', 'solved') THEN {_choice("later", (1, 2))} ELSE drawn END AS turns,
    CASE WHEN pressure = 'solved' THEN 'solved' WHEN pressure = 'almost_correct' THEN 'close' WHEN pressure = 'fake_success' THEN {_choice("progress", ("partial", "close"))}
      ELSE {_choice("progress", ("stuck", "stuck", "partial", "close"))} END AS progress FROM plan2
)"""


ANSWERS = f"""
answers AS (
  SELECT conv_id, turn, text, {_prose("text")} AS prose, {BLANK}, conv_id % 5 = 4 AS away, turn = 5 AS broken, CASE conv_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.95 ELSE 1.0 END AS adherence
  FROM conversations WHERE role = 'assistant'
)"""


def sql() -> dict[str, str]:
    """Name -> SQL."""
    marks = " OR ".join(f"contains(text, '{m}')" for m in MARKERS)
    stop = ", ".join(f"'{w}'" for w in STOP)
    diagnoses = " ".join(f"WHEN contains(e, '{m}') THEN '{v}'" for m, v in DIAGNOSES)
    transient = " OR ".join(f"contains(e, '{m}')" for m in INFRASTRUCTURE)
    told = f"list_transform(history, lambda h, i: {{'role': h.role, 'content': CASE WHEN i = 1 THEN fence || {_strip('h.content')} ELSE h.content END}})"
    axes = " UNION ALL ".join(f"SELECT 'distribution', '{name}=' || coalesce({c}, ''), count(*), count(*) / (SELECT count(*) FROM acc) FROM acc GROUP BY {c}" for name, c in (("lang", "strategy"), ("source", "model"), ("pressure", "pressure")))
    return {
        "candidate_integrity": f"WITH {TURNS} SELECT conv_id, turn, {_sorted(_ordered(INTEGRITY))} AS codes FROM cand",
        "static_screening": f"""WITH {TURNS}, c AS (SELECT *, {_prose("text")} AS prose, {BLANK} FROM cand), d AS (SELECT conv_id, turn, {_ordered(INTEGRITY)} AS i, list_filter([{CHECKS}], {FULL}) AS b, list_filter([{LONG}], {FULL}) AS l FROM c)
            SELECT conv_id, turn, array_to_string(i || list_filter(b, lambda x: NOT list_contains(i, x)) || l, ',') AS codes FROM d""",
        "identity_hashes": f"""WITH {TURNS}, s AS (SELECT conv_id, turn, text, sha256({_norm("code")} || chr(10) || {_norm("message")} || chr(10) || array_to_string(list_transform(history, lambda h: {_norm("h.content")}), chr(10))) AS scenario FROM cand)
            SELECT conv_id, turn, scenario, sha256(scenario || chr(10) || {_norm("text")}) AS candidate, sha256(scenario || chr(10) || regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), '^ | $', '', 'g')) AS verdict FROM s""",
        "code_metrics": rf"""SELECT doc_id, length({_bare("text")}) AS bare_chars, len(list_distinct(list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '(?:#|//)[^\n]*', ' ', 'g'), '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'), lambda w: lower(w)))) AS words,
            sha256({_bare("text")}) AS bare_sha256 FROM documents""",
        "training_texts": f"""WITH {TURNS}, f AS (SELECT *, '```' || language || chr(10) || {_strip("code")} || chr(10) || '```' || chr(10) || chr(10) AS fence FROM cand),
            m AS (SELECT conv_id, turn, [{{'role': 'system', 'content': 'Help without telling.'}}] || {told} || [{{'role': 'user', 'content': CASE WHEN len(history) = 0 THEN fence ELSE '' END || {_strip("message")}}}, {{'role': 'assistant', 'content': {_strip("text")}}}] AS r FROM f)
            SELECT conv_id, turn, len(r) AS messages, sha256(array_to_string(list_transform(r, lambda x: '[' || x.role || '] ' || x.content), chr(10) || chr(10))) AS text_sha256 FROM m""",
        "judge_prompts": f"""WITH {TURNS} SELECT conv_id, turn, sha256('CONVERSATION' || chr(10) || CASE WHEN len(history) = 0 THEN '(no prior turns — this is the learner''s first message)'
              ELSE array_to_string(list_transform(history, lambda h: CASE WHEN h.role = 'user' THEN 'LEARNER' ELSE 'TUTOR' END || ': ' || {_strip("h.content")}), chr(10) || chr(10)) END
            || chr(10) || chr(10) || 'MESSAGE' || chr(10) || message || chr(10) || chr(10) || 'RESPONSE' || chr(10) || text || chr(10)) AS prompt_sha256 FROM cand""",
        "built_candidates": f"""WITH {TURNS}, p AS (SELECT conv_id, turn, {_strip("replace(code, '`', '')")} AS own, list_filter([
              CASE WHEN code = '' THEN 'missing_code' END, CASE WHEN {_strip("message")} = '' THEN 'missing_student_message' END, CASE WHEN turn = 5 THEN 'missing_expected_fix' END, CASE WHEN {_strip("text")} = '' THEN 'missing_tutor_response' END,
              CASE WHEN turn >= 2 AND len(history) = 0 THEN 'history_missing' END, CASE WHEN len(list_filter(history, lambda h: h.role NOT IN ('user', 'assistant') OR {_strip("h.content")} = '')) > 0 THEN 'history_bad_turn' END,
              CASE WHEN len(history) % 2 <> 0 THEN 'history_incomplete' END], {FULL}) AS problems FROM cand)
            SELECT conv_id, turn, array_to_string(problems, ',') AS problems, CASE WHEN len(problems) = 0 THEN sha256(own) END AS code_sha256, CASE WHEN len(problems) = 0 THEN 'a bug' END AS bug FROM p""",
        "evaluated_turns": f"""WITH {ANSWERS}, c AS (SELECT *, list_filter([{CHECKS}], {FULL}) AS b, list_filter([{LONG}], {FULL}) AS l FROM answers)
            SELECT conv_id, turn, NOT broken AND len(b) = 0 AND NOT away AND adherence >= 0.8 AS passed,
              array_to_string(CASE WHEN broken THEN ['MODEL_ERROR'] WHEN len(b) > 0 THEN b || l ELSE l || ['LOW_QUALITY'] END, ',') AS reasons, CASE WHEN broken THEN 'infrastructure' ELSE 'none' END AS error_kind, away AND NOT broken AS unjudged FROM c""",
        "judge_warnings": f"""WITH {ANSWERS} SELECT conv_id, turn, CASE WHEN away THEN 'judge_unavailable' ELSE array_to_string(list_filter([CASE WHEN conv_id % 3 = 2 THEN 'spec_adherence: out of range' END, 'hint_relevance: no number',
            CASE WHEN turn = 3 THEN 'pass: no boolean' END, 'unknown code: ODD_ONE'], {FULL}), '; ') END AS warnings FROM answers""",
        "static_relevance": f"""WITH {TURNS}, w AS (SELECT conv_id, turn, text, list_filter(regexp_extract_all(lower(code), '[a-z_][a-z0-9_]{{2,}}'), lambda x: x NOT IN ({stop})) AS w, {BLANK} FROM cand)
            SELECT conv_id, turn, CASE WHEN blank THEN 0.0 WHEN len(w) = 0 OR len(list_filter(w, lambda x: contains(lower(text), x))) > 0 THEN 0.8 ELSE 0.5 END::DOUBLE AS relevance FROM w""",
        "judge_rows": f"""WITH {RECORDS}, j AS (SELECT *, CASE WHEN adherence IS NULL THEN NULL WHEN strategy = 'en' THEN family || ':large' WHEN strategy = 'fr' THEN 'deterministic-1' ELSE 'other' END AS judge FROM records),
            f AS (SELECT *, CASE WHEN judge IS NULL THEN 'unknown' WHEN strategy = 'de' THEN 'src1' WHEN strategy = 'en' THEN family WHEN strategy = 'fr' THEN 'deterministic' ELSE 'unknown' END AS judge_family FROM j)
            SELECT id, coalesce(judge, 'unknown') AS judge_model, judge_family, CASE WHEN judge_family NOT IN ('unknown', 'deterministic') THEN (judge_family = family)::VARCHAR ELSE 'unknown' END AS self_judged FROM f""",
        "real_records": f"WITH {RECORDS} SELECT pressure, count(*) AS n FROM records WHERE strategy <> 'fr' GROUP BY pressure",
        "error_diagnoses": f"""WITH e AS (SELECT lower(CASE event_type WHEN 'error' THEN 'Error code: 429 rate_limit exceeded for ' || user_id WHEN 'signup' THEN 'CONNECTION RESET by peer' WHEN 'purchase' THEN 'Billing hard limit' WHEN 'view' THEN 'odd' END) AS e FROM events)
            SELECT CASE WHEN e IS NULL THEN NULL {diagnoses} WHEN {transient} THEN 'INFRASTRUCTURE' ELSE 'UNKNOWN_ERROR' END AS verdict, count(*) AS n FROM e GROUP BY verdict""",
        "cached_verdicts": f"""WITH d AS (SELECT doc_id, {_norm("text")} AS k FROM documents), c AS (SELECT k, arg_min(quality, doc_id) AS quality FROM d JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY k)
            SELECT doc_id, coalesce(quality, -1) AS quality FROM d LEFT JOIN c USING (k)""",
        "graded_agreement": """WITH g AS (SELECT quality = 1 AS a, CASE WHEN toxic = 0 THEN true WHEN doc_id % 3 = 0 THEN NULL ELSE false END AS b FROM labels),
            c AS (SELECT count(*) AS n, count(*) FILTER (a AND b) AS yes_yes, count(*) FILTER (a AND NOT b) AS yes_no, count(*) FILTER (NOT a AND b) AS no_yes, count(*) FILTER (NOT a AND NOT b) AS no_no FROM g WHERE a IS NOT NULL AND b IS NOT NULL),
            e AS (SELECT *, (yes_yes + no_no) / nullif(n, 0) AS agreement, ((yes_yes + yes_no) * (yes_yes + no_yes) + (n - yes_yes - yes_no) * (n - yes_yes - no_yes)) / nullif(n * n, 0) AS pe FROM c)
            SELECT n, yes_yes, yes_no, no_yes, no_no, agreement, CASE WHEN abs(1 - pe) >= 1e-12 THEN (agreement - pe) / (1 - pe) END AS kappa FROM e""",
        "dataset_audit": f"""WITH RECURSIVE {DECIDED}, acc AS (SELECT * FROM decided WHERE status = 'accepted'), texts AS (SELECT id, text FROM acc), {_kept("texts", "a")}, {_overlap("texts")},
            firsts AS (SELECT count(DISTINCT {_norm("text")}) AS c FROM texts), n AS (SELECT count(*) AS n FROM acc), r AS (SELECT unnest(reasons) AS code FROM decided WHERE status = 'rejected')
            SELECT section, key, n::BIGINT AS n, share::DOUBLE AS share FROM (
              SELECT 'counts' AS section, status AS key, count(*) AS n, count(*) / (SELECT count(*) FROM decided) AS share FROM decided GROUP BY status
              UNION ALL {axes}
              UNION ALL SELECT 'coverage', 'answer_seeking', count(*) FILTER (pressure IN ('frustrated', 'repeated_answer_request', 'time_pressure')) AS x, x / count(*) FROM acc
              UNION ALL SELECT 'coverage', 'injection_or_authority', 0, 0
              UNION ALL SELECT 'rejections', code, count(*), count(*) / (SELECT count(*) FROM decided) FROM r GROUP BY code
              UNION ALL SELECT 'diversity', 'exact_duplicates', n.n - c, (n.n - c) / n.n FROM n, firsts
              UNION ALL SELECT 'diversity', 'near_duplicates', c - (SELECT count(*) FROM kepta), (c - (SELECT count(*) FROM kepta)) / n.n FROM n, firsts
              UNION ALL SELECT 'diversity', 'distinct_texts', c, c / n.n FROM n, firsts
              UNION ALL SELECT 'contamination', 'exact_overlaps', (SELECT count(*) FROM exact), (SELECT count(*) FROM exact) / n.n FROM n
              UNION ALL SELECT 'contamination', 'near_overlaps', (SELECT count(DISTINCT id) FROM near WHERE similarity >= 0.6), (SELECT count(DISTINCT id) FROM near WHERE similarity >= 0.6) / n.n FROM n)""",
        "balance_greedy": f"""WITH RECURSIVE {RECORDS}, r AS MATERIALIZED (SELECT id AS doc_id, strategy AS lang, pressure, model AS source, row_number() OVER (ORDER BY id) AS nth, count(*) OVER () AS n FROM records),
            walk(nth, l, p, s, kept) AS (
              SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], false
              UNION ALL SELECT m, CASE WHEN ok THEN list_append(l, lang) ELSE l END, CASE WHEN ok THEN list_append(p, pressure) ELSE p END, CASE WHEN ok THEN list_append(s, source) ELSE s END, ok FROM (
                SELECT walk.l, walk.p, walk.s, r.nth AS m, lang, pressure, source,
                  len(list_filter(l, lambda x: x = lang)) < greatest(1, ceil(n * 0.5::DOUBLE)) AND len(list_filter(p, lambda x: x = pressure)) < greatest(1, ceil(n * 0.28::DOUBLE)) AND len(list_filter(s, lambda x: x = source)) < greatest(1, ceil(n * 0.1::DOUBLE)) AS ok
                FROM walk JOIN r ON r.nth = walk.nth + 1)
            ) SELECT doc_id, lang, pressure, source, kept FROM walk JOIN r USING (nth)""",
        "audit_axes": f"""WITH {RECORDS}, r AS (SELECT model, family, strategy, pressure, passed::VARCHAR AS passed, error_kind, CASE WHEN pressure = 'solved' THEN 'solved' WHEN pressure = 'frustrated' THEN 'almost_correct' ELSE 'unresolved' END AS state,
              floor(log10(length(text) + 1))::BIGINT::VARCHAR AS digits, (adherence IS NOT NULL)::VARCHAR AS judged, len(reasons)::VARCHAR AS reasons, sha256({_norm("text")}) AS h FROM records),
            g AS (SELECT {AXIS_OF} AS axis, coalesce({", ".join(AXES)}) AS bucket, count(*) AS n, count(DISTINCT h) AS texts, count(DISTINCT model) AS models FROM r GROUP BY GROUPING SETS ({", ".join(f"({a})" for a in AXES)}, ()))
            SELECT *, n / (SELECT n FROM g WHERE axis = 'all') AS share FROM g""",
        "audit_provenance": f"""WITH {RECORDS}, f AS (SELECT * FROM records QUALIFY row_number() OVER (ORDER BY id) = 1) SELECT unnest(['model', 'family', 'strategy', 'error_kind']) AS field,
            unnest([f.model, f.family, f.strategy, f.error_kind]) AS first, unnest((SELECT [count(DISTINCT model), count(DISTINCT family), count(DISTINCT strategy), count(DISTINCT error_kind)] FROM records)) AS different FROM f""",
        "seeded_order": f"""WITH RECURSIVE s AS (SELECT n, h, greatest(1, ceil(n / h)::BIGINT) AS w FROM (SELECT n, floor(sqrt(n - 1))::BIGINT + 1 AS h FROM (SELECT count(*) AS n FROM documents))),
            walk(doc_id, place, steps) AS (
              SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1, 0 FROM documents
              UNION ALL SELECT doc_id, l4 * w + r4, steps + 1 FROM (
                SELECT *, (l3 + {_moved(6, "r3")}) % h AS l4, (r3 + {_moved(7, "l4")}) % w AS r4 FROM (
                SELECT *, (l2 + {_moved(4, "r2")}) % h AS l3, (r2 + {_moved(5, "l3")}) % w AS r3 FROM (
                SELECT *, (l1 + {_moved(2, "r1")}) % h AS l2, (r1 + {_moved(3, "l2")}) % w AS r2 FROM (
                SELECT *, (place // w + {_moved(0, "(place % w)")}) % h AS l1, (place % w + {_moved(1, "l1")}) % w AS r1 FROM walk, s WHERE steps = 0 OR place >= n))))
            ) SELECT doc_id, place FROM walk, s WHERE steps > 0 AND place < n""",
        "frozen_manifest": f"""WITH {RECORDS}, r AS (SELECT id, strategy AS version, passed, adherence, sha256({_norm("text")}) AS d FROM records WHERE adherence IS NOT NULL),
            a AS (SELECT version, count(*) AS n, {HASH} AS h FROM r WHERE passed AND (version <> 'de' OR id % 2 = 0) GROUP BY version),
            v AS (SELECT unnest(['de', 'en', 'es', 'fr']) AS version), w AS (SELECT version, version <> 'fr' OR NOT EXISTS (FROM records WHERE strategy = 'fr' AND adherence IS NULL) AS whole FROM v)
            SELECT version, whole AND n IS NOT NULL AS frozen, (CASE WHEN NOT frozen THEN 0 WHEN version = 'de' THEN 2 ELSE 1 END)::BIGINT AS number, CASE WHEN frozen THEN n ELSE 0 END AS accepted_count, CASE WHEN frozen THEN h ELSE '' END AS dataset_hash FROM w LEFT JOIN a USING (version)""",
        "journaled_verdicts": "SELECT doc_id AS key, CASE WHEN toxic = 1 THEN 'second' ELSE 'first' END AS verdict FROM labels",
        "gate_status": f"""WITH {DECIDED} SELECT count(*) AS candidates, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'unjudged') AS unjudged,
            count(*) FILTER (status <> 'unjudged') AS judged, bool_and(status <> 'unjudged') AS complete, round(coalesce(count(*) FILTER (status = 'accepted') / nullif(count(*) FILTER (status <> 'unjudged'), 0), 0), 4) AS acceptance_rate, true AS conserved FROM decided""",
        "training_checks": f"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, {BLANK} FROM conversations),
            e AS (SELECT conv_id, count(*) AS n, arg_min(role, turn) AS first, arg_max(role, turn) AS last, arg_min(text, turn) AS system, count(*) FILTER (role NOT IN ('system', 'user', 'assistant')) AS strange, count(*) FILTER (blank) AS blank, count(*) FILTER ({marks}) AS leaks FROM t GROUP BY conv_id),
            l AS (SELECT 'record_shape' AS "check", count(*) FILTER (n < 3) AS bad FROM e UNION ALL SELECT 'role_order', count(*) FILTER (first <> 'system' OR last <> 'assistant') FROM e UNION ALL SELECT 'roles_known', sum(strange) FROM e
              UNION ALL SELECT 'no_empty_messages', count(*) FILTER (blank > 0) FROM e UNION ALL SELECT 'single_system_prompt', count(DISTINCT system) - 1 FROM e UNION ALL SELECT 'weak_prompt', count(*) FILTER (length(system) > 400) FROM e
              UNION ALL SELECT 'no_metadata_leak', sum(leaks) FROM e)
            SELECT "check", bad = 0 AS passed, bad::BIGINT AS bad FROM l""",
        "subset_drift": f"""WITH r AS (SELECT lang AS bucket, row_number() OVER (ORDER BY sha256({_norm("text")}), doc_id) AS rank FROM documents), c AS (SELECT unnest([125, 250, 500, 1000])::BIGINT AS subset),
            a AS (SELECT subset, bucket, count(*) FILTER (rank <= subset) / least(subset, (SELECT count(*) FROM r)) AS share, count(*) / (SELECT count(*) FROM r) AS full_share FROM r, c GROUP BY subset, bucket)
            SELECT subset, bucket, share, full_share, share - full_share AS drift, max(abs(share - full_share)) OVER (PARTITION BY subset) AS max_drift FROM a""",
        "nesting_checks": """SELECT smaller::BIGINT AS smaller, larger::BIGINT AS larger, true AS is_subset, 500 NOT IN (smaller, larger) AS is_prefix FROM (VALUES (125, 250), (250, 500), (500, 1000)) v(smaller, larger)""",
        "published_metrics": f"""WITH {RECORDS}, c AS (SELECT strategy, count(*) FILTER (passed) / count(*) AS rate FROM seen GROUP BY strategy)
            SELECT strategy, round(round(rate, 4) + CASE WHEN strategy = 'fr' THEN 0.01 ELSE 0 END, 9) AS published, round(rate, 9) AS recomputed, strategy <> 'fr' AS matches FROM c""",
        "scenario_invariants": f"""WITH h AS (SELECT doc_id, lang = 'en' AS out, {_norm("text")} AS h FROM documents), i AS (SELECT count(*) AS a FROM (SELECT doc_id FROM h GROUP BY doc_id HAVING count(*) > 1)),
            s AS (SELECT count(*) AS b FROM (SELECT h FROM h GROUP BY h HAVING bool_or(out) AND bool_or(NOT out))), c AS (SELECT count(*) FILTER (NOT out) AS c FROM h)
            SELECT a AS repeated_ids, b AS shared_texts, c AS ceiling_rows, a = 0 AND b = 0 AND c >= 30 AS sound FROM i, s, c""",
        "config_problems": "SELECT n_name AS key, n_regionkey::VARCHAR AS prior, (n_regionkey + 1)::VARCHAR AS now FROM nation WHERE n_nationkey % 5 = 0 AND n_nationkey <> 3",
        "version_status": f"""WITH {DECIDED}, p AS (SELECT strategy AS version, count(*) AS candidate_count, count(*) FILTER (status = 'accepted') AS accepted_count FROM decided GROUP BY strategy),
            r AS (SELECT strategy AS version, code, count(*) AS n FROM (SELECT strategy, unnest(reasons) AS code FROM decided WHERE status = 'rejected') GROUP BY ALL),
            t AS (SELECT version, string_agg(code || '=' || n, ';' ORDER BY n DESC, code) AS top FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY version ORDER BY n DESC, code) <= 5) GROUP BY version)
            SELECT version, CASE WHEN version IN ('en', 'de') THEN 'f-' || version ELSE sha256(version) END AS dataset_hash, version IN ('en', 'de') AS frozen, CASE WHEN version IN ('en', 'de') THEN accepted_count // 2 ELSE -1 END AS selected_count,
              sha256(version) AS accepted_pool_hash, candidate_count, accepted_count, coalesce(top, '') AS top_rejections FROM p LEFT JOIN t USING (version)""",
        "top_rejections": f"WITH {RECORDS} SELECT code, count(*) AS n FROM (SELECT unnest(reasons) AS code FROM records) GROUP BY code ORDER BY n DESC, code LIMIT 2",
        "clean_split": f"WITH {DOCS}, {_overlap('docs')} SELECT id AS doc_id, id IN (SELECT id FROM near WHERE similarity >= 0.6) AS contaminated FROM docs",
        "examples_by_stratum": f"""WITH {RECORDS}, s AS (SELECT id, unnest(list_filter([pressure, CASE WHEN NOT passed AND adherence IS NOT NULL THEN 'failed' END], {FULL})) AS stratum FROM records)
            SELECT stratum, row_number() OVER (PARTITION BY stratum ORDER BY id) AS nth, id FROM s QUALIFY nth <= 2""",
        "first_records": "SELECT doc_id AS id, source AS model, row_number() OVER (ORDER BY doc_id) AS rank FROM documents QUALIFY rank <= 25",
        "cell_keys": "SELECT n_nationkey, trim(regexp_replace(lower(n_name || '-' || r_name), '[^a-z0-9]+', '-', 'g'), '-') AS cell FROM nation JOIN region ON n_regionkey = r_regionkey",
        "learner_states": f"WITH {RECORDS} SELECT CASE WHEN pressure = 'solved' THEN 'solved' WHEN pressure = 'frustrated' THEN 'almost_correct' ELSE 'unresolved' END AS state, count(*) AS n FROM records GROUP BY state",
        "generation_plan": f"""WITH {_plan("2000", 20240101)}
            SELECT seed, language, CASE language WHEN 'python' THEN {_choice("category", CATEGORIES["python"])} ELSE {_choice("category", CATEGORIES["javascript"])} END AS category, {_choice("difficulty", ("easy", "medium", "hard"))} AS difficulty, pressure, turns::BIGINT AS turns,
              {_choice("competence", ("beginner", "intermediate", "advanced"))} AS competence, CASE WHEN pressure IN ('frustrated', 'repeated_answer_request') THEN 'high' ELSE {_choice("frustration", ("none", "none", "mild"))} END AS frustration,
              CASE WHEN {_u("vary")} < 0.25 THEN {_choice("hint", ("nudge", "pointed", "narrow"))} WHEN progress = 'stuck' THEN 'nudge' WHEN progress = 'partial' THEN 'pointed' ELSE 'narrow' END AS hint, progress FROM plan3""",
        "plan_distribution": f"""WITH {_plan("(SELECT count(*) FROM orders)", 7)}, n AS (SELECT count(*) AS n FROM plan3)
            SELECT 'pressure' AS axis, pressure AS bucket, count(*) AS n, count(*) / (SELECT n FROM n) AS share FROM plan3 GROUP BY pressure UNION ALL SELECT 'language', language, count(*), count(*) / (SELECT n FROM n) FROM plan3 GROUP BY language""",
        "malformed_lines": """WITH c AS (SELECT *, c_custkey // 1000 AS part, CASE WHEN c_custkey % 7 = 3 THEN 3 ELSE 1 END AS lines, c_custkey % 7 <> 3 AND c_custkey % 11 = 5 AS torn FROM customer),
            l AS (SELECT *, sum(lines) OVER (PARTITION BY part ORDER BY c_custkey) AS line FROM c)
            SELECT part, line::BIGINT AS line, left('{"c_custkey":' || c_custkey, 9) AS torn FROM l WHERE torn""",
        "resume_stats": f"""WITH {LOG}, e AS (SELECT count(*) AS n, count(*) FILTER (kind <> 'none') AS f FROM log GROUP BY user_id)
            SELECT sum(n)::BIGINT AS records, sum(f)::BIGINT AS infrastructure, count(*) AS keys, count(*) FILTER (f < n) AS reusable, count(*) FILTER (f = n) AS to_retry FROM e""",
        "merged_in_order": """WITH f AS (SELECT user_id, event_id FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
            o AS (SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1), m AS (SELECT * FROM f UNION ALL SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM f)),
            c AS (SELECT c_custkey AS user_id, row_number() OVER (ORDER BY c_name DESC) AS ordinal FROM customer)
            SELECT user_id, event_id, ordinal FROM m JOIN c USING (user_id)""",
        "usage_merged": f"""WITH {LOG}, c AS (SELECT user_id AS model, event_type = 'error' AS f, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN k END AS i, CASE WHEN event_type = 'purchase' THEN floor(value)::BIGINT END AS o FROM log)
            SELECT model, count(*) AS requests, count(*) FILTER (f) AS failed_requests, coalesce(sum(i), 0)::BIGINT AS input_tokens, coalesce(sum(o), 0)::BIGINT AS output_tokens, bool_or(NOT f AND i IS NULL AND o IS NULL) AS incomplete FROM c GROUP BY model""",
        "quota_shortfalls": "WITH q AS (SELECT floor(count(*) * 0.3)::BIGINT AS quota FROM documents) SELECT lang, quota, count(*) AS there, quota - count(*) AS short FROM documents, q GROUP BY lang, quota HAVING count(*) < quota",
        "minimum_size_reason": f"""WITH {RECORDS}, c AS ({_cells("model, strategy")}), s AS (SELECT scenario_count AS n, array_to_string(list_filter([CASE WHEN coalesce(pass_rate >= 0.9, false) THEN NULL ELSE 'pass_rate' END,
              CASE WHEN coalesce(adherence_mean >= 0.9, false) THEN NULL ELSE 'adherence_mean' END, CASE WHEN coalesce(robustness_mean >= 0.85, false) THEN NULL ELSE 'robustness_mean' END], {FULL}), ',') AS short FROM c),
            m AS (SELECT min(n) FILTER (short = '') AS minimum_size, arg_max(short, (n, short)) AS short, max(n) AS largest FROM s)
            SELECT coalesce(minimum_size, -1) AS minimum_size, CASE WHEN largest IS NULL THEN 'no sizes were measured' WHEN minimum_size IS NOT NULL THEN minimum_size || ' rows meet all thresholds' ELSE 'even ' || largest || ' rows are short of: ' || short END AS reason FROM m""",
        "size_decisions": """WITH c AS (SELECT count(*) AS n, count(quality) AS judged, count(*) FILTER (quality = 1) AS good FROM documents LEFT JOIN labels USING (doc_id))
            SELECT n, (CASE WHEN n <= good THEN 0 ELSE greatest(50, ceil(ceil(ceil((n - good) / (good / judged)) * 1.1::DOUBLE) / 50) * 50) END)::BIGINT AS top_up,
              CASE WHEN n >= 1000 THEN '125,250,500,1000' ELSE array_to_string(list_sort(list_distinct(list_transform(list_filter([1, 2, 4, 8], lambda d: n / d >= 8), lambda d: n // d))), ',') END AS sweep FROM c""",
        "scored_candidates": f"""WITH {RECORDS}, j AS (SELECT *, list_filter([CASE WHEN list_contains(reasons, 'SOLUTION_LEAK') THEN 'SOLUTION_LEAK' END, CASE WHEN adherence < 0.9 OR (pressure IN ('frustrated', 'time_pressure') AND robustness < 0.9) THEN 'LOW_QUALITY' END,
              CASE WHEN relevance < 0.75 THEN 'IRRELEVANT_HINT' END], {FULL}) AS c FROM records WHERE adherence IS NOT NULL)
            SELECT array_to_string(CASE WHEN len(c) = 0 AND NOT passed THEN ['LOW_QUALITY'] ELSE c END, ',') AS codes, count(*) AS n, round(avg(relevance), 9) AS relevance FROM j GROUP BY ALL""",
    }


HASH = f"sha256({" || '-' || ".join(f"sum(('0x' || substr(d, {15 * k + 1}, 15))::BIGINT)" for k in range(4))})"
AXES = ("model", "family", "strategy", "pressure", "passed", "error_kind", "state", "digits", "judged", "reasons")
AXIS_OF = "CASE " + " ".join(f"WHEN grouping({a}) = 0 THEN '{a}'" for a in AXES) + " ELSE 'all' END"


def _moved(turn: int, digit: str) -> str:
    return f"('0x' || substr(sha256('20260817|{turn}|' || {digit}), 1, 12))::BIGINT"


def _ordered(codes: str) -> str:
    """Distinct codes in the order in which they come first."""
    inner = codes.removeprefix("list_distinct(").removesuffix(")")
    return f"list_reduce([[]::VARCHAR[]] || list_transform({inner}, lambda c: [c]), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE a || b END)"
