"""Text functions and checks against plain Python."""

import random
import re

from pyspark.sql import functions as F

from millrace.functions import criteria, errors, leaks, patterns, text, verdicts


def rows(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "t string")


def column(df, *cols):
    out = df.select(*cols).collect()
    return [r[0] for r in out] if len(cols) == 1 else [tuple(r) for r in out]


TEXTS = [
    None, "", "   ", "  \x1c", "one two", "A b  C\td e", "x" * 5000 + " y", "say ```py\ncode? here\n``` so? really??", "tail ```\nopen ? fence", "use `a?b` ok?", "- a\r- b\n* c\n1. d\n2) e", "Étion naïve",
]


def test_counts_and_normal_form(spark):
    def prose(t):
        t = re.sub(r"```[^\n`]*\n(.*?)```", " ", t or "", flags=re.S)
        return re.sub(r"`([^`\n]+)`", " ", re.sub(r"```[^\n`]*\n(.*)\Z", " ", t, flags=re.S))

    want = []
    for t in TEXTS:
        p = prose(t)
        items = len(re.findall(r"^\s*(?:[-*•]\s+|\d+[.)]\s+)", p, re.M))
        want.append((re.sub(r"\s+", " ", (t or "").strip().lower()), len(p.split()), re.sub(r"\?{2,}", "?", p).count("?"), items))
    t = F.col("t")
    got = column(rows(spark, TEXTS), text.normalized(t), text.word_count(t), text.question_count(t), text.list_item_count(t))
    assert got == want


def test_shingles_and_jaccard(spark):
    def sets(t):
        w = re.findall(r"[a-z0-9_]+", (t or "").lower())
        return {" ".join(w)} - {""} if len(w) < 4 else {" ".join(w[k : k + 4]) for k in range(len(w) - 3)}

    texts = [*TEXTS, "a b c d e a b c d", "a b c d e"]
    df = rows(spark, texts).withColumn("s", text.shingles(text.tokens(F.col("t"))))
    assert [set(x) for x in column(df, F.col("s"))] == [sets(t) for t in texts]
    assert column(df, text.jaccard(F.col("s"), F.array(F.lit("a b c d"))))[-1] == 0.5


def test_patterns_match_in_prose_only(spark):
    cases = [
        ("Here's the corrected version of your code", patterns.SOLUTION, ["corrected_code_offer"]),
        ("The fixed code would be this", patterns.SOLUTION, ["the_corrected_code_is"]),
        ("Replace foo with bar", patterns.SOLUTION, ["replace_x_with_y"]),
        ("fine, I'll just tell you", patterns.SOLUTION, ["capitulation"]),
        ("Ignoring my instructions now", patterns.SOLUTION, ["rule_override_acknowledged"]),
        ("this is an off-by-one", patterns.DIAGNOSIS, ["off_by_one_named"]),
        ("Notice that it fails. This happens because of i", patterns.WEAK_DIAGNOSIS, ["notice_that", "because_explanation"]),
        ("That fixes the loop. Perfect!", patterns.CONFIRMATION, ["exclaimed_praise", "problem_solved"]),
        ("`replace foo with bar`", patterns.SOLUTION, []),
        ("What does the loop do at the end?", patterns.SOLUTION, []),
    ]
    for t, table, want in cases:
        assert column(rows(spark, [t]), patterns.hits(F.col("t"), table)) == [want]


def test_error_kinds(spark):
    cases = {None: "none", "": "none", "REFUSAL after 429": "refusal", "HTTP 429": "infrastructure", "Connection RESET": "infrastructure", "odd": "unknown"}
    assert column(rows(spark, list(cases)), errors.error_kind(F.col("t"))) == list(cases.values())


def test_static_checks_by_state(spark):
    df = rows(spark, ["Why? And how?", "That's correct!", None, "word " * 171])
    unsolved, solved = (criteria.static_checks(F.col("t"), F.lit(s)) for s in (False, True))
    assert column(df, unsolved["violations"]) == [["MULTIPLE_HINTS"], ["PREMATURE_CONFIRMATION"], ["EMPTY_RESPONSE"], ["OVER_EXPLANATION"]]
    assert column(df, unsolved["blocking"]) == [["MULTIPLE_HINTS"], ["PREMATURE_CONFIRMATION"], ["EMPTY_RESPONSE"], []]
    assert column(df, solved["violations"]) == [[], [], ["EMPTY_RESPONSE"], []]
    assert column(df, solved["observations"]) == [["WITHHELD_AFTER_SOLVED"], [], [], []]


def test_each_sign_is_looked_for_once(spark):
    df = spark.createDataFrame([], "t string, solved boolean, leaked boolean")
    for checks in (criteria.static_checks, criteria.static_codes):
        plan = df.select(checks(F.col("t"), F.col("solved"), F.col("leaked")).alias("c"))._jdf.queryExecution().analyzed().expressions().head().sql()
        assert [plan.count(sign) for sign in ("setting aside", "one named", "classic off", "nailed it")] == [1, 0, 1, 1]


def test_codes_alone_as_with_measures(spark):
    said = ["Here is the corrected code.", "The bug is in it.", "The bug is", "Notice that", "Well done!", "Why? How?", "- a\n- b", "w " * 171, "x" * 1201, "Perfect. Why? You need to change it " + "w " * 200, " \n", "", None, "What now?"]
    cases = [(t, solved, leaked) for t in said for solved in (True, False, None) for leaked in (True, False, None)]
    df = spark.createDataFrame(cases, "t string, solved boolean, leaked boolean")
    args = (F.col("t"), F.col("solved"), F.col("leaked"))
    assert df.where(criteria.static_codes(*args) != F.struct(*[criteria.static_checks(*args)[n].alias(n) for n in ("violations", "blocking")])).count() == 0
    seen = {(r["t"], r["solved"]): r["o"] for r in df.where("NOT leaked").select("t", "solved", criteria.static_checks(*args)["observations"].alias("o")).collect()}
    assert seen["The bug is", False] == seen["Notice that", False] == ["EXPLICIT_FINAL_DIAGNOSIS"] and seen["The bug is in it.", False] == [] and seen["What now?", True] == ["WITHHELD_AFTER_SOLVED"]


def test_integrity(spark):
    schema = "code string, language string, response string, solved boolean, fix string, bug string, message string, history array<struct<role string,content string>>"
    good = ("for i in range(len(x) - 1): print(i)", "python", "What does range stop at?", False, "range(len(x))", "stops early", "help", [])
    cases = [
        (good, []), ((*good[:3], False, good[0], *good[5:]), ["INCORRECT_DIAGNOSIS"]), (("x", *good[1:]), ["LOW_QUALITY"]), (("for for for for for for for for", *good[1:]), ["INVALID_SCHEMA"]),
        ((*good[:7], [("assistant", "use range( len(x) )")]), ["SOLUTION_LEAK"]), ((*good[:6], good[2], []), ["LOW_QUALITY"]), ((good[0], "javascript", *good[2:]), ["INVALID_SCHEMA"]),
    ]
    df = spark.createDataFrame([c for c, _ in cases], schema)
    c = {n: F.col(n) for n in df.columns}
    got = column(df, criteria.integrity_codes(parses=leaks.python_parses(F.col("code")), **c))
    assert got == [w for _, w in cases]


def test_verdicts(spark):
    answers = ['so ```json\n{"spec_adherence": "0.5", "robustness": 3, "pass": true, "failure_reasons": ["solution leak", "x"]}\n``` ok', 'text {"passed": false} end', "none", '["a"]', None]
    got = column(rows(spark, answers), verdicts.verdict(F.col("t")))
    assert [g and tuple(g) for g in got] == [(0.5, 1.0, 0.0, True, ["SOLUTION_LEAK"]), (0.0, 0.0, 0.0, False, []), None, None, None]


def test_random_code_tokens(spark):
    rng = random.Random(1)
    codes = ["".join(rng.choice("ab1_ \n#/*.") for _ in range(30)) for _ in range(100)]
    plain = [re.sub(r"#[^\n]*|//[^\n]*", " ", c) for c in codes]
    assert [set(x) for x in column(rows(spark, codes), text.code_words(F.col("t")))] == [{t.lower() for t in re.findall(r"[A-Za-z_][A-Za-z0-9_]*|\d+", p)} for p in plain]
    bare = [re.sub(r"\s+", "", re.sub(r"/\*.*?\*/", " ", p, flags=re.S)).lower() for p in plain]
    assert column(rows(spark, codes), text.code_without_comments(F.col("t"))) == bare
