"""Seeded plans against the same definition written out with one generator a seed."""

import random

from pyspark.sql import functions as F

from millrace.plans import registry
from millrace.sources import plan, seeded


def plain(seed):
    g = random.Random(seed)
    pick = lambda w: g.choices(list(w), weights=list(w.values()), k=1)[0]
    language = g.choice(["python", "javascript"])
    pressure, turns = pick(plan.PRESSURE_WEIGHTS), pick(plan.TURN_WEIGHTS)
    if turns == 0 and pressure in {"repeated_answer_request", "fake_success", "solved"}:
        turns = g.choice([1, 2])
    match pressure:
        case "solved":
            progress = "solved"
        case "almost_correct":
            progress = "close"
        case "fake_success":
            progress = g.choice(["partial", "close"])
        case _:
            progress = g.choice(["stuck", "stuck", "partial", "close"])
    frustration = "high" if pressure in {"frustrated", "repeated_answer_request"} else g.choice(["none", "none", "mild"])
    hint = {"stuck": "nudge", "partial": "pointed"}.get(progress, "narrow")
    if g.random() < 0.25:
        hint = g.choice(["nudge", "pointed", "narrow"])
    category = g.choice(plan.CATEGORIES[language])
    difficulty = g.choice(["easy", "medium", "hard"])
    return seed, language, category, difficulty, pressure, turns, g.choice(["beginner", "intermediate", "advanced"]), frustration, hint, progress


def test_ten_thousand_seeds(spark):
    rows = seeded.seeded_plan(spark, 10_000, 20240101, 1_700)
    assert rows.rdd.getNumPartitions() == 6
    got = sorted(map(tuple, rows.collect()))
    assert got == [plain(20240101 + k) for k in range(10_000)]
    assert seeded.seeded_plan(spark, 0).count() == 0


def test_seeds_of_a_table(spark):
    df = spark.createDataFrame([(7, "x"), (7, "y"), (None, "z"), (2**40, "w")], "s long, language_ string")
    got = {r["language_"]: tuple(r)[2:] for r in seeded.with_dimensions(df, F.col("s")).collect()}
    assert got["x"] == got["y"] == plain(7)[1:] and got["w"] == plain(2**40)[1:] and set(got["z"]) == {None}


def test_query_over_documents(spark, sf_dir):
    ids = [r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()]
    want = {}
    for i in ids:
        _, language, _, _, pressure, turns, *_ = plain(20240101 + i)
        n, total = want.get((language, pressure), (0, 0))
        want[language, pressure] = (n + 1, total + turns)
    got = {(r["language"], r["pressure"]): (r["n"], r["turns"]) for r in registry.queries()["seeded_documents"](spark, sf_dir).collect()}
    assert got == want
