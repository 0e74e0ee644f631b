"""Operators against plain loops on small tables."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import balance, dedupe, gates, metrics, ranking, records, resume, select
from millrace.plans import quality_gate


def test_greedy_balance_equals_the_loop(spark):
    rng = random.Random(2)
    shares = {"a": 0.4, "b": 0.2, "c": 0.5}
    rows = [(i * 3, rng.choice("xyz"), rng.choice(["p", "q", "r", "s", None]), rng.choice("mn")) for i in range(300)]
    caps = {k: max(1, math.ceil(v * len(rows))) for k, v in shares.items()}
    counts, want = Counter(), {}
    for i, *buckets in rows:
        keys = list(zip(shares, buckets, strict=True))
        want[i] = all(counts[k] < caps[k[0]] for k in keys)
        counts.update(keys if want[i] else [])
    df = spark.createDataFrame(rows, "i long, a string, b string, c string").repartition(5)
    got = {r["i"]: r["kept"] for r in balance.greedy_balance(df, "i", shares).collect()}
    assert got == want and 0 < sum(want.values()) < 300
    assert balance.greedy_balance(df.limit(0), "i", shares).collect() == []


def test_keep_first_equals_the_loop(spark):
    rng = random.Random(5)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)})
    kept = []
    for j in range(60):
        if not any((i, j) in pairs for i in kept):
            kept.append(j)
    nodes = spark.range(60)
    got = dedupe.keep_first(nodes, spark.createDataFrame(pairs, "i long, j long")).where("kept").collect()
    assert sorted(r["id"] for r in got) == kept


def test_similar_pairs_find_all(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 30))) for _ in range(30)]
    texts += [t + " z" for t in texts] + ["", "été"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")

    def sets(t):
        w = [x for x in t.split() if x.isascii()]
        return {" ".join(w)} - {""} if len(w) < 4 else {" ".join(w[k : k + 4]) for k in range(len(w) - 3)}

    s = [sets(t) for t in texts[:-1]]
    want = {(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if s[i] and s[j] and len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.72}
    got = dedupe.similar_pairs(dedupe.shingle_sets(df, "id", F.col("text"))).collect()
    assert {(r["i"], r["j"]) for r in got} == want


def test_ranks_and_turns(spark):
    rows = [(k, "x" if k % 3 else None, k % 2) for k in range(50)]
    df = spark.createDataFrame(rows, "i long, g string, c long").repartition(4)
    got = {r["i"]: r["rank"] for r in ranking.with_rank(df, ["g"], [F.desc("i")]).collect()}
    for g in ("x", None):
        own = sorted((i for i, h, _ in rows if h == g), reverse=True)
        assert [got[i] for i in own] == list(range(1, len(own) + 1))
    turns = {r["i"]: r["turn"] for r in ranking.round_robin(df.where("g = 'x'"), ["g"], "c", [F.col("i")]).collect()}
    assert sorted(turns, key=turns.get)[:4] == [2, 1, 4, 5]


def test_largest_remainder(spark):
    shares = {"normal": 0.1903, "solved": 0.1416, "almost_correct": 0.1212, "time_pressure": 0.1008, "rest": 0.4461}
    df = spark.createDataFrame(list(shares.items()), "k string, share double")
    got = {r["k"]: r["quota"] for r in select.largest_remainder(df, "k", 600).collect()}
    assert sum(got.values()) == 600 and all(abs(got[k] - 600 * s) < 1 for k, s in shares.items())


def test_cells_without_measurements_are_not_zero(spark):
    schema = "id long, model string, strategy string, pressure string, passed boolean, reasons array<string>, error_kind string, adherence double, robustness double, relevance double"
    rows = [
        (1, "m", "a", "normal", True, [], "none", 1.0, 0.5, 1.0), (2, "m", "a", "normal", False, ["SOLUTION_LEAK"], "none", None, None, None), (3, "m", "a", "solved", None, [], "infrastructure", None, None, None),
        (4, "m", "b", "normal", None, [], "infrastructure", None, None, None),
    ]
    cells = {r["strategy"]: r for r in metrics.cell_metrics(spark.createDataFrame(rows, schema)).collect()}
    a, b = cells["a"], cells["b"]
    assert (a["scenario_count"], a["attempted_count"], a["pass_rate"], a["adherence_mean"], a["robustness_mean"], a["leak_rate"], a["partial"]) == (2, 3, 0.5, 1.0, 0.5, 0.5, True)
    assert (a["clean_pass_rate"], a["pressed_pass_rate"]) == (0.5, None)
    assert (b["scenario_count"], b["pass_rate"], b["adherence_mean"]) == (0, None, None)
    assert metrics.best_cells(metrics.cell_metrics(spark.createDataFrame(rows, schema))).first()["strategy"] == "a"


def test_kappa(spark):
    df = spark.createDataFrame([(True, True)] * 20 + [(True, False)] * 5 + [(False, True)] * 10 + [(False, False)] * 15 + [(None, True)], "a boolean, b boolean")
    row = metrics.agreement(df, F.col("a"), F.col("b")).first()
    assert row["n"] == 50 and abs(row["kappa"] - 0.4) < 1e-9
    same = spark.createDataFrame([(True, True)] * 3, "a boolean, b boolean")
    assert metrics.agreement(same, F.col("a"), F.col("b")).first()["kappa"] is None


def test_training_shares_reach_the_cap(spark):
    rates = {"normal": 0.0, "a": 0.9, "b": 0.05, "c": 0.05, "d": None, "e": 0.0}
    got = {r["pressure"]: r["share"] for r in gates.training_shares(spark.createDataFrame(list(rates.items()), "pressure string, failure_rate double")).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and max(got.values()) <= 0.22 + 1e-9 and got["a"] == pytest.approx(0.22)
    even = {r["share"] for r in gates.training_shares(spark.createDataFrame([(k, 0.0) for k in rates], "pressure string, failure_rate double")).collect()}
    assert even == {1 / 6}


def test_sizes():
    assert gates.top_up(600, 578, 0.4857) == 100
    assert gates.top_up(10, 10, 0.5) == 0
    assert gates.sweep_sizes(600) == [75, 150, 300, 600] and gates.sweep_sizes(2000) == [125, 250, 500, 1000]
    with pytest.raises(ValueError):
        gates.top_up(10, 1, 0.0)


def test_resume(spark):
    rows = [(1, 1, "none"), (1, 2, "infrastructure"), (2, 1, "infrastructure"), (2, 2, "none"), (3, 1, "infrastructure"), (4, 1, "refusal")]
    index = resume.resume_index(spark.createDataFrame(rows, "k long, t long, kind string"), ["k"], F.col("kind"), F.col("t"))
    got = {r["k"]: (r["reusable"] and r["reusable"]["t"], r["retry"]) for r in index.collect()}
    assert got == {1: (1, True), 2: (2, False), 3: (None, True), 4: (1, False)}
    owed = spark.range(1, 6).withColumnRenamed("id", "k")
    assert sorted(r[0] for r in resume.todo(owed, index, ["k"]).collect()) == [3, 5]
    assert sorted(r[0] for r in resume.done(owed, index, ["k"]).collect()) == [1, 2, 4]


def test_fingerprints(spark):
    df = spark.createDataFrame([(k, str(k)) for k in range(100)], "k long, t string")
    one = records.set_fingerprint(df, F.sha2("t", 256)).first()
    assert one == records.set_fingerprint(df.repartition(7).orderBy(F.desc("k")), F.sha2("t", 256)).first() and one["n"] == 100
    forward, back = (records.order_fingerprint(df, k, F.sha2("t", 256)).first()["fingerprint"] for k in (F.col("k"), -F.col("k")))
    assert forward != back
    assert records.set_fingerprint(df.limit(0), F.sha2("t", 256)).first()["n"] == 0


def test_chat_records(spark):
    df = spark.createDataFrame([([("user", " hi "), ("assistant", "so")], "why?", "x = 1\n", "python", " because ")], "h array<struct<role string,content string>>, m string, c string, l string, a string")
    told = records.rendered_conversation(F.col("h"), F.col("m"), F.col("c"), F.col("l"))
    out = [tuple(x) for x in df.select(records.chat_record(F.lit("be kind"), told, F.col("a"))).first()[0]]
    assert out == [("system", "be kind"), ("user", "```python\nx = 1\n```\n\nhi"), ("assistant", "so"), ("user", "why?"), ("assistant", "because")]


def test_gate_conserves_rows(spark):
    words = ["alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight", "red green blue cyan pink grey black white"]
    rows = [(k, words[k % 3] + (f" {k}" if k > 5 else ""), "xy"[k % 2], k == 7, k == 8) for k in range(12)]
    df = spark.createDataFrame(rows, "i long, t string, g string, bad boolean, none boolean")
    static = F.when(F.col("bad"), F.array(F.lit("LOW_QUALITY"))).otherwise(F.array().cast("array<string>"))
    gate = quality_gate.Gate(static, F.array().cast("array<string>"), F.col("none"), {"g": 0.5})
    bench = spark.createDataFrame([(1, words[2])], "item long, t string")
    told = []
    out = quality_gate.run(df, bench, gate, "i", "t", "item", lambda *x: told.append(x))
    assert [x[0] for x in told] == list(quality_gate.STAGES) and told[0][2] == 12 and told[1:3] == [("static", 11, 12), ("judge", 10, 11)]
    assert all(a[1] == b[2] for a, b in zip(told, told[1:])) and told[-1][1] == out.where("status = 'accepted'").count()
    status = {r["i"]: (r["status"], r["stage"]) for r in out.collect()}
    assert len(status) == 12 and status[7] == ("rejected", "static") and status[8] == ("unjudged", "judge")
    assert status[0] == ("accepted", None) and status[3] == ("rejected", "dedupe") and status[2] == ("rejected", "contamination")
    assert {(r["stage"], r["note"]) for r in out.collect()} >= {("static", "stage=static"), (None, ""), ("dedupe", "stage=dedupe"), ("judge", "")}
    report = quality_gate.report(out).first()
    assert report["candidates"] == report["accepted"] + report["rejected"] + report["unjudged"] == 12
    with pytest.raises(ValueError):
        quality_gate.freeze(out, F.sha2("t", 256))


def test_shortfalls_reasons_and_sizes(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "g string")
    quotas = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "g string, quota int")
    assert sorted(map(tuple, select.shortfalls(df, "g", quotas).collect())) == [("b", 3, 1, 2), ("c", 2, 0, 2)]
    points = spark.createDataFrame([(100, 0.95, 0.8, 0.9), (200, 0.95, 0.92, 0.9)], "n int, pass_rate double, adherence_mean double, robustness_mean double")
    reason = lambda d: tuple(gates.minimum_size_reason(d).first())
    assert reason(points) == (200, "200 rows meet all thresholds")
    assert reason(points.where("n = 100")) == (None, "even 100 rows are short of: adherence_mean")
    assert reason(points.limit(0)) == (None, "no sizes were measured")
    with pytest.raises(ValueError, match="a subset of 5 rows of 3"):
        select.nested(df, [F.col("g")], [1, 5], strict=True)
    with pytest.raises(ValueError, match="positive"):
        select.nested(df, [F.col("g")], [0, 5])


def test_merged_rows_that_nobody_asked_for(spark):
    merged = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    owed = spark.createDataFrame([(2, 7)], "k int, ordinal int")
    assert sorted(map(tuple, resume.in_order(merged, owed, ["k"], "ordinal").collect())) == [(1, "a", None), (2, "b", 7)]
