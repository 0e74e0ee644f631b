"""Readers, writers and the drop folder."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import jsonl, schemas, sinks
from millrace.streaming.incremental import ingest

SCENARIO = {
    "id": "a-1", "language": "python", "bug_category": "loop", "difficulty": "easy", "code": "x", "conversation_history": [], "student_message": "m", "expected_bug": "b", "expected_fix": "f",
    "student_has_solved": False, "pressure_type": "normal", "source": "s", "split": "clean", "notes": "",
}


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


def test_strict_and_permissive(spark, tmp_path):
    good = write(tmp_path / "good.jsonl", ["// comment", "", SCENARIO, SCENARIO | {"id": "a-2"}])
    rows = jsonl.read_strict(spark, good, schemas.SCENARIO, schemas.scenario_problems())
    assert sorted(r["id"] for r in rows.collect()) == ["a-1", "a-2"]
    torn = write(tmp_path / "torn.jsonl", [SCENARIO, '{"id": "a-3", "lang'])
    assert jsonl.line_counts(spark, torn, schemas.SCENARIO).first().asDict() == {"lines": 2, "malformed": 1}
    assert jsonl.read_lenient(spark, torn, schemas.SCENARIO).count() == 1
    for name, lines in {"torn2": [SCENARIO, "{"], "twice": [SCENARIO, SCENARIO], "none": ["// nothing"], "bad": [SCENARIO | {"id": "A B"}]}.items():
        with pytest.raises(jsonl.InvalidRecords):
            jsonl.read_strict(spark, write(tmp_path / f"{name}.jsonl", lines), schemas.SCENARIO, schemas.scenario_problems())


def test_scenario_rules(spark, tmp_path):
    turn = lambda role: {"role": role, "content": "c"}
    cases = [
        ({}, []), ({"code": " "}, ["blank_text"]), ({"language": "cobol"}, ["unknown_value"]), ({"conversation_history": [turn("assistant")]}, ["bad_history"]), ({"conversation_history": [turn("user"), turn("assistant")]}, []),
        ({"pressure_type": "solved"}, ["state_contradicts_pressure"]), ({"pressure_type": "solved", "student_has_solved": True}, []), ({"pressure_type": "fake_success", "student_has_solved": True}, ["state_contradicts_pressure"]),
    ]
    path = write(tmp_path / "s.jsonl", [SCENARIO | c | {"id": f"s-{k}"} for k, (c, _) in enumerate(cases)])
    got = jsonl.read_permissive(spark, path, schemas.SCENARIO).select("id", schemas.scenario_problems().alias("p")).orderBy("id").collect()
    assert [r["p"] for r in got] == [w for _, w in cases]


def test_other_schemas_parse(spark):
    for schema in (schemas.CANDIDATE, schemas.EVALUATION, schemas.CHAT):
        assert spark.createDataFrame([], schema).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None, "accepted"), (2, 'q"uote\nline', 0.12349, "rejected")], "i long, t string, x double, status string")
    sinks.write_version(df, str(tmp_path / "version"))
    assert spark.read.parquet(str(tmp_path / "version")).where("status = 'rejected'").count() == 1
    sinks.write_jsonl(df, str(tmp_path / "lines"))
    sinks.write_jsonl(df, str(tmp_path / "lines"), append=True)
    assert spark.read.json(str(tmp_path / "lines")).count() == 4
    sinks.write_sheet(df, str(tmp_path / "sheet"))
    assert {r["t"] for r in jsonl.read_sheet(spark, str(tmp_path / "sheet")).collect()} == {"a", 'q"uote\nline'}
    sinks.write_subsets(df.withColumn("rank", F.col("i")), str(tmp_path / "subsets"), [1, 5])
    assert {(r["i"], r["subset"]) for r in spark.read.json(str(tmp_path / "subsets")).collect()} == {(1, 1), (2, 5)}
    assert "| 2 | q" in sinks.markdown(df) and "0.123" in sinks.markdown(df)


def test_ingest_adds_each_id_once(spark, tmp_path):
    drop, target, state = (str(tmp_path / x) for x in ("drop", "target", "state"))
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id long, at long, t string").write.parquet(drop)
    run = lambda: ingest(spark, drop, target, state, "id long, at long, t string", "id", "at")
    assert run() == 2
    spark.createDataFrame([(2, 0, "later file"), (3, 1, "d")], "id long, at long, t string").write.mode("append").parquet(drop)
    assert run() == 3 and run() == 3
    assert {(r["id"], r["t"]) for r in spark.read.parquet(target).collect()} == {(1, "a"), (2, "c"), (3, "d")}


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_problems_by_path_and_line(spark, tmp_path, split):
    """Files of several splits, with blank lines, comments and line ends of either kind."""
    lines = ["// head", "", *(json.dumps(SCENARIO | {"id": f"a-{k}"}) for k in range(40)), "  ", '{"id": "torn', "// more", *(json.dumps(SCENARIO | {"id": f"b-{k}"}) for k in range(20)), json.dumps(SCENARIO | {"id": "B B"})]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.jsonl").write_bytes("\r\n".join(lines).encode())
    (folder / "two.jsonl").write_text("\n".join(lines[:30]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        rows = jsonl.read_numbered(spark, str(folder), schemas.SCENARIO)
        got = sorted((r["_file"].rsplit("/", 1)[1], r["_line"], r["id"]) for r in rows.where("_corrupt IS NULL").collect())
        want = [(name, k, json.loads(x)["id"]) for name, part in (("one.jsonl", lines), ("two.jsonl", lines[:30])) for k, x in enumerate(part, 1) if x.startswith('{"id": "a') or x.endswith("}")]
        assert got == sorted(want)
        with pytest.raises(jsonl.InvalidRecords) as told:
            jsonl.read_strict(spark, str(folder / "one.jsonl"), schemas.SCENARIO, schemas.scenario_problems())
        assert "one.jsonl:44: malformed" in str(told.value) and "one.jsonl:66: " in str(told.value)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_missing_files_and_first_ids(spark, tmp_path):
    schema = "id string, model string, n int"
    assert jsonl.read_candidates(spark, str(tmp_path / "none"), schema).count() == 0
    path = write(tmp_path / "c.jsonl", [{"id": "a", "model": "m", "n": 1}, "{", {"id": "b", "model": "Mock:x", "n": 2}, {"id": "a", "model": "m", "n": 3}])
    assert sorted(map(tuple, jsonl.read_candidates(spark, path, schema).collect())) == [("a", "m", 1), ("b", "Mock:x", 2)]
    assert sorted(r["n"] for r in jsonl.read_records(spark, path, schema).collect()) == [1, 3]
    for place in (write(tmp_path / "mocks.jsonl", [{"id": "b", "model": "mock:x"}]), str(tmp_path / "none")):
        with pytest.raises(jsonl.InvalidRecords):
            jsonl.read_records(spark, place, schema)


def test_agreement_of_a_sheet(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text('id,automatic_pass,human_pass,notes\n1,true,Yes,"a ""b""\nc"\n2,true,no,\n3,false,FAIL,\n4,false,maybe,\n5,true,,\n')
    got = jsonl.read_agreement(spark, str(tmp_path / "sheet.csv"), "automatic_pass", "human_pass").first()
    assert (got["n"], got["yes_yes"], got["yes_no"], got["no_no"]) == (3, 1, 1, 1)


def test_spec_of_a_file(spark, tmp_path):
    import hashlib

    from millrace.functions import criteria
    from millrace.sources import plan

    spec = {"dimensions": [{"failure_code": "A", "applies_when": "unsolved", "blocking": True, "weight": 0.5}, {"failure_code": "B", "applies_when": "always", "weight": 0.25, "kind": "quality"}, {"failure_code": "C", "applies_when": "solved"}], "limits": {"words": 3}}
    (tmp_path / "spec.json").write_text(json.dumps(spec))
    loaded = plan.load_spec(spark, str(tmp_path / "spec.json"))
    assert loaded.sha256 == hashlib.sha256((tmp_path / "spec.json").read_bytes()).hexdigest() and loaded.limits == criteria.Limits(words=3) and loaded.gate == criteria.GATE
    hits = spark.createDataFrame([(1, "A", False), (2, "A", True), (3, "B", None), (4, "B", True), (5, "C", True), (6, "C", None), (7, "D", False)], "n int, code string, solved boolean")
    got = {r["n"]: (r["blocking"], r["weight"]) for r in plan.applied(hits, loaded.table(spark)).collect()}
    assert got == {1: (True, 0.5), 3: (False, 0.25), 4: (False, 0.25), 5: (False, 0.0)}
    df = spark.createDataFrame([("one two three",), ("one two three four",)], "t string")
    codes = df.select(criteria.static_checks(F.col("t"), F.lit(False), limits=loaded.limits)["violations"]).collect()
    assert [r[0] for r in codes] == [[], ["OVER_EXPLANATION"]]
    (tmp_path / "bad.json").write_text(json.dumps({"criteria": [{"failure_code": "A", "applies_when": "never"}]}))
    with pytest.raises(ValueError, match="known states"):
        plan.load_spec(spark, str(tmp_path / "bad.json"))
