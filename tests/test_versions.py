"""Freezes, their guards, and journals whose keys are state."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.sources.versions import Refused, VersionLog, freeze, manifest, verified
from millrace.streaming.journal import journal


def digest():
    return F.sha2("text", 256)


def rows(spark, *accepted, unjudged=0):
    data = [(k, t, "accepted") for k, t in enumerate(accepted)] + [(100, "bad", "rejected")] + [(200 + k, "?", "unjudged") for k in range(unjudged)]
    return spark.createDataFrame(data, "id long, text string, status string").repartition(3)


def test_freeze_and_guards(spark, tmp_path):
    log = VersionLog(spark, str(tmp_path / "v1"))
    assert log.last() is None and verified(log, digest()) == ["nothing is frozen"]
    with pytest.raises(Refused, match="unjudged"):
        freeze(log, rows(spark, "a", unjudged=2), digest(), "id")
    with pytest.raises(Refused, match="accepted"):
        freeze(log, rows(spark), digest(), "id")
    one = freeze(log, rows(spark, "a", "b"), digest(), "id", {"source_dataset_hash": "s1"})
    assert (one["number"], one["accepted_count"], one["rejected_count"], one["candidate_count"]) == (1, 2, 1, 3)
    assert freeze(log, rows(spark, "a", "b").orderBy(F.desc("id")), digest(), "id") == one  # unchanged: nothing is written
    with pytest.raises(Refused, match="changed"):
        freeze(log, rows(spark, "a", "c"), digest(), "id")
    two = freeze(log, rows(spark, "a", "c"), digest(), "id", refreeze=True)
    assert two["number"] == 2 and sorted(r["text"] for r in log.read().collect()) == ["a", "c"]
    assert sorted(r["text"] for r in log.read(1).collect()) == ["a", "b"] and log.entries().count() == 2
    assert verified(log, digest()) == [] and verified(log, digest(), "s1") == ["source_dataset_hash"] and verified(log, F.sha2(F.concat("text", F.lit("!")), 256)) == ["dataset_hash"]
    with pytest.raises(Refused):
        log.read(3)


def test_only_one_of_two_at_once(spark, tmp_path):
    log = VersionLog(spark, str(tmp_path / "v"))
    data = rows(spark, "a")
    log.commit(data, {"dataset_hash": "x", "accepted_count": 1}, 0)
    with pytest.raises(Refused, match="somebody else"):
        log.commit(rows(spark, "late"), {"dataset_hash": "y", "accepted_count": 1}, 0)
    assert log.last()[1]["dataset_hash"] == "x" and log.entries().count() == 1
    assert {r["text"] for r in log.read().collect()} == {"a", "bad"}


def test_manifest(spark, tmp_path):
    logs = {v: VersionLog(spark, str(tmp_path / v)) for v in ("v1", "v2")}
    freeze(logs["v1"], rows(spark, "a"), digest(), "id")
    got = [(r["version"], r["frozen"], r["number"], r["accepted_count"]) for r in manifest(logs).collect()]
    assert got == [("v1", True, 1, 1), ("v2", False, None, None)]


def test_journal_takes_each_key_once(spark, tmp_path):
    drop, target, state = (str(tmp_path / x) for x in ("drop", "target", "state"))
    (tmp_path / "drop").mkdir()

    def put(name, *lines):
        (tmp_path / "drop" / name).write_text("".join(json.dumps(dict(zip(("key", "at", "verdict"), x, strict=True))) + "\n" for x in lines))

    def run():
        return journal(spark, drop, target, state, "key string, at long, verdict string", "key", "at", F.col("verdict") == "judge_unavailable")

    put("1.json", ("a", 2, "pass"), ("a", 1, "fail"), ("b", 1, "judge_unavailable"), (None, 1, "x"))
    assert run() == 1
    there = lambda: sorted((r["key"], r["verdict"]) for r in spark.read.parquet(target).collect())
    assert there() == [("a", "fail")]
    put("2.json", ("a", 0, "late"), ("b", 5, "pass"), ("c", 1, "fail"))
    put("3.json", ("c", 1, "fail"), ("b", 6, "fail"))
    assert run() == 2
    assert there() == [("a", "fail"), ("b", "pass"), ("c", "fail")]
    assert run() == 0  # nothing new
    assert len(there()) == 3
