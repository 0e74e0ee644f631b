"""Prefix joins against plain loops, and how many pairs they make."""

import os
import random

from pyspark.sql import functions as F

from millrace.operators import decontaminate, dedupe, similarity
from millrace.plans import registry
from millrace.session import shared_folder


def plain_sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").split()
        out[i] = {" ".join(w)} - {""} if len(w) < 4 else {" ".join(w[k : k + 4]) for k in range(len(w) - 3)}
    return {i: s for i, s in out.items() if s}


def varied(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(rng):
    base = [[f"w{rng.randrange(40 if k % 3 else 10**5)}" for _ in range(rng.randint(1, 90))] for k in range(40)]
    texts = [varied(rng, b, rng.randint(0, 2)) for b in base for _ in range(rng.randint(1, 8))] + ["", None, "a", "a b", "a  b", "x y z w"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_overlaps_equal_the_loop(spark):
    rng = random.Random(3)
    ours = corpus(rng)
    theirs = [(-1 - i, varied(rng, t.split(), i % 4) if i % 3 and t else t) for i, t in ours if i % 2] + [(-1000, ours[7][1]), (-1001, "a b")]
    theirs += [(-2000 - i, " ".join((t or "").split()[3:30])) for i, t in ours if i % 5 == 0]
    a, b = plain_sets(ours), plain_sets(theirs)
    near, inside = {}, set()
    for i, s in a.items():
        best = min(((-len(s & t) / len(s | t), j) for j, t in b.items()), default=None)
        if best and -best[0] >= 0.6:
            near[i] = (best[1], -best[0])
        inside |= {(i, j) for j, t in b.items() if t <= s}
    corpus_df, known = (spark.createDataFrame(rows, "id long, text string").repartition(3) for rows in (ours, theirs))
    known = known.withColumnRenamed("id", "item")
    got = decontaminate.near_overlap(corpus_df, known, "id", "item").collect()
    assert {r["id"]: (r["eval_id"], r["similarity"]) for r in got} == near and len(got) == len(near) > 50
    got = decontaminate.contained(corpus_df, known, "id", "item").collect()
    assert {(r["id"], r["eval_id"]) for r in got} == inside and len(got) == len(inside) > 50
    most = {(i, j) for i, s in a.items() for j, t in b.items() if len(s & t) >= 0.7 * len(t)}
    assert {(r["id"], r["eval_id"]) for r in decontaminate.contained(corpus_df, known, "id", "item", share=0.7).collect()} == most != inside
    assert decontaminate.near_overlap(corpus_df.limit(0), known, "id", "item").collect() == [] == decontaminate.contained(corpus_df, known.limit(0), "id", "item").collect()


def test_pairs_and_greedy_removal_equal_the_loop(spark, monkeypatch):
    rows = corpus(random.Random(4))
    sets, df = plain_sets(rows), spark.createDataFrame(rows, "id long, text string").repartition(3)
    want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j}
    want = {p: x for p, x in want.items() if x >= 0.72}
    for block in (1 << 15, 50):
        monkeypatch.setattr(similarity, "BLOCK", block)
        got = dedupe.similar_pairs(dedupe.shingle_sets(df, "id", F.col("text"))).collect()
        assert {(r["i"], r["j"]): r["similarity"] for r in got} == want and len(got) == len(want) > 50
    kept, blank = [], False
    for i, t in rows:
        if i not in sets:
            kept += [] if blank else [i]
            blank = True
        elif not any((k, i) in want for k in kept):
            kept.append(i)
    verdicts = dedupe.deduplicate(df, "id", "text").collect()
    assert sorted(r["id"] for r in verdicts if r["kept"]) == kept and len(verdicts) == len(rows)


def test_common_passages_and_copies_make_no_pairs(spark):
    rng = random.Random(5)
    passage = [f"common{k}" for k in range(12)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(10**9)}" for _ in range(60)])) for i in range(120)]
    sets = dedupe.shingle_sets(spark.createDataFrame(rows, "id long, text string"), "id", F.col("text"))
    assert similarity.candidates(sets, None, 0.72).count() == 0
    assert similarity.candidates(sets.where("id < 60"), sets.where("id >= 60"), 0.6).count() == 0
    copies = [(i, " ".join(passage * 3)) for i in range(200)]
    known = spark.createDataFrame([(-1 - i, t) for i, t in copies], "item long, text string")
    met = decontaminate.near_overlap(spark.createDataFrame(copies, "id long, text string"), known, "id", "item").collect()
    assert {(r["id"], r["eval_id"], r["similarity"]) for r in met} == {(i, -200, 1.0) for i in range(200)}


def written(spark):
    """Bytes that the stages so far have written for shuffles, and those of checkpoints."""
    java, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    java.listenerBus().waitUntilEmpty()
    stages = java.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    stages = {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}
    folder = shared_folder(spark).removeprefix("file:")
    return stages, {f"{at}/{f}": os.path.getsize(f"{at}/{f}") for at, _, files in os.walk(folder) for f in files}


def test_sets_are_not_written(spark, tmp_path):
    """Only prefixes move, of most texts; a group of near copies meets once, not once for each of them."""
    rng = random.Random(7)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = fresh(300)
    texts = [" ".join(fresh(300)) for _ in range(800)] + [varied(rng, base, rng.randint(1, 3)) for _ in range(80)]
    spark.createDataFrame(list(enumerate(texts)), "id long, text string").write.parquet(f"{tmp_path}/texts")
    df = spark.read.parquet(f"{tmp_path}/texts")
    before = written(spark)
    got = dedupe.deduplicate(df, "id", "text", reread=True)
    kept = [r["id"] for r in got.collect() if r["kept"]]
    assert len(got.columns) == 2 and set(range(801)) <= set(kept) and len(kept) < 880
    shuffled, checkpoints = (sum(n for k, n in now.items() if k not in was) for was, now in zip(before, written(spark), strict=True))
    assert shuffled < 1.2 * sum(map(len, texts)) and checkpoints < 0.6 * sum(map(len, texts)), (shuffled, checkpoints, sum(map(len, texts)))


def test_near_dup_pairs_writes_no_sets_and_moves_no_texts(spark, tmp_path):
    """Copies are dropped where they stand, and only prefixes move."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(800)]
    texts += [varied(rng, texts[k].split(), k % 3) for k in range(30)]
    spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    before = written(spark)
    got = {(r["i"], r["j"]) for r in registry.near_dup_pairs(spark, str(tmp_path)).collect()}
    assert got == {(k, 800 + k) for k in range(30) if k % 3}
    shuffled, checkpoints = (sum(n for k, n in now.items() if k not in was) for was, now in zip(before, written(spark), strict=True))
    assert shuffled < 1.2 * sum(map(len, texts)) and checkpoints < 0.6 * sum(map(len, texts)), (shuffled, checkpoints, sum(map(len, texts)))


def test_many_copies(spark, monkeypatch):
    """Neither the first texts nor their copies can be looked up: sets are joined instead."""
    monkeypatch.setattr(dedupe, "BROADCAST_TERMS", 2)
    rows = [(k, f"a b c d e f g h i j k l m n o p q r s t u v w {k % 5}") for k in range(40)] + [(None, "x"), (50, "x y"), (51, None), (52, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    for reread in (False, True):
        got = dedupe.deduplicate(df, "id", "text", reread=reread).collect()
        assert {r["id"] for r in got if r["kept"]} == {0, 50, 51} and len(got) == 44
