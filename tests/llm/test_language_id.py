"""Language profiles against plain dictionaries, and accuracy on rows held out."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb

from millrace.llm import language_id


def grams(text):
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        padded = f" {word} "
        out.update(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n] != " ")
    return out


def first(counts, size=300):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]


def expected(rows):
    totals = defaultdict(Counter)
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0 for i, _, _ in rows]
    for (_, text, lang), out in zip(rows, held, strict=True):
        if not out and lang is not None:
            totals[lang].update(grams(text))
    profiles = {lang: {g: k for k, g in enumerate(first(c))} for lang, c in totals.items() if c}
    result = []
    for (i, text, _), out in zip(rows, held, strict=True):
        mine = first(grams(text))
        scored = sorted((sum(abs(k - p[g]) if g in p else 300 for k, g in enumerate(mine)), lang) for lang, p in profiles.items()) if mine else []
        result.append((i, out, scored[0][1], 1 - scored[0][0] / (300 * len(mine))) if scored else (i, out, "und", 0.0))
    return result


ODD = [None, "", " \t\n", "12 34 !?", "a", "É", "Straße STRASSE", "日本語 テスト", "word " * 3000, "mixed 1x2y_z", "the the the"]
SCHEMA = "doc_id long, text string, lang string, score int, gram string"


def table_rows(spark, sf_dir):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    odd = [(90_000 + k, t, [None, "en", "xx"][k % 3]) for k, t in enumerate(ODD)]
    return [*docs, *odd, (None, "null id", "en"), docs[3], docs[3]]


def test_as_by_dictionaries(spark, sf_dir):
    rows = table_rows(spark, sf_dir)
    df = spark.createDataFrame([(*r, 1, "g") for r in rows], SCHEMA).repartition(6)
    got = sorted(map(tuple, language_id.identify(df).collect()), key=repr)
    assert got == sorted(expected(rows), key=repr)
    lang = {(i, t): lang for i, t, lang in rows}
    judged = [(p, lang[i, t]) for (i, t, _), (_, out, p, _) in zip(rows, expected(rows), strict=True) if out and i is not None and i < 90_000]
    assert sum(p == want for p, want in judged) >= 0.97 * len(judged)


def test_stretches_and_bounded_counts(monkeypatch):
    text = "Der schnelle braune Fuchs, naïve l'été " * 40
    whole = language_id.gram_counts(text)
    monkeypatch.setattr(language_id, "STRETCH", 7)
    parts = language_id.gram_counts(text)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()
    assert dict(zip(*map(list, whole), strict=True)) == {sum(ord(c) << s for c, s in zip(g, (42, 21, 0), strict=False)): n for g, n in grams(text).items()}


def test_no_rows_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert language_id.identify(empty).count() == 0
    unknown = spark.createDataFrame([(1, "some text", None, 1, ""), (2, None, "en", 1, "")], SCHEMA)
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(unknown).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}


def test_query_equals_sql(spark, sf_dir):
    from millrace.llm import queries

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = sorted(map(tuple, queries.op13_language_id(spark, sf_dir).collect()))
    assert got == sorted(duck.execute(queries.oracle_sql()["op13_language_id"]).fetchall())
