"""Features and verdicts against a plain version."""

import re
from collections import Counter, defaultdict

from millrace.llm import quality_rules


def features(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def expected(rows):
    base = [(i, h, f := features(t), f[0] < 10 or 100 * f[4] > 20 * f[0]) for i, t, h, *_ in rows]
    hosts = defaultdict(list)
    for _, h, _, bad in base:
        if h is not None:
            hosts[h].append(bad)
    rates = [sum(x) / len(x) for x in hosts.values()]
    m = sum(rates) / len(rates) if rates else 0
    v = sum((r - m) ** 2 for r in rates) / len(rates) if rates else 0
    c = max(0, m * (1 - m) / v - 1) if v > 1e-15 else None
    bad_host = {h: (m if c is None else (sum(x) + m * c) / (len(x) + c)) > 0.5 for h, x in hosts.items()}
    return sorted(((i, *f, bad, bad_host.get(h, False), not (bad or bad_host.get(h, False))) for i, h, f, bad in base), key=str)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    got = sorted(map(tuple, quality_rules.quality_verdicts(docs).collect()), key=str)
    assert got == expected(list(map(tuple, docs.collect())))
    assert any(r[5] for r in got) and any(r[6] for r in got)


def test_hosts_and_odd_rows(spark):
    good = " ".join(f"w{k}" for k in range(12))
    rows = [(k, good if k % 4 else "short", "mixed", 1) for k in range(12)]
    rows += [(100 + k, "short" if k else good, "bad", 1) for k in range(12)]
    rows += [(200, "a b c d e " * 9, "one", 1), (201, None, "one", 1), (202, "", None, 1), (203, good, None, 1), (None, good, "mixed", 1), (0, "short", "mixed", 1)]
    rows += [(204, "x " * 30000, "one", 1), (205, "a b c d e a b c d e f g h\n\na\n a\na#\n# |", "mixed", 1), (206, good + " a a a a a a", "mixed", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int")
    got = sorted(map(tuple, quality_rules.quality_verdicts(df).collect()), key=str)
    assert got == expected(rows)
    assert any(r[7] and not r[6] for r in got)  # a good document of a bad host
    kept = sorted(str(r["doc_id"]) for r in quality_rules.keep_good(df).collect())
    assert kept == sorted(str(r[0]) for r in got if r[8])
    assert quality_rules.keep_good(df).columns == df.columns
    assert quality_rules.quality_verdicts(df.limit(0)).count() == 0 == quality_rules.keep_good(df.limit(0)).count()


def test_white_space_before_a_final_line_separator(spark):
    nine = " ".join(f"w{k}" for k in range(9))
    rows = [(k, f"{nine} {end}", None) for k, end in enumerate(("\x85", "\u2028", "\u2029", "\x85 ", " ", "\n"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, quality_rules.quality_verdicts(df).collect()), key=str)
    assert got == expected(rows)
    assert [r[1] for r in got] == [10, 10, 10, 10, 9, 9]
