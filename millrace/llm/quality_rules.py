"""Quality rules over documents and over the hosts that they come from, in DataFrame operations only.

Each document meets base rules. The failures are aggregated by host, the hosts' rates are shrunk towards the rate of
all hosts with a beta prior fitted to the hosts themselves (method of moments), and a host whose shrunk rate is above
``max_rate`` is rejected with all its documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, let, squeezed, text_key, words

#: Rows up to which a checked table of hosts is broadcast.
BROADCAST_ROWS = 10_000
#: Words of a window whose repetition counts.
WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    """``min_words``: fewer fail. ``max_repeat_percent``: a larger share of words in repeated windows fails.
    ``max_rate``: a host with a larger shrunk rate of failures is rejected."""

    min_words: int = 10
    max_repeat_percent: int = 20
    max_rate: float = 0.5


def _repeat_words(w: Column, hashes: Column) -> Column:
    """Words in windows that occur twice or more; only texts in which a window's hash recurs are looked at closely."""
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    windows = F.sort_array(
        F.transform(starts, lambda i: F.struct(F.get(hashes, i).alias("h"), F.concat_ws(" ", *[F.get(w, i + k) for k in range(WINDOW)]).alias("s"), i.alias("i")))
    )
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["s"] == y["s"]), F.lit(False))
    # equal windows are neighbours in the sorted array; get() beyond either end is null
    twice = let(windows, lambda a: F.filter(a, lambda x, k: same(x, F.get(a, k - 1)) | same(x, F.get(a, k + 1))))
    at = F.array_sort(F.transform(twice, lambda x: x["i"]))
    gaps = let(at, lambda a: F.transform(a, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(a, k + 1) - p, F.lit(WINDOW)))))
    return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)


def _hashes(w: Column) -> Column:
    """The hash of each window, null for texts that have one or none."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    return F.when(F.size(w) > WINDOW, windows)


def _n_repeat_words(w: Column, h: Column) -> Column:
    return F.when((F.size(w) > WINDOW) & (F.size(F.array_distinct(h)) < F.size(h)), _repeat_words(w, h)).otherwise(0).cast("long")


def with_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with a column ``_features`` of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    A null text has the features of an empty one, all zero.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w, h = F.col("_words"), F.col("_hashes")
    return (
        df.withColumn("_words", words(F.col(text_col)))
        .withColumn("_hashes", _hashes(F.col("_words")))
        .withColumn("_lines", lines)
        .withColumn(
            "_features",
            F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(squeezed(F.col(text_col))).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                _n_repeat_words(w, h).alias("n_repeat_words"),
            ),
        )
        .drop("_words", "_hashes", "_lines")
    )


def _failed(rules: Rules) -> Column:
    f = F.col("_features")
    return (f["n_words"] < rules.min_words) | (100 * f["n_repeat_words"] > rules.max_repeat_percent * f["n_words"])


def host_verdicts(failures: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``_host`` and ``host_rejected`` for each host of ``failures`` (columns _host, _failed).

    With the mean m and variance v of the hosts' rates, the prior is Beta(m c, (1 - m) c), c = m (1 - m) / v - 1. Where
    all rates are equal, v is 0 and the shrunk rate is m. Rows without a host are not judged by one.
    """
    hosts = failures.where("_host IS NOT NULL").groupBy("_host").agg(F.count("*").alias("n"), F.count_if("_failed").alias("f"))
    hosts = hosts.withColumn("rate", F.col("f") / F.col("n"))
    hosts = checkpointed(hosts)  # used twice
    prior = hosts.agg(F.avg("rate").alias("m"), F.var_pop("rate").alias("v"))  # one row
    c = F.greatest(F.lit(0.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1)
    shrunk = F.when(F.col("v") < 1e-15, F.col("m")).otherwise((F.col("f") + F.col("m") * c) / (F.col("n") + c))
    return hosts.join(F.broadcast(prior)).select("_host", (shrunk > rules.max_rate).alias("host_rejected"))


def _rejected_hosts(failures: DataFrame, rules: Rules) -> DataFrame:
    """The rejected hosts, to be broadcast where their number, which is checked, is small."""
    rejected = checkpointed(host_verdicts(failures, rules).where("host_rejected"))
    return F.broadcast(rejected) if rejected.count() <= BROADCAST_ROWS else rejected


def quality_verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: Rules = Rules()) -> DataFrame:
    """One row per row of ``df``: the id, the features, ``base_failed``, ``host_rejected`` and ``kept``.

    Null texts count as empty and so fail; rows with a null host meet the base rules only; repeated rows are judged
    alike; an empty table gives an empty one. Other columns of ``df`` may have any names.
    """
    rows = with_features(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(host_col).alias("_host")), "_text")
    rows = checkpointed(rows.select("_id", "_host", "_features", _failed(rules).alias("_failed")))  # numbers, no texts
    rejected = _rejected_hosts(rows, rules)
    joined = rows.join(rejected, "_host", "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return joined.select(
        F.col("_id").alias(id_col), "_features.*", F.col("_failed").alias("base_failed"), "host_rejected",
        (~(F.col("_failed") | F.col("host_rejected"))).alias("kept"),
    )


def keep_good(df: DataFrame, text_col: str = "text", host_col: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``df`` that the rules keep, with their columns unchanged. The rules are evaluated once; texts that fail are
    then left out by their key."""
    # each array once: a filter is moved to the scan, and what it uses would else be repeated inside its lambdas
    limit = rules.max_repeat_percent
    failed = let(words(F.col("_text")), lambda w: let(_hashes(w), lambda h: (F.size(w) < rules.min_words) | (100 * _n_repeat_words(w, h) > limit * F.size(w))))
    rows = df.select(F.col(text_col).alias("_text"), F.col(host_col).alias("_host"))
    judged = checkpointed(rows.select("_host", text_key(F.col("_text")).alias("_gone"), failed.alias("_failed")))  # no texts
    rejected = _rejected_hosts(judged, rules).select(F.col("_host").alias("_rejected"))
    bad = judged.where("_failed").select("_gone").distinct()
    good = df.join(rejected, df[host_col] == rejected["_rejected"], "left_anti")
    return good.join(bad, text_key(df[text_col]) == bad["_gone"], "left_anti")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), wins AS (
  SELECT doc_id, unnest(range(len(w) - 4)) AS i, w FROM t WHERE len(w) >= 5
), named AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM wins
), twice AS (
  SELECT doc_id, i FROM named QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1
), covered AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id
), f AS (
  SELECT t.doc_id, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN covered USING (doc_id)
), j AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k, k / n AS rate FROM j WHERE source IS NOT NULL GROUP BY source
), p AS (
  SELECT avg(rate) AS m, var_pop(rate) AS v, greatest(0, CASE WHEN v < 1e-15 THEN 0 ELSE m * (1 - m) / v - 1 END) AS c FROM h
), r AS (
  SELECT source, CASE WHEN v < 1e-15 THEN m ELSE (k + m * c) / (n + c) END > 0.5 AS host_rejected FROM h, p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(host_rejected, false) AS host_rejected, NOT (base_failed OR coalesce(host_rejected, false)) AS kept
FROM j LEFT JOIN r USING (source)
"""
