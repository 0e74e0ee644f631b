"""Language by rank-order profiles: a text's most frequent n-grams against those of each language, by out-of-place distance.

N-grams are of one to three characters of lower-cased words (runs of letters), each with a space in front and behind; the
space alone is none. Ranks go by count, then by code points. A profile is the first 300 of a language's, over all texts given
with it; a text's is the first 300 of its own. The distance adds up, over the text's n-grams, how far apart the ranks are, and
300 for one that the language's profile lacks. The least distance wins; ties go to the least name.

N-grams are numbers of 63 bits, three characters of 21 bits, counted by array operations. Tasks add up their own counts
before they meet in a shuffle by language and n-gram, so no language is held by one task; profiles are bounded by
``LANGUAGES`` times 300 rows, which is what the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries of a profile, and languages at most (more are an error).
PROFILE, LANGUAGES = 300, 2000
#: Characters looked at together, and different n-grams after which a task hands on its counts.
STRETCH, HELD = 1 << 20, 1 << 20
UNKNOWN = "und"
_SPACE = 0x20

Counts = tuple[np.ndarray, np.ndarray]
EMPTY: Counts = (np.zeros(0, np.int64), np.zeros(0, np.int64))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else the space."""
    table = np.arange(0x110000, dtype=np.int64)
    table[[not chr(c).isalpha() for c in range(0x110000)]] = _SPACE
    return table


def merged(parts: list[Counts]) -> Counts:
    """The counts of all parts added up, n-grams ascending."""
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    counts = np.zeros(len(grams), np.int64)
    np.add.at(counts, at, np.concatenate([n for _, n in parts]))
    return grams, counts


def gram_counts(text: str) -> Counts:
    """The n-grams of a text and their counts, a stretch at a time; a window belongs to the stretch in which it starts."""
    chars = np.frombuffer((" " + text.lower() + "  ").encode("utf-32-le"), "<u4")
    parts = []
    for start in range(0, len(chars) - 2, STRETCH):
        c = _letters()[chars[start : start + STRETCH + 2]]
        c0, c1, c2 = c[:-2], c[1:-1], c[2:]
        l0, l1 = c0 != _SPACE, c1 != _SPACE
        one, two = c0 << 42, (c0 << 42) | (c1 << 21)
        parts.append(np.unique(np.concatenate([one[l0], two[l0 | l1], (two | c2)[l1]]), return_counts=True))
    return merged(parts) if len(parts) > 1 else parts[0]


def ranked(counts: Counts, size: int) -> np.ndarray:
    """The most frequent n-grams in order of rank."""
    grams, n = counts
    return grams[np.argsort(-n, kind="stable")[:size]]


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> DataFrame:
    """Profiles (lang, rank from 0, gram) of all rows of ``df`` whose language is not null; null and blank texts add nothing."""
    rows = df.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def out(held: dict[str, Counts]) -> Iterator[pa.RecordBatch]:
        for lang, (grams, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counts] = {}
        waiting: dict[str, list[Counts]] = {}
        size = 0

        def settle() -> None:
            for lang, parts in waiting.items():
                held[lang] = merged([held.get(lang, EMPTY), *parts])
            waiting.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                counts = gram_counts(text.as_py() or "")
                waiting.setdefault(lang, []).append(counts)
                size += len(counts[0])
                if size > HELD:
                    settle()
                    size = sum(len(g) for g, _ in held.values())
                    if size > HELD // 2:  # else the next texts would merge anew each time
                        yield from out(held)
                        held, size = {}, 0
        settle()
        yield from out(held)

    counts = rows.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", (F.col("rank") - 1).alias("rank"), "gram")


class Profiles:
    """The ranks of all languages: a row a language, a column for each n-gram of any profile and one for all others."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE) -> None:
        self.size, self.languages = size, sorted({lang for lang, _, _ in rows})
        self.grams = np.unique(np.array([g for _, _, g in rows], np.int64))
        self.ranks = np.full((len(self.languages), len(self.grams) + 1), -1, np.int32)
        at = {lang: k for k, lang in enumerate(self.languages)}
        for lang, rank, gram in rows:
            self.ranks[at[lang], np.searchsorted(self.grams, gram)] = rank

    def predict(self, text: str) -> tuple[str, float]:
        """The language of a text, and one less its distance as a share of the largest; ``und`` and 0 if there are no letters or profiles."""
        mine = ranked(gram_counts(text), self.size)
        if not len(mine) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, mine)
        at[(at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] != mine)] = len(self.grams)
        ranks = self.ranks[:, at]
        distances = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(mine)))).sum(axis=1)
        best = int(distances.argmin())
        return self.languages[best], 1 - int(distances[best]) / (self.size * len(mine))


def load(profiles: DataFrame, size: int = PROFILE) -> Profiles:
    """The profiles of ``fit`` on the driver; at most ``LANGUAGES`` of them."""
    rows = profiles.limit(LANGUAGES * size + 1).collect()
    if len(rows) > LANGUAGES * size:
        raise ValueError(f"more than {LANGUAGES} languages")
    return Profiles([tuple(r) for r in rows], size)


def predict(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``lang_pred`` and ``score`` of each row. A null text, or one without letters, is ``und`` with score 0.

    Repeated rows come back as often as they were; null ids are kept; an empty table gives an empty one. Other columns of
    ``df`` may have any names. A text is held whole in its task, its n-grams a stretch at a time.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t.as_py() or "") for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    return rows.mapInArrow(predicted, f"`{id_col}` {kind}, lang_pred string, score double")


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether the crc32 of an id as text is divisible by ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds == 0


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The id, ``held_out``, ``lang_pred`` and ``score`` of each row by profiles of the rows that are not held out; see ``fit`` and ``predict``."""
    profiles = load(fit(df.where(~held_out(F.col(id_col))), text_col, lang_col))
    out = predict(df, profiles, id_col, text_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")


ORACLE_SQL = r"""
WITH t AS (  -- the remainders of four bits by the polynomial of crc32
  SELECT [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
          3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108] AS four
), d AS (
  SELECT doc_id, lang, text, xor(list_reduce(
           list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT)),
           lambda x, b: xor(xor(x >> 4, four[1 + (xor(x, b) & 15)]) >> 4, four[1 + (xor(xor(x >> 4, four[1 + (xor(x, b) & 15)]), b >> 4) & 15)])),
         4294967295) % 5 = 0 AS held_out
  FROM documents, t
), w AS (
  SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM d) GROUP BY ALL
), g AS (
  SELECT doc_id, gram, sum(n) AS n
  FROM (SELECT doc_id, n, unnest(list_concat(
          list_transform(range(2, length(word) + 2), lambda i: substring(' ' || word || ' ', i, 1)),
          list_transform(range(1, length(word) + 2), lambda i: substring(' ' || word || ' ', i, 2)),
          list_transform(range(1, length(word) + 1), lambda i: substring(' ' || word || ' ', i, 3)))) AS gram FROM w)
  GROUP BY ALL
), p AS (
  SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) - 1 AS rank
  FROM g JOIN d USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, gram QUALIFY rank < 300
), m AS (
  SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) - 1 AS rank FROM g QUALIFY rank < 300
), far AS (
  SELECT m.doc_id, l.lang, sum(coalesce(abs(m.rank - p.rank), 300)) AS distance, count(*) AS n
  FROM m CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN p ON p.lang = l.lang AND p.gram = m.gram GROUP BY ALL
), best AS (
  SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) = 1
)
SELECT d.doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(1 - distance::DOUBLE / (300 * n), 0) AS score
FROM d LEFT JOIN best ON best.doc_id = d.doc_id
"""
