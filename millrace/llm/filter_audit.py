"""How filters act on each other: for each order of them, what each removes, what it finds gone already, and what is lost by it.

Each text's failures are one bit mask. Equality with an earlier text is decided by a sort: rows are dealt by range of a
128-bit fingerprint and the id, and sorted in their partition by fingerprint, whole text and id, so that the first row of
a run of equal texts is what all others are compared with, and a run of any size may lie in many partitions. Range keys
are numbers only, as their sample goes to the driver. A run can begin in an earlier partition; what is open are the rows at
the front of a partition's first fingerprint, and they are joined with the ends of all partitions by the text itself.
Texts move once; from then on rows are ids and masks, and these become counters of (part, mask), from which every order
and step follows by additions, whatever the number of documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed

CAPITALS, SYMBOLS, FOLLOWING = bytes(range(ord("A"), ord("Z") + 1)), b"#$%&*|", bytes(range(0x80, 0xC0))
#: The filters: few words, repetitive, many capitals, symbols, repeated text. The last one is decided by the sort.
FILTERS = "ABCDE"


def text_failures(text: bytes) -> int:
    """The bits of the filters A to D that a text in UTF-8 fails."""
    words = text.split()  # of bytes: at ASCII white space
    capitals, points = len(text) - len(text.translate(None, CAPITALS)), len(text.translate(None, FOLLOWING))
    repetitive, shouting = 100 * len(set(words)) < 65 * len(words), 100 * capitals > 5 * points
    return (len(words) < 50) | repetitive << 1 | shouting << 2 | (len(text.translate(None, SYMBOLS)) < len(text)) << 3


def _rows(kind: str, part: str, out: list[tuple]) -> pa.RecordBatch:
    types = [kind, part, pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
    columns = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "part", "mask", "n", "end", "a", "b", "text"])


def failure_masks(df: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text", failures: Callable[[bytes], int] = text_failures, repeated_bit: int = 16) -> DataFrame:
    """Rows (id, part, mask, n): ``n`` rows of ``df`` with the failures ``mask`` of their whole text, null being empty.

    ``repeated_bit`` is set where a smaller id has an identical text. Rows with the same id do not repeat each other, and
    null ids are neither smaller nor larger than any. Null parts are empty strings. An empty table gives an empty one;
    other columns of ``df`` may have any names. A text is held whole in its task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.repartitionByRange("a", "b", "id").sortWithinPartitions("a", "b", "text", "id")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        front = group = run = first = None  # fingerprint of the first rows and of the last, last text and its least id
        least: dict[bytes, object] = {}  # of the texts of the last fingerprint
        open_rows: Counter[tuple] = Counter()
        mask, schema = 0, None
        for batch in batches:
            schema, out = batch.schema, []
            texts = batch["text"].cast(pa.binary())
            for key, part, value, a, b in zip(batch["id"].to_pylist(), batch["part"].to_pylist(), texts, batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                data = value.as_py()
                if (a, b) != group:
                    group, run, least = (a, b), None, {}
                    front = front or group
                if data != run:
                    run, first, mask = data, None, failures(data)
                if key is not None and first is None:
                    first = least[data] = key
                if key is not None and key == first and group == front:
                    open_rows[key, part, mask, a, b, data] += 1
                else:
                    out.append((key, part, mask | (repeated_bit if key is not None and first < key else 0), 1, False, None, None, None))
            if out:
                yield _rows(schema.field("id").type, schema.field("part").type, out)
        out = [(key, part, m, n, False, a, b, data.decode()) for (key, part, m, a, b, data), n in open_rows.items()]
        out += [(key, "", 0, 0, True, *group, data.decode()) for data, key in least.items()]
        if out:
            yield _rows(schema.field("id").type, schema.field("part").type, out)

    marked = checkpointed(dealt.mapInArrow(compared, f"id {kind}, part string, mask int, n long, end boolean, a long, b long, text string"))
    edge = ["a", "b", "text"]
    ends = marked.where("end").groupBy(edge).agg(F.min("id").alias("first"))
    fronts = marked.where(~F.col("end") & F.col("text").isNotNull()).join(ends, edge, "left")
    decided = fronts.select("id", "part", F.when(F.col("first") < F.col("id"), F.col("mask").bitwiseOR(repeated_bit)).otherwise(F.col("mask")).alias("mask"), "n")
    return marked.where(F.col("text").isNull()).select("id", "part", "mask", "n").unionByName(decided)


def part_counters(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (part, mask, n, good, toxic): documents, and those of them with a label of quality 1 or toxic 1. An id with several
    labels counts once. They add up, so counters of several corpora can be merged by another sum."""
    flags = labels.groupBy(F.col(id_col).alias("id")).agg(*[F.max((F.col(x) == 1).cast("int")).alias(y) for x, y in (("quality", "good"), ("toxic", "toxic"))])
    rows = masks.join(flags, "id", "left")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(x, F.lit(0))).alias(x) for x in ("good", "toxic")])


def interactions(counters: DataFrame, filters: str = FILTERS) -> DataFrame:
    """For each part, order of the filters and step: ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost`` and
    ``shapley``. A part has at most 2^n counters for n filters and n * n! rows."""
    n = len(filters)
    rows = counters.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("found"))
    rows = rows.select("part", "found", F.explode(F.split(F.lit(" ".join(map("".join, permutations(filters)))), " ")).alias("filter_order"))
    powers, names = F.array(*[F.lit(1 << k) for k in range(n)]), F.lit(filters)
    bits = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.element_at(powers, F.instr(names, F.substring("filter_order", k, F.lit(1)))))
    rows = rows.select("*", bits.alias("bits"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    before = F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda x, y: x + y)
    rows = rows.select("part", "found", "filter_order", "step", F.element_at("bits", F.col("step")).alias("bit"), before.alias("before"))
    bit, before = F.col("bit"), F.col("before")

    def total(value: Callable[[Column], Column], where: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.filter("found", lambda x: where(x["mask"])), F.lit(0).cast("long"), lambda s, x: s + value(x).cast("long"))

    def failing(mask: Column) -> Column:
        return mask.bitwiseAND(bit) != 0

    def gone(mask: Column) -> Column:
        return mask.bitwiseAND(before) != 0

    return rows.select(
        "part", "filter_order", "step",
        total(lambda x: x["n"], lambda m: ~gone(m) & ~failing(m)).alias("kept"),
        total(lambda x: x["n"], lambda m: failing(m) & ~gone(m)).alias("removed"),
        total(lambda x: x["n"], lambda m: failing(m) & gone(m)).alias("redundant"),
        total(lambda x: x["n"], lambda m: m == bit).alias("unique_fails"),
        total(lambda x: x["good"], lambda m: failing(m) & ~gone(m)).alias("good_lost"),
        total(lambda x: x["toxic"], lambda m: failing(m) & ~gone(m)).alias("toxic_lost"),
        # of the orders, the failing filter that comes first removes: each of a document's as often as the others
        total(lambda x: x["n"] * (factorial(n) / F.bit_count(x["mask"])), failing).alias("shapley"),
    )


def audit(df: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The interactions of the five filters over ``df``; see ``failure_masks`` for nulls and repeats. Without rows there are no parts."""
    return interactions(part_counters(failure_masks(df, part_col, id_col, text_col), labels, id_col))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(first < t.doc_id, false)::INT AS mask
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id
), c AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL
), f(letter, bit) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), o AS (
  SELECT v.letter || w.letter || x.letter || y.letter || z.letter AS filter_order
  FROM f v, f w, f x, f y, f z WHERE v.bit + w.bit + x.bit + y.bit + z.bit = 31 AND v.bit | w.bit | x.bit | y.bit | z.bit = 31
), s AS (
  SELECT filter_order, step::INT AS step, (SELECT bit FROM f WHERE letter = filter_order[step]) AS bit,
         (SELECT coalesce(sum(bit), 0)::INT FROM f WHERE contains(filter_order[1:step - 1], letter)) AS earlier
  FROM o, range(1, 6) r(step)
)
SELECT part, filter_order, step,
       coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & earlier <> 0), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & bit <> 0), 0)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step
"""
