"""Judges as plug-ins: answers to prompts from whatever a judge asks, for the rows that no cache answers.

A judge is made by a registered factory, once a task, and gets prompts in batches of bounded size. Rows with the same key are
asked once. Answers are written before anything uses them: to a journal, if there is one, else to a checkpoint, so that none
is paid for twice when a later step is tried again. A judge that fails leaves its batch unanswered; what is
unanswered is unjudged, no rejection, never enters a journal and is asked again by the next run.
"""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.criteria import judge_codes
from millrace.functions.judging import answer_warnings
from millrace.functions.text import let
from millrace.functions.verdicts import verdict
from millrace.operators.resume import last_of, with_cached
from millrace.session import checkpointed, path_exists

#: Prompts that a judge gets at once.
BATCH = 64
UNJUDGED = "UNJUDGED"  # fixed value: the code of a row that nobody could judge


class Judge(ABC):
    """Who answers. ``name``, ``family`` and ``prompt_version`` are noted beside each answer."""

    name, family, prompt_version = "unknown", "unknown", "1.0.0"

    @abstractmethod
    def answers(self, prompts: list[str]) -> list[str | None]:
        """An answer to each prompt, null where there is none."""


@dataclass(frozen=True)
class Described:
    """A registered judge with its options: what a run needs to make it in a task, and to name it."""

    make: Callable[[], Judge]
    name: str
    family: str
    prompt_version: str


_REGISTRY: dict[str, Callable[..., Judge]] = {}


def register(name: str) -> Callable[[Callable[..., Judge]], Callable[..., Judge]]:
    """Register a factory of judges under a name, which no other has."""

    def keep(factory: Callable[..., Judge]) -> Callable[..., Judge]:
        if _REGISTRY.setdefault(name, factory) is not factory:
            raise ValueError(f"a judge {name} is registered already")
        return factory

    return keep


def judge(name: str, **options: object) -> Described:
    """The registered judge of that name; its factory gets the options."""
    if name not in _REGISTRY:
        raise ValueError(f"no judge {name}; there are {', '.join(sorted(_REGISTRY))}")
    factory = _REGISTRY[name]
    one = factory(**options)
    return Described(lambda: factory(**options), one.name, one.family, one.prompt_version)


@register("scripted")
class Scripted(Judge):
    """Answers by rules: of (pattern, answer) the first whose pattern is found in the prompt answers, with the pattern's groups filled
    in for ``\\1`` and so on; a null answer, and no rule, is none. A pattern ``!`` raises, as an unreachable judge does."""

    name, family = "scripted:rules", "scripted"

    def __init__(self, rules: list[tuple[str, str | None]]) -> None:
        self.rules = [(re.compile(p) if p != "!" else None, a) for p, a in rules]

    def answers(self, prompts: list[str]) -> list[str | None]:
        return [self._answer(p) for p in prompts]

    def _answer(self, prompt: str) -> str | None:
        for pattern, answer in self.rules:
            if pattern is None:
                raise ConnectionError("unreachable")
            if found := pattern.search(prompt):
                return answer and found.expand(answer)
        return None


def ask(prompts: DataFrame, who: Described, batch: int = BATCH) -> DataFrame:
    """``key`` and ``answer`` of the rows (key, prompt), null where the judge had none or failed on the batch."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = who.make()
        for rows in batches:
            for start in range(0, rows.num_rows, batch):
                part = rows.slice(start, batch)
                try:
                    answers = judge.answers(part["prompt"].to_pylist())
                except Exception:  # noqa: BLE001  whatever a plug-in meets, its rows wait
                    answers = [None] * part.num_rows
                yield pa.RecordBatch.from_arrays([part["key"], pa.array(answers, pa.string())], names=["key", "answer"])

    return prompts.mapInArrow(asked, f"key {prompts.schema['key'].dataType.simpleString()}, answer string")


def read_journal(spark: SparkSession, path: str, key: str = "string") -> DataFrame:
    """The last answer of each key of a journal as (key, answer); a journal that is not there yet is empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"key {key}, answer string")
    return last_of(spark.read.schema(f"key {key}, answer string, run long").parquet(path), ["key"], F.col("run"), F.col("answer")).select("key", "answer")


def answered(df: DataFrame, who: Described, key: Column, prompt: Column, cache: DataFrame | None = None, journal: str | None = None, batch: int = BATCH) -> DataFrame:
    """``df`` with ``answer`` (null: nobody could be asked), ``from_cache``, ``judge_model``, ``judge_family`` and ``prompt_version``.

    ``cache`` has columns key and answer, ``journal`` is a folder whose answers serve as a cache and which new ones are added
    to. Null keys are a key; null prompts are not asked. Order is that of ``df`` by whatever ordinal it has; repeated rows come back as often as they were.
    """
    spark, names = df.sparkSession, df.columns
    rows = df.withColumns({"_key": key, "_prompt": prompt})
    kind = rows.schema["_key"].dataType.simpleString()
    known = [x.select(F.col("key").alias("_key"), F.col("answer").alias("_cached")) for x in (cache, journal and read_journal(spark, journal, kind)) if x is not None]
    hit = rows.withColumn("_cached", F.lit(None).cast("string"))
    if known:
        hit = with_cached(rows, known[0] if len(known) == 1 else known[0].unionByName(known[1]), "_key", "_cached")
    missing = hit.where("_cached IS NULL").groupBy(F.col("_key").alias("key")).agg(F.min("_prompt").alias("prompt")).where("prompt IS NOT NULL")
    fresh = ask(missing, who, batch)
    if journal:
        run = spark.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]  # one number
        fresh = checkpointed(fresh)
        fresh.where("answer IS NOT NULL").withColumn("run", F.lit(run)).write.mode("append").parquet(journal)
    else:
        fresh = checkpointed(fresh)
    fresh = fresh.select(F.col("key").alias("_asked"), F.col("answer").alias("_fresh"))
    out = hit.join(fresh, hit["_cached"].isNull() & hit["_key"].eqNullSafe(fresh["_asked"]), "left")
    noted = {"judge_model": who.name, "judge_family": who.family, "prompt_version": who.prompt_version}
    return out.select(*[F.col(f"`{c}`") for c in names], F.coalesce("_cached", "_fresh").alias("answer"), F.col("_cached").isNotNull().alias("from_cache"), *[F.lit(v).alias(k) for k, v in noted.items()])


def judged_candidates(df: DataFrame, pressure: Column) -> DataFrame:
    """``df`` (with ``answer``) with what a gate needs: ``codes`` that reject a row, ``UNJUDGED`` alone for one without an answer, and
    ``note``, the scores in words."""

    def result(r: Column) -> Column:
        v = lambda name: F.coalesce(r["v"][name], F.lit(0.0))
        codes = judge_codes(r["v"]["failure_reasons"], v("spec_adherence"), v("hint_relevance"), v("robustness"), F.coalesce(r["v"]["passed"], F.lit(False)), pressure)
        waits = F.array_contains(r["w"], "judge_unavailable")
        note = F.format_string("judge adherence=%.2f robustness=%.2f relevance=%.2f", v("spec_adherence"), v("robustness"), v("hint_relevance"))
        codes, note = F.when(waits, F.array(F.lit(UNJUDGED))).otherwise(codes), F.when(waits, "judge unavailable (infrastructure)").otherwise(note)
        return F.struct(codes.alias("codes"), note.alias("note"))

    # columns that name the verdict's fields would be one evaluation of it for each field
    both = let(F.struct(verdict(F.col("answer")).alias("v"), answer_warnings(F.col("answer")).alias("w")), result)
    return df.withColumn("_judged", both).withColumns({"codes": F.col("_judged.codes"), "note": F.col("_judged.note")}).drop("_judged")
