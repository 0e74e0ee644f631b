"""Plans drawn from seeded generators: each seed's own generator makes its row, so rows can be made anywhere and in any order.

``SeededPlan`` is a data source that deals a range of seeds out to partitions, ``with_dimensions`` draws for the seeds of any table.
Both give what the standard library's generator gives for that seed, draw for draw; ``plan.sample_plan`` follows the same
rules by hashes and needs no Python, but gives other rows.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.sources.plan import CATEGORIES, COMPETENCE, DIFFICULTIES, HINTS, LATER, PRESSURE_WEIGHTS, TURN_WEIGHTS

Drawn = dict[str, object]
#: Rows of a partition, and of a batch of it.
PARTITION, BATCH = 200_000, 10_000
# What is drawn alike by several.
BY_PRESSURE = {"solved": ("solved",), "almost_correct": ("close",), "fake_success": ("partial", "close")}
ELSE_PROGRESS, ELSE_FRUSTRATION = ("stuck", "stuck", "partial", "close"), ("none", "none", "mild")
HIGH, VARIED, HINT_KINDS = ("frustrated", "repeated_answer_request"), 0.25, ("nudge", "pointed", "narrow")


def _progress(rng: random.Random, row: Drawn) -> object:
    values = BY_PRESSURE.get(str(row["pressure"]), ELSE_PROGRESS)
    return values[0] if len(values) == 1 else rng.choice(values)  # what is certain is not drawn


#: What is drawn, in the order in which the generator is asked; each may look at what has been drawn before it.
DRAWS: tuple[tuple[str, Callable[[random.Random, Drawn], object]], ...] = (
    ("language", lambda rng, row: rng.choice(tuple(CATEGORIES))),
    ("pressure", lambda rng, row: rng.choices(tuple(PRESSURE_WEIGHTS), tuple(PRESSURE_WEIGHTS.values()))[0]),
    ("turns", lambda rng, row: rng.choices(tuple(TURN_WEIGHTS), tuple(TURN_WEIGHTS.values()))[0]),
    ("turns", lambda rng, row: rng.choice((1, 2)) if not row["turns"] and row["pressure"] in LATER else row["turns"]),
    ("progress", _progress),
    ("frustration", lambda rng, row: "high" if row["pressure"] in HIGH else rng.choice(ELSE_FRUSTRATION)),
    ("hint", lambda rng, row: rng.choice(HINT_KINDS) if rng.random() < VARIED else HINTS[str(row["progress"])]),
    ("category", lambda rng, row: rng.choice(CATEGORIES[str(row["language"])])),
    ("difficulty", lambda rng, row: rng.choice(DIFFICULTIES)),
    ("competence", lambda rng, row: rng.choice(COMPETENCE)),
)
NAMES = ("language", "category", "difficulty", "pressure", "turns", "competence", "frustration", "hint", "progress")
SCHEMA = StructType([StructField(n, LongType() if n == "turns" else StringType()) for n in NAMES])


def dimensions(seed: int) -> Drawn:
    """The dimensions of one seed."""
    rng, row = random.Random(seed), {}
    for name, draw in DRAWS:
        row[name] = draw(rng, row)
    return row


@F.pandas_udf(SCHEMA)
def _of_seeds(seeds: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([dimensions(int(s)) if pd.notna(s) else dict.fromkeys(NAMES) for s in seeds], columns=list(NAMES)).astype({"turns": "Int64"})


def with_dimensions(df: DataFrame, seed: Column) -> DataFrame:
    """``df`` with the dimensions of each row's seed as columns; those of a null seed are null. No column may have one of their names."""
    return df.withColumn("_drawn", _of_seeds(seed.cast("long"))).select(*[F.col(f"`{c}`") for c in df.columns], "_drawn.*")


class _Seeds(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        super().__init__((start, end))
        self.start, self.end = start, end


class _Reader(DataSourceReader):
    def __init__(self, base: int, count: int, size: int) -> None:
        self.base, self.count, self.size = base, count, size

    def partitions(self) -> list[_Seeds]:
        """Runs of seeds; at least one, which may be empty."""
        return [_Seeds(self.base + at, self.base + min(at + self.size, self.count)) for at in range(0, max(self.count, 1), self.size)]

    def read(self, partition: _Seeds) -> Iterator[pa.RecordBatch]:
        for at in range(partition.start, partition.end, BATCH):
            seeds = range(at, min(at + BATCH, partition.end))
            rows = [dimensions(s) for s in seeds]
            arrays = [pa.array(list(seeds), pa.int64()), *(pa.array([r[n] for r in rows], pa.int64() if n == "turns" else pa.string()) for n in NAMES)]
            yield pa.RecordBatch.from_arrays(arrays, names=["seed", *NAMES])


class SeededPlan(DataSource):
    """``spark.read.format("seeded_plan")`` with the options ``count``, ``seed`` (the first) and ``partitionRows``."""

    @classmethod
    def name(cls) -> str:
        return "seeded_plan"

    def schema(self) -> StructType:
        return StructType([StructField("seed", LongType()), *SCHEMA])

    def reader(self, schema: StructType) -> _Reader:
        count, size = int(self.options.get("count", 0)), int(self.options.get("partitionrows", PARTITION))
        if count < 0 or size < 1:
            raise ValueError("count is 0 or more, partitionRows 1 or more")
        return _Reader(int(self.options.get("seed", 20240101)), count, size)


def seeded_plan(spark: SparkSession, count: int, base_seed: int = 20240101, partition_rows: int = PARTITION) -> DataFrame:
    """``count`` rows of a plan: ``seed``, from the first on, and its dimensions."""
    spark.dataSource.register(SeededPlan)
    return spark.read.format("seeded_plan").option("count", count).option("seed", base_seed).option("partitionRows", partition_rows).load()
