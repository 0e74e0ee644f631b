"""What operators need of the session: the shared folder and checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Rows up to which a counted table may be broadcast.
BROADCAST_ROWS = 100_000
#: The same for tables of two or three numbers a row.
BROADCAST_TERMS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one, on
    one machine only, as in tests; a cluster without it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def observed(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``checkpointed``, and the aggregates ``counts`` over the rows that were written, without another job."""
    seen = Observation()
    out = checkpointed(df.observe(seen, *[c.alias(name) for name, c in counts.items()]))
    return out, seen.get


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path, in whatever store Spark reads it from."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
