"""A journal of verdicts fed from a drop folder: each key once, and none that only stands in for a verdict.

Which keys are there is the state of the streaming query, kept by key in its state store, so that a batch looks at the
keys that it brings and not at the journal. A batch that is tried again, a file that is dropped twice and a late
duplicate add nothing. Of a key's verdicts the first batch with it counts, and in it the least by ``order``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def journal(spark: SparkSession, folder: str, target: str, checkpoint: str, schema: str, key: str, order: str, unavailable: Column, fmt: str = "json", files: int = 64) -> int:
    """Take the new files of ``folder`` into ``target`` (Parquet); the number of keys that were added.

    ``unavailable`` says which rows are no verdicts: they are passed over, so that the key can come again. Null keys and orders
    are passed over, too.
    """
    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(folder)
    usable = stream.where(~F.coalesce(unavailable, F.lit(False)) & F.col(key).isNotNull() & F.col(order).isNotNull())
    names = usable.columns

    def first(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """The least row of a key that has none yet; one row is held at a time."""
        if state.exists:
            return
        best = None
        for batch in batches:
            least = batch.sort_values(order, kind="stable").head(1)
            best = least if best is None or least[order].iloc[0] < best[order].iloc[0] else best
        state.update((True,))
        yield best[names]

    once = usable.groupBy(key).applyInPandasWithState(first, usable.schema, "there boolean", "append", GroupStateTimeout.NoTimeout)
    query = once.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p.stateOperators[0].numRowsUpdated for p in query.recentProgress if p.stateOperators)
