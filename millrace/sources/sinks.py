"""Writers of dataset versions, splits and sheets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

STATUSES = ("accepted", "rejected", "unjudged")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object a line, nulls included."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_version(df: DataFrame, path: str, status: str = "status") -> None:
    """A dataset version as Parquet, a folder for each status (accepted, rejected, unjudged)."""
    df.write.mode("overwrite").partitionBy(status).parquet(path)


def write_version_report(df: DataFrame, path: str, details: dict | None = None, status: str = "status") -> dict:
    """A dataset version (rows that are evaluated once for each status) as JSON lines, a folder for each status even if it is empty, and a report of the counts, the
    acceptance rate of the judged rows and further ``details`` beside them; the report is returned."""
    found = {}
    for name in STATUSES:  # each part is counted while it is written
        seen = Observation()
        write_jsonl(df.where(F.col(status) == name).drop(status).observe(seen, F.count("*").alias("n")), f"{path}/{name}")
        found[name] = seen.get["n"]
    counts = {f"{name}_count": found.get(name, 0) for name in STATUSES}
    judged = counts["accepted_count"] + counts["rejected_count"]
    rate = round(counts["accepted_count"] / judged, 4) if judged else 0.0
    report = {"candidate_count": sum(found.values()), **counts, "acceptance_rate": rate, "complete": not counts["unjudged_count"], **(details or {})}
    write_document(df.sparkSession, report, f"{path}/report")
    return report


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """One JSON document, such as a run's settings, in a folder of its own."""
    spark.createDataFrame([(json.dumps(document, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def flattened(df: DataFrame) -> DataFrame:
    """Columns of structs as one column a field, named with dots, so that cells of different tables can be put together."""
    out = []
    for field in df.schema:
        inner = getattr(field.dataType, "names", None)
        out += [F.col(f"`{field.name}`.`{n}`").alias(f"{field.name}.{n}") for n in inner] if inner else [F.col(f"`{field.name}`")]
    return df.select(*out)


def together(*tables: DataFrame) -> DataFrame:
    """Rows of tables with different columns under the union of their headers, in the order in which names come first."""
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def write_split(df: DataFrame, path: str, split: str = "split") -> None:
    """Training and validation records as JSON lines, a folder each."""
    df.write.mode("overwrite").partitionBy(split).json(path)


def write_subsets(ranked: DataFrame, path: str, sizes: list[int], rank: str = "rank") -> None:
    """Nested subsets: each row is written once, in the folder of the least size that holds it; a subset is the union of the folders up to its size."""
    least = F.coalesce(*[F.when(F.col(rank) <= n, F.lit(n)) for n in sorted(sizes)])
    ranked.withColumn("subset", least).where("subset IS NOT NULL").write.mode("overwrite").partitionBy("subset").json(path)


def write_sheet(df: DataFrame, path: str) -> None:
    """A sheet as CSV with a header, fields quoted where needed."""
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def flat_text(df: DataFrame) -> DataFrame:
    """Small tables for reports: maps as ``k=v; k=v``, arrays joined by semicolons, doubles with three places."""

    def flat(name: str, kind: str):  # noqa: ANN202
        c = F.col(f"`{name}`")
        if kind.startswith("map"):
            return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "; ")
        if kind.startswith("array"):
            return F.array_join(c.cast("array<string>"), "; ")
        return F.format_string("%.3f", c) if kind == "double" else c.cast("string")

    return df.select(*[flat(n, k).alias(n) for n, k in df.dtypes])


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small table as markdown; a table of more than ``limit`` rows is refused."""
    rows = flat_text(df).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])
