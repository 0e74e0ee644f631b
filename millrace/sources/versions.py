"""Frozen dataset versions: data that never change, and a log whose last entry says which of them hold.

A freeze writes its rows to a folder of their own and then renames an entry into the log under the next number, which fails if
somebody else has taken it. Readers look at the last entry only, so that they see the version before or the one after, never a
part; folders without an entry are of freezes that failed, and nobody reads them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.records import set_fingerprint
from millrace.session import path_exists


class Refused(ValueError):
    """A freeze that must not be."""


@dataclass(frozen=True)
class VersionLog:
    """The log and the data of one dataset under ``path``, in any store that can rename a file to a name that is free and fail otherwise."""

    spark: SparkSession
    path: str

    def entries(self) -> DataFrame:
        """``number`` and ``entry`` (JSON) of all freezes."""
        if not path_exists(self.spark, f"{self.path}/log"):
            return self.spark.createDataFrame([], "number long, entry string")
        lines = self.spark.read.text(f"{self.path}/log/*.json", wholetext=True)
        return lines.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("long").alias("number"), F.col("value").alias("entry"))

    def last(self) -> tuple[int, dict] | None:
        """The last freeze, with its number; null if there is none."""
        row = self.entries().agg(F.max_by("entry", "number").alias("entry"), F.max("number").alias("number")).first()
        return None if row["number"] is None else (row["number"], json.loads(row["entry"]))

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of the last freeze, or of an earlier one."""
        found = self.last() if number is None else next(((n, json.loads(e)) for n, e in self.entries().where(F.col("number") == number).collect()), None)
        if found is None:
            raise Refused(f"{self.path}: nothing is frozen" if number is None else f"{self.path}: no freeze {number}")
        return self.spark.read.parquet(f"{self.path}/{found[1]['data']}")

    def commit(self, rows: DataFrame, entry: dict, after: int) -> dict:
        """Freeze ``rows`` as the one after the freeze ``after`` (0: as the first); refused if that has been followed by another one."""
        data = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{data}")
        entry = entry | {"number": after + 1, "data": data}
        self._rename_in(json.dumps(entry, ensure_ascii=False, sort_keys=True), after + 1)
        return entry

    def _rename_in(self, text: str, number: int) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        place = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{name}")
        draft, final = place(f"draft-{uuid.uuid4().hex}"), place(f"{number:08d}.json")
        out = final.getFileSystem(conf).create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.getFileSystem(conf).getUri(), conf)
        try:
            files.rename(draft, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            final.getFileSystem(conf).delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Refused(f"{self.path}: freeze {number} was made by somebody else") from None
            raise


def freeze(log: VersionLog, rows: DataFrame, digest: Column, id_col: str, about: dict | None = None, status: str = "status", refreeze: bool = False) -> dict:
    """Freeze the accepted rows of ``rows`` and return the entry: counts, hashes of the rows and of their ids, and ``about``.

    Refused while rows are unjudged, if nothing is accepted, and if the rows are not those of the last freeze, unless a refreeze is asked
    for. If they are, nothing is written and the last entry is returned. Hashes do not depend on the order of rows.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(status).agg(F.count("*")).collect()}  # one row a status
    if counts.get("unjudged"):
        raise Refused(f"{counts['unjudged']} rows are unjudged: that is no rejection, and the version is incomplete")
    if not counts.get("accepted"):
        raise Refused("no row is accepted")
    accepted = rows.where(F.col(status) == "accepted")
    found = set_fingerprint(accepted, digest).first()["fingerprint"]
    last = log.last()
    if last and last[1]["dataset_hash"] == found:
        return last[1]
    if last and not refreeze:
        raise Refused(f"the rows have changed since freeze {last[0]}: {last[1]['dataset_hash']} is now {found}")
    ids = set_fingerprint(accepted, F.sha2(F.col(id_col).cast("string"), 256)).first()["fingerprint"]
    entry = {"frozen": True, "candidate_count": sum(counts.values()), "accepted_count": counts["accepted"], "rejected_count": counts.get("rejected", 0), "unjudged_count": 0, "dataset_hash": found, "content_hash_of_ids": ids}
    return log.commit(accepted.drop(status), entry | (about or {}), last[0] if last else 0)


def verified(log: VersionLog, digest: Column, source: str | None = None) -> list[str]:
    """What is wrong with the last freeze: rows that are not those that were frozen, or another source than the one it names."""
    last = log.last()
    if last is None:
        return ["nothing is frozen"]
    _, entry = last
    found = set_fingerprint(log.read(), digest).first()
    wrong = {"dataset_hash": found["fingerprint"] != entry["dataset_hash"], "accepted_count": found["n"] != entry["accepted_count"], "source_dataset_hash": source is not None and entry.get("source_dataset_hash") != source}
    return [name for name, bad in wrong.items() if bad]


def manifest(logs: dict[str, VersionLog]) -> DataFrame:
    """A row for each dataset: ``version``, ``frozen``, ``number``, ``accepted_count`` and ``dataset_hash`` of its last freeze; datasets without one are not frozen."""
    spark = next(iter(logs.values())).spark
    rows = []
    for version, log in sorted(logs.items()):  # a handful of versions
        last = log.last()
        rows.append((version, last is not None, last and last[0], last and last[1]["accepted_count"], last and last[1]["dataset_hash"]))
    return spark.createDataFrame(rows, "version string, frozen boolean, number long, accepted_count long, dataset_hash string")
