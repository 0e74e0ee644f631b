"""The quality gate: ordered stages that only reject. A row is touched by a stage if no stage before it decided.

A rejected row has at least one code, ``LOW_QUALITY`` if its stage gives none, and a note of what the judge said, the stage and its
reasons. How many rows each stage saw and left is observed while its result is written, and told at once if someone asks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.balance import greedy_balance
from millrace.operators.decontaminate import exact_overlap, near_overlap
from millrace.operators.dedupe import deduplicate
from millrace.operators.records import set_fingerprint
from millrace.session import observed

STAGES = ("schema", "static", "judge", "dedupe", "contamination", "balance")
DEFAULT_CODE = "LOW_QUALITY"  # fixed value
#: Told after each stage: its name, the rows that it left and the rows that it saw.
Progress = Callable[[str, int, int], None]


@dataclass(frozen=True)
class Gate:
    """``static`` and ``judge``: columns of codes that reject a row; ``unjudged``: whether nobody could judge it;
    ``caps``: largest shares by axis, of the rows that come to the last stage."""

    static: Column
    judge: Column
    unjudged: Column
    caps: dict[str, float] = field(default_factory=dict)
    near: float = 0.72
    overlap: float = 0.60
    schema: Column | None = None
    static_note: Column | None = None
    judge_note: Column | None = None


def _reject(rows: DataFrame, ids: DataFrame, id_col: str, stage: str, code: str) -> DataFrame:
    hit = ids.select(F.col(id_col).alias("_hit")).distinct()
    joined = rows.join(hit, rows[id_col] == hit["_hit"], "left")
    now = F.col("_hit").isNotNull() & F.col("status").isNull()
    columns = {
        "status": F.when(now, "rejected").otherwise(F.col("status")), "stage": F.when(now, stage).otherwise(F.col("stage")), "codes": F.when(now, F.array(F.lit(code))).otherwise(F.col("codes")),
        "note": F.when(now, _noted(F.col("note"), F.lit(f"stage={stage}"))).otherwise(F.col("note")),
    }
    return joined.withColumns(columns).drop("_hit")


def _noted(*notes: Column) -> Column:
    """Notes that are not empty, one after the other."""
    return F.array_join(F.filter(F.array_compact(F.array(*notes)), lambda n: n != ""), " | ")


def run(candidates: DataFrame, evaluation: DataFrame, gate: Gate, id_col: str, text_col: str, eval_id: str, on_progress: Progress | None = None) -> DataFrame:
    """``candidates`` with ``status`` (accepted, rejected, unjudged), ``stage`` that decided (null: none), ``codes`` and ``note``.

    Ids have to be unique; their order is the order of rows. Rows that could not be judged are no rejections and meet no
    later stage.
    """
    none, empty = F.array().cast("array<string>"), F.lit("")
    codes = {"_torn": gate.schema, "_bad": gate.static, "_wrong": gate.judge}
    notes = {"_static_note": gate.static_note, "_judge_note": gate.judge_note}
    screened = candidates.withColumns(
        {name: none if c is None else F.coalesce(c, none) for name, c in codes.items()}
        | {name: empty if c is None else F.coalesce(c, empty) for name, c in notes.items()} | {"_unjudged": F.coalesce(gate.unjudged, F.lit(False))}
    )
    torn, static, judged = F.size("_torn") > 0, F.size("_bad") > 0, F.size("_wrong") > 0
    unjudged = F.col("_unjudged")
    stage = F.when(torn, "schema").when(static, "static").when(unjudged | judged, "judge")
    rows = screened.select(
        id_col, *gate.caps,
        F.when(torn | static, "rejected").when(unjudged, "unjudged").when(judged, "rejected").alias("status"), stage.alias("stage"),
        F.when(torn, F.col("_torn")).when(static, F.col("_bad")).when(judged & ~unjudged, F.col("_wrong")).otherwise(none).alias("codes"),
        F.when(torn, F.lit("stage=schema")).when(static, _noted(F.lit("stage=static"), F.col("_static_note")))
        .otherwise(_noted(F.col("_judge_note"), F.when(judged & ~unjudged, F.lit("stage=judge")))).alias("note"),
    )
    at = lambda name: F.count_if(F.col("stage") == name)
    # no texts: they are read where a stage looks at them
    rows, seen = observed(rows, n=F.count("*"), **{name: at(name) for name in STAGES[:3]})
    left_rows = seen["n"]

    def tell(name: str, gone: int) -> None:
        nonlocal left_rows
        if on_progress:
            on_progress(name, left_rows - gone, left_rows)
        left_rows -= gone

    for name in STAGES[:3]:
        tell(name, seen[name])

    def left() -> DataFrame:
        open_ = rows.where("status IS NULL").select(F.col(id_col).alias("_open"))
        return candidates.select(id_col, text_col).join(open_, candidates[id_col] == open_["_open"], "left_semi")

    copies = deduplicate(left(), id_col, text_col, gate.near).where("NOT kept").select(F.col("id").alias(id_col))
    rows, seen = observed(_reject(rows, copies, id_col, "dedupe", "DUPLICATE"), gone=at("dedupe"))
    tell("dedupe", seen["gone"])
    near = near_overlap(left(), evaluation, id_col, eval_id, text_col, gate.overlap).select(F.col("id").alias(id_col))
    known = exact_overlap(left(), evaluation, id_col, text_col).select(id_col).union(near)
    rows, seen = observed(_reject(rows, known, id_col, "contamination", "CONTAMINATED"), gone=at("contamination"))
    tell("contamination", seen["gone"])
    gone = 0
    if gate.caps:
        over = greedy_balance(rows.where("status IS NULL").select(id_col, *gate.caps), id_col, gate.caps).where("NOT kept")
        rows = _reject(rows, over, id_col, "balance", "UNBALANCED")
        if on_progress:
            rows, seen = observed(rows, gone=at("balance"))
            gone = seen["gone"]
    tell("balance", gone)
    listed = F.when((F.col("status") == "rejected") & (F.size("codes") == 0), F.array(F.lit(DEFAULT_CODE))).otherwise(F.array_distinct("codes"))
    verdicts = rows.select(F.col(id_col).alias("_id"), F.coalesce("status", F.lit("accepted")).alias("status"), "stage", listed.alias("codes"), "note")
    return candidates.join(verdicts, candidates[id_col] == verdicts["_id"]).drop("_id")


def funnel(rows: DataFrame) -> DataFrame:
    """``stage``, ``status`` and ``n``; the stage of accepted rows is accepted."""
    return rows.groupBy(F.coalesce("stage", F.lit("accepted")).alias("stage"), "status").agg(F.count("*").alias("n"))


def rejections(rows: DataFrame) -> DataFrame:
    """``code`` and ``n`` of rejected rows."""
    return rows.where("status = 'rejected'").select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def report(rows: DataFrame) -> DataFrame:
    """One row: counts by status, and the acceptance rate among the rows that were decided (null: none was)."""
    counts = rows.agg(F.count("*").alias("candidates"), *[F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "rejected", "unjudged")])
    return counts.withColumn("acceptance_rate", F.try_divide(F.col("accepted").cast("double"), (F.col("accepted") + F.col("rejected")).cast("double")))


def freeze(rows: DataFrame, digest: Column, known: str | None = None, refreeze: bool = False) -> dict[str, object]:
    """Count and fingerprint of the accepted rows. Refused while rows are unjudged, or if the fingerprint is not the ``known`` one and no refreeze is asked for."""
    if not rows.where("status = 'unjudged'").isEmpty():
        raise ValueError("rows are unjudged: the version is incomplete")
    found = set_fingerprint(rows.where("status = 'accepted'"), digest).first().asDict()
    if known is not None and found["fingerprint"] != known and not refreeze:
        raise ValueError("the accepted rows have changed since the last freeze")
    return found
