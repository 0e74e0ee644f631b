"""The registered query of each operator, with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import alignment, bpe, chat_format, exact_dedup, filter_audit, language_id, packing, pii, quality_rules, simhash, substring_dedup, suffix_dedup, token_counts
from millrace.llm.common import table


def tokenizer(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Key of the surrogates in these queries; a deployment sets its own.
PII_KEY = "registered query"

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates by SimHash."""
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, and one that quotes the template itself, formatted and read back."""
    quoting = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", quoting), (-7, 1, "assistant", quoting)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.read_back(chat_format.format_turns(rows))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates by progressive refinement."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digest=True)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and host rules."""
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of a unigram vocabulary."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that start in an earlier document, removed."""
    return suffix_dedup.kept_digests(suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates."""
    return pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 words that stand earlier, removed."""
    return substring_dedup.kept_digests(substring_dedup.repeated_windows(table(spark, sf_dir, "documents")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE there and back."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers that cover the same bytes."""
    return alignment.link_statistics(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions of five filters in each source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by profiles of the documents that are not held out."""
    return language_id.identify(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""


def corpus_pipeline_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the pipeline at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    own = (op1_simhash, op2_chat_format, op3_exact_dedup, op4_packing, op5_quality_rules, op6_token_counts, op7_suffix_dedup, op8_pii, op9_substring_dedup, op10_bpe, op11_alignment, op12_filter_audit, op13_language_id)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline_run}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat_format.ORACLE_SQL, "op3_exact_dedup": OP3_SQL, "op5_quality_rules": quality_rules.ORACLE_SQL, "op9_substring_dedup": substring_dedup.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL, "op13_language_id": language_id.ORACLE_SQL}
