"""Contract queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from culprit.llm import oracles


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from culprit.llm.warc import archive_and_deduplicate

    return archive_and_deduplicate(_table(spark, sf_dir, "pages"), least_bytes=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def _held(name: str, modulus: int, remainder: int):
    """Rows whose crc32 of the id as text has that remainder."""
    return F.crc32(F.col(name).cast("string")) % modulus == remainder


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from culprit.llm.quality import classify, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, _table(spark, sf_dir, "labels").where(~_held("doc_id", 3, 1)))
    return classify(docs, model).select("doc_id", _held("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from culprit.llm.embed import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.9)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from culprit.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, tau=3, seed=42).select("doc_id", "fingerprint", "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from culprit.llm.langid import identify, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~_held("doc_id", 5, 0)))
    return identify(docs, model).select("doc_id", _held("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from culprit.llm.html import extract

    return extract(_table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from culprit.llm.tokens import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), _byte_bpe(), limit=1024)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from culprit.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), _byte_bpe(), window=1024, end_id=0)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from culprit.llm.suffix import deduplicate

    return deduplicate(_table(spark, sf_dir, "documents"), window=100)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from culprit.llm.decontam import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=13)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_revisits": op1_warc_revisits,
        "op2_quality": op2_quality,
        "op3_token_counts": op3_token_counts,
        "op4_packing": op4_packing,
        "op5_embedding_neardup": op5_embedding_neardup,
        "op6_simhash": op6_simhash,
        "op7_language_id": op7_language_id,
        "op8_html_extraction": op8_html_extraction,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_decontamination": op10_decontamination,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for four of them; the others need a tokenizer, a trained model, XXH64 or a page parser."""
    return dict(oracles.SQL)
