"""Corpus pipeline: quality, near-duplicates, repeated substrings, benchmark leaks, packing.

``run`` applies the stages to ``documents``; each stage's result is written as
Parquet in the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from culprit.llm.common import discard, materialize
from culprit.llm.decontam import decontaminate
from culprit.llm.nearcopies import one_of_each
from culprit.llm.packing import pack
from culprit.llm.quality import classify, train
from culprit.llm.suffix import deduplicate

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_REST = ("text", "lang", "source", "n_chars")


def _byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects.

    A null text is judged as an empty one; without any label all documents stay.
    Columns other than those of ``documents`` are dropped, here and in the later
    stages; rows that repeat, null ids and empty tables pass through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    return classify(docs, model, keep=_REST).where("predicted = 1").select(COLUMNS)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of documents linked by 0.8 or more of five-word shingles one row, of the least id.

    SimHash finds the closest; what 64 bits can't tell is compared by the shingles
    themselves.  Null and empty texts are one group; of repeated rows one stays;
    different texts of one id are told apart, and a null id comes after all others.
    """
    return one_of_each(docs, width=5, least=0.8).select(COLUMNS)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut bytes in 100-byte strings that start earlier from the texts.

    Every row stays, if only with an empty text (a null text becomes empty); of
    rows that share an id none is earlier than the other.
    """
    cut = deduplicate(docs, window=100, keep=("lang", "source"), with_text=True)
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a whole window of 13 benchmark words, however long they are, or items of fewer words in a twentieth of theirs.

    Null and empty texts have no window and stay; an empty benchmark drops nothing.
    """
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=13, keep=_REST)
    return found.where("not contaminated and n_hit < 13").select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens; the tables of chunks are small, as other stages' workers share the memory."""
    return pack(docs, _byte_bpe(), window=1024, end_id=0, table_size=50_000)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicate_groups),
    ("substring dedup", repeated_substrings),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", packing),
]

#: SQL can't express the classifier, the groups of near copies or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
