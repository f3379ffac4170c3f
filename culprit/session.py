"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is made in local mode (tests); on a
    cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = "file://" + tempfile.mkdtemp(prefix="culprit-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder, which is a fraction of the rows' size and of which only the columns that are asked for are read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/culprit/checkpoint-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a table that is shipped to all executors.
SHIPPED_BYTES = 32 << 20


def shipped_if_small(table: DataFrame, row_bytes: Column) -> DataFrame:
    """A checkpointed table, marked for broadcast if its rows have at most ``SHIPPED_BYTES``; joins shuffle a larger one."""
    size = table.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0
    return F.broadcast(table) if size <= SHIPPED_BYTES else table


#: Bits of a sieve at most, in words of 64: as many rows as a broadcast takes with ease.  More keys than a few million only let more rows through.
SIEVE_BITS = 26


def sieved(table: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """``table`` with ``_met``, which is false only where no row of ``keys`` has its values of ``on``.

    A bit a key is broadcast, 16 for each that there is, so that rows with texts
    need not be sent through a shuffle to be found without a partner.  About one
    row in seventeen is let through for nothing: the join itself still decides.
    """
    bits = 1 << max(10, min(SIEVE_BITS, (16 * keys.count()).bit_length()))
    at = F.pmod(F.xxhash64(*on), F.lit(bits))
    words = keys.select(at.alias("_at")).groupBy(F.expr("shiftright(_at, 6)").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_at % 64 as int)))").alias("_bits"))
    joined = table.withColumn("_at", at).withColumn("_word", F.expr("shiftright(_at, 6)")).join(F.broadcast(words), "_word", "left")
    return joined.select(*table.columns, F.expr("coalesce(shiftrightunsigned(_bits, cast(_at % 64 as int)) & 1L = 1L, false)").alias("_met"))
