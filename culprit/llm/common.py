"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from culprit.session import sieved  # noqa: F401


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it.  Only where that is unset and Spark runs
    in one process (tests) a temporary folder is made and installed as
    checkpoint folder; a cluster without a shared folder is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        set_to = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_to.isDefined():
            return set_to.get()
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="culprit-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Lineage is cut by a table that every executor can read again, so the loss
    of an executor costs no more than its running tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/culprit/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished steps: it does so once the driver has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            remove(t.sparkSession, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever file system it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def freeing(run: Callable) -> Callable:
    """``run`` over a task's batches; then free memory goes back to the system, as the worker and what other tasks need live on."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


def arrow_map(
    df: DataFrame,
    schema: str,
    make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict] | None]],
    out: pa.Schema,
) -> DataFrame:
    """Run ``make()`` once per task and its result on every Arrow batch.

    The per-batch function yields dicts of column lists in the order of ``out``.
    """

    def run(batches):
        step = make()
        for batch in batches:
            for cols in step(batch):
                yield pa.RecordBatch.from_arrays([c if isinstance(c := cols[f.name], pa.Array) else pa.array(c, f.type) for f in out], schema=out)

    return df.mapInArrow(freeing(run), schema)


def texts(column: pa.Array) -> list[str]:
    """Python strings of a column; null becomes the empty string."""
    return [t or "" for t in column.to_pylist()]
