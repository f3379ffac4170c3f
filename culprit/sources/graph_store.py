"""Stored graphs, indexes and ingestion state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from culprit.operators.graph import EDGES, NODES, duplicates


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """K2, K4: Parquet, edges partitioned by relationship.

    The tables may come from the same path: they are written beside it and
    put in its place when both are complete.
    """
    spark = nodes.sparkSession
    fresh, old = f"{path}.writing", f"{path}.old"
    nodes.write.mode("overwrite").parquet(f"{fresh}/nodes")
    edges.write.mode("overwrite").partitionBy("relationship").parquet(f"{fresh}/edges")
    hadoop = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hadoop(old), True)
    if fs.exists(hadoop(path)):
        fs.rename(hadoop(path), hadoop(old))
    fs.rename(hadoop(fresh), hadoop(path))
    fs.delete(hadoop(old), True)
    for part in ("nodes", "edges"):
        spark.catalog.refreshByPath(f"{path}/{part}")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A stored graph; a relationship filter prunes folders."""
    edges = spark.read.schema(EDGES).parquet(f"{path}/edges")
    return spark.read.schema(NODES).parquet(f"{path}/nodes"), edges


_PLAIN_NODE = ("id", "name", "type", "file_path", "line_number", "language", "docstring", "confidence", "last_modified")
_PLAIN_EDGE = ("id", "source_id", "target_id", "relationship", "confidence", "is_resolved")


def write_document(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """K1: one JSON document ``{"nodes": [...], "edges": [...]}`` in a folder, an element a line, which :func:`read_document` reads.

    Elements are in insertion order.  A document is one file, so one task writes
    it, a row at a time; many read it.  JSON lines (:func:`write_json`) have no such limit.
    """
    spark = nodes.sparkSession

    def lines(d: DataFrame, plain: tuple[str, ...], at: int) -> DataFrame:
        more = [c for c in d.columns if c not in plain and c not in ("ord", "metadata")]
        rows = d.select("ord", "id", F.to_json(F.struct(*(c for c in plain if c in d.columns), F.struct(*more).alias("metadata"))).alias("value"))
        first = rows.agg(F.min(F.struct("ord", "id")).alias("f"))
        comma = F.when(F.struct("ord", "id") == F.col("f"), "    ").otherwise("  , ")
        return rows.join(F.broadcast(first)).select(F.lit(at).alias("part"), "ord", "id", F.concat(comma, "value").alias("value"))  # one row

    fixed = spark.createDataFrame([(0, '{\n  "nodes": ['), (2, '  ],\n  "edges": ['), (4, "  ]\n}")], "part int, value string")
    every = fixed.select("part", F.lit(0).cast("long").alias("ord"), F.lit("").alias("id"), "value").union(lines(nodes, _PLAIN_NODE, 1)).union(lines(edges, _PLAIN_EDGE, 3))
    every.repartition(1).sortWithinPartitions("part", "ord", "id").select("value").write.mode("overwrite").text(path)


def write_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """K1: one JSON object a line, ``kind`` telling nodes from edges."""
    rows = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), "*")).alias("value"))
    rows.union(edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), "*")))).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The graph that :func:`write_json` wrote."""
    text = spark.read.text(path).withColumn("kind", F.get_json_object("value", "$.kind"))

    def part(kind: str, schema: str) -> DataFrame:
        return text.where(F.col("kind") == kind).select(F.from_json("value", schema).alias("r")).select("r.*")

    return part("node", NODES), part("edge", EDGES)


_META_IN = "metadata map<string,string>"


_HEAD, _MIDDLE, _TAIL = ["{", '  "nodes": ['], ["  ],", '  "edges": ['], ["  ]", "}"]


def _lines_of_document(spark: SparkSession, path: str) -> DataFrame | None:
    """``column, ord, value`` of a document in the form of :func:`write_document`, an element a line; None for other forms, which one task reads.

    Many tasks read a part of the file each.  A line's place is that of its part
    in the file, and its own in the part.
    """
    block = F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("nth"), "value")
    first = lines.groupBy("file", "block").agg(F.min("nth").alias("first"))  # a row for each part of the file
    placed = lines.join(F.broadcast(first), ["file", "block"]).select("file", (F.col("block") + F.col("nth") - F.col("first")).alias("ord"), "value")
    element = F.startswith("value", F.lit("    {")) | F.startswith("value", F.lit("  , {"))
    marks = placed.where(~element).select("file", "ord", "value").limit(8).collect()
    marks.sort(key=lambda r: r.ord)
    if [r.value for r in marks] != _HEAD + _MIDDLE + _TAIL or len({r.file for r in marks}) != 1:
        return None
    column = F.when(F.col("ord") < marks[2].ord, "nodes").otherwise("edges")
    return placed.where(element).select(column.alias("column"), "ord", F.expr("substring(value, 5)").alias("value"))


def read_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A graph document ``{"nodes": [...], "edges": [...]}``; repeated ids raise ``ValueError``."""
    node = f"id string, name string, type string, file_path string, line_number int, language string, docstring string, {_META_IN}, confidence double, last_modified string"
    edge = f"id string, source_id string, target_id string, relationship string, confidence double, is_resolved boolean, {_META_IN}"
    kinds = {"nodes": node, "edges": edge}
    written = _lines_of_document(spark, path)
    if written is None:
        doc = spark.read.schema(f"nodes array<struct<{_fields(node)}>>, edges array<struct<{_fields(edge)}>>").option("multiLine", True).json(path)
    out = []
    for column, schema in (("nodes", NODES), ("edges", EDGES)):
        if written is None:
            rows = doc.select(F.posexplode(column).alias("ord", "r")).select("ord", "r.*")
        else:
            rows = written.where(F.col("column") == column).select("ord", F.from_json("value", f"struct<{_fields(kinds[column])}>").alias("r")).select("ord", "r.*")
        if not duplicates(rows).isEmpty():
            raise ValueError(f"{column} with the same id in {path}")
        out.append(rows.select(*(_column(rows, *f.rsplit(" ", 1)) for f in schema.split(", "))))
    return out[0], out[1]


def _fields(schema: str) -> str:
    return ",".join(f"{n}:{t}" for n, t in (f.strip().split(" ", 1) for f in schema.split(", ")))


def _column(rows: DataFrame, name: str, kind: str):
    if name in rows.columns:
        return F.col(name).cast(kind).alias(name)
    value = F.col("metadata")[name]
    return (F.from_json(value, kind) if kind.startswith("array") else value.try_cast(kind)).alias(name)


def write_index(vectors: DataFrame, idf: DataFrame, path: str) -> None:
    """K3."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    idf.write.mode("overwrite").parquet(f"{path}/idf")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S7."""
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/idf")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """A text file is one incident."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("incident_id"), F.col("value").alias("raw_text"))
    return files


STATE = "graph string, repo string, last_hash string, clone_url string, updated string"


def write_state(state: DataFrame, path: str) -> None:
    """Append ingestion state; the newest row of a repository holds."""
    state.write.mode("append").parquet(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """S11."""
    rows = spark.read.schema(STATE).parquet(path)
    return rows.groupBy("graph", "repo").agg(F.max_by("last_hash", "updated").alias("last_hash"), F.max_by("clone_url", "updated").alias("clone_url"), F.max("updated").alias("updated"))
