"""Property graph as two DataFrames: ``nodes`` and ``edges``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from culprit.session import checkpoint, sieved

NODES = (
    "id string, name string, type string, file_path string, line_number int, language string, docstring string, confidence double, "
    "last_modified string, params array<string>, is_async boolean, bases array<string>, decorators array<string>, value string, "
    "last_commit_message string, last_commit_date string, last_commit_author string, last_commit_sha string, ord bigint"
)
EDGES = (
    "id string, source_id string, target_id string, relationship string, confidence double, is_resolved boolean, call_type string, "
    "arg_count int, alias string, original_name string, module string, level int, exception_name string, handler_var string, "
    "raise_type string, decorator_name string, is_builtin boolean, builtin_kind string, unresolved_reason string, raw_target string, ord bigint"
)


def node_id(file: Column, cls: Column, fn: Column) -> Column:
    """``file::class::function``; empty parts stay."""
    return F.concat(file, F.lit("::"), cls, F.lit("::"), fn)


def file_of(node: Column) -> Column:
    """The text before the first ``::``."""
    return F.substring_index(node, "::", 1)


def slashed(path: Column) -> Column:
    return F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def short_id(node: Column) -> Column:
    """File name and the last named part of an id."""
    parts = F.split(node, "::")
    before = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")
    tail = F.when(F.element_at(parts, -1) != "", F.element_at(parts, -1)).otherwise(before)
    name = basename(F.get(parts, F.lit(0)))
    return F.when(tail != "", F.concat(name, F.lit("::"), tail)).otherwise(name)


def windows_of(parts: Column, sep: str) -> Column:
    """Distinct runs of consecutive parts after the first, joined: what can stand between separators."""
    last = F.size(parts) - 1
    runs = lambda i: F.transform(F.sequence(i, last), lambda j: F.array_join(F.slice(parts, i + 1, j - i + 1), sep))
    return F.when(last >= 1, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), last), runs)))).otherwise(F.array().cast("array<string>"))


def first_by_id(rows: DataFrame, *order: str, key: str = "id") -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def duplicates(rows: DataFrame, key: str = "id") -> DataFrame:
    """Keys that occur more than once; a valid table has none."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def merge(parts: list[DataFrame], key: str = "id") -> DataFrame:
    """Union in list order where the first row of an id wins."""
    tagged = [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return first_by_id(out, "_part", "ord", key=key).drop("_part")


def get_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of ``ids(id)``, with ``has_node``; an unknown id gives a row of nulls."""
    known = nodes.withColumn("has_node", F.lit(True))
    return ids.join(known, "id", "left").withColumn("has_node", F.coalesce("has_node", F.lit(False)))


def incident_edges(edges: DataFrame, ids: DataFrame, outgoing: bool = True) -> DataFrame:
    """Edges from (or to) the ids of a one-column table."""
    end = "source_id" if outgoing else "target_id"
    return edges.join(ids.toDF(end).distinct(), end, "left_semi").select(edges.columns)


def neighbors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, neighbor_id`` over both directions, distinct, existing nodes only; ``side`` 0 where an outgoing edge gives it."""
    both = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("neighbor_id"), F.lit(0).alias("side")).union(
        edges.select("target_id", "source_id", F.lit(1))
    )
    met = both.groupBy("id", "neighbor_id").agg(F.min("side").alias("side"))
    return met.join(nodes.select(F.col("id").alias("neighbor_id")), "neighbor_id", "left_semi").select("id", "neighbor_id", "side")


def has_edge(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs(src, dst)`` with a flag."""
    known = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct().withColumn("has_edge", F.lit(True))
    return pairs.join(known, ["src", "dst"], "left").withColumn("has_edge", F.coalesce("has_edge", F.lit(False)))


def out_degree(edges: DataFrame, relationship: str | None = "CALLS") -> DataFrame:
    """Outgoing edges by node."""
    rows = edges if relationship is None else edges.where(F.col("relationship") == relationship)
    return rows.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("calls_out"))


def counts_by(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Counts, the most frequent first, then by name."""
    return rows.groupBy(column).agg(F.count("*").alias(name)).orderBy(F.desc(name), column)


def filter_relationships(edges: DataFrame, wanted: str) -> DataFrame:
    """A comma-separated list of relationships, or ``ALL``."""
    names = [w.strip() for w in wanted.split(",") if w.strip()]
    return edges if wanted.strip().upper() == "ALL" else edges.where(F.col("relationship").isin(names))


def with_known_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes."""
    ids = nodes.select("id")
    kept = edges.join(ids.toDF("source_id"), "source_id", "left_semi").join(ids.toDF("target_id"), "target_id", "left_semi")
    return kept.select(edges.columns)


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with a missing end; a missing source counts only if it is an id (has ``::``)."""
    ids = nodes.select("id")
    no_source = edges.where(F.contains("source_id", F.lit("::"))).join(ids.toDF("source_id"), "source_id", "left_anti").select("id", F.lit("source").alias("end"), F.col("source_id").alias("missing"))
    no_target = edges.join(ids.toDF("target_id"), "target_id", "left_anti").select("id", F.lit("target"), "target_id")
    return no_source.union(no_target)


def remove_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of some files (``path``) and every edge at them."""
    gone = files.select(slashed(F.col("path")).alias("_path")).distinct()
    marked = nodes.withColumn("_path", slashed(F.col("file_path")))
    dead = marked.join(gone, "_path", "left_semi").select("id")
    kept_edges = edges.join(dead.toDF("source_id"), "source_id", "left_anti").join(dead.toDF("target_id"), "target_id", "left_anti")
    return marked.join(gone, "_path", "left_anti").select(nodes.columns), kept_edges.select(edges.columns)


def ego_network(nodes: DataFrame, edges: DataFrame, name: str, radius: int = 2) -> DataFrame:
    """``id, distance`` of nodes within an undirected distance of any node with that name; edges that no step starts from are not sent."""
    both = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("to")).union(edges.select("target_id", "source_id"))
    seen = front = checkpoint(nodes.where(F.col("name") == name).select("id", F.lit(0).alias("distance")))
    for d in range(1, radius + 1):
        near = sieved(both, front, "id").where("_met").drop("_met")
        step = near.join(front.select("id"), "id").select(F.col("to").alias("id")).distinct().withColumn("distance", F.lit(d))
        seen = checkpoint(seen.union(step).groupBy("id").agg(F.min("distance").alias("distance")))
        front = seen.where(F.col("distance") == d)
    return seen.join(nodes.select("id"), "id", "left_semi")


def subgraph(ids: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 40) -> tuple[DataFrame, DataFrame]:
    """The first ids by ``pos`` with their nodes, and edges between them, one per pair."""
    ranked = ids.groupBy("id").agg(F.min("pos").alias("pos")).orderBy("pos", "id").limit(limit)
    chosen = ranked.join(nodes, "id")
    inner = with_known_ends(edges, chosen.select("id")).withColumn("_pair", F.struct("source_id", "target_id"))
    return chosen, first_by_id(inner, "ord", "id", key="_pair").drop("_pair")


def sample_nodes(nodes: DataFrame, limit: int = 500, seed: int = 0) -> DataFrame:
    """A sample that repeats for a seed, by a hash of id and seed."""
    return nodes.orderBy(F.md5(F.concat("id", F.lit(f"|{seed}"))), "id").limit(limit)


_COLORS = {"function": "#4C9BE8", "class": "#E8874C", "module": "#6BBF59", "variable": "#B58CD9"}


def display(nodes: DataFrame) -> DataFrame:
    """``id, label, title, color`` for a graph view."""
    color = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in _COLORS.items() for x in kv)), F.col("type")), F.lit("#999999"))
    title = F.concat_ws("\n", "name", "type", F.concat_ws(":", "file_path", F.col("line_number").cast("string")))
    return nodes.select("id", F.col("name").alias("label"), title.alias("title"), color.alias("color"))


_EDGE_COLORS = {"CALLS": "#4C9BE8", "IMPORTS": "#6BBF59", "EXTENDS": "#E8874C", "CONTAINS": "#999999", "RAISES": "#D9534F", "CATCHES": "#F0AD4E", "DECORATES": "#B58CD9"}


def display_edges(edges: DataFrame) -> DataFrame:
    """``source_id, target_id, title, color, dashes`` for a graph view; unresolved edges are dashed."""
    color = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in _EDGE_COLORS.items() for x in kv)), F.col("relationship")), F.lit("#999999"))
    title = F.concat_ws("\n", "relationship", F.concat(F.lit("confidence "), F.format_number("confidence", 2)))
    return edges.select("source_id", "target_id", title.alias("title"), color.alias("color"), (~F.col("is_resolved")).alias("dashes"))


def stats_by(graphs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``graph_key, nodes, edges`` of named graphs."""
    rows = [d.select(F.lit(k).alias("graph_key"), F.lit(i).alias("what")) for k, parts in sorted(graphs.items()) for i, d in enumerate(parts)]
    counted = reduce(DataFrame.union, rows).groupBy("graph_key").agg(F.count_if(F.col("what") == 0).alias("nodes"), F.count_if(F.col("what") == 1).alias("edges"))
    return counted.orderBy("graph_key")


def compare(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Keys that only one table has or whose rows differ."""
    columns = sorted(set(a.columns) & set(b.columns))
    mark = lambda d, n: d.select(key, F.xxhash64(F.to_json(F.struct(*columns))).alias(n))
    both = mark(a, "left").join(mark(b, "right"), key, "full_outer")
    state = F.when(F.col("right").isNull(), "missing right").when(F.col("left").isNull(), "missing left").when(F.col("left") != F.col("right"), "different")
    return both.select(key, state.alias("state")).where("state is not null")


NODE_TYPES = ("function", "class", "module", "variable")


def verify_stored(one: tuple[DataFrame, DataFrame], other: tuple[DataFrame, DataFrame]) -> DataFrame:
    """One row for two stored forms of a graph that must agree and be sound.

    Counts and all rows are compared, edges must end at nodes (an unresolved
    edge may not; a source is only missed if it looks like an id), nodes need id,
    path and a known type, and some function's neighbours must be readable.
    """
    (nodes, edges), (nodes2, edges2) = one, other
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    n = nodes.agg(
        F.count("*").alias("nodes"), F.count_if(empty("id")).alias("no_id"), F.count_if(~F.coalesce("type", F.lit("")).isin(*NODE_TYPES)).alias("bad_type"), F.count_if(empty("file_path")).alias("no_path"),
        F.min(F.when(F.col("type") == "function", F.col("id"))).alias("start"),
    )
    e = edges.agg(F.count("*").alias("edges"), F.count_if("is_resolved").alias("resolved"), F.count_if(~F.col("is_resolved")).alias("unresolved"))
    lost = dangling(edges, nodes).join(edges.select("id", "is_resolved"), "id")
    d = lost.agg(F.count_if((F.col("end") == "target") & F.col("is_resolved")).alias("dangling_edges"), F.count_if(F.col("end") == "source").alias("missing_sources"))
    differ = compare(nodes.drop("ord"), nodes2).agg(F.count("*").alias("node_differences")).crossJoin(compare(edges.drop("ord"), edges2).agg(F.count("*").alias("edge_differences")))
    row = n.crossJoin(e).crossJoin(d).crossJoin(differ)  # single rows
    near = neighbors(nodes, edges).select(F.col("id").alias("start"), F.lit(1).alias("_met"))
    row = row.join(near, "start", "left").groupBy(*row.columns).agg(F.count("_met").alias("neighbors"))
    match = (F.col("node_differences") == 0) & (F.col("edge_differences") == 0)
    sound = sum((F.col(c) for c in ("no_id", "bad_type", "no_path", "missing_sources", "dangling_edges")), F.lit(0)) == 0
    return row.withColumn("counts_match", match).withColumn("all_passed", match & sound).drop("start")


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with the counts that a stored graph must satisfy."""
    n = nodes.agg(F.count("*").alias("nodes"), F.countDistinct("id").alias("node_ids"), F.count_if(F.coalesce(F.col("name"), F.lit("")) == "").alias("unnamed"))
    e = edges.agg(
        F.count("*").alias("edges"), F.countDistinct("id").alias("edge_ids"), F.count_if("is_resolved").alias("resolved"),
        F.count_if(~F.col("is_resolved")).alias("unresolved"), F.count_if(~F.col("confidence").between(0, 1)).alias("bad_confidence"),
    )
    d = dangling(edges, nodes).agg(F.count_if(F.col("end") == "source").alias("dangling_sources"), F.count_if(F.col("end") == "target").alias("dangling_targets"))
    row = n.crossJoin(e).crossJoin(d)  # three single rows
    return row.withColumn("all_passed", (F.col("nodes") == F.col("node_ids")) & (F.col("edges") == F.col("edge_ids")) & (F.col("dangling_sources") == 0) & (F.col("bad_confidence") == 0))
