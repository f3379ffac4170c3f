"""Command line: ``python -m culprit.cli build|update|git|diagnose|index|verify|view|tokens ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession, functions as F

from culprit.functions.scoring import token_cost, token_estimate
from culprit.operators import commits, graph, resolve, semantic
from culprit.plans import diagnose as D, ingest
from culprit.session import checkpoint
from culprit.sources import graph_store, repository


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="culprit")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("build", help="repositories to a stored graph")
    c.add_argument("repos", nargs="+")
    c.add_argument("--output", required=True)
    c = sub.add_parser("update", help="replace the changed and deleted files of a repository in a stored graph")
    c.add_argument("graph")
    c.add_argument("--before", required=True, help="the repository as it was when the graph was built")
    c.add_argument("--after", required=True, help="the repository as it is")
    c.add_argument("--mode", choices=("repair", "compat"), default="repair")
    c = sub.add_parser("git", help="commit metadata of a table of API responses onto a stored graph")
    c.add_argument("graph")
    c.add_argument("--responses", required=True, help="JSON lines with file_path, status, body")
    c.add_argument("--root", default="")
    c.add_argument("--nodes", help="a text file of node ids, if not all nodes are meant")
    c = sub.add_parser("diagnose", help="one incident against a stored graph")
    c.add_argument("--graph", required=True)
    c.add_argument("--trace", required=True, help="a .txt file or the text itself")
    c.add_argument("--as-of", required=True, help="ISO-8601 time that takes the place of now")
    c.add_argument("--tfidf")
    c.add_argument("--hops", type=int, default=4)
    c.add_argument("--top", type=int, default=5)
    c = sub.add_parser("index", help="TF-IDF index of a stored graph")
    c.add_argument("graph")
    c.add_argument("output")
    c = sub.add_parser("verify", help="integrity of a stored graph, and agreement with its JSON document")
    c.add_argument("graph")
    c.add_argument("--document", help="the folder of the JSON document")
    c = sub.add_parser("document", help="a stored graph as one JSON document")
    c.add_argument("graph")
    c.add_argument("output")
    c = sub.add_parser("view", help="nodes and edges for display, as JSON lines")
    c.add_argument("--input", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--rel-types", default="ALL")
    c.add_argument("--max-nodes", type=int, default=500)
    c.add_argument("--center-node")
    c = sub.add_parser("tokens", help="rough tokens and cost of a repository's text")
    c.add_argument("repo")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("culprit").getOrCreate()
    if a.command == "build":
        scans = {r: repository.scan(spark, r) for r in a.repos}
        g = ingest.build_many(scans) if len(scans) > 1 else ingest.build(next(iter(scans.values())))
        graph_store.write_graph(g.nodes, g.edges, a.output)
        print(resolve.tally(spark.read.parquet(f"{a.output}/edges")).first().asDict())
        return 0
    if a.command == "tokens":
        t = repository.texts(spark, a.repo).agg(F.sum(token_estimate(F.col("text"))).alias("tokens"))
        print(t.withColumn("dollars", token_cost(F.col("tokens"))).first().asDict())
        return 0
    try:
        nodes, edges = graph_store.read_graph(spark, getattr(a, "graph", None) or a.input)
        nodes.limit(1).count()
    except Exception as e:  # noqa: BLE001  an unreadable graph is a usage error
        print(f"can't read the graph: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    if a.command == "diagnose":
        text = open(a.trace, encoding="utf-8").read() if a.trace.endswith(".txt") else a.trace
        if not text.strip():
            print("the trace is blank", file=sys.stderr)
            return 1
        incidents = spark.createDataFrame([("1", text)], "incident_id string, raw_text string")
        index = graph_store.read_index(spark, a.tfidf) if a.tfidf else None
        found = D.diagnose(incidents, nodes, edges, a.as_of, index=index, max_hops=a.hops, top_n=a.top)
        print(D.format_report(found.reports.first()))
    elif a.command == "update":
        before, after = repository.scan(spark, a.before), repository.scan(spark, a.after)
        changed = checkpoint(repository.changes(before, after))
        fresh = after.join(changed.where("status = 'AM'").select(F.col("path").alias("file_path")), "file_path", "left_semi").select("file_path", "content", "file_ord")
        g = ingest.update(ingest.Graph(nodes, edges, None), fresh, changed.select("path"), a.mode)
        graph_store.write_graph(g.nodes, g.edges, a.graph)
        print({r.status: r.n for r in changed.groupBy("status").agg(F.count("*").alias("n")).collect()})
    elif a.command == "git":
        rows = commits.from_responses(spark.read.schema("file_path string, status int, body string").json(a.responses))
        only = spark.read.text(a.nodes).toDF("id") if a.nodes else None
        enriched = commits.enrich(nodes, rows, a.root, only)
        graph_store.write_graph(checkpoint(enriched), edges, a.graph)
        print(commits.enrichment_report(graph_store.read_graph(spark, a.graph)[0]).first().asDict())
    elif a.command == "document":
        graph_store.write_document(nodes, edges, a.output)
    elif a.command == "index":
        docs = semantic.node_documents(nodes, edges)
        graph_store.write_index(*semantic.index(docs), a.output)
    elif a.command == "verify":
        row = (graph.verify_stored((nodes, edges), graph_store.read_document(spark, a.document)) if a.document else graph.integrity(nodes, edges)).first()
        print(row.asDict())
        return 0 if row.all_passed else 1
    elif a.command == "view":
        shown = graph.filter_relationships(edges, a.rel_types)
        if a.center_node:
            kept = graph.ego_network(nodes, shown, a.center_node)
            if kept.isEmpty():
                print(f"no node is called {a.center_node}", file=sys.stderr)
                return 1
            chosen = nodes.join(kept.select("id"), "id", "left_semi")
        else:
            chosen = graph.sample_nodes(nodes, a.max_nodes)
        graph.display(chosen).write.mode("overwrite").json(f"{a.output}/nodes")
        graph.with_known_ends(shown, chosen).select("source_id", "target_id", "relationship").write.mode("overwrite").json(f"{a.output}/edges")
    return 0


if __name__ == "__main__":
    sys.exit(main())
