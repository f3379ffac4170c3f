"""Commit metadata on nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from culprit.operators.graph import slashed

META = ["last_commit_message", "last_commit_date", "last_commit_author", "last_commit_sha"]


def relative_path(path: Column, root: Column) -> Column:
    """P5: path below ``root`` with slashes, without a leading slash."""
    p, r = slashed(path), F.rtrim(slashed(root), F.lit("/"))
    cut = F.when((r != "") & F.startswith(p, r), F.substr(p, F.length(r) + 1)).otherwise(p)
    return F.ltrim(cut, F.lit("/"))


def owner_and_repo(url: Column) -> Column:
    """``struct(owner, repo)`` of an https or git@ address."""
    pattern = r"^(?:https?://[^/]+/|git@[^:]+:)([^/]+)/([^/]+?)(?:\.git)?/?$"
    return F.struct(F.regexp_extract(url, pattern, 1).alias("owner"), F.regexp_extract(url, pattern, 2).alias("repo"))


def repo_root(nodes: DataFrame, repo: str) -> DataFrame:
    """One row with the folder that ends in ``/repo`` in the first such path, else the first path's folder."""
    p, mark = slashed(F.col("file_path")), f"/{repo}/"
    at = F.instr(p, mark)
    found = F.min_by(F.when(at > 0, F.substring(p, F.lit(1), at + len(repo))), F.when(at > 0, F.col("ord")))
    first = F.min_by(F.regexp_replace(p, "/?[^/]*$", ""), F.col("ord"))
    return nodes.agg(F.coalesce(found, first, F.lit("")).alias("root"))


def latest(commits: DataFrame) -> DataFrame:
    """The newest commit of each file; ties go to the greater sha."""
    w = Window.partitionBy("file_path").orderBy(F.desc("author_date"), F.desc("sha"))
    return commits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


COMMIT = "struct<sha:string,commit:struct<message:string,author:struct<name:string,date:string>,committer:struct<date:string>>>"


def from_responses(responses: DataFrame) -> DataFrame:
    """``file_path, status, body`` of a commits API to commit rows.

    A body is a JSON array, newest first.  Only status 200 gives commits; the
    committer's date counts before the author's, and seven digits of the sha are kept.
    """
    each = responses.where("status = 200").select("file_path", F.posexplode(F.from_json("body", f"array<{COMMIT}>")).alias("pos", "c"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    date = F.coalesce(F.nullif("c.commit.committer.date", F.lit("")), F.nullif("c.commit.author.date", F.lit("")), F.lit(""))
    return each.select("file_path", "pos", F.substring(text("c.sha"), 1, 7).alias("sha"), text("c.commit.message").alias("message"), text("c.commit.author.name").alias("author_name"), date.alias("author_date"))


def enrich(nodes: DataFrame, commits: DataFrame, root: str = "", only: DataFrame | None = None) -> DataFrame:
    """Nodes with their file's latest commit; files without commits, and nodes outside ``only(id)``, keep what they have."""
    if only is not None:
        chosen = enrich(nodes.join(only.select("id"), "id", "left_semi").select(nodes.columns), commits, root)
        return chosen.union(nodes.join(only.select("id"), "id", "left_anti").select(nodes.columns))
    last = latest(commits).select(F.col("file_path").alias("_file"), F.col("message").alias("_m"), F.col("author_date").alias("_d"), F.col("author_name").alias("_a"), F.col("sha").alias("_s"))
    joined = nodes.withColumn("_file", relative_path(F.col("file_path"), F.lit(root))).join(last, "_file", "left")
    new = dict(zip(META, ("_m", "_d", "_a", "_s"), strict=True))
    return joined.select(*(F.when(F.col("_s").isNotNull(), F.col(new[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in nodes.columns))


def enrichment_report(nodes: DataFrame) -> DataFrame:
    """Counters of J6."""
    return nodes.agg(F.count("*").alias("total_nodes"), F.count("last_commit_sha").alias("enriched"), F.countDistinct("file_path").alias("files"))


def seed(nodes: DataFrame, seeds: DataFrame, default_date: str = "2025-02-01T00:00:00Z", default_message: str = "initial import") -> DataFrame:
    """Named nodes get a seeded commit, all others a default one."""
    s = seeds.select(F.col("name"), F.col("last_commit_date").alias("_d"), F.col("last_commit_message").alias("_m"))
    joined = nodes.join(s, "name", "left")
    made = {"last_commit_date": F.coalesce("_d", F.lit(default_date)), "last_commit_message": F.coalesce("_m", F.lit(default_message))}
    return joined.select(*(made[c].alias(c) if c in made else F.col(c) for c in nodes.columns))
