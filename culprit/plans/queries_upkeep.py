"""Registered queries of extraction, upkeep, storage, prose incidents and reports, with DuckDB SQL for each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from culprit.functions import incident as I
from culprit.operators import commits, extract, graph as G, semantic as T, traverse as V
from culprit.plans import diagnose as D, ingest
from culprit.plans.queries import _TOKENS, _VERIFIED, _docs, _verified, query
from culprit.plans.starview import AS_OF, Star
from culprit.session import shared_folder
from culprit.sources import graph_store, repository

# --- extraction ---------------------------------------------------------------------

#: A source file a brand, with a class, a method and a function a part; a function calls the next part's class, wherever that is.
_BLOCKS = """select p_partkey as k, p_brand, p_type, p_size, 6 + 13 * (row_number() over (partition by p_brand order by p_partkey) - 1) as line from {part}"""
_HEADER = "import os\nfrom json import loads as read\n\nLIMIT = 5\n\n"


def _files(s: Star, blocks: str) -> DataFrame:
    rows = s.sql(blocks)
    k = F.col("k").cast("string")
    body = F.concat(
        F.lit("@cached\nclass P"), k, F.lit("(Base"), (F.col("p_size") % 3).cast("string"), F.lit("):\n    '''"), F.col("p_type"), F.lit("'''\n    def run(self, n):\n        '''runs'''\n        try:\n            return check(n)\n"),
        F.lit("        except KeyError:\n            raise ValueError('x')\n\ndef f"), k, F.lit("(a):\n    return P"), (F.col("k") + 1).cast("string"), F.lit("(a)\n\n"),
    )
    # a file's blocks are the file, so collecting them is bounded by it
    files = rows.groupBy("p_brand").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", body.alias("t")))), lambda x: x["t"]), "").alias("text"))
    order = F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")
    return files.select(F.concat("p_brand", F.lit(".py")).alias("file_path"), F.encode(F.concat(F.lit(_HEADER), F.col("text")), "utf-8").alias("content"), order.alias("file_ord"))


def _blocks(changed: bool = False) -> str:
    text = _BLOCKS if not changed else _BLOCKS + " where not (p_partkey % 2 = 0 and p_brand in (select max(p_brand) from {part} group by p_type))"
    return text


_SOURCE = "blocks as (" + _BLOCKS.format(part="part") + "), files as (select distinct p_brand, p_brand || '.py' as file from blocks)"
_NODES_SQL = """made as (
    select file || '::::' as id, p_brand as name, 'module' as type, 1 as line_number, null as docstring from files
    union all select file || '::::LIMIT', 'LIMIT', 'variable', 4, null from files
    union all select p_brand || '.py::P' || k || '::', 'P' || k, 'class', line + 1, p_type from blocks
    union all select p_brand || '.py::P' || k || '::run', 'run', 'function', line + 3, 'runs' from blocks
    union all select p_brand || '.py::::f' || k, 'f' || k, 'function', line + 10, null from blocks)"""
_RAW = """raw as (
    select file || '::::' as source_id, 'IMPORTS' as relationship, 'os' as target_id, 1.0 as confidence, false as is_resolved from files
    union all select file || '::::', 'IMPORTS', 'json::loads', 1.0, false from files
    union all select 'cached', 'DECORATES', p_brand || '.py::P' || k || '::', 1.0, false from blocks
    union all select p_brand || '.py::P' || k || '::', 'EXTENDS', 'Base' || (p_size % 3), 1.0, false from blocks
    union all select p_brand || '.py::P' || k || '::', 'CONTAINS', p_brand || '.py::P' || k || '::run', 1.0, true from blocks
    union all select p_brand || '.py::P' || k || '::run', 'CALLS', 'check', 1.0, false from blocks
    union all select p_brand || '.py::P' || k || '::run', 'CATCHES', 'KeyError', 0.8, false from blocks
    union all select p_brand || '.py::P' || k || '::run', 'RAISES', 'ValueError', 0.9, false from blocks
    union all select p_brand || '.py::P' || k || '::run', 'CALLS', 'ValueError', 1.0, false from blocks
    union all select p_brand || '.py::::f' || k, 'CALLS', 'P' || (k + 1), 1.0, false from blocks)"""
_LINKED = """linked as (select raw.source_id, raw.relationship, coalesce(m.id, raw.target_id) as target_id, raw.is_resolved or m.id is not null as is_resolved,
    case when raw.target_id = 'ValueError' and raw.relationship = 'CALLS' then 'exception_call' when raw.relationship in ('RAISES', 'CATCHES') then 'exception' end as builtin_kind,
    case when raw.target_id = 'ValueError' or raw.relationship in ('RAISES', 'CATCHES') then 0.5 when raw.relationship in ('IMPORTS', 'CONTAINS') or m.id is not null then raw.confidence else raw.confidence - 0.3 end as confidence
    from raw left join made m on raw.relationship = 'CALLS' and m.type = 'class' and m.name = raw.target_id)"""


def _parsed(s: Star) -> tuple[DataFrame, DataFrame, DataFrame]:
    return extract.to_graph(D.checkpoint(extract.parse_files(_files(s, _blocks()))))


@query(f"with {_SOURCE}, {_NODES_SQL} select id, name, type, line_number, coalesce(docstring, '') as docstring from made")
def extract_nodes(s: Star) -> DataFrame:
    """X3a to X3c, X3h, X3j: nodes of source files."""
    return _parsed(s)[0].select("id", "name", "type", "line_number", F.coalesce("docstring", F.lit("")).alias("docstring"))


@query(f"with {_SOURCE}, {_RAW} select source_id || '--' || relationship || '--' || target_id as id, source_id, relationship, target_id, confidence, is_resolved from raw")
def extract_edges(s: Star) -> DataFrame:
    """X3b to X3g, X3i: edges of source files, before resolution."""
    e = _parsed(s)[1]
    return e.select("id", "source_id", "relationship", "target_id", F.round("confidence", 6).alias("confidence"), "is_resolved")


@query(f"with {_SOURCE}, {_NODES_SQL}, {_RAW}, {_LINKED} select source_id, relationship, target_id, is_resolved, builtin_kind, round(confidence, 6) as confidence from linked")
def extract_sources(s: Star) -> DataFrame:
    """Source files to a resolved graph."""
    e = ingest.build(_files(s, _blocks())).edges
    return e.select("source_id", "relationship", "target_id", "is_resolved", "builtin_kind", F.round("confidence", 6).alias("confidence"))


_FEWER = "blocks as (" + _blocks(True).format(part="part") + "), files as (select distinct p_brand, p_brand || '.py' as file from part)"


@query(f"with {_FEWER}, {_NODES_SQL}, {_RAW}, {_LINKED} select source_id, relationship, target_id, is_resolved, builtin_kind, round(confidence, 6) as confidence from linked")
def kg_update(s: Star) -> DataFrame:
    """Some files lose half of their classes; the repaired graph equals one built anew."""
    old = ingest.build(_files(s, _blocks()))
    before, after = D.checkpoint(_files(s, _blocks())), D.checkpoint(_files(s, _blocks(True)))
    changed = D.checkpoint(repository.changes(before, after))
    fresh = after.join(changed.where("status = 'AM'").select(F.col("path").alias("file_path")), "file_path", "left_semi").select(after.columns)
    e = ingest.update(old, fresh, changed.select("path")).edges
    return e.select("source_id", "relationship", "target_id", "is_resolved", "builtin_kind", F.round("confidence", 6).alias("confidence"))


@query(
    """select p_brand || '.py' as file_path, cast(2 * count(*) + 1 as bigint) as functions, count(*) as classes, cast(2 as bigint) as errors, 'café' as docstring from part group by p_brand"""
)
def extract_recovery(s: Star) -> DataFrame:
    """A file with one broken statement gives the others; bytes that are no UTF-8 are read as Latin-1; unknown suffixes give nothing."""
    broken = "\n\ndef bad(:\n    pass\n\ndef ok():\n    '''café'''\n    return 1\n"
    files = _files(s, _blocks()).withColumn("content", F.encode(F.concat(F.decode("content", "utf-8"), F.lit(broken)), "ISO-8859-1"))
    files = files.union(files.withColumn("file_path", F.replace("file_path", F.lit(".py"), F.lit(".txt"))))
    nodes, _, errors = extract.to_graph(D.checkpoint(extract.parse_files(files)))
    n = nodes.groupBy("file_path").agg(F.count_if(F.col("type") == "function").alias("functions"), F.count_if(F.col("type") == "class").alias("classes"), F.max(F.when(F.col("name") == "ok", F.col("docstring"))).alias("docstring"))
    return n.join(errors.groupBy("file_path").agg(F.count("*").alias("errors")), "file_path", "left")


# --- files, commits, storage -----------------------------------------------------------

@query(
    """with a as (select file_path as path, min(name) as c from nodes where ord % 3 <> 0 group by 1), b as (select file_path as path, min(name) as c from nodes where ord % 5 <> 1 and file_path not like '%3.py' group by 1)
    select coalesce(a.path, b.path) as path, case when b.path is null then 'D' else 'AM' end as status from a full outer join b using (path) where a.c is distinct from b.c""",
    "nodes",
)
def repo_changes(s: Star) -> DataFrame:
    """Changed and deleted files of two scans."""
    scan = lambda d: d.groupBy("file_path").agg(F.encode(F.min("name"), "utf-8").alias("content"))
    return repository.changes(scan(s.nodes.where("ord % 3 <> 0")), scan(s.nodes.where("ord % 5 <> 1 and file_path not like '%3.py'")))


@query("select split_part(file_path, '/', 1) as folder, count(*) as n from nodes group by 1 order by n desc, folder limit 1", "nodes")
def repo_densest_folder(s: Star) -> DataFrame:
    """The folder with most files; every node stands for a file here."""
    files = s.nodes.withColumn("file_path", F.concat_ws("/", F.substring_index("file_path", "/", 1), F.col("name")))
    tests = s.nodes.withColumn("file_path", F.concat(F.lit("tests/"), F.col("name")))
    return repository.densest_folder(files.select("file_path").union(tests.select("file_path")))


_RESPONSES = """select 'sales/c' || cast(o_custkey as string) || '.py' as file_path, o_custkey % 10 as kind, 'sha' || cast(o_orderkey as string) as sha, o_orderpriority as message, 'clerk' || cast(o_orderkey % 7 as string) as author_name,
  substring(cast(o_orderdate as string), 1, 10) as author_date, o_orderkey from {orders}"""


@query(
    f"""with r as ({_RESPONSES.format(orders="orders")}) select file_path, row_number() over (partition by file_path order by author_date desc, o_orderkey) - 1 as pos, substring(sha, 1, 7) as sha, message, author_name, author_date from r where kind < 8"""
)
def commits_from_api(s: Star) -> DataFrame:
    """Bodies of a commits API; one file in five is not found or refused."""
    c = F.struct(F.col("sha"), F.struct("message", F.struct(F.col("author_name").alias("name"), F.lit("1999-01-01").alias("date")).alias("author"), F.struct(F.col("author_date").alias("date")).alias("committer")).alias("commit"))
    listed = s.sql(_RESPONSES).groupBy("file_path", "kind").agg(F.sort_array(F.collect_list(F.struct(-F.unix_date(F.to_date("author_date")), "o_orderkey", c.alias("c")))).alias("l"))
    status = F.when(F.col("kind") == 8, 404).when(F.col("kind") == 9, 403).otherwise(200)
    return commits.from_responses(listed.select("file_path", status.alias("status"), F.to_json(F.transform("l", lambda x: x["c"])).alias("body"))).withColumn("pos", F.col("pos").cast("long"))


@query(
    """select id, case when ord % 3 = 0 then coalesce(o.message, last_commit_message) else last_commit_message end as last_commit_message from nodes left join (
    select n_name, max_by(o_orderpriority, (o_orderdate, 'sha' || cast(o_orderkey as varchar))) as message from orders join customer on o_custkey = c_custkey join nation on n_nationkey = c_nationkey group by 1) o on nodes.file_path = 'sales/' || n_name || '.py'""",
    "nodes",
)
def commits_subset(s: Star) -> DataFrame:
    """The latest commit of a file onto some of its nodes."""
    rows = s.sql("select 'sales/' || n_name || '.py' as file_path, 'sha' || cast(o_orderkey as string) as sha, o_orderpriority as message, 'a' as author_name, cast(o_orderdate as string) as author_date from {orders} join {customer} on o_custkey = c_custkey join {nation} on n_nationkey = c_nationkey")
    none = {c: F.lit(None).cast("string").alias(c) for c in commits.META if c not in s.nodes.columns}
    nodes = s.nodes.select("*", *none.values())
    return commits.enrich(nodes, rows, "", nodes.where("ord % 3 = 0").select("id")).select("id", "last_commit_message")


@query(
    """select n.id, coalesce(case when r_name is not null then 'seeded ' || r_name end, 'initial import') as last_commit_message, case when r_name is not null then '2001-0' || cast(r_regionkey + 1 as varchar) || '-01T00:00:00Z' else '2025-02-01T00:00:00Z' end as last_commit_date
    from nodes n left join region on n.name = lower(r_name)""",
    "nodes",
)
def commits_seeded(s: Star) -> DataFrame:
    """R11."""
    seeds = s.sql("select lower(r_name) as name, '2001-0' || cast(r_regionkey + 1 as string) || '-01T00:00:00Z' as last_commit_date, 'seeded ' || r_name as last_commit_message from {region}")
    return commits.seed(s.nodes, seeds).select("id", "last_commit_message", "last_commit_date")


@query("select '/srv/app' as root from (select count(*) from nodes)", "nodes")
def repo_root_of(s: Star) -> DataFrame:
    """P6."""
    return commits.repo_root(s.nodes.withColumn("file_path", F.concat(F.lit("\\srv\\app\\"), F.col("file_path"))), "app")


@query(
    """select (select count(*) from nodes) as nodes, count(*) as edges, count(*) filter (is_resolved) as resolved, count(*) filter (not is_resolved) as unresolved,
    count(*) filter (is_resolved and target_id not in (select id from nodes)) as dangling_edges, count(*) filter (source_id like '%::%' and source_id not in (select id from nodes)) as missing_sources,
    0 as node_differences, 0 as edge_differences, true as counts_match,
    count(*) filter (is_resolved and target_id not in (select id from nodes)) = 0 and count(*) filter (source_id like '%::%' and source_id not in (select id from nodes)) = 0 as all_passed from edges""",
    "nodes", "edges",
)
def kg_stored_forms(s: Star) -> DataFrame:
    """A graph stored as Parquet and as one JSON document, read back and compared."""
    path = f"{shared_folder(s.spark)}/culprit/forms-{uuid.uuid4().hex}"
    graph_store.write_graph(s.nodes, s.edges, f"{path}/store")
    graph_store.write_document(s.nodes, s.edges, f"{path}/document")
    row = G.verify_stored(graph_store.read_graph(s.spark, f"{path}/store"), graph_store.read_document(s.spark, f"{path}/document"))
    return row.select("nodes", "edges", "resolved", "unresolved", "dangling_edges", "missing_sources", "node_differences", "edge_differences", "counts_match", "all_passed")


@query(
    """select 'all' as graph_key, (select count(*) from nodes) as nodes, (select count(*) from edges) as edges
    union all select 'calls', (select count(*) from nodes where type = 'function'), (select count(*) from edges where relationship = 'CALLS')""",
    "nodes", "edges",
)
def kg_stats_by_graph(s: Star) -> DataFrame:
    """A14."""
    return G.stats_by({"all": (s.nodes, s.edges), "calls": (s.nodes.where("type = 'function'"), s.edges.where("relationship = 'CALLS'"))})


@query(
    """select source_id, target_id, relationship || chr(10) || 'confidence ' || printf('%.2f', confidence) as title, case relationship when 'CALLS' then '#4C9BE8' when 'IMPORTS' then '#6BBF59' when 'CONTAINS' then '#999999' else '#D9534F' end as color,
    not is_resolved as dashes from edges""",
    "nodes", "edges",
)
def kg_display_edges(s: Star) -> DataFrame:
    """K7, F20."""
    return G.display_edges(s.edges)


@query("select id, 2 as n from nodes where type <> 'function'", "nodes")
def kg_duplicate_ids(s: Star) -> DataFrame:
    """Ids that a table has more than once."""
    return G.duplicates(s.nodes.union(s.nodes.where("type <> 'function'")))


@query("select 'parts/' || p_brand || '.py::p' || cast(p_partkey + 3 as varchar) || '::' || replace(p_name, ' ', '_') as id, n.name, n.id is not null as has_node from part left join nodes n on n.id = 'parts/' || p_brand || '.py::p' || cast(p_partkey + 3 as varchar) || '::' || replace(p_name, ' ', '_')", "nodes")
def kg_get_nodes(s: Star) -> DataFrame:
    """Known and unknown ids."""
    ids = s.sql("select 'parts/' || p_brand || '.py::p' || cast(p_partkey + 3 as string) || '::' || replace(p_name, ' ', '_') as id from {part}")
    return G.get_nodes(s.nodes, ids).select("id", "name", "has_node")


@query(
    """select 'from' as side, relationship, count(*) as n from edges where source_id in (select id from nodes where type = 'class') group by relationship
    union all select 'to', relationship, count(*) from edges where target_id in (select id from nodes where type = 'class') group by relationship""",
    "nodes", "edges",
)
def kg_incident_edges(s: Star) -> DataFrame:
    """G3."""
    ids = s.nodes.where("type = 'class'").select("id")
    count = lambda d, side: d.groupBy(F.lit(side).alias("side"), "relationship").agg(F.count("*").alias("n"))
    return count(G.incident_edges(s.edges, ids), "from").union(count(G.incident_edges(s.edges, ids, outgoing=False), "to"))


@query("select cast(o_custkey % 3 as varchar) as graph, cast(o_custkey as varchar) as repo, max_by(cast(o_orderkey as varchar), cast(o_orderdate as varchar) || cast(o_orderkey as varchar)) as last_hash, max(cast(o_orderdate as varchar) || cast(o_orderkey as varchar)) as updated from orders group by 1, 2")
def state_latest(s: Star) -> DataFrame:
    """Ingestion state, written in two parts and read back."""
    rows = s.sql("select cast(o_custkey % 3 as string) as graph, cast(o_custkey as string) as repo, cast(o_orderkey as string) as last_hash, 'u' as clone_url, cast(o_orderdate as string) || cast(o_orderkey as string) as updated, o_orderkey from {orders}")
    path = f"{shared_folder(s.spark)}/culprit/state-{uuid.uuid4().hex}"
    for part in (0, 1):
        graph_store.write_state(rows.where(F.col("o_orderkey") % 2 == part).drop("o_orderkey"), path)
    return graph_store.read_state(s.spark, path).select("graph", "repo", "last_hash", "updated")


@query(f"with {_TOKENS} select doc, count(*) as terms, round(sum(tf * idf), 6) as total from tf join idf using (term) group by doc")
def tfidf_stored(s: Star) -> DataFrame:
    """The text index, written and read back."""
    path = f"{shared_folder(s.spark)}/culprit/index-{uuid.uuid4().hex}"
    graph_store.write_index(*T.index(_docs(s)), path)
    return graph_store.read_index(s.spark, path)[0].groupBy("doc").agg(F.count("*").alias("terms"), F.round(F.sum("tfidf"), 6).alias("total"))


# --- incidents ------------------------------------------------------------------------

#: Texts with Windows line ends, repeated frames, and messages that go on over lines.
_ODD = """select cast(event_id as string) as incident_id, 'ERROR order.py:' || cast(event_id % 50 as string) || ' place_order failed' || chr(13) || chr(10)
  || 'sales/a.py:7 in place_order' || chr(13) || chr(10) || 'sales/a.py:7 in place_order' || chr(13) || chr(10) || 'cart.errors.CartError: cart ' || cast(user_id as string) || chr(13) || chr(10)
  || '  of ' || event_type || chr(13) || chr(10) || chr(13) || chr(10) || 'done' as raw_text from {events}"""


@query(
    f"""with odd as ({_ODD.format(events="events").replace("as string", "as varchar")}) select o.incident_id, 'CartError' as error_type, 'cart ' || cast(user_id as varchar) || ' of ' || event_type as error_message, 'unknown' as language,
    'order.py:' || cast(event_id % 50 as varchar) || ',sales/a.py:7' as frames from odd o join events e on o.incident_id = cast(e.event_id as varchar)"""
)
def incident_odd_texts(s: Star) -> DataFrame:
    """Other line ends, continued messages, frames that repeat."""
    p = I.parse(s.sql(_ODD))
    shown = F.array_join(F.transform("frames", lambda f: F.concat_ws(":", f["file_path"], f["line_number"].cast("string"))), ",")
    return p.select("incident_id", "error_type", "error_message", "language", shown.alias("frames"))


_PROSE = """select cast(c_custkey as string) as incident_id, 'the ' || lower(c_mktsegment) || ' account wants ' || p_name || ' but it is slow' as raw_text from {customer} join {part} on p_partkey = c_custkey * 7 % 200 + 1"""


def _stop() -> str:
    return ", ".join(f"'{w}'" for w in sorted(T.STOP_WORDS))


@query(
    f"""with prose as ({_PROSE.format(customer="customer", part="part").replace("as string", "as varchar")}),
    toks as (select id as doc, list_filter(regexp_split_to_array(lower(replace(name, '_', ' ') || ' ' || docstring), '[^a-z0-9]+'), lambda t: len(t) >= 2 and t not in ({_stop()})) as t from nodes),
    tf as (select doc, term, count(*) / max(total) as tf from (select doc, len(t) as total, unnest(t) as term from toks) group by doc, term),
    idf as (select term, ln((select count(*) from nodes) / (1.0 + count(*))) as idf from tf group by term),
    asked as (select incident_id as query, list_distinct(list_filter(regexp_extract_all(raw_text, '[a-z_]+'), lambda w: w not in ('the', 'but', 'it', 'is') and len(w) > 1)) as t from prose),
    q as (select query, term, count(*) / max(total) * max(idf) as q from (select query, len(t) as total, unnest(t) as term from asked) join idf using (term) group by query, term),
    v as (select doc, term, tf * idf as v from tf join idf using (term)),
    dots as (select query, doc, sum(q * v) as dot from q join v using (term) where q <> 0 and v <> 0 group by query, doc),
    scored as (select query, doc, dot / (qn * dn) as similarity from dots join (select query, sqrt(sum(q * q)) as qn from q group by 1) using (query) join (select doc, sqrt(sum(v * v)) as dn from v group by 1) using (doc) where dot > 0),
    top as (select * from (select *, row_number() over (partition by query order by round(similarity, 9) desc, doc) as rank from scored) where rank <= 10)
    select query as incident_id, doc as node_id, pos - 1 as pos from (select *, row_number() over (partition by query order by rank) as pos from top join nodes on nodes.id = doc where type in ('function', 'class')) where pos <= 5""",
    "nodes",
)
def prose_entries(s: Star) -> DataFrame:
    """Entries of incidents without frames, by keyword search."""
    docs = s.nodes.select(F.col("id").alias("doc"), F.concat_ws(" ", F.replace("name", F.lit("_"), F.lit(" ")), "docstring").alias("text"))
    found = T.semantic_entries(I.parse(s.sql(_PROSE)), s.nodes, *T.index(docs))
    return found.withColumn("pos", F.col("pos").cast("long"))


# --- reports ---------------------------------------------------------------------------

_TOLD = f"""{_VERIFIED}, told as (select v.incident_id, v.node_id, v.verified_rank, n.name, n.file_path, n.line_number, v.confidence,
    list_filter([case when v.path_exists then 'path_exists' end, case when v.git_confirms then 'git_confirms' end, case when v.keyword_match then 'keyword_match' end], lambda x: x is not null) as passed,
    case when coalesce(n.last_commit_message, '') = '' then '' else substring(n.last_commit_message, 1, 120) || case when coalesce(n.last_commit_date, '') = '' then '' else ' (' || substring(n.last_commit_date, 1, 10) || ')' end end as evidence,
    list_filter([case when v.hop = 0 then 'Entry point from stack trace' end, case when git.g > 0.5 then 'Modified ' || git.days || ' days ago: ' || substring(n.last_commit_message, 1, 80) end,
      case when len(list_filter(kw.k, lambda x: contains(git.hay, x))) > 0 then 'Keyword match: ' || array_to_string(list_filter(kw.k, lambda x: contains(git.hay, x))[1:5], ', ') end,
      case when kw.error_type = 'StatusFError' and git.raises_f then 'Raises StatusFError directly' end, case when v.hop = 0 and git.calls_out > 5 then 'High connectivity: ' || git.calls_out || ' outgoing calls' end], lambda x: x is not null) as reasons
    from verified v join nodes n on n.id = v.node_id join git on git.node_id = v.node_id join kw on kw.incident_id = v.incident_id)"""


@query(
    f"""with {_TOLD} select incident_id, verified_rank, evidence as git_evidence, array_to_string(reasons, ' | ') as reasons, 'Root cause candidate: ' || name || ' in ' || file_path || ':' || line_number || '. Confidence: ' || confidence || '. Checks passed: '
    || array_to_string(passed, ', ') || '. Git evidence: ' || case when evidence = '' then 'none' else evidence end || '. Reasons: ' || array_to_string(reasons, ', ') || '.' as explanation_context from told""",
    "nodes", "edges", "incidents",
)
def verify_explanations(s: Star) -> DataFrame:
    """Reasons, commit evidence and explanation of verified candidates."""
    same, v = _verified(s)
    v = v.select("incident_id", F.col("verified_rank").cast("long").alias("verified_rank"), "git_evidence", F.array_join("reasons", " | ").alias("reasons"), "explanation_context")
    return V.told_to_all(v, same)


_SHOWN = f"""{_VERIFIED}, walk as (select incident_id, 1 as part, row_number() over (partition by incident_id order by hop, rank, node_id) - 1 as pos, node_id from candidates
      union all select incident_id, 0, pos, node_id from entries),
    placed as (select incident_id, node_id, min(part * 1000000 + pos) as spot from walk group by 1, 2),
    shown as (select *, row_number() over (partition by incident_id order by spot) - 1 as k from placed qualify k < 40),
    root as (select incident_id, n.name from verified v join nodes n on n.id = v.node_id where head_rank = 1 and path_exists),
    hops as (select incident_id, n.name, max_by(hop, verified_rank) as hop from verified v join nodes n on n.id = v.node_id group by 1, 2)"""


@query(
    f"""with {_SHOWN} select s.incident_id, k as pos, n.id, case when n.name = root.name then 'root_cause' when spot < 1000000 then 'entry' else 'traversal' end as role, coalesce(hops.hop, case when spot < 1000000 then 0 else 1 end) as hop
    from shown s join nodes n on n.id = s.node_id left join root on root.incident_id = s.incident_id left join hops on hops.incident_id = s.incident_id and hops.name = n.name""",
    "nodes", "edges", "incidents",
)
def report_subgraph_nodes(s: Star) -> DataFrame:
    """Nodes around an incident with roles and hops."""
    d = D.diagnose(s.incidents, s.nodes, s.edges, AS_OF)
    return D.subgraphs(d, s.nodes, s.edges)[0].select("incident_id", F.col("pos").cast("long").alias("pos"), "id", "role", "hop")


@query(
    f"""with {_SHOWN} select a.incident_id, e.source_id as source, e.target_id as target, min_by(e.relationship, e.ord) as rel from shown a join edges e on e.source_id = a.node_id
    join shown b on b.incident_id = a.incident_id and b.node_id = e.target_id group by 1, 2, 3""",
    "nodes", "edges", "incidents",
)
def report_subgraph_edges(s: Star) -> DataFrame:
    """Edges between those nodes."""
    d = D.diagnose(s.incidents, s.nodes, s.edges, AS_OF)
    return D.subgraphs(d, s.nodes, s.edges)[1]




@query(
    """select incident_id, case when k < 2 then '' else 'Crash site not found in graph. Functions searched: none extracted from trace' end as no_entry_reason, case when k < 2 then 1 else 0 end as entries
    from (select incident_id, cast(incident_id as bigint) % 4 as k from log_lines)""",
    "nodes", "log_lines",
)
def diagnose_failures(s: Star) -> DataFrame:
    """Why an incident has no entry; each line names one function or none."""
    r = D.diagnose(s.log_lines, s.nodes, s.edges, AS_OF).reports
    reason = F.when(F.col("entry_nodes_found") == 0, F.col("no_result_reason")).otherwise("")
    return r.select("incident_id", reason.alias("no_entry_reason"), F.least(F.lit(1), F.col("entry_nodes_found")).cast("int").alias("entries"))
