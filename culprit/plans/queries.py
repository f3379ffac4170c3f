"""Registered queries of the engine's operators over the star view, with DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from culprit.functions import incident as I, scoring as S
from culprit.operators import commits, extract, graph as G, resolve as R, semantic as T, traverse as V, verify as C
from culprit.plans import diagnose as D, ingest
from culprit.plans.starview import AS_OF, Star, duck
from culprit.streaming import incidents as ST

#: The queries as functions of a star view, which several may share.
ON_STAR: dict[str, Callable[[Star], DataFrame]] = {}
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


_STARS: dict[tuple[str, str], Star] = {}


def stored(spark: SparkSession, sf_dir: str) -> Star:
    """The view of a folder, whose graph is built once in an application, as a stored graph is that many questions are asked of."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _STARS:
        _STARS.clear()
        _STARS[key] = Star(spark, sf_dir)
    return _STARS[key]


def query(sql: str | None = None, *views: str):
    """Register a function of a :class:`Star` as a query, with its SQL over the named views."""

    def add(f: Callable[[Star], DataFrame]):
        ON_STAR[f.__name__] = f
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(stored(spark, sf_dir))
        if sql is not None:
            head = duck(*views)
            body = sql.strip()
            if body.startswith("with "):
                body = ("" if head == "with recursive " else ", ") + body[5:]
                _ORACLES[f.__name__] = head + body
            else:
                _ORACLES[f.__name__] = body if head == "with recursive " else head + body
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import culprit.plans.queries_upkeep  # noqa: F401  registers its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    import culprit.plans.queries_upkeep  # noqa: F401

    return dict(_ORACLES)


# --- graph store ------------------------------------------------------------


@query("select type, count(*) as n from nodes group by type", "nodes")
def kg_node_counts_by_type(s: Star) -> DataFrame:
    return G.counts_by(s.nodes, "type", "n")


@query("select relationship, count(*) as n from edges group by relationship", "nodes", "edges")
def kg_edge_counts_by_rel(s: Star) -> DataFrame:
    return G.counts_by(s.edges, "relationship", "n")


@query(
    """select id, count(*) as neighbors, sum(case when side = 0 then 1 else 0 end) as outgoing from (
    select id, neighbor_id, min(side) as side from (select source_id as id, target_id as neighbor_id, 0 as side from edges union all select target_id, source_id, 1 from edges)
    where neighbor_id in (select id from nodes) group by id, neighbor_id) group by id""",
    "nodes", "edges",
)
def kg_neighbors(s: Star) -> DataFrame:
    return G.neighbors(s.nodes, s.edges).groupBy("id").agg(F.count("*").alias("neighbors"), F.count_if(F.col("side") == 0).alias("outgoing"))


@query(
    """select p.src, p.dst, exists (select 1 from edges e where e.source_id = p.src and e.target_id = p.dst) as has_edge
    from (select c.id as src, p.id as dst from nodes c join nodes p on p.ord = 4000000001 + c.ord % (select count(*) from part) where c.name like 'Customer#%') p""",
    "nodes", "edges",
)
def kg_has_edge(s: Star) -> DataFrame:
    c = s.nodes.where("name like 'Customer#%'").select(F.col("id").alias("src"), (F.lit(4000000001) + F.col("ord") % s.table("part").count()).alias("ord"))
    return G.has_edge(c.join(s.nodes.select("ord", F.col("id").alias("dst")), "ord").select("src", "dst"), s.edges)


@query("select source_id as id, count(*) as calls_out from edges where relationship = 'CALLS' group by source_id", "nodes", "edges")
def kg_out_degree(s: Star) -> DataFrame:
    return G.out_degree(s.edges)


@query(
    """select relationship, count(*) as n from edges where relationship in ('CONTAINS', 'IMPORTS', 'RAISES')
    and source_id in (select id from nodes) and target_id in (select id from nodes) group by relationship""",
    "nodes", "edges",
)
def kg_rel_filter_endpoints(s: Star) -> DataFrame:
    kept = G.with_known_ends(G.filter_relationships(s.edges, "CONTAINS, IMPORTS,RAISES"), s.nodes)
    return kept.groupBy("relationship").agg(F.count("*").alias("n"))


_DANGLING = """select id, 'source' as "end", source_id as missing from edges where source_id like '%::%' and source_id not in (select id from nodes)
    union all select id, 'target', target_id from edges where target_id not in (select id from nodes)"""


@query(_DANGLING, "nodes", "edges")
def kg_dangling_edges(s: Star) -> DataFrame:
    return G.dangling(s.edges, s.nodes)


@query(
    f"""select *, nodes = node_ids and edges = edge_ids and dangling_sources = 0 and bad_confidence = 0 as all_passed from (
    (select count(*) as nodes, count(distinct id) as node_ids, count(*) filter (coalesce(name, '') = '') as unnamed from nodes)
    cross join (select count(*) as edges, count(distinct id) as edge_ids, count(*) filter (is_resolved) as resolved, count(*) filter (not is_resolved) as unresolved,
      count(*) filter (confidence not between 0 and 1) as bad_confidence from edges)
    cross join (select count(*) filter ("end" = 'source') as dangling_sources, count(*) filter ("end" = 'target') as dangling_targets from ({_DANGLING})))""",
    "nodes", "edges",
)
def kg_integrity_summary(s: Star) -> DataFrame:
    return G.integrity(s.nodes, s.edges)


@query(
    """select type, count(*) as n, sum(line_number) as lines from (
    select *, row_number() over (partition by id order by part, ord) as k from (select *, 0 as part from nodes where type <> 'module'
      union all select id, name, type, file_path, line_number + 1000, docstring, confidence, last_commit_date, last_commit_message, ord, 1 from nodes))
    where k = 1 group by type""",
    "nodes",
)
def kg_merge_first_wins(s: Star) -> DataFrame:
    moved = s.nodes.withColumn("line_number", F.col("line_number") + 1000)
    merged = G.merge([s.nodes.where("type <> 'module'"), moved])
    return merged.groupBy("type").agg(F.count("*").alias("n"), F.sum("line_number").alias("lines"))


@query(
    """with dead as (select id from nodes where file_path in ('sales/NATION_3.py', 'parts/Brand#5.py'))
    select 'nodes' as what, count(*) as n from nodes where id not in (select id from dead)
    union all select relationship, count(*) from edges where source_id not in (select id from dead) and target_id not in (select id from dead) group by relationship""",
    "nodes", "edges",
)
def kg_remove_file(s: Star) -> DataFrame:
    files = s.spark.createDataFrame([("sales\\NATION_3.py",), ("parts/Brand#5.py",)], "path string")
    nodes, edges = G.remove_files(s.nodes, s.edges, files)
    counted = edges.groupBy(F.col("relationship").alias("what")).agg(F.count("*").alias("n"))
    return nodes.agg(F.lit("nodes").alias("what"), F.count("*").alias("n")).union(counted)


@query(
    """select id, count(*) as n from (select base || case when k = 0 then '' else '--' || cast(k as varchar) end as id from (
    select base, row_number() over (partition by base order by l_orderkey, l_linenumber) - 1 as k
    from (select 'c' || cast(o_custkey as varchar) || '--CALLS--p' || cast(l_partkey as varchar) as base, l_orderkey, l_linenumber from lineitem join orders on l_orderkey = o_orderkey)))
    group by id having count(*) > 1 or id like '%--1'"""
)
def kg_edge_repeat_ids(s: Star) -> DataFrame:
    """X3k, W5: repeat numbers in the ids of a file's edges."""
    key = lambda c, n: F.concat(F.lit(n), F.col(c).cast("string"))
    rows = s.table("lineitem").join(s.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.lit("edge").alias("kind"), F.lit("orders.py").alias("file_path"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("seq"), F.lit(None).cast("string").alias("id"),
        key("o_custkey", "c").alias("source_id"), F.lit("CALLS").alias("relationship"), key("l_partkey", "p").alias("target_id"), F.lit(None).cast("string").alias("message"),
    )
    return extract.to_graph(rows)[1].groupBy("id").agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.endswith("id", F.lit("--1")))


@query(
    """select coalesce(a.id, b.id) as id, case when b.id is null then 'missing right' when a.id is null then 'missing left' else 'different' end as state
    from (select * from nodes where ord % 10 <> 1) a full outer join (select *, case when ord % 10 = 2 then line_number + 1 else line_number end as l2 from nodes where ord % 10 <> 3) b on a.id = b.id
    where a.id is null or b.id is null or a.line_number <> b.l2""",
    "nodes",
)
def kg_compare(s: Star) -> DataFrame:
    b = s.nodes.where("ord % 10 <> 3").withColumn("line_number", F.when(F.expr("ord % 10 = 2"), F.col("line_number") + 1).otherwise(F.col("line_number")))
    return G.compare(s.nodes.where("ord % 10 <> 1"), b)


@query(
    """with both_ways as (select source_id as a, target_id as b from edges union select target_id, source_id from edges),
    zero as (select id from nodes where name = 'NATION_3'), one as (select b as id from both_ways where a in (select id from zero)),
    two as (select b as id from both_ways where a in (select id from one))
    select id, min(distance) as distance from (select id, 0 as distance from zero union all select id, 1 from one union all select id, 2 from two)
    where id in (select id from nodes) group by id""",
    "nodes", "edges",
)
def kg_ego_radius2(s: Star) -> DataFrame:
    return G.ego_network(s.nodes, s.edges, "NATION_3", 2)


@query(
    """with first as (select id, row_number() over (order by ord) as pos from nodes where type <> 'module' order by ord limit 40)
    select source_id, target_id, relationship from edges where source_id in (select id from first) and target_id in (select id from first)""",
    "nodes", "edges",
)
def kg_subgraph_first40(s: Star) -> DataFrame:
    ids = s.nodes.where("type <> 'module'").select("id", F.col("ord").alias("pos"))
    return G.subgraph(ids, s.nodes, s.edges, 40)[1].select("source_id", "target_id", "relationship")


@query("select id, name from nodes order by md5(id || '|3'), id limit 500", "nodes")
def kg_sample_nodes(s: Star) -> DataFrame:
    return G.sample_nodes(s.nodes, 500, seed=3).select("id", "name")


@query(
    """select id, string_split(id, '::')[1] as file, string_split(string_split(id, '::')[1], '/')[-1] || case when type = 'module' then '' else '::' || name end as short from nodes""",
    "nodes",
)
def kg_short_ids(s: Star) -> DataFrame:
    return s.nodes.select("id", G.file_of(F.col("id")).alias("file"), G.short_id(F.col("id")).alias("short"))


@query(
    """select id, name as label, name || chr(10) || type || chr(10) || file_path || ':' || cast(line_number as varchar) as title,
    case type when 'function' then '#4C9BE8' when 'class' then '#E8874C' else '#6BBF59' end as color from nodes""",
    "nodes",
)
def kg_display(s: Star) -> DataFrame:
    return G.display(s.nodes)


@query(
    """with steps as (select distinct source_id, target_id from edges where relationship in ('CALLS', 'IMPORTS')),
    f0 as (select id as start, id from nodes where name like 'Customer#%'),
    f1 as (select distinct start, target_id as id from f0 join steps on source_id = id), f2 as (select distinct start, target_id as id from f1 join steps on source_id = id),
    f3 as (select distinct start, target_id as id from f2 join steps on source_id = id)
    select start, count(*) as reached from (select * from f0 union select * from f1 union select * from f2 union select * from f3) group by start""",
    "nodes", "edges",
)
def reach_forward(s: Star) -> DataFrame:
    """What each account reaches in three hops."""
    starts = s.nodes.where("name like 'Customer#%'").select(F.col("id").alias("incident_id"), F.col("id").alias("node_id"))
    reached, asked, _ = C.walked(starts, s.edges, True, 3)
    return reached.groupBy("incident").agg(F.count("*").alias("reached")).join(asked, "incident").select(F.col("incident_id").alias("start"), "reached")


# --- resolution ---------------------------------------------------------------

#: Symbolic edges, which grow with the tables: accounts call, extend, raise, catch and are decorated; suppliers import by name, by module and by a part of an id.
_SYMBOLS = """
select case when rel = 'DECORATES' then sym else src end || '--' || rel || '--' || case when rel = 'DECORATES' then src else sym end as id,
  case when rel = 'DECORATES' then sym else src end as source_id, case when rel = 'DECORATES' then src else sym end as target_id,
  rel as relationship, cast(1.0 as double) as confidence, false as is_resolved, alias, ord
from (
  select c.id as src, c_custkey as ord, cast(null as string) as alias,
    case c_custkey % 8 when 0 then 'CALLS' when 1 then 'CALLS' when 2 then 'EXTENDS' when 3 then 'RAISES' when 4 then 'CALLS' when 5 then 'DECORATES' when 6 then 'CALLS' else 'CATCHES' end as rel,
    case c_custkey % 8 when 0 then replace(p_name, ' ', '_') when 1 then case when c_custkey % 3 = 0 then 'append' when c_custkey % 3 = 1 then 'str' else c_name end
      when 2 then case when c_custkey % 3 = 0 then 'Enum' else 'NATION_' || cast(c_custkey % 25 as string) end
      when 3 then case when c_custkey % 3 = 0 then 'ValueError' when c_custkey % 3 = 1 then 'StatusFError' else c_name end
      when 4 then 'dep' when 5 then case when c_custkey % 3 = 0 then 'property' else replace(p_name, ' ', '_') end
      when 6 then 'p' || cast(p_partkey as string) else case when c_custkey % 3 = 0 then 're_raise' else 'NoSuchThing' end end as sym
  from {customer} join {nodes} c on c.ord = 1000000 + c_custkey join {part} on p_partkey = c_custkey * 7 % 200 + 1
  union all
  select c.id, 10000000 + c_custkey, case when c_custkey % 20 = 19 then 'dep' end, 'IMPORTS', p_brand || '::' || replace(p_name, ' ', '_')
  from {customer} join {nodes} c on c.ord = 1000000 + c_custkey join {part} on p_partkey = c_custkey * 11 % 200 + 1 where c_custkey % 10 = 9
  union all
  select n.id, 20000000 + s_suppkey, case when s_suppkey % 2 = 0 then 'it' || cast(s_suppkey as string) end, 'IMPORTS',
    case s_suppkey % 3 when 0 then p_brand || '::' || replace(p_name, ' ', '_') when 1 then lower(r_name) else 'c' || cast(s_suppkey as string) || '::Customer' end
  from {supplier} join {nodes} n on n.ord = 2000000000 + s_suppkey join {part} on p_partkey = s_suppkey * 3 % 200 + 1 join {region} on r_regionkey = s_suppkey % 5
) x
"""


def _symbolic(s: Star) -> DataFrame:
    e = s.sql(_SYMBOLS, nodes=s.nodes)
    missing = [f.split(" ") for f in G.EDGES.split(", ") if f.split(" ")[0] not in e.columns]
    return D.checkpoint(e.select("*", *(F.lit(None).cast(t).alias(n) for n, t in missing)))


# The four strategies as SQL over the symbolic edges: same file, imports, ranked name, part of an id.
_SYM = "with syms as (" + _SYMBOLS.format(nodes="nodes", **{t: t for t in ("customer", "part", "supplier", "region")}) + ")"
_SAME = "select max_by(id, ord) as id, file_path, name from nodes where name <> '' group by file_path, name"
_FIND = f"""{_SYM}, own as ({_SAME}),
    targets as (select distinct target_id, case when contains(target_id, '::') then split_part(target_id, '::', 1) else target_id end as module,
      case when contains(target_id, '::') then split_part(target_id, '::', 2) end as symbol from syms where relationship = 'IMPORTS'),
    files as (select distinct file_path, split_part(split_part(file_path, '/', -1), '.py', 1) as stem from nodes),
    exact as (select target_id, min_by(n.id, n.ord) as node from targets t join files f on stem = module or contains(f.file_path, '/' || module || '/') join nodes n on n.file_path = f.file_path
      and case when symbol is null then n.type = 'module' else n.name = symbol end group by target_id),
    inside as (select target_id, min_by(n.id, n.ord) as node from targets t join nodes n on contains(n.id, t.target_id) where target_id not in (select target_id from exact) group by target_id),
    aim as (select * from exact union all select * from inside),
    symtab as (select split_part(source_id, '::', 1) as file, coalesce(nullif(alias, ''), case when contains(syms.target_id, '::') then split_part(syms.target_id, '::', 2) else syms.target_id end) as local_name,
      max_by(coalesce(node, syms.target_id), ord) as resolved from syms left join aim using (target_id) where relationship = 'IMPORTS' group by 1, 2),
    work as (select *, case when relationship = 'DECORATES' then source_id else target_id end as name, split_part(case when relationship = 'DECORATES' then target_id else source_id end, '::', 1) as file,
      case when relationship in ('CATCHES', 'EXTENDS', 'RAISES') then 'class' when relationship = 'DECORATES' then 'function' end as preferred from syms where relationship <> 'IMPORTS'),
    pool as (select w.id as edge, n.id as node, row_number() over (partition by w.id order by exists (select 1 from symtab t where t.file = w.file and split_part(t.resolved, '::', 1) = split_part(n.id, '::', 1)) desc,
      coalesce(n.type = w.preferred, false) desc, case n.type when 'function' then 0 when 'class' then 1 when 'module' then 2 when 'variable' then 3 else 4 end, n.confidence desc, n.ord) as k from work w join nodes n on n.name = w.name),
    parts as (select distinct id, p as name from (select id, split_part(id, '::', 2) as a, split_part(id, '::', 3) as b from nodes) cross join unnest([a, b, a || '::' || b]) u(p)),
    partial as (select name, min(id) as node from parts where name not in (select name from nodes) group by name having count(*) = 1),
    found as (select w.*, own.id as hit1, case when t.resolved in (select id from nodes) then t.resolved end as hit2, p.node as hit3, q.node as hit4 from work w left join own on own.name = w.name and own.file_path = w.file
      left join symtab t on t.file = w.file and t.local_name = w.name left join pool p on p.edge = w.id and p.k = 1 left join partial q on q.name = w.name)"""


@query(f"{_FIND} select id, coalesce(hit1, hit2, hit3, hit4) as resolved, case when hit1 is not null then 1 when hit2 is not null then 2 when hit3 is not null then 3 when hit4 is not null then 4 end as strategy from found", "nodes")
def resolve_strategies(s: Star) -> DataFrame:
    """The strategy that finds each symbol of an edge."""
    e = _symbolic(s)
    decorates, rel = F.col("relationship") == "DECORATES", F.col("relationship")
    e = e.where("relationship <> 'IMPORTS'").withColumn("name", F.when(decorates, F.col("source_id")).otherwise(F.col("target_id")))
    e = e.withColumn("file", G.file_of(F.when(decorates, F.col("target_id")).otherwise(F.col("source_id"))))
    e = e.withColumn("preferred", F.when(rel.isin("CATCHES", "EXTENDS", "RAISES"), "class").when(decorates, "function")).select("id", "name", "file", "preferred")
    found = R.find_nodes(e.select("name", "file", "preferred"), s.nodes, _symbolic(s))
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("name", "file", "preferred")]
    return e.alias("e").join(found.alias("f"), same[0] & same[1] & same[2]).select("id", "resolved", F.col("strategy").cast("long").alias("strategy"))


@query(f"{_FIND} select w.id, own.id as resolved from work w join own on own.name = w.name and own.file_path = w.file where relationship in ('CALLS', 'EXTENDS')", "nodes")
def resolve_same_file(s: Star) -> DataFrame:
    e = _symbolic(s).where("relationship in ('CALLS', 'EXTENDS')").withColumn("file", G.file_of(F.col("source_id")))
    found = R.find_nodes(e.select(F.col("target_id").alias("name"), "file", F.lit(None).cast("string").alias("preferred")), s.nodes, _symbolic(s)).where("strategy = 1")
    return e.join(found, (F.col("name") == F.col("target_id")) & (found.file == e.file)).select("id", "resolved")


@query(f"{_FIND} select file, local_name, resolved from symtab", "nodes")
def resolve_symbol_table(s: Star) -> DataFrame:
    return R.symbol_table(s.nodes, _symbolic(s))


@query(f"{_FIND} select target_id, node, target_id in (select target_id from inside) as by_substring from aim", "nodes")
def resolve_import_targets(s: Star) -> DataFrame:
    """What imports mean, and which of them only a part of an id tells."""
    found = R.import_targets(s.nodes, _symbolic(s))
    named = F.when(F.contains("target_id", F.lit("::")), F.substring_index("target_id", "::", -1) == F.substring_index("node", "::", -1)).otherwise(F.endswith("node", F.lit(".py::::")))
    return found.select("target_id", "node", (~named).alias("by_substring"))


@query(
    """with wanted as (select distinct replace(p_name, ' ', '_') as name from part)
    select w.name, (select id from nodes n where n.name = w.name order by confidence desc, ord limit 1) as resolved from wanted w""",
    "nodes",
)
def resolve_ranked_name(s: Star) -> DataFrame:
    names = s.table("part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("name")).distinct()
    wanted = names.select("name", F.lit("elsewhere.py").alias("file"), F.lit("function").alias("preferred"))
    return R.find_nodes(wanted, s.nodes, _symbolic(s)).select("name", "resolved")


@query(
    """with wanted as (select 'c' || cast(c_custkey as varchar) as name from customer union all select 'p5::' union all select 'py'),
    parts as (select distinct id, p as name from (select id, string_split(id, '::')[2] as a, string_split(id, '::')[3] as b from nodes) cross join unnest([a, b, a || '::' || b]) u(p))
    select name, min(id) as resolved from wanted join parts using (name) group by name having count(*) = 1""",
    "nodes",
)
def resolve_partial_id(s: Star) -> DataFrame:
    c = s.table("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"))
    names = c.union(s.spark.createDataFrame([("p5::",), ("py",)], "name string"))
    wanted = names.select("name", F.lit("elsewhere.py").alias("file"), F.lit(None).cast("string").alias("preferred"))
    return R.find_nodes(wanted, s.nodes, _symbolic(s)).where("strategy = 4").select("name", "resolved")


_RESOLVED = f"""{_FIND}, kinds as (select *, case when relationship = 'DECORATES' and name = 'property' then 'decorator' when relationship in ('RAISES', 'CATCHES') and name = 'ValueError' then 'exception' end as before from found),
    hits as (select *, case when before is null and name <> 're_raise' then coalesce(hit1, hit2, hit3, hit4) end as hit from kinds),
    done as (select *, case when hit is not null or name = 're_raise' then null else coalesce(before, case when relationship = 'CALLS' and name = 'append' then 'method' when relationship = 'CALLS' and name = 'str' then 'type_call'
      when relationship = 'EXTENDS' and name = 'Enum' then 'base_class' end) end as kind from hits)"""


@query(
    f"""{_RESOLVED} select id, case when relationship = 'DECORATES' then coalesce(hit, source_id) else source_id end as source_id, case when relationship <> 'DECORATES' then coalesce(hit, target_id) else target_id end as target_id,
    hit is not null as is_resolved, kind as builtin_kind, round(case when kind is not null then 0.5 when hit is null then confidence - 0.3 else confidence end, 6) as confidence,
    case when name = 're_raise' then 'placeholder target (re_raise)' when hit is null and kind is null then case relationship when 'CALLS' then 'call target' when 'EXTENDS' then 'base class' when 'DECORATES' then 'decorator' else 'exception class' end || ' not found in graph' end as unresolved_reason
    from done""",
    "nodes",
)
def resolve_edges(s: Star) -> DataFrame:
    done = R.resolve(s.nodes, _symbolic(s)).where("relationship <> 'IMPORTS'")
    return done.select("id", "source_id", "target_id", "is_resolved", "builtin_kind", F.round("confidence", 6).alias("confidence"), "unresolved_reason")


@query(
    f"""{_RESOLVED} select (select count(*) from syms) as total_edges, cast(0 as bigint) as skipped, (select count(*) from syms where relationship = 'IMPORTS') as imports,
    count(*) filter (kind is not null) as builtins, count(*) filter (hit is not null) as resolved, count(*) filter (hit is null and kind is null) as unresolved,
    round(count(*) filter (hit is not null) / count(*) filter (kind is null), 9) as resolution_rate from done""",
    "nodes",
)
def resolve_tally(s: Star) -> DataFrame:
    row = R.tally(R.resolve(s.nodes, _symbolic(s)))
    return row.withColumn("resolution_rate", F.round("resolution_rate", 9))


#: A name a part: catalog names and names of the tables in turn.
_NAMES = "case p_partkey % 9 when 0 then 'append' when 1 then 'print' when 2 then 'dict' when 3 then 'KeyError' when 4 then 'os.path' when 5 then 'property' when 6 then lower(p_type) || '.setter' when 7 then 'json.' || lower(p_brand) else replace(p_name, ' ', '_') end"


@query(
    f"""select p_partkey, name, case when name = 'append' then 'method' when name in ('print', 'property') then 'function' when name = 'dict' then 'type_call' when name = 'KeyError' then 'exception_call' when name = 'os.path' or name like 'json.%' then 'stdlib' end as call_kind,
    case when name in ('property', 'os.path') or name like 'json.%' then 'decorator' when name like '%.setter' then 'property_descriptor' end as decorator_kind,
    case when name = 'dict' then 'base_class' when name = 'KeyError' then 'exception_base' end as base_kind from (select p_partkey, {_NAMES} as name from part)"""
)
def builtin_classify(s: Star) -> DataFrame:
    """F22 to F24."""
    names = s.table("part").select("p_partkey", F.expr(_NAMES).alias("name"))
    return names.select("p_partkey", "name", R.call_kind(F.col("name")).alias("call_kind"), R.decorator_kind(F.col("name")).alias("decorator_kind"), R.base_kind(F.col("name")).alias("base_kind"))


# --- commits and upkeep ---------------------------------------------------------


@query(
    """select c_name as name, 'sha' || cast(o_orderkey as varchar) as last_commit_sha, o_orderpriority as last_commit_message from customer left join (
    select *, row_number() over (partition by o_custkey order by o_orderdate desc, 'sha' || cast(o_orderkey as varchar) desc) as k from orders) o on o_custkey = c_custkey and k = 1"""
)
def commits_latest_join(s: Star) -> DataFrame:
    key = lambda c: F.concat(F.lit("sales/c"), F.col(c).cast("string"), F.lit(".py"))
    rows = s.table("orders").select(
        key("o_custkey").alias("file_path"), F.concat(F.lit("sha"), F.col("o_orderkey").cast("string")).alias("sha"), F.col("o_orderpriority").alias("message"),
        F.lit("a").alias("author_name"), F.col("o_orderdate").cast("string").alias("author_date"),
    )
    none = {c: F.lit(None).cast("string").alias(c) for c in commits.META}
    nodes = s.table("customer").select(F.concat(F.lit("\\repo\\"), F.replace(key("c_custkey"), F.lit("/"), F.lit("\\"))).alias("file_path"), F.col("c_name").alias("name"), *none.values())
    return commits.enrich(nodes, rows, "/repo/").select("name", "last_commit_sha", "last_commit_message")


@query(
    """select url, split_part(split_part(url, '://', 2), '/', 2) as owner, regexp_replace(split_part(split_part(url, '://', 2), '/', 3), '\\.git$', '') as repo
    from (select distinct 'https://host/' || lower(replace(n_name, '_', '-')) || '/' || lower(r_name) || case when n_nationkey % 2 = 0 then '.git' else '' end as url from nation join region on n_regionkey = r_regionkey)"""
)
def repo_addresses(s: Star) -> DataFrame:
    url = "select distinct 'https://host/' || lower(replace(n_name, '_', '-')) || '/' || lower(r_name) || case when n_nationkey % 2 = 0 then '.git' else '' end as url from {nation} join {region} on n_regionkey = r_regionkey"
    rows = s.sql(url).withColumn("a", commits.owner_and_repo(F.col("url")))
    return rows.select("url", "a.owner", "a.repo")


@query(
    """select coalesce(repo, 'TOTAL') as repo, sum(n) as nodes, sum(e) as edges, sum(x) as errors from (
    select split_part(id, '/', 1) as repo, count(*) as n, 0 as e, 0 as x from nodes group by 1
    union all select split_part(source_id, '/', 1), 0, count(*), count(*) filter (not is_resolved) from edges group by 1) group by rollup (repo)""",
    "nodes", "edges",
)
def repo_rollup(s: Star) -> DataFrame:
    top = lambda c: F.substring_index(c, "/", 1)
    n = s.nodes.groupBy(top("id").alias("repo")).agg(F.count("*").alias("nodes"), F.lit(0).alias("edges"), F.lit(0).alias("errors"))
    e = s.edges.groupBy(top("source_id").alias("repo")).agg(F.lit(0).alias("nodes"), F.count("*").alias("edges"), F.count_if(~F.col("is_resolved")).alias("errors"))
    return ingest.summary(n.union(e))


# --- incidents --------------------------------------------------------------------

_CLEAN = "regexp_replace(regexp_replace(regexp_replace(split_part(raw_text, chr(10), 1), '^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}( [0-9:]+)?\\s*', ''), '^(ERROR|WARN)\\s*', ''), '^\\[[^\\]]+\\]\\s*', '')"


@query(f"select incident_id, {_CLEAN} as first_line, 'python' as language from incidents", "nodes", "incidents")
def incident_prefix_and_language(s: Star) -> DataFrame:
    clean = I.cleaned(F.col("raw_text"))
    return s.incidents.select("incident_id", F.substring_index(clean, "\n", 1).alias("first_line"), I.language(clean).alias("language"))


@query(
    """select incident_id, case split_part(regexp_extract(raw_text, '\\n([A-Za-z.]+): [^\\n]*$', 1), '.', -1) when '' then '' else split_part(regexp_extract(raw_text, '\\n([A-Za-z.]+): [^\\n]*$', 1), '.', -1) end as error_type,
    regexp_extract(raw_text, '\\n[A-Za-z.]+: ([^\\n]*)$', 1) as error_message from incidents""",
    "nodes", "incidents",
)
def incident_errors(s: Star) -> DataFrame:
    return I.parse(s.incidents).select("incident_id", "error_type", "error_message")


_FRAMES = """select incident_id, unnest(range(len(f))) as i, unnest(regexp_extract_all(raw_text, 'File "([^"]+)"', 1)) as file, unnest(regexp_extract_all(raw_text, ', in (\\S+)', 1)) as function,
    cast(unnest(regexp_extract_all(raw_text, ', line (\\d+)', 1)) as int) as line, unnest(regexp_extract_all(raw_text, ', in \\S+\\n    ([^\\n]+)', 1)) as code_context
    from (select *, regexp_extract_all(raw_text, 'File "') as f from incidents)"""


@query(f"select incident_id, i, file, function, line, code_context from ({_FRAMES})", "nodes", "incidents")
def frames_python(s: Star) -> DataFrame:
    p = I.parse(s.incidents).select("incident_id", F.posexplode("frames").alias("i", "f"))
    return p.select("incident_id", F.col("i").cast("long").alias("i"), F.col("f.file_path").alias("file"), F.col("f.function_name").alias("function"), F.col("f.line_number").alias("line"), "f.code_context")


@query(
    """select incident_id, case when k = 0 then regexp_extract(t, '\\(([^)]+):\\d+\\)', 1) when k = 1 then regexp_extract(t, '^([^ :]+):', 1) else regexp_extract(t, 'WARN ([^ :]+):', 1) end as file,
    case when k = 0 then regexp_extract(t, '^at (\\S+)', 1) when k = 1 then regexp_extract(t, ' in (\\S+)', 1) else '' end as function,
    cast(case when k = 0 then regexp_extract(t, ':(\\d+)\\)', 1) when k = 1 then regexp_extract(t, ':(\\d+) in', 1) else regexp_extract(t, ':(\\d+)$', 1) end as int) as line, 'OutOfStock' as error_type
    from (select incident_id, split_part(raw_text, chr(10), 1) as t, cast(incident_id as bigint) % 4 as k from log_lines) where k < 3""",
    "nodes", "log_lines",
)
def frames_generic(s: Star) -> DataFrame:
    p = I.parse(s.log_lines).select("incident_id", F.explode("frames").alias("f"), "error_type")
    return p.select("incident_id", F.col("f.file_path").alias("file"), F.col("f.function_name").alias("function"), F.col("f.line_number").alias("line"), "error_type")


_NOISE = "('in', 'of', 'is', 'no', 'error', 'the')"


@query(
    f"""with parsed as (select incident_id, split_part(regexp_extract(raw_text, '\\n([A-Za-z.]+): [^\\n]*$', 1), '.', -1) as error_type,
      regexp_extract(raw_text, '\\n[A-Za-z.]+: ([^\\n]*)$', 1) as error_message, regexp_extract_all(raw_text, ', in (\\S+)', 1) as fs, regexp_extract_all(raw_text, '/([^/"]+)\\.py"', 1) as ss from incidents),
    words as (select incident_id, list_concat(list_concat(case error_type when 'StatusFError' then ['status'] when 'StockTimeoutError' then ['stock', 'timeout'] else ['value'] end,
        list_filter(regexp_extract_all(error_message, '[a-z_]+'), lambda x: x not in {_NOISE})),
      list_concat(list_concat(string_split(lower(fs[1]), '_'), string_split(lower(fs[2]), '_')), list_transform(ss, lambda x: lower(x)))) as w from parsed),
    each as (select incident_id, unnest(w) as k, unnest(range(len(w))) as i from words)
    select incident_id, string_agg(k, ',' order by i) as keywords, count(*) as n from (select incident_id, k, min(i) as i from each where len(k) > 1 group by incident_id, k) group by incident_id""",
    "nodes", "incidents",
)
def incident_keywords(s: Star) -> DataFrame:
    return I.parse(s.incidents).select("incident_id", F.array_join("keywords", ",").alias("keywords"), F.size("keywords").cast("long").alias("n"))


_ENTRIES = f"""frames as ({_FRAMES}),
    met as (select f.incident_id, f.i, 0.4 + 0.6 * f.i as weight, n.id as node_id, n.ord, n.line_number, f.line, n.line_number <= f.line as before
      from frames f join nodes n on n.name = f.function and n.type in ('class', 'function') and (ends_with(n.file_path, f.file) or ends_with(f.file, split_part(n.file_path, '/', -1)) or split_part(n.file_path, '/', -1) = split_part(f.file, '/', -1))),
    kept as (select *, row_number() over (partition by incident_id, i order by before desc, line_number desc, ord) as k, bool_or(before) over (partition by incident_id, i) as any_before from met),
    matches as (select incident_id, i, weight, node_id, ord from kept where not any_before or k = 1),
    entries as (select incident_id, node_id, max(weight) as weight, row_number() over (partition by incident_id order by max(weight) desc, min(i * 10000000000 + ord)) - 1 as pos from matches group by incident_id, node_id qualify pos < 5)"""


@query(f"with {_ENTRIES} select incident_id, i, round(weight, 6) as weight, node_id from matches", "nodes", "incidents")
def entry_match_asof(s: Star) -> DataFrame:
    m = V.entry_matches(I.parse(s.incidents), s.nodes)
    return m.select("incident_id", F.col("i").cast("long").alias("i"), F.round("weight", 6).alias("weight"), "node_id")


@query(f"with {_ENTRIES} select incident_id, node_id, round(weight, 6) as weight, pos from entries", "nodes", "incidents")
def entry_weights(s: Star) -> DataFrame:
    e = V.entry_nodes(V.entry_matches(I.parse(s.incidents), s.nodes))
    return e.select("incident_id", "node_id", F.round("weight", 6).alias("weight"), F.col("pos").cast("long").alias("pos"))


# --- scoring and search -------------------------------------------------------------

_DAYS = f"greatest(0, date_diff('day', cast(substring(last_commit_date, 1, 10) as date), date '{AS_OF[:10]}'))"


@query(
    f"""select bucket, count(*) as n, sum(days) as days from (select case when last_commit_date is null then 0.0 when {_DAYS} <= 1 then 1.0 when {_DAYS} <= 7 then 0.8 when {_DAYS} <= 30 then 0.5 else 0.2 end as bucket,
    case when last_commit_date is not null then {_DAYS} end as days from nodes) group by bucket""",
    "nodes",
)
def git_recency_bucket(s: Star) -> DataFrame:
    d = s.nodes.withColumn("days", S.days_since(F.coalesce("last_commit_date", F.lit("")), AS_OF))
    return d.groupBy(S.git_score(F.col("days")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("days").alias("days"))


@query(
    """select source_id as node_id, count(*) filter (target_id = 'StatusFError') > 0 as raises_it from edges where relationship = 'RAISES' group by source_id""",
    "nodes", "edges",
)
def raises_align(s: Star) -> DataFrame:
    sig = V.node_signals(s.nodes, s.edges, AS_OF).where(F.size("raises") > 0)
    return sig.select("node_id", F.exists("raises", lambda r: F.substring_index(r, ".", -1) == "StatusFError").alias("raises_it"))


# Keywords by incident as a list, and all facts that a score needs.
_SCORE_BASE = f"""{_ENTRIES},
    parsed as (select incident_id, split_part(regexp_extract(raw_text, '\\n([A-Za-z.]+): [^\\n]*$', 1), '.', -1) as error_type,
      regexp_extract(raw_text, '\\n[A-Za-z.]+: ([^\\n]*)$', 1) as error_message, regexp_extract_all(raw_text, ', in (\\S+)', 1) as fs, regexp_extract_all(raw_text, '/([^/"]+)\\.py"', 1) as ss from incidents),
    kw0 as (select incident_id, error_type, list_filter(list_concat(list_concat(case error_type when 'StatusFError' then ['status'] when 'StockTimeoutError' then ['stock', 'timeout'] else ['value'] end,
        list_filter(regexp_extract_all(error_message, '[a-z_]+'), lambda x: x not in ('in', 'of', 'is', 'no'))),
      list_concat(list_concat(string_split(lower(fs[1]), '_'), string_split(lower(fs[2]), '_')), list_transform(ss, lambda x: lower(x)))), lambda x: len(x) > 1) as k0 from parsed),
    kw as (select incident_id, error_type, list_filter(k0, lambda x, i: list_position(k0, x) = i) as k from kw0),
    sig as (select n.id as node_id, n.name, case when last_commit_date is null then null else {_DAYS} end as days,
      lower(concat_ws(' ', nullif(n.name, ''), nullif(n.docstring, ''), nullif(n.last_commit_message, ''))) as hay, coalesce(c.n, 0) as calls_out, coalesce(r.f, false) as raises_f
      from nodes n left join (select source_id, count(*) as n from edges where relationship = 'CALLS' group by 1) c on c.source_id = n.id
      left join (select source_id, bool_or(target_id = 'StatusFError') as f from edges where relationship = 'RAISES' group by 1) r on r.source_id = n.id),
    git as (select *, case when days is null then 0.0 when days <= 1 then 1.0 when days <= 7 then 0.8 when days <= 30 then 0.5 else 0.2 end as g from sig)"""


def _sql_score(hop: int) -> str:
    kw = "cast(len(list_filter(kw.k, lambda x: contains(git.hay, x))) as double) / len(kw.k)"
    link = "least(1.0, git.calls_out / 10.0)" if hop == 0 else "0.0"
    return f"round({1 / (1 + hop)!r} * 0.2 + git.g * 0.35 + {kw} * 0.2 + case when kw.error_type = 'StatusFError' and git.raises_f then 0.15 else 0.0 end + {link} * 0.1, 4)"


def _parsed_entries(s: Star) -> tuple[DataFrame, DataFrame]:
    parsed = D.checkpoint(I.parse(s.incidents))
    return parsed, D.checkpoint(V.entry_nodes(V.entry_matches(parsed, s.nodes)).select("incident_id", "node_id", "pos"))


@query(
    f"""with {_SCORE_BASE} select e.incident_id, e.node_id, {_sql_score(0)} as score, len(list_filter(kw.k, lambda x: contains(git.hay, x))) as hits, len(kw.k) as keywords, git.calls_out, git.days
    from entries e join git using (node_id) join kw using (incident_id)""",
    "nodes", "edges", "incidents",
)
def score_signals(s: Star) -> DataFrame:
    parsed, entries = _parsed_entries(s)
    d = V.score(entries.select("incident_id", "node_id", F.lit(0).alias("hop")), parsed, V.node_signals(s.nodes, s.edges, AS_OF), S.Weights())
    return d.select("incident_id", "node_id", "score", F.size("hits").cast("long").alias("hits"), F.size("keywords").cast("long").alias("keywords"), F.col("calls_out").cast("long").alias("calls_out"), F.col("days").cast("long").alias("days"))


def _sql_levels(hops: int) -> str:
    out = [f"level0 as (select e.incident_id, e.node_id, {_sql_score(0)} as score, 0 as hop from entries e join git using (node_id) join kw using (incident_id))"]
    links = """links as (select target_id as a, source_id as b from edges where relationship in ('CALLS', 'EXTENDS', 'IMPORTS') union all select source_id, target_id from edges where relationship in ('CALLS', 'IMPORTS'))"""
    out.insert(0, links)
    for h in range(1, hops + 1):
        seen = " union all ".join(f"select incident_id, node_id from level{k}" for k in range(h))
        out.append(
            f"""level{h} as (select n.incident_id, n.node_id, {_sql_score(h)} as score, {h} as hop from (
            select distinct l.incident_id, b as node_id from level{h - 1} l join links on a = l.node_id
            where (l.incident_id, b) not in ({seen})) n join git using (node_id) join kw using (incident_id)
            qualify row_number() over (partition by n.incident_id order by score desc, n.node_id) <= 15)"""
        )
    return ",\n".join(out)


_CANDIDATES = f"{_SCORE_BASE}, {_sql_levels(4)}, candidates as (select *, row_number() over (partition by incident_id order by score desc, hop, node_id) as rank from (" + " union all ".join(f"select * from level{k}" for k in range(5)) + "))"


def _candidates(s: Star) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Which incidents ask the same, and entries and candidates of those that ask first."""
    parsed, entries = _parsed_entries(s)
    same = V.asked_once(parsed, entries)
    parsed, entries = D.checkpoint(V.leading(parsed, same)), D.checkpoint(V.leading(entries, same))
    return same, entries, V.beam_search(entries, parsed, s.nodes, s.edges, AS_OF)


def _verified(s: Star) -> tuple[DataFrame, DataFrame]:
    same, entries, candidates = _candidates(s)
    return same, C.verify(candidates, entries, s.edges)


@query(f"with {_CANDIDATES} select incident_id, node_id, hop as hops_from_entry, score, rank from candidates", "nodes", "edges", "incidents")
def bfs_beam(s: Star) -> DataFrame:
    same, _, found = _candidates(s)
    return V.told_to_all(found.select("incident_id", "node_id", "hops_from_entry", "score", F.col("rank").cast("long").alias("rank")), same)


def _sql_closure() -> str:
    out = ["calls as (select distinct source_id as a, target_id as b from edges where relationship in ('CALLS', 'IMPORTS'))", "f0 as (select incident_id, node_id from entries)", "b0 as (select incident_id, node_id from entries)"]
    for h in range(1, 6):
        for name, here, there in (("f", "a", "b"), ("b", "b", "a")):
            seen = " union ".join(f"select * from {name}{k}" for k in range(h))
            out.append(f"{name}{h} as (select distinct x.incident_id, {there} as node_id from {name}{h - 1} x join calls on {here} = x.node_id except ({seen}))")
    union = " union ".join(f"select * from {n}{k}" for n in "fb" for k in range(6))
    return ", ".join(out) + f", reached as ({union})"


_VERIFIED = f"""{_CANDIDATES}, {_sql_closure()},
    checked as (select c.*, r.node_id is not null as path_exists, coalesce(git.days <= 30, false) as git_confirms, len(list_filter(kw.k, lambda x: contains(git.hay, x))) > 0 as keyword_match
      from candidates c join git using (node_id) join kw using (incident_id) left join reached r on r.incident_id = c.incident_id and r.node_id = c.node_id where c.rank <= 5),
    graded as (select *, cast(path_exists as int) + cast(git_confirms as int) + cast(keyword_match as int) as passed from checked),
    verified as (select *, case when passed >= 3 then 'high' when passed = 2 then 'medium' else 'low' end as confidence,
      row_number() over (partition by incident_id order by path_exists desc, score desc, least(3, passed) desc, rank) as verified_rank,
      row_number() over (partition by incident_id order by path_exists desc, case when passed >= 3 then 0 when passed = 2 then 1 else 2 end, score desc, rank) as head_rank from graded)"""


@query(f"with {_VERIFIED} select incident_id, node_id, path_exists, git_confirms, keyword_match, confidence, verified_rank from verified", "nodes", "edges", "incidents")
def verify_checks(s: Star) -> DataFrame:
    same, v = _verified(s)
    v = v.select("incident_id", "node_id", "path_exists", "git_confirms", "keyword_match", "confidence", F.col("verified_rank").cast("long").alias("verified_rank"))
    return V.told_to_all(v, same)


@query(f"with {_VERIFIED} select incident_id, node_id, confidence, score from verified where head_rank = 1", "nodes", "edges", "incidents")
def headline_by_confidence(s: Star) -> DataFrame:
    same, v = _verified(s)
    return V.told_to_all(C.headline(v).select("incident_id", "node_id", "confidence", "score"), same)


@query(
    f"""with {_VERIFIED} select i.incident_id, p.error_type, coalesce(n.name, '') as root_cause_node, coalesce(v.confidence, 'none') as confidence, coalesce(v.score, 0.0) as score, coalesce(v.path_exists, false) as is_valid,
    coalesce(v.hop, 0) as hops_from_entry, coalesce(e.n, 0) as entry_nodes_found, coalesce(c.n, 0) as candidates_found
    from incidents i join parsed p using (incident_id) left join verified v on v.incident_id = i.incident_id and v.verified_rank = 1 left join nodes n on n.id = v.node_id
    left join (select incident_id, count(*) as n from entries group by 1) e on e.incident_id = i.incident_id left join (select incident_id, count(*) as n from candidates group by 1) c on c.incident_id = i.incident_id""",
    "nodes", "edges", "incidents",
)
def diagnose_report(s: Star) -> DataFrame:
    r = D.diagnose(s.incidents, s.nodes, s.edges, AS_OF).reports
    return r.select("incident_id", "error_type", "root_cause_node", "confidence", "score", "is_valid", "hops_from_entry", "entry_nodes_found", "candidates_found")


# --- text index ----------------------------------------------------------------------

_TOKENS = """toks as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda t: len(t) >= 2 and t not in ({stop})) as t from documents),
    tf as (select doc_id as doc, term, count(*) as n, count(*) / max(total) as tf from (select doc_id, len(t) as total, unnest(t) as term from toks) group by doc_id, term),
    idf as (select term, count(*) as df, ln((select count(*) from documents) / (1.0 + count(*))) as idf from tf group by term)""".format(
    stop=", ".join(f"'{w}'" for w in sorted(T.STOP_WORDS))
)


def _docs(s: Star) -> DataFrame:
    return s.table("documents").select(F.col("doc_id").alias("doc"), "text")


@query(f"with {_TOKENS} select doc, term, n, round(tf, 9) as tf from tf")
def tfidf_tf(s: Star) -> DataFrame:
    return T.term_frequencies(_docs(s)).select("doc", "term", "n", F.round("tf", 9).alias("tf"))


@query(f"with {_TOKENS} select term, df, round(idf, 6) as idf from idf")
def tfidf_idf(s: Star) -> DataFrame:
    return T.index(_docs(s))[1].select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    f"""with {_TOKENS} select doc, term, round(v, 6) as tfidf from (select doc, term, tf * idf as v, row_number() over (partition by doc order by round(tf * idf, 9) desc, term) as k from tf join idf using (term)) where k <= 3"""
)
def tfidf_top_terms(s: Star) -> DataFrame:
    w = Window.partitionBy("doc").orderBy(F.round("tfidf", 9).desc(), "term")
    return T.index(_docs(s))[0].withColumn("k", F.row_number().over(w)).where("k <= 3").select("doc", "term", F.round("tfidf", 6).alias("tfidf"))


@query(
    f"""with {_TOKENS},
    qt as (select item_id as query, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: len(t) >= 2 and t not in ({", ".join(f"'{w}'" for w in sorted(T.STOP_WORDS))})) as t from benchmark),
    q as (select query, term, count(*) / max(total) * max(idf) as q from (select query, len(t) as total, unnest(t) as term from qt) join idf using (term) group by query, term),
    v as (select doc, term, tf * idf as v from tf join idf using (term)),
    dots as (select query, doc, sum(q * v) as dot from q join v using (term) group by query, doc),
    scored as (select query, doc, dot / (qn * dn) as similarity from dots join (select query, sqrt(sum(q * q)) as qn from q group by 1) using (query) join (select doc, sqrt(sum(v * v)) as dn from v group by 1) using (doc) where dot > 0)
    select query, doc, round(similarity, 6) as similarity, rank from (select *, row_number() over (partition by query order by round(similarity, 9) desc, doc) as rank from scored) where rank <= 10"""
)
def tfidf_search_topk(s: Star) -> DataFrame:
    asked = s.table("benchmark").select(F.col("item_id").alias("query"), "text")
    vectors, idf = T.index(_docs(s))
    found = T.search(asked, D.checkpoint(vectors), idf, 10)
    return found.select("query", "doc", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"with {_TOKENS} select (select count(*) from documents) as total_nodes, (select count(*) from idf) as vocabulary_size, round((select count(*) from tf) / (select count(*) from documents), 6) as avg_vector_length")
def tfidf_report(s: Star) -> DataFrame:
    return T.index_report(_docs(s), *T.index(_docs(s))).withColumn("avg_vector_length", F.round("avg_vector_length", 6))


@query(
    """with near as (select id, min(side) as side, neighbor_id from (select source_id as id, target_id as neighbor_id, 0 as side from edges union all select target_id, source_id, 1 from edges) group by id, neighbor_id),
    named as (select near.id, string_agg(n.name, ' ' order by side, neighbor_id) as near from near join nodes n on n.id = near.neighbor_id group by near.id)
    select nodes.id as doc, md5(lower(concat_ws(' ', name, name, name, type, nullif(docstring, ''), case when type = 'function' then 'self of_' || split_part(docstring, ' ', 1) when type = 'class' then 'Place' end,
      case when ord % 2 = 0 then 'cached wraps' end, near))) as text from nodes left join named using (id)""",
    "nodes", "edges",
)
def node_document(s: Star) -> DataFrame:
    word = F.substring_index("docstring", " ", 1)
    nodes = s.nodes.withColumn("params", F.array(F.lit("self"), F.concat(F.lit("of_"), word))).withColumn("bases", F.array(F.lit("Place")))
    nodes = nodes.withColumn("decorators", F.when(F.col("ord") % 2 == 0, F.array(F.lit("cached"), F.lit("wraps"))))
    return T.node_documents(nodes, s.edges).select("doc", F.md5("text").alias("text"))


# --- other tables ------------------------------------------------------------------------


@query("select lang, sum(greatest(1, length(text) // 4)) as tokens, round(sum(greatest(1, length(text) // 4)) * 3.0 / 1000000, 9) as dollars from documents group by lang")
def token_estimate(s: Star) -> DataFrame:
    t = s.table("documents").groupBy("lang").agg(F.sum(S.token_estimate(F.col("text"))).alias("tokens"))
    return t.withColumn("dollars", F.round(S.token_cost(F.col("tokens")), 9))


@query(
    """select conv_id, turn, min(preset_key) as preset_key from conversations join (select unnest(['a', 'b']) as preset_key, unnest(['en', 'que']) as role) p on contains(text, p.role) or contains(p.role, text) group by conv_id, turn"""
)
def preset_match(s: Star) -> DataFrame:
    traces = s.table("conversations").select(F.struct("conv_id", "turn").alias("trace_id"), F.col("text").alias("trace"))
    return D.match_preset(traces, [("a", "en"), ("b", "que")]).select("trace_id.conv_id", "trace_id.turn", "preset_key")


@query("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def incident_windows(s: Star) -> DataFrame:
    return ST.windows(s.table("events")).withColumn("total", F.round("total", 4))


@query(
    """with marks as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as fresh from events),
    numbered as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from marks)
    select user_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as n from numbered group by user_id, k"""
)
def incident_sessions(s: Star) -> DataFrame:
    return ST.sessions(s.table("events"))
