"""Registered graph queries."""

from pyspark.sql import functions as F

from lithic.operators import resolve, traverse as G
from lithic.plans.registry import query
from lithic.plans.warehouse import Warehouse, oracle
from lithic.session import cut


def _seed(spark, *ids):
    return spark.createDataFrame([(i, i) for i in ids], "seed bigint, node bigint")


@query(
    "reachability",
    oracle("""
, r as (select 0::bigint as node union select dst from r join m_part_edges on src = node)
select node from r"""),
)
def reachability(spark, sf):
    return G.reach(Warehouse(spark, sf).part_edges, _seed(spark, 0)).select("node")


@query(
    "depth6_closure",
    oracle("""
, r as (select src as seed, src as node, 0 as depth from m_succ union select seed, dst, depth + 1 from r join m_succ on src = node where depth < 6)
select seed, node, min(depth) as depth from r group by all"""),
)
def depth6_closure(spark, sf):
    s = Warehouse(spark, sf).succ
    return G.reach(s, s.select(F.col("src").alias("seed"), F.col("src").alias("node")), 6)


@query(
    "call_closure",
    oracle("""
, r as (select src as seed, src as node from m_succ union select seed, dst from r join m_succ on src = node)
select seed, count(*) as reached from r group by seed"""),
)
def call_closure(spark, sf):
    return G.reach_counts(Warehouse(spark, sf).succ)


@query(
    "impact_reverse",
    oracle("""
, r as (select (select min(dst) from m_succ) as node union select src from r join m_succ on dst = node)
select node from r"""),
)
def impact_reverse(spark, sf):
    s = Warehouse(spark, sf).succ
    seed = s.agg(F.min("dst").alias("seed")).withColumn("node", F.col("seed"))
    return G.reach(G.reverse(s), seed).select("node")


@query(
    "components",
    oracle("""
, und as (select src, dst from m_succ union select dst, src from m_succ),
r as (select src as id, src as other from und union select r.id, und.dst from r join und on und.src = r.other)
select id, min(other) as component from r group by id"""),
)
def components(spark, sf):
    return G.components(Warehouse(spark, sf).succ)


@query(
    "strong_components",
    oracle("""
, r as (select src, dst from m_succ union select r.src, m_succ.dst from r join m_succ on r.dst = m_succ.src),
scc as (select a.src as id, least(a.src, min(a.dst)) as component from r a join r b on a.src = b.dst and a.dst = b.src where a.src <> a.dst group by a.src)
select id, component from scc"""),
)
def strong_components(spark, sf):
    return G.strong_components(Warehouse(spark, sf).succ)


@query(
    "strong_components_dense",
    oracle("""
, e as (select src, dst from m_part_edges where dst in (select src from m_part_edges)),
fwd as (select min(dst) as node from e where dst in (select src from e) union select e.dst from fwd join e on e.src = fwd.node),
bwd as (select min(dst) as node from e where dst in (select src from e) union select e.src from bwd join e on e.dst = bwd.node)
select node as id, (select min(node) from fwd where node in (select node from bwd)) as component from fwd where node in (select node from bwd)"""),
)
def strong_components_dense(spark, sf):
    """Members of the component that holds the smallest part with predecessors."""
    scc = G.strong_components(Warehouse(spark, sf).part_edges)
    first = scc.agg(F.min("component")).scalar()
    return scc.filter(F.col("component") == first)


def _pagerank_sql(rounds: int = 20) -> str:
    sql = """
, n as materialized (select id, (select count(*) from m_part_edges where src = id) as out from (select src as id from m_part_edges union select dst from m_part_edges)),
ed as materialized (select * from m_part_edges),
r0 as materialized (select id, out, 1.0::double / (select count(*) from n) as rank from n)"""
    for i in range(1, rounds + 1):
        sql += f""",
r{i} as materialized (select n.id, n.out, (1-0.85::double)/(select count(*) from n) + 0.85::double*(coalesce(g.got,0) +
   coalesce((select sum(rank) from r{i-1} where out = 0),0)/(select count(*) from n)) as rank
 from n left join (select ed.dst as id, sum(rank/out) as got from r{i-1} join ed on ed.src = r{i-1}.id group by 1) g on g.id = n.id)"""
    return oracle(sql + f" select id, floor(rank*(select count(*) from n)*10000+0.5)/10000 as rank from r{rounds}")


@query("pagerank", _pagerank_sql())
def pagerank(spark, sf):
    r = G.pagerank(Warehouse(spark, sf).part_edges)
    n = r.agg(F.count("*")).scalar()
    return r.select("id", (F.floor(F.col("rank") * n * 10000 + 0.5) / 10000).alias("rank"))


def _lpa_sql(rounds: int = 12) -> str:
    sql = """
, und as materialized (select src, dst from m_succ union select dst, src from m_succ),
l0 as materialized (select src as id, src as c from und group by src)"""
    for i in range(1, rounds + 1):
        sql += f""",
l{i} as materialized (select id, c from (select id, c, row_number() over (partition by id order by n desc, c) r from
   (select und.dst as id, l{i-1}.c, count(*) n from und join l{i-1} on und.src = l{i-1}.id group by all)) where r = 1)"""
    return oracle(sql + f" select id, c as community from l{rounds}")


@query("communities", _lpa_sql())
def communities(spark, sf):
    return G.communities(Warehouse(spark, sf).succ)


@query(
    "dag_layers",
    """with recursive e as (select a.conv_id*1000 + a.turn as src, a.conv_id*1000 + b.turn as dst from conversations a join conversations b
    on a.conv_id = b.conv_id and b.turn = a.turn + 1),
 r as (select src as id, 0 as layer from e where src not in (select dst from e) union select dst, layer + 1 from r join e on src = id)
 select id, max(layer) as layer from r group by id""",
)
def dag_layers(spark, sf):
    return G.layers(turn_edges(Warehouse(spark, sf)))


def turn_edges(w: Warehouse):
    c = w.table("conversations").select("conv_id", "turn")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("next"))
    return c.join(nxt, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("src"), (F.col("conv_id") * 1000 + F.col("next")).alias("dst")
    )


@query(
    "degrees",
    oracle("""
select id, coalesce(i,0) as indeg, coalesce(o,0) as outdeg from (select src as id from m_part_edges union select dst from m_part_edges)
left join (select dst as id, count(*) i from m_part_edges group by 1) using (id) left join (select src as id, count(*) o from m_part_edges group by 1) using (id)"""),
)
def degrees(spark, sf):
    return G.degrees(Warehouse(spark, sf).part_edges)


_RESOLVED = """
, nm as (select name, count(*) n, min(id) only_id from m_functions group by name),
loc as (select file, name, arg_min(id, ord) id, min(ord) ord from m_functions group by all),
k as (select c.caller_id, c.file, c.name, nm.n, nm.only_id, loc.id as local_id from m_calls c join nm using (name) left join loc on loc.file = c.file and loc.name = c.name),
imp as (select distinct file, resolved from m_imports),
sc as (select k.caller_id, k.name, arg_min(loc.id, loc.ord) as dst from k join imp on imp.file = k.file join loc on loc.file = imp.resolved and loc.name = k.name
       where k.n > 1 and k.local_id is null group by all),
m_call_edges as materialized (select distinct k.caller_id as src, case when k.n = 1 then k.only_id when k.local_id is not null then k.local_id else sc.dst end as dst
  from k left join sc on sc.caller_id = k.caller_id and sc.name = k.name
  where coalesce(case when k.n = 1 then k.only_id when k.local_id is not null then k.local_id else sc.dst end, k.caller_id) <> k.caller_id)
"""


def call_edges(w: Warehouse):
    return resolve.resolve_calls(w.calls, w.functions, w.imports)


@query("call_resolve", oracle(_RESOLVED + " select src, dst from m_call_edges"))
def call_resolve(spark, sf):
    return call_edges(Warehouse(spark, sf))


@query("called_by", oracle(_RESOLVED + " select dst as id, count(distinct src) as callers from m_call_edges group by dst"))
def called_by(spark, sf):
    # Edges are distinct and have both ends, so callers need not be told apart again.
    return call_edges(Warehouse(spark, sf)).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))


@query(
    "impact_of_function",
    oracle(_RESOLVED + """
, r as (select (select min(dst) from m_call_edges) as node union select src from r join m_call_edges on dst = node),
a as (select node from r where node <> (select min(dst) from m_call_edges))
select count(*) as functions, count(distinct split_part(node,'::',1)) as files,
  case when count(*) >= 15 then 'high' when count(*) >= 4 then 'medium' else 'low' end as severity from a"""),
)
def impact_of_function(spark, sf):
    from lithic.operators.impact import impact_of_function as impact

    w = Warehouse(spark, sf)
    edges = cut(call_edges(w))  # searched for the target, then walked
    target = edges.agg(F.min("dst")).first()[0]
    return impact(edges, w.functions, target).select("functions", "files", "severity")


_TREE = """
, tree as (select 'repo' as id, null as parent union all select 'r' || r_regionkey, 'repo' from region
 union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 'c' || c_custkey, 'n' || c_nationkey from customer),
heat as (select 'c' || o_custkey as id, max(o_totalprice) as heat from orders group by 1)
"""


def hierarchy(w: Warehouse):
    region, nation, customer = w.table("region"), w.table("nation"), w.table("customer")
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    root = w.spark.createDataFrame([("repo", None)], "id string, parent string")
    return (
        root.union(region.select(s("r", "r_regionkey"), F.lit("repo")))
        .union(nation.select(s("n", "n_nationkey"), s("r", "n_regionkey")))
        .union(customer.select(s("c", "c_custkey"), s("n", "c_nationkey")))
    )


@query(
    "container_heat",
    oracle(_TREE + """
, cl as (select id, id as ancestor, parent from tree union select cl.id, tree.id, tree.parent from cl join tree on tree.id = cl.parent)
select ancestor as id, max(heat) as heat from cl join heat using (id) where ancestor <> cl.id group by 1"""),
)
def container_heat(spark, sf):
    w = Warehouse(spark, sf)
    heat = w.table("orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id")).agg(F.max("o_totalprice").alias("heat"))
    return G.container_heat(G.ancestors(hierarchy(w)), heat)


@query(
    "edge_lifting",
    oracle(_TREE + """
, n0 as (select 'n' || c_nationkey as a, 'c' || c_custkey as id from customer),
e as (select n0.a as src, 'n' || s_nationkey as dst, case when l_returnflag = 'R' then 'reads' else 'uses' end as verb, count(*) n
  from lineitem join orders on l_orderkey = o_orderkey join n0 on n0.id = 'c' || o_custkey join supplier on s_suppkey = l_suppkey group by all),
rg as (select 'n' || n_nationkey as nn, 'r' || n_regionkey as rr from nation),
v as (select x.rr as src, y.rr as dst, verb, sum(n) n from e join rg x on x.nn = e.src join rg y on y.nn = e.dst where x.rr <> y.rr group by all)
select src, dst, cast(sum(n) as bigint) as weight, (arg_max(verb, n)) as verb from v group by src, dst"""),
)
def edge_lifting(spark, sf):
    """Customer to supplier-nation edges seen at the region level."""
    w = Warehouse(spark, sf)
    tree = hierarchy(w)
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = (
        w.table("lineitem")
        .join(w.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(w.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(
            s("c", "o_custkey").alias("src"), s("n", "s_nationkey").alias("dst"),
            F.when(F.col("l_returnflag") == "R", "reads").otherwise("uses").alias("verb"),
        )
        .agg(F.count("*").alias("n"))
    )
    visible = tree.filter(F.col("parent") == "repo").select("id")
    return G.lift_edges(edges, G.ancestors(tree), visible)


@query(
    "visible_frontier",
    oracle(_TREE + """select id from tree where parent = 'repo' and id <> 'r0' union select id from tree where parent = 'r0' and id not in (select 'n' || n_nationkey from nation where n_nationkey = 0)
 union select id from tree where parent = 'n0'"""),
)
def visible_frontier(spark, sf):
    tree = hierarchy(Warehouse(spark, sf))
    expanded = spark.createDataFrame([("repo",), ("r0",), ("n0",)], "id string")
    return G.visible_frontier(tree, expanded, spark.createDataFrame([("repo",)], "id string"))


@query(
    "neighbours",
    oracle("select src as id from m_part_edges where dst = 1 union select dst from m_part_edges where src = 1 union select 1::bigint"),
)
def neighbours(spark, sf):
    return G.neighbours(Warehouse(spark, sf).part_edges, spark.createDataFrame([(1,)], "id bigint"))
