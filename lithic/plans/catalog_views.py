"""Registered queries: versions, history, plugins, views."""

from pyspark.sql import functions as F

from lithic.operators import versioning as V
from lithic.operators import views as U
from lithic.operators.plugins import Registry
from lithic.plans.catalog_quality import layer_sql
from lithic.plans.catalog_source import infra_paths
from lithic.operators.scan import detect_infra
from lithic.plans.registry import query
from lithic.plans.warehouse import Warehouse, oracle
from lithic.session import cut



def two_versions(w: Warehouse):
    """Documents before and after: labelled-bad ones are new, Spanish ones gone, French ones edited."""
    docs = w.table("documents").join(w.table("labels").select("doc_id", "quality"), "doc_id", "left")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    before = docs.filter(F.coalesce("quality", F.lit(1)) != 0).select(path.alias("path"), F.col("text").alias("content"))
    after = docs.filter(F.col("lang") != "es").select(
        path.alias("path"), F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content")
    )
    return before, after


_TWO = """with d as (select source || '/' || doc_id as path, text, lang, coalesce(quality,1) q from documents left join labels using (doc_id)),
a as (select path, substr(sha1(text),1,16) h from d where q <> 0), b as (select path, substr(sha1(case when lang='fr' then text || '!' else text end),1,16) h from d where lang <> 'es'),
df as (select coalesce(a.path,b.path) as path, case when a.path is null then 'added' when b.path is null then 'deleted' when a.h <> b.h then 'modified' else 'unchanged' end as status from a full join b on a.path = b.path)
"""


@query("snapshot_diff", _TWO + "select * from df")
def snapshot_diff(spark, sf):
    before, after = two_versions(Warehouse(spark, sf))
    return V.diff_snapshots(V.snapshot(before), V.snapshot(after))


@query("snapshot_counts", _TWO + """select count(*) filter (status in ('added','modified')) as changed, count(*) filter (status='added') as added, count(*) filter (status='modified') as modified,
 count(*) filter (status='deleted') as deleted, count(*) filter (status='unchanged') as unchanged from df""")
def snapshot_counts(spark, sf):
    before, after = two_versions(Warehouse(spark, sf))
    return V.diff_counts(V.diff_snapshots(V.snapshot(before), V.snapshot(after)))


def version(w: Warehouse, first: int, last: int):
    """One version of the five compared entities, seen through the orders of a span of years."""
    o = w.table("orders").filter(F.year("o_orderdate").between(first, last))
    li = w.table("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    paths = w.paths
    return {
        "files": li.groupBy("l_partkey").agg(F.count("*").alias("functions"), F.sum(F.col("l_linenumber").cast("long")).alias("complexity"))
        .join(paths, F.col("l_partkey") == F.col("pk")).select("path", (F.col("p_size") * 20).cast("long").alias("loc"), "functions", "complexity"),
        "functions": li.join(paths, F.col("l_partkey") == F.col("pk")).groupBy(F.col("path").alias("file"), F.concat(F.lit("fn_"), F.col("l_suppkey").cast("string")).alias("name"))
        .agg(F.count("*").alias("complexity"), F.max(F.floor("l_quantity").cast("long")).alias("loc")),
        "routes": o.select(F.col("o_orderpriority").alias("method"), F.concat(F.lit("/c/"), F.col("o_custkey").cast("string")).alias("path")).distinct(),
        "tables": o.select(F.concat(F.lit("t_"), F.col("o_custkey").cast("string")).alias("name")).distinct(),
        "dependencies": li.groupBy(F.concat(F.lit("s_"), F.col("l_suppkey").cast("string")).alias("name")).agg(F.count("*").cast("string").alias("version")),
    }


def _version_sql(tag: str, span: str) -> str:
    return f"""
o{tag} as (select * from orders where year(o_orderdate) between {span}),
l{tag} as (select lineitem.* from lineitem join o{tag} on l_orderkey = o_orderkey),
fi{tag} as (select path as k, (p_size*20) || ',' || count(*) || ',' || sum(l_linenumber) as v from l{tag} join m_paths on l_partkey = pk group by path, p_size),
fn{tag} as (select path || ' fn_' || l_suppkey as k, count(*) || ',' || max(cast(floor(l_quantity) as bigint)) as v from l{tag} join m_paths on l_partkey = pk group by path, l_suppkey),
ro{tag} as (select distinct o_orderpriority || ' /c/' || o_custkey as k, null as v from o{tag}),
ta{tag} as (select distinct 't_' || o_custkey as k, null as v from o{tag}),
de{tag} as (select 's_' || l_suppkey as k, cast(count(*) as varchar) as v from l{tag} group by l_suppkey)"""


def _cmp(entity: str, t: str) -> str:
    return f"""select '{entity}' as entity, coalesce(a.k,b.k) as key, case when a.k is null then 'added' when b.k is null then 'removed' when a.v is distinct from b.v then 'changed' end as change,
 case when a.k is not null and b.k is not null and a.v is distinct from b.v then a.v || ' -> ' || b.v end as detail from {t}1 a full join {t}2 b on a.k = b.k"""


_CHANGES = "," + _version_sql("1", "1995 and 1998") + "," + _version_sql("2", "1996 and 2001") + """,
ch as (select * from (""" + " union all ".join(_cmp(e, t) for e, t in [("files", "fi"), ("functions", "fn"), ("routes", "ro"), ("tables", "ta"), ("dependencies", "de")]) + ") where change is not null)"


def changes(w: Warehouse):
    return V.compare_versions(version(w, 1995, 1998), version(w, 1996, 2001))


@query("version_compare", oracle(_CHANGES + " select * from ch"))
def version_compare(spark, sf):
    return changes(Warehouse(spark, sf))


@query("change_risk", oracle(_CHANGES + """, r as (select 2*count(*) filter (entity='routes' and change='added') + 3*count(*) filter (entity='routes' and change='removed') + count(*) filter (entity='functions' and change='removed')
 + 4*count(*) filter (entity='tables' and change='removed') + count(*) filter (entity='dependencies' and change='changed') + 2*count(*) filter (entity='files' and change='removed') as risk from ch)
 select risk, case when risk >= 20 then 'high' when risk >= 8 then 'medium' else 'low' end as risk_label from r"""))
def change_risk(spark, sf):
    return V.change_risk(changes(Warehouse(spark, sf)))


@query("diff_lanes", oracle(_CHANGES + """ select entity, key, change from ch where entity in ('routes','tables') and change in ('added','removed')
 union all select * from (select entity, key, change from ch where entity='files' and change='added' order by key limit 30)
 union all select * from (select entity, key, change from ch where entity='files' and change='removed' order by key limit 30)"""))
def diff_lanes(spark, sf):
    return V.diff_lanes(changes(Warehouse(spark, sf)))


@query("version_deltas", oracle(_CHANGES + """ select (select sum(cast(split_part(v,',',1) as bigint)) from fi2) - (select sum(cast(split_part(v,',',1) as bigint)) from fi1) as loc,
 (select count(*) from fi2) - (select count(*) from fi1) as files, (select count(*) from fn2) - (select count(*) from fn1) as functions, (select count(*) from ro2) - (select count(*) from ro1) as routes"""))
def version_deltas(spark, sf):
    w = Warehouse(spark, sf)
    return V.version_deltas(version(w, 1995, 1998), version(w, 1996, 2001))


@query("timeline_sample", """with e as (select event_id, ts, row_number() over (order by ts, event_id) - 1 as i, count(*) over () as n from events)
 select event_id, i from e where i % greatest(1, n // 24) = 0 or i = n - 1""")
def timeline_sample(spark, sf):
    return V.sample_evenly(Warehouse(spark, sf).table("events"), ["ts", "event_id"]).select("event_id", "i")


@query("timeline_counts", oracle("""
, t as (select o_orderdate as c, path from orders join lineitem on o_orderkey = l_orderkey join m_paths on pk = l_partkey)
select strftime(c, '%Y-%m') as commit, count(*) as files, count(*) filter (regexp_matches(path, '\\.(ts|tsx|js|jsx|py|go|rs|java|kt|rb|php|cs|c|cpp|swift|dart|scala)$')) as code,
 count(*) filter (regexp_matches(path, '/route\\.(ts|js|tsx|jsx)$|routes?\\.|controller|_controller|urls\\.py|routes\\.rb')) as routes,
 count(*) filter (regexp_matches(path, 'migration|schema\\.|\\.sql$|models?\\.')) as tables, count(*) filter (regexp_matches(path, '(^|/)tests/')) as tests,
 count(distinct regexp_extract(path, '(\\.[^.]*)$', 1)) as langs from t group by 1"""))
def timeline_counts(spark, sf):
    w = Warehouse(spark, sf)
    trees = (
        w.table("orders").join(w.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(w.paths, F.col("l_partkey") == F.col("pk"))
        .select(F.date_format("o_orderdate", "yyyy-MM").alias("commit"), "path")
    )
    return V.timeline_counts(trees)


@query("timeline_listing", oracle("""
, ch as (select strftime(l_shipdate, '%Y-%m') as commit, path, bool_and(l_returnflag = 'R') as deleted from lineitem join m_paths on pk = l_partkey group by 1, 2),
 cm as (select commit, row_number() over (order by commit) - 1 as i, count(*) over () as n from (select distinct commit from ch)),
 sm as (select commit from cm where i % greatest(1, n // 24) = 0 or i = n - 1),
 st as (select sm.commit, ch.path, arg_max(ch.deleted, ch.commit) as deleted from sm join ch on ch.commit <= sm.commit group by 1, 2), t as (select commit, path from st where not deleted)
select sm.commit, count(path) as files, count(*) filter (regexp_matches(path, '\\.(ts|tsx|js|jsx|py|go|rs|java|kt|rb|php|cs|c|cpp|swift|dart|scala)$')) as code,
 count(*) filter (regexp_matches(path, '/route\\.(ts|js|tsx|jsx)$|routes?\\.|controller|_controller|urls\\.py|routes\\.rb')) as routes,
 count(*) filter (regexp_matches(path, 'migration|schema\\.|\\.sql$|models?\\.')) as tables, count(*) filter (regexp_matches(path, '(^|/)tests/')) as tests,
 count(distinct regexp_extract(path, '(\\.[^.]*)$', 1)) as langs from sm left join t using (commit) group by 1"""))
def timeline_listing(spark, sf):
    """Counts of the tree at sampled commits; returned parts are deletions of their path."""
    w = Warehouse(spark, sf)
    changes = cut(w.table("lineitem").join(w.paths, F.col("l_partkey") == F.col("pk")).select(
        F.date_format("l_shipdate", "yyyy-MM").alias("commit"), "path", (F.col("l_returnflag") == "R").alias("deleted")
    ))
    return V.timeline_of(V.validity(changes), V.sample_evenly(changes.select("commit").distinct(), ["commit"]))


@query("churn", oracle("""
, c as (select event_id from events order by ts desc, event_id desc limit 400)
select path, count(*) as churn from events join c using (event_id) join m_paths on user_id = pk group by path"""))
def churn(spark, sf):
    w = Warehouse(spark, sf)
    e = w.table("events").select(F.col("event_id").alias("commit"), F.col("ts").alias("date"), "user_id")
    touched = e.join(w.paths, F.col("user_id") == F.col("pk")).select("commit", "path")
    return V.churn(touched, e.select("commit", "date"))


@query("percent_bars", "select cast(ts as date) as day, count(*) as n, cast(floor(count(*)*100.0::double/max(count(*)) over () + 0.5) as bigint) as percent from events group by 1")
def percent_bars(spark, sf):
    per_day = Warehouse(spark, sf).table("events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return V.percent_of_max(per_day, "n")


_PLUG = """
, inf as (select case s_nationkey % 5 when 0 then 'github-actions' when 1 then 'docker' when 2 then 'docker-compose' when 3 then 'terraform' else 'kubernetes' end as system from supplier)
"""


@query("plugin_insights", oracle(_PLUG + """
select 'infra' as plugin, 'infra-systems' as insight, system as label, count(*) as count from inf group by system
union all select 'security', 'security-findings', severity, count(*) from m_security group by severity
union all select 'deps', 'dep-ecosystems', ecosystem, count(*) from m_deps group by ecosystem"""))
def plugin_insights(spark, sf):
    w = Warehouse(spark, sf)
    catalog = {"infra": detect_infra(infra_paths(w)), "files": w.files, "security": w.security, "dependencies": w.dependencies}
    return Registry().run(spark, catalog).relations["insights"]


@query("plugin_tags", oracle("select distinct 'file:' || file as node, 'security:' || type as tag from m_security"))
def plugin_tags(spark, sf):
    w = Warehouse(spark, sf)
    return Registry().run(spark, {"files": w.files, "security": w.security}).relations["tags"]


@query("security_counts", oracle("select type, severity, count(*) as n from m_security group by all"))
def security_counts(spark, sf):
    return Warehouse(spark, sf).security.groupBy("type", "severity").agg(F.count("*").alias("n"))


@query("file_list", oracle("select path, loc from m_files where contains(path, 'pay') and lang = 'python' order by path limit 800"))
def file_list(spark, sf):
    return U.file_list(Warehouse(spark, sf).files, "pay", "python").select("path", "loc")


@query("function_list", oracle("select id from m_functions where contains(name,'entry_1') or contains(file,'entry_1') order by id limit 700"))
def function_list(spark, sf):
    return U.function_list(Warehouse(spark, sf).functions, "entry_1").select("id")


@query("route_list", oracle("select method, path, file, ord from m_routes where framework = 'spring' and (contains(lower(path),'cart') or contains(file,'cart'))"))
def route_list(spark, sf):
    return U.route_list(Warehouse(spark, sf).routes, "cart", "spring").select("method", "path", "file", "ord")


@query("dep_list", oracle("select name, version from m_deps where scope = 'runtime' and contains(name,'s')"))
def dep_list(spark, sf):
    return U.dependency_list(Warehouse(spark, sf).dependencies, "s", "runtime").select("name", "version")


@query("sorted_table", oracle("select path, loc from m_files order by loc desc, path limit 100"))
def sorted_table(spark, sf):
    return U.sort_table(Warehouse(spark, sf).files, "loc", True, ["path"], 100).select("path", "loc")


@query("file_detail", oracle("""
, t as (select min(path) as p from m_files)
select distinct 'imports' as section, resolved as item from m_imports, t where file = p union select 'imported by', file from m_imports, t where resolved = p
union select 'routes', method || ' ' || path from m_routes, t where file = p union select 'writes', "table" from m_dbw, t where file = p and is_write
union select 'reads', "table" from m_dbw, t where file = p and not is_write union select 'functions', name || '#' || line from m_functions, t where file = p"""))
def file_detail(spark, sf):
    w = Warehouse(spark, sf)
    first = w.files.agg(F.min("path")).first()[0]
    return U.file_detail(first, w.files, w.imports, w.routes, w.db_access, w.functions)


@query("layer_matrix", oracle(f"select source, target, count(*) as weight from (select {layer_sql('file')} as source, {layer_sql('resolved')} as target from m_imports) where source <> target group by all"))
def layer_matrix(spark, sf):
    return U.layer_matrix(Warehouse(spark, sf).imports)


@query("module_matrix", oracle("""select source, target, count(*) as weight from (select split_part(file,'/',1) || '/' || split_part(file,'/',2) as source,
 split_part(resolved,'/',1) || '/' || split_part(resolved,'/',2) as target from m_imports) where source <> target group by all"""))
def module_matrix(spark, sf):
    return U.module_matrix(Warehouse(spark, sf).imports)


@query("co_access_pairs", oracle("""
, d as (select distinct file, "table" as t from m_db), f as (select * from (select *, row_number() over (partition by file order by t) r from d) where r <= 8)
select distinct x.t as a, y.t as b from f x join f y on x.file = y.file and x.t < y.t order by a, b limit 400"""))
def co_access_pairs(spark, sf):
    return U.co_access_pairs(Warehouse(spark, sf).db_access)


@query("dependency_graph", oracle("""
, en as (select file as id from m_imports union all select resolved from m_imports), tp as (select id from en group by id order by count(*) desc, id limit 300)
select distinct file as source, resolved as target from m_imports where file <> resolved and file in (from tp) and resolved in (from tp) order by source, target limit 900"""))
def dependency_graph(spark, sf):
    return U.dependency_graph(Warehouse(spark, sf).imports)


@query("flow_steps", "select a.conv_id, a.turn as prev, b.turn as next from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1")
def flow_steps(spark, sf):
    return U.next_links(Warehouse(spark, sf).table("conversations"), "conv_id", "turn").withColumnRenamed("conv", "conv_id")


@query("nearest_line_attach", """with s as (select conv_id, turn from conversations where role = 'assistant'), u as (select conv_id, turn from conversations where role = 'user')
 select s.conv_id, s.turn, coalesce(max(u.turn) filter (u.turn = s.turn), max(u.turn)) as near from s join u on u.conv_id = s.conv_id and abs(u.turn - s.turn) <= 6 group by all""")
def nearest_line_attach(spark, sf):
    from lithic.operators.deep import attach_nearest

    c = Warehouse(spark, sf).table("conversations").select("conv_id", "turn", "role")
    return attach_nearest(
        c.filter("role = 'assistant'").select("conv_id", "turn"), c.filter("role = 'user'").select("conv_id", F.col("turn").alias("near")),
        ["conv_id"], "turn", "near", 6,
    )
