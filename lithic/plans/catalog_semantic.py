"""Registered queries: domains, hierarchy, flows, capabilities, systems, product views, questions."""

from pyspark.sql import functions as F

from lithic.functions import taxonomy as T
from lithic.operators import capability as C
from lithic.operators import flows as FL
from lithic.operators import intent as I
from lithic.operators import quality as Q
from lithic.operators import semantic as S
from lithic.operators import views as U
from lithic.operators.relations import dedupe_routes
from lithic.plans.catalog_graph import _RESOLVED, call_edges
from lithic.plans.catalog_quality import _CENTRAL, layer_sql
from lithic.plans.registry import query
from lithic.plans.warehouse import Warehouse, oracle
from lithic.session import cut

_MOD = "split_part({p},'/',1) || '/' || split_part({p},'/',2)"


def mod(p: str) -> str:
    return _MOD.replace("{p}", p)


_DOM = f"""
, kw as (select {mod('path')} as dir, split_part(split_part(path,'/',3),'_',1) as word, count(*) n from m_files group by all),
dbase as (select {mod('path')} as dir, count(*) file_count, cast(sum(functions) as bigint) function_count, cast(sum(loc) as bigint) loc from m_files group by 1),
rdup as (select distinct method, path, file from m_routes),
dr as (select {mod('file')} as dir, count(*) routes from rdup group by 1), dt as (select {mod('file')} as dir, count(distinct "table") tables from m_db group by 1),
dk as (select dir, array_to_string(list(word order by n desc, word)[1:3], ',') as keywords,
   list(word order by n desc, word) filter (n >= greatest(2, file_count*0.34)) as strong from kw join dbase using (dir) group by dir),
m_domains as (select 'dom:' || dir as id, dir, case when len(strong) > 0 and split_part(dir,'/',2) not in ('config','core')
   then upper(strong[1][1]) || strong[1][2:] || coalesce(' / ' || upper(strong[2][1]) || strong[2][2:], '') || ' (' || split_part(dir,'/',2) || ')'
   else upper(split_part(dir,'/',2)[1]) || split_part(dir,'/',2)[2:] end as label,
   case when len(strong) > 0 then 'business' else 'technical' end as kind, keywords, file_count, function_count, loc, coalesce(routes,0) as routes, coalesce(tables,0) as tables
  from dbase left join dk using (dir) left join dr using (dir) left join dt using (dir))
"""


def domains_of(w: Warehouse):
    return S.domains(w.files, w.routes.select("method", "path", "file").distinct(), w.db_access)


@query("domain_cluster", oracle(_DOM + "select * from m_domains"))
def domain_cluster(spark, sf):
    return domains_of(Warehouse(spark, sf)).withColumn("keywords", F.array_join("keywords", ","))


@query("subsystems", oracle(f"""
, l as (select {layer_sql('path')} as layer, path, row_number() over (partition by {layer_sql('path')} order by path) r from m_files)
select layer, count(*) as files, string_agg(path, ',' order by path) filter (r <= 6) as sample from l group by layer"""))
def subsystems(spark, sf):
    return S.subsystems(Warehouse(spark, sf).files).withColumn("sample", F.array_join("sample", ","))


@query("core_components", oracle(_CENTRAL + "select 'hub' as role, path from (select path from central order by score desc, path limit 8)"))
def core_components(spark, sf):
    w = Warehouse(spark, sf)
    return S.core_components(w.files, Q.centrality(w.files, w.imports))


@query("learning_path", oracle(_DOM + """
, p as (select *, lower(dir) d, lower(label || ' ' || dir) b from m_domains),
q as (select *, case when regexp_matches(d,'(^|/)(config|configs)($|/)') then 0 when regexp_matches(d,'(^|/)(core|lib|common|shared|util|utils)($|/)') then 1 when regexp_matches(b,'auth|login|session|security|permission') then 2
  when regexp_matches(b,'model|entity|schema') then 3 when regexp_matches(b,'api|route|controller|handler|server') then 4 when regexp_matches(d,'(^|/)tests($|/)') then 9 when regexp_matches(d,'(^|/)components($|/)') then 8 else 5 end as priority from p),
t as (select *, row_number() over (order by priority, loc desc, id) as "order" from q)
select "order", id, label, priority, floor(least((select sum(loc) from m_files)/220 + 12*4, 600) + 0.5) as minutes from t where "order" <= 12"""))
def learning_path(spark, sf):
    w = Warehouse(spark, sf)
    return S.learning_path(domains_of(w), w.files.agg(F.sum("loc")).scalar())


_DEDGE = f"""
, de as (select 'dom:' || {mod('file')} as source, 'dom:' || {mod('resolved')} as target, 'imports' as t from m_imports
 union all select 'dom:' || {mod("split_part(src,'::',1)")}, 'dom:' || {mod("split_part(dst,'::',1)")}, 'calls' from m_call_edges
 union all select 'dom:' || {mod('file')}, 'table:' || "table", case when is_write then 'writes' else 'reads' end from m_dbw),
dg as (select source, target, count(*) as count, count(*) filter (t='imports') as imports, count(*) filter (t='calls') as calls, count(*) filter (t='reads') as reads, count(*) filter (t='writes') as writes
 from de where source <> target group by all),
m_dedges as (select source, target, case when starts_with(target,'table:') and writes > 0 then 'persists' when starts_with(target,'table:') then 'reads' when calls > 0 and imports > 0 then 'uses' when calls > 0 then 'calls' else 'depends on' end as verb,
 count, imports, calls, reads, writes from dg)
"""


@query("domain_edges", oracle(_RESOLVED + _DEDGE + "select * from m_dedges"))
def domain_edges(spark, sf):
    w = Warehouse(spark, sf)
    return S.domain_edges(w.imports, call_edges(w), w.functions, w.db_access)


@query("domain_layers", oracle(_DOM + """
, x as (select id, lower(label || ' ' || dir) b, routes, tables from m_domains)
select id, layer from (select id, unnest(list_filter(['business', case when routes > 0 then 'api' end, case when tables > 0 then 'data' end, case when tables > 0 then 'database' end,
 case when regexp_matches(b,'auth|login|permission|security|token|session') then 'security' end, case when regexp_matches(b,'test|spec|mock') then 'testing' end,
 case when regexp_matches(b,'config|infra|deploy|docker|ci|worker|job|queue|cache|redis') then 'infrastructure' end, 'technical'], lambda v: v is not null)) as layer from x)"""))
def domain_layers(spark, sf):
    return S.domain_layers(domains_of(Warehouse(spark, sf)))


@query("semantic_hierarchy", oracle("""
, fr as (select *, row_number() over (partition by file order by line, name) r from m_functions)
select 'repo' as kind, 1::bigint as n union all select 'domain', count(distinct split_part(path,'/',1) || '/' || split_part(path,'/',2)) from m_files
 union all select 'module', count(distinct split_part(path,'/',1) || '/' || split_part(path,'/',2)) from m_files union all select 'file', count(*) from m_files
 union all select 'function', count(*) from fr where r <= 60 union all select 'table', count(distinct "table") from m_db"""))
def semantic_hierarchy(spark, sf):
    w = Warehouse(spark, sf)
    classes = w.functions.limit(0)
    tables = w.db_access.select(F.col("table").alias("name")).distinct()
    h = S.hierarchy(w.files, domains_of(w), classes, w.functions, tables)
    return h.groupBy("kind").agg(F.count("*").alias("n"))


@query("property_graph", oracle(_RESOLVED + """
select 'node' as part, 'file' as type, count(*) as n from m_files union all select 'node', 'function', count(*) from m_functions union all select 'node', 'table', count(distinct "table") from m_db
 union all select 'node', 'route', count(*) from (select distinct method, path, file from m_routes) union all select 'node', 'dependency', count(distinct name) from m_deps union all select 'node', 'env', count(distinct name) from m_env
 union all select 'edge', 'imports', count(*) from m_imports union all select 'edge', 'contains', count(*) from m_functions union all select 'edge', 'calls', count(*) from m_call_edges
 union all select 'edge', case when is_write then 'writes' else 'reads' end, count(*) from m_dbw group by is_write union all select 'edge', 'exposes', count(*) from (select distinct method, path, file from m_routes)
 union all select 'edge', 'uses', count(*) from (select distinct file, name from m_env)"""))
def property_graph(spark, sf):
    w = Warehouse(spark, sf)
    nodes, edges = S.property_graph(w.files, w.functions, w.functions.limit(0), w.imports, cut(call_edges(w)), w.db_access, w.routes, w.dependencies, w.env)
    return cut(nodes.groupBy(F.lit("node").alias("part"), "type").agg(F.count("*").alias("n"))).unionByName(
        edges.groupBy(F.lit("edge").alias("part"), "type").agg(F.count("*").alias("n"))
    )


@query("special_layers", oracle("""
select 'file:' || file as id, 'security' as layer from m_security union select 'file:' || file, 'infrastructure' from m_jobs
 union select 'file:' || path, 'performance' from m_files where floor(complexity/greatest((select max(complexity) from m_files),1)*10000+0.5)/10000 > 0.6
 union select 'file:' || path, 'testing' from m_files where contains(path,'/tests/')"""))
def special_layers(spark, sf):
    w = Warehouse(spark, sf)
    return S.special_layers(w.files, Q.heat(w.files, w.imports), w.security, w.jobs)


@query("intent_views", oracle(_DOM + _CENTRAL + f"""
, t as (select *, lower(label || ' ' || dir) b from m_domains)
select 'auth' as intent, id as node from t where regexp_matches(b,'auth|login|session|permission|token|oauth|security') union select 'notif', id from t where regexp_matches(b,'notif|email|mail|sms|push|message')
 union select 'frontend', id from t where regexp_matches(b,'ui|component|view|page|frontend|client|web') union select 'infra', id from t where regexp_matches(b,'config|infra|deploy|docker|ci|worker|queue|cache|redis')
 union select case when is_write then 'db' else 'db-read' end, 'dom:' || {mod('file')} from m_dbw union select 'api', id from t where routes > 0 union select 'backend', id from t where routes > 0 or tables > 0
 union select 'jobs', 'dom:' || {mod('file')} from m_jobs union select 'security', 'dom:' || {mod('file')} from m_security union select 'security', id from t where regexp_matches(b,'auth|login|permission|security')
 union select 'critical', 'file:' || path from (select path from central order by score desc, path limit 12)"""))
def intent_views(spark, sf):
    w = Warehouse(spark, sf)
    return S.intents(domains_of(w), w.db_access, w.jobs, w.security, Q.centrality(w.files, w.imports))


_FLOWS = """
, ff as (select * from (select *, row_number() over (partition by file order by ord) r, count(*) over (partition by file) n from m_routes) where r = 1),
fname as (select upper(split_part(path,'/',3)[1]) || split_part(path,'/',3)[2:] as name, file, n, ord from ff),
fl as (select 'route:' || name as flow, name, 'api' as kind, file as entry, n as n_routes from (select *, row_number() over (partition by name order by ord) r2 from fname) where r2 = 1),
se as (select a.path as src, b.path as dst from m_succ join m_paths a on a.pk = src join m_paths b on b.pk = dst),
r as (select flow, entry as node from fl union select flow, dst from r join se on src = node),
wt as (select distinct file, "table" from m_dbw where is_write)
"""


def flow_inputs(w: Warehouse):
    """One function per file that calls the file's most frequent target."""
    fns = w.files.select(F.concat("path", F.lit("::run#1")).alias("id"), F.col("path").alias("file"))
    p, q = w.paths.select(F.col("pk").alias("src"), F.col("path").alias("a")), w.paths.select(F.col("pk").alias("dst"), F.col("path").alias("b"))
    calls = w.succ.join(p, "src").join(q, "dst").select(F.concat("a", F.lit("::run#1")).alias("src"), F.concat("b", F.lit("::run#1")).alias("dst"))
    return fns, calls


@query("flow_inference", oracle(_FLOWS + """
select flow, name, kind, entry, n_routes, (select count(*) from r where r.flow = fl.flow) as function_count, (select count(distinct "table") from r join wt on wt.file = node where r.flow = fl.flow) as tables_written
 from fl order by function_count desc, flow limit 30"""))
def flow_inference(spark, sf):
    w = Warehouse(spark, sf)
    fns, calls = flow_inputs(w)
    return FL.infer_flows(w.files, fns, calls, w.routes, w.db_access)[0]


@query("flow_step_files", oracle(_FLOWS + """
, rd as (select flow, entry as node, 0 as depth from fl union select flow, dst, depth + 1 from rd join se on src = node where depth < 120),
d as (select flow, node, min(depth) depth from rd group by all),
s as (select flow, node as ref, row_number() over (partition by flow order by depth, node) i from d where node <> (select entry from fl where fl.flow = d.flow))
select flow, i, string_split(ref,'/')[-1] as label, ref from s where i <= 8 union all select flow, 0, string_split(entry,'/')[-1], entry from fl"""))
def flow_step_files(spark, sf):
    w = Warehouse(spark, sf)
    fns, calls = flow_inputs(w)
    return FL.infer_flows(w.files, fns, calls, w.routes, w.db_access)[1]


@query("flow_mermaid")
def flow_mermaid(spark, sf):
    w = Warehouse(spark, sf)
    fns, calls = flow_inputs(w)
    return U.flow_mermaid(FL.infer_flows(w.files, fns, calls, w.routes, w.db_access)[1])


@query("keyword_flow_seeds", oracle("""
, k as (select path, split_part(split_part(path,'/',3),'_',1) as word from m_files where functions > 0)
select 'kw:' || word as flow, upper(word[1]) || word[2:] as name, 'domain' as kind, min(path) over (partition by word) as entry, path as file from k
 where word not in ('dashboard','cache')"""))
def keyword_flow_seeds(spark, sf):
    return FL.keyword_flow_seeds(Warehouse(spark, sf).files)


def _values() -> str:
    rows = [f"('{c.id}','{s}','{w.lower()}')" for c in T.built_in() for s in T.SIGNALS for w in c.needles[s]]
    return ",".join(rows)


def _meta() -> str:
    esc = lambda s: s.replace("'", "''")
    return ",".join(f"('{c.id}','{esc(c.label)}','{c.kind}',{T.KIND_RANK[c.kind]},{i},'{esc(c.why)}',{len(c.users)})" for i, c in enumerate(T.built_in()))


_TESTP = "regexp_matches(lower({f}), '(^|/)(tests?|specs?|__tests__|e2e|fixtures?|examples?|mocks?|benchmarks?)(/|$)|\\.(test|spec)\\.|_test\\.|test_')"
_CAPS = f"""
, needle(cap, signal, word) as (values {_values()}), meta(cap, label, kind, kind_rank, ord, why, users) as (values {_meta()}),
ftok as (select path, unnest(list_distinct(list_concat(list_filter(string_split_regex(regexp_replace(lower(string_split(path,'/')[-1]), '\\.[^./]+$', ''), '[/_\\-.]+'), lambda t: t <> ''), string_split(lower(path),'/')))) as tok from m_files),
e0 as (
 select cap, 'name' as signal, path as item, path as file, count(distinct word) as hits from ftok join needle on signal = 'name' and word = tok group by cap, path
 union all select cap, 'symbol', name, file, count(*) from (select distinct name, file from m_functions) join needle on signal = 'symbol' and contains(lower(name), word) group by cap, name, file
 union all select cap, 'route', method || ' ' || path, file, count(*) from (select distinct method, path, file from m_routes) join needle on signal = 'route' and contains(lower(path), word) group by cap, method, path, file
 union all select cap, 'table', t, null, count(*) from (select distinct "table" t from m_db) join needle on signal = 'table' and contains(lower(t), word) group by cap, t
 union all select cap, 'dep', name, null, count(*) from (select distinct name from m_deps) join needle on signal = 'dep' and contains(lower(name), word) group by cap, name
 union all select cap, 'env', name, null, count(*) from (select distinct name from m_env) join needle on signal = 'env' and contains(lower(name), word) group by cap, name),
m_ev as materialized (select *, coalesce({_TESTP.replace('{f}','file')}, false) as is_test from e0),
ep as (select *, (case signal when 'name' then 3000*least(hits,2) when 'route' then 2500 when 'table' then 2500 when 'dep' then 3500 when 'symbol' then 1200 else 1500 end) as pts from m_ev),
m_points as (select cap, signal, item, file, hits, is_test, cast(case when is_test then floor(pts*0.15::double+0.5) else pts end as bigint) as points from ep),
m_evf as materialized (select cap, file, is_test from m_ev where file is not null union select cap, d.file, {_TESTP.replace('{f}','d.file')} from m_ev join m_db d on signal = 'table' and item = d."table"),
pc as (select cap, sum(points)/1000::double as sc, count(*) filter (signal='route' and not is_test) as routes, count(*) filter (signal='table') as tables, count(*) filter (signal='dep') as deps,
  count(*) filter (signal='symbol' and not is_test) as symbols, count(*) filter (signal='env') as env from m_points group by cap),
sp as (select cap, count(*) filter (not is_test) as impl, count(*) as af from m_evf group by cap),
szz as (select f.cap, count(*) as file_count, cast(coalesce(sum(loc),0) as bigint) as loc from m_evf f join sp using (cap) left join m_files on path = file where impl = 0 or not is_test group by f.cap),
cj as (select pc.*, coalesce(impl,0) impl, coalesce(af,0) af, coalesce(file_count,0) file_count, coalesce(loc,0) loc from pc left join sp using (cap) left join szz using (cap)),
ck as (select *, (routes>0)::int + (tables>0)::int + (deps>0)::int + (symbols>0)::int + (env>0)::int + (impl>0)::int as signals from cj),
cl as (select *, least(0.98::double, (1-exp(-sc/9))*0.7::double + (case when deps>0 then 0.25::double else 0 end) + (case when tables>0 then 0.12::double else 0 end) + (case when routes>0 then 0.12::double else 0 end)
  + (case when signals>=3 then 0.15::double else 0 end)) as c0 from ck where sc > 0 and impl+routes+tables+deps >= 2 and (impl > 0 or deps > 0)),
cm as (select *, case when signals < 2 then least(c0, 0.4::double) else c0 end as c1 from cl),
cn as (select *, case when coalesce(impl/nullif(af,0),1) < 0.34 then least(c1,0.45::double) else c1 end as c2 from cm),
m_caps as materialized (select cap as id, label, kind, kind_rank, ord, why, users, floor(c2*100.0::double+0.5)/100.0::double as confidence,
  case when c2 >= 0.75 then 'confident' when c2 >= 0.5 then 'likely' when c2 >= 0.28 then 'possibly' else 'low' end as confidence_label, floor(sc*10.0::double+0.5)/10.0::double as score,
  signals, file_count, routes, tables, deps, symbols, env, loc from cn join meta using (cap))
"""
_OWN = """
, m_own as materialized (select file, cap as owner from (select file, cap, row_number() over (partition by file order by kind_rank - confidence, kind_rank, confidence desc, ord) r from m_evf join m_caps on id = cap) where r = 1),
sl as (select a.owner as source, b.owner as target, 'imports' as t, count(*) n from m_imports i join m_own a on a.file = i.file join m_own b on b.file = i.resolved where a.owner <> b.owner group by all
 union all select a.owner, b.owner, 'calls', count(*) from m_call_edges c join m_own a on a.file = split_part(c.src,'::',1) join m_own b on b.file = split_part(c.dst,'::',1) where a.owner <> b.owner group by all
 union all select r.owner, w.owner, 'reads', count(*) from (select distinct "table" t, owner from m_dbw join m_own using (file) where not is_write) r join (select distinct "table" t, owner from m_dbw join m_own using (file) where is_write) w using (t) where r.owner <> w.owner group by all),
sg as (select source, target, cast(sum(n) as bigint) as strength, cast(coalesce(sum(n) filter (t='imports'),0) as bigint) as imports, cast(coalesce(sum(n) filter (t='calls'),0) as bigint) as calls, cast(coalesce(sum(n) filter (t='reads'),0) as bigint) as reads from sl group by all),
m_sedges as materialized (select * from sg where strength >= 2 or reads > 0)
"""
TAX = T.built_in()


class Systems:
    """Evidence and capabilities of the mapped tables, cut once because several views read them."""

    def __init__(self, w: Warehouse):
        self.w = w
        classes = w.functions.select("name", "file").limit(0)
        self.ev = cut(C.evidence(w.sizes, w.functions, classes, w.routes, w.db_access, w.dependencies, w.env, TAX))
        self.files = cut(C.evidence_files(self.ev, w.db_access))
        self.caps = cut(C.capabilities(self.ev, self.files, w.sizes, TAX))

    def edges(self):
        w = self.w
        return cut(C.system_edges(self.caps, C.owners(self.caps, self.files), w.imports, call_edges(w), w.functions, w.db_access))


@query("capability_evidence", oracle(_CAPS + "select cap, signal, count(*) as items, cast(sum(points) as bigint) as points from m_points group by all"))
def capability_evidence(spark, sf):
    w = Warehouse(spark, sf)
    ev = C.evidence(w.sizes, w.functions, w.functions.select("name", "file").limit(0), w.routes, w.db_access, w.dependencies, w.env, TAX)
    return ev.groupBy("cap", "signal").agg(F.count("*").alias("items"), F.sum("points").alias("points"))


@query("capabilities", oracle(_CAPS + "select id, label, kind, confidence, confidence_label, score, signals, file_count, routes, tables, deps, symbols, env, loc from m_caps"))
def capabilities(spark, sf):
    return Systems(Warehouse(spark, sf)).caps.drop("kind_rank", "ord", "why", "users")


def _first(name: str, rows: str, n: int) -> str:
    return f"(select string_agg(item, '|' order by item) from (select item from (select distinct item from {rows}) order by item limit {n})) as {name}"


@query("capability_evidence_lists", oracle(_CAPS + "select id, " + ", ".join([
    _first("files", "(select f.file as item from m_evf f join sp on sp.cap = f.cap where f.cap = m_caps.id and (impl = 0 or not is_test))", 60),
    *(_first(name, f"(select p.item from m_points p where p.cap = m_caps.id and p.signal = '{signal}' and not is_test)", n)
      for name, signal, n in (("routes", "route", 20), ("tables", "table", 20), ("deps", "dep", 20), ("symbols", "symbol", 24), ("env", "env", 12))),
]) + " from m_caps"))
def capability_evidence_lists(spark, sf):
    s = Systems(Warehouse(spark, sf))
    lists = C.evidence_lists(s.caps, s.ev, s.files)
    text = lambda c: F.when(F.size(c) > 0, F.array_join(c, "|")).alias(c)
    return lists.select("id", *map(text, C.LISTED))


@query("capability_kinds", oracle(_CAPS + """select kind, count(*) as capabilities, count(*) filter (confidence >= 0.75) as confident,
 count(*) filter (confidence >= 0.75) / count(*)::double as confident_share from m_caps group by kind"""))
def capability_kinds(spark, sf):
    return C.kinds(Systems(Warehouse(spark, sf)).caps)


@query("owner_argmin", oracle(_CAPS + _RESOLVED + _OWN + "select file, owner from m_own"))
def owner_argmin(spark, sf):
    s = Systems(Warehouse(spark, sf))
    return C.owners(s.caps, s.files)


@query("system_edges", oracle(_CAPS + _RESOLVED + _OWN + "select source, target, strength, imports, calls, reads from m_sedges"))
def system_edges(spark, sf):
    return Systems(Warehouse(spark, sf)).edges().select("source", "target", "strength", "imports", "calls", "reads")


@query("system_spine", oracle(_CAPS + _RESOLVED + _OWN + """
, b as (select * from m_caps where kind = 'business'), i as (select target as id, count(*) n from m_sedges where source in (select id from b) and target in (select id from b) group by 1)
select row_number() over (order by coalesce(n,0), confidence desc, ord) as position, id, label, coalesce(n,0) as indegree from b left join i using (id)"""))
def system_spine(spark, sf):
    s = Systems(Warehouse(spark, sf))
    return C.spine(s.caps, s.edges())


@query("system_degree", oracle(_CAPS + _RESOLVED + _OWN + "select id, cast(sum(strength) as bigint) as degree from (select source as id, strength from m_sedges union all select target, strength from m_sedges) group by id"))
def system_degree(spark, sf):
    return C.degree(Systems(Warehouse(spark, sf)).edges())


_JOURNEY = ",".join(f"('{j}','{l}','{p}','{s}',{len(st)})" for j, l, p, st in T.JOURNEYS for s in st)


@query("journeys", oracle(_CAPS + f"""
, st(journey, label, persona, id, total) as (values {_JOURNEY})
select journey as id, st.label, persona, count(*) as steps, floor(count(*)/total*100+0.5) as coverage, floor(cast(sum(round(confidence*100)) as bigint)/count(*)/100*100.0::double+0.5)/100.0::double as confidence
 from st join m_caps using (id) where confidence >= 0.28 group by journey, st.label, persona, total having count(*) >= 2"""))
def journeys(spark, sf):
    return C.journeys(Systems(Warehouse(spark, sf)).caps)


@query("system_stories", oracle(_CAPS + _RESOLVED + _OWN + """
select id, label, least((select count(*) from m_sedges where source = id),6) as dependencies, least((select count(*) from m_sedges where target = id),6) as consumers from m_caps where confidence >= 0.4 and kind in ('business','integration','infrastructure')"""))
def system_stories(spark, sf):
    w = Warehouse(spark, sf)
    s = Systems(w)
    risk = Q.risk(Q.centrality(w.files, w.imports))
    return C.stories(s.caps, s.edges(), s.files, risk).select("id", "label", "dependencies", "consumers")


@query("capability_map", oracle(_CAPS + """
, im as (select cap, string_split(file,'/')[-2] as dir, loc from m_evf join m_caps on id = cap left join (select path, loc as l2 from m_files) on path = file
   where confidence >= 0.28 and not regexp_matches(lower(file), '(^|/)(tests?|specs?|__tests__|e2e|fixtures?|mocks?)(/|$)|\\.(test|spec)\\.|_test\\.|test_')),
im2 as (select cap, string_split(file,'/')[-2] as dir, f.loc from m_evf join m_caps on id = cap left join m_files f on path = file
   where confidence >= 0.28 and not regexp_matches(lower(file), '(^|/)(tests?|specs?|__tests__|e2e|fixtures?|mocks?)(/|$)|\\.(test|spec)\\.|_test\\.|test_')),
g as (select cap as id, dir, count(*) as files, cast(coalesce(sum(loc),0) as bigint) as loc from im2 group by all)
select * from (select *, row_number() over (partition by id order by files desc, dir) as rank from g) where rank <= 8"""))
def capability_map(spark, sf):
    w = Warehouse(spark, sf)
    s = Systems(w)
    return C.capability_map(s.caps, s.files, w.sizes)


@query("product_overview", oracle(_CAPS + """
select case when (select count(*) from m_routes) > 0 and (select count(*) from m_db) > 0 then 'full-stack web application' end as product_type, 0.7::double as type_confidence,
 count(*) filter (kind='business' and confidence >= 0.5) as core, count(*) filter (kind='integration' and confidence >= 0.5) as integrations,
 floor(least(0.9::double, count(*) filter (kind='business' and confidence >= 0.5)*0.08::double + 0.4::double)*100.0::double+0.5)/100.0::double as confidence from m_caps"""))
def product_overview(spark, sf):
    w = Warehouse(spark, sf)
    n = lambda df: df.agg(F.count("*")).scalar()
    p = C.product_overview(Systems(w).caps, w.sizes, n(w.routes), n(w.db_access))
    return p.select("product_type", "type_confidence", "core", "integrations", "confidence")


@query("product_scorecard")
def product_scorecard(spark, sf):
    from lithic.plans.catalog_quality import summary_of

    w = Warehouse(spark, sf).keep("files", "functions", "imports", "db_access")
    s = Systems(w)
    health = cut(Q.health(w.files, w.functions, w.imports, w.security, cut(summary_of(w))))
    return C.scorecard(s.caps, s.edges(), s.files, health, w.files.agg(F.count("*")).scalar())


@query("guided_tour", oracle(_CAPS + _RESOLVED + _OWN + """
, dg as (select id, sum(strength) as d from (select source as id, strength from m_sedges union all select target, strength from m_sedges) group by id),
rk as (select m_caps.*, cast(coalesce(d,0) as bigint) as degree, case when kind='cross-cutting' and contains(id,'config') then 0 when kind='infrastructure' then 1 when id='auth' then 2 when id='data-access' then 3 when kind='business' then 4
  when kind='integration' then 6 when kind='technical' then 7 else 5 end as learn from m_caps left join dg using (id) where confidence >= 0.4),
o as (select row_number() over (order by learn, degree desc, confidence desc, ord) as "order", id, label, degree from rk)
select "order", id, label, degree, floor(least((select sum(loc) from m_files)/300 + (select count(*) from o where "order" <= 12)*3.5::double, 90)+0.5) as minutes from o where "order" <= 12"""))
def guided_tour(spark, sf):
    w = Warehouse(spark, sf)
    s = Systems(w)
    return C.tour(s.caps, s.edges(), w.sizes.agg(F.sum("loc")).scalar())


@query("lens_systems", oracle(_CAPS + "select id, kind from m_caps where routes > 0"))
def lens_systems(spark, sf):
    return U.lens(Systems(Warehouse(spark, sf)).caps, "api").select("id", "kind")


_QUESTION = "where are payment orders saved to the cart"


@query("question_target", oracle(_CAPS + """
, terms(t) as (values ('payment'),('orders'),('saved'),('cart')),
h as (select id, t from m_caps, terms where contains(lower(label || ' ' || id || ' ' || why), t) union select cap, t from m_ev, terms where signal in ('dep','symbol') and contains(lower(item), t)),
b as (select cap as id, 3*count(*) as b from needle join terms on word = t where signal in ('name','symbol','route','table','dep') group by 1),
s as (select m_caps.id, ord, coalesce((select 2*count(*) from h where h.id = m_caps.id),0) + coalesce(b,0) as score from m_caps left join b using (id))
select id, score from s where score > 0"""))
def question_target(spark, sf):
    s = Systems(Warehouse(spark, sf))
    return I.target_scores(s.caps, s.ev, TAX, _QUESTION).select("id", "score")


@query("question_evidence", oracle("""
, s as (select distinct "table" t, file from m_dbw where is_write and (regexp_matches("table", 'payment|orders|saved|cart') or regexp_matches(file, 'payment|orders|saved|cart')))
select * from (select 'file' as kind, p as item from (select path p from m_files where regexp_matches(path,'payment|orders|saved|cart') union select file from s) order by p limit 24)
 union all select * from (select distinct 'table', t from (select "table" t from m_db where regexp_matches("table",'payment|orders|saved|cart') union select t from s) order by t limit 24)
 union all select * from (select distinct 'route', method || ' ' || path as i from m_routes where regexp_matches(path,'payment|orders|saved|cart') order by i limit 24)"""))
def question_evidence(spark, sf):
    w = Warehouse(spark, sf)
    return I.question_evidence(w.files, w.functions, w.routes, w.db_access, _QUESTION)


@query("command_map", oracle(_CAPS + "select id, label, kind from m_caps where id in (select cap from m_ev where signal='dep' and contains(item,'stripe')) or id in (select cap from m_evf where contains(file,'stripe'))"))
def command_map(spark, sf):
    s = Systems(Warehouse(spark, sf))
    return I.map_systems(s.caps, s.ev, s.files, "show me everything touching stripe")


@query("question_ops", """
select role, case when regexp_matches(q,'where.*(write|save|store|insert|persist)|written to|writes? to|store data') then 'db-write' when regexp_matches(q,'where.*(read|fetch|load|query)|reads? from') then 'db-read'
 when regexp_matches(q,'how.*(auth|login|sign)') then 'auth' when regexp_matches(q,'where.*(calcul|comput|generat)') then 'compute' when regexp_matches(q,'how.*(email|notif|sms|sent|send)') then 'notify'
 when regexp_matches(q,'how.*(cache|caching)') then 'cache' when regexp_matches(q,'external|third.?party|integrat|api call') then 'integration' when regexp_matches(q,'touch|use|using|depend') then 'uses'
 when regexp_matches(q,'security|secure|vulnerab|permission') then 'security' when regexp_matches(q,'performance|slow|bottleneck|hot path') then 'performance' else 'general' end as op, count(*) as n
 from (select role, lower(text) q from conversations) group by all""")
def question_ops(spark, sf):
    from lithic.functions.rules import question_op

    return Warehouse(spark, sf).table("conversations").groupBy("role", question_op(F.col("text")).alias("op")).agg(F.count("*").alias("n"))


@query("context_neighbours", oracle(_CENTRAL + """
, sd as (select path as seed from central order by score desc, path limit 6), lk as (select distinct file as a, resolved as b from m_imports where file <> resolved),
n as (select seed, 'imports' as relation, b as neighbour from sd join lk on a = seed union all select seed, 'imported by', a from sd join lk on b = seed),
r as (select *, row_number() over (partition by seed, relation order by neighbour) rn from n)
select seed, relation, neighbour from r where rn <= case relation when 'imports' then 4 else 3 end"""))
def context_neighbours(spark, sf):
    from lithic.operators.search import context_neighbours as expand

    w = Warehouse(spark, sf)
    seeds = Q.centrality(w.files, w.imports).select(F.lit("file").alias("type"), F.col("path").alias("id"), "score")
    calls = w.functions.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    return expand(seeds, calls, w.imports, w.db_access.select("table", "file"), None)


@query("overview_text", oracle("""
, l as (select case lang when 'python' then 'Python' when 'typescript' then 'TypeScript' when 'java' then 'Java' when 'go' then 'Go' when 'ruby' then 'Ruby' when 'tsx' then 'TSX' when 'javascript' then 'JavaScript' else 'Rust' end
   || ' (' || count(*) || ' files)' as t from m_files group by lang order by sum(size) desc, lang limit 6)
select 'Languages: ' || (select string_agg(t, ', ' order by t) from l) || chr(10) || 'Size: ' || (select count(*) from m_files) || ' files, ' || (select cast(sum(loc) as bigint) from m_files) || ' LOC, ' || (select count(*) from m_functions)
 || ' functions' || chr(10) || 'Routes: ' || (select count(*) from (select distinct method, path, file from m_routes)) || ', tables: ' || (select count(distinct "table") from m_db) || chr(10) || 'Flows: none' as text"""))
def overview_text(spark, sf):
    from lithic.operators.relations import language_stats, manifest_counts
    from lithic.operators.search import overview_text as text

    w = Warehouse(spark, sf)
    no_flows = w.spark.createDataFrame([], "flow string, name string, function_count bigint")
    counts = manifest_counts(w.files, w.functions, w.table("nation"), w.routes, w.db_access, w.env, w.dependencies, w.security, no_flows)
    return text(counts, language_stats(w.files), no_flows)
