"""Registered queries: relational core, metrics, health, insights."""

from pyspark.sql import functions as F

from lithic.functions import rules
from lithic.operators import quality as Q
from lithic.operators import relations as R
from lithic.operators import traverse as G
from lithic.plans.registry import query
from lithic.plans.warehouse import Warehouse, oracle

LAYER_SQL = """case when regexp_matches(lower({p}), '(^|/)(test|tests|spec|__tests__|__test__)(/|$)|\\.(test|spec)\\.') then 'test'
 when regexp_matches(lower({p}), '(^|/)(controller|controllers|routes|route|api|handler|handlers|endpoints)(/|\\.)') then 'api'
 when regexp_matches(lower({p}), '(^|/)(service|services|usecase|usecases|domain|business|logic)(/|\\.)') then 'service'
 when regexp_matches(lower({p}), '(^|/)(model|models|entity|entities|schema|schemas|repository|repositories|dao|dto|orm)(/|\\.)') then 'data'
 when regexp_matches(lower({p}), '(^|/)(component|components|view|views|pages|page|ui|widgets|screens)(/|\\.)') then 'ui'
 when regexp_matches(lower({p}), '(^|/)(util|utils|helper|helpers|lib|libs|common|shared|core)(/|\\.)') then 'lib'
 when regexp_matches(lower({p}), '(^|/)(config|configs|settings|env)(/|\\.)') then 'config' else 'other' end"""


def layer_sql(column: str) -> str:
    return LAYER_SQL.replace("{p}", column)


@query("lang_stats", oracle("""
select lang as id, case lang when 'python' then 'Python' when 'typescript' then 'TypeScript' when 'java' then 'Java' when 'go' then 'Go' when 'ruby' then 'Ruby'
  when 'tsx' then 'TSX' when 'javascript' then 'JavaScript' when 'rust' then 'Rust' end as label, count(*) as files, cast(sum(size) as bigint) as bytes from m_files group by lang"""))
def lang_stats(spark, sf):
    return R.language_stats(Warehouse(spark, sf).files)


@query("doc_lang_stats", "select lang as id, lang as label, count(*) as files, cast(sum(n_chars) as bigint) as bytes from documents group by lang")
def doc_lang_stats(spark, sf):
    return R.language_stats(Warehouse(spark, sf).table("documents").withColumnRenamed("n_chars", "size"))


@query("manifest_counts", oracle("""
select (select count(*) from m_files) as files, (select count(*) from m_functions) as functions, (select count(*) from nation) as classes,
 (select count(*) from (select distinct method, path, file from m_routes)) as routes, (select count(distinct "table") from m_db) as tables,
 (select count(distinct name) from m_env) as env_vars, (select count(distinct name) from m_deps) as dependencies, (select count(*) from m_security) as security_findings,
 (select count(distinct lang) from m_files) as languages, (select count(*) from region) as flows, (select cast(sum(loc) as bigint) from m_files) as loc"""))
def manifest_counts(spark, sf):
    w = Warehouse(spark, sf)
    return R.manifest_counts(w.files, w.functions, w.table("nation"), w.routes, w.db_access, w.env, w.dependencies, w.security, w.table("region"))


@query("table_summary", oracle("""
, u as (select *, regexp_matches(lower(kind || ' ' || coalesce(op,'')), 'write|insert|update|delete|create|save|upsert') as w from m_db)
select "table" as name, count(*) as accesses, string_agg(distinct kind, ',' order by kind) as kinds, (select max_by(file, (ord, file)) from u d where d."table" = u."table" and kind = 'ddl-table') as defined_in,
 count(distinct case when w then file end) as writers, count(distinct case when not w then file end) as readers from u group by "table\""""))
def table_summary(spark, sf):
    return R.table_summary(Warehouse(spark, sf).db_access).withColumn("kinds", F.array_join("kinds", ","))


@query("route_dedupe", oracle("""
select method, path, framework, file, line, ord from (select *, row_number() over (partition by method, path, file order by ord) r from m_routes) where r = 1"""))
def route_dedupe(spark, sf):
    return R.dedupe_routes(Warehouse(spark, sf).routes)


@query("env_unique", oracle("select name, file, line, ord from (select *, row_number() over (partition by name order by ord) r from m_env) where r = 1"))
def env_unique(spark, sf):
    return R.dedupe_env(Warehouse(spark, sf).env)


@query("dependency_unique", oracle("select name, version, scope, ecosystem, ord from (select *, row_number() over (partition by ecosystem, name order by ord) r from m_deps) where r = 1"))
def dependency_unique(spark, sf):
    return R.dedupe_dependencies(Warehouse(spark, sf).dependencies)


@query("db_sites", oracle('select distinct "table", file, is_write from m_dbw'))
def db_sites(spark, sf):
    return R.table_users(Warehouse(spark, sf).db_access)


@query("dead_files", oracle("""
select path from m_files where functions > 0 and path not in (select resolved from m_imports) and not regexp_matches(path, '(^|/)(test|tests|spec|examples?|scripts?|bin|cmd)(/|$)')"""))
def dead_files(spark, sf):
    w = Warehouse(spark, sf)
    return Q.dead_files(w.files, w.imports)


@query("large_files", oracle("select path, loc from m_files where loc >= 400"))
def large_files(spark, sf):
    return Q.large_files(Warehouse(spark, sf).files)


@query("large_functions", oracle("select id, name, file, loc from m_functions where loc >= 60"))
def large_functions(spark, sf):
    return Q.large_functions(Warehouse(spark, sf).functions)


@query("complex_functions", oracle("select id, name, file, complexity from m_functions where complexity >= 12"))
def complex_functions(spark, sf):
    return Q.complex_functions(Warehouse(spark, sf).functions)


@query("dup_names", oracle("""select name, count(distinct file) as count from m_functions where length(name) >= 3 group by name having count(distinct file) > 2 order by count desc, name limit 100"""))
def dup_names(spark, sf):
    return Q.duplicate_names(Warehouse(spark, sf).functions)


@query("dup_blocks", oracle("""
select name, loc, complexity, count(*) as occurrences, min(file) as first_file from m_functions where loc >= 8 group by all having count(*) > 1 order by occurrences desc, name, loc, complexity limit 60"""))
def dup_blocks(spark, sf):
    return Q.duplicate_blocks(Warehouse(spark, sf).functions)


@query("layer_violations", oracle(f"""
, v as (select file as "from", resolved as "to", {layer_sql('file')} as a, {layer_sql('resolved')} as b from m_imports)
select "from", "to", case when a = 'ui' then 'ui imports ' || b else 'data imports ui' end as rule from v where (a = 'ui' and b in ('data','api')) or (a = 'data' and b = 'ui')"""))
def layer_violations(spark, sf):
    return Q.layer_violations(Warehouse(spark, sf).imports)


@query("layer_counts", oracle(f"select {layer_sql('path')} as layer, count(*) as files from m_files group by 1"))
def layer_counts(spark, sf):
    return Q.layer_counts(Warehouse(spark, sf).files)


_SUMMARY = f"""
, lv as (select {layer_sql('file')} as a, {layer_sql('resolved')} as b from m_imports),
cyc as (with recursive r as (select src, dst from m_succ union select r.src, m_succ.dst from r join m_succ on r.dst = m_succ.src)
  select distinct least(a.src, min(a.dst)) as component from r a join r b on a.src = b.dst and a.dst = b.src where a.src <> a.dst group by a.src),
m_summary as materialized (select (select count(*) from cyc) as circular,
 (select count(*) from m_files where functions > 0 and path not in (select resolved from m_imports) and not regexp_matches(path, '(^|/)(test|tests|spec)(/|$)')) as dead,
 (select count(*) from m_files where loc >= 400) as large_files, (select count(*) from m_functions where loc >= 60) as large_functions,
 (select count(*) from m_functions where complexity >= 12) as complex_functions,
 (select count(*) from (select name from m_functions where length(name) >= 3 group by name having count(distinct file) > 2)) as duplicate_names,
 (select count(*) from (select 1 from m_functions where loc >= 8 group by name, loc, complexity having count(*) > 1)) as duplicate_blocks,
 (select count(*) from m_files where has_parse_error) as parse_errors,
 (select count(*) from lv where (a = 'ui' and b in ('data','api')) or (a = 'data' and b = 'ui')) as layer_violations,
 (select count(*) from m_functions where doc is null and loc >= 15) as undocumented)
"""


def summary_of(w: Warehouse):
    return Q.metric_summary(w.files, w.functions, w.imports, G.strong_components(w.succ))


@query("metric_summary", oracle(_SUMMARY + "select * from m_summary"))
def metric_summary(spark, sf):
    return summary_of(Warehouse(spark, sf).keep("files", "functions", "imports"))


_FAN = """
, fd as (select distinct file, resolved from m_imports where file <> resolved),
fan as (select path, coalesce(i,0) as fan_in, coalesce(o,0) as fan_out from m_files
  left join (select resolved as path, count(*) i from fd group by 1) using (path) left join (select file as path, count(*) o from fd group by 1) using (path))
"""


@query("health_scores", oracle(_SUMMARY + _FAN + f"""
, f as (select *, greatest((select count(*) from m_files),1) n, (select count(doc) from m_files) documented,
   (select count(*) from m_files where regexp_matches(path, '(^|/)tests/')) tests, greatest((select count(*) from m_functions),1) fns,
   (select count(*) from m_functions where loc >= 15) big, (select count(*) from m_functions where loc >= 15 and doc is not null) big_doc,
   (select count(*) from m_security where severity='high') high, (select count(*) from m_security where severity='medium') medium,
   (select sum(fan_in) from fan) fan_total, (select count(distinct {layer_sql('path')}) from m_files) layers from m_summary),
s as (select n, large_files,
  floor(greatest(0,least(1,(case when circular=0 then 0.4::double else 0.15::double end) + (case when layer_violations=0 then 0.3::double else greatest(0::double,0.3::double-layer_violations*0.01::double) end) + least(layers/5,1)*0.3::double))*100+0.5) as architecture,
  floor(greatest(0,least(1,(documented/n)*0.5::double + coalesce(big_doc/nullif(big,0),1)*0.5::double))*100+0.5) as documentation,
  floor(greatest(0,least(1,(tests/n)/0.35::double))*100+0.5) as testing,
  floor(greatest(0,least(1,1-(high*8+medium*1.5::double)/greatest(n*2,40)))*100+0.5) as security,
  floor(greatest(0,least(1,1-(circular*0.05::double+greatest(fan_total/n-2,0)*0.12::double)))*100+0.5) as coupling,
  floor(greatest(0,least(1,1-complex_functions/greatest(fns*0.12::double,20)))*100+0.5) as complexity,
  floor(greatest(0,least(1,1-(dead/n)/0.15::double))*100+0.5) as deadcode from f),
m as (select *, floor((complexity*0.4::double + documentation*0.25::double + greatest(0,least(1,1-large_files/greatest(n*0.1::double,10)))*100*0.35::double)/100*100+0.5) as maintainability from s)
select key, cast(value as bigint) as value from (select *, floor((architecture+documentation+testing+security+maintainability+coupling+complexity+deadcode)/8+0.5) as overall from m)
 unpivot (value for key in (architecture, documentation, testing, security, maintainability, coupling, complexity, deadcode, overall))"""))
def health_scores(spark, sf):
    from lithic.session import cut

    w = Warehouse(spark, sf).keep("files", "functions", "imports")
    return Q.health(w.files, w.functions, w.imports, w.security, cut(summary_of(w)))


@query("fan_in_out_distinct", oracle(_FAN + "select path, fan_in, fan_out from fan where fan_in + fan_out > 0"))
def fan_in_out_distinct(spark, sf):
    return Q.fan_distinct(Warehouse(spark, sf).imports)


@query("fan_in_out_raw", oracle("""
select path, cast(sum(i) as bigint) as fan_in, cast(sum(o) as bigint) as fan_out from (select resolved as path, 1 i, 0 o from m_imports where file <> resolved
 union all select file, 0, 1 from m_imports where file <> resolved) group by path"""))
def fan_in_out_raw(spark, sf):
    return Q.fan_statements(Warehouse(spark, sf).imports)


_CENTRAL = _FAN + """
, central as (select path, fan_in, fan_out, functions, complexity, loc,
   floor((fan_in*2 + fan_out + least(functions,20)*0.2::double + least(complexity,80)*0.05::double)*10.0::double+0.5)/10.0::double as score from m_files join fan using (path))
"""


@query("centrality_rank", oracle(_CENTRAL + "select * from central order by score desc, path limit 20"))
def centrality_rank(spark, sf):
    w = Warehouse(spark, sf)
    return Q.top(Q.centrality(w.files, w.imports), "score")


@query("risk_rank", oracle(_CENTRAL + """
, rk as (select path, cast(floor(fan_in*3 + (complexity + loc*0.02::double)*0.3::double + case when complexity > 60 then 15 else 0 end + case when loc > 500 then 10 else 0 end + 0.5) as bigint) as risk,
  fan_in, complexity, loc, concat_ws('; ', case when fan_in >= 5 then fan_in || ' modules depend on it' end, case when complexity > 60 then 'high complexity (' || complexity || ')' end,
  case when loc > 500 then 'large file (' || loc || ' LOC)' end, case when fan_in >= 3 and complexity > 30 then 'central + complex' end) as reasons from central)
select * from rk where reasons <> '' order by risk desc, path limit 20"""))
def risk_rank(spark, sf):
    w = Warehouse(spark, sf)
    return Q.top(Q.risk(Q.centrality(w.files, w.imports)).withColumn("reasons", F.array_join("reasons", "; ")), "risk")


@query("heat_normalised", oracle(_FAN + """
, tst as (select resolved as path, count(*) tested from fd where regexp_matches(file, '(^|/)tests/') group by 1),
x as (select m_files.path, fan_in, fan_out, complexity, loc, coalesce(tested,0) tested, greatest((select max(fan_in) from fan),1) mf, greatest((select max(complexity) from m_files),1) mc,
  greatest((select max(loc) from m_files),1) ml from m_files join fan using (path) left join tst using (path))
select path, floor(fan_in/mf*10000.0::double+0.5)/10000.0::double as most_imported, floor((fan_in+fan_out)/(mf*2)*10000.0::double+0.5)/10000.0::double as most_coupled,
 floor(complexity/mc*10000.0::double+0.5)/10000.0::double as complexity, case when tested > 0 then 0.0::double when fan_in > 0 then 0.8::double else 0.4::double end as least_tested,
 floor(least(1,(fan_in/mf)*0.6::double+(complexity/mc)*0.4::double)*10000.0::double+0.5)/10000.0::double as criticality,
 floor(least(1,(fan_in/mf)*0.4::double+(complexity/mc)*0.3::double+(loc/ml)*0.3::double)*10000.0::double+0.5)/10000.0::double as risk from x"""))
def heat_normalised(spark, sf):
    w = Warehouse(spark, sf)
    return Q.heat(w.files, w.imports)


_INSIGHT = """
, fr as (select path, sum(i) as fan_in, sum(o) as fan_out from (select resolved as path, 1 i, 0 o from m_imports where file <> resolved union all select file, 0, 1 from m_imports where file <> resolved) group by path),
ch as (select path, count(*) churn from events join m_paths on user_id = pk group by path),
ir as (select path, string_split(path,'/')[-1] as label, cast(coalesce(fan_in,0) as bigint) fan_in, cast(coalesce(fan_out,0) as bigint) fan_out, complexity, loc, coalesce(churn,0) churn, doc is not null as documented,
  floor((coalesce(fan_in,0)*2 + coalesce(fan_out,0) + complexity*0.05::double)*10.0::double+0.5)/10.0::double as criticality,
  floor((coalesce(fan_in,0)*3 + complexity*0.3::double + case when loc > 500 then 10 else 0 end + coalesce(churn,0)*0.8::double + case when doc is null then 5 else 0 end)*10.0::double+0.5)/10.0::double as risk, functions
  from m_files left join fr using (path) left join ch using (path))
"""


def insight(w: Warehouse):
    churn = w.table("events").join(w.paths, F.col("user_id") == F.col("pk")).groupBy("path").agg(F.count("*").alias("churn"))
    return Q.insight_rows(w.files, w.imports, churn)


@query("insight_rows", oracle(_INSIGHT + "select * from ir"))
def insight_rows(spark, sf):
    return insight(Warehouse(spark, sf))


@query("insight_lists", oracle(_INSIGHT + ", l as (" + " union all ".join(
    f"select * from (select '{n}' as list, path, cast({v} as double) as value from ir where {k} order by value desc, path limit 15)" for n, v, k in [
        ("most_critical", "criticality", "true"), ("most_complex", "complexity", "true"), ("most_coupled", "fan_in+fan_out", "true"), ("most_modified", "churn", "true"),
        ("least_documented", "fan_in", "not documented and functions >= 2"), ("highest_risk", "risk", "true"), ("most_unstable", "churn*fan_in", "churn > 0"), ("fastest_growing", "churn", "loc > 100")]
) + ") select * from l"))
def insight_lists(spark, sf):
    return Q.insight_lists(insight(Warehouse(spark, sf)))


@query("lifecycle_stages", oracle("""
select distinct "table", case when k like '%ddl%' then 'ddl' when regexp_matches(k,'insert|create|save|add') then 'create' when regexp_matches(k,'update|upsert|patch|set|sql-write') then 'update'
  when regexp_matches(k,'delete|remove|destroy') then 'delete' else 'read' end as stage, file, line from (select *, lower(kind || ' ' || coalesce(op,'')) as k from m_db)"""))
def lifecycle_stages(spark, sf):
    from lithic.operators.impact import table_lifecycle

    return table_lifecycle(Warehouse(spark, sf).db_access)


@query("event_lifecycle", """select event_type, case when regexp_matches(event_type,'insert|create|save|add') then 'create' when regexp_matches(event_type,'update|upsert|patch|set') then 'update'
 when regexp_matches(event_type,'delete|remove|destroy') then 'delete' else 'read' end as stage, count(*) as n from events group by all""")
def event_lifecycle(spark, sf):
    e = Warehouse(spark, sf).table("events")
    return e.groupBy("event_type", rules.lifecycle_stage(F.col("event_type"), F.lit("")).alias("stage")).agg(F.count("*").alias("n"))


@query("impact_of_tables", oracle("""
select "table", count(distinct case when not is_write then file end) as readers, count(distinct case when is_write then file end) as writers,
 case when count(distinct file) >= 8 then 'high' when count(distinct file) >= 3 then 'medium' else 'low' end as severity from m_dbw group by 1"""))
def impact_of_tables(spark, sf):
    from lithic.operators.impact import impact_of_tables as impact

    return impact(Warehouse(spark, sf).db_access)
