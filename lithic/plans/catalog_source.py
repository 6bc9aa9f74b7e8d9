"""Registered queries over text: signal detectors, symbol extraction, import resolution."""

from pyspark.sql import functions as F

from lithic.operators import resolve, scan, symbols
from lithic.plans.corpus import ORDERS_SQL, corpus
from lithic.plans.registry import query
from lithic.plans.warehouse import Warehouse
from lithic.session import spread

_O = "with " + ORDERS_SQL


def documents(w: Warehouse):
    return w.table("documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")


_DOC_LINES = """
with ln as (select source || '/' || lang || '/' || doc_id as file, unnest(string_split(text, chr(10))) as s,
                   generate_subscripts(string_split(text, chr(10)), 1) as line from documents),
 pat(type, kind, severity, re, opt) as (values
  ('secret','AWS access key id','high','\\bAKIA[0-9A-Z]{16}\\b','c'),
  ('secret','GitHub token','high','\\bgh[pousr]_[A-Za-z0-9]{36,}\\b','c'),
  ('secret','Private key','high','-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----','c'),
  ('secret','Hardcoded credential','medium','(?i)(?:password|passwd|pwd|secret|api[_-]?key|token|access[_-]?key)\\s*[:=]\\s*[`''"][^`''"\\s]{8,}[`''"]','c'),
  ('code-exec','eval() use','medium','\\beval\\s*\\(','c'),
  ('crypto','Weak hash (MD5/SHA1)','low','(?i)md5\\(|sha1\\(|hashlib\\.md5','c')),
 hit as (select type, kind, severity, file, line, unnest(regexp_extract_all(s, re)) as h from ln, pat where regexp_matches(s, re))
"""


@query(
    "security_scan",
    _DOC_LINES + """select type, kind, severity, file, line,
   case when type <> 'secret' then null when length(h) <= 10 then substr(h,1,3) || '***' else substr(h,1,6) || '***' || right(h,3) end as snippet from hit""",
)
def security_scan(spark, sf):
    return scan.detect_security(spread(documents(Warehouse(spark, sf))))


@query("security_by_severity", _DOC_LINES + "select type, severity, count(*) as findings, count(distinct file) as files from hit group by all")
def security_by_severity(spark, sf):
    found = scan.detect_security(spread(documents(Warehouse(spark, sf))))
    return found.groupBy("type", "severity").agg(F.count("*").alias("findings"), F.countDistinct("file").alias("files"))


@query(
    "page_security_scan",
    """with hit as (select url as file, unnest(regexp_extract_all(html, 'dangerouslySetInnerHTML|\\.innerHTML\\s*=|v-html|document\\.write\\(')) as h from pages)
    select 'xss' as type, file, count(*) as findings from hit group by all""",
)
def page_security_scan(spark, sf):
    pages = Warehouse(spark, sf).table("pages").select(F.col("url").alias("path"), F.col("html").alias("text"))
    return scan.detect_security(spread(pages)).filter("type = 'xss'").groupBy("type", "file").agg(F.count("*").alias("findings"))


@query(
    "route_scan",
    _O + """select case p when '1-URGENT' then 'GET' when '3-MEDIUM' then 'GET' else 'HANDLEFUNC' end as method, '/orders/' || k as path,
  case p when '1-URGENT' then 'python-web' when '3-MEDIUM' then 'spring' else 'go-http' end as framework, path as file,
  case p when '1-URGENT' then 10 when '3-MEDIUM' then 6 else 4 end as line from o where p in ('1-URGENT','3-MEDIUM','4-NOT SPECIFIED')""",
)
def route_scan(spark, sf):
    from lithic.operators.relations import dedupe_routes

    return dedupe_routes(scan.detect_routes(spread(corpus(Warehouse(spark, sf))))).select("method", "path", "framework", "file", "line")


@query(
    "db_access_scan",
    _O + """select 'prisma' as kind, 'orders' || c as "table", 'findMany' as op, path as file, 4 as line from o where p = '2-HIGH'
  union all select 'ddl-table', 'orders_' || k, null, path, 1 from o where p = '5-LOW'
  union all select 'sql', 'orders_' || k, null, path, 2 from o where p = '5-LOW'
  union all select 'sql', 'orders_' || c, null, path, 2 from o where p = '5-LOW'
  union all select 'sql', 'orders_' || c, null, path, 3 from o where p = '5-LOW'""",
)
def db_access_scan(spark, sf):
    return scan.detect_db(spread(corpus(Warehouse(spark, sf))))


@query(
    "env_scan",
    _O + """select case p when '1-URGENT' then 'ORDER_' || c when '2-HIGH' then 'ORDER_REGION' else 'ORDER_ZONE' end as name, path as file,
  case p when '1-URGENT' then 8 else 6 end as line from o where p in ('1-URGENT','2-HIGH','4-NOT SPECIFIED')""",
)
def env_scan(spark, sf):
    return scan.detect_env(spread(corpus(Warehouse(spark, sf))))


@query("job_scan", _O + "select 'timer' as kind, null::varchar as detail, path as file, 15 as line from o where p = '2-HIGH'")
def job_scan(spark, sf):
    return scan.detect_jobs(spread(corpus(Warehouse(spark, sf))))


_INFRA_PATH = {
    0: ".github/workflows/ci_{}.yml", 1: "svc_{}/Dockerfile", 2: "svc_{}/docker-compose.yaml", 3: "infra/main_{}.tf", 4: "deploy/k8s_{}/kubernetes.yaml",
}


@query(
    "infra_scan",
    """select case s_nationkey % 5 when 0 then 'ci' when 3 then 'iac' else 'container' end as type,
 case s_nationkey % 5 when 0 then 'github-actions' when 1 then 'docker' when 2 then 'docker-compose' when 3 then 'terraform' else 'kubernetes' end as system,
 case s_nationkey % 5 when 0 then '.github/workflows/ci_' || s_suppkey || '.yml' when 1 then 'svc_' || s_suppkey || '/Dockerfile'
   when 2 then 'svc_' || s_suppkey || '/docker-compose.yaml' when 3 then 'infra/main_' || s_suppkey || '.tf' else 'deploy/k8s_' || s_suppkey || '/kubernetes.yaml' end as file
 from supplier""",
)
def infra_scan(spark, sf):
    return scan.detect_infra(infra_paths(Warehouse(spark, sf)))


def infra_paths(w: Warehouse):
    key, out = F.col("s_suppkey").cast("string"), None
    for i, pattern in _INFRA_PATH.items():
        a, b = pattern.split("{}")
        v = F.concat(F.lit(a), key, F.lit(b))
        out = F.when(F.col("s_nationkey") % 5 == i, v) if out is None else out.when(F.col("s_nationkey") % 5 == i, v)
    return w.table("supplier").select(out.alias("path"))


@query(
    "function_extract",
    _O + """, f as (
 select path as file, 'python' as lang, 'settle_' || k as name, 5 as line, 8 as end_line, 3 as complexity, 'apply_' || c || ',get' as calls, null as doc, false as async from o where p = '1-URGENT'
 union all select path, 'python', 'view_' || k, 11, 13, 1, 'settle_' || k, null, false from o where p = '1-URGENT'
 union all select path, 'typescript', 'load' || k, 3, 9, 3, 'findMany,settle', 'Loads order ' || k, true from o where p = '2-HIGH'
 union all select path, 'typescript', 'total', 11, 13, 2, 'load' || k, null, false from o where p = '2-HIGH'
 union all select path, 'java', 'net', 6, 14, 3, 'multiply,compareTo,subtract,add,net', null, false from o where p = '3-MEDIUM'
 union all select path, 'go', 'Serve' || k, 3, 8, 2, 'HandleFunc,audit' || c || ',Getenv', null, false from o where p = '4-NOT SPECIFIED')
 select file || '::' || name || '#' || line as id, file, lang, name, line, end_line, end_line - line + 1 as loc, complexity, calls, doc, async from f""",
)
def function_extract(spark, sf):
    f = symbols.functions(symbols.parse(spread(corpus(Warehouse(spark, sf)))))
    return f.withColumn("calls", F.array_join("calls", ","))


@query(
    "class_extract",
    _O + """select path || '::Order' || k as id, path as file, 'typescript' as lang, 'Order' || k as name, 'class' as kind, 10 as line, 14 as end_line, 5 as loc, null::varchar as doc from o where p = '2-HIGH'
 union all select path || '::Order' || k || 'Service', path, 'java', 'Order' || k || 'Service', 'class', 3, 15, 13, null from o where p = '3-MEDIUM'""",
)
def class_extract(spark, sf):
    return symbols.classes(symbols.parse(spread(corpus(Warehouse(spark, sf)))))


@query(
    "import_resolve",
    _O + """, i as (
 select path as file, 'os' as source, null as resolved from o where p = '1-URGENT'
 union all select a.path, 'base.order_' || a.c, b.path from o a left join o b on b.k = a.c and b.k <> a.k and b.p in ('1-URGENT','2-HIGH','4-NOT SPECIFIED') where a.p = '1-URGENT'
 union all select a.path, './order_' || a.c, b.path from o a left join o b on b.k = a.c and b.p = '2-HIGH' and b.y = a.y where a.p = '2-HIGH'
 union all select a.path, 'app.y' || a.y || '.Order' || a.c || 'Service', b.path from o a left join o b on b.k = a.c and b.k <> a.k and b.p = '3-MEDIUM' where a.p = '3-MEDIUM'
 union all select a.path, 'shop/order_' || a.c, b.path from o a left join o b on b.k = a.c and b.k <> a.k and b.p in ('1-URGENT','2-HIGH','4-NOT SPECIFIED') where a.p = '4-NOT SPECIFIED')
 select file, source, resolved, resolved is null as external from i""",
)
def import_resolve(spark, sf):
    files = spread(corpus(Warehouse(spark, sf)))
    parsed = symbols.parse(files)
    known = files.filter(F.col("lang").isNotNull()).select("path")
    return resolve.resolve_imports(symbols.imports(parsed), known).select("file", "source", "resolved", "external")


@query(
    "file_records",
    _O + """select path, case p when '1-URGENT' then 'python' when '2-HIGH' then 'typescript' when '3-MEDIUM' then 'java' else 'go' end as lang,
  case p when '1-URGENT' then 14 when '2-HIGH' then 16 when '3-MEDIUM' then 16 else 9 end as loc,
  case p when '1-URGENT' then 10 when '2-HIGH' then 14 when '3-MEDIUM' then 15 else 8 end as sloc,
  case p when '1-URGENT' then 2 when '2-HIGH' then 2 else 1 end as functions,
  case p when '1-URGENT' then 4 when '2-HIGH' then 5 when '3-MEDIUM' then 3 else 2 end as complexity,
  case p when '1-URGENT' then 'Order ' || k || ' of customer ' || c end as doc from o where p <> '5-LOW'""",
)
def file_records(spark, sf):
    files = spread(corpus(Warehouse(spark, sf)))
    fns = symbols.functions(symbols.parse(files))
    return symbols.file_records(files, fns).select("path", "lang", "loc", "sloc", "functions", "complexity", "doc")


@query(
    "source_range",
    """with d as (select source || '/' || lang || '/' || doc_id as path, text from documents),
 ln as (select path, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as line from d)
 select line, text from ln where path = (select max(path) from d) and line between 2 and 32""",
)
def source_range(spark, sf):
    docs = documents(Warehouse(spark, sf))
    last = docs.agg(F.max("path")).first()[0]
    return scan.source_lines(docs, last, 2)


#: A file of callbacks for each order: in a call, over several lines, as an argument, and one that gets a name.
_CALLBACKS = """app.get("/orders/{k}", (req, res) => {
  make{c}(req);
  items.forEach(x => keep{k}(x));
});
run(async function () {
  await load{c}();
});
const named{k} = (a) => pack{k}(a);
"""


def callbacks(w: Warehouse):
    text = F.lit(_CALLBACKS)
    for name, column in (("{k}", "o_orderkey"), ("{c}", "o_custkey")):
        text = F.replace(text, F.lit(name), F.col(column).cast("string"))
    o = w.table("orders")
    return o.select(F.concat(F.lit("web/cb_"), F.col("o_orderkey"), F.lit(".js")).alias("path"), F.lit("javascript").alias("lang"), F.lit(None).cast("string").alias("meta"), text.alias("text")).withColumn("size", F.length("text").cast("long"))


@query(
    "anonymous_functions",
    """with o as (select 'web/cb_' || o_orderkey || '.js' as file, o_orderkey k, o_custkey c from orders), f as (
 select file, '(anonymous)' as name, 1 as line, 4 as end_line, 'make' || c || ',forEach,keep' || k as calls, false as async from o
 union all select file, '(anonymous)', 3, 3, 'keep' || k, false from o union all select file, '(anonymous)', 5, 7, 'load' || c, true from o
 union all select file, 'named' || k, 8, 8, 'pack' || k, false from o)
 select file || '::' || name || '#' || line as id, file, name, line, end_line, calls, async from f""",
)
def anonymous_functions(spark, sf):
    f = symbols.functions(symbols.parse(spread(callbacks(Warehouse(spark, sf)))))
    return f.select("id", "file", "name", "line", "end_line", F.array_join("calls", ",").alias("calls"), "async")


@query(
    "parse_errors",
    _O + """select case p when '1-URGENT' then 'python' when '2-HIGH' then 'typescript' when '3-MEDIUM' then 'java' else 'go' end as lang,
 count(*) as files, count(*) filter (k % 7 = 0) as broken from o where p <> '5-LOW' group by 1""",
)
def parse_errors(spark, sf):
    """Every seventh order's file lacks its last characters, and with them a closing bracket."""
    source = corpus(Warehouse(spark, sf)).filter("lang is not null")
    torn = F.regexp_extract("path", r"(\d+)(?:Service)?\.\w+$", 1).cast("long") % 7 == 0
    source = source.withColumn("text", F.when(torn, F.expr("substring(text, 1, length(text) - 3)")).otherwise(F.col("text")))
    parsed = symbols.parse(spread(source))
    bad = symbols.broken(parsed).withColumn("bad", F.lit(1))
    return parsed.select("path", "lang").join(bad, "path", "left").groupBy("lang").agg(F.count("*").alias("files"), F.count("bad").alias("broken"))
