"""Registered search queries."""

from pyspark.sql import functions as F

from lithic.operators import search as S
from lithic.plans.registry import query
from lithic.plans.warehouse import Warehouse, oracle
from lithic.session import cut


def document_items(w: Warehouse):
    return w.table("documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("type"), F.col("source").alias("label"),
        F.col("source").alias("ref"), "text", F.concat_ws(" ", "source", "lang", "text").alias("hay"),
    )


# Vector search in SQL: hash each token, count buckets per document, exact integer dot products.
_VEC = """
with tok0 as (
  select doc_id as id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) as p from documents),
tok1 as (
  select id, unnest(list_concat([p], list_filter(string_split_regex(
     regexp_replace(regexp_replace(p,'([a-z])([0-9])','\\1 \\2','g'),'([0-9])([a-z])','\\1 \\2','g'), '\\s+'), lambda s: s <> '' and s <> p))) as t from tok0),
tok as (select id, t from tok1 where length(t) between 2 and 30),
voc as (
  select t, list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(t,''), lambda c: ascii(c)::bigint)),
     lambda h, c: (xor(h, c) * 16777619) & 4294967295) %% 512 as b from (select distinct t from tok union select unnest(%s))),
vec as (select id, b, count(*) as n from tok join voc using (t) group by id, b),
nrm as (select id, sum(n*n) as n2 from vec group by id),
"""
_Q = "the payment of the user token 24be"
_QTOK = "['the','payment','of','the','user','token','24be','24','be']"
_HQ = "MIT License"
_HTOK = "['mit','license']"


def _vector_sql(toks: str) -> str:
    return _VEC % toks + f"""
qv as (select b, count(*) as n from (select unnest({toks}) as t) join voc using (t) group by b),
qn as (select sum(n*n) as n2 from qv),
raw as (select vec.id, cast(sum(vec.n*qv.n) as double) / (sqrt(cast(max(nrm.n2) as double)) * sqrt(cast((select n2 from qn) as double))) as r
        from vec join qv using (b) join nrm using (id) group by vec.id),
hits as (select doc_id as id, lang as type, source as label, source as ref, floor(r*1000.0+0.5)/1000.0 as score
        from raw join documents on doc_id = id where r > 0)
"""


_VEC_Q = _vector_sql(_QTOK)


@query("doc_semantic_search", _VEC_Q + " select * from hits order by score desc, id limit 20")
def doc_semantic_search(spark, sf):
    return S.semantic_search(document_items(Warehouse(spark, sf)), _Q)


@query("doc_index_search", _VEC_Q + " select * from hits order by score desc, id limit 20")
def doc_index_search(spark, sf):
    """The same search from the written index, which does not touch the texts again."""
    return S.index_search(cut(S.embedding_index(document_items(Warehouse(spark, sf)))), _Q)


@query("doc_semantic_search_typed", _VEC_Q + " select * from hits where type = 'fr' order by score desc, id limit 20")
def doc_semantic_search_typed(spark, sf):
    return S.semantic_search(document_items(Warehouse(spark, sf)), _Q, kind="fr")


@query(
    "hybrid_search",
    _vector_sql(_HTOK) + """,
 v as (select *, 0 as stage from hits order by score desc, id limit 24),
 l as (select doc_id as id, lang as type, source as label, source as ref, 0.5 as score, 1 as stage from documents
       where contains(lower(source || ' ' || lang || ' ' || text), 'mit license') and doc_id not in (select id from v) order by id limit 24)
 select * from (select * from v union all select * from l) order by stage, score desc, id limit 24""",
)
def hybrid_search(spark, sf):
    return S.hybrid_search(document_items(Warehouse(spark, sf)), _HQ)


@query(
    "doc_similar",
    _VEC % "['the']" + """
 qv as (select b, n from vec where id = 0), qn as (select n2 from nrm where id = 0),
 raw as (select vec.id, cast(sum(vec.n*qv.n) as double) / (sqrt(cast(max(nrm.n2) as double)) * sqrt(cast((select n2 from qn) as double))) as r
        from vec join qv using (b) join nrm using (id) where vec.id <> 0 group by vec.id)
 select doc_id as id, lang as type, source as label, source as ref, floor(r*1000.0+0.5)/1000.0 as score
 from raw join documents on doc_id = id where r > 0.05 order by score desc, id limit 10""",
)
def doc_similar(spark, sf):
    return S.similar_to(document_items(Warehouse(spark, sf)), 0)


@query(
    "embedding_index",
    _VEC % "['the']" + " fin as (select id, b as bucket, n / sqrt(cast(n2 as double)) as w from vec join nrm using (id)) "
    "select id, count(*) as buckets, floor(sum(w*w)*1000.0+0.5)/1000.0 as unit, floor(max(w)*1000000.0+0.5)/1000000.0 as top from fin group by id",
)
def embedding_index(spark, sf):
    idx = S.embedding_index(document_items(Warehouse(spark, sf)))
    return idx.groupBy("id").agg(
        F.count("*").alias("buckets"),
        (F.floor(F.sum(F.col("weight") * F.col("weight")) * 1000.0 + 0.5) / 1000.0).alias("unit"),
        (F.floor(F.max("weight") * 1000000.0 + 0.5) / 1000000.0).alias("top"),
    )


@query(
    "dense_similar",
    """with q as (select embedding::double[] as e from embeddings where vec_id = 0),
 raw as (select vec_id as id, label, list_dot_product(embedding::double[], (select e from q)) /
   sqrt(list_dot_product(embedding::double[], embedding::double[]) * list_dot_product((select e from q),(select e from q))) as r
   from embeddings where vec_id <> 0)
 select id, label, floor(r*1000.0+0.5)/1000.0 as score from raw where r > 0.05 order by score desc, id limit 10""",
)
def dense_similar(spark, sf):
    v = Warehouse(spark, sf).table("embeddings").select(
        F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec")
    )
    return S.dense_similar(v, 0)


_LEX_Q = "payment payroll user widget entry"


@query(
    "lexical_retrieve",
    oracle("""
, words as (
  select 'file' as type, path as ref, path as title, path as f1, doc as f2, '' as f3, 2.0 as b1, 1.5 as b2, 0.0 as b3 from m_files
  union all select 'function', file || ':' || line, name, name, file, doc, 3.0, 1.0, 1.5 from m_functions
  union all select 'route', file, method || ' ' || path, path, file, method, 3.0, 1.0, 1.0 from m_routes),
sc as (select type, ref, title,
   len(list_filter(regexp_extract_all(lower(coalesce(f1,'')),'[a-z_][a-z0-9_]{2,}'), lambda t: t in ('payment','payroll','user','widget','entry')))*b1 +
   len(list_filter(regexp_extract_all(lower(coalesce(f2,'')),'[a-z_][a-z0-9_]{2,}'), lambda t: t in ('payment','payroll','user','widget','entry')))*b2 +
   len(list_filter(regexp_extract_all(lower(coalesce(f3,'')),'[a-z_][a-z0-9_]{2,}'), lambda t: t in ('payment','payroll','user','widget','entry')))*b3 as score
   from words)
select type, ref, title, cast(score as double) as score from sc where score > 0 order by score desc, type, ref, title limit 14"""),
)
def lexical_retrieve(spark, sf):
    w = Warehouse(spark, sf)
    ents = (
        w.files.select(F.lit("file").alias("type"), F.col("path").alias("ref"), F.col("path").alias("title"), "path", "doc")
        .unionByName(
            w.functions.select(
                F.lit("function").alias("type"), F.concat("file", F.lit(":"), F.col("line").cast("string")).alias("ref"),
                F.col("name").alias("title"), "name", "file", "doc",
            ),
            allowMissingColumns=True,
        )
        .unionByName(
            w.routes.select(
                F.lit("route").alias("type"), F.col("file").alias("ref"), F.concat_ws(" ", "method", "path").alias("title"),
                F.col("path").alias("route_path"), "file", "method",
            ),
            allowMissingColumns=True,
        )
    )
    boosts = {
        "file": {"path": 2.0, "doc": 1.5},
        "function": {"name": 3.0, "file": 1.0, "doc": 1.5},
        "route": {"route_path": 3.0, "file": 1.0, "method": 1.0},
    }
    return S.lexical_retrieve(ents, _LEX_Q, boosts)


@query(
    "global_search",
    oracle("""
, idx as (select 'file' as kind, path as name, lang as meta from m_files
  union all select 'fn', name, file from m_functions
  union all select 'api', method || ' ' || path, framework from (select distinct method, path, framework from m_routes)
  union all select 'dep', name, ecosystem from m_deps
  union all select 'customer', c_name, c_mktsegment from customer)
select kind, name, meta, floor(((case when starts_with(lower(name),'e') then 3 else 1 end) + (case when starts_with(lower(name),'pay') then 3 else 1 end)
   - length(name)*0.002::double)*1000.0+0.5)/1000.0 as score
from idx where contains(lower(name),'e') and contains(lower(name),'pay') order by score desc, kind, name, meta limit 40"""),
)
def global_search(spark, sf):
    w = Warehouse(spark, sf)
    idx = (
        w.files.select(F.lit("file").alias("kind"), F.col("path").alias("name"), F.col("lang").alias("meta"))
        .unionByName(w.functions.select(F.lit("fn").alias("kind"), "name", F.col("file").alias("meta")))
        .unionByName(
            w.routes.select(F.lit("api").alias("kind"), F.concat_ws(" ", "method", "path").alias("name"), F.col("framework").alias("meta")).distinct()
        )
        .unionByName(w.dependencies.select(F.lit("dep").alias("kind"), "name", F.col("ecosystem").alias("meta")))
        .unionByName(w.table("customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("meta")))
    )
    return S.global_search(idx, "e pay")


@query(
    "palette_search",
    oracle("""
, f as (select 'function' as kind, name || '()' as label, string_split(file,'/')[-1] as meta from m_functions where contains(name,'entry_1') order by name, file limit 8),
fl as (select 'file' as kind, string_split(path,'/')[-1] as label, lang as meta from m_files where contains(path,'entry_1') order by path limit 6)
select * from f union all select * from fl"""),
)
def palette_search(spark, sf):
    w = Warehouse(spark, sf)
    tables = w.db_access.select(F.col("table").alias("name")).distinct()
    return S.palette_search(w.functions, w.files, tables, "entry_1")
