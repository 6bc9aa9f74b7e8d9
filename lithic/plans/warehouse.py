"""Maps the star-schema test tables onto the source model so every operator has a checkable query.

Each relation is defined twice from the same tables: here as DataFrames and in `PRELUDE` as SQL for
the oracle. All derivations are row-local or key joins, so they grow with the tables and need no
window over an order.

    part                -> files          one file per part
    lineitem            -> functions, calls, imports, db_access, security
    orders              -> routes
    supplier x nation   -> dependencies
    customer            -> env
    events              -> jobs and history
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.session import cut

KEYWORDS = (
    "auth login user account order cart payment invoice billing search report dashboard schedule "
    "booking product inventory admin role payroll employee webhook cache token session email"
).split()
LAYER_DIR = {
    "ring": "controllers", "widget": "services", "bolt": "models", "gear": "components",
    "gizmo": "utils", "plate": "config", "rod": "tests", "anvil": "core",
}
LANG_EXT = {
    "red": ("python", ".py"), "blue": ("typescript", ".ts"), "hot": ("java", ".java"), "cold": ("go", ".go"),
    "old": ("ruby", ".rb"), "new": ("tsx", ".tsx"), "small": ("javascript", ".js"), "large": ("rust", ".rs"),
}
LIBS = "stripe redis celery openai express sentry nodemailer zod prisma winston".split()
PARTS_PER_SUPPLIER = 20


def pick(values: list[str], index: Column) -> Column:
    """Element of a fixed list, index counted from 0 and wrapped."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int") + 1)


def lookup(mapping: dict[str, str], key: Column, default: str) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)


class Warehouse:
    """Lazily built relations over one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def keep(self, *names: str) -> Warehouse:
        """Write relations that a query reads several times, so that their joins are done once."""
        for name in names:
            self.__dict__[name] = cut(getattr(self, name))
        return self

    @cached_property
    def paths(self) -> DataFrame:
        """part key -> path and language."""
        first, second = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
        brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
        ext = lookup({k: v[1] for k, v in LANG_EXT.items()}, first, ".c")
        path = F.concat(
            F.lower("p_type"), F.lit("/"), lookup(LAYER_DIR, second, "misc"), F.lit("/"),
            pick(KEYWORDS, brand - 1), F.lit("_"), F.col("p_partkey").cast("string"), ext,
        )
        return self.table("part").select(
            F.col("p_partkey").alias("pk"),
            path.alias("path"),
            lookup({k: v[0] for k, v in LANG_EXT.items()}, first, "c").alias("lang"),
            "p_size",
            "p_name",
        )

    @cached_property
    def pair_stats(self) -> DataFrame:
        """One row per (part, supplier) pair: the function level."""
        return (
            self.table("lineitem")
            .groupBy("l_partkey", "l_suppkey")
            .agg(
                F.max("l_quantity").alias("q"),
                F.max(F.round(F.col("l_discount") * 100).cast("long")).alias("d"),
                F.max(F.round(F.col("l_tax") * 100).cast("long")).alias("t"),
                # The largest flag, as far as it matters: 1 for R. A largest string would be sorted for, a number is not.
                F.max(F.when(F.col("l_returnflag") > "R", 2).when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("flag"),
            )
        )

    @staticmethod
    def _fn_name(pk: Column, sk: Column) -> Column:
        own = F.floor(pk / PARTS_PER_SUPPLIER) == sk
        return F.when(own, F.concat(F.lit("entry_"), pk.cast("string"))).otherwise(
            F.concat(F.lit("handle_"), sk.cast("string"))
        )

    @staticmethod
    def _fn_id(path: Column, name: Column, sk: Column) -> Column:
        return F.concat(path, F.lit("::"), name, F.lit("#"), (sk + 1).cast("string"))

    @cached_property
    def functions(self) -> DataFrame:
        f = self.pair_stats.join(self.paths, F.col("l_partkey") == F.col("pk"))
        name = self._fn_name(F.col("pk"), F.col("l_suppkey"))
        return f.select(
            self._fn_id(F.col("path"), name, F.col("l_suppkey")).alias("id"),
            F.col("path").alias("file"),
            "lang",
            name.alias("name"),
            (F.col("l_suppkey") + 1).alias("line"),
            F.floor(F.col("q") + 12).cast("long").alias("loc"),
            (F.lit(1) + F.col("d") + F.col("t")).cast("long").alias("complexity"),
            F.when(F.col("flag") == 1, F.lit(None).cast("string")).otherwise(F.col("p_name")).alias("doc"),
            (F.col("pk") * 1000000 + F.col("l_suppkey")).alias("ord"),
        )

    @cached_property
    def files(self) -> DataFrame:
        per_file = self.pair_stats.groupBy("l_partkey").agg(
            F.count("*").alias("functions"), F.sum(F.lit(1) + F.col("d") + F.col("t")).cast("long").alias("complexity")
        )
        return self.paths.join(per_file, F.col("pk") == F.col("l_partkey"), "left").select(
            "path",
            "lang",
            (F.col("p_size") * 20).cast("long").alias("loc"),
            (F.col("p_size") * 640).cast("long").alias("size"),
            F.coalesce("functions", F.lit(0)).cast("long").alias("functions"),
            F.coalesce("complexity", F.lit(0)).cast("long").alias("complexity"),
            F.when(F.col("p_size") <= 35, F.col("p_name")).alias("doc"),
            (F.col("p_size") == 13).alias("has_parse_error"),
            F.col("pk").alias("ord"),
        )

    @cached_property
    def sizes(self) -> DataFrame:
        """`files` without what is counted over their functions, which costs a shuffle of the line items."""
        return self.paths.select("path", (F.col("p_size") * 20).cast("long").alias("loc"))

    @cached_property
    def _lines(self) -> DataFrame:
        """Line items with the part they point at; targets beyond the last part drop out in the joins."""
        return self.table("lineitem").withColumn(
            "target", F.col("l_suppkey") * PARTS_PER_SUPPLIER + F.col("l_linenumber")
        )

    @cached_property
    def imports(self) -> DataFrame:
        """One row per import statement, already resolved."""
        p, q = self.paths.alias("p"), self.paths.alias("q")
        return (
            self._lines.filter(F.col("l_partkey") != F.col("target"))
            .join(p, F.col("l_partkey") == F.col("p.pk"))
            .join(q, F.col("target") == F.col("q.pk"))
            .select(F.col("p.path").alias("file"), F.col("q.path").alias("resolved"))
        )

    @cached_property
    def calls(self) -> DataFrame:
        """Distinct call names of each function (caller id, file, callee name)."""
        sk, pk, ln = F.col("l_suppkey"), F.col("l_partkey"), F.col("l_linenumber")
        entry = F.coalesce(F.col("l_tax") >= 0.055, F.lit(False))
        # Made distinct as keys, which decide about the names; a caller or name without its supplier or line is null whatever the rest.
        keys = self.table("lineitem").select(
            pk, sk, F.when(sk.isNotNull(), ln).alias("l_linenumber"), (entry & sk.isNotNull() & ln.isNotNull()).alias("entry")
        ).distinct()
        callee = F.when(
            F.col("entry"), F.concat(F.lit("entry_"), (sk * PARTS_PER_SUPPLIER + ln).cast("string"))
        ).otherwise(F.concat(F.lit("handle_"), (sk + ln).cast("string")))
        # A path ends with its part's key, so parts share none but null.
        named = keys.join(self.paths.select("pk", "path").distinct(), pk == F.col("pk")).select(
            self._fn_id(F.col("path"), self._fn_name(pk, sk), sk).alias("caller_id"),
            F.col("path").alias("file"),
            callee.alias("name"),
        )
        return named.filter("file is not null").unionByName(named.filter("file is null").distinct())

    @cached_property
    def succ(self) -> DataFrame:
        """Functional graph: every part's most frequent target, ties to the smaller key."""
        pairs = (
            self._lines.filter(F.col("l_partkey") != F.col("target"))
            .join(self.paths.select(F.col("pk").alias("target")), "target", "left_semi")
            .groupBy("l_partkey", "target")
            .count()
        )
        best = F.max(F.struct(F.col("count"), (-F.col("target")).alias("neg"))).alias("m")
        return pairs.groupBy("l_partkey").agg(best).select(
            F.col("l_partkey").alias("src"), (-F.col("m.neg")).alias("dst")
        )

    @cached_property
    def part_edges(self) -> DataFrame:
        """Distinct part -> part edges of the whole line-item table."""
        return (
            self._lines.filter(F.col("l_partkey") != F.col("target"))
            .join(self.paths.select(F.col("pk").alias("target")), "target", "left_semi")
            .select(F.col("l_partkey").alias("src"), F.col("target").alias("dst"))
            .distinct()
        )

    @cached_property
    def routes(self) -> DataFrame:
        method = lookup(
            {"1-URGENT": "POST", "2-HIGH": "PUT", "3-MEDIUM": "GET", "4-NOT SPECIFIED": "DELETE"},
            F.col("o_orderpriority"), "PATCH",
        )
        framework = lookup({"O": "express", "F": "spring"}, F.col("o_orderstatus"), "django")
        return (
            self.table("orders")
            .join(self.paths, F.col("o_custkey") == F.col("pk"))
            .select(
                method.alias("method"),
                F.concat(F.lit("/api/"), pick(KEYWORDS, F.col("o_custkey")), F.lit("/:id")).alias("path"),
                framework.alias("framework"),
                F.col("path").alias("file"),
                (F.col("o_orderkey") + 1).alias("line"),
                F.col("o_orderkey").alias("ord"),
            )
        )

    @cached_property
    def db_access(self) -> DataFrame:
        mode = F.concat("l_returnflag", "l_linestatus")
        kind = F.when(F.col("l_discount") >= 0.095, "prisma").otherwise(
            lookup({"RF": "prisma", "RO": "sql", "AF": "prisma", "AO": "sql-write", "NF": "prisma"}, mode, "ddl-table")
        )
        op = F.when(F.col("l_discount") >= 0.095, "delete").otherwise(
            F.when(mode == "RF", "findMany").when(mode == "AF", "create").when(mode == "NF", "update")
        )
        return (
            self.table("lineitem")
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.paths, F.col("l_partkey") == F.col("pk"))
            .select(
                kind.alias("kind"),
                F.concat(pick(KEYWORDS, F.col("s_nationkey")), F.lit("s")).alias("table"),
                op.alias("op"),
                F.col("path").alias("file"),
                F.col("l_linenumber").cast("long").alias("line"),
                (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"),
            )
        )

    @cached_property
    def security(self) -> DataFrame:
        sev = F.when(F.col("l_tax") >= 0.065, "high").when(F.col("l_tax") >= 0.035, "medium").otherwise("low")
        return (
            self.table("lineitem")
            .filter(F.col("l_discount") >= 0.085)
            .join(self.paths, F.col("l_partkey") == F.col("pk"))
            .select(
                F.when(F.col("l_returnflag") == "R", "secret").otherwise("xss").alias("type"),
                sev.alias("severity"),
                F.col("path").alias("file"),
                F.col("l_linenumber").cast("long").alias("line"),
            )
        )

    @cached_property
    def dependencies(self) -> DataFrame:
        eco = lookup({"0": "npm", "1": "pip", "2": "go", "3": "maven"}, F.col("n_regionkey").cast("string"), "cargo")
        return (
            self.table("supplier")
            .join(F.broadcast(self.table("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.concat(pick(LIBS, F.col("s_suppkey")), F.lit("-"), F.col("s_suppkey").cast("string")).alias("name"),
                F.floor(F.col("s_acctbal")).cast("long").cast("string").alias("version"),
                F.when(F.col("s_acctbal") >= 0, "runtime").otherwise("dev").alias("scope"),
                eco.alias("ecosystem"),
                F.col("s_suppkey").alias("ord"),
            )
        )

    @cached_property
    def env(self) -> DataFrame:
        return (
            self.table("customer")
            .join(self.paths, F.col("c_custkey") == F.col("pk"))
            .select(
                F.concat(F.lit("APP_"), F.upper("c_mktsegment"), F.lit("_"), F.col("c_nationkey").cast("string")).alias("name"),
                F.col("path").alias("file"),
                (F.col("c_custkey") + 1).alias("line"),
                F.col("c_custkey").alias("ord"),
            )
        )

    @cached_property
    def jobs(self) -> DataFrame:
        return (
            self.table("events")
            .filter(F.col("event_type") == "error")
            .join(self.paths, F.col("user_id") == F.col("pk"))
            .select(F.lit("timer").alias("kind"), F.col("path").alias("file"), F.col("event_id").alias("ord"))
        )


def _sql_pick(values: list[str], index: str) -> str:
    return "list_extract([" + ",".join(f"'{v}'" for v in values) + f"], cast(({index}) % {len(values)} as int) + 1)"


def _sql_lookup(mapping: dict[str, str], key: str, default: str) -> str:
    return "case " + key + " " + " ".join(f"when '{k}' then '{v}'" for k, v in mapping.items()) + f" else '{default}' end"


_EXT = _sql_lookup({k: v[1] for k, v in LANG_EXT.items()}, "split_part(p_name,' ',1)", ".c")
_LANG = _sql_lookup({k: v[0] for k, v in LANG_EXT.items()}, "split_part(p_name,' ',1)", "c")
_LAYER = _sql_lookup(LAYER_DIR, "split_part(p_name,' ',2)", "misc")
_BRAND = r"cast(regexp_extract(p_brand,'([0-9]+)',1) as int)-1"
_FN_NAME = "case when l_partkey // 20 = l_suppkey then 'entry_' || l_partkey else 'handle_' || l_suppkey end"

PRELUDE = f"""
m_paths as (
  select p_partkey as pk, lower(p_type) || '/' || {_LAYER} || '/' || {_sql_pick(KEYWORDS, _BRAND)} || '_' || p_partkey || {_EXT} as path,
         {_LANG} as lang, p_size, p_name from part),
m_pairs as (
  select l_partkey, l_suppkey, max(l_quantity) q, max(cast(round(l_discount*100) as bigint)) d,
         max(cast(round(l_tax*100) as bigint)) t, max(l_returnflag) flag from lineitem group by all),
m_functions as (
  select path || '::' || ({_FN_NAME}) || '#' || (l_suppkey+1) as id, path as file, lang, {_FN_NAME} as name,
         l_suppkey + 1 as line, cast(floor(q+12) as bigint) as loc, 1 + d + t as complexity,
         case when flag = 'R' then null else p_name end as doc, pk*1000000 + l_suppkey as ord
  from m_pairs join m_paths on l_partkey = pk),
m_files as (
  select path, lang, cast(p_size*20 as bigint) loc, cast(p_size*640 as bigint) size,
         cast(coalesce(n,0) as bigint) as functions, cast(coalesce(cx,0) as bigint) as complexity,
         case when p_size <= 35 then p_name end as doc, p_size = 13 as has_parse_error, pk as ord
  from m_paths left join (select l_partkey, count(*) n, sum(1+d+t) cx from m_pairs group by 1) on pk = l_partkey),
m_lines as (select *, l_suppkey*20 + l_linenumber as target from lineitem),
m_imports as (
  select p.path as file, q.path as resolved from m_lines join m_paths p on l_partkey = p.pk join m_paths q on target = q.pk
  where l_partkey <> target),
m_calls as (
  select distinct path || '::' || ({_FN_NAME}) || '#' || (l_suppkey+1) as caller_id, path as file,
    case when l_tax >= 0.055 then 'entry_' || target else 'handle_' || (l_suppkey + l_linenumber) end as name
  from m_lines join m_paths on l_partkey = pk),
m_part_edges as (
  select distinct l_partkey as src, target as dst from m_lines where l_partkey <> target and target in (select pk from m_paths)),
m_succ as (
  select src, dst from (select src, dst, row_number() over (partition by src order by n desc, dst) r from (
    select l_partkey as src, target as dst, count(*) n from m_lines
    where l_partkey <> target and target in (select pk from m_paths) group by all)) where r = 1),
m_routes as (
  select case o_orderpriority when '1-URGENT' then 'POST' when '2-HIGH' then 'PUT' when '3-MEDIUM' then 'GET'
              when '4-NOT SPECIFIED' then 'DELETE' else 'PATCH' end as method,
         '/api/' || {_sql_pick(KEYWORDS, 'o_custkey')} || '/:id' as path,
         case o_orderstatus when 'O' then 'express' when 'F' then 'spring' else 'django' end as framework,
         m_paths.path as file, o_orderkey + 1 as line, o_orderkey as ord
  from orders join m_paths on o_custkey = pk),
m_db as (
  select case when l_discount >= 0.095 then 'prisma' else case l_returnflag || l_linestatus when 'RF' then 'prisma' when 'RO' then 'sql'
              when 'AF' then 'prisma' when 'AO' then 'sql-write' when 'NF' then 'prisma' else 'ddl-table' end end as kind,
         {_sql_pick(KEYWORDS, 's_nationkey')} || 's' as "table",
         case when l_discount >= 0.095 then 'delete' else case l_returnflag || l_linestatus when 'RF' then 'findMany'
              when 'AF' then 'create' when 'NF' then 'update' end end as op,
         path as file, cast(l_linenumber as bigint) as line, l_orderkey*100 + l_linenumber as ord
  from lineitem join supplier on l_suppkey = s_suppkey join m_paths on l_partkey = pk),
m_dbw as (
  select *, regexp_matches(lower(kind || ' ' || coalesce(op,'')), 'write|insert|update|delete|create|save|upsert|ddl') as is_write from m_db),
m_security as (
  select case when l_returnflag = 'R' then 'secret' else 'xss' end as type,
         case when l_tax >= 0.065 then 'high' when l_tax >= 0.035 then 'medium' else 'low' end as severity,
         path as file, cast(l_linenumber as bigint) as line
  from lineitem join m_paths on l_partkey = pk where l_discount >= 0.085),
m_deps as (
  select {_sql_pick(LIBS, 's_suppkey')} || '-' || s_suppkey as name, cast(cast(floor(s_acctbal) as bigint) as varchar) as version,
         case when s_acctbal >= 0 then 'runtime' else 'dev' end as scope,
         case n_regionkey when 0 then 'npm' when 1 then 'pip' when 2 then 'go' when 3 then 'maven' else 'cargo' end as ecosystem,
         s_suppkey as ord
  from supplier join nation on s_nationkey = n_nationkey),
m_env as (
  select 'APP_' || upper(c_mktsegment) || '_' || c_nationkey as name, path as file, c_custkey + 1 as line, c_custkey as ord
  from customer join m_paths on c_custkey = pk),
m_jobs as (
  select 'timer' as kind, path as file, event_id as ord from events join m_paths on user_id = pk where event_type = 'error')
"""


def oracle(body: str) -> str:
    """A query over the mapped relations; recursive bodies may add their own common tables."""
    return f"with recursive {PRELUDE.strip()}\n{body}"
