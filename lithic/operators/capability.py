"""Capabilities, the systems they form, and the product views built on them.

Everything after the evidence relation is aggregated per capability, a table as long as the taxonomy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.functions import rules
from lithic.functions import taxonomy as T
from lithic.functions.text import base_name, clamp01, js_round, lc, path_tokens
from lithic.operators.resolve import label_ends
from lithic.session import cut


def _matches(df: DataFrame, caps, signal: str, hay: Column, item: Column, file: Column, tokens: bool = False) -> DataFrame:
    """Rows (cap, signal, item, file, hits): needles found in a text, or equal to one of its distinct tokens.

    The taxonomy travels inside the expression, so matching is a projection and not a join. Words are looked for first, and only
    those that are found are turned into capabilities.
    """
    owners: dict[str, list[str]] = {}
    for c in caps:
        words = [w.lower() for w in c.needles.get(signal, [])]
        for w in dict.fromkeys(words) if tokens else words:
            owners.setdefault(w, []).append(c.id)
    if not owners:
        return df.limit(0).select(F.lit("").alias("cap"), F.lit(signal).alias("signal"), item.alias("item"), file.alias("file"), F.lit(0).alias("hits"))
    of = F.create_map(*[x for w, ids in owners.items() for x in (F.lit(w), F.array(*map(F.lit, ids)))])
    words = F.filter(hay, lambda t: t.isin(list(owners))) if tokens else F.filter(F.array(*map(F.lit, owners)), lambda w: F.contains(hay, w))
    own = df.select(F.flatten(F.transform(words, lambda w: F.element_at(of, w))).alias("own"), item.alias("item"), file.alias("file"))
    hits = F.transform(F.array_distinct("own"), lambda c: F.struct(c.alias("cap"), F.size(F.filter("own", lambda x: x == c)).alias("hits")))
    return own.select(F.explode(hits).alias("m"), "item", "file").select("m.cap", F.lit(signal).alias("signal"), "item", "file", "m.hits")


def _matches_once(df: DataFrame, caps, signal: str, text: str, item: Column) -> DataFrame:
    """`_matches` in a text that many rows of many files share: each distinct text is looked at once, and joined to its rows."""
    found = _matches(df.select(text).distinct(), caps, signal, lc(F.col(text)), F.col(text), F.lit(None).cast("string"))
    return df.join(found.select("cap", "signal", F.col("item").alias(text), "hits"), text).select("cap", "signal", item.alias("item"), "file", "hits")


def evidence(files, functions, classes, routes, db, deps, env, caps: list[T.Capability]) -> DataFrame:
    """(cap, signal, item, file, hits, is_test, points) with points in thousandths."""
    toks = F.array_distinct(F.concat(path_tokens(base_name(F.col("path"))), F.split(F.lower("path"), "/")))
    none = F.lit(None).cast("string")
    tables = db.filter(F.col("table").isNotNull()).select("table").distinct()
    parts = [
        _matches(files, caps, "name", toks, F.col("path"), F.col("path"), tokens=True),
        # Names and routes that hold no needle are gone before the others are made distinct.
        _matches_once(functions.select("name", "file"), caps, "symbol", "name", F.col("name")).distinct(),
        _matches_once(classes.select("name", "file"), caps, "symbol", "name", F.col("name")),
        _matches_once(routes.select("method", "path", "file"), caps, "route", "path", F.struct("method", "path")).distinct()
        .withColumn("item", F.concat_ws(" ", "item.method", "item.path")),
        _matches(tables, caps, "table", lc(F.col("table")), F.col("table"), none),
        _matches(deps.select("name").distinct(), caps, "dep", lc(F.col("name")), F.col("name"), none),
        _matches(env.select("name").distinct(), caps, "env", lc(F.col("name")), F.col("name"), none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    is_test = F.coalesce(rules.is_capability_test(F.col("file")), F.lit(False))
    full = None
    for s, pts in T.POINTS.items():
        full = F.when(F.col("signal") == s, pts) if full is None else full.when(F.col("signal") == s, pts)
    full = full * F.when(F.col("signal") == "name", F.least(F.col("hits"), F.lit(2))).otherwise(1)
    return out.withColumn("is_test", is_test).withColumn(
        "points", F.when(F.col("is_test"), F.floor(full * T.TEST_SHARE + 0.5)).otherwise(full).cast("bigint")
    )


def evidence_files(ev: DataFrame, db: DataFrame) -> DataFrame:
    """Distinct (cap, file, is_test): files of the evidence and the users of matched tables.

    Reading and writing are users alike; whether a file is a test is asked once a pair, after these are distinct.
    """
    direct = ev.filter(F.col("file").isNotNull()).select("cap", "file")
    users = db.filter(F.col("table").isNotNull()).select("table", "file").distinct()
    via = ev.filter(F.col("signal") == "table").select("cap", F.col("item").alias("table")).join(users, "table").select("cap", "file")
    return direct.unionByName(via).distinct().withColumn("is_test", rules.is_capability_test(F.col("file")))


def capabilities(ev: DataFrame, ev_files: DataFrame, files: DataFrame, caps: list[T.Capability]) -> DataFrame:
    """(id, label, kind, kind_rank, ord, confidence, confidence_label, score, signals, file_count, counts.., loc)."""
    n = lambda s, c="item": F.count_if((F.col("signal") == s) & ~F.col("is_test")).alias(c)
    per = ev.groupBy("cap").agg(
        (F.sum("points") / 1000).alias("score"), n("route", "routes"), n("table", "tables"), n("dep", "deps"), n("symbol", "symbols"), n("env", "env")
    )
    spread = ev_files.groupBy("cap").agg(F.count_if(~F.col("is_test")).alias("impl"), F.count("*").alias("all_files"))
    chosen = ev_files.join(spread.select("cap", (F.col("impl") > 0).alias("has_impl")), "cap").filter(~F.col("has_impl") | ~F.col("is_test"))
    sizes = chosen.join(files.select(F.col("path").alias("file"), "loc"), "file", "left").groupBy("cap").agg(
        F.count("*").alias("file_count"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc")
    )
    c = F.col
    j = per.join(spread, "cap", "left").join(sizes, "cap", "left").fillna(0, ["impl", "all_files", "file_count", "loc"])
    flag = lambda x: F.when(c(x) > 0, 1).otherwise(0)
    j = j.withColumn("signals", sum((flag(x) for x in ["routes", "tables", "deps", "symbols", "env"]), flag("impl")))
    boost = (
        F.when(c("deps") > 0, 0.25).otherwise(0.0) + F.when(c("tables") > 0, 0.12).otherwise(0.0)
        + F.when(c("routes") > 0, 0.12).otherwise(0.0) + F.when(c("signals") >= 3, 0.15).otherwise(0.0)
    )
    conf = F.least(F.lit(0.98), (1 - F.exp(-c("score") / 9)) * 0.7 + boost)
    conf = F.when(c("signals") < 2, F.least(conf, F.lit(0.4))).otherwise(conf)
    share = F.coalesce(F.try_divide(c("impl"), c("all_files")), F.lit(1.0))
    conf = F.when(share < 0.34, F.least(conf, F.lit(0.45))).otherwise(conf)
    kept = j.filter(
        (c("score") > 0) & (c("impl") + c("routes") + c("tables") + c("deps") >= 2) & ((c("impl") > 0) | (c("deps") > 0))
    ).withColumn("raw", conf)
    meta = files.sparkSession.createDataFrame(
        [(x.id, x.label, x.kind, T.KIND_RANK[x.kind], i, x.why, x.users) for i, x in enumerate(caps)],
        "cap string, label string, kind string, kind_rank int, ord int, why string, users array<string>",
    )
    return kept.join(F.broadcast(meta), "cap").select(  # as long as the taxonomy
        c("cap").alias("id"), "label", "kind", "kind_rank", "ord", "why", "users", js_round(c("raw"), 2).alias("confidence"),
        rules.confidence_word(c("raw")).alias("confidence_label"), js_round(c("score"), 1).alias("score"), "signals", "file_count",
        "routes", "tables", "deps", "symbols", "env", "loc",
    )


#: Entries of the evidence lists of a capability.
LISTED = {"files": 60, "routes": 20, "tables": 20, "deps": 20, "symbols": 24, "env": 12}


def evidence_lists(caps: DataFrame, ev: DataFrame, ev_files: DataFrame, listed: dict[str, int] = LISTED) -> DataFrame:
    """(id, files, routes, tables, deps, symbols, env): what each capability is claimed from, in the order of the names.

    Files are those that are no tests, or all if there are no others. The first entries of a list are chosen by a pruned window, which
    drops the rest of a key in each task before anything is shuffled.
    """
    one = ev.filter(~F.col("is_test") & (F.col("signal") != "name")).select("cap", F.concat(F.col("signal"), F.when(F.col("signal") == "env", "").otherwise("s")).alias("list"), "item")
    has = ev_files.groupBy("cap").agg(F.max(~F.col("is_test")).alias("has_impl"))
    files = ev_files.join(has, "cap").filter(~F.col("has_impl") | ~F.col("is_test")).select("cap", F.lit("files").alias("list"), F.col("file").alias("item"))
    lists = one.unionByName(files).distinct()
    most = None
    for name, n in listed.items():
        most = F.when(F.col("list") == name, n) if most is None else most.when(F.col("list") == name, n)
    rank = F.row_number().over(Window.partitionBy("cap", "list").orderBy("item"))
    first = lists.withColumn("rank", rank).filter(F.col("rank") <= max(listed.values())).filter(F.col("rank") <= most)
    of = lambda name: F.transform(F.sort_array(F.collect_list(F.when(F.col("list") == name, F.struct("rank", "item")))), lambda x: x["item"]).alias(name)
    return caps.select(F.col("id").alias("cap")).join(first, "cap").groupBy(F.col("cap").alias("id")).agg(*map(of, listed))


def kinds(caps: DataFrame) -> DataFrame:
    """(kind, capabilities, confident, confident_share): the split by kind, and how many are confident."""
    sure = F.count_if(F.col("confidence") >= 0.75)
    return caps.groupBy("kind").agg(F.count("*").alias("capabilities"), sure.alias("confident"), (sure / F.count("*")).alias("confident_share"))


def owners(caps: DataFrame, ev_files: DataFrame) -> DataFrame:
    """(file, owner): the capability with the smallest kind rank minus confidence."""
    ranked = ev_files.join(F.broadcast(caps.select(F.col("id").alias("cap"), "kind_rank", "confidence", "ord")), "cap")
    key = F.struct((F.col("kind_rank") - F.col("confidence")).alias("r"), "kind_rank", (-F.col("confidence")).alias("c"), "ord")
    return ranked.groupBy("file").agg(F.min_by("cap", key).alias("owner"))


def system_edges(caps: DataFrame, own: DataFrame, imports: DataFrame, call_edges: DataFrame, functions: DataFrame, db: DataFrame) -> DataFrame:
    """(source, target, strength, imports, calls, reads, why, templated) between owning systems."""
    a, b = own.select(F.col("file").alias("fa"), F.col("owner").alias("source")), own.select(F.col("file").alias("fb"), F.col("owner").alias("target"))
    # A few rows each, written at once: the shuffles of one kind are gone before the next is counted.
    counted = lambda df, t: cut(df.filter("source <> target").groupBy("source", "target").agg(F.count("*").alias("n")).withColumn("type", F.lit(t)))
    imp = counted(imports.filter(F.col("resolved").isNotNull()).select(F.col("file").alias("fa"), F.col("resolved").alias("fb")).join(a, "fa").join(b, "fb"), "imports")
    # Functions meet their owners once, and the calls meet owners, which are short.
    owned = functions.select("id", "file").join(own.select("file", F.col("owner").alias("label")), "file").select("id", "label")
    calls = counted(label_ends(call_edges, owned, "source", "target"), "calls")
    # Owners per table and role are distinct first, so the pairing is bounded by the taxonomy squared per table. Each task has few of them, so files need not be distinct before.
    hits = db.filter(F.col("table").isNotNull()).select("table", "file", rules.is_write(F.col("kind"), F.col("op")).alias("is_write"))
    used = cut(hits.join(own, "file").select("table", "is_write", "owner").distinct())
    hand = counted(
        used.filter("not is_write").select("table", F.col("owner").alias("source"))
        .join(used.filter("is_write").select("table", F.col("owner").alias("target")), "table"),
        "reads",
    )
    of = lambda t: F.coalesce(F.sum(F.when(F.col("type") == t, F.col("n"))), F.lit(0)).alias(t)
    e = imp.unionByName(calls).unionByName(hand).groupBy("source", "target").agg(F.sum("n").alias("strength"), of("imports"), of("calls"), of("reads"))
    label = lambda side: caps.select(F.col("id").alias(side), F.col("label").alias(side + "_label"))
    e = e.filter("strength >= 2 or reads > 0").join(F.broadcast(label("source")), "source").join(F.broadcast(label("target")), "target")
    template = F.lit(None).cast("string")
    for (x, y), why in T.WHY.items():
        template = F.when((F.col("source") == x) & (F.col("target") == y), why).otherwise(template)
    s, t = F.col("source_label"), F.col("target_label")
    factual = (
        F.when(F.col("reads") > 0, F.concat(s, F.lit(" reads data owned by "), t, F.lit(".")))
        .when(F.col("calls") > 0, F.concat(s, F.lit(" invokes functionality implemented in "), t, F.lit(".")))
        .when(F.col("imports") > 0, F.concat(s, F.lit(" builds on modules provided by "), t, F.lit(".")))
        .otherwise(F.concat(s, F.lit(" is connected to "), t, F.lit(".")))
    )
    return e.select("source", "target", "strength", "imports", "calls", "reads", F.coalesce(template, factual).alias("why"), template.isNotNull().alias("templated"))


def spine(caps: DataFrame, edges: DataFrame) -> DataFrame:
    """(position, id, label): business systems, fewest dependants first."""
    biz = caps.filter(F.col("kind") == "business")
    ids = biz.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    indeg = inside.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("indegree"))
    order = Window.orderBy("indegree", F.desc("confidence"), "ord")  # at most one row per business capability
    return biz.join(indeg, "id", "left").fillna(0, ["indegree"]).select(F.row_number().over(order).alias("position"), "id", "label", "indegree")


def degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("id"), "strength").union(edges.select("target", "strength"))
    return ends.groupBy("id").agg(F.sum("strength").alias("degree"))


def journeys(caps: DataFrame) -> DataFrame:
    """(id, label, persona, steps, coverage, confidence): templates of which at least two steps exist."""
    rows = [(j, l, p, i, s, len(steps)) for j, l, p, steps in T.JOURNEYS for i, s in enumerate(steps)]
    steps = caps.sparkSession.createDataFrame(rows, "journey string, jlabel string, persona string, i int, id string, total int")
    hit = steps.join(caps.filter(F.col("confidence") >= 0.28).select("id", "confidence"), "id")
    # Confidence has two decimals, so its sum is taken in whole hundredths.
    cents = F.sum(F.round(F.col("confidence") * 100).cast("bigint"))
    return hit.groupBy("journey", "jlabel", "persona", "total").agg(F.count("*").alias("steps"), cents.alias("cents")).filter("steps >= 2").select(
        F.col("journey").alias("id"), F.col("jlabel").alias("label"), "persona", "steps",
        js_round(F.col("steps") / F.col("total") * 100).alias("coverage"), js_round(F.col("cents") / F.col("steps") / 100, 2).alias("confidence"),
    )


def stories(caps: DataFrame, edges: DataFrame, ev_files: DataFrame, risk: DataFrame) -> DataFrame:
    """(id, label, value, dependencies, consumers, risky_files) for the visible systems."""
    shown = caps.filter((F.col("confidence") >= 0.4) & F.col("kind").isin("business", "integration", "infrastructure"))
    out = edges.groupBy(F.col("source").alias("id")).agg(F.least(F.count("*"), F.lit(6)).alias("dependencies"))
    inc = edges.groupBy(F.col("target").alias("id")).agg(F.least(F.count("*"), F.lit(6)).alias("consumers"))
    risky = ev_files.filter("not is_test").join(risk.select(F.col("path").alias("file"), "risk"), "file").groupBy(F.col("cap").alias("id")).agg(
        F.least(F.count("*"), F.lit(3)).alias("risky_files"), F.max("risk").alias("top_risk")
    )
    user = F.coalesce(F.get(F.col("users"), F.lit(0)), F.lit("users"))
    value = (
        F.when(F.col("kind") == "business", F.concat(F.lit('Directly delivers "'), "label", F.lit('" to '), user, F.lit(".")))
        .when(F.col("kind") == "integration", F.concat(F.lit("Connects the product to an external "), F.lower("label"), F.lit(" system.")))
        .otherwise(F.concat(F.lit("Operational backbone enabling "), F.lower("label"), F.lit(".")))
    )
    return (
        shown.join(out, "id", "left").join(inc, "id", "left").join(risky, "id", "left").fillna(0, ["dependencies", "consumers", "risky_files", "top_risk"])
        .select("id", "label", value.alias("value"), "dependencies", "consumers", "risky_files", "top_risk")
    )


def capability_map(caps: DataFrame, ev_files: DataFrame, files: DataFrame) -> DataFrame:
    """(id, dir, files, loc, rank): implementation files by their folder, the eight largest per capability."""
    impl = ev_files.join(caps.filter(F.col("confidence") >= 0.28).select(F.col("id").alias("cap")), "cap", "left_semi").filter(~rules.is_product_test(F.col("file")))
    segs = F.split("file", "/")
    seg = F.when(F.size(segs) > 1, F.element_at(segs, -2)).otherwise(segs[0])
    per = impl.join(files.select(F.col("path").alias("file"), "loc"), "file", "left").groupBy("cap", seg.alias("dir")).agg(
        F.count("*").alias("files"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc")
    )
    w = Window.partitionBy("cap").orderBy(F.desc("files"), "dir")
    return per.withColumn("rank", F.row_number().over(w)).filter("rank <= 8").select(F.col("cap").alias("id"), "dir", "files", "loc", "rank")


def product_overview(caps: DataFrame, files: DataFrame, n_routes: Column, n_tables: Column) -> DataFrame:
    """One row: product type, confidence, core and possible features."""
    ui = files.filter(F.col("path").rlike(r"\.(vue|jsx|tsx|svelte)$") | F.lower("path").rlike(r"(^|/)(components?|pages?|views?)(/|$)"))
    biz = (F.col("kind") == "business") & (F.col("confidence") >= 0.5)
    f = caps.agg(
        F.count_if(biz).alias("core"), F.count_if((F.col("kind") == "business") & F.col("confidence").between(0.28, 0.499)).alias("possible"),
        F.count_if((F.col("kind") == "integration") & (F.col("confidence") >= 0.5)).alias("integrations"),
        F.count_if(F.col("id") == "api-layer").alias("api_layer"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(biz, F.col("users")))))).alias("audiences"),
    )
    f = f.withColumn("routes", n_routes).withColumn("tables", n_tables).withColumn("ui", ui.agg(F.count("*")).scalar())
    r, t, u = F.col("routes") > 0, F.col("tables") > 0, F.col("ui") > 0
    both = lambda t, c: F.struct(F.lit(t).alias("t"), F.lit(c).alias("c"))
    kind = (
        F.when(r & t & u, both("full-stack web application", 0.7))
        .when(r & t, both("backend web service with a database", 0.68))
        .when(r, both("web service / API", 0.6))
        .when(u, both("front-end application", 0.55))
        .when((F.col("core") == 0) & (F.col("api_layer") > 0), both("library or framework", 0.5))
        .otherwise(both("software application", 0.4))
    )
    conf = F.when(F.col("core") > 0, F.least(F.lit(0.9), F.col("core") * 0.08 + 0.4)).otherwise(0.3)
    return f.select(kind["t"].alias("product_type"), kind["c"].alias("type_confidence"), "core", "possible", "integrations", "audiences", js_round(conf, 2).alias("confidence"))


def scorecard(caps: DataFrame, edges: DataFrame, ev_files: DataFrame, health: DataFrame, n_files: Column) -> DataFrame:
    """(key, value): nine product scores and the overall mean."""
    shared = ev_files.join(caps.select(F.col("id").alias("cap")), "cap", "left_semi").groupBy("file").agg(F.count("*").alias("n"))
    sh = shared.agg(F.count("*").alias("n"), F.count_if(F.col("n") > 1).alias("s"))
    biz = caps.filter((F.col("kind") == "business") & (F.col("confidence") >= 0.5))
    ids = biz.select("id")
    cross = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    h = lambda k: health.filter(F.col("key") == k).select("value").scalar()
    f = biz.agg(F.count("*").alias("biz"), F.count_if(F.col("file_count") >= 3).alias("cohesive"))
    f = f.withColumn("n", sh.select("n").scalar()).withColumn("s", sh.select("s").scalar()).withColumn("cross", cross.agg(F.count("*")).scalar()).withColumn("files", n_files)
    for k in ("architecture", "coupling", "documentation", "testing", "maintainability"):
        f = f.withColumn(k, h(k))
    c = F.col
    sep = clamp01(1 - c("s") / F.greatest(c("n"), F.lit(1)))
    modular = clamp01(F.when(c("biz") > 0, c("cohesive") / F.greatest(c("biz"), F.lit(1))).otherwise(0.3))
    decoupled = clamp01(1 - c("cross") / F.greatest(c("biz") * 2, F.lit(4)))
    ready = clamp01(c("documentation") / 100 * 0.4 + sep * 0.3 + c("testing") / 100 * 0.3)
    onboard = clamp01(
        1 - (F.when(c("files") > 400, 0.3).otherwise(0.0) + F.when(c("cross") > c("biz") * 2, 0.2).otherwise(0.0) + (100 - c("documentation")) / 100 * 0.3)
    )
    vals = {
        "architectureMaturity": c("architecture").cast("double"), "businessModularity": js_round(modular * 100), "technicalModularity": c("coupling").cast("double"),
        "domainSeparation": js_round(sep * 100), "featureCoupling": js_round(decoupled * 100), "aiReadiness": js_round(ready * 100),
        "documentation": c("documentation").cast("double"), "maintainability": c("maintainability").cast("double"), "onboarding": js_round(onboard * 100),
    }
    rows = f.select(*[v.alias(k) for k, v in vals.items()])
    keys = list(vals)
    mean = js_round(sum((c(k) for k in keys[1:]), c(keys[0])) / len(keys))
    cells = [F.struct(F.lit(k).alias("key"), c(k).cast("bigint").alias("value")) for k in keys]
    cells.append(F.struct(F.lit("overall").alias("key"), mean.cast("bigint").alias("value")))
    return rows.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def weakest(scores: DataFrame, n: int = 3) -> DataFrame:
    return scores.filter(F.col("key") != "overall").orderBy("value", "key").limit(n)


def tour(caps: DataFrame, edges: DataFrame, loc: Column, limit: int = 12) -> DataFrame:
    """(order, id, label, degree, minutes): guided reading order of the systems."""
    c = F.col
    learn = (
        F.when((c("kind") == "cross-cutting") & c("id").contains("config"), 0).when(c("kind") == "infrastructure", 1).when(c("id") == "auth", 2)
        .when(c("id") == "data-access", 3).when(c("kind") == "business", 4).when(c("kind") == "integration", 6).when(c("kind") == "technical", 7).otherwise(5)
    )
    ranked = caps.filter(c("confidence") >= 0.4).join(degree(edges), "id", "left").fillna(0, ["degree"]).withColumn("learn", learn)
    order = ["learn", F.desc("degree"), F.desc("confidence"), "ord"]
    top = ranked.orderBy(*order).limit(limit)
    stops = top.agg(F.count("*")).scalar()
    return top.select(
        F.row_number().over(Window.orderBy(*order)).alias("order"), "id", "label", "degree", js_round(F.least(loc / 300 + stops * 3.5, F.lit(90.0))).alias("minutes")
    )
