"""Offline retrieval: hashed-vector search, hybrid search, lexical ranking, substring search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.functions import vectors as V
from lithic.functions.text import base_name, js_round, lc
from lithic.session import spread

# Words ignored by lexical retrieval.
RETRIEVAL_STOP_WORDS = (
    "the a an is are of to in and or how does do what where which this that for on with i it "
    "explain me like work works used use uses get show find happens if delete file"
).split()
RETRIEVAL_LIMIT = 14
SEARCH_LIMIT = 20
HYBRID_LIMIT = 24
SIMILAR_LIMIT = 10


def vectorise(items: DataFrame, text: str = "text") -> DataFrame:
    """Add the token buckets with their counts and the squared norm of each item's text.

    No filter is put on these columns: the optimiser would push it below the projection and hash
    every text twice. Items without a token simply score zero.
    """
    return spread(items).withColumn("buckets", V.buckets(F.col(text))).withColumn("norm2", V.squared_norm(F.col("buckets")))


def embedding_index(items: DataFrame, text: str = "text") -> DataFrame:
    """Persisted form: (id, type, label, ref, bucket, weight), L2-normalised."""
    counted = vectorise(items, text).select(
        "id", "type", "label", "ref", "norm2", F.explode("buckets").alias("b")
    )
    return counted.select(
        "id", "type", "label", "ref", "b.bucket", (F.col("b.n") / F.sqrt(F.col("norm2"))).alias("weight")
    )


def cosine_score(counts: dict[int, int]) -> Column:
    """Cosine of the row's counts with a query's counts (at most 512 buckets, so a literal map)."""
    if not counts:
        return F.lit(0.0)
    query = F.create_map(*[F.lit(x) for b, n in sorted(counts.items()) for x in (b, n)]).cast("map<int,bigint>")
    norm2 = float(sum(n * n for n in counts.values()))
    dot = V.dot_with(F.col("buckets"), query).cast("double")
    return F.coalesce(F.try_divide(dot, F.sqrt(F.col("norm2").cast("double")) * F.sqrt(F.lit(norm2))), F.lit(0.0))


def _top(items: DataFrame, counts: dict[int, int], floor: float, limit: int, text: str) -> DataFrame:
    """Map-only scoring, bounded top-k, then the score threshold (safe after the limit: best first)."""
    scored = vectorise(items, text).withColumn("raw", cosine_score(counts))
    return (
        scored.select("id", "type", "label", "ref", "raw", js_round(F.col("raw"), 3).alias("score"))
        .orderBy(F.desc("score"), F.desc(F.col("raw") > floor), F.asc("id"))
        .limit(limit)
        .filter(F.col("raw") > floor)
        .select("id", "type", "label", "ref", "score")
    )


def semantic_search(
    items: DataFrame, query: str, limit: int = SEARCH_LIMIT, kind: str | None = None, text: str = "text"
) -> DataFrame:
    """Top items by cosine with the query text."""
    if kind is not None:
        items = items.filter(F.col("type") == kind)
    return _top(items, V.query_counts(query), 0.0, limit, text)


def index_search(index: DataFrame, query: str, limit: int = SEARCH_LIMIT, kind: str | None = None) -> DataFrame:
    """The ranking of `semantic_search` from a stored `embedding_index`: no text is read, and only the buckets of the query."""
    counts = V.query_counts(query)
    if not counts:
        return index.limit(0).select("id", "type", "label", "ref", F.lit(0.0).alias("score"))
    share = F.element_at(F.create_map(*[F.lit(x) for b, n in sorted(counts.items()) for x in (b, n / sum(v * v for v in counts.values()) ** 0.5)]), F.col("bucket").cast("int"))
    hits = index.filter(F.col("bucket").isin(list(counts)) & (F.lit(True) if kind is None else F.col("type") == kind))
    scored = hits.groupBy("id", "type", "label", "ref").agg(F.sum(F.col("weight") * share).alias("raw"))
    return scored.select("id", "type", "label", "ref", js_round(F.col("raw"), 3).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def similar_to(items: DataFrame, target_id, limit: int = SIMILAR_LIMIT, text: str = "text") -> DataFrame:
    """Items close to one item (cosine above 0.05). Only the target's bucket counts visit the driver."""
    row = vectorise(items.filter(F.col("id") == F.lit(target_id)), text).select(V.count_map(F.col("buckets"))).first()
    counts = dict(row[0]) if row and row[0] else {}
    return _top(items.filter(F.col("id") != F.lit(target_id)), counts, 0.05, limit, text)


def dense_similar(vectors: DataFrame, target_id, limit: int = SIMILAR_LIMIT) -> DataFrame:
    """The same ranking for stored dense vectors (id, label, vec), normalised here."""
    row = vectors.filter(F.col("id") == F.lit(target_id)).select("vec").first()
    if row is None:
        return vectors.limit(0).select("id", "label", F.lit(0.0).alias("score"))
    target = F.array(*[F.lit(float(x)) for x in row["vec"]])
    raw = V.dense_dot(F.col("vec"), target) / F.sqrt(
        V.dense_dot(F.col("vec"), F.col("vec")) * V.dense_dot(target, target)
    )
    return (
        vectors.filter(F.col("id") != F.lit(target_id))
        .select("id", "label", raw.alias("raw"), js_round(raw, 3).alias("score"))
        .orderBy(F.desc("score"), "id")
        .limit(limit)
        .filter("raw > 0.05")
        .select("id", "label", "score")
    )


def hybrid_search(
    items: DataFrame, query: str, limit: int = HYBRID_LIMIT, lexical: str = "hay", text: str = "text"
) -> DataFrame:
    """Vector hits first, then plain containment hits not already listed, at a flat 0.5."""
    vector_hits = semantic_search(items, query, limit, text=text).withColumn("stage", F.lit(0))
    # At most `limit` containment hits can repeat a vector hit, so twice the limit is enough of them;
    # the duplicates are then dropped among a few dozen rows.
    lexical_hits = (
        items.filter(lc(F.col(lexical)).contains(query.lower()))
        .select("id", "type", "label", "ref", F.lit(0.5).alias("score"), F.lit(1).alias("stage"))
        .orderBy("id")
        .limit(2 * limit)
    )
    first = Window.partitionBy("id").orderBy("stage")
    return (
        vector_hits.unionByName(lexical_hits)
        .withColumn("rn", F.row_number().over(first))
        .filter("rn = 1")
        .orderBy("stage", F.desc("score"), "id")
        .limit(limit)
        .select("id", "type", "label", "ref", "score", "stage")
    )


def query_terms(query: str) -> list[str]:
    import re

    return [t for t in re.findall(r"[a-z_][a-z0-9_]{2,}", query.lower()) if t not in RETRIEVAL_STOP_WORDS]


def field_score(text: Column, terms: list[str], query: str, boost: float) -> Column:
    """Count tokens of a field that are query terms, +5 for the whole phrase, times the boost."""
    toks = F.regexp_extract_all(lc(text), F.lit(r"([a-z_][a-z0-9_]{2,})"), F.lit(1))
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(terms)])
    hits = F.size(F.filter(toks, lambda t: F.array_contains(wanted, t)))
    if len(terms) > 1:
        hits = hits + F.when(lc(text).contains(query.lower()), F.lit(5)).otherwise(F.lit(0))
    return hits.cast("double") * F.lit(boost)


def lexical_retrieve(entities: DataFrame, query: str, boosts: dict[str, dict[str, float]], limit: int = RETRIEVAL_LIMIT) -> DataFrame:
    """Rank a union of entity kinds; `boosts[kind][column]` gives the weight of each text column."""
    terms = query_terms(query)
    if not terms:
        return entities.limit(0).select("type", "ref", "title", F.lit(0.0).alias("score"))
    total: Column = F.lit(0.0)
    for kind, fields in boosts.items():
        part: Column = F.lit(0.0)
        for column, boost in fields.items():
            part = part + field_score(F.col(column), terms, query, boost)
        total = F.when(F.col("type") == kind, part).otherwise(total)
    return (
        entities.withColumn("score", total)
        .filter("score > 0")
        .select("type", "ref", "title", "score")
        .orderBy(F.desc("score"), "type", "ref", "title")
        .limit(limit)
    )


def global_search(index: DataFrame, query: str, limit: int = 40) -> DataFrame:
    """All terms must occur in the name: 3 for a prefix, 1 inside, +5 exact, minus 0.002 per character."""
    terms = query.lower().split()
    if not terms:
        return index.limit(0).select("kind", "name", "meta", F.lit(0.0).alias("score"))
    name = lc(F.col("name"))
    keep: Column = F.lit(True)
    score: Column = F.lit(0)
    for t in terms:
        keep = keep & name.contains(t)
        score = score + F.when(name.startswith(t), F.lit(3)).otherwise(F.lit(1))
        score = score + F.when(name == t, F.lit(5)).otherwise(F.lit(0))
    return (
        index.filter(keep)
        .withColumn("score", js_round(score.cast("double") - F.length("name") * F.lit(0.002), 3))
        .select("kind", "name", "meta", "score")
        .orderBy(F.desc("score"), "kind", "name", "meta")
        .limit(limit)
    )


def palette_search(functions: DataFrame, files: DataFrame, tables: DataFrame, query: str) -> DataFrame:
    """Quick jump: at most 8 functions, 6 files and 5 tables whose name contains the query."""
    q = query.lower().strip()
    if len(q) < 2:
        return files.limit(0).select(F.lit("file").alias("kind"), F.col("path").alias("label"), F.lit("").alias("meta"))
    fn = functions.filter(lc(F.col("name")).contains(q)).orderBy("name", "file").limit(8).select(
        F.lit("function").alias("kind"), F.concat("name", F.lit("()")).alias("label"), base_name(F.col("file")).alias("meta")
    )
    fl = files.filter(lc(F.col("path")).contains(q)).orderBy("path").limit(6).select(
        F.lit("file").alias("kind"), base_name(F.col("path")).alias("label"), F.col("lang").alias("meta")
    )
    tb = tables.filter(lc(F.col("name")).contains(q)).orderBy("name").limit(5).select(
        F.lit("table").alias("kind"), F.col("name").alias("label"), F.lit("").alias("meta")
    )
    return fn.unionByName(fl).unionByName(tb)


# How many neighbours of each kind a seed may bring along, and the total.
CONTEXT_SEEDS, CONTEXT_BUDGET = 6, 10
CONTEXT_NEIGHBOURS = {"calls": 3, "called by": 3, "imports": 4, "imported by": 3, "written by": 3}


def context_neighbours(
    seeds: DataFrame, call_edges: DataFrame, imports: DataFrame, writers: DataFrame, budget: int | None = CONTEXT_BUDGET
) -> DataFrame:
    """(seed, relation, neighbour): the direct surroundings of the best evidence items.

    `seeds` is (type, id, score); only the first few are expanded, so that side of each join is a
    handful of rows, and the row-number filter prunes before the shuffle.
    """
    few = seeds.orderBy(F.desc("score"), "id").limit(CONTEXT_SEEDS).select("type", F.col("id").alias("seed"))
    links = imports.filter(F.col("resolved").isNotNull()).select(F.col("file").alias("a"), F.col("resolved").alias("b")).distinct()
    calls = call_edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    specs = [
        ("function", "calls", calls, "a", "b"), ("function", "called by", calls, "b", "a"), ("file", "imports", links, "a", "b"),
        ("file", "imported by", links, "b", "a"), ("table", "written by", writers.select(F.col("table").alias("a"), F.col("file").alias("b")).distinct(), "a", "b"),
    ]
    w = Window.partitionBy("seed", "relation").orderBy("neighbour")
    out = None
    for kind, relation, edges, at, to in specs:
        part = (
            edges.join(F.broadcast(few.filter(F.col("type") == kind).withColumnRenamed("seed", at)), at)  # at most six rows
            .select(F.col(at).alias("seed"), F.lit(relation).alias("relation"), F.col(to).alias("neighbour"))
            .filter("seed <> neighbour")
            .withColumn("rn", F.row_number().over(w))
            .filter(F.col("rn") <= CONTEXT_NEIGHBOURS[relation])
            .drop("rn")
        )
        out = part if out is None else out.unionByName(part)
    return out.orderBy("seed", "relation", "neighbour").limit(budget) if budget else out


def overview_text(counts: DataFrame, languages: DataFrame, flows: DataFrame) -> DataFrame:
    """One row of plain text that describes a repository, from its counts, languages and flows."""
    top = lambda df, c, n, order: df.orderBy(*order).limit(n).agg(F.array_join(F.array_sort(F.collect_list(c)), ", ")).scalar()
    langs = top(languages, F.concat("label", F.lit(" ("), F.col("files").cast("string"), F.lit(" files)")), 6, [F.desc("bytes"), "id"])
    names = top(flows, F.col("name"), 12, [F.desc("function_count"), "flow"])
    s = lambda c: F.col(c).cast("string")
    return counts.select(
        F.concat(
            F.lit("Languages: "), F.coalesce(F.nullif(langs, F.lit("")), F.lit("none")), F.lit("\nSize: "), s("files"), F.lit(" files, "), s("loc"), F.lit(" LOC, "), s("functions"),
            F.lit(" functions\nRoutes: "), s("routes"), F.lit(", tables: "), s("tables"), F.lit("\nFlows: "), F.coalesce(F.nullif(names, F.lit("")), F.lit("none")),
        ).alias("text")
    )
