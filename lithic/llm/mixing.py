"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations only.

* Targets: sources in code point order (null last) weigh 5, 2, 1 in turn and share `SHARE` times all words. A target
  stops at `CAP` times its source; the excess is shared again by weight until none is above.
* Schedule: slot i asks for the point frac(i * golden ratio). The targets, laid end to end, tell which source the point
  belongs to, so any stretch of the schedule holds the sources in nearly the wanted ratio.
* Blocks: the documents of a source, in the order of a hash of their id, form one stream of words, cut into blocks of
  `BLOCK` words, or of one word where the target is below `FINE` words, as blocks would be too coarse for it. Fine and coarse sources have a
  schedule each. The source's slots are ranked and take the blocks in turn, starting over after the last one; nothing
  is taken more than `CAP` times.

Running sums over a source are made from a range-partitioned sort, sums per partition and offsets, so a source with a
third of all rows is spread like any other. What the driver sees are single numbers.

Defined results: null and blank texts have size 0 and are never taken; a null source is a source; repeated rows are
mixed as separate documents; without words all targets are 0; extra columns pass through `mixed`; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lithic.llm.common import SPACE_CLASS, WORD_PATTERN, tasks_for
from lithic.session import cut

SHARE, CAP, WEIGHTS, BLOCK = 1.5, 2, (5, 2, 1), 64
GOLDEN = 0.6180339887498949
#: Words of a target from which on blocks are `BLOCK` words long.
FINE = 4096
#: Slots are numbered high * 2^20 + low; the fraction of 2^20 golden ratios keeps the digits that a product of doubles would lose.
HIGH = 0.6077874097403510


def running(df: DataFrame, by: list[str], order: list[str | Column], value: Column, name: str) -> DataFrame:
    """Add the sum of `value` over the earlier rows of the same `by`, without gathering a group in one task."""
    near = cut(df.withColumn("_v", value.cast("long")).repartitionByRange(tasks_for(df.sparkSession), *by, *order).withColumn("_p", F.spark_partition_id()))
    sums = near.groupBy(*by, "_p").agg(F.sum("_v").alias("_s"))
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "_p", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_o"))
    above = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = near.withColumn("_l", F.coalesce(F.sum("_v").over(above), F.lit(0)))
    return local.join(offsets, [*by, "_p"]).withColumn(name, F.col("_o") + F.col("_l")).drop("_p", "_v", "_o", "_l")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key): words of each row; `key` is equal for equal rows only."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in ("doc_id", "source", "text")]
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.md5(F.concat_ws("\x01", *parts)).alias("key"))


def targets(sized: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, src, source_size, target, quota, block, at): per source its ordinal, words, target, words of a block and place among all targets of such blocks."""
    spark = sized.sparkSession
    grouped = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("nil", F.col("source").isNull().cast("int")).withColumn("one", F.lit(1))
    placed = running(grouped, ["one"], ["nil", "source"], F.lit(1), "src")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("src") % len(WEIGHTS) + 1).cast("int")).cast("double")
    placed = cut(placed.select("source", "src", "source_size", weight.alias("w"), (F.col("source_size") * CAP).cast("double").alias("most")))
    level, before = 0.0, None
    while level != before:  # the level rises until no source is above its limit
        full = F.col("most") <= F.lit(level) * F.col("w")
        s = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)).alias("full"), F.sum(F.when(~full, F.col("w"))).alias("open")).first()
        before, level = level, max(level, (SHARE * s["all"] - s["full"]) / s["open"]) if s["open"] else level
    target = F.least("most", F.lit(level) * F.col("w"))
    quota = placed.select("source", "src", "source_size", F.round(target, 6).alias("target"), F.round(target).cast("long").alias("quota"))
    quota = quota.withColumn("block", F.when(F.col("quota") < FINE, F.lit(1)).otherwise(F.lit(block)).cast("long"))
    return cut(running(quota, ["block"], ["src"], F.col("quota"), "at"))


def point(slot: Column) -> Column:
    """The golden-ratio point of a slot, in [0, 1)."""
    high, low = F.shiftright(slot, 20).cast("double") * F.lit(HIGH), slot.bitwiseAND(F.lit((1 << 20) - 1)).cast("double") * F.lit(GOLDEN)
    return F.pmod(F.pmod(high, F.lit(1.0)) + F.pmod(low, F.lit(1.0)), F.lit(1.0))


def passes(goals: DataFrame) -> DataFrame:
    """(src, b, times): how often the schedules take block `b` of a source."""
    spark, found = goals.sparkSession, None
    for s in goals.filter("quota > 0").groupBy("block").agg(F.sum("quota").alias("all"), F.count(F.lit(1)).alias("n")).orderBy("block").collect():  # two rows at most
        width = max(1, -(-s["all"] // max(1024, 4 * s["n"])))
        slots = spark.range(-(-s["all"] // s["block"])).select("id", F.floor(point(F.col("id")) * F.lit(float(s["all"]))).cast("long").alias("p")).withColumn("cell", F.floor(F.col("p") / width))
        ends = F.col("at") + F.col("quota")
        own = goals.filter((F.col("quota") > 0) & (F.col("block") == s["block"]))
        cells = own.select("src", "source_size", "at", ends.alias("until"), F.explode(F.sequence(F.floor(F.col("at") / width), F.floor((ends - 1) / width))).alias("cell"))
        given = slots.join(cells, "cell").filter((F.col("p") >= F.col("at")) & (F.col("p") < F.col("until"))).select("src", "source_size", "id")
        ranked = running(given, ["src"], ["id"], F.lit(1), "r")
        blocks = F.ceil(F.col("source_size") / s["block"])
        taken = ranked.filter(F.col("r") < blocks * CAP).groupBy("src", (F.col("r") % blocks).alias("b")).agg(F.count(F.lit(1)).alias("times"))
        found = taken if found is None else found.unionByName(taken)
    return found if found is not None else goals.select("src", F.col("at").alias("b"), F.lit(0).cast("long").alias("times")).limit(0)


def schedule(sized: DataFrame, block: int = BLOCK) -> DataFrame:
    """`sizes` rows with source_size, target, and first, second: words taken in the first and the second pass."""
    goals = targets(sized, block)
    known = sized.withColumn("turn", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).join(
        goals.select(F.col("source").alias("_source"), "src", "source_size", "target", "block"), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    placed = cut(running(known, ["src"], ["turn", "size", "key"], F.col("size"), "start"))
    end, width = F.col("start") + F.col("size"), F.col("block")
    touched = placed.filter("size > 0").select("src", "start", "block", end.alias("until"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((end - 1) / width))).alias("b"))
    words = F.least(F.col("until"), (F.col("b") + 1) * width) - F.greatest(F.col("start"), F.col("b") * width)
    taken = touched.join(passes(goals), ["src", "b"]).groupBy("src", "start").agg(*(F.sum(F.when(F.col("times") >= k, words).otherwise(0)).alias(n) for k, n in ((1, "first"), (2, "second"))))
    some = F.col("size") > 0
    back = placed.join(taken.withColumn("some", F.lit(True)), (placed.src == taken.src) & (placed.start == taken.start) & some, "left")
    return back.select("doc_id", "key", "size", "source_size", "target", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("first", "second")))


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row."""
    return schedule(cut(sizes(docs)), block).select("doc_id", "size", "source_size", "target", (F.col("first") + F.col("second")).alias("taken"))


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mixed corpus: a row of `docs` per pass that takes words of it, its text cut to the words taken.

    Rows that are equal in doc_id, source and text are one row that may be taken more often. Texts are dealt out once, by that key, for both.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in ("doc_id", "source", "text")]
    taken = schedule(cut(sizes(docs)), block).select("key", "size", F.explode(F.array("first", "second")).alias("words")).filter("words > 0")
    rows = docs.withColumn("_key", F.md5(F.concat_ws("\x01", *parts))).dropDuplicates(["_key"])
    words = F.split("text", f"(?<=[^{SPACE_CLASS}])(?=[{SPACE_CLASS}])")
    part = F.when(F.col("_words") == F.col("_size"), F.col("text")).otherwise(F.array_join(F.slice(words, 1, F.col("_words").cast("int")), ""))
    joined = rows.join(taken.select(F.col("key").alias("_key"), F.col("size").alias("_size"), F.col("words").alias("_words")), "_key")
    return joined.withColumn("text", part).select(*docs.columns)


SQL = f"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM sized GROUP BY source),
w AS (SELECT *, [{", ".join(f"{x}.0" for x in WEIGHTS)}][src % {len(WEIGHTS)} + 1] AS w, {CAP}.0::DOUBLE * source_size AS most FROM src),
ordered AS (SELECT *, {SHARE}::DOUBLE * sum(source_size) OVER () AS pot, coalesce(sum(most) OVER before, 0.0) AS full_words, sum(w) OVER rest AS open_weight FROM w
  WINDOW before AS (ORDER BY most / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rest AS (ORDER BY most / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (SELECT arg_min((pot - full_words) / open_weight, most / w) AS level FROM ordered WHERE (pot - full_words) / open_weight <= most / w),
goal AS (SELECT source, src, source_size, least(most, level * w) AS target FROM w, level),
quota AS (SELECT *, round(target)::BIGINT AS quota, CASE WHEN round(target) < {FINE} THEN 1 ELSE {BLOCK} END::BIGINT AS width FROM goal),
laid AS (SELECT *, ceil(source_size / width)::BIGINT AS blocks, (sum(quota) OVER (PARTITION BY width ORDER BY src) - quota)::BIGINT AS lead, (sum(quota) OVER (PARTITION BY width))::BIGINT AS total FROM quota),
slots AS (SELECT width, i, floor((((i >> 20) * {HIGH}::DOUBLE % 1.0::DOUBLE + (i & 1048575) * {GOLDEN}::DOUBLE % 1.0::DOUBLE) % 1.0::DOUBLE) * e)::BIGINT AS p
  FROM (SELECT width, unnest(range(ceil(e / width)::BIGINT)) AS i, e FROM (SELECT width, max(total) AS e FROM laid GROUP BY width))),
given AS (SELECT src, blocks, row_number() OVER (PARTITION BY src ORDER BY i) - 1 AS r FROM slots JOIN laid ON slots.width = laid.width AND p >= lead AND p < lead + quota),
times AS (SELECT src, r % blocks AS b, count(*) AS times FROM given WHERE r < {CAP} * blocks GROUP BY ALL),
placed AS (SELECT doc_id, size, src, source_size, target, width, sum(size) OVER (PARTITION BY src ORDER BY md5(doc_id::VARCHAR), size ROWS UNBOUNDED PRECEDING) - size AS start FROM sized JOIN quota ON sized.source IS NOT DISTINCT FROM quota.source),
touched AS (SELECT *, unnest(range((start // width)::BIGINT, ((start + size - 1) // width)::BIGINT + 1)) AS b FROM placed WHERE size > 0),
taken AS (SELECT doc_id, sum((least(start + size, (b + 1) * width) - greatest(start, b * width)) * times) AS taken FROM touched JOIN times USING (src, b) GROUP BY doc_id)
SELECT doc_id, size, source_size, round(target, 6) AS target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN taken USING (doc_id)
"""
