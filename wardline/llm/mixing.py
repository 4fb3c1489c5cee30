"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule has the golden-ratio point frac(i * g) (a Weyl sequence in 32-bit integers), which falls into one
source's part of the cumulative targets. Every stretch of the schedule so holds each source in proportion, without chance.
The r-th slot of a source takes the r-th block of equal size of that source's shuffled documents, laid end to end and
started again when they are used up. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm import common

#: 2**32 divided by the golden ratio, the multiplier of the Weyl sequence.
GOLDEN = 2654435769
POINTS = 1 << 32
CELL_BITS = 22
#: Slots ranked together.
RANKED = 1 << 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, limit: int = 3) -> DataFrame:
    """(source, src, source_size, target) per source; weights 1, 2, 3 repeat in code point order, a null source comes last.

    The sum of all sizes is shared by weight; a target stops at `limit` times the source's size and what is left over is
    shared by weight among the others. In order of size per weight the stopped sources come first: the level of the rest is
    what remains divided by their weights, and the first source it does not exceed ends the search.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = total.withColumn("src", F.row_number().over(one) - 1).withColumn("weight", F.col("src") % 3 + 1)
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), "src")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("left", (F.sum("source_size").over(everything) - limit * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double"))
    s = s.withColumn("level", F.col("left") / F.sum("weight").over(after))
    free = limit * F.col("source_size") >= F.col("level") * F.col("weight")
    s = s.withColumn("free_from", F.min(F.when(free, F.struct(F.col("source_size") / F.col("weight"), "src", "level"))).over(everything))
    target = F.least((limit * F.col("source_size")).cast("double"), F.coalesce(F.col("free_from.level"), F.lit(0.0)) * F.col("weight"))
    return s.select("source", "src", "source_size", target.alias("target"))


def parts(targets: DataFrame) -> DataFrame:
    """Each source's part [lo, hi) of the points, in proportion to its target."""
    mills = F.floor(F.col("target") * 1000)
    upto = F.sum(mills).over(Window.orderBy("src"))
    every = F.sum(mills).over(Window.partitionBy())
    at = lambda c: F.floor(c / every * F.lit(float(POINTS)))
    return targets.withColumns({"lo": at(upto - mills), "hi": at(upto)})


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """(src, slot, rank): which source each slot takes a block from, and the how manieth of that source it is."""
    spark = targets.sparkSession
    words = targets.agg(F.sum("source_size")).first()[0] or 0
    slots = spark.range(-(-words // block)).select(F.col("id").alias("slot"), F.pmod((F.col("id") % (1 << 31)) * GOLDEN, F.lit(POINTS)).alias("point"))
    cells = F.sequence(F.shiftright("lo", CELL_BITS), F.shiftright(F.col("hi") - 1, CELL_BITS))
    of = parts(targets).where("hi > lo").select("src", "lo", "hi", F.explode(cells).alias("cell"))
    taken = slots.withColumn("cell", F.shiftright("point", CELL_BITS)).join(of, "cell").where("point >= lo and point < hi").select("src", "slot", F.floor(F.col("slot") / RANKED).alias("part"))
    part = taken.groupBy("src", "part").agg(F.count("*").alias("n"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("src", "part").orderBy("slot")) - 1
    return taken.withColumn("inside", inside).join(part.select("src", "part", start.alias("start")), ["src", "part"]).select("src", "slot", (F.col("start") + F.col("inside")).alias("rank"))


def completed(slots: DataFrame, targets: DataFrame, block: int) -> DataFrame:
    """(src, rank) with exactly the ranks that each target needs: surplus ones go, missing ones follow at the end."""
    need = targets.select("src", F.ceil(F.floor("target") / block).alias("need"))
    have = need.join(slots.groupBy("src").agg(F.count("*").alias("have")), "src", "left").select("src", "need", F.coalesce("have", F.lit(0)).alias("have"))
    missing = have.where("have < need").select("src", F.explode(F.sequence("have", F.col("need") - 1)).alias("rank"))
    return slots.join(need, "src").where("rank < need").select("src", "rank").unionByName(missing)


def shuffled(sizes: DataFrame) -> DataFrame:
    """Position `at` of every document in its source's shuffled line of words: order of md5(doc_id), summed in three levels."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    byte = lambda i: F.conv(F.substring("key", i, 2), 16, 10).cast("int")
    rows = sizes.withColumn("key", key).withColumns({"b1": byte(1), "b2": byte(3)})
    fine = rows.groupBy("src", "b1", "b2").agg(F.sum("size").alias("n"))
    coarse = fine.groupBy("src", "b1").agg(F.sum("n").alias("n1"))
    before = lambda by, order, n: F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = coarse.select("src", "b1", before(["src"], ["b1"], "n1").alias("s1"))
    starts = fine.withColumn("s2", before(["src", "b1"], ["b2"], "n")).join(coarse, ["src", "b1"]).select("src", "b1", "b2", (F.col("s1") + F.col("s2")).alias("start"))
    inside = before(["src", "b1", "b2"], ["key", "doc_id", "size"], "size")
    return rows.withColumn("inside", inside).join(starts, ["src", "b1", "b2"]).withColumn("at", F.col("start") + F.col("inside")).drop("key", "b1", "b2", "start", "inside")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 128, limit: int = 3, whole: bool = True) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken (words the mix takes, repeats counted).

    Sizes are words; null, empty and blank texts have none and are never taken. A source's blocks stop at its target, so no
    document is taken more than `limit` times. Null sources form one source, null ids are ids like any other, repeated rows
    are documents of their own; rows that agree in id, source and size may swap places, which no result shows. Other
    columns are ignored; an empty table gives an empty table. Every source is taken up to the last whole word of its target:
    slots that the schedule deals it beyond that go, missing ones follow at its end. Without `whole` the schedule stays as
    dealt, and a source may end some blocks of `block` words below its target.
    """
    return taken_words(docs, id_col, text_col, source_col, block, limit, whole).drop("row")


def taken_words(docs: DataFrame, id_col: str, text_col: str, source_col: str, block: int, limit: int, whole: bool) -> DataFrame:
    """`mix` with `row`, the number that monotonically_increasing_id gives each row of `docs`."""
    number = F.monotonically_increasing_id().alias("row")
    sizes = docs.select(number, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    sizes = common.stored(sizes, "mix-sizes")
    targets = common.checkpointed(source_targets(sizes, limit))
    slots = common.checkpointed(schedule(targets, block))
    slots = common.checkpointed(completed(slots, targets, block)) if whole else slots
    used = targets.join(slots.groupBy("src").agg(F.count("*").alias("slots")), "src", "left").withColumn("words", F.least(F.coalesce("slots", F.lit(0)) * block, F.floor("target")))
    rows = sizes.join(used, sizes["source"].eqNullSafe(used["source"])).drop(used["source"])
    rows = common.checkpointed(shuffled(rows))
    passes = F.sequence(F.lit(0), F.ceil(F.col("words") / F.col("source_size")) - 1)
    pieces = rows.where("size > 0 and words > 0").withColumn("pass", F.explode(passes)).withColumn("from", F.col("pass") * F.col("source_size") + F.col("at"))
    pieces = pieces.where(F.col("from") < F.col("words")).withColumn("to", F.least(F.col("from") + F.col("size"), "words"))
    pieces = pieces.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    cut = F.least("to", (F.col("rank") + 1) * block) - F.greatest("from", F.col("rank") * block)
    taken = pieces.join(slots, ["src", "rank"]).groupBy("row").agg(F.sum(cut).alias("taken"))
    return rows.join(taken, "row", "left").select("row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 128, limit: int = 3) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns; a part of a document rounds to the nearer whole.

    Every source is taken up to its target. Documents without words are never taken. `docs` is read twice and must number its rows alike, as a written table does.
    """
    taken = taken_words(docs, id_col, text_col, source_col, block, limit, True)
    times = F.round(F.col("taken") / F.col("size")).cast("int")
    copies = taken.where((F.col("size") > 0) & (times > 0)).select("row", times.alias("times"))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc"))
    return numbered.join(copies, "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("doc.*")


BLOCK = 128
SQL = """
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
t0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM s GROUP BY source),
t1 AS (SELECT *, src % 3 + 1 AS weight, source_size / (src % 3 + 1)::DOUBLE AS per FROM t0),
t2 AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY per, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
       / (sum(weight) OVER (ORDER BY per, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM t1),
l AS (SELECT coalesce((SELECT level FROM t2 WHERE 3 * source_size >= level * weight ORDER BY per, src LIMIT 1), 0) AS level),
t3 AS (SELECT source, src, source_size, least((3 * source_size)::DOUBLE, l.level * weight) AS target FROM t2, l),
u AS (SELECT *, floor(target)::BIGINT AS words FROM t3),
d AS (SELECT s.doc_id, s.size, u.source_size, u.target, u.words,
      (sum(s.size) OVER (PARTITION BY u.src ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size)::BIGINT AS pos
      FROM s JOIN u ON s.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(words, pos + size) - pos) + greatest(0, least(words, source_size + pos + size) - source_size - pos)
   + greatest(0, least(words, 2 * source_size + pos + size) - 2 * source_size - pos))::BIGINT AS taken FROM d
"""
