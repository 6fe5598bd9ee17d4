"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the documents are sorted by
that key in ranges, distributed prefix sums of their sizes are computed range by range,
and each source is cut exactly where its budget ends; a source whose budget exceeds its
size is repeated in whole epochs first. Only DataFrame operations are used.

Documents of one id, source and size are counted first and share a place; their copies are
told apart when the result is written out, a bounded number at a time. So a null or
repeated id that holds a large part of all rows stays one row until then.

Defined results: a null or empty text has size 0, a very long one is counted whole; a null
source is a source of its own and comes last; repeated rows and repeated ids are separate
documents, ties of the key being broken by id and then by size (documents equal in these
are interchangeable); an empty table gives an empty result; other columns of the input,
whatever their names, are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.llm.common import WORD, spread_join, written

#: Rows that one window partition should hold; the number of ranges follows from it.
RANGE_ROWS = 20_000
NAMED = ("doc_id", "source", "size")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Targets of sources (source, source_size): shares by weight, ``most`` sizes at most.

    Sources in code point order, null last, take the weights in turn. What exceeds a
    source's limit is shared by weight among the others until no target is above its
    limit. Sorted by limit per weight, the level of the rest is closed-form. The windows
    run over one row a source.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy("ratio", "rank")
    return (
        sizes.withColumn("rank", F.row_number().over(named))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("full", F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("all", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("share", (F.col("all") - F.col("full")).cast("double") / F.col("open"))
        .withColumn("share", F.max(F.when(F.col("share") <= F.col("ratio"), F.col("share"))).over(Window.partitionBy()))
        .select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("share") * F.col("weight")).alias("target"))
    )


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, part) for every document.

    A document is taken ``epochs`` times whole and then ``part`` of its words once more.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    sized = written(sized.groupBy(*NAMED).agg(F.count("*").alias("copies")), "sized")
    digits = max(0, min(6, math.ceil(math.log(max(1, sized.count()) / RANGE_ROWS, 16))))
    keyed = sized.withColumn("key", F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))).withColumn("range", F.substring("key", 1, digits))
    words = F.col("size") * F.col("copies")
    ranges = keyed.groupBy("source", "range").agg(F.sum(words).alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, most)
    ranges = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), "range_start")
    starts = ranges.join(targets.withColumnRenamed("source", "t"), F.col("s").eqNullSafe(F.col("t"))).drop("t")
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        keyed.withColumn("inside", F.coalesce(F.sum(words).over(within), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("s")) & F.col("range").eqNullSafe(F.col("r")))
        .withColumn("budget", F.floor(F.col("target") + 0.5))
        .withColumn("epochs", F.coalesce(F.expr("budget div nullif(source_size, 0)"), F.lit(0)))
        .withColumn("room", F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("range_start") - F.col("inside"))
    )
    placed = written(placed.select(*NAMED, "copies", "source_size", "target", "epochs", "room"), "placed")
    last = lambda first: F.sequence(first, F.least(F.col("copies"), first + RANGE_ROWS) - 1)
    zero = F.lit(0).cast("long")
    few = placed.filter(F.col("copies") <= RANGE_ROWS).withColumn("copy", F.explode(last(zero)))
    many = placed.filter(F.col("copies") > RANGE_ROWS).withColumn("first", F.explode(F.sequence(zero, F.col("copies") - 1, F.lit(RANGE_ROWS).cast("long"))))
    many = many.repartition("doc_id", "first").withColumn("copy", F.explode(last(F.col("first")))).drop("first")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - F.col("copy") * F.col("size"))).cast("long").alias("part")
    return few.unionByName(many).select(*NAMED, "source_size", "target", "epochs", part)


def _name(doc_id: Column, source: Column, size: Column) -> Column:
    """A string for each id, source and size, nulls included."""
    said = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.concat(said(doc_id), said(source), size.cast("string"))


def repeat_documents(docs: DataFrame, mix: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; documents are not split.

    The last, partly taken document of a source counts as taken if at least half of it
    is. Documents equal in id, source and size are taken alike, but for those among which
    a source's budget ends: of these a share by hash of the row is taken once more.
    """
    names = docs.columns
    own, place = "__named", "__row"
    while {own, place} & set(names):
        own, place = own + "_", place + "_"
    times = F.col("epochs") + ((F.col("part") * 2 >= F.col("size")) & (F.col("part") > 0)).cast("long")
    each = mix.select(_name(F.col("doc_id"), F.col("source"), F.col("size")).alias(own), times.alias("times"))
    each = written(each.groupBy(own).agg(F.count("*").alias("k"), F.min("times").alias("__low"), F.sum("times").alias("__sum")).withColumn("__k", F.col("k")), "times")
    rows = docs.withColumn(own, _name(F.col(doc_id), F.col(source), word_count(F.col(text)))).withColumn(place, F.monotonically_increasing_id())
    joined = spread_join(rows, each, [own], ["__low", "__sum", "__k"])
    more = F.col("__sum") - F.col("__low") * F.col("__k")
    count = F.col("__low") + (F.pmod(F.xxhash64(place), F.col("__k")) < more).cast("long")
    return joined.withColumn("__copy", F.explode(F.when(count > 0, F.sequence(F.lit(1).cast("long"), count)))).select([joined[f"`{c}`"] for c in names])
