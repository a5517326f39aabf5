"""Mixing sources to target weights along a time-varying curriculum, with SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from answerloom.llm.common import saved

# Weights of the sources in order of their names, repeating; words of the mix per hundred of the input; most
# repeats of a document.
WEIGHTS = (3, 1, 2)
PERCENT = 150
MOST = 2
#: Schedules, repeating with the weights: how a source's rate changes from the start to the end of training.
#: The rate is weight * (1 + slope * (2 * time - 1)): its integral over the training is the weight.
SLOPES = (-0.6, 0.0, 0.6)
#: Documents of a stretch of a source; places are summed by stretch first, and within stretches next.
STRETCH = 2_000
BLANK = r"[\x20\x09-\x0D]+"


def size(text: Column) -> Column:
    """Words of a text: starts of runs of other characters than white space."""
    return F.coalesce(F.size(F.filter(F.split(text, BLANK), lambda w: w != "")), F.lit(0)).cast("bigint")


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` (source, source_size) with ``place``, ``weight`` and ``target``, a double.

    PERCENT of all sizes is shared by weight. A source's target stops at MOST times its size, and what it leaves is shared
    by weight among the rest until none is above: with the sources sorted by size per weight, those that stop are the
    first ones, and the last source at which the shares of the rest still exceed its stop tells how many. Sources without
    words have target 0. One row per source goes through one window.
    """
    everything = W.orderBy(F.col("source").asc_nulls_last())
    rows = sources.withColumn("place", F.row_number().over(everything) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")))
    by_ratio = W.orderBy((F.col("source_size") / F.col("weight")).asc(), "place")
    before = by_ratio.rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy(F.lit(0))
    total = F.sum("source_size").over(every) * F.lit(PERCENT) / F.lit(100)
    rows = rows.withColumn("total", total).withColumn("all_weight", F.sum("weight").over(every))
    rows = rows.withColumn("cap", (MOST * F.col("source_size")).cast("double"))
    rows = rows.withColumn("capped_before", F.sum("cap").over(before) - F.col("cap")).withColumn("weight_left", F.col("all_weight") - F.sum("weight").over(before) + F.col("weight"))
    rows = rows.withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_left"))
    rows = rows.withColumn("stops", F.col("level") * F.col("weight") >= F.col("cap"))
    level = F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), "place", "level"))).over(every)["level"]
    rows = rows.withColumn("target", F.when(F.col("stops"), F.col("cap")).otherwise(F.coalesce(level, F.lit(0.0)) * F.col("weight")))
    return rows.select("source", "source_size", F.col("place").cast("int").alias("place"), "weight", "target")


def time_of(share: Column, slope: Column) -> Column:
    """When a source has given ``share`` of its words: the inverse of the integral t + slope * (t * t - t)."""
    b = 1 - slope
    return F.when(F.abs(slope) < 1e-9, share).otherwise((F.sqrt(F.greatest(b * b + 4 * slope * share, F.lit(0.0))) - b) / (2 * slope))


def schedule(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, position, epochs, and the columns ``keep``) for each row of ``docs``.

    A source's documents lie in the order of the md5 of their ids on an axis of words, which is run through again once it ends,
    up to the target: the words of a document below the target, of both rounds, are ``taken``, so each source gives its target
    rounded down and no document more than MOST times its size. ``position`` (0 to 1) is the time at which the curriculum's
    demand for the source reaches the document's first word, ``epochs`` the times of every round; both are null for
    documents that are not taken. The sum over the axis is taken by stretches of about STRETCH documents, which no source
    exceeds whatever its share. Null texts have size 0; documents without words are not taken. Null sources are one source,
    last. Rows that repeat an id follow one another by text hash; equal rows are interchangeable.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", size(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"), F.xxhash64("text").alias("t"), *keep)
    known = saved(rows.select("doc_id", "source", "size", "h", "t"), "sizes") if not keep else rows
    by_source = known.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_source = saved(by_source, "sources")
    facts = targets(by_source.select("source", "source_size")).withColumnRenamed("source", "s")
    facts = facts.join(by_source.select(F.col("source").alias("z"), "n"), F.col("s").eqNullSafe(F.col("z"))).drop("z")
    facts = saved(facts.withColumn("stretches", F.ceil(F.col("n") / STRETCH).cast("bigint")), "facts")
    same = F.col("source").eqNullSafe(F.col("s"))
    unit = F.conv(F.substring("h", 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    placed = known.join(facts, same).drop("s", "n").withColumn("stretch", F.floor(unit * F.col("stretches")).cast("bigint"))
    sums = placed.groupBy("place", "stretch").agg(F.sum("size").alias("words"))
    ahead = W.partitionBy("place").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).select("place", "stretch", "ahead")
    within = W.partitionBy("place", "stretch").orderBy("h", "doc_id", "t").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("first", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(sums, ["place", "stretch"]).withColumn("first", F.col("first") + F.col("ahead"))
    goal = F.floor("target").cast("bigint")
    given = [F.least(F.greatest(goal - F.col("first") - F.lit(k) * F.col("source_size"), F.lit(0)), F.col("size")) for k in range(MOST)]
    slope = F.element_at(F.array(*(F.lit(x) for x in SLOPES)), (F.col("place") % len(SLOPES) + 1).cast("int"))
    times = F.array(*(F.when(g > 0, time_of((F.col("first") + F.lit(k) * F.col("source_size")) / F.col("target"), slope)) for k, g in enumerate(given)))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", sum(given[1:], given[0]).alias("taken"),
        F.element_at(times, 1).alias("position"), F.filter(times, lambda x: x.isNotNull()).alias("epochs"), *keep,
    )


def in_order(rows: DataFrame) -> DataFrame:
    """Rows range-sorted by their position in the training; those that are not taken come last."""
    keys = [F.col("position").asc_nulls_last(), F.col("doc_id").asc()]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def mixed(docs: DataFrame) -> DataFrame:
    """The digest of ``schedule``, range-sorted by position: doc_id, size, source_size, target, taken, position."""
    return in_order(schedule(docs).select("doc_id", "size", "source_size", "target", "taken", "position"))
