"""Mixing sources to target sizes by entropy balancing.

Every document gets a rate, the expected number of its copies. Rates are those
closest to one in relative entropy under a token constraint for each source and
an upper bound: rate = min(CAP, exp(lambda_source * size / mean size)). Newton
steps, bracketed by bisection, solve the dual for all sources at once. They run
on counts of documents by source and size, which hold all that the dual needs.
Systematic rounding along the sizes turns rates into copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import stored

CAP = 3.0
WEIGHTS = (1, 2, 3)
TOLERANCE = 1e-9
MAX_STEPS = 60
#: Documents of one source and size are dealt by a hash into this many lots before they are ranked.
LOTS = 1024


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked_sources(sources: DataFrame) -> DataFrame:
    """Add ``place``, the position by code point from 0, null last; ranked within ranges that are counted first."""
    ordered = stored(
        sources.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("part", F.spark_partition_id()),
        "sources",
    )
    before, total = {}, 0
    for part, n in sorted(map(tuple, ordered.groupBy("part").count().collect())):
        before[part], total = total, total + n
    offset = F.lit(0)
    for part, n in before.items():
        offset = F.when(F.col("part") == part, F.lit(n)).otherwise(offset)
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ordered.withColumn("place", inside - 1 + offset).drop("part")


def targets(sources: DataFrame) -> DataFrame:
    """Add ``weight`` and ``target`` to (source, source_size).

    Targets share the total by weight; none exceeds CAP times its source, and
    what lies above is shared again by weight among the others.
    """
    place = F.pmod(F.col("place"), F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int"))
    table = stored(ranked_sources(sources).withColumn("weight", weight.cast("double")), "weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:  # each round fixes at least one more source at its bound, most rounds many
        over = F.col("weight") * level >= CAP * F.col("source_size")
        fixed, free = table.agg(
            F.sum(F.when(over, CAP * F.col("source_size")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))
        ).first()
        new = (total - (fixed or 0.0)) / free if free else level
        if new <= level * (1 + 1e-15):
            break
        level = new
    return table.withColumn("target", F.least(F.col("weight") * level, CAP * F.col("source_size")))


def _rate(z: Column, tilt: Column) -> Column:
    return F.least(F.lit(CAP), F.exp(F.least(z * tilt, F.lit(2.0))))


def tilts(histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, tilt): the dual solution for each source; null where every document takes CAP copies.

    ``histogram``: source, size, n; ``goals``: source, mean, target. One
    aggregation of the histogram by source is one Newton step of all sources.
    """
    state = goals.select(
        "source", "mean", "target", F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("done")
    )
    state = stored(state, "tilts")
    for _ in range(MAX_STEPS):
        z = F.col("size") / F.col("mean")
        words = F.col("n") * F.col("size") * _rate(z, F.col("tilt"))
        slope = F.when(_rate(z, F.col("tilt")) < CAP, words * z).otherwise(0.0)
        open_ = state.where("not done")
        step = histogram.join(open_, histogram["source"].eqNullSafe(open_["source"])).groupBy(open_["source"]).agg(
            F.first("mean").alias("mean"), F.first("target").alias("target"), F.first("tilt").alias("tilt"), F.first("low").alias("low"),
            F.first("high").alias("high"), F.sum(words).alias("words"), F.sum(slope).alias("slope"),
        )
        miss = F.col("words") - F.col("target")
        low = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(miss >= 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - miss / F.col("slope")
        middle = (
            F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), (F.col("low") + F.col("high")) / 2)
            .when(F.col("low").isNull(), F.col("high") * 2 - 1)
            .otherwise(F.col("low") * 2 + 1)
        )
        good = (F.col("slope") > 0) & (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
        new = (
            step.withColumn("low", low)
            .withColumn("high", high)
            .select(
                "source", "mean", "target",
                F.when(F.abs(miss) <= F.col("target") * TOLERANCE, F.col("tilt")).when(good, newton).otherwise(middle).alias("tilt"),
                "low", "high",
                (F.abs(miss) <= F.col("target") * TOLERANCE).alias("done"),
            )
        )
        state = stored(state.where("done").unionByName(new), "tilts")
        if state.where("not done").isEmpty():
            break
    # Rounded, so that the order in which sums are formed can't change any copy.
    return state.select("source", F.round("tilt", 9).alias("tilt"))


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """Copies of each document that bring every source near its target size.

    Returns a row for each input row: doc_id, size (words), source_size, target
    (its source's), taken (words taken, repeats counted), copies, rate. Null and
    empty texts have size 0 and take 0 words; a null source is a source of its
    own, the last. Repeated rows and ids are documents of their own. Sources of
    size 0 have target 0. Other columns are ignored; an empty table gives an
    empty result. The same input gives the same copies.
    """
    rows = stored(
        docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), word_count(F.col(text_column)).alias("size")).withColumn(
            "lot", F.pmod(F.xxhash64("doc_id"), F.lit(LOTS)).cast("int")
        ),
        "sizes",
    )
    lots = stored(rows.groupBy("source", "size", "lot").agg(F.count("*").alias("n")), "lots")
    histogram = stored(lots.groupBy("source", "size").agg(F.sum("n").alias("n")), "histogram")
    sources = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    goals = stored(
        targets(sources).withColumn("mean", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9))), "goals"
    )
    full = F.col("target") >= CAP * F.col("source_size") * (1 - 1e-12)
    solved = tilts(histogram, goals.where(~full).select("source", "mean", "target"))
    told = goals.withColumn("full", full)
    tilt = told.join(solved.withColumnRenamed("source", "s"), told["source"].eqNullSafe(F.col("s")), "left").drop("s")
    goal = stored(tilt.select("source", "source_size", "target", "mean", "full", "tilt"), "goal").withColumnRenamed("source", "s")

    rate = F.when(F.col("full"), F.lit(CAP)).otherwise(_rate(F.col("size") / F.col("mean"), F.col("tilt")))
    cells = histogram.join(goal, histogram["source"].eqNullSafe(goal["s"])).select(
        "source", "size", "n", "source_size", "target", rate.alias("rate")
    )
    # Extra copies of a source, along falling size: as many as the rates' fractions add up to, at every point.
    fraction = F.col("rate") - F.floor("rate")
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    sums = cells.withColumn("f", fraction).withColumn("upto", F.sum(F.col("f") * F.col("n")).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    whole = lambda c: F.floor(c + F.lit(0.5) + F.lit(1e-6))
    extra = (whole(F.col("upto")) - F.coalesce(whole(F.lag("upto").over(down)), F.lit(0))).cast("long")
    cells = stored(sums.withColumn("extra", F.least(F.greatest(extra, F.lit(0)), F.col("n"))), "cells").select(
        F.col("source").alias("s"), F.col("size").alias("z"), "n", "source_size", "target", "rate", "extra"
    )
    # Within a cell the extra copies go to the first documents by lot and id.
    along = Window.partitionBy("source", "size").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    before = lots.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0))).drop("n")
    placed = before.join(cells, before["source"].eqNullSafe(cells["s"]) & (before["size"] == cells["z"])).select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("lot").alias("l"), "source_size", "target", "rate",
        (F.col("extra") - F.col("before")).alias("left"),
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "lot").orderBy("doc_id"))
    ranked = rows.withColumn("rank", rank)
    joined = ranked.join(placed, ranked["source"].eqNullSafe(placed["s"]) & (ranked["size"] == placed["z"]) & (ranked["lot"] == placed["l"]))
    copies = (F.floor("rate") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)).cast("int")
    return joined.select("doc_id", "size", "source_size", "target", copies.alias("copies"), "rate").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate"
    )
