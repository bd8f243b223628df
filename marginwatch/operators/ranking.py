"""A ranking over all rows that no single task sorts.

``percent_rank() OVER (ORDER BY x)`` moves every row to one task. Here rows are dealt to ranges of
``(value, key)``; the key keeps ranges even when one value is very common. A row's rank is the number of
smaller values in the ranges before, which follows from one line of counts per range, plus its rank
inside its range. A value that runs over the border of its range started earlier: the rows of it in the
ranges before are taken off again, so ties share one rank wherever they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from marginwatch.sources.stage import staged

# Rows of a range, two numbers each: some hundred MB at most.
RANGE_ROWS = 4_000_000


def range_counts(dealt: DataFrame) -> DataFrame:
    """Per range its rows, and the rows of smaller values before it, for its first value and for the others.

    The window has no partition key, but its input is one row per range.
    """
    ends = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    last = dealt.join(ends, "range").where("v = high").groupBy("range").agg(F.count(F.lit(1)).alias("n_high"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("high").orderBy("range")
    counts = (
        ends.join(last, "range")
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        # rows of a range's last value up to and with this range, if earlier ranges end in it too
        .withColumn("n_run", F.sum("n_high").over(same.rowsBetween(Window.unboundedPreceding, 0)))
    )
    # the range before ends in this one's first value: its whole run is not smaller
    previous = Window.orderBy("range")
    tied = F.lag("high").over(previous) == F.col("low")
    return counts.select(
        "range",
        "n",
        "low",
        "before",
        F.coalesce(F.when(tied, F.lag("n_run").over(previous)), F.lit(0)).alias("tied"),
    )


def percent_ranks(df: DataFrame, value: str, key: str, ranges: int | None = None) -> DataFrame:
    """key, ``smaller`` (rows with a smaller value) and ``percent_rank``, smaller / (rows - 1), of every row.

    Rows with a null value have neither and count nowhere; a single row has rank 0. Keys need not be
    unique, but rows that agree in value and key stay in one range.
    """
    rows = df.select(F.col(key).alias("key"), F.col(value).alias("v"))
    known = staged(rows.where("v IS NOT NULL"))
    if ranges is None:
        ranges = max(1, -(-known.count() // RANGE_ROWS))
    # Written, since bounds of ranges are drawn anew whenever the plan runs.
    dealt = staged(known.repartitionByRange(ranges, "v", "key").withColumn("range", F.spark_partition_id()))
    counts = range_counts(dealt)
    inside = F.rank().over(Window.partitionBy("range").orderBy("v")) - 1
    ranked = dealt.withColumn("inside", inside).join(F.broadcast(counts), "range")
    smaller = F.col("before") + F.col("inside") - F.when(F.col("v") == F.col("low"), F.col("tied")).otherwise(0)
    total = counts.agg(F.sum("n")).scalar()
    found = ranked.select(
        F.col("key").alias(key),
        F.col("v").alias(value),
        smaller.alias("smaller"),
        F.coalesce(F.try_divide(smaller.cast("double"), total - 1), F.lit(0.0)).alias("percent_rank"),
    )
    nothing = rows.where("v IS NULL").select(
        F.col("key").alias(key),
        F.col("v").alias(value),
        F.lit(None).cast("long").alias("smaller"),
        F.lit(None).cast("double").alias("percent_rank"),
    )
    return found.unionByName(nothing)
