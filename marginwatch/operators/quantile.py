"""Exact interpolated quantiles that never gather the values in one task.

``percentile`` keeps every distinct value in one aggregation buffer, which a column of
customer totals outgrows. Here the wanted ranks are located by counting: values are
counted per coarse bucket, the bucket holding each rank is kept, and only the values
inside it are counted again in finer buckets. Three rounds of 21 bits reach single
values, and a round leaves at most 2**22 counters however large or skewed the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_SHIFTS = (42, 21, 0)


def _ranks(probabilities: Sequence[float]) -> Column:
    """For each probability the rank below and above its position among ``n`` values."""
    wanted = []
    for i, p in enumerate(probabilities):
        position = (F.col("n") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            wanted.append(
                F.struct(
                    F.lit(f"{side}{i}").alias("target"),
                    rank.cast("long").alias("rank"),
                    (position - F.floor(position)).alias("fraction"),
                )
            )
    return F.explode(F.array(*wanted))


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float], digits: int = 2) -> DataFrame:
    """One row with a double ``q0, q1, ...`` per probability, linear between neighbours.

    ``column`` holds numbers with at most ``digits`` decimals; nulls are ignored and an
    empty input gives nulls.
    """
    unit = 10**digits
    values = df.select(F.rint(F.col(column).cast("double") * unit).cast("long").alias("v")).filter(
        F.col("v").isNotNull()
    )

    found = None
    for shift in _SHIFTS:
        bucket = F.shiftright("v", shift).alias("bucket")
        if found is None:
            counts = values.groupBy(bucket).agg(F.count(F.lit(1)).alias("cnt"))
            running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
            counts = counts.select(
                "bucket",
                "cnt",
                F.sum("cnt").over(running).alias("upto"),
                F.sum("cnt").over(Window.partitionBy()).alias("n"),
            ).select("*", _ranks(probabilities).alias("t"))
            counts = counts.select("bucket", "cnt", "upto", "t.*")
        else:
            # ``found`` has two rows per probability, so its broadcast size is fixed.
            inside = values.join(
                F.broadcast(found), F.shiftright("v", shift + 21) == F.col("prefix")
            )
            counts = inside.groupBy("target", "rank", "fraction", bucket).agg(F.count(F.lit(1)).alias("cnt"))
            running = Window.partitionBy("target").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
            counts = counts.withColumn("upto", F.sum("cnt").over(running))
        found = counts.filter(
            (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("cnt"))
        ).select(
            "target",
            F.col("bucket").alias("prefix"),
            (F.col("rank") - F.col("upto") + F.col("cnt")).alias("rank"),
            "fraction",
        )

    def pick(target: str, what: Column) -> Column:
        return F.max(F.when(F.col("target") == target, what))

    value = F.col("prefix") / F.lit(float(unit))
    quantiles = []
    for i in range(len(probabilities)):
        low, high = pick(f"lo{i}", value), pick(f"hi{i}", value)
        quantiles.append((low + (high - low) * pick(f"lo{i}", F.col("fraction"))).alias(f"q{i}"))
    return found.agg(*quantiles)


def quantile_scalars(df: DataFrame, column: str, probabilities: Sequence[float], digits: int = 2) -> list[Column]:
    """The quantiles as scalar-subquery columns, ready for use in another query."""
    row = exact_quantiles(df, column, probabilities, digits)
    names = row.columns
    whole = row.select(F.struct(*names).alias("q")).scalar()
    return [whole.getField(name) for name in names]
