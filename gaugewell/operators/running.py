"""Sums along an order, over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of the order that one task sums at a time.
WIDTH = 1 << 16


def running_sums(df: DataFrame, sums: dict[str, Column], order: str, *by: str, width: int = WIDTH) -> DataFrame:
    """df with columns that hold the sums of whole numbers from 0 up to each row, in groups of by.

    order is a number, such as a row's place; nulls come first. Rows are summed in stretches of width numbers, so a group of any size goes
    to many tasks, and what a stretch begins with comes from the totals of those before it: a row per stretch. Stretches are cut at
    fixed numbers, so a task that runs again gives the same.
    """
    at = F.coalesce(F.floor(F.col(order) / width).cast("long"), F.lit(-(1 << 62)))
    # a struct with a null in it is equal to another one, so null groups meet their totals
    rows = df.withColumn("x_of", F.struct(*[F.col(c).alias(f"x{i}") for i, c in enumerate(by)], at.alias("at")))
    own = Window.partitionBy("x_of").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: F.sum(F.coalesce(c.cast("long"), F.lit(0))).over(own) for n, c in sums.items()})
    ends = rows.groupBy("x_of").agg(*[F.max(n).alias(f"x_before_{n}") for n in sums])
    before = Window.partitionBy(*[f"x_of.x{i}" for i in range(len(by))]).orderBy("x_of.at").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("x_of", *[F.coalesce(F.sum(f"x_before_{n}").over(before), F.lit(0)).alias(f"x_before_{n}") for n in sums])
    # groups are read from the struct, so both sides of the join need the same columns of one shuffle where rows hold no others
    groups = {c: F.col(f"x_of.x{i}").alias(c) for i, c in enumerate(by)}
    return rows.join(starts, "x_of").select(*[groups.get(c, F.col(c)) for c in df.columns], *[(F.col(n) + F.col(f"x_before_{n}")).alias(n) for n in sums])
