"""Running sums and row numbers over one order of a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


def running_sums(df: DataFrame, order: list[Column], **sums: str) -> DataFrame:
    """`df` with a column for each of `sums` (new name = summed column): its running sum in `order`, the row itself included.

    The table is dealt out in ranges of `order` and summed within them; a range starts at the totals of those before
    it, a table of one row a range. So no task sees all rows. Rows that tie in `order` are summed in any order.
    """
    ranged = cut(df.repartitionByRange(*order).select("*", F.spark_partition_id().alias("__part")))
    upto = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = ranged.groupBy("__part").agg(*[F.sum(v).alias(f"__t_{n}") for n, v in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in sums])
    within = ranged.select("*", *[F.sum(v).over(upto).alias(n) for n, v in sums.items()])
    out = within.join(F.broadcast(starts), "__part")
    return out.select(*[c for c in df.columns if c not in sums], *[(F.col(n) + F.col(f"__s_{n}")).alias(n) for n in sums])


def numbered(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """`df` with its row number in `order`, from 1."""
    return running_sums(df.withColumn("__one", F.lit(1).cast("long")), order, **{name: "__one"}).drop("__one")
