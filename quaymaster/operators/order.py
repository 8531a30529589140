"""Total orders without a single task: rows are dealt to ranges, summed in each range, and moved up by what the ranges before hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.staging import staged


def cumulative(df: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """df with running sums (each row's own value included) over all rows in the given order. Rows equal in `order` stand in any order.
    What is broadcast has one row for each range, and there are as many ranges as shuffle partitions at most."""
    at = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "ordered").withColumn("_p", F.shiftright("_m", 33))
    total = at.groupBy("_p").agg(*[F.sum(x).alias(f"_t_{k}") for k, x in sums.items()])
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    total = total.select("_p", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    upto = W.partitionBy("_p").orderBy("_m").rowsBetween(W.unboundedPreceding, 0)
    own = at.select("*", *[F.sum(x).over(upto).alias(f"_o_{k}") for k, x in sums.items()])
    return own.join(F.broadcast(total), "_p").select(*df.columns, *[(F.col(f"_o_{k}") + F.col(f"_b_{k}")).alias(k) for k in sums])


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with each row's place from 0 in the given order."""
    return cumulative(df, order, {name: F.lit(1)}).withColumn(name, (F.col(name) - 1).cast("long"))
