"""Numbers for rows in a total order, without a task that sees all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import cut


def numbered(df: DataFrame, by: list[Column], name: str = "pos", first: int = 1, part: str | None = None, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """df with each row's number in the order of by, from first, and with the number of its sorted partition if a name for it is given.

    A range-partitioned sort, stored by keep, is numbered within partitions; the partitions' sizes, one row each, are summed up and broadcast.
    """
    n, own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), part or "_part"
    at = keep(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id()))
    number = F.shiftrightunsigned(name, 33)
    sizes = at.groupBy(number.alias(own)).agg(F.count("*").alias("_size"))
    starts = sizes.select(own, (F.sum("_size").over(Window.orderBy(own)) - F.col("_size") + first).alias("_start"))
    placed = at.withColumn(own, number).join(F.broadcast(starts), own)
    return placed.withColumn(name, F.col("_start") + F.col(name).bitwiseAND((1 << 33) - 1)).drop("_start", *([] if part else [own]))
