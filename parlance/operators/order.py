"""Global positions in a sort order without a single-partition window.

The frame is range-partitioned on the sort keys and written once (so that the
sampled range bounds are fixed), each partition's row count gives its offset
(a window over the few partition rows), and a row's position is that offset
plus its ``row_number`` inside its own range partition.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def with_positions(df: DataFrame, order_cols: Sequence[str], name: str = "position",
                   partitions: int | None = None) -> DataFrame:
    """Add a 0-based ``name`` column = rank of the row in the order of ``order_cols`` (ties broken
    by the remaining order of the columns given; pass a unique key last for a total order)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(n, *order_cols).withColumn("_pid", F.spark_partition_id()))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    j = ranged.join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
    w = Window.partitionBy("_pid").orderBy(*order_cols)
    return j.withColumn(name, (F.col("_off") + F.row_number().over(w) - 1).cast("long")).drop("_pid", "_off")
