"""Numbers for rows in a global order, without bringing the rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from morphlake.operators.shared import written


def numbered(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """df with each row's number from 0 in the order of the columns given.

    Rows are range-partitioned, sorted and written once, one file a partition; a row's number is that of its file's
    first row plus its place in the file. Only the partitions' counts, a row for each, are added up in one task and
    sent to all. Rows equal in all order columns are numbered in any order. An empty table stays empty.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    rows = written(ranged, "ranged").select("*", F.col("_metadata.row_index").alias("__own"))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("__part").agg(F.count("*").alias("c")).select("__part", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("__start"))
    held = rows.join(F.broadcast(starts), "__part")  # as many rows as the shuffle has partitions
    return held.withColumn(name, F.col("__start") + F.col("__own")).drop("__part", "__own", "__start")


def with_batch(df: DataFrame, size: int, *order: str, name: str = "batch") -> DataFrame:
    """df with the number of its batch: size rows each, in the given order."""
    if size < 1:
        raise ValueError("a batch holds at least one row")
    return numbered(df, *order, name="__n").withColumn(name, F.floor(F.col("__n") / size)).drop("__n")
