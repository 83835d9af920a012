"""Places of rows within large groups, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.session import checkpointed


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with place (from 0, by `order` within the group) and size (rows of the group).

    Rows are sorted by range of (group, order) and written, each partition is
    counted by group, and the counts are summed along the partitions: the only
    window runs over at most one row per partition and group. rows should be
    narrow; rows equal in group and order follow each other in any order.
    """
    keys = [group, *order]
    dealt = rows.withColumn("nth", F.monotonically_increasing_id())
    dealt = checkpointed(dealt).repartitionByRange(*keys, "nth").sortWithinPartitions(*keys, "nth").drop("nth")
    dealt = checkpointed(dealt.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}))
    parts = dealt.groupBy(F.col(group).alias("own_group"), F.col("part").alias("own_part")).agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("own_group")
    parts = parts.select("own_group", "own_part", (F.sum("n").over(whole.orderBy("own_part")) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size"))
    placed = dealt.join(parts, F.col(group).eqNullSafe(F.col("own_group")) & (F.col("part") == F.col("own_part")))
    return placed.select(*rows.columns, (F.col("seq") + F.col("shift")).alias("place"), "size")
