"""Places in a global order, without a window that holds a group in one task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexicarta.sources import files

#: Rows of partitions' sizes that are sent to all tasks at most.
MOST_SENT = 200_000


def with_places(rows: DataFrame, order: list[Column | str], group: list[str] = (), name: str = "place") -> DataFrame:
    """rows with their place, from 0, in an order, or in that of their group.

    Rows are range-partitioned by group and order and numbered in each partition; the sizes of the partitions before give what is added.
    So a group, however large, spreads over partitions; ties keep the order of their partitions, so the order should be total.
    """
    keys = [*(F.col(g) for g in group), *order]
    dealt = files.written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    its = [F.col(g).alias(f"_g{k}") for k, g in enumerate(group)]
    sizes = dealt.groupBy(*its, part.alias("_part")).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_held"))
    own = [f"_g{k}" for k in range(len(group))]
    before = Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sizes = files.written(sizes.select(*own, "_part", (F.coalesce(F.sum("_held").over(before), F.lit(0)) - F.col("_low")).alias("_shift")), "sizes")
    # of many small groups most partitions hold several: then the sizes meet the rows in a join
    sent = F.broadcast(sizes) if sizes.count() <= MOST_SENT else sizes
    same = part == F.col("_part")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return dealt.join(sent, same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))
