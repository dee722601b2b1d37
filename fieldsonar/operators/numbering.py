"""Dense numbers in a global order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def numbered(keys: DataFrame, order: str | list[str], name: str, size: str | None = None) -> DataFrame:
    """Rows of keys with a column `name`: how many rows come before in the order of a column, or of several; or the sum of a
    column `size` over these. Rows that are equal in all of them come in any order.

    Ranges of the order are sorted side by side; only one row a range is added up in one task.
    """
    order = [order] if isinstance(order, str) else order
    own = F.lit(1) if size is None else F.col(size)
    ranged = written(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("__range").agg(F.sum(own).alias("__total"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    start = totals.withColumn("__start", F.coalesce(F.sum("__total").over(before(Window.orderBy("__range"))), F.lit(0))).drop("__total")
    inside = F.coalesce(F.sum(own).over(before(Window.partitionBy("__range").orderBy(*order))), F.lit(0))
    # one row for each range: bounded by the number of partitions
    return ranged.withColumn(name, inside).join(F.broadcast(start), "__range").withColumn(name, (F.col(name) + F.col("__start")).cast("long")).drop("__range", "__start")
