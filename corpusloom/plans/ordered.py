"""What stands before a row in its group, also where one group holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize

#: Rows of a group that one task sorts.
GROUP_ROWS = 500_000


def lagged(rows: DataFrame, key: str, order: str, value: str, name: str, most: int = GROUP_ROWS) -> DataFrame:
    """Add name: the value of the row before in its group of equal keys, by order; null for a group's first and for null keys.

    Rows with a null key are not shuffled. Groups of more than `most` rows, counted with map-side partial counts, are dealt out
    by ranges of (key, order): each range looks back within itself, and its first row to the last one of the range before.
    order is unique in a group.
    """
    none = rows.where(F.col(key).isNull()).withColumn(name, F.lit(None).cast(rows.schema[value].dataType))
    held = rows.where(F.col(key).isNotNull())
    before = lambda *by: F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    # no more of them than rows / most
    large = materialize(held.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(key), "large")
    n = large.count()
    if not n:
        return held.withColumn(name, before(key)).unionByName(none)
    large = F.broadcast(large) if n <= 100_000 else large
    small = held.join(large, key, "left_anti").withColumn(name, before(key))
    own = held.join(large, key, "left_semi")
    ranges = max(2, own.count() // most + 1)
    dealt = materialize(own.repartitionByRange(ranges, key, order).withColumn("#range", F.spark_partition_id()), "ranges")
    last = dealt.groupBy(key, "#range").agg(F.max_by(value, order).alias("#last"))
    # one row for each range of a key
    last = materialize(last.select(key, "#range", F.lag("#last").over(Window.partitionBy(key).orderBy("#range")).alias("#earlier")), "lasts")
    looked = dealt.withColumn("#in", before(key, "#range")).join(F.broadcast(last) if ranges + n <= 100_000 else last, [key, "#range"])
    return small.unionByName(looked.withColumn(name, F.coalesce("#in", "#earlier")).select(*small.columns)).unionByName(none)
