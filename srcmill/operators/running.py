"""Running totals, first-n and latest-per-group forms that survive one very large group."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_total(df, keys, order, value, name="running", width=65536, limit=None):
    """Inclusive running sum of `value` per `keys` in the order of the integral, per-key unique `order`.

    The order axis is cut into ranges of `width`.  Range totals are pre-aggregated on the map side, added up per
    key (one small row per range), and rows are only ever sorted inside one range, so that no task sees a whole
    large group.  With `limit`, ranges that start beyond it are dropped before the rows are sorted.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    ranged = df.withColumn("_range", F.expr(f"cast(`{order}` as bigint) div {int(width)}"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(*keys, "_range")
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    if limit is not None:
        starts = starts.filter(F.col("_start") <= limit)
    inside = W.partitionBy(*keys, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = (
        ranged.join(starts, [*keys, "_range"])
        .withColumn(name, F.col("_start") + F.sum(value).over(inside))
        .drop("_range", "_start")
    )
    return out if limit is None else out.filter(F.col(name) <= limit)


def first_per_group(df, keys, *order, n=1, rank=None):
    """The first n rows per group.  Spark prunes each partition to n rows per group before the shuffle."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    label = rank or "_rank"
    out = df.withColumn(label, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(label) <= n)
    return out if rank else out.drop(label)


def latest_per_group(df, keys, order, columns, prefix=""):
    """The columns of the row with the greatest `order` tuple, as a plain (map-side combined) aggregate."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    newest = F.max_by(F.struct(*columns), F.struct(*order)).alias("_newest")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_newest.{c}").alias(prefix + c) for c in columns])
