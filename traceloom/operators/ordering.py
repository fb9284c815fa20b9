"""Numbering, previous-row and carry-forward that never put one group into one task.

A window partitioned by investigation or host sends a group that holds a third
of all rows to a single task. These functions range-partition by group *and*
order instead, work inside each slice, and pass only one small row per slice
(its size or its last value) on to the slices after it.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..session import checkpoint

PART, AT = "_part", "_at"


def slices(df: DataFrame, group, order) -> DataFrame:
    """Rows in (group, order) order with their slice ``_part`` and place in it ``_at``.

    ``order`` must end in columns that tell rows apart: equal keys stay together.
    """
    keys = [F.col(g).asc_nulls_first() for g in group] + list(order)
    marked = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn("_mono", F.monotonically_increasing_id())
              .withColumn(PART, F.shiftright("_mono", 33))
              .withColumn(AT, F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1)))
              .drop("_mono"))
    return checkpoint(marked)


def _attach(rows: DataFrame, per_slice: DataFrame, group) -> DataFrame:
    keys = [*group, PART]
    small = per_slice.select(*[F.col(k).alias(f"__{k}") for k in keys],
                             *[c for c in per_slice.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(small[f"__{k}"]) for k in keys])
    return rows.join(small, same, "left").drop(*[f"__{k}" for k in keys])


def number_rows(df: DataFrame, group, order, name: str) -> DataFrame:
    """``name`` = 1-based position of each row within its group."""
    rows = slices(df, group, order)
    sizes = rows.groupBy(*group, PART).agg(F.min(AT).alias("_low"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, PART, "_low",
                           F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return (_attach(rows, offsets, group)
            .withColumn(name, F.col("_before") + F.col(AT) - F.col("_low") + 1)
            .drop("_before", "_low", PART, AT))


def previous_value(df: DataFrame, group, order, value, name: str, *, sliced=False) -> DataFrame:
    """``name`` = ``value`` of the row before, within the group.

    With ``sliced`` the rows already carry ``_part`` and ``_at`` in group order.
    """
    rows = (df if sliced else slices(df, group, order)).withColumn("_value", value)
    inside = Window.partitionBy(*group, PART).orderBy(AT)
    marked = (rows.withColumn("_prev", F.lag("_value").over(inside))
              .withColumn("_first", F.row_number().over(inside) == 1))
    edges = rows.groupBy(*group, PART).agg(F.max_by("_value", AT).alias("_edge"))
    across = Window.partitionBy(*group).orderBy(PART)
    carried = edges.select(*group, PART, F.lag("_edge").over(across).alias("_carry"))
    return (_attach(marked, carried, group)
            .withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev")))
            .drop("_value", "_prev", "_first", "_carry", PART, AT))


def last_value_so_far(df: DataFrame, group, order, value, name: str, *, sliced=False) -> DataFrame:
    """``name`` = the latest non-null ``value`` at or before each row, within the group."""
    rows = (df if sliced else slices(df, group, order)).withColumn("_value", value)
    inside = (Window.partitionBy(*group, PART).orderBy(AT)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = rows.withColumn("_last", F.last("_value", ignorenulls=True).over(inside))
    edges = rows.groupBy(*group, PART).agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(AT))).alias("_edge"))
    before = (Window.partitionBy(*group).orderBy(PART)
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = edges.select(*group, PART,
                           F.last("_edge", ignorenulls=True).over(before).alias("_carry"))
    return (_attach(marked, carried, group)
            .withColumn(name, F.coalesce(F.col("_last"), F.col("_carry")))
            .drop("_value", "_last", "_carry", PART, AT))


def first_rows(df: DataFrame, group, order, n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows per group. The rank filter lets each map task keep only ``n``."""
    window = Window.partitionBy(*group).orderBy(*order)
    kept = df.withColumn(rank or "_rank", F.row_number().over(window)).filter(
        F.col(rank or "_rank") <= n)
    return kept if rank else kept.drop("_rank")


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the least by ``order`` (a list of Columns, ascending, nulls last).

    A partial aggregate runs before the shuffle, so a key that holds a third of
    all rows costs one row per map task.
    """
    rest = [c for c in df.columns if c not in keys]
    parts = [p for c in order for p in (c.isNull(), c)]
    if len(rest) == 0:
        return df.dropDuplicates(list(keys))
    least = F.min_by(F.struct(*rest), F.struct(*[p.alias(f"o{i}") for i, p in enumerate(parts)]))
    return df.groupBy(*keys).agg(least.alias("_row")).select(*keys, "_row.*").select(*df.columns)
