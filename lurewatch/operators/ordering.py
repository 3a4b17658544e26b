"""Order-dependent operators that stay spread out when one key is hot.

A window sorts all rows of a key in one task.  These helpers first read a thin
sample of keys and order values (by hash, about ``SAMPLES`` rows for as many
rows as one task should sort; no row is shuffled but the sampled ones).  A key
with more samples than that is hot, and every so many of its samples become the
bounds of its ranges, kept in a small table.  Without hot keys an ordinary
window does the work.  With some, each row of a hot key looks up its range;
rows are ordered inside (key, range) and shifted by what the earlier ranges of
the key hold.  Other keys have a single range and keep their window.  Bounds
are stored values, so a retried task finds the same ranges and no row has to be
frozen.  Both ways give the same result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.session import cut_lineage, scratch_path

MAX_GROUP_ROWS_KEY = "spark.lurewatch.maxGroupRows"
DEFAULT_MAX_GROUP_ROWS = 1_000_000
#: Sampled rows for as many rows as one task should sort.
SAMPLES = 32
_RANGE, _BOUNDS, _AT = "__range", "__bounds", "__at"
_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def max_group_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(MAX_GROUP_ROWS_KEY, str(DEFAULT_MAX_GROUP_ROWS)))


def _same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str, *also: Column) -> DataFrame:
    """Join that also matches null keys; ``right`` has its keys under ``__k_`` names, which are dropped."""
    met = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], F.lit(True))
    return left.join(right, reduce(lambda a, b: a & b, also, met), how).drop(*[f"__k_{k}" for k in keys])


def hot_bounds(df: DataFrame, keys: list[str], order: list[str], descending: bool = False) -> DataFrame | None:
    """Range bounds of the hot keys, in pieces of a list, or None if no key is hot.

    A list of n bounds is cut into pieces of the root of n, so that a row's range is found in two short scans.
    """
    limit = max_group_rows(df)
    most = min(SAMPLES, limit)
    thin = F.pmod(F.xxhash64(*keys, *order), F.lit(1 << 40)) < int((1 << 40) * most / limit)
    at = F.struct(*order)
    turn = Window.partitionBy(*keys).orderBy(at.desc() if descending else at.asc())
    numbered = df.select(*keys, *order).filter(thin).select(*keys, at.alias(_AT), F.row_number().over(turn).alias("__n"))
    # a key's last number is its sample count
    bounds = numbered.groupBy(*keys).agg(
        F.max("__n").alias("__n"), F.sort_array(F.collect_list(F.when(F.col("__n") % max(1, most // 2) == 0, F.col(_AT))), not descending).alias("__b")
    ).filter(F.col("__n") > most)
    width = F.ceil(F.sqrt(F.size("__b"))).cast("int")
    pieces = F.transform(F.sequence(F.lit(1), F.size("__b"), width), lambda i: F.slice("__b", i, width))
    path = scratch_path(df.sparkSession, "bounds")
    bounds.select(*[F.col(k).alias(f"__k_{k}") for k in keys], pieces.alias(_BOUNDS)).write.parquet(path)
    stored = df.sparkSession.read.parquet(path)
    return None if stored.isEmpty() else stored


def _range_of(order: list[str], descending: bool) -> Column:
    """Number of a row's range: how many bounds of its key it has reached."""
    here = F.struct(*order)
    reached = lambda x: x >= here if descending else x <= here
    piece = F.size(F.filter(F.transform(_BOUNDS, lambda p: F.element_at(p, 1)), reached))
    inside = F.size(F.filter(F.element_at(_BOUNDS, piece), reached))
    width = F.size(F.element_at(_BOUNDS, 1))
    return F.when(F.col(_BOUNDS).isNull(), 0).when(piece == 0, 0).otherwise((piece - 1) * width + inside)


def running(df: DataFrame, keys: list[str], order: list[str], descending: bool = False, **outputs: tuple[str, Column]) -> DataFrame:
    """Running aggregates per key, the current row included.

    ``outputs`` maps a new column to (``sum`` | ``max`` | ``min`` | ``count``,
    expression).  ``order`` must be unique within a key, and ``df`` must give the
    same rows whenever it is read.
    """
    for name, (_, expr) in outputs.items():
        df = df.withColumn(f"__in_{name}", expr)
    inputs = [f"__in_{name}" for name in outputs]
    turn = [F.desc(o) if descending else F.asc(o) for o in order]
    bounds = hot_bounds(df, keys, order, descending)

    if bounds is None:
        w = Window.partitionBy(*keys).orderBy(*turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        for name, (how, _) in outputs.items():
            df = df.withColumn(name, _COMBINE[how](f"__in_{name}").over(w))
        return df.drop(*inputs)

    cut = _same_keys(df, bounds, keys, "left").withColumn(_RANGE, _range_of(order, descending))
    parts = cut.filter(F.col(_BOUNDS).isNotNull()).groupBy(*keys, _RANGE).agg(
        *[_COMBINE[how](f"__in_{name}").alias(f"__part_{name}") for name, (how, _) in outputs.items()]
    )
    # One row per range of a hot key.
    before = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    merge = {"count": F.sum}
    offsets = parts.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col(_RANGE).alias("__r"),
        *[merge.get(how, _COMBINE[how])(f"__part_{name}").over(before).alias(f"__before_{name}") for name, (how, _) in outputs.items()],
    )
    local = Window.partitionBy(*keys, _RANGE).orderBy(*turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cut.drop(_BOUNDS)
    for name, (how, _) in outputs.items():
        out = out.withColumn(name, _COMBINE[how](f"__in_{name}").over(local))
    out = _same_keys(out, offsets, keys, "left", F.col(_RANGE) == F.col("__r"))
    for name, (how, _) in outputs.items():
        here, earlier = F.col(name), F.col(f"__before_{name}")
        if how in ("sum", "count"):
            value = F.when(earlier.isNull(), here).otherwise(earlier + F.coalesce(here, F.lit(0)))
        else:
            value = (F.greatest if how == "max" else F.least)(earlier, here)
        out = out.withColumn(name, value)
    return out.drop(_RANGE, "__r", *inputs, *[f"__before_{name}" for name in outputs])


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rn", descending: bool = False) -> DataFrame:
    """1-based position of every row within its key."""
    return running(df, keys, order, descending, **{name: ("count", F.lit(1))})


def cumulated(df: DataFrame, order: list, amount: Column, name: str) -> DataFrame:
    """Running sum of ``amount`` over all rows in ``order`` (unique), the current row included.

    Rows are range-partitioned, summed inside each range and shifted by the ranges before it; what meets in one task
    besides a range is one row per range.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = cut_lineage(df.withColumn("__amount", amount).repartitionByRange(width, *order).withColumn(_RANGE, F.spark_partition_id()))
    sums = cut.groupBy(_RANGE).agg(F.sum("__amount").alias("__sum"))
    before = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(_RANGE, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__shift"))
    local = Window.partitionBy(_RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cut.withColumn(name, F.sum("__amount").over(local)).join(F.broadcast(shifts), _RANGE)  # a row per shuffle partition
    return out.withColumn(name, F.col(name) + F.col("__shift")).drop("__amount", _RANGE, "__shift")


def lagged(df: DataFrame, keys: list[str], position: str, columns: dict[str, str], depth: int, block: int = 100_000) -> DataFrame:
    """Array of the previous ``depth`` values of each column, nearest first.

    ``position`` is the 1-based rank within the key.  Keys are cut into blocks
    of consecutive rows; the last ``depth`` rows of a block are also sent to the
    next one as context, so no task sees more than a block.
    """
    blocked = df.withColumn("__block", F.floor((F.col(position) - 1) / block)).withColumn("__context", F.lit(False))
    edge = blocked.filter((F.col(position) - 1) % block >= block - depth)
    edge = edge.withColumn("__block", F.col("__block") + 1).withColumn("__context", F.lit(True))
    w = Window.partitionBy(*keys, "__block").orderBy(position)
    out = blocked.unionByName(edge)
    for new, source in columns.items():
        out = out.withColumn(new, F.array_compact(F.array(*[F.lag(source, i).over(w) for i in range(1, depth + 1)])))
    return out.filter(~F.col("__context")).drop("__block", "__context")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
