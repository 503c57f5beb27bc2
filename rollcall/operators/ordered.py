"""Running values over rows in order, where one group may hold most of the table.

Rows are dealt into ranges of group and order, so a large group lies in several ranges.  Values
run within each range first; then what the ranges before hold of the same group is carried in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollcall.stage import staged, task_count

_ENDS = {"max": lambda c, at: F.max(c), "last": lambda c, at: F.max_by(c, F.when(c.isNotNull(), at))}
_RUNS = {"max": lambda c: F.max(c), "last": lambda c: F.last(c, ignorenulls=True)}
_BOTH = {"max": lambda own, carried: F.greatest(own, carried), "last": lambda own, carried: F.coalesce(own, carried)}


def laid_out(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` in ranges of ``order`` as a stage table, with ``__part``, the range, and ``__at``, which ascends in order over all rows."""
    n = ranges or task_count(df)
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return staged(placed.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)), "ranges")


def running(df: DataFrame, group: list[str], order: list[str], values: dict[str, tuple[str, str]], inclusive: bool = False, ranges: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``values``, named ``{name: (kind, column)}``, over the earlier rows of its group.

    ``kind`` is ``max`` or ``last``, both of which leave nulls out; ``inclusive`` takes the row itself in.  ``group`` and
    ``order`` together should tell rows apart, else rows that are equal in them stand in any order, and a group of
    such rows lies in one range.  Rows with null groups are groups as well.
    """
    laid = laid_out(df, [*group, *order], ranges)
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in group])
    key = F.struct(*group)
    # Of each range its first and last group, the only ones that other ranges may hold too.
    edges = laid.groupBy("__part").agg(F.min_by(key, "__at").alias("first"), F.max_by(key, "__at").alias("last"))
    either = edges.select("__part", F.explode(F.array_distinct(F.array("first", "last"))).alias("g")).select("__part", "g.*")
    several = either.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    either = either.alias("e").join(F.broadcast(several.alias("s")), same("e", "s"), "left_semi")
    shared = laid.alias("l").join(F.broadcast(either.alias("e")), (F.col("l.__part") == F.col("e.__part")) & same("l", "e"), "left_semi")
    ends = shared.groupBy("__part", *group).agg(*[_ENDS[kind](F.col(c), F.col("__at")).alias(name) for name, (kind, c) in values.items()])
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    carried = ends.select("__part", *group, *[_RUNS[kind](F.col(name)).over(before).alias(f"__{name}") for name, (kind, _) in values.items()])
    local = Window.partitionBy("__part", *group).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = laid.withColumns({f"__own_{name}": _RUNS[kind](F.col(c)).over(local) for name, (kind, c) in values.items()})
    met = own.alias("l").join(F.broadcast(carried.alias("c")), (F.col("l.__part") == F.col("c.__part")) & same("l", "c"), "left")
    out: list[Column] = [_BOTH[kind](F.col(f"l.__own_{name}"), F.col(f"c.__{name}")).alias(name) for name, (kind, _) in values.items()]
    return met.select(*[F.col(f"l.`{c}`") for c in df.columns], *out)
