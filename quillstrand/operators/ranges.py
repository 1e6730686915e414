"""Running aggregates over groups of any size, in two levels: inside ranges of rows, and over the ranges' totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstrand.shared import free_name, stash

#: How a value before a row is put together from that before its range and that inside it.
JOINED = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest}


def before_row(df: DataFrame, group: str, order: list[Column], wanted: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with a column for each wanted name -> (sum or max, value): the aggregate of the rows of the same group that stand
    before the row. Nothing before: 0 for sums, null for maxima. Null groups are one group.

    Rows are dealt to ranges of (group, order), so a group may spread over many tasks; rows that are equal in order stand
    in any order, and may be split, too. The totals have a row for each range and each group that it holds; a window
    over them hands each range what came before.
    """
    part, spread = free_name("part", df), free_name("spread", df)
    value, name = {}, {}
    for n in wanted:
        value[n], name[n] = free_name(f"value_{n}", df), free_name(f"sofar_{n}", df)
    rows = df.withColumns({value[n]: v for n, (_, v) in wanted.items()} | {spread: F.rand()})
    ranged = stash(rows.repartitionByRange(F.col(group), *order, F.col(spread)).withColumn(part, F.spark_partition_id()), "ranges")
    how: dict[str, Callable] = {n: getattr(F, kind) for n, (kind, _) in wanted.items()}
    totals = ranged.groupBy(F.col(group), F.col(part)).agg(*[how[n](value[n]).alias(name[n]) for n in wanted])
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    key, at = free_name("group", ranged), free_name("range", ranged)
    offsets = totals.select(F.col(group).alias(key), F.col(part).alias(at), *[how[n](name[n]).over(earlier).alias(name[n]) for n in wanted])
    met = ranged.join(offsets, F.col(group).eqNullSafe(F.col(key)) & (F.col(part) == F.col(at)))
    inside = Window.partitionBy(group, part).orderBy(*order, spread).rowsBetween(Window.unboundedPreceding, -1)
    found = {n: JOINED[wanted[n][0]](F.col(name[n]), how[n](value[n]).over(inside)) for n in wanted}
    return met.select(*df.columns, *[c.alias(n) for n, c in found.items()])
