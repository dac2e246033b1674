"""Running totals over rows in an order, without a group ever meeting in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakespark.session import free_name, materialise


def running(
    rows: DataFrame,
    group: list[str],
    order: list[Column],
    values: dict[str, Column],
    facts: DataFrame | None = None,
    fold: Callable[[Column], Column] = F.sum,
    join: Callable[[Column, Column], Column] = lambda a, b: a + b,
) -> DataFrame:
    """``rows`` with, under each name of ``values``, the fold of that value over the rows before it in its group (0 at first).

    Rows are range-partitioned by group and order, so that a hot group is spread over as many tasks as its rows
    need; each range is folded on its own, and only one row for each range and group meets in the window that
    carries the totals on. ``facts`` (a row for each group) is joined to those few rows and comes along, so
    that no join has a hot key. Group columns hold no nulls; ``fold`` is associative with 0 as its neutral value
    (sums, exclusive ors), ``join`` does the same for two columns. Rows that are equal in group and order share
    no defined order; they are split between ranges like all others. ``rows`` is read twice: hand it over written.
    """
    part, tie = free_name("__part", rows), free_name("__tie", rows)
    base = {name: free_name(f"__base_{name}", rows) for name in values}
    dealt = materialise(
        rows.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(*map(F.col, group), *order, F.col(tie)).withColumn(part, F.spark_partition_id()),
        "ordered",
    )
    none = F.lit(0).cast("long")
    sums = dealt.groupBy(part, *group).agg(*(fold(value).alias(base[name]) for name, value in values.items()))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(part, *group, *(F.coalesce(fold(F.col(b)).over(before), none).alias(b) for b in base.values()))
    if facts is not None:
        bases = bases.join(facts, group)
    own = Window.partitionBy(part, *group).orderBy(*order, F.col(tie)).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumns({name: F.coalesce(fold(value).over(own), none) for name, value in values.items()})
    out = within.join(bases, [part, *group]).withColumns({name: join(F.col(name), F.col(b)) for name, b in base.items()}).drop(part, tie, *base.values())
    out.written_to = dealt.written_to
    return out
