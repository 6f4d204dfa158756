"""Row numbers in a total order, without a window over one partition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.shared import kept

#: The least part of a share that is worth a task of its own.
SMALL = 16


def dealt(df: DataFrame, keys: list[str], share: int) -> DataFrame:
    """``df`` dealt by ``keys`` to so many tasks that one has about ``share`` rows, however many rows there are.

    Rows are counted first.  Few rows are dealt to as many tasks as there are cores.
    """
    rows = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, -(-rows // share), min(cores, rows * SMALL // share)), *keys)


PLACE, PART, SHIFT, SIZE = "__place", "__part", "__shift", "__size"


def numbered(df: DataFrame, order: list[Column | str], within: list[str] | None = None, name: str = "number", size: str | None = None) -> DataFrame:
    """``df`` with ``name``, the place of a row (long, from 0) by ``order`` in its group ``within``; ``size`` adds the group's row count.

    Rows are dealt by ranges of (within, order), sorted where they are and
    written with their place in the file; one count for each file and group, of
    which there are few, gives the offsets.  So a group of any size is spread
    over as many tasks as it needs.  Rows equal in all of ``order`` are in one
    task and numbered in any order; nulls are a group, and come first in an order.
    """
    within = within or []
    keys = [*within, *order]
    sorted_rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = kept(sorted_rows.select("*", F.monotonically_increasing_id().alias(PLACE)), "ordered")
    part = F.shiftright(PLACE, 33)
    counts = at.groupBy(part.alias(PART), *within).agg(F.count("*").alias("n"), F.min(PLACE).alias("first"))
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    before = F.sum("n").over(group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    names = {c: f"__w{k}" for k, c in enumerate(within)}
    offsets = counts.select(PART, *(F.col(c).alias(a) for c, a in names.items()), (F.coalesce(before, F.lit(0)) - F.col("first")).alias(SHIFT), F.sum("n").over(group).alias(SIZE))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(a)) for c, a in names.items()), part == F.col(PART))
    out = at.join(offsets, same).select(*df.columns, (F.col(PLACE) + F.col(SHIFT)).alias(name), *([F.col(SIZE).alias(size)] if size else []))
    return out
