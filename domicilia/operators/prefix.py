"""Positions, ranks and running totals in a global order, however long a group is.

Rows are dealt to range partitions, sorted there and stored, which fixes the partition and
the line of each. The totals of the partitions are few; their exclusive running totals are
the offsets at which the partitions start. No window spans a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domicilia.operators.joins import SIDE_LIMIT, Side, bounded_side, null_safe
from domicilia.session import materialize

_LINE = (1 << 33) - 1  # the lower bits of monotonically_increasing_id count inside a partition


def ordered(frame: DataFrame, order: Sequence[Column | str], partitions: int | None = None) -> DataFrame:
    """Stored rows with `_part`, their range partition, and `_line`, their place in it.

    Rows that are equal in the whole order may be dealt to several partitions, by the input
    partition they come from, so that one value may hold any share of the rows.
    """
    spark = frame.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, "_tie"]
    dealt = frame.withColumn("_tie", F.spark_partition_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    line = F.monotonically_increasing_id().bitwiseAND(F.lit(_LINE))
    return materialize(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_line", line).drop("_tie"))


def _attach_spans(rows: DataFrame, spans: DataFrame, by: Sequence[str], limit: int) -> DataFrame:
    """Columns of (`_part`, group) spans on their rows; NULL is a group like any other."""
    keys = ["_part", *by]
    side = bounded_side(spans.withColumnsRenamed({k: f"_s{k}" for k in keys}), limit)
    right = F.broadcast(side.frame) if side.bounded else side.frame
    return rows.join(right, null_safe(rows, right, [(k, f"_s{k}") for k in keys]), "left").drop(*[f"_s{k}" for k in keys])


def _earlier(by: Sequence[str]) -> Window:
    """The partitions of a group before the current one: as many rows as partitions at most."""
    return Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def positions(
    frame: DataFrame, by: Sequence[str], order: Sequence[Column | str], partitions: int | None = None, limit: int = SIDE_LIMIT
) -> DataFrame:
    """`position` of each row in its group, from 0, and the group's `group_rows`.

    `by` names one column at least. Rows that are equal in the whole order get their places in any order.
    """
    rows = ordered(frame, [*by, *order], partitions)
    spans = rows.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_line").alias("_first"))
    whole = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = spans.select(
        "_part",
        *by,
        (F.coalesce(F.sum("_n").over(_earlier(by)), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("group_rows"),
    )
    joined = _attach_spans(rows, placed, by, limit)
    return joined.withColumn("position", F.col("_line") + F.col("_shift")).drop("_part", "_line", "_shift")


def _offsets(rows: DataFrame) -> Side:
    """`_before`, the rows in earlier partitions, for each partition: one row each, summed up here."""
    counts = sorted(rows.groupBy("_part").agg(F.count("*").alias("_n")).collect())
    found, before = [], 0
    for part, n in counts:
        found.append((part, before))
        before += n
    return Side(rows.sparkSession.createDataFrame(found, "_part int, _before long"), True)


def dense_ranks(frame: DataFrame, value: str, name: str = "rank", descending: bool = False, partitions: int | None = None) -> DataFrame:
    """The distinct values of a column with their rank from 1; NULL comes first, or last if descending."""
    column = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_first()
    rows = ordered(frame.select(value).distinct(), [column], partitions)
    joined = rows.join(F.broadcast(_offsets(rows).frame), "_part")
    return joined.select(value, (F.col("_before") + F.col("_line") + 1).cast("int").alias(name))


def _combined(kind: str, before: Column, local: Column) -> Column:
    both = before + local if kind == "sum" else before * local
    return F.coalesce(both, local, before)


def running_total(
    frame: DataFrame,
    value: str,
    by: Sequence[str],
    order: Sequence[Column | str],
    name: str,
    kind: str = "sum",
    partitions: int | None = None,
    limit: int = SIDE_LIMIT,
) -> DataFrame:
    """Running sum or product from the first row of the group to the current one, as column `name`.

    NULL values are passed over; before the first known value the total is NULL. `by` names one
    column at least; a hot group is scanned by many tasks, each the rows of one range partition.
    """
    combine = getattr(F, kind)
    rows = ordered(frame, [*by, *order], partitions)
    spans = rows.groupBy("_part", *by).agg(combine(value).alias("_total"))
    before = spans.select("_part", *by, combine("_total").over(_earlier(by)).alias("_before"))
    inside = Window.partitionBy("_part", *by).orderBy("_line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("_local", combine(value).over(inside))
    joined = _attach_spans(local, before, by, limit)
    return joined.withColumn(name, _combined(kind, F.col("_before"), F.col("_local"))).drop("_part", "_line", "_before", "_local")
