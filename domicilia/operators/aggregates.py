"""Aggregate, window and reshape operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from domicilia.operators.joins import hot_keys, join_to_unique, null_safe_left_join
from domicilia.operators.prefix import dense_ranks
from domicilia.session import materialize

LISTED_KEYS = 5_000
WIDE_KEYS = 1_000


def strict_sum(value: Column, where: Column | None = None) -> Column:
    """Sum that is NULL as soon as one value of the group is NULL."""
    if where is None:
        return F.when(F.count(value) == F.count("*"), F.sum(value))
    kept = F.count(F.when(where, 1))
    known = F.count(F.when(where, value))
    return F.when((kept > 0) & (known == kept), F.sum(F.when(where, value)))


def total_rows(frame: DataFrame, by: Sequence[str], keep: Sequence[str], aggregates: Sequence[Column], fill: str) -> DataFrame:
    """Groups, their outer groups and the grand total in one pass.

    `by` is rolled up from the right; a rolled-up key carries `fill`. The columns in
    `keep` are grouping keys of every row.
    """
    by, keep = list(by), list(keep)
    sets = [[*by[:n], *keep] for n in range(len(by), -1, -1)]
    marks = [F.grouping(c).alias(f"_g_{c}") for c in by]
    grouped = frame.groupingSets(sets, *by, *keep).agg(*marks, *aggregates)
    labelled = {c: F.when(F.col(f"_g_{c}") == 1, F.lit(fill)).otherwise(F.col(c).cast("string")) for c in by}
    return grouped.withColumns(labelled).drop(*[f"_g_{c}" for c in by])


def running(value: Column, by: Sequence[str], order: Column, kind: str = "sum") -> Column:
    """Running sum or product from the first row of the group to the current one."""
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return getattr(F, kind)(value).over(frame)


def partition_sum(frame: DataFrame, value: Column, by: Sequence[str], name: str) -> DataFrame:
    """Group sum on every row of the group.

    Aggregated first and joined back, so that a hot group is combined before the
    shuffle and its rows need not meet in one task, as they would in a window. Rows with a
    NULL key are a group like any other; the one group of a single NULL key is broadcast.
    """
    sums = frame.groupBy(*by).agg(F.sum(value).alias(name))
    known = reduce(and_, [F.col(c).isNotNull() for c in by])
    keyed = join_to_unique(frame.filter(known), sums.filter(known), by, "left", hot_keys(frame, by))
    unkeyed = sums.filter(~known)
    if len(by) == 1:
        unkeyed = F.broadcast(unkeyed)
    return keyed.unionByName(null_safe_left_join(frame.filter(~known), unkeyed, by))


def rank_groups(frame: DataFrame, group: str, statistic: Column, name: str = "rank") -> DataFrame:
    """Position of each group by a statistic of its rows (sum, max, ...), however many groups there are."""
    # Stored, since sums of doubles made twice may differ in their last bits.
    order = materialize(frame.groupBy(group).agg(statistic.alias("_stat")))
    ranked = null_safe_left_join(order, dense_ranks(order, "_stat", name), ["_stat"]).drop("_stat")
    return null_safe_left_join(frame, ranked, [group])


def spread(frame: DataFrame, rows: Sequence[str], key: str, value: str, keys: Sequence, fill: float | None = None) -> DataFrame:
    """Long to wide over the given key values, one cell per key and row; a second one is an error."""
    twice = F.raise_error(F.lit(f"{key} has two cells in one row")).cast(frame.schema[value].dataType)
    wide = frame.groupBy(*rows).pivot(key, list(keys)).agg(F.when(F.count(F.lit(1)) <= 1, F.max(value)).otherwise(twice))
    return wide if fill is None else wide.fillna(fill, subset=[str(k) for k in keys])


def known_keys(frame: DataFrame, key: str, limit: int = LISTED_KEYS) -> list | None:
    """The distinct values of a column in order, NULL first; None if there are more than `limit`."""
    rows = frame.select(key).distinct().limit(limit + 1).collect()
    return sorted((r[0] for r in rows), key=lambda k: (k is not None, k)) if len(rows) <= limit else None


def spread_open(frame: DataFrame, rows: Sequence[str], key: str, value: str, fill: float | None = None) -> DataFrame:
    """Long to wide over all key values that occur, one column each; a NULL key becomes the column `NA`."""
    text = F.coalesce(F.col(key).cast("string"), F.lit("NA"))
    keys = known_keys(frame.select(key, text.alias("_name")).distinct().select("_name"), "_name", WIDE_KEYS)
    if keys is None:
        raise ValueError(f"{key} has more than {WIDE_KEYS} values, too many for columns")
    return spread(frame.withColumn(key, text), rows, key, value, keys, fill)


def complete_open(
    frame: DataFrame, rows: Sequence[str], key: str, value: str, limit: int = LISTED_KEYS, salts: int = 64
) -> DataFrame:
    """Every row with every key that occurs anywhere; cells that were missing or NULL are zero.

    The keys need not be known before. Up to `limit` of them are fetched and listed in the plan;
    beyond, rows and keys are both dealt over `salts` parts and meet there. NULL is a row
    or key like any other. A second cell for one row and key is an error.
    """
    rows = list(rows)
    twice = F.raise_error(F.concat(F.lit(f"{key} has two cells in one row: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))
    one = F.when(F.count(F.lit(1)) <= 1, F.max(value)).otherwise(twice.cast(frame.schema[value].dataType))
    cells = frame.groupBy(*rows, key).agg(one.alias(value))
    groups = frame.select(*rows).distinct()
    keys = known_keys(frame, key, limit)
    if keys is not None:
        kind = frame.schema[key].dataType
        listed = F.array(*[F.lit(k).cast(kind) for k in keys]) if keys else F.array().cast(ArrayType(kind))
        grid = groups.withColumn(key, F.explode(listed))
    else:
        salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        dealt = frame.select(key).distinct().withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
        grid = salted.join(dealt.hint("shuffle_hash"), "_salt").select(*rows, key)
    filled = null_safe_left_join(grid, cells, [*rows, key])
    return filled.select(*rows, key, F.coalesce(value, F.lit(0).cast(frame.schema[value].dataType)).alias(value))


def gather(frame: DataFrame, ids: Sequence[str], columns: Sequence[str], key: str, value: str) -> DataFrame:
    """Wide to long."""
    return frame.unpivot(list(ids), list(columns), key, value)


def complete(frame: DataFrame, rows: Sequence[str], key: str, value: str, keys: Sequence) -> DataFrame:
    """Every row with every key; cells that were missing or NULL are zero. Another key is an error."""
    listed = F.when(F.col(key).isin(list(keys)), F.col(key))
    other = F.raise_error(F.concat(F.lit(f"{key} is not listed: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))
    wide = spread(frame.withColumn(key, F.coalesce(listed, other)), rows, key, value, keys, 0.0)
    return gather(wide, rows, [str(k) for k in keys], key, value)


def round_numeric(frame: DataFrame, digits: int) -> DataFrame:
    """Round every fractional column, ties to the even digit."""
    numeric = [f.name for f in frame.schema if f.dataType.typeName() in ("double", "float", "decimal")]
    return frame.withColumns({c: F.bround(c, digits) for c in numeric})


def column_range(frame: DataFrame, first: str, last: str) -> list[str]:
    names = frame.columns
    return names[names.index(first) : names.index(last) + 1]
