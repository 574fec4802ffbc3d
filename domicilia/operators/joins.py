"""Joins: checked broadcast, hot keys, NULL-safe keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE_LIMIT = 200_000
SALTS = 64
HOT_ROWS = 500_000
HOT_FRACTION = 0.01


@dataclass(frozen=True)
class Side:
    """The small side of a join, with the answer to "was its size checked?"."""

    frame: DataFrame
    bounded: bool
    rows: pa.Table | None = None

    def map(self, change) -> Side:
        """Same side after a step that adds no rows."""
        return Side(change(self.frame), self.bounded)


def bounded_side(frame: DataFrame, limit: int = SIDE_LIMIT) -> Side:
    """Fetch an aggregate that is expected to be small.

    At most ``limit + 1`` rows reach the driver. If all fit, they become a local
    table that may be broadcast; if not, the distributed frame is kept.
    """
    rows = frame.limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        return Side(frame, False)
    return Side(frame.sparkSession.createDataFrame(rows, frame.schema), True, rows)


def attach(big: DataFrame, side: Side, on: Sequence[str], salt_by: Sequence[str], how: str = "left") -> DataFrame:
    """Join columns of a few groups (strata, post-strata) to many rows.

    A bounded side is broadcast. Beyond the bound the join is salted, since one
    group may hold a large part of the rows. The salt is a hash of `salt_by`, so a
    lost task gives the same rows when it runs again.
    """
    on = list(on)
    if side.bounded:
        return big.join(F.broadcast(side.frame), on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(SALTS)).cast("int"))
    copies = side.frame.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def hot_keys(
    frame: DataFrame, on: Sequence[str], rows: int | None = None, fraction: float | None = None, limit: int = SIDE_LIMIT
) -> DataFrame | None:
    """Keys held by more than about `rows` rows, as a local table; None if there are none.

    Judged from a sample. It only decides how rows travel in a join, never which rows
    take part, so a key missed or listed without need costs time, not results.
    """
    rows, fraction = rows or HOT_ROWS, fraction or HOT_FRACTION
    sample = frame.select(*on).sample(fraction, 1) if fraction < 1 else frame.select(*on)
    counts = sample.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows * fraction)
    side = bounded_side(counts.drop("_n").na.drop(), limit)
    return side.frame if side.rows is not None and side.rows.num_rows else None


def join_to_unique(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", hot: DataFrame | None = None
) -> DataFrame:
    """Join many rows per key to one row per key of `right`, by left or inner join.

    Rows of the `hot` keys (see `hot_keys`, on some or all of the join columns) stay
    where they are and meet their few partners by broadcast. All other rows are
    shuffled. The engine's own splitting of skewed partitions does not help here: it
    needs both sides to come straight from a shuffle, not from an aggregation.
    """
    on = list(on)
    if hot is None:
        return left.join(right, on, how)
    keys, hot_on = F.broadcast(hot), hot.columns
    cold = left.join(keys, hot_on, "left_anti").join(right, on, how)
    partners = right.join(keys, hot_on, "left_semi")
    return cold.unionByName(left.join(keys, hot_on, "left_semi").join(F.broadcast(partners), on, how))


def left_join_fan_out(left: DataFrame, right: DataFrame, on: Sequence[str], hot: DataFrame | None = None) -> DataFrame:
    """Left join of one row per key to many; `hot` names the hot keys of `right`.

    The matches are found from the side of the many, then the rows without a partner
    are added.
    """
    on = list(on)
    matched = join_to_unique(right, left, on, "inner", hot)
    alone = left.join(right.select(*on).distinct(), on, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def null_safe_left_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left equi-join in which a NULL key matches a NULL key."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    joined = left.join(renamed, null_safe(left, renamed, [(c, f"_r_{c}") for c in on]), "left")
    return joined.drop(*[f"_r_{c}" for c in on])


def natural_join_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on all shared columns, NULLs matching, as a bag.

    Equal rows multiply in such a join. Each distinct result row comes once with
    `copies`, the number of times the join holds it, so that a large group of equal
    rows is counted on both sides instead of paired.
    """
    shared = [c for c in left.columns if c in right.columns]
    lefts = left.groupBy(*left.columns).agg(F.count("*").alias("_left"))
    rights = right.groupBy(*right.columns).agg(F.count("*").alias("_right"))
    joined = null_safe_left_join(lefts, rights, shared)
    copies = F.col("_left") * F.coalesce("_right", F.lit(1))
    return joined.withColumn("copies", copies).drop("_left", "_right")
