"""Joins with declared cardinality, set operations, calendars and as-of fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class CardinalityError(ValueError):
    """A key that should be unique is not."""


def assert_unique(df: DataFrame, keys: Sequence[str], side: str) -> None:
    """Raise unless the keys are unique; one aggregation, which stops at the first duplicate."""
    if not df.groupBy(*keys).count().where(F.col("count") > 1).isEmpty():
        raise CardinalityError(f"{side} keys {list(keys)} are not unique")


def join_checked(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "many_to_one", marker: str | None = None) -> DataFrame:
    """An equi-join whose cardinality is checked: one_to_one, many_to_one or one_to_many.

    ``marker`` names a boolean column that tells whether the right side matched.
    """
    if validate in ("one_to_one", "one_to_many"):
        assert_unique(left, on, "left")
    if validate in ("one_to_one", "many_to_one"):
        assert_unique(right, on, "right")
    if marker:
        right = right.withColumn(marker, F.lit(True))
    out = left.join(right, list(on), how)
    return out.withColumn(marker, F.coalesce(marker, F.lit(False))) if marker else out


def set_gaps(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that stand on one side only: the keys and ``missing_in`` (left or right)."""
    a, b = left.select(*on).distinct(), right.select(*on).distinct()
    return a.join(b, list(on), "left_anti").withColumn("missing_in", F.lit("right")).unionByName(b.join(a, list(on), "left_anti").withColumn("missing_in", F.lit("left")))


def same_sets(left: DataFrame, right: DataFrame, on: Sequence[str]) -> bool:
    return set_gaps(left, right, on).isEmpty()


def duplicated(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")


def calendar(df: DataFrame, day: str, start=None, end=None) -> DataFrame:
    """Every day from the first to the last, or between the given ones.

    The bounds are one aggregated row; the days are made from it, not collected.
    """
    low = F.min(day) if start is None else F.lit(start).cast("date")
    high = F.max(day) if end is None else F.lit(end).cast("date")
    bounds = df.agg(low.alias("lo"), high.alias("hi")).where("lo is not null")
    return bounds.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias(day))


def densify(df: DataFrame, day: str, start=None, end=None) -> DataFrame:
    """``df`` on a gap-free calendar; columns are null on days that it lacks."""
    return calendar(df, day, start, end).join(df, day, "left")


def missing_days(df: DataFrame, day: str, start=None, end=None) -> DataFrame:
    return calendar(df, day, start, end).join(df.select(day).distinct(), day, "left_anti")


def forward_fill(df: DataFrame, day: str, columns: Sequence[str], by: Sequence[str] = (), observed: str = "is_observed", staleness: str = "days_since_observation") -> DataFrame:
    """Last observed value of each column, whether the day was observed, and days since it was.

    A day counts as observed if any of the columns is there.  Without ``by`` the series goes
    to one task, so it has to be an aggregated one (a row a day).
    """
    seen = F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()
    w = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns(
        {c: F.last(c, ignorenulls=True).over(w) for c in columns}
        | {observed: seen, staleness: F.datediff(day, F.max(F.when(seen, F.col(day))).over(w)).cast("smallint")}
    )


def in_windows(panel: DataFrame, windows: DataFrame, day: str, condition: Column) -> DataFrame:
    """Rows of the panel beside each window that they belong to.

    ``windows`` is configuration, a handful of rows, and is broadcast; the panel is scanned
    once for all windows and not shuffled.
    """
    return panel.join(F.broadcast(windows), condition)


def grid(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of two small literal tables."""
    return left.crossJoin(F.broadcast(right))


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """Wide to long in one pass over the rows."""
    return df.unpivot(list(ids), list(columns), name, value)
