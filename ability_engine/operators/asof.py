"""Lookups of the last row before a place and the first one after it, without a join of pairs and without one task for all.

Points are reduced to their distinct places, and merged with the knots in ranges of places: bounds are quantiles of both, so a key with most of the rows is cut as
well. In a range, a window meets each place with the last knot before it and the first one after it. What lies in other ranges is carried: a row for
each key and range, at most ``ranges`` for a key. Points then take what their place has got by an equi-join.

Defined cases: of several knots at one place, the greatest value counts. Places and keys that are null meet nothing. Without knots every point gets null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGES = 64


def position(df: DataFrame, on: str) -> Column:
    """The place as a number: days, microseconds or the number itself."""
    kind = df.schema[on].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(on).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(on).cast("double")
    return F.col(on).cast("double")


def around(points: DataFrame, knots: DataFrame, by: tuple[str, ...], on: str, value: str, ranges: int = RANGES) -> DataFrame:
    """``points`` with the structs (at, v) of the last knot at or before their place, ``before``, and of the first one at or after it, ``after``."""
    marks = knots.select(*by, position(knots, on).alias("_x"), F.col(value).alias("_v")).where("_x is not null").groupBy(*by, "_x").agg(F.max("_v").alias("_v"))
    mark = F.struct(F.col("_x").alias("at"), F.col("_v").alias("v"))
    places = points.select(*by, position(points, on).alias("_x")).where("_x is not null").distinct()
    both = marks.select(*by, "_x", mark.alias("_mark")).unionByName(places.select(*by, "_x"), allowMissingColumns=True)
    # ``ranges`` numbers at most.
    cuts = both.agg(F.percentile_approx("_x", [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or []
    steps = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>")
    both = both.withColumn("_range", F.size(F.filter(steps, lambda c: c < F.col("_x"))))

    one = Window.partitionBy(*by, "_range")
    within = both.withColumns(
        {
            "_before": F.last("_mark", True).over(one.orderBy("_x", F.col("_mark").isNull()).rowsBetween(Window.unboundedPreceding, 0)),
            "_after": F.last("_mark", True).over(one.orderBy(F.desc("_x"), F.col("_mark").isNull()).rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).where("_mark is null")
    line = Window.partitionBy(*by).orderBy("_range")  # a row for each range
    ends = both.groupBy(*by, "_range").agg(F.max("_mark").alias("_last"), F.min("_mark").alias("_first"))
    carried = ends.select(
        *by, "_range", F.last("_last", True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"), F.first("_first", True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("_later")
    )
    met = within.join(carried, [*by, "_range"]).select(*by, "_x", F.coalesce("_before", "_earlier").alias("before"), F.coalesce("_after", "_later").alias("after"))
    return points.withColumn("_x", position(points, on)).join(met, [*by, "_x"], "left").select(*points.columns, "before", "after")


def last_before(points: DataFrame, knots: DataFrame, by: tuple[str, ...], on: str, value: str) -> DataFrame:
    """``points`` with the value of the last knot at or before their place."""
    return around(points, knots, by, on, value).select(*points.columns, F.col("before.v").alias(value))
