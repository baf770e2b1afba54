"""Exact quantiles of large groups, with linear interpolation.

Spark's ``percentile`` holds every distinct value of a group in one buffer, which suits a
user's days but not all users.  Here values are counted first (partial sums before the
shuffle), the counts of ranges of values tell in which range a rank falls, and only the
distinct values of that range are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges for each doubling of a value.
STEPS = 256


def group_quantiles(rows: DataFrame, by: Sequence[str], value: str = "v", p: str = "p") -> DataFrame:
    """``by`` and ``quantile``: of each group the quantile that its column ``p`` (one number a group) names.

    Null values are left out; a group without values has no row.
    """
    base = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"), F.col(p).cast("double").alias("p"))
    counts = base.groupBy(*by, "v").agg(F.count("*").alias("n"), F.first("p").alias("p"))
    counts = counts.withColumn("range", F.floor(F.signum("v") * F.log2(F.abs("v") + 1.0) * STEPS))
    order = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy(*by, "range").agg(F.sum("n").alias("rows"), F.first("p").alias("p"))
    ranges = ranges.withColumns({"below": F.coalesce(F.sum("rows").over(order), F.lit(0)), "all": F.sum("rows").over(Window.partitionBy(*by))})
    place = F.col("p") * (F.col("all") - 1)
    wanted = ranges.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))))
    edges = wanted.where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("rows"))).select(*by, "range", "below", "rank", (F.col("rank") - place).alias("off"))
    inside = counts.drop("p").join(edges, [*by, "range"])
    upto = Window.partitionBy(*by, "range", "rank").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    hits = inside.withColumn("end", F.col("below") + F.sum("n").over(upto)).where((F.col("end") > F.col("rank")) & (F.col("end") - F.col("n") <= F.col("rank")))
    # One row where the place is a whole number, else its two neighbours, each by how near it is.
    return hits.groupBy(*by).agg(F.sum(F.col("v") * (1.0 - F.abs("off"))).alias("quantile"))
