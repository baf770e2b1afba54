"""Windows over daily series: lags, trailing statistics, anomalies, periodicity.

A daily series has a row a day and is small after aggregation.  Every function takes ``by``,
the columns that tell series apart; without it the one series goes to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(day: str, by: Sequence[str]):
    return Window.partitionBy(*by).orderBy(day)


def lags(df: DataFrame, columns: Sequence[str], steps: Sequence[int], day: str = "report_date", by: Sequence[str] = ()) -> DataFrame:
    """Lag n, change over n, and the change over 1 as of the day before, of each column."""
    w = _w(day, by)
    out = {}
    for c in columns:
        for n in steps:
            out[f"{c}_lag{n}"] = F.lag(c, n).over(w)
            out[f"{c}_diff{n}"] = F.col(c) - F.lag(c, n).over(w)
        out[f"{c}_diff1_lag1"] = F.lag(c, 1).over(w) - F.lag(c, 2).over(w)
    return df.withColumns(out)


def lagged_rolling(df: DataFrame, columns: Sequence[str], means: Sequence[int] = (7, 14, 28), stds: Sequence[int] = (7, 28), day: str = "report_date", by: Sequence[str] = ()) -> DataFrame:
    """Rolling means and sample deviations that end the day before: a row never sees itself.

    Null until the window is full.
    """
    out = {}
    for c in columns:
        for kind, sizes, f in (("mean", means, F.avg), ("std", stds, F.stddev_samp)):
            for n in sizes:
                w = _w(day, by).rowsBetween(-n, -1)
                out[f"{c}_{kind}{n}"] = F.when(F.count(c).over(w) == n, f(c).over(w))
    return df.withColumns(out)


def centered_mean(df: DataFrame, column: str, out: str, day: str = "report_date", by: Sequence[str] = (), size: int = 28, least: int = 14) -> DataFrame:
    """Mean over the ``size`` rows from size/2 before to size/2 - 1 after; null under ``least`` values.

    It sees the future, so it describes and never predicts.
    """
    w = _w(day, by).rowsBetween(-(size // 2), size - size // 2 - 1)
    return df.withColumn(out, F.when(F.count(column).over(w) >= least, F.avg(column).over(w)))


def _median(values: Column) -> Column:
    """Median of an array without nulls, between the two middle values."""
    s, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2.0)


def robust_score(df: DataFrame, column: str, prefix: str, day: str = "report_date", by: Sequence[str] = (), size: int = 28, least: int = 14) -> DataFrame:
    """|value - median| / (1.4826 * MAD) against the ``size`` rows before.

    The median needs ``least`` earlier values; the deviation needs all ``size``.  Null where
    either is missing or the deviation is zero.  Arrays are ``size`` long at most.
    """
    w = _w(day, by).rowsBetween(-size, -1)
    before = F.collect_list(F.col(column).cast("double")).over(w)
    df = df.withColumn("__before", before).withColumn(f"{prefix}_median", F.when(F.size("__before") >= least, _median(F.col("__before"))))
    middle = _median(F.col("__before"))
    df = df.withColumn("__middle", middle).withColumn(f"{prefix}_mad", F.when(F.size("__before") >= size, _median(F.transform("__before", lambda x: F.abs(x - F.col("__middle"))))))
    score = F.try_divide(F.abs(F.col(column) - F.col(f"{prefix}_median")), 1.4826 * F.col(f"{prefix}_mad"))
    return df.withColumn(f"{prefix}_score", score).drop("__before", "__middle")


def anomalies(df: DataFrame, columns: Sequence[str], day: str = "report_date", by: Sequence[str] = (), threshold: float = 6.0) -> DataFrame:
    """Long form: day, metric, value, trailing and same-weekday scores, the larger one, and the flag."""
    long = df.select(*by, day, F.weekday(day).alias("weekday"), F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])))
    scored = robust_score(long, "value", "trailing", day, [*by, "metric"])
    scored = robust_score(scored, "value", "weekday", day, [*by, "metric", "weekday"], size=8, least=4)
    worst = F.greatest("trailing_score", "weekday_score")
    return scored.withColumn("robust_score", worst).withColumn("is_anomaly", F.coalesce(worst > threshold, F.lit(False)))


def trailing(df: DataFrame, column: str, sizes: Sequence[int] = (7, 14, 28), slopes: Sequence[int] = (14, 28), day: str = "report_date", by: Sequence[str] = ()) -> DataFrame:
    """As of each row, itself included: mean, median, population CV over the last n, and slope of log1p."""
    out = {}
    for n in sizes:
        w = _w(day, by).rowsBetween(-(n - 1), 0)
        mean = F.avg(column).over(w)
        out |= {
            f"mean{n}": mean, f"median{n}": F.percentile(column, F.lit(0.5)).over(w),
            f"cv{n}": F.coalesce(F.try_divide(F.stddev_pop(column).over(w), mean), F.lit(0.0)),
        }
    df = df.withColumn("__idx", F.row_number().over(_w(day, by)).cast("double")).withColumn("__log", F.log1p(F.greatest(F.col(column).cast("double"), F.lit(0.0))))
    for n in slopes:
        w = _w(day, by).rowsBetween(-(n - 1), 0)
        out[f"slope{n}"] = F.when(F.count("__log").over(w) > 1, F.regr_slope("__log", "__idx").over(w))
    return df.withColumns(out).drop("__idx", "__log")


def autocorrelation(df: DataFrame, column: str, lags_: int = 60, day: str = "report_date", by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of the series with itself, 1 to ``lags_`` rows later; null where a side is constant."""
    from .association import correlation

    rows = df.select(*by, F.row_number().over(_w(day, by)).alias("i"), F.col(column).cast("double").alias("x"))
    steps = rows.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags_)))).withColumn("j", F.col("i") + F.col("lag"))
    pairs = steps.join(rows.select(*by, F.col("i").alias("j"), F.col("x").alias("y")), [*by, "j"])
    return pairs.where("x is not null and y is not null").groupBy(*by, "lag").agg(correlation("x", "y").alias("autocorrelation"), F.count("*").alias("pairs"))


def periodogram(df: DataFrame, column: str, day: str = "report_date", low: float = 2.0, high: float = 90.0, top: int = 10) -> DataFrame:
    """Strongest periods of the demeaned series under a Hann window, by the discrete Fourier transform.

    The transform is an aggregation over (day, frequency) pairs of one daily series.
    """
    n_mean = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"))
    rows = df.where(F.col(column).isNotNull()).select((F.row_number().over(_w(day, ())) - 1).alias("t"), F.col(column).cast("double").alias("x"))
    pi = 3.141592653589793
    hann = 0.5 - 0.5 * F.cos(2 * pi * F.col("t") / (F.col("n") - 1))
    base = rows.crossJoin(F.broadcast(n_mean)).where("n > 2").select("t", "n", ((F.col("x") - F.col("mean")) * hann).alias("x"))
    waves = base.withColumn("k", F.explode(F.sequence(F.lit(1), F.floor(F.col("n") / 2).cast("int"))))
    angle = 2 * pi * ((F.col("k") * F.col("t")) % F.col("n")) / F.col("n")
    power = waves.groupBy("k", "n").agg((F.pow(F.sum(F.col("x") * F.cos(angle)), F.lit(2.0)) + F.pow(F.sum(F.col("x") * F.sin(angle)), F.lit(2.0))).alias("power"))
    periods = power.withColumn("period_days", F.col("n") / F.col("k")).where(F.col("period_days").between(low, high))
    return periods.orderBy(F.desc("power"), "k").limit(top).select(F.col("k").cast("int").alias("k"), "period_days", "power")


def weekday_profile(df: DataFrame, column: str, day: str = "report_date") -> DataFrame:
    """Of each weekday: days, mean, median, and its mean against that of all days; R2 of the weekday means on log1p."""
    base = df.select(F.weekday(day).alias("weekday"), F.col(column).cast("double").alias("v"), F.log1p(column).alias("l"))
    days = base.groupBy("weekday").agg(F.count("v").alias("days"), F.avg("v").alias("mean"), F.percentile("v", F.lit(0.5)).alias("median"), F.count("l").alias("n"), F.avg("l").alias("ml"))
    whole = base.agg(F.avg("v").alias("all_mean"), F.avg("l").alias("all_ml"), F.var_pop("l").alias("all_var"), F.count("l").alias("all_n"))
    between = days.crossJoin(F.broadcast(whole)).agg(F.try_divide(F.sum(F.col("n") * F.pow(F.col("ml") - F.col("all_ml"), F.lit(2.0))), F.first("all_var") * F.first("all_n")).alias("r2"))
    return days.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(between)).select("weekday", "days", "mean", "median", F.try_divide("mean", "all_mean").alias("index"), F.col("r2").alias("weekday_r2"))


def average_rank(column: str, by: Sequence[str] = ()) -> Column:
    """Rank from 1; ties share the mean of their ranks."""
    ties = Window.partitionBy(*by, column)
    return F.rank().over(Window.partitionBy(*by).orderBy(column)) + (F.count("*").over(ties) - 1) / 2.0


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("__rn = 1").drop("__rn")
