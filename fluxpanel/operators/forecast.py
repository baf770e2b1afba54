"""Baselines, seasonal anchor, ridge forecasts, component composition, weight search and backtests.

All work on daily tables, a row a day; windows are configuration rows (id, start, end) and
every window is evaluated in one plan by a range join.  Features of a day come from rows
before it alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import daily_score, month_features, relative_error, relative_error_floored, score_curve
from .joins import grid
from .series import trailing

# Fixed values of the forecaster.
LAGS = (1, 7, 14, 21, 28)
ROLLS = (7, 14, 28)
SLOPES = (14, 28)
HORIZON, MIN_HISTORY, HALF_LIFE, ALPHA = 30, 28, 180.0, 12.0
ANCHOR = (0.55, 0.30, 0.15)
DECAY = 0.82
RATES = 10_000.0


def future_days(windows: DataFrame) -> DataFrame:
    """Every day of every window with its horizon from 1 and its weekday."""
    days = windows.withColumn("target_date", F.explode(F.sequence("start", "end", F.expr("interval 1 day"))))
    return days.withColumns({"horizon": F.datediff("target_date", "start") + 1, "weekday": F.weekday("target_date")})


def history(daily: DataFrame, windows: DataFrame, days: int | None = None, day: str = "report_date") -> DataFrame:
    """Rows before each window's start, or the last ``days`` of them."""
    cond = F.col(day) < F.col("start")
    if days is not None:
        cond = cond & (F.col(day) >= F.date_sub(F.col("start"), days))
    return daily.join(F.broadcast(windows), cond)


def baselines(daily: DataFrame, windows: DataFrame, targets: Sequence[str], day: str = "report_date") -> DataFrame:
    """Four forecasts of each target and day: 30-day mean, weekday mean and median of 56 days, seasonal naive.

    The recursive seven-day naive forecast has a closed form: the value seven days before the
    start, plus the horizon within its week.
    """
    long = daily.select(day, F.inline(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("value")) for t in targets])))
    ahead = future_days(windows)
    mean30 = history(long, windows, 30, day).groupBy("id", "target").agg(F.avg("value").alias("predicted"))
    by_wd = history(long, windows, 56, day).groupBy("id", "target", F.weekday(day).alias("weekday")).agg(F.avg("value").alias("m"), F.percentile("value", F.lit(0.5)).alias("md"))
    naive = long.select(F.col(day).alias("source_date"), "target", F.col("value").alias("predicted"))
    out = ["id", "target", "target_date", "horizon"]
    a = ahead.join(mean30, "id").select(*out, F.lit("mean_30d").alias("method"), "predicted")
    w = ahead.join(by_wd, ["id", "weekday"])
    b, c = w.select(*out, F.lit("weekday_mean").alias("method"), F.col("m").alias("predicted")), w.select(*out, F.lit("weekday_median").alias("method"), F.col("md").alias("predicted"))
    back = ahead.withColumn("source_date", F.date_add(F.date_sub("start", 7), (F.col("horizon") - 1) % 7))
    d = back.join(naive, "source_date").select(*out, F.lit("seasonal_naive").alias("method"), "predicted")
    return a.unionByName(b).unionByName(c).unionByName(d)


def scored(predicted: DataFrame, daily: DataFrame, targets: tuple[str, str], by: Sequence[str] = ("id", "method"), day: str = "report_date", error=relative_error) -> DataFrame:
    """Days, mean errors, and mean daily scores along three curves, of two targets together."""
    actual = daily.select(F.col(day).alias("target_date"), F.inline(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("actual")) for t in targets])))
    both = predicted.where(F.col("target").isin(*targets)).join(actual, ["target_date", "target"])
    e = both.withColumn("error", error("actual", "predicted"))
    wide = e.groupBy(*by, "target_date").agg(*[F.max(F.when(F.col("target") == t, F.col("error"))).alias(n) for t, n in zip(targets, ("e1", "e2"))])
    curves = {n: F.avg(daily_score(score_curve("e1", p), score_curve("e2", p))) for n, p in (("linear", 1), ("quadratic", 2), ("cubic", 3))}
    return wide.groupBy(*by).agg(
        F.count("*").alias("days"), F.avg("e1").alias("purchase_error"), F.avg("e2").alias("redeem_error"), F.avg(daily_score("e1", "e2")).alias("weighted_error"),
        F.count_if((F.col("e1") >= 0.3) | (F.col("e2") >= 0.3)).alias("zero_days"), *[c.alias(n) for n, c in curves.items()],
    )


def score_curves(steps: int = 70, width: float = 200.0) -> Column:
    """Errors 0, 0.005, ... as an array to explode."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / F.lit(width))


def seasonal_anchor(daily: DataFrame, windows: DataFrame, targets: Sequence[str], day: str = "report_date") -> DataFrame:
    """Of each window, target and weekday: the blend of its last four, of its decayed last eight, and of the last 28 days.

    Never below 5 % of the 28-day level, nor below 1.
    """
    long = daily.select(day, F.inline(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("value")) for t in targets])))
    back = history(long, windows, 56, day).withColumns({"weekday": F.weekday(day), "k": F.floor((F.datediff("start", day) - 1) / 7)})
    level = history(long, windows, 28, day).groupBy("id", "target").agg(F.avg("value").alias("level"))
    weight = F.pow(F.lit(DECAY), F.col("k").cast("double"))
    wd = back.groupBy("id", "target", "weekday").agg(F.avg(F.when(F.col("k") < 4, F.col("value"))).alias("m4"), (F.sum(F.col("value") * weight) / F.sum(weight)).alias("m8"))
    blend = ANCHOR[0] * F.col("m4") + ANCHOR[1] * F.col("m8") + ANCHOR[2] * F.col("level")
    floor = F.greatest(F.lit(1.0), 0.05 * F.col("level"))
    return wd.join(level, ["id", "target"]).select("id", "target", "weekday", "level", F.greatest(blend, floor).alias("anchor"))


def anchored(daily: DataFrame, windows: DataFrame, targets: Sequence[str]) -> DataFrame:
    """The anchor as a forecast: id, target, target_date, horizon, predicted."""
    return future_days(windows).join(seasonal_anchor(daily, windows, targets), ["id", "weekday"]).select("id", "target", "target_date", "horizon", F.lit("seasonal_anchor").alias("method"), F.col("anchor").alias("predicted"))


def origin_features(daily: DataFrame, target: str, auxiliary: Sequence[str] = (), rates: Sequence[str] = (), day: str = "report_date") -> DataFrame:
    """One row per origin day, from that day and earlier rows alone: anchors by weekday, lags, trailing statistics.

    Lag 1 is the origin day itself; a lag that isn't there is null and becomes the anchor.
    """
    w = Window.orderBy(day)
    y = F.col(target).cast("double")
    base = daily.withColumns({"y": y, "weekday": F.weekday(day)} | {f"raw_lag{n}": F.lag(y, n - 1).over(w) for n in LAGS})
    base = trailing(base, "y", ROLLS, SLOPES, day)
    full = lambda n: w.rowsBetween(-(n - 1), 0)
    extra = {}
    for c in rates:
        for n in (7, 28):
            extra[f"{c}_change{n}"] = F.col(c) - F.coalesce(F.lag(c, n).over(w), F.first(c).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        extra[f"{c}_last"] = F.col(c)
    for c in auxiliary:
        v = F.greatest(F.col(c).cast("double"), F.lit(0.0))
        m7, m28 = F.avg(v).over(full(7)), F.avg(v).over(full(28))
        extra |= {f"{c}_log_last": F.log1p(v), f"{c}_log_mean7": F.log1p(m7), f"{c}_log_ratio": F.log1p(m7) - F.log1p(m28)}
    base = base.withColumns(extra)
    eight = F.collect_list(F.struct(F.weekday(day).alias("wd"), y.alias("v"))).over(full(56))
    base = base.withColumn("recent", eight).withColumn("seen", F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    keep = [c for c in base.columns if c not in daily.columns and c not in ("y", "weekday")]
    return base.select(F.col(day).alias("origin"), *keep, F.avg("y").over(full(28)).alias("level"))


def _weekday_anchor() -> Column:
    own = F.reverse(F.transform(F.filter("recent", lambda s: s["wd"] == F.col("target_weekday")), lambda s: s["v"]))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, v: x + v)
    m4 = F.try_divide(total(F.slice(own, 1, 4)), F.least(F.size(own), F.lit(4)))
    weights = F.transform(F.slice(own, 1, 8), lambda v, i: F.pow(F.lit(DECAY), i.cast("double")))
    m8 = F.try_divide(total(F.zip_with(F.slice(own, 1, 8), weights, lambda v, x: v * x)), total(weights))
    blend = ANCHOR[0] * F.coalesce(m4, "level") + ANCHOR[1] * F.coalesce(m8, "level") + ANCHOR[2] * F.col("level")
    return F.greatest(blend, F.greatest(F.lit(1.0), 0.05 * F.col("level")))


def with_target(origins: DataFrame, pairs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Feature rows of (origin, target_date) pairs, and the names of the features."""
    rows = pairs.join(origins, "origin").withColumns({"horizon": F.datediff("target_date", "origin"), "target_weekday": F.weekday("target_date")})
    rows = rows.withColumn("anchor", _weekday_anchor())
    cal = month_features("target_date")
    h = F.col("horizon") / 30.0
    made = {"f_horizon": h, "f_horizon2": h * h, "f_day": cal["day_share"], "f_to_end": cal["to_month_end"]}
    made |= {f"f_{n}": cal[n].cast("double") for n in ("weekend", "month_start", "month_end", "weekday_sin", "weekday_cos")}
    made |= {f"f_weekday{k}": (F.col("target_weekday") == k).cast("double") for k in range(7)}
    made["f_anchor"] = F.log1p("anchor")
    for n in LAGS:
        v = F.coalesce(F.col(f"raw_lag{n}"), F.col("anchor"))
        made |= {f"f_lag{n}": F.log1p(v), f"f_lag{n}_ratio": F.log1p(v) - F.log1p("anchor")}
    for n in ROLLS:
        made |= {f"f_mean{n}": F.log1p(f"mean{n}"), f"f_median{n}": F.log1p(f"median{n}"), f"f_cv{n}": F.col(f"cv{n}")}
    made |= {f"f_slope{n}": F.coalesce(f"slope{n}", F.lit(0.0)) for n in SLOPES}
    extra = [c for c in origins.columns if c.endswith(("_last", "_mean7", "_ratio", "_change7", "_change28"))]
    made |= {f"f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in extra}
    return rows.withColumns(made), list(made)


def training_rows(daily: DataFrame, origins: DataFrame, target: str, cutoff: str, day: str = "report_date") -> tuple[DataFrame, list[str]]:
    """Every (origin, day up to 30 later) before the cutoff, with label and half-life weight.

    The label is the log of the value less the log of the anchor.
    """
    cut = F.lit(cutoff).cast("date")
    known = daily.where(F.col(day) < cut).select(F.col(day).alias("target_date"), F.col(target).cast("double").alias("y"))
    starts = origins.where((F.col("origin") < cut) & (F.col("seen") >= MIN_HISTORY)).select("origin")
    pairs = starts.join(known, F.col("target_date").between(F.date_add("origin", 1), F.date_add("origin", HORIZON)))
    rows, names = with_target(origins, pairs)
    age = F.datediff(cut, "target_date").cast("double")
    return rows.withColumns({"label": F.log1p(F.greatest("y", F.lit(0.0))) - F.log1p("anchor"), "weight": F.pow(F.lit(0.5), age / HALF_LIFE)}), names


def fit_ridge(rows: DataFrame, names: Sequence[str], alpha: float = ALPHA) -> dict:
    """Standardised weighted ridge and the clip of its residual; a model of a few numbers.

    Spark scales the penalty by the weights and the label's deviation, so ``alpha`` becomes
    alpha / sum(w) * sd(label) to mean the same as an unscaled penalty.
    """
    stats = rows.agg(*[F.struct(F.avg(n).alias("m"), F.stddev_pop(n).alias("s")).alias(n) for n in names], F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("label")).alias("wy"), F.sum(F.col("weight") * F.col("label") * F.col("label")).alias("wyy"), F.percentile("label", F.array(F.lit(0.01), F.lit(0.99))).alias("q")).first()
    scale = {n: (stats[n].m, stats[n].s if stats[n].s > 1e-12 else 1.0) for n in names}
    sd = max(0.0, stats.wyy / stats.w - (stats.wy / stats.w) ** 2) ** 0.5
    low, high = max(-0.7, stats.q[0]), min(0.7, stats.q[1])
    model = {"names": list(names), "scale": scale, "low": low, "high": high}
    if sd == 0:
        return model | {"coefficients": [0.0] * len(names), "intercept": stats.wy / stats.w}
    std = rows.select("label", "weight", *[((F.col(n) - scale[n][0]) / scale[n][1]).alias(n) for n in names])
    fit = LinearRegression(solver="normal", standardization=False, elasticNetParam=0.0, regParam=alpha / stats.w * sd, weightCol="weight").fit(VectorAssembler(inputCols=list(names), outputCol="features").transform(std))
    return model | {"coefficients": fit.coefficients.toArray().tolist(), "intercept": fit.intercept}


def predict_ridge(rows: DataFrame, model: dict) -> DataFrame:
    """expm1(log1p(anchor) + clipped residual), never below zero; a projection."""
    raw = F.lit(float(model["intercept"]))
    for n, c in zip(model["names"], model["coefficients"]):
        raw = raw + (F.col(n) - float(model["scale"][n][0])) / float(model["scale"][n][1]) * float(c)
    resid = F.greatest(F.lit(float(model["low"])), F.least(F.lit(float(model["high"])), raw))
    return rows.withColumn("predicted", F.greatest(F.lit(0.0), F.expm1(F.log1p("anchor") + resid)))


def forecast(daily: DataFrame, target: str, cutoff: str, auxiliary: Sequence[str] = (), rates: Sequence[str] = ()) -> DataFrame:
    """Thirty days from the cutoff by ridge on the rows before it: target_date, anchor, predicted."""
    past = daily.where(F.col("report_date") < F.lit(cutoff).cast("date"))
    origins = origin_features(past, target, auxiliary, rates).cache()
    rows, names = training_rows(past, origins, target, cutoff)
    model = fit_ridge(rows, names)
    last = origins.agg(F.max("origin").alias("origin"))
    pairs = last.withColumn("target_date", F.explode(F.sequence(F.lit(cutoff).cast("date"), F.date_add(F.lit(cutoff).cast("date"), HORIZON - 1), F.expr("interval 1 day"))))
    ahead, _ = with_target(origins, pairs)
    return predict_ridge(ahead, model).select("target_date", "anchor", "predicted")


def share_rate(daily: DataFrame, rate: str, windows: DataFrame, day: str = "report_date") -> DataFrame:
    """Median of the last 14 days, within the 10th and 90th percentile of the last 56; a row a window."""
    back = history(daily, windows, 56, day).where(F.col(rate).isNotNull())
    q = F.percentile(rate, F.array(F.lit(0.1), F.lit(0.9)))
    m = F.percentile(F.when(F.col(day) >= F.date_sub("start", 14), F.col(rate)), F.lit(0.5))
    return back.groupBy("id").agg(F.greatest(q[0], F.least(q[1], m)).alias("rate"))


def balance_recursion(flows: DataFrame, opening: Column, rate: Column, by: Sequence[str] = ("id",), day: str = "target_date", overdrawn: bool = False) -> DataFrame:
    """Day by day: share = opening * rate / 10000; next opening = opening + direct + share - transfer - consume.

    The days of a window (a bounded array) are folded in one expression; a negative balance
    is an error, or with ``overdrawn`` goes on by the same rule.
    """
    days = flows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(day, "direct", "transfer", "consume"))).alias("days"), F.first(opening).alias("opening"), F.first(rate).alias("rate"))
    kind = f"array<struct<{day}:date,opening:double,share:double,closing:double>>"

    def step(acc: Column, x: Column) -> Column:
        start = F.when(F.size(acc) > 0, F.element_at(acc, -1)["closing"]).otherwise(F.col("opening").cast("double"))
        share = start * F.col("rate") / RATES
        end = start + x["direct"] + share - x["transfer"] - x["consume"]
        checked = end if overdrawn else F.when(end < 0, F.raise_error(F.lit("negative balance")).cast("double")).otherwise(end)
        return F.concat(acc, F.array(F.struct(x[day].alias(day), start.alias("opening"), share.alias("share"), checked.alias("closing"))))

    folded = days.withColumn("run", F.aggregate("days", F.array().cast(kind), step))
    return folded.select(*by, F.inline("run"))


def blend(seasonal: Column, component: Column, weight: Column) -> Column:
    """``weight`` of the seasonal forecast and the rest of the component forecast."""
    return weight * seasonal + (1.0 - weight) * component


def select_weights(predictions: DataFrame, spark_grid: DataFrame, least_better: int = 4) -> DataFrame:
    """Blend weights by a grid over folds, with a gate of stability; (1, 1) where none passes.

    ``predictions``: id, target_date, actual and two forecasts of each side (p_*, r_*).  A pair
    of weights passes if enough folds improve, the median gain is 1 % or more, no fold loses
    over 2 %, and no more days score zero than without a blend.
    """
    rows = grid(predictions, spark_grid)
    p, r = blend(F.col("p_seasonal"), F.col("p_component"), F.col("wp")), blend(F.col("r_seasonal"), F.col("r_component"), F.col("wr"))
    e = rows.withColumns({"ep": relative_error_floored("p_actual", p), "er": relative_error_floored("r_actual", r)})
    folds = e.groupBy("wp", "wr", "id").agg(F.avg(daily_score(score_curve("ep"), score_curve("er"))).alias("score"), F.count_if((F.col("ep") >= 0.3) | (F.col("er") >= 0.3)).alias("zero_days"))
    base = folds.where("wp = 1 and wr = 1").select("id", F.col("score").alias("base"), F.col("zero_days").alias("base_zero"))
    gain = F.coalesce(F.try_divide(F.col("score") - F.col("base"), "base"), F.lit(0.0))
    per = folds.join(F.broadcast(base), "id").withColumn("gain", gain).groupBy("wp", "wr").agg(
        F.count_if(F.col("gain") > 0).alias("better"), F.percentile("gain", F.lit(0.5)).alias("median_gain"), F.min("gain").alias("worst_gain"),
        F.sum("zero_days").alias("zero_days"), F.sum("base_zero").alias("base_zero"), F.avg("score").alias("score"),
    )
    passes = (F.col("better") >= least_better) & (F.col("median_gain") >= 0.01) & (F.col("worst_gain") >= -0.02) & (F.col("zero_days") <= F.col("base_zero"))
    plain = (F.col("wp") == 1) & (F.col("wr") == 1)
    order = [F.desc(passes), F.desc(plain & ~passes), F.desc("score"), F.desc("median_gain"), F.asc("zero_days"), F.desc("wp"), F.desc("wr")]
    return per.withColumn("passes", passes).orderBy(*order).limit(1)


def contaminated(daily: DataFrame, cutoff: str, columns: Sequence[str], day: str = "report_date", seed: int = 7) -> DataFrame:
    """The table with all numbers from the cutoff on replaced by noise; what is forecast from it must not change."""
    noise = lambda i: F.rand(seed + i) * 1e15 + 1e12
    return daily.withColumns({c: F.when(F.col(day) >= F.lit(cutoff).cast("date"), noise(i).cast(daily.schema[c].dataType)).otherwise(F.col(c)) for i, c in enumerate(columns)})


def holdout(daily: DataFrame, start: str, end: str, columns: Sequence[str], day: str = "report_date") -> DataFrame:
    """Labels of a date range; raises unless every day is there."""
    part = daily.where(F.col(day).between(start, end)).groupBy(day).agg(*[F.sum(c).alias(c) for c in columns])
    n = part.agg(F.count("*").alias("n")).select(F.assert_true(F.col("n") == F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1, F.lit("days are missing")).alias("ok"), "n")
    return part.crossJoin(F.broadcast(n.where("ok is null").select("n"))).select(day, *columns)
