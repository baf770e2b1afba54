"""Association statistics as grouped aggregates: correlations, ranks, effect sizes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import effect_label
from .quantiles import group_quantiles
from .series import average_rank


def correlation(x: str, y: str) -> Column:
    """Pearson correlation; null where a side is constant.  Rows with a null side must be gone."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def long_pairs(df: DataFrame, left: Sequence[str], right: Sequence[str], ids: Sequence[str], triangular: bool = False) -> DataFrame:
    """Every (left, right) pair of columns of each row, in one pass: ids, a, b, x, y."""
    pairs = [(a, b) for i, a in enumerate(left) for j, b in enumerate(right) if not triangular or i < j]
    return df.select(*ids, F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs])))


def pair_statistics(pairs: DataFrame, by: Sequence[str] = ("a", "b")) -> DataFrame:
    """Complete pairs, Pearson and Spearman of each group; null pairs go before values are ranked.

    A group is ranked in one task, so its rows should be an aggregated series.
    """
    whole = pairs.where("x is not null and y is not null")
    ranked = whole.withColumns({"rx": average_rank("x", by), "ry": average_rank("y", by)})
    two = F.count("*") >= 2
    return ranked.groupBy(*by).agg(F.count("*").alias("pairs"), F.when(two, correlation("x", "y")).alias("pearson"), F.when(two, correlation("rx", "ry")).alias("spearman"))


def ranked_in_ranges(rows: DataFrame, by: str, value: str, steps: int = 256) -> DataFrame:
    """``rows`` with ``rank``, the average rank of ``value`` among all rows of ``by``, without sorting a group in one task.

    Equal values are counted first; counts of ranges of values (``steps`` for each doubling) say
    how many lie below a range, and only the distinct values of one range are put in order.
    """
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    counts = counts.withColumn("range", F.floor(F.signum(value) * F.log2(F.abs(value) + 1.0) * steps))
    below = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy(by, "range").agg(F.sum("n").alias("m")).withColumn("below", F.coalesce(F.sum("m").over(below), F.lit(0)))
    inside = Window.partitionBy(by, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.join(ranges.select(by, "range", "below"), [by, "range"])
    rank = F.col("below") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + (F.col("n") + 1) / 2.0
    return rows.join(placed.select(by, value, rank.alias("rank")), [by, value])


def user_spearman(metrics: DataFrame, value: str, key: str = "user_id") -> DataFrame:
    """Spearman of every pair of targets over users: a, b, user_spearman; ``metrics`` has a row for each user and target."""
    ranked = ranked_in_ranges(metrics.select(key, "target", F.col(value).cast("double").alias("v")), "target", "v")
    wide = ranked.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("target", "rank"))).alias("m"))  # a user's targets
    names = sorted(r[0] for r in metrics.select("target").distinct().collect())  # of the panel's columns
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("m")[a].alias("x"), F.col("m")[b].alias("y")) for a in names for b in names if a != b]
    return wide.select(F.inline(F.array(*cells))).where("x is not null and y is not null").groupBy("a", "b").agg(correlation("x", "y").alias("user_spearman"))


#: Statistics of a rate and a flow: which form of each, and which correlation.
GRID = {
    "pearson_raw": ("x", "y", "pearson"), "pearson_log": ("x", "l", "pearson"), "spearman": ("x", "y", "spearman"), "residual_corr": ("x_res", "l_res", "pearson"), "lag1_spearman": ("x_lag1", "y", "spearman"),
    "lag7_spearman": ("x_lag7", "y", "spearman"), "diff1_corr": ("x_diff1", "l_diff1", "pearson"), "diff7_corr": ("x_diff7", "l_diff7", "pearson"), "lagged_diff1_corr": ("x_diff1_lag1", "l_diff1", "pearson"),
}


def _forms(daily: DataFrame, columns: Sequence[str], log: bool, day: str) -> DataFrame:
    """Each column in long form (name, level, v) with lags, differences and residual of v, the level or its log."""
    level = F.col("level").cast("double")
    long = daily.select(day, F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("level")) for c in columns])))
    base = long.withColumns({"v": F.log1p(level) if log else level, "t": F.datediff(day, F.lit("1970-01-01")).cast("double")})
    w, wd, whole = Window.partitionBy("name").orderBy(day), Window.partitionBy("name", F.weekday(day)), Window.partitionBy("name")
    lag = lambda n: F.lag("v", n).over(w)
    out = base.withColumns({
        "lag1": lag(1), "lag7": lag(7), "diff1": F.col("v") - lag(1), "diff7": F.col("v") - lag(7), "diff1_lag1": lag(1) - lag(2),
        "v_d": F.col("v") - F.avg("v").over(wd), "t_d": F.col("t") - F.avg(F.when(F.col("v").isNotNull(), F.col("t"))).over(wd),
    })
    slope = F.coalesce(F.try_divide(F.sum(F.col("v_d") * F.col("t_d")).over(whole), F.sum(F.when(F.col("v").isNotNull(), F.col("t_d") * F.col("t_d"))).over(whole)), F.lit(0.0))
    return out.withColumn("res", F.col("v_d") - slope * F.col("t_d")).drop("t", "v_d", "t_d")


def rate_grid(daily: DataFrame, rates: Sequence[str], flows: Sequence[str], day: str = "report_date") -> DataFrame:
    """Of each rate and flow: the nine correlations of ``GRID``, complete pairs of each, and their absolute values.

    ``daily`` is an aggregated series; its columns are put in long form once, so the plan has
    the same size for any number of them.
    """
    x, y = _forms(daily, rates, False, day).alias("x"), _forms(daily, flows, True, day).alias("y")
    both = x.join(y, day)
    side = lambda c, table: F.col(f"{table}.{'level' if c in ('x', 'y') else 'v' if c == 'l' else c.partition('_')[2]}")
    cells = [F.struct(F.lit(s).alias("statistic"), side(a, "x").alias("x"), side(b, "y").alias("y")) for s, (a, b, _) in GRID.items()]
    found = pair_statistics(both.select(F.col("x.name").alias("rate"), F.col("y.name").alias("flow"), F.inline(F.array(*cells))), ("rate", "flow", "statistic"))
    value = F.when(F.col("statistic").endswith("spearman"), F.col("spearman")).otherwise(F.col("pearson"))
    return found.select("rate", "flow", "statistic", "pairs", value.alias("value"), F.abs(value).alias("abs_value"))


def residuals(df: DataFrame, columns: Sequence[str], day: str = "report_date") -> DataFrame:
    """Columns less intercept, linear trend and weekday means (least squares).

    By the Frisch-Waugh-Lovell theorem: demean values and trend within weekdays, then take
    off the slope of one on the other.
    """
    base = df.withColumns({"__t": F.datediff(day, F.lit("1970-01-01")).cast("double"), "__wd": F.weekday(day)})
    wd, whole = Window.partitionBy("__wd"), Window.partitionBy()
    base = base.withColumn("__t", F.col("__t") - F.avg("__t").over(wd))
    for c in columns:
        base = base.withColumn(c, F.col(c).cast("double") - F.avg(c).over(wd))
    for c in columns:
        base = base.withColumn(c, F.col(c) - F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("__t")).over(whole), F.sum(F.when(F.col(c).isNotNull(), F.col("__t") * F.col("__t"))).over(whole)), F.lit(0.0)) * F.col("__t"))
    return base.drop("__t", "__wd")


def eta_squared(df: DataFrame, category: str, value: str, by: Sequence[str] = (), log: bool = False, constant: float | None = None) -> DataFrame:
    """Share of the variance of ``value`` between categories: groups, rows, eta_squared and its label.

    Null categories and values are left out.  Without variance the share is ``constant``.
    """
    v = F.log1p(value) if log else F.col(value).cast("double")
    base = df.select(*by, F.col(category).alias("c"), v.alias("v")).where("c is not null and v is not null")
    groups = base.groupBy(*by, "c").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    total = F.sum("n")
    mean = F.sum(F.col("n") * F.col("m")) / total
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - total * mean * mean
    within = F.sum(F.col("n") * F.col("s"))
    out = groups.groupBy(*by).agg(F.count("*").alias("groups"), total.alias("rows"), between.alias("b"), within.alias("w"))
    eta = F.coalesce(F.try_divide("b", F.when(F.col("b") + F.col("w") > 1e-12, F.col("b") + F.col("w"))), F.lit(constant).cast("double"))
    return out.select(*by, "groups", "rows", F.greatest(F.lit(0.0), eta).alias("eta_squared") if constant is not None else eta.alias("eta_squared")).withColumn("effect", effect_label("eta_squared"))


def pooled(df: DataFrame, columns: Sequence[str], out: str, least: int = 50, other: str = "__SMALL_GROUP__") -> DataFrame:
    """The columns joined by ``|`` as one category, groups under ``least`` rows as one."""
    joined = df.withColumn(out, F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    sizes = joined.groupBy(out).agg(F.count("*").alias("__n"))
    return joined.join(sizes, out).withColumn(out, F.when(F.col("__n") < least, other).otherwise(F.col(out))).drop("__n")


def group_profile(df: DataFrame, category: str, values: Sequence[str]) -> DataFrame:
    """Size, mean, median, 90th percentile and positive share of each value by category; quantiles by ranges, without a buffer for a group."""
    long = df.select(F.col(category).cast("string").alias("group"), F.inline(F.array(*[F.struct(F.lit(v).alias("target"), F.col(v).cast("double").alias("v")) for v in values])))
    both = long.select("group", "target", F.inline(F.array(*[F.struct(F.lit(n).alias("q"), F.lit(p).alias("p"), F.col("v")) for n, p in (("median", 0.5), ("p90", 0.9))])))
    found = group_quantiles(both, ["group", "target", "q"]).groupBy("group", "target").agg(*[F.max(F.when(F.col("q") == n, F.col("quantile"))).alias(n) for n in ("median", "p90")])
    sums = long.groupBy("group", "target").agg(F.count("*").alias("users"), F.avg("v").alias("mean"), F.avg((F.col("v") > 0).cast("int")).alias("positive_rate"))
    same = [sums.group.eqNullSafe(found.group), sums.target == found.target]
    return sums.join(found, same, "left").select(F.lit(category).alias("category"), sums.group, sums.target, "users", "mean", "median", "p90", "positive_rate")


def demographic_grid(metrics: DataFrame, profile: DataFrame, features: Sequence[str], values: Mapping[str, Column], key: str = "user_id") -> DataFrame:
    """Eta squared of each value (by name) by each feature, for every target of the long ``metrics``; one grouping for all."""
    joined = metrics.join(profile.select(key, *features), key)
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("group"), F.lit(n).alias("metric"), v.cast("double").alias("v")) for f in features for n, v in values.items()]
    return eta_squared(joined.select("target", F.inline(F.array(*cells))), "group", "v", ["feature", "target", "metric"])


def crossed_grid(metrics: DataFrame, profile: DataFrame, crosses: Sequence[Sequence[str]], value: Column, least: int = 50, key: str = "user_id", other: str = "__SMALL_GROUP__") -> DataFrame:
    """Eta squared of ``value`` by each cross of features, groups under ``least`` users being one, for every target."""
    names = sorted({f for c in crosses for f in c})
    cells = [F.struct(F.lit("_x_".join(c)).alias("feature"), F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in c]).alias("group")) for c in crosses]
    users = profile.join(metrics.select(key).distinct(), key, "left_semi").select(key, *names).select(key, F.inline(F.array(*cells)))
    sizes = users.groupBy("feature", "group").agg(F.count("*").alias("n"))
    raw = sizes.groupBy("feature").agg(F.count("*").alias("raw_groups"))  # a row for each cross
    kept = users.join(sizes, ["feature", "group"]).withColumn("group", F.when(F.col("n") < least, other).otherwise(F.col("group")))
    found = eta_squared(metrics.select(key, "target", value.alias("v")).join(kept, key), "group", "v", ["feature", "target"])
    return found.join(F.broadcast(raw), "feature")


#: Pairs of which one is a component of the other, and the stocks among the targets.
MECHANICAL = (
    ("total_purchase_amt", "direct_purchase_amt"), ("direct_purchase_amt", "purchase_bal_amt"), ("direct_purchase_amt", "purchase_bank_amt"), ("total_purchase_amt", "share_amt"),
    ("total_redeem_amt", "consume_amt"), ("total_redeem_amt", "transfer_amt"), ("transfer_amt", "tftobal_amt"), ("transfer_amt", "tftocard_amt"),
)
STOCKS = ("tBalance", "yBalance")


def pair_type(a: str, b: str) -> Column:
    """Whether two targets go together by arithmetic, through the balance, or by behaviour."""
    key = F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    mechanical = key.isin(*["|".join(sorted(p)) for p in MECHANICAL])
    stock = F.col(a).isin(*STOCKS) | F.col(b).isin(*STOCKS)
    return F.when(mechanical, "mechanical_component_relationship").when(stock, "balance_behavior_relationship").otherwise("behavioral_flow_relationship")
