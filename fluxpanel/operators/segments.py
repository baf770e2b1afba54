"""Rolling-cutoff user snapshots, behaviour rules, segment summaries and label stability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip, first_match, holds, safe_divide
from .association import eta_squared
from .joins import in_windows
from .panel import FLOWS, period_aggregates
from .quantiles import group_quantiles

#: Rules in the order in which they are named, and the order in which the first that holds labels a user.
RULES = (
    "no_active_history", "history_insufficient", "observed_never_used", "passive_balance_only", "funded_never_withdrawn", "dormant_zero_balance",
    "low_turnover_holder", "frequent_large_roundtrip", "frequent_small_consumer", "transfer_oriented", "consumption_oriented",
)
PRECEDENCE = (
    "history_insufficient", "observed_never_used", "passive_balance_only", "funded_never_withdrawn", "frequent_large_roundtrip", "frequent_small_consumer",
    "dormant_zero_balance", "low_turnover_holder", "transfer_oriented", "consumption_oriented",
)
#: Labels that a clustering doesn't override.
STRUCTURAL = ("history_insufficient", "observed_never_used", "passive_balance_only", "funded_never_withdrawn", "dormant_zero_balance")


def periods(panel: DataFrame, windows: DataFrame) -> DataFrame:
    """Life, 90-day, 30-day and future measures of every (window, user) in one scan and one shuffle."""
    start, day = F.col("start"), F.col("report_date")
    rows = in_windows(panel, windows, "report_date", day <= F.col("end"))
    life = day < start
    inside = {"life": life, "90": life & (day >= F.date_sub(start, 90)), "30": life & (day >= F.date_sub(start, 30))}
    future = day.between(start, F.col("end"))
    later = [x for name in ("purchase", "redeem", "consume", "transfer") for x in (
        F.coalesce(F.sum(F.when(future, F.col(FLOWS[name]))), F.lit(0)).alias(f"future_{name}"), F.count_if(future & (F.col(FLOWS[name]) > 0)).alias(f"future_{name}_days"))]
    last = [F.max(F.when(life & (F.col(FLOWS[n]) > 0), day)).alias(f"last_{n}_day") for n in ("direct", "redeem", "consume", "transfer")]
    measures = [m for suffix, cond in inside.items() for m in period_aggregates(suffix, cond)]
    return rows.groupBy("id", "start", "end", "user_id").agg(*measures, *last, *later)


def features(profiles: DataFrame) -> DataFrame:
    """Known users (rows before the cutoff) with tenure, recencies and ratios."""
    known = profiles.where("rows_life > 0")
    recency = lambda c: clip(F.coalesce(F.datediff("start", c), F.lit(999)), 1, 999)
    return known.withColumns({
        "tenure_days": F.greatest(F.lit(1), F.datediff("start", "first_seen_life")),
        **{f"{n}_recency": recency(f"last_{n}_day") for n in ("direct", "redeem", "consume", "transfer")},
        "active_recency": recency(F.greatest("last_direct_day", "last_redeem_day")),
        "roundtrip_90": safe_divide(F.least("direct_90", "transfer_90"), F.greatest("direct_90", "transfer_90")),
        "net_flow_share_90": safe_divide(F.col("direct_90") - F.col("redeem_90"), F.col("direct_90") + F.col("redeem_90")),
        "consume_share_90": safe_divide("consume_90", "redeem_90"), "transfer_share_90": safe_divide("transfer_90", "redeem_90"),
        "bank_share_90": safe_divide("bank_90", "direct_90"), "positive_balance_ratio": safe_divide("positive_balance_days_life", "rows_life"),
        "balance_cv": safe_divide("std_balance_life", F.abs("mean_balance_life") + 1), "active_days_per_30": F.col("active_flow_days_90") / 3.0,
        "volume_90": F.col("direct_90") + F.col("transfer_90"),
    })


def thresholds(users: DataFrame, panel: DataFrame, windows: DataFrame) -> DataFrame:
    """Four quantiles of each window, each of its own population; a row a window."""
    c, day = F.col, F.col("report_date")
    of = lambda name, p, value, cond: F.struct(F.lit(name).alias("metric"), F.lit(p).alias("p"), F.when(cond, c(value).cast("double")).alias("v"))
    kinds = [
        of("p75_active", 0.75, "active_flow_days_90", c("active_flow_days_90") > 0), of("p90_volume", 0.9, "volume_90", (c("direct_90") > 0) & (c("transfer_90") > 0)),
        of("p75_consume", 0.75, "consume_days_90", c("consume_days_90") > 0),
    ]
    spent = in_windows(panel.where("consume_amt > 0").select("report_date", "consume_amt"), windows, "report_date", (day < c("start")) & (day >= F.date_sub(c("start"), 90)))
    rows = users.select("id", F.inline(F.array(*kinds))).unionByName(spent.select("id", F.lit("p50_consume_row").alias("metric"), F.lit(0.5).alias("p"), c("consume_amt").cast("double").alias("v")))
    found = group_quantiles(rows, ["id", "metric"])
    wide = found.groupBy("id").agg(*[F.max(F.when(c("metric") == m, c("quantile"))).alias(m) for m in ("p75_active", "p90_volume", "p75_consume", "p50_consume_row")])
    return windows.select("id").join(wide, "id", "left")


def rule_columns() -> dict[str, Column]:
    c = F.col
    inactive = (c("direct_life") == 0) & (c("redeem_life") == 0)
    short = c("tenure_days") < 28
    return {k: holds(v) for k, v in {
        "no_active_history": inactive,
        "history_insufficient": short,
        "observed_never_used": inactive & ~short & (c("max_balance_life") == 0),
        "passive_balance_only": inactive & ~short & (c("max_balance_life") > 0),
        "funded_never_withdrawn": (c("direct_life") > 0) & (c("redeem_life") == 0) & (c("end_balance_life") > 0),
        "dormant_zero_balance": ~inactive & (c("active_flow_days_90") == 0) & (c("end_balance_life") == 0),
        "low_turnover_holder": (c("end_balance_life") > 0) & (c("active_flow_days_90") <= 1) & (c("redeem_90") <= 0.05 * (c("end_balance_life") + c("direct_90") + 1)),
        "frequent_large_roundtrip": (c("active_flow_days_90") >= F.greatest(F.lit(4.0), c("p75_active"))) & (c("direct_days_90") >= 3) & (c("transfer_days_90") >= 3)
        & (c("volume_90") >= c("p90_volume")) & (c("direct_90") > 0) & (c("transfer_90") > 0) & (c("roundtrip_90") >= 0.5),
        "frequent_small_consumer": (c("consume_days_90") >= F.greatest(F.lit(3.0), c("p75_consume"))) & (c("consume_median_90") <= c("p50_consume_row")) & (c("consume_share_90") >= 0.5),
        "transfer_oriented": (c("redeem_90") > 0) & (c("transfer_share_90") >= 0.8),
        "consumption_oriented": (c("redeem_90") > 0) & (c("consume_share_90") >= 0.8),
    }.items()}


def snapshot(panel: DataFrame, windows: DataFrame) -> DataFrame:
    """Every known user of every window with features, rules, primary segment and outcomes."""
    users = features(periods(panel, windows))
    ruled = users.join(F.broadcast(thresholds(users, panel, windows)), "id").withColumns(rule_columns())  # a row a window
    net = F.col("net_flow_share_90")
    primary = first_match([(F.col(r), r) for r in PRECEDENCE] + [(net >= 0.5, "inflow_dominant"), (net <= -0.5, "outflow_dominant")], "balanced_or_other_active")
    return ruled.withColumn("segment", primary)


def cold_start(profiles: DataFrame) -> DataFrame:
    """Known and new users of each window and their part of the future flow."""
    known = F.col("rows_life") > 0
    seen = F.col("future_purchase_days") + F.col("future_redeem_days") > 0
    return profiles.groupBy("id").agg(
        F.count_if(known).alias("known_users"), F.count_if(~known).alias("new_users"), F.count_if(known & seen).alias("known_active"),
        F.sum(F.when(known, F.col("future_purchase")).otherwise(0)).alias("known_purchase"), F.sum("future_purchase").alias("all_purchase"),
        F.sum(F.when(known, F.col("future_redeem")).otherwise(0)).alias("known_redeem"), F.sum("future_redeem").alias("all_redeem"),
    ).withColumns({"known_purchase_share": safe_divide("known_purchase", "all_purchase"), "known_redeem_share": safe_divide("known_redeem", "all_redeem")})


def _active(name: str) -> Column:
    return F.avg((F.col(f"future_{name}_days") > 0).cast("int"))


OUTCOMES = ("purchase", "redeem", "consume", "transfer")


def summarize_segments(users: DataFrame, label: str = "segment") -> DataFrame:
    """Of each window and segment: users, shares, future activity with its lift, and total, mean, median and share of each future flow."""
    groups = users.groupBy("id", label).agg(
        F.count("*").alias("users"), _active("purchase").alias("purchase_rate"), _active("redeem").alias("redeem_rate"), F.sum("end_balance_life").alias("balance"),
        *[x for t in OUTCOMES for x in (F.sum(f"future_{t}").alias(f"future_{t}"), F.avg(f"future_{t}").alias(f"mean_{t}"))],
    )
    flows = F.inline(F.array(*[F.struct(F.lit(t).alias("flow"), F.col(f"future_{t}").cast("double").alias("v")) for t in OUTCOMES]))
    middle = group_quantiles(users.select("id", label, flows).withColumn("p", F.lit(0.5)), ["id", label, "flow"])
    medians = middle.groupBy("id", label).agg(*[F.max(F.when(F.col("flow") == t, F.col("quantile"))).alias(f"median_{t}") for t in OUTCOMES])
    w = Window.partitionBy("id")
    total = lambda c: F.sum(c).over(w)
    lift = lambda t: safe_divide(f"{t}_rate", total(F.col(f"{t}_rate") * F.col("users")) / total("users"))
    return groups.join(medians, ["id", label]).withColumns({
        "user_share": safe_divide("users", total("users")), "balance_share": safe_divide("balance", total("balance")), "purchase_lift": lift("purchase"), "redeem_lift": lift("redeem"),
        **{f"{t}_share": safe_divide(f"future_{t}", total(f"future_{t}")) for t in OUTCOMES},
    })


def summarize_rules(users: DataFrame, rules: Sequence[str] = RULES) -> DataFrame:
    """Of each window and rule: covered users and share; future purchase and redeem rates with their lifts and means; rules without users too."""
    kinds = ("purchase", "redeem")
    long = users.select("id", *[F.col(f"future_{t}{x}") for t in kinds for x in ("", "_days")], F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("hit")) for r in rules])))
    hit, used = F.col("hit"), {t: (F.col(f"future_{t}_days") > 0).cast("int") for t in kinds}
    sums = [x for t in kinds for x in (F.avg(F.when(hit, used[t])).alias(f"own_{t}"), F.avg(used[t]).alias(f"all_{t}"), F.avg(F.when(hit, F.col(f"future_{t}"))).alias(f"sum_{t}"))]
    groups = long.groupBy("id", "rule").agg(F.count("*").alias("all_users"), F.count_if(hit).alias("users"), *sums)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    made = [x for t in kinds for x in (zero(f"own_{t}").alias(f"{t}_rate"), safe_divide(f"own_{t}", f"all_{t}").alias(f"{t}_lift"), zero(f"sum_{t}").alias(f"mean_{t}"))]
    return groups.select("id", "rule", "users", safe_divide("users", "all_users").alias("coverage"), *made)


def rule_overlap(users: DataFrame, rules: Sequence[str] = RULES) -> DataFrame:
    """Users that two rules share and their Jaccard index, for every pair; one pass, no pairs of users."""
    pairs = [(a, b) for i, a in enumerate(rules) for b in rules[i + 1 :]]
    one = users.groupBy("id").agg(*[F.struct(F.count_if(F.col(a) & F.col(b)).alias("i"), F.count_if(F.col(a) | F.col(b)).alias("u")).alias(f"p{k}") for k, (a, b) in enumerate(pairs)])
    long = one.select("id", F.inline(F.array(*[F.struct(F.lit(a).alias("rule_a"), F.lit(b).alias("rule_b"), F.col(f"p{k}").alias("p")) for k, (a, b) in enumerate(pairs)])))
    return long.select("id", "rule_a", "rule_b", F.col("p.i").alias("both"), F.col("p.u").alias("either"), safe_divide("p.i", "p.u").alias("jaccard"))


def predictive_strength(users: DataFrame, labels: Sequence[str], targets: Sequence[str] = ("future_purchase", "future_redeem", "future_consume", "future_transfer")) -> DataFrame:
    """Eta squared of each labelling for each log outcome; 0 without variance."""
    pairs = [F.struct(F.lit(m).alias("method"), F.lit(t).alias("target"), F.col(m).cast("string").alias("label"), F.col(t).cast("double").alias("v")) for m in labels for t in targets]
    long = users.select("id", F.inline(F.array(*pairs)))  # one pass for all
    return eta_squared(long, "label", "v", ["id", "method", "target"], log=True, constant=0.0).select("id", "method", "target", "groups", "rows", "eta_squared")


def adjusted_rand(pairs: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index of two labelings; 1.0 where both are a single cluster."""
    two = lambda n: n * (n - 1) / 2.0
    cells = pairs.groupBy(*by, a, b).agg(F.count("*").cast("double").alias("n"))
    rows = cells.groupBy(*by, a).agg(F.sum("n").alias("n"))
    cols = cells.groupBy(*by, b).agg(F.sum("n").alias("n"))
    one = lambda df, name: df.groupBy(*by).agg(F.sum(two(F.col("n"))).alias(name), F.sum("n").alias(f"n_{name}"))
    if by:
        joined = one(cells, "s").join(one(rows, "r"), list(by)).join(one(cols, "c"), list(by))
    else:
        joined = one(cells, "s").crossJoin(one(rows, "r")).crossJoin(one(cols, "c"))  # a row each
    expected = F.coalesce(F.try_divide(F.col("r") * F.col("c"), two(F.col("n_s"))), F.lit(0.0))
    top = (F.col("r") + F.col("c")) / 2.0
    return joined.select(*by, F.col("n_s").cast("long").alias("users"), F.coalesce(F.try_divide(F.col("s") - expected, top - expected), F.lit(1.0)).alias("adjusted_rand"))


def stability(users: DataFrame, label: str = "segment") -> DataFrame:
    """Adjacent windows: users in both, unchanged labels, adjusted Rand index."""
    order = users.select("id", "start").distinct().withColumn("next_id", F.lead("id").over(Window.orderBy("start")))  # a row a window
    left = users.join(F.broadcast(order.select("id", "next_id")), "id").select("id", "next_id", "user_id", F.col(label).alias("a"))
    right = users.select(F.col("id").alias("next_id"), "user_id", F.col(label).alias("b"))
    both = left.join(right, ["next_id", "user_id"])
    same = both.groupBy("id", "next_id").agg(F.count("*").alias("common_users"), F.avg((F.col("a") == F.col("b")).cast("int")).alias("unchanged_share"))
    return same.join(adjusted_rand(both, "a", "b", ["id", "next_id"]).drop("users"), ["id", "next_id"])
