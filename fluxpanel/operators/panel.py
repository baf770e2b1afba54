"""The user-by-day panel: typed layer, daily tables, user metrics and period profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import all_present, filled, joined_where, log1p, positive, safe_divide
from .joins import join_checked

CATEGORIES = tuple(f"category{i}" for i in range(1, 5))
#: Flow measures of a user's day, by the short name that period profiles use.
FLOWS = {
    "direct": "direct_purchase_amt", "purchase": "total_purchase_amt", "bank": "purchase_bank_amt", "share": "share_amt",
    "redeem": "total_redeem_amt", "consume": "consume_amt", "transfer": "transfer_amt",
}
EVENT_FLOWS = ("direct", "redeem", "consume", "transfer")
FLOW_TARGETS = (
    "total_purchase_amt", "direct_purchase_amt", "purchase_bal_amt", "purchase_bank_amt", "share_amt", "total_redeem_amt", "consume_amt",
    "transfer_amt", "tftobal_amt", "tftocard_amt",
)
STOCK_TARGETS = ("tBalance", "yBalance")
TARGETS = FLOW_TARGETS + STOCK_TARGETS


def typed(panel: DataFrame) -> DataFrame:
    """The panel with null-filled companions, reconciliation, flags and narrow logs.

    Nulls of the source stay; nothing is corrected, deviations are flagged.
    """
    delta = F.col("yBalance") + F.col("total_purchase_amt") - F.col("total_redeem_amt") - F.col("tBalance")
    return panel.withColumns(
        {f"{c}_filled": filled(c) for c in CATEGORIES}
        | {
            "balance_reconciliation_delta": delta, "balance_identity_ok": delta == 0, "has_consume": positive("consume_amt"),
            "has_consume_breakdown": all_present(CATEGORIES), "purchase_log1p": log1p("total_purchase_amt", narrow=True),
            "redeem_log1p": log1p("total_redeem_amt", narrow=True),
        }
    )


def new_users(panel: DataFrame, user: str = "user_id", day: str = "report_date") -> DataFrame:
    """First-seen users per day."""
    return panel.groupBy(user).agg(F.min(day).alias(day)).groupBy(day).agg(F.count("*").alias("new_users"))


def daily_aggregate(panel: DataFrame) -> DataFrame:
    """Rows, users, sums, active users, identity failures and new users of each day."""
    days = panel.groupBy("report_date").agg(
        F.count("*").alias("rows"), F.countDistinct("user_id").alias("users"), F.sum("tBalance").alias("total_balance"),
        F.sum("total_purchase_amt").alias("total_purchase_amt"), F.sum("total_redeem_amt").alias("total_redeem_amt"),
        F.count_if(F.col("total_purchase_amt") > 0).alias("purchase_users"), F.count_if(F.col("total_redeem_amt") > 0).alias("redeem_users"),
        F.count_if(F.col("yBalance") + F.col("total_purchase_amt") - F.col("total_redeem_amt") != F.col("tBalance")).alias("balance_identity_failures"),
    )
    joined = join_checked(days, new_users(panel), ["report_date"], validate="one_to_one")
    return joined.withColumns({"new_users": F.coalesce("new_users", F.lit(0)), "purchase_log1p": log1p("total_purchase_amt"), "redeem_log1p": log1p("total_redeem_amt")})


def daily_flow(panel: DataFrame) -> DataFrame:
    """The daily flow table: 17 measures, net flow and four ratios that are 0 where nothing flowed."""
    sums = {
        "opening_balance_amt": "yBalance", "closing_balance_amt": "tBalance", "direct_inflow_amt": "direct_purchase_amt",
        "balance_purchase_inflow_amt": "purchase_bal_amt", "bankcard_purchase_inflow_amt": "purchase_bank_amt", "profit_share_inflow_amt": "share_amt",
        "total_inflow_amt": "total_purchase_amt", "total_outflow_amt": "total_redeem_amt", "transfer_outflow_amt": "transfer_amt",
        "consume_outflow_amt": "consume_amt", "transfer_to_balance_amt": "tftobal_amt", "transfer_to_card_amt": "tftocard_amt",
    }
    active = {"direct_inflow_users": "direct_purchase_amt", "total_outflow_users": "total_redeem_amt", "transfer_users": "transfer_amt", "consume_users": "consume_amt"}
    days = panel.groupBy("report_date").agg(
        F.countDistinct("user_id").alias("observed_users"), *[F.sum(c).alias(n) for n, c in sums.items()], *[F.count_if(F.col(c) > 0).alias(n) for n, c in active.items()]
    )
    return days.withColumns({
        "net_flow_amt": F.col("total_inflow_amt") - F.col("total_outflow_amt"),
        "direct_inflow_per_user": safe_divide("direct_inflow_amt", "direct_inflow_users"),
        "outflow_per_user": safe_divide("total_outflow_amt", "total_outflow_users"),
        "consume_share": safe_divide("consume_outflow_amt", "total_outflow_amt"),
        "outflow_to_opening": safe_divide("total_outflow_amt", "opening_balance_amt"),
    })


def new_users_by_month(panel: DataFrame) -> DataFrame:
    first = panel.groupBy("user_id").agg(F.min("report_date").alias("first"))
    return first.groupBy(F.date_format("first", "yyyy-MM").alias("month")).agg(F.count("*").alias("new_users"))


def user_metrics(panel: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """Per user and target: total, active days, amount per exposure day, active-day rate, mean of positive days.

    Exposure runs from a user's first day to the last day of the panel, a broadcast one-row
    aggregate.
    """
    last = panel.agg(F.max("report_date").alias("last_day"))
    users = panel.groupBy("user_id").agg(
        F.min("report_date").alias("first_day"), F.count("*").alias("rows"),
        *[x for t in targets for x in (F.sum(filled(t)).alias(f"{t}_total"), F.count_if(F.col(t) > 0).alias(f"{t}_active_days"))],
    )
    exposed = users.crossJoin(F.broadcast(last)).withColumn("exposure_days", F.datediff("last_day", "first_day") + 1)
    long = exposed.select(
        "user_id", "exposure_days", F.inline(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"{t}_total").alias("total"), F.col(f"{t}_active_days").alias("active_days")) for t in targets]))
    )
    return long.select(
        "user_id", "target", "exposure_days", "total", "active_days", (F.col("total") / F.col("exposure_days")).alias("per_exposure_day"),
        (F.col("active_days") / F.col("exposure_days")).alias("active_day_rate"), safe_divide("total", "active_days").alias("positive_day_mean"),
    )


def period_aggregates(suffix: str, inside: Column, day: str = "report_date") -> list[Column]:
    """All measures of one period as conditional aggregates over the rows where ``inside`` holds.

    With one list per period a single pass over the lifetime rows fills every period.
    """
    when = lambda c: F.when(inside, F.col(c) if isinstance(c, str) else c)
    active = (F.col(FLOWS["direct"]) > 0) | (F.col(FLOWS["redeem"]) > 0)
    out = [
        F.count_if(inside).alias(f"rows_{suffix}"), F.min(when(day)).alias(f"first_seen_{suffix}"), F.max(when(day)).alias(f"last_seen_{suffix}"),
        F.min_by(when("yBalance"), when(day)).alias(f"start_balance_{suffix}"), F.max_by(when("tBalance"), when(day)).alias(f"end_balance_{suffix}"),
        F.max(when("tBalance")).alias(f"max_balance_{suffix}"), F.avg(when("tBalance")).alias(f"mean_balance_{suffix}"),
        F.stddev_samp(when("tBalance")).alias(f"std_balance_{suffix}"), F.count_if(inside & (F.col("tBalance") > 0)).alias(f"positive_balance_days_{suffix}"),
        F.count_if(inside & active).alias(f"active_flow_days_{suffix}"),
    ]
    for name, c in FLOWS.items():
        out += [F.coalesce(F.sum(when(c)), F.lit(0)).alias(f"{name}_{suffix}"), F.coalesce(F.max(when(c)), F.lit(0)).alias(f"{name}_max_{suffix}")]
    for name in EVENT_FLOWS:
        c = FLOWS[name]
        out += [
            F.count_if(inside & (F.col(c) > 0)).alias(f"{name}_days_{suffix}"),
            F.coalesce(F.percentile(F.when(inside & (F.col(c) > 0), F.col(c)), F.lit(0.5)), F.lit(0.0)).alias(f"{name}_median_{suffix}"),
        ]
    return out


def user_lag(panel: DataFrame) -> DataFrame:
    """Each row beside the user's previous row: its closing balance and the gap in days."""
    w = Window.partitionBy("user_id").orderBy("report_date")
    return panel.withColumns({"previous_balance": F.lag("tBalance").over(w), "gap_days": F.datediff("report_date", F.lag("report_date").over(w))})


def continuity(panel: DataFrame) -> DataFrame:
    """Whether opening balances equal the previous closing ones, in two scopes."""
    lagged = user_lag(panel.select("user_id", "report_date", "tBalance", "yBalance")).where("gap_days is not null")
    delta = F.col("yBalance") - F.col("previous_balance")
    scopes = lagged.select(delta.alias("delta"), F.explode(F.when(F.col("gap_days") == 1, F.array(F.lit("calendar_day"), F.lit("previous_row"))).otherwise(F.array(F.lit("previous_row")))).alias("scope"))
    return scopes.groupBy("scope").agg(
        F.count("*").alias("checks"), F.count_if(F.col("delta") != 0).alias("mismatches"), F.max(F.abs("delta")).alias("max_abs_delta")
    )


EXTREME_METRICS = ("purchase_total", "redeem_total", "purchase_daily_max", "redeem_daily_max", "balance_max")


def user_extremes(panel: DataFrame) -> DataFrame:
    """Eight measures of each user."""
    return panel.groupBy("user_id").agg(
        F.count("*").alias("observed_days"), F.count_if(F.col("total_purchase_amt") > 0).alias("purchase_days"), F.count_if(F.col("total_redeem_amt") > 0).alias("redeem_days"),
        F.sum("total_purchase_amt").alias("purchase_total"), F.sum("total_redeem_amt").alias("redeem_total"), F.max("total_purchase_amt").alias("purchase_daily_max"),
        F.max("total_redeem_amt").alias("redeem_daily_max"), F.max("tBalance").alias("balance_max"),
    )


def extreme_users(panel: DataFrame, top: int = 50, rank_from: float = 0.999, metrics: Sequence[str] = EXTREME_METRICS) -> DataFrame:
    """Users in the ``top`` of any metric, their percentile rank in each, and where it is ``rank_from`` or more.

    Ties of the top go to the smaller id, ranks count ties as the highest.  Each top list is a
    bounded partial sort.  For percentiles, users are counted by ranges of value; only values
    in the range of a listed user are compared with it, so all users are never sorted.
    """
    users = user_extremes(panel)
    marked = None
    for m in metrics:
        part = users.orderBy(F.desc(m), "user_id").limit(top).select("user_id")
        marked = part if marked is None else marked.unionByName(part)
    few = users.join(F.broadcast(marked.distinct()), "user_id")  # a list of ``top`` for each metric at most
    span = lambda v: F.floor(F.log2(F.greatest(F.col(v), F.lit(0)) + 1.0) * 64).cast("int")  # noqa: E731  64 for each doubling
    long = lambda df, name, *more: df.select(*more, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in metrics]))).withColumn("range", span(name))
    bounds = long(few, "bound", "user_id")
    values = long(users, "v")
    sums = values.groupBy("metric", "range").agg(F.count("*").alias("n"))
    under = Window.partitionBy("metric").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("below", F.coalesce(F.sum("n").over(under), F.lit(0)))  # a row for each range
    inside = values.join(F.broadcast(bounds), ["metric", "range"]).where("v <= bound").groupBy("user_id", "metric", "range").agg(F.count("*").alias("same"))
    placed = inside.join(F.broadcast(sums), ["metric", "range"]).groupBy("user_id").pivot("metric", list(metrics)).agg(F.first(F.col("same") + F.col("below")))
    size = users.agg(F.count("*").alias("n"))
    ranked = few.join(placed.select("user_id", *[F.col(m).alias(f"{m}_pct_rank") for m in metrics]), "user_id").crossJoin(F.broadcast(size))
    ranked = ranked.withColumns({f"{m}_pct_rank": F.col(f"{m}_pct_rank") / F.col("n") for m in metrics}).drop("n")
    return ranked.withColumn("extreme_dimensions", joined_where([(F.col(f"{m}_pct_rank") >= rank_from, m) for m in metrics]))


#: Names and shares of the concentration groups.
SHARES = ((0.001, "top_0_1_percent_users"), (0.01, "top_1_percent_users"), (0.05, "top_5_percent_users"), (0.1, "top_10_percent_users"))


def concentration(panel: DataFrame, metrics: Sequence[str] = ("purchase_total", "redeem_total")) -> DataFrame:
    """Of each metric: the share of its total that the largest 1, 10, 0.1 %, 1 %, 5 % and 10 % of users hold."""
    wide = user_extremes(panel)
    users = wide.select("user_id", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])))
    size = users.groupBy("metric").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    groups = [F.struct(F.lit(g).alias("group"), F.lit(k).cast("long").alias("k")) for g, k in (("top_1_user", 1), ("top_10_users", 10))]
    groups += [F.struct(F.lit(g).alias("group"), F.greatest(F.lit(1), F.ceil(F.col("n") * p)).cast("long").alias("k")) for p, g in SHARES]
    table = size.select("metric", "n", "total", F.inline(F.array(*groups)))
    # Users are ranked within ranges of value; sums over the ranges above give the rest.
    users = users.withColumn("range", F.floor(F.log2(F.greatest("v", F.lit(0)) + 1.0) * 64).cast("int"))
    above = Window.partitionBy("metric").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = users.groupBy("metric", "range").agg(F.count("*").alias("rn_n"), F.sum("v").alias("rn_v"))  # 64 for each doubling
    ranges = ranges.withColumns({"n_above": F.coalesce(F.sum("rn_n").over(above), F.lit(0)), "v_above": F.coalesce(F.sum("rn_v").over(above), F.lit(0))})
    table = table.withColumn("edge", F.least("k", "n"))
    edges = ranges.alias("r").join(F.broadcast(table).alias("t"), (F.col("r.metric") == F.col("t.metric")) & (F.col("n_above") < F.col("edge")) & (F.col("edge") <= F.col("n_above") + F.col("rn_n")))
    edges = edges.select("r.metric", "range", "group", "k", "total", "n_above", "v_above")
    ranked = users.withColumn("rn", F.row_number().over(Window.partitionBy("metric", "range").orderBy(F.desc("v"), "user_id")))
    inside = ranked.join(F.broadcast(edges), ["metric", "range"]).where(F.col("rn") + F.col("n_above") <= F.col("k"))
    held = inside.groupBy("metric", "group").agg(F.first("k").alias("user_count"), (F.first("v_above") + F.sum("v")).alias("amount"), F.first("total").alias("total"))
    return held.select("metric", "group", "user_count", "amount", safe_divide("amount", "total").alias("share"))


def daily_quality(panel: DataFrame) -> DataFrame:
    """Of each day: share of zero flows, largest flow, and the largest user's share."""
    return panel.groupBy("report_date").agg(
        F.count("*").alias("rows"), F.avg((F.col("total_purchase_amt") == 0).cast("int")).alias("zero_purchase_rate"),
        F.avg((F.col("total_redeem_amt") == 0).cast("int")).alias("zero_redeem_rate"), F.max("total_purchase_amt").alias("max_purchase"),
        F.max("total_redeem_amt").alias("max_redeem"), safe_divide(F.max("total_purchase_amt"), F.sum("total_purchase_amt")).alias("top_purchase_share"),
        safe_divide(F.max("total_redeem_amt"), F.sum("total_redeem_amt")).alias("top_redeem_share"),
    )


def hash_folds(users: DataFrame, salt: str, fold_size: int, folds: int, key: str = "user_id") -> DataFrame:
    """The users with the smallest salted hashes, in contiguous folds of equal size.

    The limit keeps the ranking to ``fold_size * folds`` rows: a bounded partial sort.
    """
    from ..functions import salted_hash

    hashed = users.select(key).distinct().withColumn("sample_hash", salted_hash(salt, key)).orderBy("sample_hash").limit(fold_size * folds)
    ranked = hashed.withColumn("rank", F.row_number().over(Window.orderBy("sample_hash")))
    return ranked.withColumn("fold", F.ceil(F.col("rank") / fold_size).cast("int"))


def fold_activity(panel: DataFrame, folds: DataFrame, start: str, end: str) -> DataFrame:
    """Members, active members, sums and share of the total of each fold in a date range."""
    inside = panel.where(F.col("report_date").between(start, end))
    total = inside.agg(F.sum("total_purchase_amt").alias("all_purchase"), F.sum("total_redeem_amt").alias("all_redeem"))
    members = folds.groupBy("fold").agg(F.count("*").alias("members"))
    used = inside.join(F.broadcast(folds), "user_id").groupBy("fold").agg(
        F.countDistinct("user_id").alias("active_users"), F.count("*").alias("rows"), F.sum("total_purchase_amt").alias("purchase"), F.sum("total_redeem_amt").alias("redeem")
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("active_users", "rows", "purchase", "redeem")}
    return members.join(used, "fold", "left").withColumns(zero).crossJoin(F.broadcast(total)).select(
        "fold", "members", "active_users", "rows", "purchase", "redeem", safe_divide("purchase", "all_purchase").alias("purchase_share"), safe_divide("redeem", "all_redeem").alias("redeem_share")
    )


def cohorts(panel: DataFrame, windows: DataFrame, start: str, end: str, least_days: int = 2) -> DataFrame:
    """Of users first seen in each window: how many, how many were active in a range, on enough days, and their part of it."""
    first = panel.groupBy("user_id").agg(F.min("report_date").alias("first"))
    inside = panel.where(F.col("report_date").between(start, end)).groupBy("user_id").agg(F.countDistinct("report_date").alias("days"), F.sum("total_purchase_amt").alias("purchase"))
    total = inside.agg(F.sum("purchase").alias("all_purchase"))
    members = first.join(F.broadcast(windows), F.col("first").between(F.col("start"), F.col("end"))).select("id", "user_id")
    return (
        members.join(inside, "user_id", "left").groupBy("id").agg(
            F.count("*").alias("users"), F.count("days").alias("active_users"), F.count_if(F.col("days") >= least_days).alias("steady_users"),
            F.coalesce(F.sum("purchase"), F.lit(0)).alias("purchase"),
        ).crossJoin(F.broadcast(total)).select("id", "users", "active_users", "steady_users", "purchase", safe_divide("purchase", "all_purchase").alias("purchase_share"))
    )
