"""The analytical tables that the registered queries run on, built from the driver's tables.

A user's day is a four-hour slot of ``events``, so that thirty days of events give a panel of
180 days.  The daily series has all days of ``orders``, on a calendar without gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import densify

PANEL_START = "2024-01-01"
SERIES = ("1995-01-01", "2001-08-01")
SERIES_SQL = f"DATE '{SERIES[0]}' AND DATE '{SERIES[1]}'"
CALENDAR_SQL = f"generate_series(DATE '{SERIES[0]}', DATE '{SERIES[1]}', INTERVAL 1 DAY)"
#: Rolling cutoffs of the panel: id, first and last day.
PANEL_WINDOWS = (("w1", "2024-03-31", "2024-04-29"), ("w2", "2024-04-30", "2024-05-29"), ("w3", "2024-05-30", "2024-06-28"))
#: Backtest windows of the daily series.
SERIES_WINDOWS = (
    ("b1", "1997-09-01", "1997-09-30"), ("b2", "1997-10-01", "1997-10-30"), ("b3", "1997-11-01", "1997-11-30"), ("b4", "1997-12-01", "1997-12-30"),
    ("b5", "1998-01-01", "1998-01-30"), ("b6", "1998-02-01", "1998-03-02"),
)


#: With a window that has but 62 days of history before it.
BACKTESTS = (("b0", "1995-03-04", "1995-04-02"), *SERIES_WINDOWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def windows(spark: SparkSession, rows=PANEL_WINDOWS) -> DataFrame:
    """Configuration rows as a small table; never derived from the data."""
    return spark.createDataFrame(list(rows), "id string, start string, end string").select("id", F.to_date("start").alias("start"), F.to_date("end").alias("end"))


def cents(column: str):
    return F.floor(F.col(column) * 100 + 0.5).cast("bigint")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, report_date and the sixteen amounts of a user's day, in cents; one shuffle on the user."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", cents("value").alias("c"))
    slot = F.datediff(F.to_date("ts"), F.lit(PANEL_START).cast("date")) * 6 + F.floor(F.hour("ts") / 4).cast("int")
    e = e.withColumn("report_date", F.date_add(F.lit(PANEL_START).cast("date"), slot))
    when = lambda kind, more=None: F.coalesce(F.sum(F.when((F.col("event_type") == kind) & (F.lit(True) if more is None else more), F.col("c"))), F.lit(0))
    days = e.groupBy("user_id", "report_date").agg(
        when("purchase").alias("purchase_bal_amt"), when("signup").alias("purchase_bank_amt"), F.floor(when("view") / 10).cast("bigint").alias("share_amt"), when("click").alias("consume_amt"),
        when("error", F.col("event_id") % 2 == 0).alias("tftobal_amt"), when("error", F.col("event_id") % 2 == 1).alias("tftocard_amt"),
        *[when("click", F.col("event_id") % 4 == i).alias(f"category{i + 1}") for i in range(4)],
    )
    days = days.withColumns({f"category{i}": F.when(F.col("consume_amt") > 0, F.col(f"category{i}")) for i in range(1, 5)})
    days = days.withColumns({"direct_purchase_amt": F.col("purchase_bal_amt") + F.col("purchase_bank_amt"), "transfer_amt": F.col("tftobal_amt") + F.col("tftocard_amt")})
    days = days.withColumns({"total_purchase_amt": F.col("direct_purchase_amt") + F.col("share_amt"), "total_redeem_amt": F.col("consume_amt") + F.col("transfer_amt")})
    w = Window.partitionBy("user_id").orderBy("report_date").rowsBetween(Window.unboundedPreceding, 0)
    net = F.col("total_purchase_amt") - F.col("total_redeem_amt")
    days = days.withColumn("tBalance", F.lit(10_000_000).cast("bigint") + F.sum(net).over(w))
    late = F.when((F.col("user_id") % 50 == 0) & (F.dayofmonth("report_date") % 7 == 0), 1).otherwise(0)  # a known break of the identity
    return days.withColumn("yBalance", F.col("tBalance") - net + late).select(
        "user_id", "report_date", "tBalance", "yBalance", "total_purchase_amt", "direct_purchase_amt", "purchase_bal_amt", "purchase_bank_amt", "total_redeem_amt",
        "consume_amt", "transfer_amt", "tftobal_amt", "tftocard_amt", "share_amt", "category1", "category2", "category3", "category4",
    )


PANEL_SQL = """
panel_events AS (
  SELECT event_id, user_id, event_type, CAST(floor(value * 100 + 0.5) AS BIGINT) AS c,
    DATE '2024-01-01' + CAST(date_diff('day', DATE '2024-01-01', ts::DATE) * 6 + hour(ts) // 4 AS INTEGER) AS report_date FROM events
), panel_days AS (
  SELECT user_id, report_date,
    CAST(coalesce(sum(c) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS purchase_bal_amt, CAST(coalesce(sum(c) FILTER (event_type = 'signup'), 0) AS BIGINT) AS purchase_bank_amt,
    CAST(coalesce(sum(c) FILTER (event_type = 'view'), 0) // 10 AS BIGINT) AS share_amt, CAST(coalesce(sum(c) FILTER (event_type = 'click'), 0) AS BIGINT) AS consume_amt,
    CAST(coalesce(sum(c) FILTER (event_type = 'error' AND event_id % 2 = 0), 0) AS BIGINT) AS tftobal_amt, CAST(coalesce(sum(c) FILTER (event_type = 'error' AND event_id % 2 = 1), 0) AS BIGINT) AS tftocard_amt,
    CAST(coalesce(sum(c) FILTER (event_type = 'click' AND event_id % 4 = 0), 0) AS BIGINT) AS k1, CAST(coalesce(sum(c) FILTER (event_type = 'click' AND event_id % 4 = 1), 0) AS BIGINT) AS k2,
    CAST(coalesce(sum(c) FILTER (event_type = 'click' AND event_id % 4 = 2), 0) AS BIGINT) AS k3, CAST(coalesce(sum(c) FILTER (event_type = 'click' AND event_id % 4 = 3), 0) AS BIGINT) AS k4
  FROM panel_events GROUP BY ALL
), panel_flows AS (
  SELECT *, purchase_bal_amt + purchase_bank_amt AS direct_purchase_amt, tftobal_amt + tftocard_amt AS transfer_amt,
    purchase_bal_amt + purchase_bank_amt + share_amt AS total_purchase_amt, consume_amt + tftobal_amt + tftocard_amt AS total_redeem_amt FROM panel_days
), panel_balances AS (
  SELECT *, CAST(10000000 + sum(total_purchase_amt - total_redeem_amt) OVER (PARTITION BY user_id ORDER BY report_date) AS BIGINT) AS tBalance FROM panel_flows
), panel AS (
  SELECT user_id, report_date, tBalance, tBalance - total_purchase_amt + total_redeem_amt + CASE WHEN user_id % 50 = 0 AND day(report_date) % 7 = 0 THEN 1 ELSE 0 END AS yBalance,
    total_purchase_amt, direct_purchase_amt, purchase_bal_amt, purchase_bank_amt, total_redeem_amt, consume_amt, transfer_amt, tftobal_amt, tftocard_amt, share_amt,
    CASE WHEN consume_amt > 0 THEN k1 END AS category1, CASE WHEN consume_amt > 0 THEN k2 END AS category2, CASE WHEN consume_amt > 0 THEN k3 END AS category3, CASE WHEN consume_amt > 0 THEN k4 END AS category4
  FROM panel_balances
)"""


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 2).cast("tinyint").alias("sex"), F.col("c_nationkey").cast("bigint").alias("city"), F.col("c_mktsegment").alias("constellation"))


PROFILE_SQL = "profile AS (SELECT c_custkey AS user_id, CAST(c_custkey % 2 AS TINYINT) AS sex, CAST(c_nationkey AS BIGINT) AS city, c_mktsegment AS constellation FROM customer)"


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rates of the days that observe them (Monday to Friday)."""
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("report_date"), cents("o_totalprice").alias("c"), "o_orderkey")
    o = o.where(F.col("report_date").between(*SERIES) & (F.weekday("report_date") < 5))
    return o.groupBy("report_date").agg((F.sum("c") / F.count("*") / 1e7).alias("rate_1d"), F.avg(F.col("o_orderkey") % 97).alias("rate_7d"))


RATES_SQL = f"""
rates AS (
  SELECT o_orderdate::DATE AS report_date, sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT))::DOUBLE / count(*) / 1e7 AS rate_1d, avg(o_orderkey % 97) AS rate_7d
  FROM orders WHERE o_orderdate::DATE BETWEEN {SERIES_SQL} AND isodow(o_orderdate) <= 5 GROUP BY 1
)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily flows on a gap-free calendar, days without orders being zero; flows in cents."""
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("report_date"), "o_orderstatus", cents("o_totalprice").alias("c")).where(F.col("report_date").between(*SERIES))
    when = lambda s: F.coalesce(F.sum(F.when(F.col("o_orderstatus") == s, F.col("c"))), F.lit(0))
    days = o.groupBy("report_date").agg(when("O").alias("direct"), when("F").alias("transfer"), when("P").alias("consume"), F.sum(F.col("c") % 1000).alias("share"))
    names = ("direct", "transfer", "consume", "share")
    full = densify(days, "report_date", *SERIES).withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
    return full.withColumns({"purchase": F.col("direct") + F.col("share"), "redeem": F.col("transfer") + F.col("consume")})


DAILY_SQL = f"""
calendar AS (
  SELECT CAST(unnest({CALENDAR_SQL}) AS DATE) AS report_date
), daily_orders AS (
  SELECT o_orderdate::DATE AS report_date, o_orderstatus, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS c FROM orders
), daily_sums AS (
  SELECT report_date, CAST(sum(c) FILTER (o_orderstatus = 'O') AS BIGINT) AS direct, CAST(sum(c) FILTER (o_orderstatus = 'F') AS BIGINT) AS transfer,
    CAST(sum(c) FILTER (o_orderstatus = 'P') AS BIGINT) AS consume, CAST(sum(c % 1000) AS BIGINT) AS share FROM daily_orders GROUP BY 1
), daily AS (
  SELECT report_date, coalesce(direct, 0) AS direct, coalesce(transfer, 0) AS transfer, coalesce(consume, 0) AS consume, coalesce(share, 0) AS share,
    coalesce(direct, 0) + coalesce(share, 0) AS purchase, coalesce(transfer, 0) + coalesce(consume, 0) AS redeem
  FROM calendar LEFT JOIN daily_sums USING (report_date)
)"""


def windows_sql(rows=PANEL_WINDOWS, name: str = "windows") -> str:
    values = ", ".join(f"('{i}', DATE '{a}', DATE '{b}')" for i, a, b in rows)
    return f'{name}(id, "start", "end") AS (VALUES {values})'
