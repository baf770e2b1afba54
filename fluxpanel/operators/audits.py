"""Data-quality audits.  Every audit returns rows; nothing is corrected."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite, status
from .joins import join_checked


def _rows(structs: list[Column]) -> Column:
    return F.inline(F.array(*structs))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Of each column: type, nulls, null rate, distinct values, least and greatest as text.

    Nulls and extremes are one aggregate of partial sums.  Distinct values are counted from
    (column, value) pairs that are made distinct before the shuffle, so no row is expanded
    once for each distinct count.
    """
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    one = df.agg(F.count("*").alias("rows"), *[F.struct(F.count_if(F.col(c).isNull()).alias("nulls"), F.min(c).cast("string").alias("low"), F.max(c).cast("string").alias("high")).alias(f"p_{i}") for i, c in enumerate(columns)])
    facts = one.select("rows", _rows([F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.col(f"p_{i}").alias("p")) for i, c in enumerate(columns)]))
    values = df.select(_rows([F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).where("v is not null").distinct()
    kinds = values.groupBy("column").agg(F.count("*").alias("distinct_values"))  # a row a column
    return facts.join(F.broadcast(kinds), "column", "left").select(
        "column", "type", "rows", F.col("p.nulls").alias("nulls"), F.try_divide("p.nulls", "rows").alias("null_rate"), F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"),
        F.col("p.low").alias("min_value"), F.col("p.high").alias("max_value"),
    )


def type_audit(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """Expected columns and types against those of the table; extra columns are named as well."""
    have = dict(df.dtypes)
    rows = [(c, expected.get(c), have.get(c), "PASS" if expected.get(c) == have.get(c) else "FAIL") for c in [*expected, *[c for c in have if c not in expected]]]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, found string, status string")


def key_audit(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows, distinct keys, rows of keys that occur more than once (all members) and rows with a null key."""
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return df.groupBy(*keys).agg(F.count("*").alias("c")).agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_keys"), F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(null, F.col("c"))), F.lit(0)).alias("null_key_rows"),
    ).select(F.lit(name).alias("table"), "rows", "distinct_keys", "duplicate_rows", "null_key_rows", status(F.col("duplicate_rows") + F.col("null_key_rows")).alias("status"))


#: The additive identities of the panel: name, left side, right side.
IDENTITIES = (
    ("direct_purchase", "direct_purchase_amt", "purchase_bal_amt + purchase_bank_amt"),
    ("total_purchase", "total_purchase_amt", "direct_purchase_amt + share_amt"),
    ("total_redeem", "total_redeem_amt", "consume_amt + transfer_amt"),
    ("transfer", "transfer_amt", "tftobal_amt + tftocard_amt"),
    ("consume", "consume_amt", "coalesce(category1, 0) + coalesce(category2, 0) + coalesce(category3, 0) + coalesce(category4, 0)"),
    ("balance", "tBalance", "yBalance + total_purchase_amt - total_redeem_amt"),
)


def identity_audit(df: DataFrame, identities: Sequence[tuple[str, str, str]] = IDENTITIES) -> DataFrame:
    """Of each identity: rows, mismatches, match rate, largest and summed deviation; one pass."""
    deltas = df.select(*[(F.expr(left) - F.expr(right)).alias(name) for name, left, right in identities])
    one = deltas.agg(*[F.struct(F.count(n).alias("rows"), F.count_if(F.col(n) != 0).alias("mismatches"), F.max(F.abs(n)).alias("max_abs_delta"), F.sum(n).alias("sum_delta")).alias(n) for n, _, _ in identities])
    long = one.select(_rows([F.struct(F.lit(n).alias("identity"), F.col(n).alias("v")) for n, _, _ in identities]))
    return long.select(
        "identity", F.col("v.rows").alias("rows"), F.col("v.mismatches").alias("mismatches"), F.try_divide(F.col("v.rows") - F.col("v.mismatches"), F.col("v.rows")).alias("match_rate"),
        F.col("v.max_abs_delta").alias("max_abs_delta"), F.col("v.sum_delta").alias("sum_delta"), status("v.mismatches").alias("status"),
    )


def domain_audit(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """How many rows break each rule (a condition that should hold; null counts as broken)."""
    one = df.agg(*[F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()])
    return one.unpivot([], list(rules), "rule", "violations").withColumn("status", status("violations"))


def business_domains(panel: DataFrame, profile: DataFrame, rates: DataFrame, cities: int = 7, signs: int = 12, rate_columns: Sequence[str] = ()) -> DataFrame:
    """Six domain constraints over panel, profile and rates: violations, severity and status."""
    amounts = [c for c in panel.columns if c not in ("user_id", "report_date")]
    p = panel.agg(F.count_if(F.col("user_id") <= 0).alias("a"), sum((F.count_if(F.col(c) < 0) for c in amounts[1:]), F.count_if(F.col(amounts[0]) < 0)).alias("b"))
    exact = lambda c, n: F.when((F.count_if(F.col(c).isNull()) == 0) & (F.countDistinct(c) == n), 0).otherwise(1)
    f = profile.agg(F.count_if(~F.coalesce(F.col("sex").isin(0, 1), F.lit(False))).alias("c"), exact("city", cities).alias("d"), exact("constellation", signs).alias("e"))
    rate_columns = list(rate_columns or [c for c in rates.columns if c != "report_date"])
    bad = [F.count_if(~finite(c) | (F.col(c) <= 0)) for c in rate_columns]
    r = rates.agg(sum(bad[1:], bad[0]).alias("f"))
    # Names of the constraints.
    names = (
        ("a", "user_id positive integer", "CRITICAL"), ("b", "source amounts non-negative", "HIGH"), ("c", "sex domain subset of {0,1}", "MEDIUM"),
        ("d", f"city has exactly {cities} non-null codes", "MEDIUM"), ("e", f"constellation has exactly {signs} non-null values", "MEDIUM"), ("f", "rates finite and positive", "HIGH"),
    )
    one = p.crossJoin(f).crossJoin(r)  # a row each
    long = one.select(_rows([F.struct(F.lit(n).alias("constraint"), F.col(c).cast("long").alias("violation_count"), F.lit(s).alias("severity")) for c, n, s in names]))
    return long.withColumn("status", status("violation_count"))


def structural_nulls(panel: DataFrame, columns: Sequence[str] = ("category1", "category2", "category3", "category4"), amount: str = "consume_amt") -> DataFrame:
    """Rows whose columns are all null, only partly null, and null against ``amount`` = 0."""
    all_null = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in columns])
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    out = panel.agg(F.count_if(all_null).alias("all_null_rows"), F.count_if(any_null & ~all_null).alias("partial_null_rows"), F.count_if(all_null != (F.col(amount) == 0)).alias("disagreeing_rows"))
    return out.withColumn("status", status(F.col("partial_null_rows") + F.col("disagreeing_rows")))


def panel_rules() -> dict[str, Column]:
    """Row rules of the panel for ``domain_audit``."""
    amounts = ("tBalance", "yBalance", "total_purchase_amt", "total_redeem_amt", "consume_amt", "transfer_amt")
    cats = [F.col(f"category{i}") for i in range(1, 5)]
    null_all = reduce(lambda a, b: a & b, [c.isNull() for c in cats])
    null_any = reduce(lambda a, b: a | b, [c.isNull() for c in cats])
    return {f"{a}_not_negative": F.col(a) >= 0 for a in amounts} | {
        "categories_all_or_none": null_all | ~null_any,
        "categories_null_iff_no_consume": null_all == (F.col("consume_amt") == 0),
        "amounts_finite": reduce(lambda a, b: a & b, [finite(a) for a in amounts]),
    }


def reconcile(source: DataFrame, derived: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Row counts and totals of a source against a table derived from it."""
    total = lambda df: df.agg(F.count("*").alias("rows"), *[F.sum(m).alias(m) for m in measures])
    return reconcile_totals(total(source), total(derived), measures)


def reconcile_totals(source: DataFrame, derived: DataFrame, measures: Sequence[str]) -> DataFrame:
    """The same for one row of totals (rows and the measures) a side."""
    long = lambda df, name: df.unpivot([], ["rows", *measures], "measure", name)
    out = long(source, "source_total").join(F.broadcast(long(derived, "derived_total")), "measure").withColumn("delta", F.col("derived_total") - F.col("source_total"))
    return out.withColumn("status", status(F.abs("delta")))


def coverage(panel: DataFrame, profile: DataFrame, yields: DataFrame, observed: DataFrame, dense: DataFrame) -> DataFrame:
    """Nine checks between the panel and its dimensions: keys on one side only, join inflation and total drift.

    ``yields``, ``observed`` and ``dense`` have report_date.  Counts are informative where a gap
    is expected (days without an observed rate), else they must be zero.
    """
    users, days = panel.select("user_id").distinct(), panel.select("report_date").distinct()
    joined = join_checked(panel.select("user_id", "total_purchase_amt", "total_redeem_amt"), profile.select("user_id"), ["user_id"], "left", "many_to_one", "matched")
    after = joined.agg(F.count("*").alias("n"), F.count_if(~F.col("matched")).alias("lost"), F.sum("total_purchase_amt").alias("p"), F.sum("total_redeem_amt").alias("r"))
    base = panel.agg(F.count("*").alias("n0"), F.sum("total_purchase_amt").alias("p0"), F.sum("total_redeem_amt").alias("r0"))
    # Names of the checks.
    drift = after.crossJoin(base).select(  # a row each
        F.inline(F.array(*[F.struct(F.lit(n).alias("coverage_check"), v.cast("long").alias("count")) for n, v in (
            ("profile join unmatched or row inflation", F.col("lost") + F.abs(F.col("n") - F.col("n0"))), ("profile join purchase total drift", F.abs(F.col("p") - F.col("p0"))),
            ("profile join redeem total drift", F.abs(F.col("r") - F.col("r0"))))]))
    )
    gaps = (
        ("balance users missing profile", users, profile, "user_id"), ("profile users absent from balance", profile, users, "user_id"),
        ("balance dates missing fund yield", days, yields, "report_date"), ("fund yield dates absent from balance", yields, days, "report_date"),
        ("balance dates without observed rate", days, observed, "report_date"), ("balance dates missing dense rate", days, dense, "report_date"),
    )
    counted = [a.select(k).distinct().join(b.select(k).distinct(), k, "left_anti").agg(F.count("*").alias("count")).select(F.lit(n).alias("coverage_check"), "count") for n, a, b, k in gaps]
    out = reduce(DataFrame.unionByName, [drift, *counted])
    informative = F.col("coverage_check") == "balance dates without observed rate"
    return out.withColumn("status", F.when(informative, "INFO").when(F.col("count") != 0, "FAIL").otherwise("PASS"))


def leakage_audit(profiles: DataFrame, panel: DataFrame, windows: DataFrame) -> DataFrame:
    """Of each window: whether the history that features were made of ends before it, and whether windows overlap.

    ``profiles`` has (id, user_id, rows_life, last_seen_life), as the snapshots use them; what
    they hold is looked at, whatever condition made them.  A window fails that ends before it
    starts, begins before an earlier one has ended, or has a history that reaches into it; one
    that doesn't begin a month, or lacks a day, asks for review.
    """
    history = profiles.groupBy("id").agg(F.max("last_seen_life").alias("last_history_day"), F.sum("rows_life").alias("history_rows"))
    inside = panel.join(F.broadcast(windows), F.col("report_date").between(F.col("start"), F.col("end"))).groupBy("id").agg(F.countDistinct("report_date").alias("days"))
    before = Window.orderBy("start", "id").rowsBetween(Window.unboundedPreceding, -1)  # configuration rows
    out = windows.withColumn("overlap", F.coalesce(F.max("end").over(before) >= F.col("start"), F.lit(False))).join(history, "id", "left").join(inside, "id", "left")
    bad = (F.col("start") > F.col("end")) | F.col("overlap") | F.coalesce(F.col("last_history_day") >= F.col("start"), F.lit(False))
    soft = (F.dayofmonth("start") != 1) | (F.coalesce("days", F.lit(0)) != F.datediff("end", "start") + 1)
    return out.select(
        "id", "start", "end", "overlap", "last_history_day", F.coalesce("history_rows", F.lit(0)).alias("history_rows"), F.coalesce("days", F.lit(0)).alias("observed_days"),
        status(bad.cast("int"), soft.cast("int")).alias("status"),
    )


#: The checks of the summary, their dimension and how serious a failure is.
CHECKS = {
    "types": ("schema", "CRITICAL"), "domain_constraints": ("validity", "HIGH"), "primary_keys": ("keys", "CRITICAL"), "structural_nulls": ("missingness", "INFO"),
    "negative_amounts": ("validity", "HIGH"), "additive_relationships": ("consistency", "MEDIUM"), "balance_continuity": ("consistency", "HIGH"), "calendar": ("completeness", "CRITICAL"),
    "anomalous_dates": ("anomaly", "MEDIUM"), "extreme_users": ("distribution", "INFO"), "cross_table_coverage": ("coverage", "HIGH"), "time_leakage": ("leakage", "CRITICAL"),
    "derived_reconciliation": ("reconciliation", "HIGH"),
}
#: Checks whose findings are looked at, not failed.
SOFT = ("additive_relationships", "balance_continuity", "anomalous_dates", "extreme_users")


def audit_summary(findings: Mapping[str, DataFrame]) -> DataFrame:
    """One row per check: dimension, severity if failed, the metric and the status.

    Each of ``findings`` is one row of two numbers, named as the check: the metric that is
    reported, and the violations.  Without violations a check passes; else it fails, or asks
    for review where it is a soft one.
    """
    rows = []
    for n, df in findings.items():
        metric, violations = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in df.columns)
        rows.append(df.select(F.lit(n).alias("check_id"), F.lit(CHECKS[n][0]).alias("dimension"), F.lit(CHECKS[n][1]).alias("severity_if_failed"), metric.alias("metric_value"), violations.alias("violations")))
    every = reduce(DataFrame.unionByName, rows)
    return every.withColumn("status", F.when(F.col("violations") == 0, "PASS").when(F.col("check_id").isin(*SOFT), "REVIEW").otherwise("FAIL"))


def quality_summary(panel: DataFrame) -> DataFrame:
    """Fourteen facts of the panel as (check, value, unit) rows; one pass, then long form."""
    distinct, low, high = F.countDistinct("report_date"), F.min("report_date"), F.max("report_date")
    null = lambda c: F.count_if(F.col(c).isNull())
    facts = {
        "rows": F.count("*"), "columns_loaded": F.lit(len(panel.columns)), "unique_users": F.countDistinct("user_id"), "date_min": low, "date_max": high, "distinct_dates": distinct,
        "expected_calendar_dates": F.datediff(high, low) + 1, "null_user_id": null("user_id"), "null_report_date": null("report_date"), "null_purchase": null("total_purchase_amt"),
        "null_redeem": null("total_redeem_amt"), "negative_purchase_rows": F.count_if(F.col("total_purchase_amt") < 0), "negative_redeem_rows": F.count_if(F.col("total_redeem_amt") < 0),
    }
    one = panel.agg(*[v.cast("string").alias(n) for n, v in facts.items()])
    twice = key_audit(panel, ["user_id", "report_date"], "panel").select((F.col("rows") - F.col("distinct_keys")).cast("string").alias("duplicate_user_date_rows"))
    wide = one.crossJoin(twice)  # a row each
    return wide.unpivot([], wide.columns, "check", "value").withColumn("unit", F.when(F.col("check").startswith("date_"), "date").otherwise("count"))


def submission_audit(table: DataFrame, start: str, end: str) -> DataFrame:
    """A headerless forecast (day as yyyyMMdd text, purchase, redeem as text) against its contract."""
    from .joins import calendar

    days = calendar(table, "d", start, end).select(F.date_format("d", "yyyyMMdd").alias("day"))
    digits = lambda c: F.coalesce(F.col(c).rlike("^[0-9]+$"), F.lit(False))
    shape = table.agg(
        F.count_if(~(F.coalesce(F.col("day").rlike("^[0-9]{8}$"), F.lit(False)))).alias("malformed_days"), (F.count("*") - F.countDistinct("day")).alias("repeated_days"),
        F.count_if(~digits("purchase")).alias("malformed_purchase"), F.count_if(~digits("redeem")).alias("malformed_redeem"),
    )
    lost = days.join(table, "day", "left_anti").agg(F.count("*").alias("missing_days"))
    more = table.join(days, "day", "left_anti").agg(F.count("*").alias("unexpected_days"))
    one = shape.crossJoin(lost).crossJoin(more)
    return one.unpivot([], one.columns, "check", "violations").withColumn("status", status("violations"))
