"""Queries over the user-by-day panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import banded, log1p, looked_up, positive
from ..operators import association, audits, features, joins, panel as ops, segments, series
from ..sources.tables import CALENDAR_SQL, PANEL_SQL, PANEL_WINDOWS, PROFILE_SQL, RATES_SQL, SERIES, panel, profile, rates, windows, windows_sql
from .registry import query
from .series_queries import _robust

P = f"WITH {PANEL_SQL}"
PW = f"WITH {PANEL_SQL}, {windows_sql()}"
PP = f"WITH {PANEL_SQL}, {PROFILE_SQL}"


@query(f"""{P} SELECT *, coalesce(category1, 0) AS category1_filled, coalesce(category2, 0) AS category2_filled, coalesce(category3, 0) AS category3_filled,
  coalesce(category4, 0) AS category4_filled, yBalance + total_purchase_amt - total_redeem_amt - tBalance AS balance_reconciliation_delta,
  yBalance + total_purchase_amt - total_redeem_amt = tBalance AS balance_identity_ok, consume_amt > 0 AS has_consume,
  category1 IS NOT NULL AND category2 IS NOT NULL AND category3 IS NOT NULL AND category4 IS NOT NULL AS has_consume_breakdown,
  round(ln(1 + total_purchase_amt), 3) AS purchase_log1p, round(ln(1 + total_redeem_amt), 3) AS redeem_log1p FROM panel""", "purchase_log1p redeem_log1p")
def typed_panel(spark, sf):
    out = ops.typed(panel(spark, sf))
    return out.withColumns({c: F.round(F.log1p(s), 3) for c, s in (("purchase_log1p", "total_purchase_amt"), ("redeem_log1p", "total_redeem_amt"))})


@query(f"""{P}, f AS (SELECT report_date, count(*) AS new_users FROM (SELECT user_id, min(report_date) AS report_date FROM panel GROUP BY 1) GROUP BY 1)
SELECT d.*, coalesce(f.new_users, 0) AS new_users, ln(1 + total_purchase_amt) AS purchase_log1p, ln(1 + total_redeem_amt) AS redeem_log1p FROM (
  SELECT report_date, count(*) AS rows, count(DISTINCT user_id) AS users, sum(tBalance)::BIGINT AS total_balance, sum(total_purchase_amt)::BIGINT AS total_purchase_amt,
    sum(total_redeem_amt)::BIGINT AS total_redeem_amt, count(*) FILTER (total_purchase_amt > 0) AS purchase_users, count(*) FILTER (total_redeem_amt > 0) AS redeem_users,
    count(*) FILTER (yBalance + total_purchase_amt - total_redeem_amt <> tBalance) AS balance_identity_failures FROM panel GROUP BY 1) d LEFT JOIN f USING (report_date)""", "purchase_log1p redeem_log1p")
def daily_aggregate(spark, sf):
    return ops.daily_aggregate(panel(spark, sf))


@query(f"""{P}, d AS (SELECT report_date, count(DISTINCT user_id) AS observed_users, sum(yBalance)::BIGINT AS opening_balance_amt, sum(tBalance)::BIGINT AS closing_balance_amt,
  sum(direct_purchase_amt)::BIGINT AS direct_inflow_amt, sum(purchase_bal_amt)::BIGINT AS balance_purchase_inflow_amt, sum(purchase_bank_amt)::BIGINT AS bankcard_purchase_inflow_amt,
  sum(share_amt)::BIGINT AS profit_share_inflow_amt, sum(total_purchase_amt)::BIGINT AS total_inflow_amt, sum(total_redeem_amt)::BIGINT AS total_outflow_amt,
  sum(transfer_amt)::BIGINT AS transfer_outflow_amt, sum(consume_amt)::BIGINT AS consume_outflow_amt, sum(tftobal_amt)::BIGINT AS transfer_to_balance_amt, sum(tftocard_amt)::BIGINT AS transfer_to_card_amt,
  count(*) FILTER (direct_purchase_amt > 0) AS direct_inflow_users, count(*) FILTER (total_redeem_amt > 0) AS total_outflow_users, count(*) FILTER (transfer_amt > 0) AS transfer_users,
  count(*) FILTER (consume_amt > 0) AS consume_users FROM panel GROUP BY 1)
SELECT *, total_inflow_amt - total_outflow_amt AS net_flow_amt, coalesce(direct_inflow_amt::DOUBLE / nullif(direct_inflow_users, 0), 0) AS direct_inflow_per_user,
  coalesce(total_outflow_amt::DOUBLE / nullif(total_outflow_users, 0), 0) AS outflow_per_user, coalesce(consume_outflow_amt::DOUBLE / nullif(total_outflow_amt, 0), 0) AS consume_share,
  coalesce(total_outflow_amt::DOUBLE / nullif(opening_balance_amt, 0), 0) AS outflow_to_opening FROM d""", "direct_inflow_per_user outflow_per_user consume_share outflow_to_opening")
def daily_flow_table(spark, sf):
    return ops.daily_flow(panel(spark, sf))


@query(f"{P} SELECT strftime(f, '%Y-%m') AS month, count(*) AS new_users FROM (SELECT user_id, min(report_date) AS f FROM panel GROUP BY 1) GROUP BY 1")
def new_users_by_month(spark, sf):
    return ops.new_users_by_month(panel(spark, sf))


_TARGETS = ", ".join(f"'{t}'" for t in ops.TARGETS)
@query(f"""{P}, l AS (SELECT user_id, report_date, target, v FROM (SELECT user_id, report_date, {", ".join(f"coalesce({t}, 0) AS {t}" for t in ops.TARGETS)} FROM panel) UNPIVOT (v FOR target IN ({", ".join(ops.TARGETS)}))),
m AS (SELECT max(report_date) AS last FROM panel)
SELECT user_id, target, CAST(date_diff('day', min(report_date), max(last)) + 1 AS INTEGER) AS exposure_days, sum(v)::BIGINT AS total, count(*) FILTER (v > 0) AS active_days,
  sum(v)::DOUBLE / (date_diff('day', min(report_date), max(last)) + 1) AS per_exposure_day, count(*) FILTER (v > 0)::DOUBLE / (date_diff('day', min(report_date), max(last)) + 1) AS active_day_rate,
  coalesce(sum(v)::DOUBLE / nullif(count(*) FILTER (v > 0), 0), 0) AS positive_day_mean FROM l, m GROUP BY 1, 2""", "per_exposure_day active_day_rate positive_day_mean")
def user_metrics(spark, sf):
    return ops.user_metrics(panel(spark, sf))


@query(f"""{P}, l AS (SELECT user_id, report_date, yBalance - lag(tBalance) OVER w AS delta, date_diff('day', lag(report_date) OVER w, report_date) AS gap FROM panel WINDOW w AS (PARTITION BY user_id ORDER BY report_date)),
s AS (SELECT 'previous_row' AS scope, delta FROM l WHERE gap IS NOT NULL UNION ALL SELECT 'calendar_day', delta FROM l WHERE gap = 1)
SELECT scope, count(*) AS checks, count(*) FILTER (delta <> 0) AS mismatches, max(abs(delta)) AS max_abs_delta FROM s GROUP BY 1""")
def balance_continuity(spark, sf):
    return ops.continuity(panel(spark, sf))


@query(f"{P} SELECT user_id, report_date, lag(tBalance) OVER w AS previous_balance, CAST(date_diff('day', lag(report_date) OVER w, report_date) AS INTEGER) AS gap_days FROM panel WINDOW w AS (PARTITION BY user_id ORDER BY report_date)")
def user_lag(spark, sf):
    return ops.user_lag(panel(spark, sf)).select("user_id", "report_date", "previous_balance", "gap_days")


_USERS = """u AS (SELECT user_id, count(*) AS observed_days, count(*) FILTER (total_purchase_amt > 0) AS purchase_days, count(*) FILTER (total_redeem_amt > 0) AS redeem_days, sum(total_purchase_amt)::BIGINT AS purchase_total,
  sum(total_redeem_amt)::BIGINT AS redeem_total, max(total_purchase_amt) AS purchase_daily_max, max(total_redeem_amt) AS redeem_daily_max, max(tBalance) AS balance_max FROM panel GROUP BY 1)"""
@query(f"""{P}, {_USERS}, c AS (SELECT *, {", ".join(f"cume_dist() OVER (ORDER BY {m}) AS {m}_pct_rank" for m in ops.EXTREME_METRICS)} FROM u),
t AS ({" UNION ".join(f"(SELECT user_id FROM u ORDER BY {m} DESC, user_id LIMIT 50)" for m in ops.EXTREME_METRICS)})
SELECT c.*, concat_ws(',', {", ".join(f"CASE WHEN {m}_pct_rank >= 0.999 THEN '{m}' END" for m in ops.EXTREME_METRICS)}) AS extreme_dimensions FROM c SEMI JOIN t USING (user_id)""", " ".join(f"{m}_pct_rank" for m in ops.EXTREME_METRICS))
def extreme_users(spark, sf):
    return ops.extreme_users(panel(spark, sf))


@query(f"""{P}, {_USERS}, l AS (SELECT 'purchase_total' AS metric, user_id, purchase_total AS v FROM u UNION ALL SELECT 'redeem_total', user_id, redeem_total FROM u), r AS (SELECT metric, v, row_number() OVER (PARTITION BY metric ORDER BY v DESC, user_id) AS rn FROM l),
n AS (SELECT metric, count(*) AS n, sum(v) AS total FROM l GROUP BY 1), g AS (SELECT unnest(['top_1_user', 'top_10_users', {", ".join(f"'{g}'" for _, g in ops.SHARES)}]) AS "group", unnest([0.0, 0.0, 0.001, 0.01, 0.05, 0.1]) AS p, unnest([1, 10, 0, 0, 0, 0]) AS fixed),
k AS (SELECT metric, "group", CASE WHEN fixed > 0 THEN fixed ELSE greatest(1, CAST(ceil(n * p::DOUBLE) AS BIGINT)) END AS k, total FROM g, n)
SELECT k.metric, "group", k AS user_count, sum(v)::BIGINT AS amount, sum(v)::DOUBLE / any_value(total) AS share FROM k JOIN r ON r.metric = k.metric AND rn <= k GROUP BY 1, 2, 3""", "share")
def user_concentration(spark, sf):
    return ops.concentration(panel(spark, sf))


@query(f"""{P} SELECT report_date, count(*) AS rows, avg((total_purchase_amt = 0)::INT) AS zero_purchase_rate, avg((total_redeem_amt = 0)::INT) AS zero_redeem_rate, max(total_purchase_amt) AS max_purchase,
  max(total_redeem_amt) AS max_redeem, coalesce(max(total_purchase_amt)::DOUBLE / nullif(sum(total_purchase_amt), 0), 0) AS top_purchase_share, coalesce(max(total_redeem_amt)::DOUBLE / nullif(sum(total_redeem_amt), 0), 0) AS top_redeem_share
  FROM panel GROUP BY 1""", "zero_purchase_rate zero_redeem_rate top_purchase_share top_redeem_share")
def daily_quality(spark, sf):
    return ops.daily_quality(panel(spark, sf))


_PROFILED = ("user_id", "report_date", "tBalance", "category1")
_KINDS = {"user_id": "bigint", "report_date": "date", "tBalance": "bigint", "category1": "bigint"}
@query(f"{P} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{_KINDS[c]}' AS type, count(*) AS rows, count(*) - count({c}) AS nulls, (count(*) - count({c}))::DOUBLE / count(*) AS null_rate, count(DISTINCT {c}) AS distinct_values, min({c})::VARCHAR AS min_value, max({c})::VARCHAR AS max_value FROM panel" for c in _PROFILED), "null_rate")
def column_profile(spark, sf):
    return audits.column_profile(panel(spark, sf).select(*_PROFILED))


@query(f"""{P}, k AS (SELECT 'panel' AS "table", count(*) AS c, user_id IS NULL OR report_date IS NULL AS nul FROM panel GROUP BY user_id, report_date UNION ALL SELECT 'panel_by_day', count(*), report_date IS NULL FROM panel GROUP BY report_date)
SELECT "table", sum(c)::BIGINT AS rows, count(*) AS distinct_keys, coalesce(sum(c) FILTER (c > 1), 0)::BIGINT AS duplicate_rows, coalesce(sum(c) FILTER (nul), 0)::BIGINT AS null_key_rows,
  CASE WHEN coalesce(sum(c) FILTER (c > 1 OR nul), 0) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM k GROUP BY 1""")
def key_audit(spark, sf):
    p = panel(spark, sf)
    return audits.key_audit(p, ["user_id", "report_date"], "panel").unionByName(audits.key_audit(p, ["report_date"], "panel_by_day"))


@query(f"{P}, d AS (" + " UNION ALL ".join(f"SELECT '{n}' AS identity, ({a}) - ({b}) AS d FROM panel" for n, a, b in audits.IDENTITIES) + """)
SELECT identity, count(d) AS rows, count(*) FILTER (d <> 0) AS mismatches, (count(d) - count(*) FILTER (d <> 0))::DOUBLE / count(d) AS match_rate, max(abs(d)) AS max_abs_delta, sum(d)::BIGINT AS sum_delta,
  CASE WHEN count(*) FILTER (d <> 0) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM d GROUP BY 1""", "match_rate")
def identity_audit(spark, sf):
    return audits.identity_audit(panel(spark, sf))


_RULES = {f"{a}_not_negative": f"{a} >= 0" for a in ("tBalance", "yBalance", "total_purchase_amt", "total_redeem_amt", "consume_amt", "transfer_amt")} | {
    "categories_all_or_none": "(category1 IS NULL) = (category2 IS NULL) AND (category2 IS NULL) = (category3 IS NULL) AND (category3 IS NULL) = (category4 IS NULL)",
    "categories_null_iff_no_consume": "(category1 IS NULL AND category2 IS NULL AND category3 IS NULL AND category4 IS NULL) = (consume_amt = 0)", "amounts_finite": "true",
}
@query(f"{P} " + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (NOT ({r})) AS violations, CASE WHEN count(*) FILTER (NOT ({r})) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM panel" for n, r in _RULES.items()))
def domain_audit(spark, sf):
    return audits.domain_audit(panel(spark, sf), audits.panel_rules())


_AMOUNTS = ("tBalance", "yBalance", "total_purchase_amt", "direct_purchase_amt", "purchase_bal_amt", "purchase_bank_amt", "total_redeem_amt", "consume_amt", "transfer_amt", "tftobal_amt", "tftocard_amt", "share_amt", "category1", "category2", "category3", "category4")
@query(f"""{PP}, {RATES_SQL}, v AS (SELECT unnest(['user_id positive integer', 'source amounts non-negative', 'sex domain subset of {{0,1}}', 'city has exactly 25 non-null codes', 'constellation has exactly 5 non-null values', 'rates finite and positive']) AS "constraint",
  unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'MEDIUM', 'MEDIUM', 'HIGH']) AS severity, unnest([(SELECT count(*) FILTER (user_id <= 0) FROM panel), (SELECT {" + ".join(f"count(*) FILTER ({a} < 0)" for a in _AMOUNTS)} FROM panel), (SELECT count(*) FILTER (sex NOT IN (0, 1)) FROM profile),
  (SELECT (count(DISTINCT city) <> 25)::BIGINT FROM profile), (SELECT (count(DISTINCT constellation) <> 5)::BIGINT FROM profile), (SELECT count(*) FILTER (rate_1d <= 0) + count(*) FILTER (rate_7d <= 0) FROM rates)]) AS violation_count)
SELECT "constraint", violation_count::BIGINT AS violation_count, severity, CASE WHEN violation_count > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM v""")
def business_domains(spark, sf):
    return audits.business_domains(panel(spark, sf), profile(spark, sf), rates(spark, sf), cities=25, signs=5)


@query(f"""{P}, c AS (SELECT count(*) FILTER (n = 4) AS all_null_rows, count(*) FILTER (n BETWEEN 1 AND 3) AS partial_null_rows, count(*) FILTER ((n = 4) <> (consume_amt = 0)) AS disagreeing_rows FROM (SELECT consume_amt, (category1 IS NULL)::INT + (category2 IS NULL)::INT + (category3 IS NULL)::INT + (category4 IS NULL)::INT AS n FROM panel))
SELECT *, CASE WHEN partial_null_rows + disagreeing_rows > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM c""")
def structural_nulls(spark, sf):
    return audits.structural_nulls(panel(spark, sf))


def _dated(spark, df):
    """Dates of the rate table moved onto the panel's calendar."""
    return df.select(F.date_add("report_date", 2556).alias("report_date"))


_GAP = lambda a, b, k: f"(SELECT count(DISTINCT {k}) FROM {a} ANTI JOIN {b} USING ({k}))"
@query(f"""{PP}, {RATES_SQL}, cal AS (SELECT CAST(unnest({CALENDAR_SQL}) AS DATE) + 2556 AS report_date), obs AS (SELECT report_date + 2556 AS report_date FROM rates), j AS (SELECT p.*, f.user_id IS NOT NULL AS matched FROM panel p LEFT JOIN profile f USING (user_id)),
v AS (SELECT unnest(['balance users missing profile', 'profile users absent from balance', 'balance dates missing fund yield', 'fund yield dates absent from balance', 'balance dates without observed rate', 'balance dates missing dense rate', 'profile join unmatched or row inflation', 'profile join purchase total drift', 'profile join redeem total drift']) AS coverage_check,
  unnest([{_GAP("panel", "profile", "user_id")}, {_GAP("profile", "panel", "user_id")}, {_GAP("panel", "cal", "report_date")}, {_GAP("cal", "panel", "report_date")}, {_GAP("panel", "obs", "report_date")}, {_GAP("panel", "cal", "report_date")},
  (SELECT count(*) FILTER (NOT matched) FROM j) + abs((SELECT count(*) FROM j) - (SELECT count(*) FROM panel)), abs((SELECT sum(total_purchase_amt)::BIGINT FROM j) - (SELECT sum(total_purchase_amt)::BIGINT FROM panel)), abs((SELECT sum(total_redeem_amt)::BIGINT FROM j) - (SELECT sum(total_redeem_amt)::BIGINT FROM panel))]) AS "count")
SELECT coverage_check, "count"::BIGINT AS "count", CASE WHEN coverage_check = 'balance dates without observed rate' THEN 'INFO' WHEN "count" <> 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM v""")
def coverage_audit(spark, sf):
    r = rates(spark, sf)
    cal = joins.calendar(r, "report_date", *SERIES)
    return audits.coverage(panel(spark, sf), profile(spark, sf), _dated(spark, cal), _dated(spark, r), _dated(spark, cal))


#: The panel's windows, and one that reaches back into the last of them: a leak to be found.
_LEAKY = (*PANEL_WINDOWS, ("w4", "2024-06-20", "2024-07-01"))
_LEAK_SQL = f"""{windows_sql(_LEAKY)}, h AS (SELECT id, max(last) AS last_history_day, sum(n)::BIGINT AS history_rows FROM (SELECT id, user_id, max(report_date) FILTER (report_date < "start") AS last, count(*) FILTER (report_date < "start") AS n FROM panel JOIN windows ON report_date <= "end" GROUP BY 1, 2) GROUP BY 1),
i AS (SELECT id, count(DISTINCT report_date) AS d FROM panel JOIN windows ON report_date BETWEEN "start" AND "end" GROUP BY 1), o AS (SELECT *, coalesce(max("end") OVER (ORDER BY "start", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= "start", false) AS overlap FROM windows),
leaks AS (SELECT id, "start", "end", overlap, last_history_day, coalesce(history_rows, 0) AS history_rows, coalesce(d, 0) AS observed_days,
  CASE WHEN "start" > "end" OR overlap OR coalesce(last_history_day >= "start", false) THEN 'FAIL' WHEN day("start") <> 1 OR coalesce(d, 0) <> date_diff('day', "start", "end") + 1 THEN 'REVIEW' ELSE 'PASS' END AS status
  FROM o LEFT JOIN h USING (id) LEFT JOIN i USING (id))"""
@query(f"{P}, {_LEAK_SQL} SELECT * FROM leaks")
def leakage_audit(spark, sf):
    p, w = panel(spark, sf), windows(spark, _LEAKY)
    return audits.leakage_audit(segments.periods(p, w).select("id", "user_id", "rows_life", "last_seen_life"), p, w)


@query(f"""{P}, v AS (SELECT count(*)::VARCHAR AS rows, '18' AS columns_loaded, count(DISTINCT user_id)::VARCHAR AS unique_users, min(report_date)::VARCHAR AS date_min, max(report_date)::VARCHAR AS date_max, count(DISTINCT report_date)::VARCHAR AS distinct_dates,
  (date_diff('day', min(report_date), max(report_date)) + 1)::VARCHAR AS expected_calendar_dates, (count(*) - count(DISTINCT (user_id, report_date)))::VARCHAR AS duplicate_user_date_rows, count(*) FILTER (user_id IS NULL)::VARCHAR AS null_user_id,
  count(*) FILTER (report_date IS NULL)::VARCHAR AS null_report_date, count(*) FILTER (total_purchase_amt IS NULL)::VARCHAR AS null_purchase, count(*) FILTER (total_redeem_amt IS NULL)::VARCHAR AS null_redeem,
  count(*) FILTER (total_purchase_amt < 0)::VARCHAR AS negative_purchase_rows, count(*) FILTER (total_redeem_amt < 0)::VARCHAR AS negative_redeem_rows FROM panel)
SELECT "check", value, CASE WHEN "check" LIKE 'date\\_%' ESCAPE '\\' THEN 'date' ELSE 'count' END AS unit FROM v UNPIVOT (value FOR "check" IN (COLUMNS(*)))""")
def quality_summary(spark, sf):
    return audits.quality_summary(panel(spark, sf))


@query(f"""{P}, s AS (SELECT unnest(['rows', 'total_purchase_amt', 'total_redeem_amt']) AS measure, unnest([count(*), sum(total_purchase_amt)::BIGINT, sum(total_redeem_amt)::BIGINT]) AS t FROM panel)
SELECT measure, t AS source_total, t AS derived_total, 0::BIGINT AS delta, 'PASS' AS status FROM s""")
def reconcile_layer(spark, sf):
    p = panel(spark, sf)
    return audits.reconcile(p, ops.typed(p), ["total_purchase_amt", "total_redeem_amt"])


@query(f"""{P}, u AS (SELECT user_id, sha256('coldstart|' || user_id) AS sample_hash FROM (SELECT DISTINCT user_id FROM panel)), r AS (SELECT *, row_number() OVER (ORDER BY sample_hash) AS rank FROM u)
SELECT user_id, sample_hash, rank::INTEGER AS rank, CAST(ceil(rank / 40.0) AS INTEGER) AS fold FROM r WHERE rank <= 80""")
def hash_folds(spark, sf):
    return ops.hash_folds(panel(spark, sf), "coldstart", 40, 2)


_FOLDS = """f AS (SELECT user_id, CAST(ceil(rank / 40.0) AS INTEGER) AS fold FROM (SELECT user_id, row_number() OVER (ORDER BY sha256('coldstart|' || user_id)) AS rank FROM (SELECT DISTINCT user_id FROM panel)) WHERE rank <= 80)"""
@query(f"""{P}, {_FOLDS}, i AS (SELECT * FROM panel WHERE report_date BETWEEN DATE '2024-05-30' AND DATE '2024-06-28'), t AS (SELECT sum(total_purchase_amt) AS ap, sum(total_redeem_amt) AS ar FROM i),
m AS (SELECT fold, count(*) AS members FROM f GROUP BY 1), a AS (SELECT fold, count(DISTINCT user_id) AS active_users, count(*) AS rows, sum(total_purchase_amt)::BIGINT AS purchase, sum(total_redeem_amt)::BIGINT AS redeem FROM i JOIN f USING (user_id) GROUP BY 1)
SELECT fold, members, coalesce(active_users, 0) AS active_users, coalesce(rows, 0) AS rows, coalesce(purchase, 0) AS purchase, coalesce(redeem, 0) AS redeem, coalesce(purchase::DOUBLE / nullif(ap, 0), 0) AS purchase_share,
  coalesce(redeem::DOUBLE / nullif(ar, 0), 0) AS redeem_share FROM m LEFT JOIN a USING (fold), t""", "purchase_share redeem_share")
def fold_activity(spark, sf):
    p = panel(spark, sf)
    return ops.fold_activity(p, ops.hash_folds(p, "coldstart", 40, 2), "2024-05-30", "2024-06-28")


@query(f"""{P}, {_FOLDS} SELECT fold, count(*) AS users, sha256(string_agg(user_id::VARCHAR, chr(10) ORDER BY user_id) || chr(10)) AS list_sha256 FROM f GROUP BY 1""")
def fold_list_hashes(spark, sf):
    from ..functions import list_hash

    return ops.hash_folds(panel(spark, sf), "coldstart", 40, 2).groupBy("fold").agg(F.count("*").alias("users"), list_hash(F.collect_list("user_id")).alias("list_sha256"))


@query(f"""WITH {PANEL_SQL}, c(id, "start", "end") AS (VALUES ('early', DATE '2024-01-01', DATE '2024-01-03'), ('late', DATE '2024-01-04', DATE '2024-06-28')),
f AS (SELECT user_id, min(report_date) AS first FROM panel GROUP BY 1), i AS (SELECT user_id, count(DISTINCT report_date) AS days, sum(total_purchase_amt) AS purchase FROM panel WHERE report_date BETWEEN DATE '2024-05-30' AND DATE '2024-06-28' GROUP BY 1),
t AS (SELECT sum(purchase) AS ap FROM i)
SELECT id, count(*) AS users, count(days) AS active_users, count(*) FILTER (days >= 2) AS steady_users, coalesce(sum(purchase), 0)::BIGINT AS purchase, coalesce(sum(purchase)::DOUBLE / nullif(any_value(ap), 0), 0) AS purchase_share
FROM c JOIN f ON first BETWEEN "start" AND "end" LEFT JOIN i USING (user_id), t GROUP BY 1""", "purchase_share")
def new_user_cohorts(spark, sf):
    rows = (("early", "2024-01-01", "2024-01-03"), ("late", "2024-01-04", "2024-06-28"))
    return ops.cohorts(panel(spark, sf), windows(spark, rows), "2024-05-30", "2024-06-28")


_FLOW = {"direct": "direct_purchase_amt", "purchase": "total_purchase_amt", "bank": "purchase_bank_amt", "share": "share_amt", "redeem": "total_redeem_amt", "consume": "consume_amt", "transfer": "transfer_amt"}


def _period_sql(s: str, cond: str) -> str:
    f = f"FILTER ({cond})"
    out = [
        f"count(*) {f} AS rows_{s}", f"min(report_date) {f} AS first_seen_{s}", f"max(report_date) {f} AS last_seen_{s}", f"arg_min(yBalance, report_date) {f} AS start_balance_{s}", f"arg_max(tBalance, report_date) {f} AS end_balance_{s}",
        f"max(tBalance) {f} AS max_balance_{s}", f"avg(tBalance) {f} AS mean_balance_{s}", f"stddev_samp(tBalance) {f} AS std_balance_{s}", f"count(*) FILTER ({cond} AND tBalance > 0) AS positive_balance_days_{s}",
        f"count(*) FILTER ({cond} AND (direct_purchase_amt > 0 OR total_redeem_amt > 0)) AS active_flow_days_{s}",
    ]
    for n, c in _FLOW.items():
        out += [f"coalesce(sum({c}) {f}, 0)::BIGINT AS {n}_{s}", f"coalesce(max({c}) {f}, 0) AS {n}_max_{s}"]
    for n in ("direct", "redeem", "consume", "transfer"):
        c = _FLOW[n]
        out += [f"count(*) FILTER ({cond} AND {c} > 0) AS {n}_days_{s}", f"coalesce(quantile_cont({c}, 0.5) FILTER ({cond} AND {c} > 0), 0) AS {n}_median_{s}"]
    return ", ".join(out)


_LIFE = 'report_date < "start"'
_PERIODS = f"""{PW}, periods AS (SELECT id, "start", "end", user_id, {_period_sql("life", _LIFE)}, {_period_sql("90", _LIFE + ' AND report_date >= "start" - 90')}, {_period_sql("30", _LIFE + ' AND report_date >= "start" - 30')},
  {", ".join(f"max(report_date) FILTER ({_LIFE} AND {_FLOW[n]} > 0) AS last_{n}_day" for n in ("direct", "redeem", "consume", "transfer"))},
  {", ".join(f'''coalesce(sum({_FLOW[n]}) FILTER (report_date BETWEEN "start" AND "end"), 0)::BIGINT AS future_{n}, count(*) FILTER (report_date BETWEEN "start" AND "end" AND {_FLOW[n]} > 0) AS future_{n}_days''' for n in ("purchase", "redeem", "consume", "transfer"))}
  FROM panel JOIN windows ON report_date <= "end" GROUP BY 1, 2, 3, 4)"""
_D = lambda a, b: f"coalesce(({a})::DOUBLE / nullif(({b}), 0), 0.0)"
_REC = lambda c: f"greatest(1, least(999, coalesce(date_diff('day', {c}, \"start\"), 999)))::INTEGER"
_FEATURES = f"""{_PERIODS}, feats AS (SELECT *, greatest(1, date_diff('day', first_seen_life, "start"))::INTEGER AS tenure_days, {", ".join(f"{_REC(f'last_{n}_day')} AS {n}_recency" for n in ("direct", "redeem", "consume", "transfer"))},
  {_REC("greatest(coalesce(last_direct_day, last_redeem_day), coalesce(last_redeem_day, last_direct_day))")} AS active_recency, {_D("least(direct_90, transfer_90)", "greatest(direct_90, transfer_90)")} AS roundtrip_90,
  {_D("direct_90 - redeem_90", "direct_90 + redeem_90")} AS net_flow_share_90, {_D("consume_90", "redeem_90")} AS consume_share_90, {_D("transfer_90", "redeem_90")} AS transfer_share_90, {_D("bank_90", "direct_90")} AS bank_share_90,
  {_D("positive_balance_days_life", "rows_life")} AS positive_balance_ratio, {_D("std_balance_life", "abs(mean_balance_life) + 1")} AS balance_cv, active_flow_days_90 / 3.0::DOUBLE AS active_days_per_30, direct_90 + transfer_90 AS volume_90
  FROM periods WHERE rows_life > 0), thresholds AS (SELECT id, quantile_cont(active_flow_days_90, 0.75) FILTER (active_flow_days_90 > 0) AS p75_active, quantile_cont(volume_90, 0.9) FILTER (direct_90 > 0 AND transfer_90 > 0) AS p90_volume,
  quantile_cont(consume_days_90, 0.75) FILTER (consume_days_90 > 0) AS p75_consume, (SELECT quantile_cont(consume_amt, 0.5) FROM panel, windows w WHERE w.id = feats.id AND consume_amt > 0 AND report_date < w."start" AND report_date >= w."start" - 90) AS p50_consume_row FROM feats GROUP BY id)"""
_INACTIVE = "(direct_life = 0 AND redeem_life = 0)"
_RULE_SQL = {
    "no_active_history": _INACTIVE, "history_insufficient": "tenure_days < 28", "observed_never_used": f"{_INACTIVE} AND tenure_days >= 28 AND max_balance_life = 0", "passive_balance_only": f"{_INACTIVE} AND tenure_days >= 28 AND max_balance_life > 0",
    "funded_never_withdrawn": "direct_life > 0 AND redeem_life = 0 AND end_balance_life > 0", "dormant_zero_balance": f"NOT {_INACTIVE} AND active_flow_days_90 = 0 AND end_balance_life = 0",
    "low_turnover_holder": "end_balance_life > 0 AND active_flow_days_90 <= 1 AND redeem_90 <= 0.05 * (end_balance_life + direct_90 + 1)",
    "frequent_large_roundtrip": "active_flow_days_90 >= greatest(4, p75_active) AND direct_days_90 >= 3 AND transfer_days_90 >= 3 AND volume_90 >= p90_volume AND direct_90 > 0 AND transfer_90 > 0 AND roundtrip_90 >= 0.5",
    "frequent_small_consumer": "consume_days_90 >= greatest(3, p75_consume) AND consume_median_90 <= p50_consume_row AND consume_share_90 >= 0.5", "transfer_oriented": "redeem_90 > 0 AND transfer_share_90 >= 0.8", "consumption_oriented": "redeem_90 > 0 AND consume_share_90 >= 0.8",
}
_SNAP = f"""{_FEATURES}, ruled AS (SELECT *, {", ".join(f"coalesce({r}, false) AS {n}" for n, r in _RULE_SQL.items())} FROM feats JOIN thresholds USING (id)),
snap AS (SELECT *, CASE {" ".join(f"WHEN {r} THEN '{r}'" for r in segments.PRECEDENCE)} WHEN net_flow_share_90 >= 0.5 THEN 'inflow_dominant' WHEN net_flow_share_90 <= -0.5 THEN 'outflow_dominant' ELSE 'balanced_or_other_active' END AS segment FROM ruled)"""
_DOUBLES = "mean_balance std_balance direct_median redeem_median consume_median transfer_median"


@query(f"{_PERIODS} SELECT * FROM periods", " ".join(f"{c}_{s}" for c in _DOUBLES.split() for s in ("life", "90", "30")))
def period_profiles(spark, sf):
    return segments.periods(panel(spark, sf), windows(spark))


_SNAP_COLUMNS = ("id", "user_id", "tenure_days", "direct_recency", "redeem_recency", "consume_recency", "transfer_recency", "active_recency", "roundtrip_90", "net_flow_share_90", "consume_share_90", "transfer_share_90", "bank_share_90", "positive_balance_ratio", "balance_cv", "active_days_per_30", "volume_90", *segments.RULES, "segment")
@query(f"{_SNAP} SELECT {', '.join(_SNAP_COLUMNS)} FROM snap", "roundtrip_90 net_flow_share_90 consume_share_90 transfer_share_90 bank_share_90 positive_balance_ratio balance_cv active_days_per_30")
def user_snapshots(spark, sf):
    return segments.snapshot(panel(spark, sf), windows(spark)).select(*_SNAP_COLUMNS)


@query(f"{_FEATURES} SELECT * FROM thresholds", "p75_active p90_volume p75_consume p50_consume_row")
def segment_thresholds(spark, sf):
    p, w = panel(spark, sf), windows(spark)
    return segments.thresholds(segments.features(segments.periods(p, w)), p, w)


@query(f"""{_PERIODS} SELECT id, count(*) FILTER (rows_life > 0) AS known_users, count(*) FILTER (rows_life = 0) AS new_users, count(*) FILTER (rows_life > 0 AND future_purchase_days + future_redeem_days > 0) AS known_active,
  coalesce(sum(future_purchase) FILTER (rows_life > 0), 0)::BIGINT AS known_purchase, sum(future_purchase)::BIGINT AS all_purchase, coalesce(sum(future_redeem) FILTER (rows_life > 0), 0)::BIGINT AS known_redeem, sum(future_redeem)::BIGINT AS all_redeem,
  {_D("sum(future_purchase) FILTER (rows_life > 0)", "sum(future_purchase)")} AS known_purchase_share, {_D("sum(future_redeem) FILTER (rows_life > 0)", "sum(future_redeem)")} AS known_redeem_share FROM periods GROUP BY 1""", "known_purchase_share known_redeem_share")
def cold_start(spark, sf):
    return segments.cold_start(segments.periods(panel(spark, sf), windows(spark)))


_FUTURE = ("purchase", "redeem", "consume", "transfer")
_SEG = f"""{_SNAP}, g AS (SELECT id, segment, count(*) AS users, avg((future_purchase_days > 0)::INT) AS purchase_rate, avg((future_redeem_days > 0)::INT) AS redeem_rate, sum(end_balance_life)::BIGINT AS balance,
  {", ".join(f"sum(future_{t})::BIGINT AS future_{t}, avg(future_{t}) AS mean_{t}, quantile_cont(future_{t}, 0.5) AS median_{t}" for t in _FUTURE)} FROM snap GROUP BY 1, 2)"""
_SEG_SQL = f"""SELECT *, users::DOUBLE / sum(users) OVER w AS user_share, coalesce(balance::DOUBLE / nullif(sum(balance) OVER w, 0), 0) AS balance_share, {", ".join(f"coalesce({t}_rate / nullif(sum({t}_rate * users) OVER w / sum(users) OVER w, 0), 0) AS {t}_lift" for t in ("purchase", "redeem"))},
  {", ".join(f"coalesce(future_{t}::DOUBLE / nullif(sum(future_{t}) OVER w, 0), 0) AS {t}_share" for t in _FUTURE)} FROM g WINDOW w AS (PARTITION BY id)"""
@query(f"{_SEG} {_SEG_SQL}", "purchase_rate redeem_rate user_share balance_share purchase_lift redeem_lift " + " ".join(f"mean_{t} median_{t} {t}_share" for t in _FUTURE))
def segment_summary(spark, sf):
    return segments.summarize_segments(segments.snapshot(panel(spark, sf), windows(spark)))


@query(f"{_SEG}, s AS ({_SEG_SQL}) SELECT segment, count(*) AS windows, quantile_cont(user_share, 0.5) AS median_share, min(user_share) AS min_share, max(user_share) AS max_share FROM s GROUP BY 1", "median_share min_share max_share")
def segment_rollup(spark, sf):
    s = segments.summarize_segments(segments.snapshot(panel(spark, sf), windows(spark)))
    return s.groupBy("segment").agg(F.count("*").alias("windows"), F.percentile("user_share", F.lit(0.5)).alias("median_share"), F.min("user_share").alias("min_share"), F.max("user_share").alias("max_share"))


@query(f"{_SNAP} SELECT segment, " + ", ".join(f"coalesce(count(*) FILTER (id = '{w[0]}'), 0) AS {w[0]}" for w in PANEL_WINDOWS) + " FROM snap GROUP BY 1")
def segment_pivot(spark, sf):
    s = segments.snapshot(panel(spark, sf), windows(spark))
    ids = [w[0] for w in PANEL_WINDOWS]
    return s.groupBy("segment").pivot("id", ids).count().na.fill(0, ids)


@query(f"{_SNAP}, l AS (" + " UNION ALL ".join(f"SELECT id, '{r}' AS rule, {r} AS hit, future_purchase AS m_purchase, future_redeem AS m_redeem, (future_purchase_days > 0)::INT AS b_purchase, (future_redeem_days > 0)::INT AS b_redeem FROM snap" for r in segments.RULES) + f""")
SELECT id, rule, count(*) FILTER (hit) AS users, count(*) FILTER (hit)::DOUBLE / count(*) AS coverage, {", ".join(f"coalesce(avg(b_{t}) FILTER (hit), 0) AS {t}_rate, coalesce(avg(b_{t}) FILTER (hit) / nullif(avg(b_{t}), 0), 0) AS {t}_lift, coalesce(avg(m_{t}) FILTER (hit), 0) AS mean_{t}" for t in ("purchase", "redeem"))}
  FROM l GROUP BY 1, 2""", "coverage purchase_rate purchase_lift mean_purchase redeem_rate redeem_lift mean_redeem")
def rule_summary(spark, sf):
    return segments.summarize_rules(segments.snapshot(panel(spark, sf), windows(spark)))


@query(f"{_SNAP} " + " UNION ALL ".join(f"SELECT id, '{a}' AS rule_a, '{b}' AS rule_b, count(*) FILTER ({a} AND {b}) AS both, count(*) FILTER ({a} OR {b}) AS either, coalesce(count(*) FILTER ({a} AND {b})::DOUBLE / nullif(count(*) FILTER ({a} OR {b}), 0), 0) AS jaccard FROM snap GROUP BY 1" for i, a in enumerate(segments.RULES) for b in segments.RULES[i + 1 :]), "jaccard")
def rule_overlap(spark, sf):
    return segments.rule_overlap(segments.snapshot(panel(spark, sf), windows(spark)))


def _eta_sql(source: str, cat: str, value: str, by: str = "", constant: str = "NULL") -> str:
    """groups, rows and eta squared of a value by a category."""
    comma = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT {comma}count(DISTINCT c) AS groups, count(*) AS rows, CASE WHEN sum((v - m) ** 2) > 1e-12 THEN sum((g - m) ** 2) / sum((v - m) ** 2) ELSE {constant} END AS eta_squared FROM (
      SELECT {comma}c, v, avg(v) OVER ({part}) AS m, avg(v) OVER (PARTITION BY {comma}c) AS g FROM (SELECT {comma}{cat} AS c, ({value})::DOUBLE AS v FROM {source} WHERE {cat} IS NOT NULL AND {value} IS NOT NULL)) {group}"""


@query(f"{_SNAP} " + " UNION ALL ".join(f"SELECT id, 'segment' AS method, '{t}' AS target, groups, rows, eta_squared FROM ({_eta_sql('snap', 'segment', f'ln(1 + {t})', 'id', '0.0')})" for t in ("future_purchase", "future_redeem", "future_consume", "future_transfer")), "eta_squared")
def predictive_strength(spark, sf):
    return segments.predictive_strength(segments.snapshot(panel(spark, sf), windows(spark)), ["segment"])


_PAIRS = f"""{_SNAP}, o AS (SELECT id, lead(id) OVER (ORDER BY "start") AS next_id FROM windows), pairs AS (SELECT o.id, o.next_id, x.segment AS a, y.segment AS b FROM o JOIN snap x ON x.id = o.id JOIN snap y ON y.id = o.next_id AND y.user_id = x.user_id),
  cells AS (SELECT id, next_id, a, b, count(*)::DOUBLE AS n FROM pairs GROUP BY ALL), s AS (SELECT id, next_id, sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM cells GROUP BY ALL), r AS (SELECT id, sum(n * (n - 1) / 2) AS r FROM (SELECT id, a, sum(n) AS n FROM cells GROUP BY ALL) GROUP BY 1),
  k AS (SELECT id, sum(n * (n - 1) / 2) AS c FROM (SELECT id, b, sum(n) AS n FROM cells GROUP BY ALL) GROUP BY 1)"""
@query(f"""{_PAIRS} SELECT id, next_id, count(*) AS common_users, avg((a = b)::INT) AS unchanged_share, any_value(coalesce((s - r * c / nullif(s.n * (s.n - 1) / 2, 0)) / nullif((r + c) / 2 - r * c / nullif(s.n * (s.n - 1) / 2, 0), 0), 1.0)) AS adjusted_rand
  FROM pairs JOIN s USING (id, next_id) JOIN r USING (id) JOIN k USING (id) GROUP BY 1, 2""", "unchanged_share adjusted_rand")
def label_stability(spark, sf):
    return segments.stability(segments.snapshot(panel(spark, sf), windows(spark)))


@query(f"{_SNAP} SELECT segment, frequent_large_roundtrip AS roundtrip, count(*) AS users FROM snap WHERE id = 'w3' GROUP BY ALL")
def contingency(spark, sf):
    s = segments.snapshot(panel(spark, sf), windows(spark)).where("id = 'w3'")
    return s.groupBy("segment", F.col("frequent_large_roundtrip").alias("roundtrip")).agg(F.count("*").alias("users"))


_TOTALS = "um AS (SELECT user_id, sum(total_purchase_amt)::DOUBLE AS purchase, sum(consume_amt)::DOUBLE AS consume, sex, city, constellation FROM panel JOIN profile USING (user_id) GROUP BY ALL)"


def _totals(spark, sf):
    users = panel(spark, sf).groupBy("user_id").agg(F.sum("total_purchase_amt").cast("double").alias("purchase"), F.sum("consume_amt").cast("double").alias("consume"))
    return joins.join_checked(users, profile(spark, sf), ["user_id"], "inner", "one_to_one")


@query(f"{PP}, {_TOTALS}, l AS (SELECT constellation AS \"group\", 'purchase' AS target, purchase AS v FROM um UNION ALL SELECT constellation, 'consume', consume FROM um) SELECT 'constellation' AS category, \"group\", target, count(*) AS users, avg(v) AS mean, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.9) AS p90, avg((v > 0)::INT) AS positive_rate FROM l GROUP BY 2, 3", "mean median p90 positive_rate")
def group_profile(spark, sf):
    return association.group_profile(_totals(spark, sf), "constellation", ["purchase", "consume"])


_LABEL = "CASE WHEN eta_squared IS NULL THEN 'unknown' WHEN eta_squared < 0.001 THEN 'negligible' WHEN eta_squared < 0.01 THEN 'weak' WHEN eta_squared < 0.06 THEN 'small' WHEN eta_squared < 0.14 THEN 'moderate' ELSE 'large' END AS effect"
@query(f"{PP}, {_TOTALS}, e AS (" + " UNION ALL ".join(f"SELECT '{c}' AS category, '{t}' AS target, * FROM ({_eta_sql('um', c, t)})" for c in ("sex", "city", "constellation") for t in ("purchase", "consume")) + f") SELECT *, {_LABEL} FROM e", "eta_squared")
def demographic_effects(spark, sf):
    users = _totals(spark, sf).cache()
    out = None
    for c in ("sex", "city", "constellation"):
        for t in ("purchase", "consume"):
            part = association.eta_squared(users, c, t).select(F.lit(c).alias("category"), F.lit(t).alias("target"), "groups", "rows", "eta_squared", "effect")
            out = part if out is None else out.unionByName(part)
    return out


_METRICS = f"""um2 AS (SELECT m.*, sex::VARCHAR AS sex, city::VARCHAR AS city, constellation FROM (SELECT user_id, target, sum(v)::DOUBLE / (date_diff('day', min(report_date), max(last)) + 1) AS per_day, count(*) FILTER (v > 0)::DOUBLE / (date_diff('day', min(report_date), max(last)) + 1) AS rate,
  coalesce(sum(v)::DOUBLE / nullif(count(*) FILTER (v > 0), 0), 0) AS positive FROM (SELECT user_id, report_date, target, v FROM (SELECT user_id, report_date, {", ".join(f"coalesce({t}, 0) AS {t}" for t in ops.TARGETS)} FROM panel) UNPIVOT (v FOR target IN ({", ".join(ops.TARGETS)}))), (SELECT max(report_date) AS last FROM panel) GROUP BY 1, 2) m JOIN profile USING (user_id))"""
_VALUES = {"log1p_amount_per_exposure_day": "ln(1 + per_day)", "active_day_rate": "rate", "log1p_positive_day_amount": "ln(1 + positive)"}
_DEMO = ("sex", "city", "constellation")
_CROSSES = (("sex", "city"), ("sex", "constellation"), ("city", "constellation"), ("sex", "city", "constellation"))
@query(f"{PP}, {_METRICS}, e AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, target, '{n}' AS metric, groups, rows, eta_squared FROM ({_eta_sql('um2', f, v, 'target')})" for f in _DEMO for n, v in _VALUES.items()) + f") SELECT *, {_LABEL} FROM e", "eta_squared")
def demographic_grid(spark, sf):
    values = {"log1p_amount_per_exposure_day": F.log1p("per_exposure_day"), "active_day_rate": F.col("active_day_rate"), "log1p_positive_day_amount": F.log1p("positive_day_mean")}
    return association.demographic_grid(ops.user_metrics(panel(spark, sf)), profile(spark, sf), _DEMO, values)


@query(f"{PP}, {_METRICS}, k AS (" + " UNION ALL ".join(f"SELECT '{'_x_'.join(c)}' AS feature, target, per_day, {' || chr(124) || '.join(c)} AS g, count(*) OVER (PARTITION BY target, {', '.join(c)}) AS n FROM um2" for c in _CROSSES) + f"""), z AS (SELECT feature, target, per_day, CASE WHEN n < 50 THEN '__SMALL_GROUP__' ELSE g END AS g FROM k),
e AS ({_eta_sql("z", "g", "ln(1 + per_day)", "feature, target")}), r AS (SELECT feature, count(DISTINCT g) AS raw_groups FROM k GROUP BY 1) SELECT e.*, raw_groups, {_LABEL} FROM e JOIN r USING (feature)""", "eta_squared")
def crossed_effects(spark, sf):
    return association.crossed_grid(ops.user_metrics(panel(spark, sf)), profile(spark, sf), _CROSSES, F.log1p("per_exposure_day"))


@query(f"""{PP}, {_TOTALS}, j AS (SELECT *, sex::VARCHAR || '|' || constellation AS k FROM um), z AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY k) < 15 THEN '__SMALL_GROUP__' ELSE k END AS pooled FROM j)
SELECT pooled, count(*) AS users, sum(purchase)::BIGINT AS purchase FROM z GROUP BY 1""")
def pooled_groups(spark, sf):
    z = association.pooled(_totals(spark, sf), ["sex", "constellation"], "pooled", least=15)
    return z.groupBy("pooled").agg(F.count("*").alias("users"), F.sum("purchase").cast("bigint").alias("purchase"))


@query(f"""{PP}, {_TOTALS} SELECT user_id, CASE WHEN sex = 0 THEN 'a' WHEN sex = 1 THEN 'b' ELSE '-' END AS sex_label, CASE WHEN purchase < 10000 THEN 'low' WHEN purchase < 50000 THEN 'mid' ELSE 'high' END AS band, purchase > 0 AS has_purchase, ln(1 + purchase) AS purchase_log1p,
  least(purchase, consume) AS smaller, greatest(purchase, consume) AS larger, least(purchase, 50000) AS clipped, CAST(round_even(purchase / 8, 0) AS BIGINT) AS eighth FROM um""", "purchase_log1p smaller larger clipped")
def row_expressions(spark, sf):
    from ..functions import clip, half_even

    u = _totals(spark, sf)
    return u.select(
        "user_id", looked_up(F.col("sex").cast("int"), {0: "a", 1: "b"}, "-").alias("sex_label"), banded("purchase", ((10000, "low"), (50000, "mid")), "high", "unknown").alias("band"), positive("purchase").alias("has_purchase"),
        log1p("purchase").alias("purchase_log1p"), F.least("purchase", "consume").alias("smaller"), F.greatest("purchase", "consume").alias("larger"), clip("purchase", high=50000.0).alias("clipped"), half_even(F.col("purchase") / 8).alias("eighth"),
    )


@query(f"""{PP}, u AS (SELECT DISTINCT user_id FROM panel) SELECT user_id, 'left' AS missing_in FROM profile ANTI JOIN u USING (user_id) UNION ALL SELECT user_id, 'right' FROM u ANTI JOIN profile USING (user_id)""")
def set_gaps(spark, sf):
    return joins.set_gaps(panel(spark, sf), profile(spark, sf), ["user_id"])


@query(f"{PP} SELECT DISTINCT user_id FROM panel SEMI JOIN profile USING (user_id) WHERE report_date BETWEEN DATE '2024-05-30' AND DATE '2024-06-28' AND user_id IN (SELECT user_id FROM panel WHERE report_date < DATE '2024-05-30')")
def known_future_users(spark, sf):
    p = panel(spark, sf)
    past, ahead = p.where("report_date < DATE '2024-05-30'"), p.where("report_date BETWEEN DATE '2024-05-30' AND DATE '2024-06-28'")
    return ahead.select("user_id").distinct().join(past, "user_id", "left_semi").join(profile(spark, sf), "user_id", "left_semi")


@query(f"{P} SELECT report_date, count(*) AS n FROM panel GROUP BY 1 HAVING count(*) > 1")
def duplicated_days(spark, sf):
    return joins.duplicated(panel(spark, sf), ["report_date"])


_T = ops.TARGETS
def _type_sql(a, b):
    if tuple(sorted((a, b))) in {tuple(sorted(p)) for p in association.MECHANICAL}:
        return "mechanical_component_relationship"
    return "balance_behavior_relationship" if {a, b} & set(association.STOCKS) else "behavioral_flow_relationship"
_RANK = lambda t: f"rank() OVER (ORDER BY {t}) + (count(*) OVER (PARTITION BY {t}) - 1) / 2.0"
@query(f"""{P}, d AS (SELECT report_date, {', '.join(f'sum(coalesce({t}, 0))::DOUBLE AS {t}' for t in _T)} FROM panel GROUP BY 1), r AS (SELECT report_date, {', '.join(f'{_RANK(t)} AS r_{t}, {t}' for t in _T)} FROM d),
u AS (SELECT user_id, {', '.join(f"sum(coalesce({t}, 0))::DOUBLE / (date_diff('day', min(report_date), (SELECT max(report_date) FROM panel)) + 1) AS {t}" for t in _T)} FROM panel GROUP BY 1), ur AS (SELECT {', '.join(f'{_RANK(t)} AS u_{t}' for t in _T)} FROM u), z AS (""" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS pairs, corr({a}, {b}) AS pearson, corr(r_{a}, r_{b}) AS spearman, corr(ln(1 + {a}), ln(1 + {b})) AS log_pearson, (SELECT corr(u_{a}, u_{b}) FROM ur) AS user_spearman, '{_type_sql(a, b)}' AS pair_type FROM r" for i, a in enumerate(_T) for b in _T[i + 1 :]) + """)
SELECT *, greatest(abs(spearman), abs(log_pearson), abs(user_spearman)) AS max_abs_correlation FROM z""", "pearson spearman log_pearson user_spearman max_abs_correlation")
def target_associations(spark, sf):
    days = panel(spark, sf).groupBy("report_date").agg(*[F.sum(F.coalesce(t, F.lit(0))).alias(t) for t in _T])
    stats = association.pair_statistics(association.long_pairs(days, _T, _T, [], triangular=True)).withColumn("pair_type", association.pair_type("a", "b"))
    logs = association.pair_statistics(association.long_pairs(days.select(*[F.log1p(t).alias(t) for t in _T]), _T, _T, [], triangular=True)).select("a", "b", F.col("pearson").alias("log_pearson"))
    users = association.user_spearman(ops.user_metrics(panel(spark, sf)), "per_exposure_day")
    out = stats.join(logs, ["a", "b"]).join(users, ["a", "b"])
    return out.withColumn("max_abs_correlation", F.greatest(F.abs("spearman"), F.abs("log_pearson"), F.abs("user_spearman")))


_BAD = lambda e: f"count(*) FILTER ({e})"
#: What the tables are to be; the profile's city is wanted as text, which it isn't.
_TYPES = {"user_id": "bigint", "report_date": "date"} | dict.fromkeys(_AMOUNTS, "bigint")
_SQL_TYPES = {"bigint": "BIGINT", "date": "DATE", "tinyint": "TINYINT", "string": "VARCHAR", "double": "DOUBLE"}
_PROFILE_TYPES = {"user_id": "bigint", "sex": "tinyint", "city": "string", "constellation": "string"}
_RATE_TYPES = {"report_date": "date", "rate_1d": "double", "rate_7d": "double"}
_WRONG = lambda name, kinds: "(SELECT " + " + ".join(f"(typeof(any_value({c})) <> '{_SQL_TYPES[t]}')::INT" for c, t in kinds.items()) + f" FROM {name})"
_SUMMED = f"""domains AS (SELECT unnest([(SELECT {_BAD("user_id <= 0")} FROM panel), (SELECT {" + ".join(_BAD(f"{a} < 0") for a in _AMOUNTS)} FROM panel), (SELECT {_BAD("sex NOT IN (0, 1)")} FROM profile), (SELECT (count(DISTINCT city) <> 25)::BIGINT FROM profile), (SELECT (count(DISTINCT constellation) <> 5)::BIGINT FROM profile),
  (SELECT {_BAD("rate_1d <= 0")} + {_BAD("rate_7d <= 0")} FROM rates)]) AS n), lagged AS (SELECT yBalance - lag(tBalance) OVER w AS d, date_diff('day', lag(report_date) OVER w, report_date) AS gap FROM panel WINDOW w AS (PARTITION BY user_id ORDER BY report_date)),
nulls AS (SELECT consume_amt, (category1 IS NULL)::INT + (category2 IS NULL)::INT + (category3 IS NULL)::INT + (category4 IS NULL)::INT AS n FROM panel), keyed AS (SELECT count(*) AS c, user_id IS NULL OR report_date IS NULL AS z FROM panel GROUP BY user_id, report_date UNION ALL SELECT count(*), user_id IS NULL FROM profile GROUP BY user_id UNION ALL SELECT count(*), report_date IS NULL FROM rates GROUP BY report_date),
cal AS (SELECT CAST(unnest({CALENDAR_SQL}) AS DATE) + 2556 AS report_date), gaps AS (SELECT unnest([{_GAP("panel", "profile", "user_id")}, {_GAP("profile", "panel", "user_id")}, {_GAP("panel", "cal", "report_date")}, {_GAP("cal", "panel", "report_date")}, {_GAP("panel", "cal", "report_date")}]) AS n),
joined AS (SELECT count(*) FILTER (f.user_id IS NULL) AS lost FROM panel p LEFT JOIN profile f USING (user_id)), byday AS (SELECT report_date, sum(total_purchase_amt)::DOUBLE AS purchase, sum(total_redeem_amt)::DOUBLE AS redeem FROM panel GROUP BY 1),
long AS (SELECT report_date, isodow(report_date) - 1 AS weekday, 'purchase' AS metric, purchase AS value FROM byday UNION ALL SELECT report_date, isodow(report_date) - 1, 'redeem', redeem FROM byday), {_robust("long", "t1", "trailing", "metric", 28, 14)}, {_robust("t1", "t2", "weekday", "metric, weekday", 8, 4)},
odd AS (SELECT coalesce(greatest(abs(value - trailing_median) / nullif(1.4826 * trailing_mad, 0), abs(value - weekday_median) / nullif(1.4826 * weekday_mad, 0)) > 6, false) AS is_anomaly FROM t2), {_USERS},
top AS ({" UNION ".join(f"(SELECT user_id FROM u ORDER BY {m} DESC, user_id LIMIT 50)" for m in ops.EXTREME_METRICS)}), drift AS (SELECT count(*) FILTER (a <> b) AS n FROM (SELECT unnest([(SELECT sum(total_purchase_amt) FROM panel), (SELECT sum(total_redeem_amt) FROM panel)]) AS a, unnest([(SELECT sum(purchase_bal_amt) + sum(purchase_bank_amt) FROM panel), (SELECT sum(consume_amt) + sum(transfer_amt) FROM panel)]) AS b)),
v AS (SELECT unnest({list(audits.CHECKS)!r}) AS check_id, unnest({[d for d, _ in audits.CHECKS.values()]!r}) AS dimension, unnest({[x for _, x in audits.CHECKS.values()]!r}) AS severity_if_failed, unnest([
  {{'m': {_WRONG("panel", _TYPES)} + {_WRONG("profile", _PROFILE_TYPES)} + {_WRONG("rates", _RATE_TYPES)}, 'x': {_WRONG("panel", _TYPES)} + {_WRONG("profile", _PROFILE_TYPES)} + {_WRONG("rates", _RATE_TYPES)}}},
  {{'m': (SELECT sum(n) FROM domains), 'x': (SELECT sum(n) FROM domains)}}, {{'m': (SELECT coalesce(sum(c) FILTER (c > 1), 0) FROM keyed), 'x': (SELECT coalesce(sum(c) FILTER (c > 1), 0) + coalesce(sum(c) FILTER (z), 0) FROM keyed)}},
  {{'m': (SELECT count(*) FILTER (n = 4) FROM nulls), 'x': (SELECT count(*) FILTER (n BETWEEN 1 AND 3) + count(*) FILTER ((n = 4) <> (consume_amt = 0)) FROM nulls)}}, {{'m': (SELECT {" + ".join(_BAD(f"{a} < 0") for a in _AMOUNTS)} FROM panel), 'x': (SELECT {" + ".join(_BAD(f"{a} < 0") for a in _AMOUNTS)} FROM panel)}},
  {{'m': (SELECT {" + ".join(_BAD(f"({a}) <> ({b})") for _, a, b in audits.IDENTITIES)} FROM panel), 'x': (SELECT {" + ".join(_BAD(f"({a}) <> ({b})") for _, a, b in audits.IDENTITIES)} FROM panel)}},
  {{'m': (SELECT count(*) FILTER (d <> 0 AND gap IS NOT NULL) + count(*) FILTER (d <> 0 AND gap = 1) FROM lagged), 'x': (SELECT count(*) FILTER (d <> 0 AND gap IS NOT NULL) + count(*) FILTER (d <> 0 AND gap = 1) FROM lagged)}},
  {{'m': (SELECT count(*) FROM byday), 'x': (SELECT date_diff('day', min(report_date), max(report_date)) + 1 - count(*) FROM byday)}}, {{'m': (SELECT count(*) FILTER (is_anomaly) FROM odd), 'x': (SELECT count(*) FILTER (is_anomaly) FROM odd)}},
  {{'m': (SELECT count(*) FROM top), 'x': (SELECT count(*) FROM top)}}, {{'m': (SELECT sum(n) FROM gaps) + (SELECT lost FROM joined), 'x': (SELECT sum(n) FROM gaps) + (SELECT lost FROM joined)}},
  {{'m': (SELECT count(*) FILTER (status = 'FAIL') FROM leaks), 'x': (SELECT count(*) FILTER (status = 'FAIL') FROM leaks)}}, {{'m': (SELECT n FROM drift), 'x': (SELECT n FROM drift)}}]::STRUCT(m BIGINT, x BIGINT)[]) AS f)"""
@query(f"""{PP}, {RATES_SQL}, {_LEAK_SQL}, {_SUMMED} SELECT check_id, dimension, severity_if_failed, f.m AS metric_value, f.x AS violations, CASE WHEN f.x = 0 THEN 'PASS' WHEN check_id IN {audits.SOFT!r} THEN 'REVIEW' ELSE 'FAIL' END AS status FROM v""")
def audit_summary(spark, sf):
    p, prof, r = panel(spark, sf), profile(spark, sf), rates(spark, sf)
    twice = lambda df, c: df.select(F.col(c).alias("m"), F.col(c).alias("x"))
    failed = lambda df, bad="FAIL": twice(df.agg(F.count_if(F.col("status") == bad).alias("n")), "n")
    types = reduce(DataFrame.unionByName, [audits.type_audit(df, kinds) for df, kinds in ((p, _TYPES), (prof, _PROFILE_TYPES), (r, _RATE_TYPES))])
    keys = reduce(DataFrame.unionByName, [audits.key_audit(df, k, n) for df, k, n in ((p, ["user_id", "report_date"], "panel"), (prof, ["user_id"], "profile"), (r, ["report_date"], "rates"))])
    days = p.groupBy("report_date").agg(F.sum("total_purchase_amt").alias("purchase"), F.sum("total_redeem_amt").alias("redeem"))
    odd = series.anomalies(days, ("purchase", "redeem")).agg(F.count_if("is_anomaly").alias("n"))
    cal = joins.calendar(r, "report_date", *SERIES)
    gaps = audits.coverage(p, prof, _dated(spark, cal), _dated(spark, r), _dated(spark, cal)).where("status = 'FAIL'").agg(F.sum("count").alias("n"))
    leaky = windows(spark, _LEAKY)
    parts = p.agg(F.count("*").alias("rows"), F.sum(F.col("purchase_bal_amt") + F.col("purchase_bank_amt")).alias("total_purchase_amt"), F.sum(F.col("consume_amt") + F.col("transfer_amt")).alias("total_redeem_amt"))
    whole = p.agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in ("total_purchase_amt", "total_redeem_amt")])
    return audits.audit_summary({
        "types": failed(types), "domain_constraints": twice(audits.business_domains(p, prof, r, cities=25, signs=5).agg(F.sum("violation_count").alias("n")), "n"),
        "primary_keys": keys.agg(F.sum("duplicate_rows").alias("m"), (F.sum("duplicate_rows") + F.sum("null_key_rows")).alias("x")),
        "structural_nulls": audits.structural_nulls(p).select("all_null_rows", (F.col("partial_null_rows") + F.col("disagreeing_rows")).alias("x")),
        "negative_amounts": twice(p.agg(reduce(lambda a, b: a + b, [F.count_if(F.col(c) < 0) for c in _AMOUNTS]).alias("n")), "n"), "additive_relationships": twice(audits.identity_audit(p).agg(F.sum("mismatches").alias("n")), "n"),
        "balance_continuity": twice(ops.continuity(p).agg(F.sum("mismatches").alias("n")), "n"), "calendar": days.agg(F.count("*").alias("m"), (F.datediff(F.max("report_date"), F.min("report_date")) + 1 - F.count("*")).alias("x")),
        "anomalous_dates": twice(odd, "n"), "extreme_users": twice(ops.extreme_users(p).agg(F.count("*").alias("n")), "n"), "cross_table_coverage": twice(gaps, "n"),
        "time_leakage": failed(audits.leakage_audit(segments.periods(p, leaky).select("id", "user_id", "rows_life", "last_seen_life"), p, leaky)),
        "derived_reconciliation": failed(audits.reconcile_totals(whole, parts, ["total_purchase_amt", "total_redeem_amt"])),
    })


def _clustered(spark, sf):
    from ..operators import clustering

    users = segments.snapshot(panel(spark, sf), windows(spark)).where("id = 'w3'").persist()  # read by the scale, the fits, the labels and every measure
    scaled = clustering.robust_scale(clustering.inputs(clustering.eligible(users)).select("user_id", *clustering.INPUTS), clustering.INPUTS)
    table, labels, _ = clustering.fit_grid(scaled)
    return users, table, labels


@query(None)
def user_clusters(spark, sf):
    from ..operators import clustering

    users, _, labels = _clustered(spark, sf)
    return clustering.hybrid(users, labels).select("user_id", "segment", "auto_cluster", "hybrid_segment")


@query(None)
def cluster_grid(spark, sf):
    """The metrics of every k."""
    return _clustered(spark, sf)[1]


@query(None)
def cluster_strength(spark, sf):
    """Eta squared of the rule, cluster and hybrid labels for each outcome."""
    from ..operators import clustering

    users, _, labels = _clustered(spark, sf)
    return segments.predictive_strength(clustering.hybrid(users, labels), ["segment", "auto_cluster", "hybrid_segment"])


_MEDIANS = ("end_balance_life", "direct_90", "redeem_90", "tenure_days", "active_recency", "future_purchase")
@query(f"{_SNAP} SELECT segment, count(*) AS users, {', '.join(f'quantile_cont({c}, 0.5) AS median_{c}' for c in _MEDIANS)} FROM snap WHERE id = 'w3' GROUP BY 1", " ".join(f"median_{c}" for c in _MEDIANS))
def label_medians(spark, sf):
    from ..operators import clustering

    users = segments.snapshot(panel(spark, sf), windows(spark)).where("id = 'w3'")
    return clustering.cluster_profile(users, _MEDIANS, "segment")


_SCALED = ("active_recency", "active_days_per_30", "roundtrip_90", "net_flow_share_90", "consume_share_90", "balance_cv")
@query(f"""{_SNAP} SELECT "column", quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, stddev_pop(v) AS deviation, CASE WHEN quantile_cont(v, 0.75) - quantile_cont(v, 0.25) > 0 THEN quantile_cont(v, 0.75) - quantile_cont(v, 0.25) WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1.0 END AS scale
  FROM ({" UNION ALL ".join(f"SELECT '{c}' AS column, {c}::DOUBLE AS v FROM snap WHERE id = 'w3'" for c in _SCALED)}) GROUP BY 1""", "median iqr deviation scale")
def robust_scales(spark, sf):
    from ..operators import clustering

    return clustering.scale_table(segments.snapshot(panel(spark, sf), windows(spark)).where("id = 'w3'"), _SCALED)



# The catalogue in SQL, written from its rules: families as joins of names with lags and sizes.
_CATALOG = """WITH demo AS (SELECT * FROM (VALUES (1, 'sex'), (2, 'city'), (3, 'constellation')) x(i, n)), rate AS (SELECT unnest(['mfd_daily_yield', 'mfd_7daily_yield'] || ['Interest_' || x FOR x IN ['O_N', '1_W', '2_W', '1_M', '3_M', '6_M', '9_M', '1_Y']]) AS n),
target AS (SELECT unnest(['total_purchase_amt', 'total_redeem_amt', 'direct_purchase_amt', 'purchase_bank_amt', 'transfer_amt']) AS n),
pair AS (SELECT * FROM (VALUES ('mfd_7daily_yield', 'Interest_O_N'), ('mfd_7daily_yield', 'Interest_1_W'), ('mfd_7daily_yield', 'Interest_1_M'), ('mfd_7daily_yield', 'Interest_3_M'), ('Interest_1_Y', 'Interest_O_N'), ('Interest_3_M', 'Interest_O_N'), ('Interest_1_M', 'Interest_1_W')) x(a, b)),
part AS (SELECT * FROM (VALUES ('bank_purchase_share', 'purchase_bank_amt', 'direct_purchase_amt'), ('balance_purchase_share', 'purchase_bal_amt', 'direct_purchase_amt'), ('share_purchase_share', 'share_amt', 'total_purchase_amt'), ('transfer_redeem_share', 'transfer_amt', 'total_redeem_amt'),
  ('consume_redeem_share', 'consume_amt', 'total_redeem_amt'), ('transfer_to_card_share', 'tftocard_amt', 'transfer_amt'), ('transfer_to_balance_share', 'tftobal_amt', 'transfer_amt')) x(n, a, b)),
catalog AS (SELECT 'P0' AS priority, 'raw_demographic' AS family, n AS feature_name, n AS formula, 'user' AS grain FROM demo
UNION ALL SELECT 'P0', 'demographic_cross', a.n || '_x_' || b.n, a.n || ' + ' || b.n, 'user' FROM demo a JOIN demo b ON a.i < b.i
UNION ALL SELECT 'P1', 'demographic_cross', string_agg(n, '_x_' ORDER BY i), string_agg(n, ' + ' ORDER BY i), 'user' FROM demo
UNION ALL SELECT 'P0', 'rate_lag', n || '_lag' || k, 'lag(' || n || ', ' || k || ')', 'date' FROM rate, (SELECT unnest([1, 7]) AS k)
UNION ALL SELECT 'P0', 'rate_change', n || '_delta' || k || '_lag1', 'lag(' || n || ' - lag(' || n || ',' || k || '), 1)', 'date' FROM rate, (SELECT unnest([1, 7]) AS k)
UNION ALL SELECT 'P1', 'rate_rolling', n || '_mean' || k, 'rolling_mean(lag(' || n || ',1), ' || k || ')', 'date' FROM rate, (SELECT unnest([7, 14, 28]) AS k)
UNION ALL SELECT 'P1', 'rate_volatility', n || '_std' || k, 'rolling_std(lag(' || n || ',1), ' || k || ')', 'date' FROM rate, (SELECT unnest([7, 28]) AS k)
UNION ALL SELECT 'P0', 'rate_spread_curve', 'spread_' || a || '_less_' || b, 'lag(' || a || ' - ' || b || ', 1)', 'date' FROM pair
UNION ALL SELECT 'P0', 'rate_spread_curve', 'bend_Interest_3_M', 'lag(2 * Interest_3_M - Interest_O_N - Interest_1_Y, 1)', 'date'
UNION ALL SELECT 'P0', 'target_history', n || '_lag' || k, 'lag(daily_sum(' || n || '), ' || k || ')', 'date' FROM target, (SELECT unnest([1, 7, 14, 28]) AS k)
UNION ALL SELECT 'P0', 'target_history', n || '_rolling_mean' || k, 'rolling_mean(lag(daily_sum(' || n || '),1), ' || k || ')', 'date' FROM target, (SELECT unnest([7, 14, 28]) AS k)
UNION ALL SELECT 'P0', 'behavior_composition', n || '_lag1', 'lag(daily(' || a || ' / ' || b || '), 1)', 'date' FROM part
UNION ALL SELECT 'P0', 'behavior_composition', 'net_flow_lag1', 'lag(daily(total_purchase_amt - total_redeem_amt), 1)', 'date'
UNION ALL SELECT 'P1', 'segment_history', d.n || '_' || t.n || '_rolling7', 'rolling_mean(lag(daily_sum(' || t.n || ') by ' || d.n || ',1),7)', 'date x segment' FROM demo d, target t
UNION ALL SELECT 'P1', 'cross_domain_interaction', unnest(['rate_spread_x_bank_share', 'rate_change_x_transfer_share', 'weekday_x_rate_spread', 'new_user_share_x_rate']), unnest(['spread_mfd_7daily_yield_less_Interest_1_W_lag1 * bank_purchase_share_lag1',
  'delta7(mfd_7daily_yield)_lag1 * transfer_redeem_share_lag1', 'weekday * spread_mfd_7daily_yield_less_Interest_1_W_lag1', 'new_user_share_lag1 * mfd_7daily_yield_lag1']), 'date'
UNION ALL SELECT 'P2_NOT_NOW', 'defer_or_reject', unnest(['all_pairwise_polynomials', 'high_cardinality_user_id_cross', 'full_period_target_encoding', 'same_day_component_ratios']),
  unnest(['every numeric pair and square', 'user_id x demographic x rate', 'category mean target on all dates', 'ratios built from forecast-day outcomes']), 'mixed')"""


@query(f"{_CATALOG} SELECT * FROM catalog")
def feature_catalog(spark, sf):
    return features.catalog(spark).drop("rationale", "leakage_rule")


@query(f"{_CATALOG} SELECT priority, family, count(*)::INTEGER AS features FROM catalog GROUP BY 1, 2")
def feature_catalog_counts(spark, sf):
    return features.catalog(spark).groupBy("priority", "family").agg(F.count("*").cast("int").alias("features"))


@query(f"""{PP}, d AS (SELECT constellation, report_date, sum(total_purchase_amt)::BIGINT AS total FROM panel JOIN profile USING (user_id) GROUP BY 1, 2)
SELECT *, CASE WHEN count(*) OVER w = 7 THEN avg(total) OVER w END AS constellation_total_purchase_amt_rolling7 FROM d WINDOW w AS (PARTITION BY constellation ORDER BY report_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""", "constellation_total_purchase_amt_rolling7")
def segment_history(spark, sf):
    return features.segment_history(panel(spark, sf), profile(spark, sf), "constellation", "total_purchase_amt")


@query(f"""{P}, d AS (SELECT report_date, sum(purchase_bank_amt)::DOUBLE AS bank, sum(direct_purchase_amt) AS direct, sum(transfer_amt)::DOUBLE AS transfer, sum(total_redeem_amt) AS redeem FROM panel GROUP BY 1)
SELECT report_date, lag(bank / nullif(direct, 0)) OVER w AS bank_share_lag1, lag(transfer / nullif(redeem, 0)) OVER w AS transfer_share_lag1 FROM d WINDOW w AS (ORDER BY report_date)""", "bank_share_lag1 transfer_share_lag1")
def composition_history(spark, sf):
    d = panel(spark, sf).groupBy("report_date").agg(*[F.sum(c).alias(n) for n, c in (("bank", "purchase_bank_amt"), ("direct", "direct_purchase_amt"), ("transfer", "transfer_amt"), ("redeem", "total_redeem_amt"))])
    return features.composition_features(d, {"bank_share": ("bank", "direct"), "transfer_share": ("transfer", "redeem")}).select("report_date", "bank_share_lag1", "transfer_share_lag1")
