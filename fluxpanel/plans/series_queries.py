"""Queries over the daily series: windows, periodicity, associations, forecasts and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import daily_score, month_features, relative_error, score_curve
from ..operators import association, audits, clustering, features, forecast, joins, series
from ..sources.tables import BACKTESTS, DAILY_SQL, RATES_SQL, SERIES, SERIES_SQL, SERIES_WINDOWS, daily, rates, table, windows, windows_sql
from .registry import query

D = f"WITH {DAILY_SQL}"
DW = f"WITH {DAILY_SQL}, {windows_sql(SERIES_WINDOWS)}"
DR = f"WITH {DAILY_SQL}, {RATES_SQL}"
OVER = "OVER (ORDER BY report_date)"
BOTH = ("purchase", "redeem")


@query(f"{D} SELECT * FROM daily")
def daily_series(spark, sf):
    return daily(spark, sf)


@query(f"{DR} SELECT report_date FROM calendar ANTI JOIN rates USING (report_date)")
def missing_rate_days(spark, sf):
    return joins.missing_days(rates(spark, sf), "report_date", *SERIES)


_FILLED = f"""{DR}, filled AS (SELECT report_date, last_value(rate_1d IGNORE NULLS) OVER w AS rate_1d, last_value(rate_7d IGNORE NULLS) OVER w AS rate_7d, rate_1d IS NOT NULL OR rate_7d IS NOT NULL AS is_observed,
  CAST(date_diff('day', max(CASE WHEN rate_1d IS NOT NULL OR rate_7d IS NOT NULL THEN report_date END) OVER w, report_date) AS SMALLINT) AS days_since_observation
  FROM calendar LEFT JOIN rates USING (report_date) WINDOW w AS (ORDER BY report_date ROWS UNBOUNDED PRECEDING))"""
@query(f"{_FILLED} SELECT * FROM filled", "rate_1d rate_7d")
def rates_filled(spark, sf):
    return joins.forward_fill(joins.densify(rates(spark, sf), "report_date", *SERIES), "report_date", ["rate_1d", "rate_7d"])


@query(f"""{D} SELECT report_date, {", ".join(f"lag({c}, {n}) {OVER} AS {c}_lag{n}, {c} - lag({c}, {n}) {OVER} AS {c}_diff{n}" for c in BOTH for n in (1, 7))}, {", ".join(f"lag({c}, 1) {OVER} - lag({c}, 2) {OVER} AS {c}_diff1_lag1" for c in BOTH)} FROM daily""")
def lags_and_diffs(spark, sf):
    return series.lags(daily(spark, sf), BOTH, (1, 7)).drop("direct", "transfer", "consume", "share", *BOTH)


_ROLL = [(k, n, f) for k, sizes, f in (("mean", (7, 14, 28), "avg"), ("std", (7, 28), "stddev_samp")) for n in sizes]
@query(f"""{D} SELECT report_date, {", ".join(f"CASE WHEN count(purchase) OVER (ORDER BY report_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} THEN {f}(purchase) OVER (ORDER BY report_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) / 1e6 END AS purchase_{k}{n}" for k, n, f in _ROLL)} FROM daily""", " ".join(f"purchase_{k}{n}" for k, n, _ in _ROLL))
def lagged_rolling(spark, sf):
    d = series.lagged_rolling(daily(spark, sf), ["purchase"])
    return d.select("report_date", *[(F.col(f"purchase_{k}{n}") / 1e6).alias(f"purchase_{k}{n}") for k, n, _ in _ROLL])


_LR = lambda k, n: f"CASE WHEN count(rate_1d) OVER (ORDER BY report_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} THEN {k}(rate_1d) OVER (ORDER BY report_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"
_RF = ("rate_1d_lag1", "rate_1d_lag7", "rate_1d_delta1_lag1", "rate_1d_delta7_lag1", "spread", "rate_1d_mean7", "rate_1d_mean14", "rate_1d_mean28", "rate_1d_std7", "rate_1d_std28")
@query(f"""{_FILLED} SELECT report_date, lag(rate_1d, 1) {OVER} AS rate_1d_lag1, lag(rate_1d, 7) {OVER} AS rate_1d_lag7, lag(rate_1d, 1) {OVER} - lag(rate_1d, 2) {OVER} AS rate_1d_delta1_lag1, lag(rate_1d, 1) {OVER} - lag(rate_1d, 8) {OVER} AS rate_1d_delta7_lag1,
  lag(rate_7d - rate_1d, 1) {OVER} AS spread, {", ".join(f"{_LR('avg', n)} AS rate_1d_mean{n}" for n in (7, 14, 28))}, {", ".join(f"{_LR('stddev_samp', n)} AS rate_1d_std{n}" for n in (7, 28))} FROM filled""", " ".join(_RF))
def rate_features(spark, sf):
    return features.rate_features(rates_filled(spark, sf), ["rate_1d"], {"spread": "rate_7d - rate_1d"}).select("report_date", *_RF)


@query(f"{D} SELECT report_date, CASE WHEN count(*) OVER w >= 14 THEN avg(ln(1 + purchase)) OVER w END AS trend FROM daily WINDOW w AS (ORDER BY report_date ROWS BETWEEN 14 PRECEDING AND 13 FOLLOWING)", "trend")
def centered_trend(spark, sf):
    return series.centered_mean(daily(spark, sf).select("report_date", F.log1p("purchase").alias("l")), "l", "trend").drop("l")


_LONG = "long AS (SELECT report_date, isodow(report_date) - 1 AS weekday, 'purchase' AS metric, purchase::DOUBLE AS value FROM daily UNION ALL SELECT report_date, isodow(report_date) - 1, 'redeem', redeem::DOUBLE FROM daily)"
def _robust(src: str, out: str, p: str, part: str, size: int, least: int) -> str:
    w = f"OVER (PARTITION BY {part} ORDER BY report_date ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING)"
    return f"""{out}_b AS (SELECT *, CASE WHEN count(*) {w} >= {least} THEN quantile_cont(value, 0.5) {w} END AS {p}_median, list(value) {w} AS {p}_before FROM {src}),
    {out} AS (SELECT * EXCLUDE ({p}_before), CASE WHEN len({p}_before) >= {size} THEN list_aggregate([abs(x - list_aggregate({p}_before, 'quantile_cont', 0.5)) FOR x IN {p}_before], 'quantile_cont', 0.5) END AS {p}_mad FROM {out}_b)"""
@query(f"""{D}, {_LONG}, {_robust("long", "t1", "trailing", "metric", 28, 14)}, {_robust("t1", "t2", "weekday", "metric, weekday", 8, 4)},
s AS (SELECT *, abs(value - trailing_median) / nullif(1.4826 * trailing_mad, 0) AS trailing_score, abs(value - weekday_median) / nullif(1.4826 * weekday_mad, 0) AS weekday_score FROM t2)
SELECT report_date, metric, value, trailing_median, trailing_mad, trailing_score, weekday_median, weekday_mad, weekday_score, greatest(trailing_score, weekday_score) AS robust_score, coalesce(greatest(trailing_score, weekday_score) > 6, false) AS is_anomaly FROM s""",
    "value trailing_median trailing_mad trailing_score weekday_median weekday_mad weekday_score robust_score")
def daily_anomalies(spark, sf):
    return series.anomalies(daily(spark, sf), BOTH).drop("weekday")


@query(f"""{D}, r AS (SELECT row_number() {OVER} AS i, ln(1 + purchase) AS x FROM daily) SELECT b.i - a.i AS lag, corr(a.x, b.x) AS autocorrelation, count(*) AS pairs FROM r a JOIN r b ON b.i BETWEEN a.i + 1 AND a.i + 60 GROUP BY 1""", "autocorrelation")
def autocorrelation(spark, sf):
    return series.autocorrelation(daily(spark, sf).select("report_date", F.log1p("purchase").alias("l")), "l").withColumn("lag", F.col("lag").cast("bigint"))


@query(f"""{D}, l AS (SELECT row_number() {OVER} - 1 AS t, ln(1 + purchase) AS x FROM daily), m AS (SELECT count(*) AS n, avg(x) AS mean FROM l),
h AS (SELECT t, n, (x - mean) * (0.5 - 0.5 * cos(2 * pi() * t / (n - 1))) AS x FROM l, m), k AS (SELECT unnest(generate_series(1, n // 2)) AS k, n FROM m),
p AS (SELECT k, k.n / k AS period_days, sum(x * cos(2 * pi() * ((k * t) % h.n) / h.n)) ** 2 + sum(x * sin(2 * pi() * ((k * t) % h.n) / h.n)) ** 2 AS power FROM h, k GROUP BY k, k.n)
SELECT k::INTEGER AS k, period_days, power FROM p WHERE period_days BETWEEN 2 AND 90 ORDER BY power DESC, k LIMIT 10""", "period_days power")
def periodogram(spark, sf):
    return series.periodogram(daily(spark, sf).select("report_date", F.log1p("purchase").alias("l")), "l")


@query(f"""{D}, b AS (SELECT isodow(report_date)::INTEGER - 1 AS weekday, purchase / 1e6 AS v, ln(1 + purchase / 1e6) AS l FROM daily), m AS (SELECT avg(v) AS av, avg(l) AS al, sum((l - (SELECT avg(l) FROM b)) ** 2) AS sst FROM b),
g AS (SELECT weekday, count(*) AS days, avg(v) AS mean, quantile_cont(v, 0.5) AS median, avg(l) AS ml FROM b GROUP BY 1)
SELECT weekday, days, mean, median, mean / av AS "index", (SELECT sum(days * (ml - al) ** 2) FROM g, m) / sst AS weekday_r2 FROM g, m""", 'mean median "index" weekday_r2')
def weekday_profile(spark, sf):
    return series.weekday_profile(daily(spark, sf).select("report_date", (F.col("purchase") / 1e6).alias("v")), "v")


_TR = ["CAST(avg(v) OVER w{n} AS DOUBLE) AS mean{n}", "quantile_cont(v, 0.5) OVER w{n} AS median{n}", "coalesce(stddev_pop(v) OVER w{n} / nullif(avg(v) OVER w{n}, 0), 0) AS cv{n}"]
@query(f"""{D}, b AS (SELECT report_date, purchase / 1e4 AS v, ln(1 + purchase / 1e4) AS l, row_number() {OVER} AS i FROM daily) SELECT report_date, {", ".join(x.format(n=n) for n in (7, 14, 28) for x in _TR)},
  {", ".join(f"CASE WHEN count(*) OVER w{n} > 1 THEN regr_slope(l, i) OVER w{n} END AS slope{n}" for n in (14, 28))} FROM b WINDOW {", ".join(f"w{n} AS (ORDER BY report_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (7, 14, 28))}""",
    "mean7 median7 cv7 mean14 median14 cv14 mean28 median28 cv28 slope14 slope28")
def trailing_statistics(spark, sf):
    return series.trailing(daily(spark, sf).select("report_date", (F.col("purchase") / 1e4).alias("v")), "v").drop("v")


@query(f"{D} SELECT report_date, cume_dist() OVER (ORDER BY purchase) AS percentile, rank() OVER (ORDER BY purchase) + (count(*) OVER (PARTITION BY purchase) - 1) / 2.0 AS average_rank FROM daily", "percentile average_rank")
def ranks(spark, sf):
    from pyspark.sql import Window

    d = daily(spark, sf)
    return d.select("report_date", F.cume_dist().over(Window.orderBy("purchase")).alias("percentile"), series.average_rank("purchase").alias("average_rank"))


@query(f"{D} SELECT * FROM (SELECT report_date, purchase, strftime(report_date, '%Y-%m') AS month, row_number() OVER (PARTITION BY strftime(report_date, '%Y-%m') ORDER BY purchase DESC, report_date) AS rn FROM daily) WHERE rn = 1")
def best_day_per_month(spark, sf):
    d = daily(spark, sf).select("report_date", "purchase", F.date_format("report_date", "yyyy-MM").alias("month"))
    return series.first_per_group(d, ["month"], [F.desc("purchase"), "report_date"]).withColumn("rn", F.lit(1).cast("bigint"))


@query(f"{D} SELECT report_date, purchase - redeem AS net FROM daily ORDER BY abs(purchase - redeem) DESC, report_date LIMIT 25")
def largest_net_days(spark, sf):
    return daily(spark, sf).select("report_date", (F.col("purchase") - F.col("redeem")).alias("net")).orderBy(F.desc(F.abs("net")), "report_date").limit(25)


_FLOWS = ("purchase", "redeem", "direct", "share")
_RANKED = lambda x: f"rank() OVER (PARTITION BY a, b ORDER BY {x}) + (count(*) OVER (PARTITION BY a, b, {x}) - 1) / 2.0"
_STATS = f"""w AS (SELECT a, b, x, y, {_RANKED("x")} AS rx, {_RANKED("y")} AS ry FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT a, b, count(*) AS pairs, CASE WHEN isnan(corr(x, y)) THEN NULL ELSE corr(x, y) END AS pearson, CASE WHEN isnan(corr(rx, ry)) THEN NULL ELSE corr(rx, ry) END AS spearman FROM w GROUP BY 1, 2"""
@query(f"{_FILLED}, j AS (SELECT * FROM daily JOIN filled USING (report_date)), pairs AS (" + " UNION ALL ".join(f"SELECT '{r}' AS a, '{f}' AS b, {r} AS x, {f}::DOUBLE AS y FROM j" for r in ("rate_1d", "rate_7d") for f in _FLOWS) + f"), {_STATS}", "pearson spearman")
def rate_flow_correlations(spark, sf):
    joined = daily(spark, sf).join(rates_filled(spark, sf), "report_date")
    return association.pair_statistics(association.long_pairs(joined, ("rate_1d", "rate_7d"), _FLOWS, []))


@query(f"{DR}, j AS (SELECT *, lag(rate_1d, 1) {OVER} AS lagged, lag(rate_1d - rate_7d, 1) {OVER} AS spread FROM daily LEFT JOIN rates USING (report_date)), pairs AS (" + " UNION ALL ".join(f"SELECT '{r}' AS a, '{f}' AS b, {r} AS x, {f}::DOUBLE AS y FROM j" for r in ("lagged", "spread", "rate_1d") for f in BOTH) + f"), {_STATS}", "pearson spearman")
def lagged_rate_correlations(spark, sf):
    from pyspark.sql import Window

    w = Window.orderBy("report_date")
    j = daily(spark, sf).join(rates(spark, sf), "report_date", "left").withColumns({"lagged": F.lag("rate_1d", 1).over(w), "spread": F.lag(F.col("rate_1d") - F.col("rate_7d"), 1).over(w)})
    return association.pair_statistics(association.long_pairs(j, ("lagged", "spread", "rate_1d"), BOTH, []))


_MODULI = (53, 59, 61, 67, 71, 73, 79, 83, 89, 97)
_TENORS = tuple(f"rate_{i}" for i in range(10))
_GRID_FLOWS = ("purchase", "redeem", "direct", "transfer", "consume", "share")
#: Ten rates of the days that observe them, carried forward from the first observation.
_WIDE = f"""{DR}, obs AS (SELECT o_orderdate::DATE AS report_date, {", ".join(f"avg(o_orderkey % {m})::DOUBLE AS {r}" for r, m in zip(_TENORS, _MODULI))} FROM orders WHERE o_orderdate::DATE BETWEEN {SERIES_SQL} AND isodow(o_orderdate) <= 5 GROUP BY 1),
wide AS (SELECT * FROM (SELECT report_date, {", ".join(f"last_value({r} IGNORE NULLS) OVER w AS {r}" for r in _TENORS)} FROM calendar LEFT JOIN obs USING (report_date) WINDOW w AS (ORDER BY report_date ROWS UNBOUNDED PRECEDING)) WHERE rate_0 IS NOT NULL)"""


def wide_rates(spark, sf):
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("report_date"), "o_orderkey")
    o = o.where(F.col("report_date").between(*SERIES) & (F.weekday("report_date") < 5))
    seen = o.groupBy("report_date").agg(*[F.avg(F.col("o_orderkey") % m).alias(r) for r, m in zip(_TENORS, _MODULI)])
    return joins.forward_fill(joins.densify(seen, "report_date", *SERIES), "report_date", list(_TENORS)).where("rate_0 is not null").select("report_date", *_TENORS)


def _grid_sql() -> str:
    x = {"x": "{r}", "x_lag1": "lag({r}, 1) OVER w", "x_lag7": "lag({r}, 7) OVER w", "x_diff1": "{r} - lag({r}, 1) OVER w", "x_diff7": "{r} - lag({r}, 7) OVER w", "x_diff1_lag1": "lag({r}, 1) OVER w - lag({r}, 2) OVER w"}
    y = {"y": "{t}::DOUBLE", "l": "ln(1 + {t})", "l_diff1": "ln(1 + {t}) - lag(ln(1 + {t}), 1) OVER w", "l_diff7": "ln(1 + {t}) - lag(ln(1 + {t}), 7) OVER w"}
    xs = " UNION ALL ".join(f"SELECT report_date, '{r}' AS rate, {', '.join(f'{e.format(r=r)} AS {n}' for n, e in x.items())} FROM j WINDOW w AS (ORDER BY report_date)" for r in _TENORS)
    ys = " UNION ALL ".join(f"SELECT report_date, '{t}' AS flow, {', '.join(f'{e.format(t=t)} AS {n}' for n, e in y.items())} FROM j WINDOW w AS (ORDER BY report_date)" for t in _GRID_FLOWS)
    centred = lambda cte, name, v: f"""{cte}_c AS (SELECT *, {v} - avg({v}) OVER p AS v_d, date_diff('day', DATE '1970-01-01', report_date) - avg(date_diff('day', DATE '1970-01-01', report_date)) OVER p AS t_d FROM {cte} WINDOW p AS (PARTITION BY {name}, isodow(report_date))),
    {cte}_r AS (SELECT * EXCLUDE (v_d, t_d), v_d - sum(v_d * t_d) OVER q / sum(t_d * t_d) OVER q * t_d AS {cte[0]}_res FROM {cte}_c WINDOW q AS (PARTITION BY {name}))"""  # noqa: E731
    both = " UNION ALL ".join(f"SELECT rate, flow, '{s}' AS statistic, {a} AS x, {b if b != 'l_res' else 'y_res'} AS y FROM g" for s, (a, b, _) in association.GRID.items())
    ranked = lambda v: f"rank() OVER (PARTITION BY rate, flow, statistic ORDER BY {v}) + (count(*) OVER (PARTITION BY rate, flow, statistic, {v}) - 1) / 2.0"
    return f"""{_WIDE}, j AS (SELECT * FROM daily JOIN wide USING (report_date)), xs AS ({xs}), ys AS ({ys}), {centred("xs", "rate", "x")}, {centred("ys", "flow", "l")}, g AS (SELECT * FROM xs_r JOIN ys_r USING (report_date)),
long AS ({both}), ok AS (SELECT *, {ranked("x")} AS rx, {ranked("y")} AS ry FROM long WHERE x IS NOT NULL AND y IS NOT NULL),
v AS (SELECT rate, flow, statistic, count(*) AS pairs, CASE WHEN statistic LIKE '%spearman' THEN corr(rx, ry) ELSE corr(x, y) END AS value FROM ok GROUP BY 1, 2, 3)
SELECT rate, flow, statistic, pairs, CASE WHEN isnan(value) THEN NULL ELSE value END AS value, CASE WHEN isnan(value) THEN NULL ELSE abs(value) END AS abs_value FROM v"""


@query(_grid_sql(), "value abs_value")
def rate_flow_grid(spark, sf):
    joined = daily(spark, sf).join(wide_rates(spark, sf), "report_date")
    return association.rate_grid(joined, _TENORS, _GRID_FLOWS)


@query(f"{_WIDE}, pairs AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM wide" for i, a in enumerate(_TENORS) for b in _TENORS[i + 1 :]) + f"), s AS ({'SELECT * FROM ('}WITH {_STATS})) SELECT a, b, pairs, spearman, abs(spearman) AS abs_spearman FROM s", "spearman abs_spearman")
def rate_collinearity(spark, sf):
    found = association.pair_statistics(association.long_pairs(wide_rates(spark, sf), _TENORS, _TENORS, [], triangular=True))
    return found.drop("pearson").withColumn("abs_spearman", F.abs("spearman"))


_RES = lambda c: f"{c}_d - sum({c}_d * t_d) OVER () / sum(t_d * t_d) OVER () * t_d"
@query(f"""{D}, b AS (SELECT report_date, isodow(report_date) AS wd, date_diff('day', DATE '1970-01-01', report_date)::DOUBLE AS t, ln(1 + purchase) AS p, ln(1 + redeem) AS r FROM daily),
c AS (SELECT report_date, t - avg(t) OVER w AS t_d, p - avg(p) OVER w AS p_d, r - avg(r) OVER w AS r_d FROM b WINDOW w AS (PARTITION BY wd)) SELECT report_date, {_RES("p")} AS p, {_RES("r")} AS r FROM c""", "p r")
def residual_series(spark, sf):
    d = daily(spark, sf).select("report_date", F.log1p("purchase").alias("p"), F.log1p("redeem").alias("r"))
    return association.residuals(d, ["p", "r"])


@query(f"{D} SELECT report_date, {', '.join(f'(isodow(report_date) - 1 = {k})::INT AS weekday{k}' for k in range(7))}, day(report_date)::INTEGER AS day, day(last_day(report_date))::INTEGER AS days_in_month, (isodow(report_date) > 5)::INT AS weekend, (day(report_date) <= 3)::INT AS month_start, (day(report_date) >= day(last_day(report_date)) - 2)::INT AS month_end, sin(2 * pi() * (isodow(report_date) - 1) / 7) AS weekday_sin, cos(2 * pi() * (isodow(report_date) - 1) / 7) AS weekday_cos FROM daily", "weekday_sin weekday_cos")
def calendar_features(spark, sf):
    from ..functions import one_hot

    f = month_features("report_date")
    return daily(spark, sf).select("report_date", *one_hot(F.weekday("report_date"), range(7), "weekday"), *[f[n].alias(n) for n in ("day", "days_in_month", "weekend", "month_start", "month_end", "weekday_sin", "weekday_cos")])


_LT = "lt AS (SELECT report_date, 'purchase' AS target, purchase::DOUBLE AS value FROM daily UNION ALL SELECT report_date, 'redeem', redeem::DOUBLE FROM daily)"
_AHEAD = """ahead AS (SELECT id, "start", CAST(unnest(generate_series("start", "end", INTERVAL 1 DAY)) AS DATE) AS target_date FROM windows), future AS (SELECT *, (date_diff('day', "start", target_date) + 1)::INTEGER AS horizon, isodow(target_date) AS wd FROM ahead)"""
_BASE = f"""WITH {DAILY_SQL}, {windows_sql(BACKTESTS)}, {_LT}, {_AHEAD}, m30 AS (SELECT id, target, avg(value) AS p FROM lt JOIN windows ON report_date < "start" AND report_date >= "start" - 30 GROUP BY 1, 2),
wd AS (SELECT id, target, isodow(report_date) AS wd, avg(value) AS m, quantile_cont(value, 0.5) AS md FROM lt JOIN windows ON report_date < "start" AND report_date >= "start" - 56 GROUP BY 1, 2, 3),
predicted AS (SELECT id, target, target_date, horizon, 'mean_30d' AS method, p AS predicted FROM future JOIN m30 USING (id) UNION ALL SELECT id, target, target_date, horizon, 'weekday_mean', m FROM future JOIN wd USING (id, wd)
  UNION ALL SELECT id, target, target_date, horizon, 'weekday_median', md FROM future JOIN wd USING (id, wd)
  UNION ALL SELECT id, target, target_date, horizon, 'seasonal_naive', value FROM future JOIN lt ON report_date = "start" - 7 + (horizon - 1) % 7)"""
@query(f"{_BASE} SELECT * FROM predicted", "predicted")
def baseline_forecasts(spark, sf):
    return forecast.baselines(daily(spark, sf), windows(spark, BACKTESTS), BOTH)


_SCORE = lambda src, by: f"""e AS (SELECT {by}, target_date, max(CASE WHEN target = 'purchase' THEN er END) AS e1, max(CASE WHEN target = 'redeem' THEN er END) AS e2 FROM (
  SELECT p.*, CASE WHEN value = 0 THEN CASE WHEN predicted = 0 THEN 0 ELSE 'inf'::DOUBLE END ELSE abs(predicted - value) / abs(value) END AS er FROM {src} p JOIN lt ON report_date = target_date AND lt.target = p.target) GROUP BY {by}, target_date)
SELECT {by}, count(*) AS days, avg(e1) AS purchase_error, avg(e2) AS redeem_error, avg(0.45 * e1 + 0.55 * e2) AS weighted_error, count(*) FILTER (e1 >= 0.3 OR e2 >= 0.3) AS zero_days,
  {", ".join(f"avg(0.45 * 10 * greatest(0, least(1, 1 - e1 / 0.3)) ** {p} + 0.55 * 10 * greatest(0, least(1, 1 - e2 / 0.3)) ** {p}) AS {n}" for n, p in (("linear", 1), ("quadratic", 2), ("cubic", 3)))} FROM e GROUP BY {by}"""  # noqa: E731
_METRICS = "purchase_error redeem_error weighted_error linear quadratic cubic"
@query(f"{_BASE}, {_SCORE('predicted', 'id, method')}", _METRICS)
def backtest_metrics(spark, sf):
    d = daily(spark, sf)
    return forecast.scored(forecast.baselines(d, windows(spark, BACKTESTS), BOTH), d, BOTH)


@query(f"{_BASE}, s AS (SELECT * FROM ({_BASE.replace('WITH ', 'WITH ', 1)}, {_SCORE('predicted', 'id, method')})) SELECT method, avg(linear) AS linear, max(weighted_error) AS worst, sum(zero_days)::BIGINT AS zero_days FROM s GROUP BY 1 ORDER BY linear DESC, worst, zero_days, method LIMIT 1", "linear worst")
def model_selection(spark, sf):
    d = daily(spark, sf)
    s = forecast.scored(forecast.baselines(d, windows(spark, BACKTESTS), BOTH), d, BOTH)
    per = s.groupBy("method").agg(F.avg("linear").alias("linear"), F.max("weighted_error").alias("worst"), F.sum("zero_days").alias("zero_days"))
    return clustering.first_by(per, [F.desc("linear"), "worst", "zero_days", "method"])


_ANCHOR = f"""{DW}, {_LT}, {_AHEAD}, lev AS (SELECT id, target, avg(value) AS level FROM lt JOIN windows ON report_date < "start" AND report_date >= "start" - 28 GROUP BY 1, 2),
bk AS (SELECT id, target, isodow(report_date) AS wd, value, (date_diff('day', report_date, "start") - 1) // 7 AS k FROM lt JOIN windows ON report_date < "start" AND report_date >= "start" - 56),
an AS (SELECT id, target, wd, avg(value) FILTER (k < 4) AS m4, sum(value * 0.82 ** k) / sum(0.82 ** k) AS m8 FROM bk GROUP BY 1, 2, 3),
anchors AS (SELECT id, target, wd, level, greatest(0.55 * m4 + 0.30 * m8 + 0.15 * level, greatest(1, 0.05 * level)) AS anchor FROM an JOIN lev USING (id, target))"""
@query(f"{_ANCHOR} SELECT id, target, (wd - 1)::INTEGER AS weekday, level, anchor FROM anchors", "level anchor")
def seasonal_anchors(spark, sf):
    return forecast.seasonal_anchor(daily(spark, sf), windows(spark, SERIES_WINDOWS), BOTH)


@query(f"{_ANCHOR}, predicted AS (SELECT id, target, target_date, 'seasonal_anchor' AS method, anchor AS predicted FROM future JOIN anchors USING (id, wd)), {_SCORE('predicted', 'id, method')}", _METRICS)
def anchor_metrics(spark, sf):
    d = daily(spark, sf)
    return forecast.scored(forecast.anchored(d, windows(spark, SERIES_WINDOWS), BOTH), d, BOTH)


@query("SELECT i / 200.0 AS error, 10 * greatest(0, least(1, 1 - i / 200.0 / 0.3)) AS linear, 10 * greatest(0, least(1, 1 - i / 200.0 / 0.3)) ** 2 AS quadratic, 10 * greatest(0, least(1, 1 - i / 200.0 / 0.3)) ** 3 AS cubic FROM range(71) t(i)", "error linear quadratic cubic")
def score_curves(spark, sf):
    base = spark.range(1).select(F.explode(forecast.score_curves()).alias("error"))
    return base.select("error", *[score_curve("error", p).alias(n) for n, p in (("linear", 1), ("quadratic", 2), ("cubic", 3))])


@query(f"""{D}, e AS (SELECT a.report_date, CASE WHEN a.purchase = 0 THEN CASE WHEN b.purchase = 0 THEN 0 ELSE 1e9 END ELSE abs(b.purchase - a.purchase)::DOUBLE / a.purchase END AS e1, CASE WHEN a.redeem = 0 THEN CASE WHEN b.redeem = 0 THEN 0 ELSE 1e9 END ELSE abs(b.redeem - a.redeem)::DOUBLE / a.redeem END AS e2 FROM daily a JOIN daily b ON b.report_date = a.report_date - 7)
SELECT report_date, e1, e2, 0.45 * 10 * greatest(0, least(1, 1 - e1 / 0.3)) + 0.55 * 10 * greatest(0, least(1, 1 - e2 / 0.3)) AS score FROM e""", "e1 e2 score")
def daily_scores(spark, sf):
    d = daily(spark, sf).select("report_date", *BOTH)
    past = d.select(F.date_add("report_date", 7).alias("report_date"), *[F.col(c).alias(f"p_{c}") for c in BOTH])
    e = d.join(past, "report_date").select("report_date", relative_error("purchase", "p_purchase").alias("e1"), relative_error("redeem", "p_redeem").alias("e2"))
    e = e.withColumn("score", daily_score(score_curve("e1"), score_curve("e2")))
    return e.withColumns({c: F.when(F.col(c) == float("inf"), 1e9).otherwise(F.col(c)) for c in ("e1", "e2")})


@query(f"""{_FILLED}, {windows_sql(SERIES_WINDOWS)} SELECT id, greatest(quantile_cont(rate_1d, 0.1), least(quantile_cont(rate_1d, 0.9), quantile_cont(rate_1d, 0.5) FILTER (report_date >= "start" - 14))) AS rate FROM filled JOIN windows ON report_date < "start" AND report_date >= "start" - 56 WHERE rate_1d IS NOT NULL GROUP BY 1""", "rate")
def profit_share_rate(spark, sf):
    return forecast.share_rate(rates_filled(spark, sf), "rate_1d", windows(spark, SERIES_WINDOWS))


_REC = """r AS (SELECT id, target_date, horizon, direct, transfer, consume, 1e9 AS opening, 1e9 * 2 / 10000 AS share, 1e9 + direct + 1e9 * 2 / 10000 - transfer - consume AS closing FROM f WHERE horizon = 1
  UNION ALL SELECT f.id, f.target_date, f.horizon, f.direct, f.transfer, f.consume, r.closing, r.closing * 2 / 10000, r.closing + f.direct + r.closing * 2 / 10000 - f.transfer - f.consume FROM r JOIN f ON f.id = r.id AND f.horizon = r.horizon + 1)"""
@query(f"""WITH RECURSIVE {DAILY_SQL}, {windows_sql(SERIES_WINDOWS)}, {_AHEAD}, f AS (SELECT id, target_date, horizon, direct / 100.0::DOUBLE AS direct, transfer / 100.0::DOUBLE AS transfer, consume / 100.0::DOUBLE AS consume FROM future JOIN daily ON report_date = target_date), {_REC}
SELECT id, target_date, opening / 1e3 AS opening, share / 1e3 AS share, closing / 1e3 AS closing FROM r""", "opening share closing")
def balance_recursion(spark, sf):
    f = forecast.future_days(windows(spark, SERIES_WINDOWS)).join(daily(spark, sf), F.col("report_date") == F.col("target_date"))
    f = f.select("id", "target_date", *[(F.col(c) / 100.0).alias(c) for c in ("direct", "transfer", "consume")])
    out = forecast.balance_recursion(f, F.lit(1e9), F.lit(2.0), overdrawn=True)  # the opening is fixed, flows grow with the orders
    return out.select("id", "target_date", *[(F.col(c) / 1e3).alias(c) for c in ("opening", "share", "closing")])


@query(f"{D} SELECT report_date, purchase, redeem FROM daily WHERE report_date BETWEEN DATE '1998-02-01' AND DATE '1998-03-02'")
def holdout_labels(spark, sf):
    return forecast.holdout(daily(spark, sf), "1998-02-01", "1998-03-02", BOTH)


_CHECKS = ("malformed_days", "repeated_days", "malformed_purchase", "malformed_redeem", "missing_days", "unexpected_days")
@query(f"""{D}, s AS (SELECT strftime(report_date, '%Y%m%d') AS day FROM daily WHERE report_date BETWEEN DATE '1998-02-02' AND DATE '1998-03-03'), w AS (SELECT strftime(CAST(unnest(generate_series(DATE '1998-02-01', DATE '1998-03-02', INTERVAL 1 DAY)) AS DATE), '%Y%m%d') AS day),
v AS (SELECT unnest({list(_CHECKS)!r}) AS "check", unnest([0, 0, 0, 0, (SELECT count(*) FROM w ANTI JOIN s USING (day)), (SELECT count(*) FROM s ANTI JOIN w USING (day))]) AS violations) SELECT "check", violations::BIGINT AS violations, CASE WHEN violations > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM v""")
def submission_audit(spark, sf):
    d = daily(spark, sf).where("report_date BETWEEN DATE '1998-02-02' AND DATE '1998-03-03'")
    return audits.submission_audit(d.select(F.date_format("report_date", "yyyyMMdd").alias("day"), F.col("purchase").cast("string").alias("purchase"), F.col("redeem").cast("string").alias("redeem")), "1998-02-01", "1998-03-02")


_G = "g AS (SELECT a / 4.0::DOUBLE AS wp, b / 4.0::DOUBLE AS wr FROM range(5) x(a), range(5) y(b))"
_CUR = lambda e: f"10 * greatest(0, least(1, 1 - {e} / 0.3))"
_ERR = lambda a, x, y, w: f"abs({w} * {x} + (1 - {w}) * {y} - {a}) / greatest(abs({a}), 1)"
@query(f"""{_ANCHOR}, nv AS (SELECT id, target, target_date, value AS naive FROM future JOIN lt ON report_date = "start" - 7 + (horizon - 1) % 7), rows AS (SELECT f.id, f.target_date, max(CASE WHEN a.target = 'purchase' THEN anchor END) AS ps, max(CASE WHEN a.target = 'redeem' THEN anchor END) AS rs,
  max(CASE WHEN a.target = 'purchase' THEN naive END) AS pc, max(CASE WHEN a.target = 'redeem' THEN naive END) AS rc, any_value(purchase)::DOUBLE AS pa, any_value(redeem)::DOUBLE AS ra FROM future f JOIN anchors a USING (id, wd) JOIN nv ON nv.id = f.id AND nv.target = a.target AND nv.target_date = f.target_date JOIN daily ON report_date = f.target_date GROUP BY 1, 2), {_G},
e AS (SELECT wp, wr, id, {_ERR("pa", "ps", "pc", "wp")} AS ep, {_ERR("ra", "rs", "rc", "wr")} AS er FROM rows, g), fo AS (SELECT wp, wr, id, avg(0.45 * {_CUR("ep")} + 0.55 * {_CUR("er")}) AS score, count(*) FILTER (ep >= 0.3 OR er >= 0.3) AS z FROM e GROUP BY ALL),
b AS (SELECT id, score AS base, z AS bz FROM fo WHERE wp = 1 AND wr = 1), per AS (SELECT wp, wr, count(*) FILTER (gain > 0) AS better, quantile_cont(gain, 0.5) AS median_gain, min(gain) AS worst_gain, sum(z)::BIGINT AS zero_days, sum(bz)::BIGINT AS base_zero, avg(score) AS score FROM (SELECT *, coalesce((score - base) / nullif(base, 0), 0) AS gain FROM fo JOIN b USING (id)) GROUP BY 1, 2),
o AS (SELECT *, better >= 4 AND median_gain >= 0.01 AND worst_gain >= -0.02 AND zero_days <= base_zero AS passes FROM per) SELECT * FROM o ORDER BY passes DESC, (wp = 1 AND wr = 1 AND NOT passes) DESC, score DESC, median_gain DESC, zero_days, wp DESC, wr DESC LIMIT 1""", "wp wr median_gain worst_gain score")
def weight_selection(spark, sf):
    d, w = daily(spark, sf), windows(spark, SERIES_WINDOWS)
    anchor = forecast.anchored(d, w, BOTH)
    naive = forecast.baselines(d, w, BOTH).where("method = 'seasonal_naive'")
    side = lambda df, t, n: F.max(F.when((F.col("target") == t) & (F.col("method") == n), F.col("predicted")))
    both = anchor.unionByName(naive).groupBy("id", "target_date").agg(
        side(None, "purchase", "seasonal_anchor").alias("p_seasonal"), side(None, "redeem", "seasonal_anchor").alias("r_seasonal"), side(None, "purchase", "seasonal_naive").alias("p_component"), side(None, "redeem", "seasonal_naive").alias("r_component")
    )
    rows = both.join(d.select(F.col("report_date").alias("target_date"), F.col("purchase").cast("double").alias("p_actual"), F.col("redeem").cast("double").alias("r_actual")), "target_date")
    steps = spark.createDataFrame([(a / 4, b / 4) for a in range(5) for b in range(5)], "wp double, wr double")
    return forecast.select_weights(rows, steps)


@query("""WITH t(k, ch, db, st) AS (VALUES (3, 10.0, 1.5, 0.9), (4, 12.0, 1.2, 0.8), (5, 12.0, 1.4, 0.95), (6, 8.0, 1.2, 0.7)), r AS (SELECT *, rank() OVER (ORDER BY -ch) + (count(*) OVER (PARTITION BY ch) - 1) / 2.0 AS ch_rank, rank() OVER (ORDER BY db) + (count(*) OVER (PARTITION BY db) - 1) / 2.0 AS db_rank,
rank() OVER (ORDER BY -st) + (count(*) OVER (PARTITION BY st) - 1) / 2.0 AS st_rank FROM t) SELECT k, ch, db, st, ch_rank, db_rank, st_rank, ch_rank + db_rank + st_rank AS rank_sum FROM r ORDER BY rank_sum, k LIMIT 1""", "ch db st ch_rank db_rank st_rank rank_sum")
def rank_sum_selection(spark, sf):
    t = spark.createDataFrame([(3, 10.0, 1.5, 0.9), (4, 12.0, 1.2, 0.8), (5, 12.0, 1.4, 0.95), (6, 8.0, 1.2, 0.7)], "k int, ch double, db double, st double")
    return clustering.rank_sum(t, {"ch": False, "db": True, "st": False}, "k").limit(1)


@query(f"""{D}, d AS (SELECT report_date, direct, row_number() {OVER} AS seen, {", ".join(f"lag(direct, {n - 1}) {OVER}::DOUBLE AS raw_lag{n}" for n in forecast.LAGS)}, avg(direct) OVER (ORDER BY report_date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS level FROM daily)
SELECT report_date AS origin, seen, {", ".join(f"raw_lag{n} / 1e6 AS raw_lag{n}" for n in forecast.LAGS)}, level / 1e6 AS level FROM d""", " ".join(f"raw_lag{n}" for n in forecast.LAGS) + " level")
def origin_lags(spark, sf):
    rows = forecast.origin_features(daily(spark, sf), "direct")
    return rows.select("origin", "seen", *[(F.col(c) / 1e6).alias(c) for c in (*[f"raw_lag{n}" for n in forecast.LAGS], "level")])


@query(f"""{D}, o AS (SELECT report_date AS origin, row_number() {OVER} AS seen FROM daily) SELECT origin, report_date AS target_date, date_diff('day', origin, report_date)::INTEGER AS horizon, 0.5 ** (date_diff('day', report_date, DATE '1998-02-01')::DOUBLE / {forecast.HALF_LIFE}) AS weight
  FROM o JOIN daily ON report_date BETWEEN origin + 1 AND origin + {forecast.HORIZON} WHERE origin < DATE '1998-02-01' AND report_date < DATE '1998-02-01' AND seen >= {forecast.MIN_HISTORY}""", "weight")
def origin_horizons(spark, sf):
    d = daily(spark, sf)
    rows, _ = forecast.training_rows(d, forecast.origin_features(d, "direct"), "direct", "1998-02-01")
    return rows.select("origin", "target_date", "horizon", "weight")


@query(f"{D} SELECT report_date, direct, transfer FROM daily WHERE report_date < DATE '1998-02-01'")
def sentinel_history(spark, sf):
    """What lies before a cutoff after all numbers from it on have been replaced by noise."""
    noisy = forecast.contaminated(daily(spark, sf).select("report_date", "direct", "transfer"), "1998-02-01", ("direct", "transfer"))
    return noisy.where("report_date < DATE '1998-02-01'")


@query(None)
def ridge_forecast(spark, sf):
    d = daily(spark, sf).join(wide_rates(spark, sf), "report_date")
    return forecast.forecast(d, "direct", "1998-02-01", auxiliary=("redeem", "consume", "transfer", "share", "purchase"), rates=_TENORS)
