import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from fluxpanel.operators import association, audits, clustering, features, forecast, joins, quantiles, segments, series
from fluxpanel.operators import panel as ops


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def daily(spark, values, name="v"):
    return spark.createDataFrame([(day(i), float(v) if v is not None else None) for i, v in enumerate(values)], f"report_date date, {name} double")


def test_joins_check_cardinality(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "x")], "k int, w string")
    out = joins.join_checked(left, right, ["k"], marker="hit")
    assert sorted((r.k, r.w, r.hit) for r in out.collect()) == [(1, "x", True), (1, "x", True), (2, None, False)]
    with pytest.raises(joins.CardinalityError):
        joins.join_checked(left, right, ["k"], validate="one_to_one")
    with pytest.raises(joins.CardinalityError):
        joins.join_checked(right, left, ["k"])
    assert sorted(map(tuple, joins.set_gaps(left, right, ["k"]).collect())) == [(2, "right")]
    assert joins.same_sets(left.where("k = 1"), right, ["k"])
    assert [tuple(r) for r in joins.duplicated(left, ["k"]).collect()] == [(1, 2)]


def test_calendar_and_forward_fill(spark):
    df = spark.createDataFrame([(day(0), 1.0), (day(3), 4.0)], "report_date date, rate double")
    got = joins.forward_fill(joins.densify(df, "report_date", "2024-01-01", "2024-01-05"), "report_date", ["rate"]).orderBy("report_date").collect()
    assert [r.rate for r in got] == [1, 1, 1, 4, 4]
    assert [r.days_since_observation for r in got] == [0, 1, 2, 0, 1]
    assert [r.is_observed for r in got] == [True, False, False, True, False]
    assert [r.report_date for r in joins.missing_days(df, "report_date").orderBy("report_date").collect()] == [day(1), day(2)]
    assert joins.calendar(df.limit(0), "report_date").count() == 0


def test_median_and_deviation_have_their_own_gates(spark):
    rng = random.Random(1)
    values = [rng.random() * 100 for _ in range(40)]
    got = series.robust_score(daily(spark, values), "v", "t").orderBy("report_date").collect()
    assert [i for i, r in enumerate(got) if r.t_median is not None][0] == 14
    assert [i for i, r in enumerate(got) if r.t_mad is not None][0] == 28
    before = values[5:33]
    med = statistics.median(before)
    assert got[33].t_median == pytest.approx(med)
    assert got[33].t_score == pytest.approx(abs(values[33] - med) / (1.4826 * statistics.median(abs(x - med) for x in before)))


def test_anomaly_flags_a_spike_and_not_a_constant(spark):
    rng = random.Random(2)
    values = [100 + rng.random() for _ in range(60)]
    values[50] = 500
    flagged = series.anomalies(daily(spark, values), ["v"]).where("is_anomaly").collect()
    assert [r.report_date for r in flagged] == [day(50)]
    assert series.anomalies(daily(spark, [5.0] * 60), ["v"]).where("is_anomaly").count() == 0


def test_centered_window_and_ranks(spark):
    values = list(range(60))
    got = series.centered_mean(daily(spark, values), "v", "m").orderBy("report_date").collect()
    assert got[30].m == pytest.approx(statistics.mean(range(16, 44)))
    assert got[0].m == pytest.approx(statistics.mean(range(14)))
    ranked = spark.createDataFrame([(3,), (1,), (3,)], "v int").select("v", series.average_rank("v").alias("r")).orderBy("v").collect()
    assert [r.r for r in ranked] == [1.0, 2.5, 2.5]


def test_correlations_drop_null_pairs_first_and_survive_constants(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, None), (None, 3.0), (4.0, 4.0)], "x double, y double")
    r = association.pair_statistics(association.long_pairs(df, ["x"], ["y"], [])).first()
    assert (r.pairs, r.spearman) == (2, 1.0)
    flat = association.pair_statistics(association.long_pairs(df.select(F.lit(1.0).alias("x"), "y"), ["x"], ["y"], [])).first()
    assert flat.pearson is None and flat.spearman is None


def test_residuals_are_free_of_trend_and_weekday(spark):
    rng = random.Random(3)
    df = daily(spark, [3 * i + 10 * (i % 7) + rng.gauss(0, 1) for i in range(140)])
    res = [r.v for r in association.residuals(df, ["v"]).orderBy("report_date").collect()]
    assert abs(sum(i * x for i, x in enumerate(res))) < 1e-6 * 140**2
    for k in range(7):
        assert abs(sum(res[k::7])) < 1e-8


def test_eta_squared_range_and_constant(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 5.0), (None, 9.0)], "c string, v double")
    r = association.eta_squared(df, "c", "v").first()
    assert (r.groups, r.rows, r.effect) == (2, 3, "large") and r.eta_squared == pytest.approx(1.0)
    assert association.eta_squared(df.where("c = 'a'"), "c", "v", constant=0.0).first().eta_squared == 0.0
    assert association.eta_squared(df.where("c = 'a'"), "c", "v").first().effect == "unknown"


def test_periodogram_finds_the_week(spark):
    top = series.periodogram(daily(spark, [math.sin(2 * math.pi * i / 7) for i in range(280)]), "v").first()
    assert top.period_days == pytest.approx(7.0)


def test_autocorrelation_of_a_cycle(spark):
    acf = {r.lag: r.autocorrelation for r in series.autocorrelation(daily(spark, [i % 7 for i in range(210)]), "v", 14).collect()}
    assert acf[7] == pytest.approx(1.0) and acf[14] == pytest.approx(1.0) and acf[3] < 0.5


def test_adjusted_rand(spark):
    two = spark.createDataFrame([("x", "p"), ("x", "p"), ("y", "q"), ("y", "q")], "a string, b string")
    assert segments.adjusted_rand(two, "a", "b").first().adjusted_rand == pytest.approx(1.0)
    assert segments.adjusted_rand(two.select(F.lit("o").alias("a"), F.lit("o").alias("b")), "a", "b").first().adjusted_rand == 1.0
    assert segments.adjusted_rand(spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p"), ("y", "q")], "a string, b string"), "a", "b").first().adjusted_rand == pytest.approx(-0.5)


COLUMNS = "user_id long, report_date date, tBalance long, yBalance long, total_purchase_amt long, direct_purchase_amt long, purchase_bal_amt long, purchase_bank_amt long, total_redeem_amt long, consume_amt long, transfer_amt long, tftobal_amt long, tftocard_amt long, share_amt long, category1 long, category2 long, category3 long, category4 long"


def row(user, n, direct=0, transfer=0, consume=0, balance=100, opening=None):
    cats = (consume, 0, 0, 0) if consume else (None,) * 4
    opening = balance - direct + transfer + consume if opening is None else opening
    return (user, day(n), balance, opening, direct, direct, direct, 0, transfer + consume, consume, transfer, transfer, 0, 0, *cats)


def windows(spark):
    return spark.createDataFrame([("w1", day(100), day(129))], "id string, start date, end date")


def test_continuity_scopes(spark):
    df = spark.createDataFrame([row(1, 0, balance=5), row(1, 1, balance=5, opening=5), row(1, 3, balance=6, opening=6)], COLUMNS)
    got = {r.scope: (r.checks, r.mismatches) for r in ops.continuity(df).collect()}
    assert got == {"previous_row": (2, 1), "calendar_day": (1, 0)}


def test_key_audit_counts_all_members(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    assert audits.key_audit(df, ["k"], "t").first()[1:] == (4, 3, 2, 1, "FAIL")


def test_rules_and_precedence(spark):
    rows = [row(1, n) for n in (0, 50)]  # no flows, balance
    rows += [row(2, 95, direct=5)]  # seen for under 28 days
    rows += [row(3, n, direct=1000, transfer=900) for n in range(20, 99, 10)]  # round trips
    rows += [row(4, 0, direct=10)]  # funded, never withdrawn
    rows += [row(5, 0, transfer=10, balance=0), row(5, 2, direct=3, balance=0)]  # dormant
    rows += [row(6, n, consume=5) for n in range(20, 99, 20)]
    rows += [row(7, 110, direct=7)]  # new in the window
    panel = spark.createDataFrame(rows, COLUMNS)
    got = {r.user_id: r for r in segments.snapshot(panel, windows(spark)).collect()}
    labels = {u: r.segment for u, r in got.items()}
    assert labels == {1: "passive_balance_only", 2: "history_insufficient", 3: "frequent_large_roundtrip", 4: "funded_never_withdrawn", 5: "dormant_zero_balance", 6: "frequent_small_consumer"}
    assert got[1].direct_recency == 999 and got[2].tenure_days == 5
    assert got[1].last_direct_day is None and got[4].first_seen_90 is None or got[4].rows_90 >= 0
    cold = segments.cold_start(segments.periods(panel, windows(spark))).first()
    assert (cold.known_users, cold.new_users, cold.known_purchase, cold.all_purchase) == (6, 1, 0, 7)


def test_rules_that_hold_for_no_one_still_have_a_row(spark):
    users = segments.snapshot(spark.createDataFrame([row(1, 0)], COLUMNS), windows(spark))
    assert segments.summarize_rules(users).count() == len(segments.RULES)
    assert segments.rule_overlap(users).count() == 55


def test_hash_folds_are_contiguous(spark):
    users = spark.range(100).select(F.col("id").alias("user_id"))
    folds = ops.hash_folds(users, "s", 10, 2).orderBy("rank").collect()
    assert [r.fold for r in folds] == [1] * 10 + [2] * 10
    assert [r.sample_hash for r in folds] == sorted(r.sample_hash for r in folds)


def test_concentration_equals_sorting(spark):
    rng = random.Random(5)
    totals = [int(rng.paretovariate(1) * 1000) for _ in range(300)]
    panel = spark.createDataFrame([row(u, 0, direct=v) for u, v in enumerate(totals)], COLUMNS)
    got = {r.group: (r.user_count, r.amount) for r in ops.concentration(panel, ["purchase_total"]).collect()}
    best = sorted(totals, reverse=True)
    for group, k in (("top_1_user", 1), ("top_10_users", 10), ("top_0_1_percent_users", 1), ("top_1_percent_users", 3), ("top_5_percent_users", 15), ("top_10_percent_users", 30)):
        assert got[group] == (k, sum(best[:k]))


def test_group_quantiles_equal_percentile(spark):
    rng = random.Random(7)
    groups = [("many", 0.9, [rng.gauss(0, 1000) for _ in range(301)]), ("same", 0.75, [5.0] * 50), ("one", 0.5, [-3.0]), ("two", 0.5, [1.0, 4.0]), ("ends", 1.0, [1.0, 2.0, 9.0]), ("ties", 0.25, [0.0] * 7 + [1.0] * 3)]
    rows = [(g, p, v) for g, p, vs in groups for v in vs] + [("many", 0.9, None), ("none", 0.5, None)]
    df = spark.createDataFrame(rows, "g string, p double, v double")
    got = {r.g: r.quantile for r in quantiles.group_quantiles(df, ["g"]).collect()}
    want = {g: df.where(F.col("g") == g).agg(F.percentile("v", F.lit(p)).alias("q")).first().q for g, p, _ in groups}
    assert got == pytest.approx(want) and set(got) == {g for g, _, _ in groups}


def series_windows(spark, start):
    return spark.createDataFrame([("w", day(start), day(start + 9))], "id string, start date, end date")


def test_seasonal_naive_repeats_the_last_week(spark):
    df = daily(spark, [*[0] * 63, 1, 2, 3, 4, 5, 6, 7])
    got = forecast.baselines(df, series_windows(spark, 70), ["v"]).where("method = 'seasonal_naive'").orderBy("horizon").collect()
    assert [r.predicted for r in got] == [1, 2, 3, 4, 5, 6, 7, 1, 2, 3]


def test_balance_recursion(spark):
    flows = spark.createDataFrame([("w", day(0), 10.0, 4.0, 0.0), ("w", day(1), 10.0, 4.0, 0.0)], "id string, target_date date, direct double, transfer double, consume double")
    got = forecast.balance_recursion(flows, F.lit(1000.0), F.lit(100.0)).orderBy("target_date").collect()
    assert [r.share for r in got] == pytest.approx([10.0, 10.16]) and got[0].closing == pytest.approx(1016.0)
    with pytest.raises(Exception, match="negative balance"):
        forecast.balance_recursion(flows, F.lit(-100.0), F.lit(0.0)).collect()


def test_holdout_needs_every_day(spark):
    df = daily(spark, range(10))
    assert forecast.holdout(df, "2024-01-02", "2024-01-04", ["v"]).count() == 3
    with pytest.raises(Exception, match="days are missing"):
        forecast.holdout(df, "2024-01-05", "2024-01-20", ["v"]).collect()


def noisy(spark, n=150):
    rng = random.Random(9)
    rows = [(day(i), int(1000 + 200 * (i % 7) + rng.random() * 50), int(500 + rng.random() * 20), 2.0 + rng.random()) for i in range(n)]
    return spark.createDataFrame(rows, "report_date date, v long, w long, rate double")


def test_nothing_from_the_cutoff_on_reaches_the_forecast(spark):
    df, cutoff = noisy(spark), "2024-04-30"
    clean = forecast.forecast(df, "v", cutoff, ("w",), ("rate",)).orderBy("target_date").collect()
    dirty = forecast.forecast(forecast.contaminated(df, cutoff, ["v", "w", "rate"]), "v", cutoff, ("w",), ("rate",)).orderBy("target_date").collect()
    assert len(clean) == 30 and clean == dirty
    actual = [1025 + 200 * ((120 + i) % 7) for i in range(30)]
    assert max(abs(r.predicted - a) / a for r, a in zip(clean, actual)) < 0.05
    lagged = features.rate_features(df, ["rate"]).where(F.col("report_date") == F.lit(cutoff).cast("date")).drop("rate", "v", "w").first()
    again = features.rate_features(forecast.contaminated(df, cutoff, ["rate"]), ["rate"]).where(F.col("report_date") == F.lit(cutoff).cast("date")).drop("rate", "v", "w").first()
    assert lagged == again


def test_ridge_equals_the_normal_equations(spark):
    import numpy as np

    df, cutoff = noisy(spark), "2024-04-30"
    origins = forecast.origin_features(df.where(F.col("report_date") < F.lit(cutoff).cast("date")), "v", ("w",), ("rate",))
    rows, names = forecast.training_rows(df, origins, "v", cutoff)
    assert len(names) == 38 + 6
    model = forecast.fit_ridge(rows, names)
    pdf = rows.select(*names, "label", "weight").toPandas()
    x = np.array([(pdf[n] - model["scale"][n][0]) / model["scale"][n][1] for n in names]).T
    w, y = pdf["weight"].to_numpy(), pdf["label"].to_numpy()
    xm, ym = (x * w[:, None]).sum(0) / w.sum(), (y * w).sum() / w.sum()
    xc, yc = x - xm, y - ym
    beta = np.linalg.solve((xc * w[:, None]).T @ xc + 12.0 * np.eye(len(names)), (xc * w[:, None]).T @ yc)
    assert np.abs(beta - model["coefficients"]).max() < 1e-6


def test_weight_selection_falls_back(spark):
    rows = [(f"f{k}", day(i), 100.0, 100.0, 101.0, 300.0, 101.0, 300.0) for k in range(5) for i in range(3)]
    p = spark.createDataFrame(rows, "id string, target_date date, p_actual double, r_actual double, p_seasonal double, p_component double, r_seasonal double, r_component double")
    steps = spark.createDataFrame([(a / 4, b / 4) for a in range(5) for b in range(5)], "wp double, wr double")
    best = forecast.select_weights(p, steps).first()
    assert (best.wp, best.wr, best.passes) == (1.0, 1.0, False)
    swapped = p.select("id", "target_date", "p_actual", "r_actual", F.col("p_component").alias("p_seasonal"), F.col("p_seasonal").alias("p_component"), F.col("r_component").alias("r_seasonal"), F.col("r_seasonal").alias("r_component"))
    better = forecast.select_weights(swapped.withColumns({"p_seasonal": F.lit(125.0), "r_seasonal": F.lit(125.0)}), steps).first()
    assert better.passes and (better.wp, better.wr) == (0.0, 0.0)


def test_cluster_grid_finds_separate_groups(spark):
    rng = random.Random(4)
    rows = [(i, 5.0 * (i % 3) + rng.gauss(0, 0.1), 5.0 * (i % 3 == 1) + rng.gauss(0, 0.1)) for i in range(90)]
    df = spark.createDataFrame(rows, "user_id long, a double, b double")
    scaled = clustering.robust_scale(df, ["a", "b"])
    table, labels, k = clustering.fit_grid(scaled, ["a", "b"], ks=(2, 3, 4), seeds=(0, 1))
    assert table.count() == 3
    best = {r.k: r for r in table.collect()}
    assert best[3].calinski_harabasz > best[2].calinski_harabasz and best[3].inertia < best[2].inertia
    assert k in (2, 3, 4) and labels.count() == 90
    three = clustering.fit_grid(scaled, ["a", "b"], ks=(3,), seeds=(0, 1, 2))[1].withColumn("truth", F.col("user_id") % 3)
    assert segments.adjusted_rand(three, "auto_cluster", "truth").first().adjusted_rand > 0.5


def test_cluster_grid_is_whole(spark, monkeypatch):
    import inspect

    from fluxpanel.plans import panel_queries

    rng = random.Random(6)
    rows = [(i, 5.0 * (i % 3 == 0) + rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(80)]
    scaled = clustering.robust_scale(spark.createDataFrame(rows, "user_id long, a double, b double"), ["a", "b"])
    row = clustering.fit_grid(scaled, ["a", "b"], ks=(4,), seeds=(0, 1, 2, 3))[0].first()
    runs = []
    for seed in range(4):
        points = clustering.VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(scaled)
        model = clustering.KMeans(k=4, seed=seed, maxIter=100, tol=1e-7).fit(points)
        runs.append((model.summary.trainingCost, model.transform(points).select("user_id", "prediction")))
    pairs = [segments.adjusted_rand(a.withColumnRenamed("prediction", "x").join(b.withColumnRenamed("prediction", "y"), "user_id"), "x", "y").first().adjusted_rand for i, (_, a) in enumerate(runs) for _, b in runs[i + 1 :]]
    assert row.stability == pytest.approx((sorted(pairs)[2] + sorted(pairs)[3]) / 2)
    assert row.smallest_share == min(r["count"] for r in min(runs, key=lambda r: r[0])[1].groupBy("prediction").count().collect()) / 80
    assert "fit_grid(scaled)" in inspect.getsource(panel_queries._clustered)
    grid = inspect.signature(clustering.fit_grid).parameters
    assert list(grid["ks"].default) == [3, 4, 5, 6, 7, 8] and len(grid["seeds"].default) == 5


def test_fits_run_at_once_on_few_partitions(spark, monkeypatch):
    import threading

    seen, fit = [], clustering.KMeans.fit
    monkeypatch.setattr(clustering.KMeans, "fit", lambda self, points: seen.append((points.rdd.getNumPartitions(), threading.get_ident())) or fit(self, points))
    df = spark.createDataFrame([(i, float(i % 3), i / 100) for i in range(90)], "user_id long, a double, b double").repartition(64)
    table, labels, k = clustering.fit_grid(df, ["a", "b"], ks=(2, 3), seeds=(0, 1))
    assert [r.k for r in table.orderBy("k").collect()] == [2, 3] and labels.count() == 90 and k in (2, 3)
    assert len(seen) == 4 and max(n for n, _ in seen) <= spark.sparkContext.defaultParallelism and len({t for _, t in seen}) > 1


def test_strength_is_one_pass(spark):
    rows = [("w", "a" if i % 2 else "b", "c" if i % 3 else None, i, i % 2) for i in range(60)] + [("x", "a", None, 5, 5)]
    df = spark.createDataFrame(rows, "id string, p string, q string, s long, t long")
    out = segments.predictive_strength(df, ["p", "q"], ["s", "t"])
    got = {(r.id, r.method, r.target): (r.groups, r.rows, r.eta_squared) for r in out.collect()}
    assert set(got) == {("w", m, t) for m in "pq" for t in "st"} | {("x", "p", t) for t in "st"}
    assert got["w", "p", "t"] == (2, 60, pytest.approx(1)) and got["w", "q", "s"] == (1, 40, 0.0) and got["x", "p", "s"] == (1, 1, 0.0)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_ranks_by_ranges_equal_sorted_ranks(spark):
    rng = random.Random(11)
    values = [rng.choice([0.0, -3.5, 2.0, rng.gauss(0, 1e6), rng.random()]) for _ in range(400)]
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", v) for i, v in enumerate(values)], "id long, g string, v double").repartition(5)
    got = {r.id: r["rank"] for r in association.ranked_in_ranges(df, "g", "v", steps=4).collect()}
    for i, v in enumerate(values):
        own = [x for k, x in enumerate(values) if bool(k % 3) == bool(i % 3)]
        assert got[i] == sum(x < v for x in own) + (sum(x == v for x in own) + 1) / 2


def test_user_spearman_of_a_monotone_pair(spark):
    rows = [(u, t, f(u)) for u in range(1, 40) for t, f in (("a", lambda u: float(u)), ("b", lambda u: u**3.0), ("c", lambda u: -float(u % 7)))]
    got = {(r.a, r.b): r.user_spearman for r in association.user_spearman(spark.createDataFrame(rows, "user_id long, target string, v double"), "v").collect()}
    assert got["a", "b"] == pytest.approx(1) and got["a", "b"] == got["b", "a"] and abs(got["a", "c"]) < 0.5


def test_rate_grid_lags_and_differences(spark):
    rng = random.Random(5)
    rate = [rng.random() for _ in range(90)]
    flow = [0.0] + [math.expm1(3 + r) for r in rate[:-1]]  # yesterday's rate moves today's flow
    df = spark.createDataFrame([(day(i), rate[i], flow[i]) for i in range(90)], "report_date date, r double, f double")
    got = {x.statistic: x for x in association.rate_grid(df, ["r"], ["f"]).collect()}
    assert set(got) == set(association.GRID)
    assert got["lag1_spearman"].value == pytest.approx(1) and got["lag1_spearman"].pairs == 89
    assert got["lagged_diff1_corr"].pairs == 88 and got["lagged_diff1_corr"].value > 0.5
    assert got["diff7_corr"].pairs == 83 and all(abs(x.value) == x.abs_value for x in got.values())
    assert abs(got["spearman"].value) < 0.4


def test_leaks_and_overlaps_are_found(spark):
    windows = spark.createDataFrame([("a", day(10), day(19)), ("b", day(15), day(30)), ("c", day(40), day(35)), ("d", day(60), day(69))], "id string, start date, end date")
    panel = spark.createDataFrame([(1, day(i)) for i in range(80)], "user_id long, report_date date")
    profiles = spark.createDataFrame([("a", 1, 10, day(9)), ("b", 1, 16, day(14)), ("c", 1, 40, day(39)), ("d", 1, 61, day(60))], "id string, user_id long, rows_life long, last_seen_life date")
    got = {r.id: (r.overlap, r.status) for r in audits.leakage_audit(profiles, panel, windows).collect()}
    assert got == {"a": (False, "REVIEW"), "b": (True, "FAIL"), "c": (False, "FAIL"), "d": (False, "FAIL")}


def test_summary_status_follows_violations(spark):
    one = lambda m, x: spark.createDataFrame([(m, x)], "m long, x long")
    got = {r.check_id: (r.metric_value, r.status) for r in audits.audit_summary({"calendar": one(30, 0), "extreme_users": one(5, 5), "types": one(1, 1), "time_leakage": spark.createDataFrame([(None, None)], "m long, x long")}).collect()}
    assert got == {"calendar": (30, "PASS"), "extreme_users": (5, "REVIEW"), "types": (1, "FAIL"), "time_leakage": (0, "PASS")}


def test_profile_counts_distinct_values(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (2, None, None)], "x long, y string, z double")
    got = {r["column"]: (r.rows, r.nulls, r.distinct_values, r.min_value, r.max_value) for r in audits.column_profile(df).collect()}
    assert got == {"x": (3, 0, 2, "1", "2"), "y": (3, 1, 1, "a", "a"), "z": (3, 3, 0, None, None)}
    assert {r["column"]: r.rows for r in audits.column_profile(df.limit(0)).collect()} == {"x": 0, "y": 0, "z": 0}


def test_spreads_come_from_pairs():
    made = features.spreads()
    assert len(made) == len(features.SPREAD_PAIRS) + 1
    assert made["spread_Interest_1_Y_less_Interest_O_N"] == "Interest_1_Y - Interest_O_N"
