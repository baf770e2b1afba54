import hashlib
import math

import pytest
from pyspark.sql import functions as F

from fluxpanel import functions as fx


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_division_conventions(spark):
    r = one(spark, zero=fx.safe_divide(F.lit(3), F.lit(0)), null=fx.safe_divide(F.lit(3), F.lit(None)), some=fx.safe_divide(F.lit(3), F.lit(2)), none=fx.ratio_or_null(F.lit(3), F.lit(0)))
    assert (r.zero, r.null, r.some, r.none) == (0.0, 0.0, 1.5, None)


def test_errors_and_scores(spark):
    rows = spark.createDataFrame([(100.0, 110.0), (0.0, 0.0), (0.0, 1.0)], "a double, p double")
    assert [round(r.e, 9) for r in rows.select(fx.relative_error("a", "p").alias("e")).collect()] == [0.1, 0.0, math.inf]
    assert [r.e for r in rows.select(fx.relative_error_floored("a", "p").alias("e")).collect()] == pytest.approx([0.1, 0.0, 1.0])
    errors = spark.createDataFrame([(0.0,), (0.15,), (0.3,), (0.31,), (math.inf,)], "e double")
    for power, want in ((1, [10, 5, 0, 0, 0]), (2, [10, 2.5, 0, 0, 0]), (3, [10, 1.25, 0, 0, 0])):
        assert [r.s for r in errors.select(fx.score_curve("e", power).alias("s")).collect()] == pytest.approx(want)
    both = spark.createDataFrame([(100.0, 100.0, 100.0, 130.0)], "a double, b double, c double, d double")
    assert both.select(fx.daily_score(fx.score_curve(fx.relative_error("a", "b")), fx.score_curve(fx.relative_error("c", "d"))).alias("s")).first().s == pytest.approx(4.5)
    with pytest.raises(ValueError):
        fx.score_curve("e", 4)
    with pytest.raises(ValueError):
        fx.score_curve("e", 1, 0)


def test_rounding_labels_and_nulls(spark):
    r = one(
        spark, a=fx.half_even(F.lit(2.5)), b=fx.half_even(F.lit(3.5)), e=fx.effect_label(F.lit(0.05)), n=fx.effect_label(F.lit(float("nan"))), m=fx.effect_label(F.lit(None).cast("double")),
        f=fx.first_match([(F.lit(None).cast("boolean"), "x"), (F.lit(True), "y"), (F.lit(True), "z")], "d"), d=fx.first_match([(F.lit(False), "x")], "d"),
        s1=fx.status(F.lit(0)), s2=fx.status(F.lit(0), F.lit(1)), s3=fx.status(F.lit(2), F.lit(1)), s4=fx.status(F.lit(1), informative=True), h=fx.holds(F.lit(None).cast("boolean")),
        c=fx.clip(F.lit(9), 1, 5), cn=fx.clip(F.lit(None).cast("int"), 1, 5), k=fx.looked_up(F.lit("q"), {"a": 1}, 7), nan=fx.missing_as_null(F.lit(float("nan"))), fin=fx.finite(F.lit(float("inf"))),
    )
    assert (r.a, r.b, r.e, r.n, r.m, r.f, r.d) == (2, 4, "small", "unknown", "unknown", "y", "d")
    assert (r.s1, r.s2, r.s3, r.s4, r.h, r.c, r.cn, r.k, r.nan, r.fin) == ("PASS", "REVIEW", "FAIL", "INFO", False, 5, None, 7, None, False)


def test_hashes(spark):
    assert one(spark, h=fx.salted_hash("coldstart-v1-seed-20260824", F.lit(1))).h == "9b8d5e0b284e1e1a2ac96573d5e7a4881ead5a8299b9bc3e92b872525822cb72"
    assert one(spark, h=fx.list_hash(F.array(F.lit(3), F.lit(1)))).h == hashlib.sha256(b"1\n3\n").hexdigest()


def test_month_features(spark):
    f = {n: c for n, c in fx.month_features(F.lit("2024-02-27").cast("date")).items()}
    r = one(spark, **f)
    assert (r.weekday, r.day, r.days_in_month, r.weekend, r.month_start, r.month_end) == (1, 27, 29, 0, 0, 1)
