"""Column expressions.  All are built-in Spark expressions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(column: ColumnOrName) -> Column:
    return F.col(column) if isinstance(column, str) else column


def filled(column: ColumnOrName, value=0) -> Column:
    """The column with nulls replaced; for companion columns that leave the original alone."""
    return F.coalesce(_c(column), F.lit(value))


def positive(column: ColumnOrName) -> Column:
    """True where above zero; a null is not."""
    return F.coalesce(_c(column) > 0, F.lit(False))


def holds(condition: Column) -> Column:
    """The condition with null as false, so that its negation is true for null."""
    return F.coalesce(condition, F.lit(False))


def all_present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def none_present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNull() for c in columns])


def log1p(column: ColumnOrName, narrow: bool = False) -> Column:
    return F.log1p(_c(column)).cast("float" if narrow else "double")


def safe_divide(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num / den, and 0.0 where the denominator is zero or null."""
    return F.coalesce(F.try_divide(_c(num).cast("double"), _c(den).cast("double")), F.lit(0.0))


def ratio_or_null(num: ColumnOrName, den: ColumnOrName) -> Column:
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def clip(column: ColumnOrName, low=None, high=None) -> Column:
    """Null stays null."""
    out = _c(column)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    return out


def first_match(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """The label of the first rule that holds; the default if none does."""
    out = None
    for rule, label in rules:
        out = F.when(holds(rule), label) if out is None else out.when(holds(rule), label)
    return out.otherwise(default) if out is not None else F.lit(default)


def banded(column: ColumnOrName, bands: Sequence[tuple[float, str]], last: str, missing: str) -> Column:
    """The label of the first upper bound above the value; ``missing`` for null and NaN."""
    value = _c(column)
    out = F.when(value.isNull() | F.isnan(value.cast("double")), missing)
    for bound, label in bands:
        out = out.when(value < bound, label)
    return out.otherwise(last)


#: Upper bounds of the effect-size labels.
EFFECT_BANDS = ((0.001, "negligible"), (0.01, "weak"), (0.06, "small"), (0.14, "moderate"))


def effect_label(column: ColumnOrName) -> Column:
    return banded(column, EFFECT_BANDS, "large", "unknown")


def status(failures: ColumnOrName, review: ColumnOrName | None = None, informative: bool = False) -> Column:
    """PASS without failures, else FAIL; REVIEW where only the softer count is above zero."""
    if informative:
        return F.lit("INFO")
    out = F.when(_c(failures) > 0, "FAIL")
    if review is not None:
        out = out.when(_c(review) > 0, "REVIEW")
    return out.otherwise("PASS")


def looked_up(column: ColumnOrName, table: Mapping, default=None) -> Column:
    """The value of a small literal table."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[_c(column)], F.lit(default))


def one_hot(column: ColumnOrName, values: Sequence, prefix: str) -> list[Column]:
    return [F.when(_c(column) == v, 1).otherwise(0).alias(f"{prefix}{v}") for v in values]


def half_even(column: ColumnOrName) -> Column:
    """Rounded to a whole number, halves to even."""
    return F.rint(_c(column)).cast("bigint")


def finite(column: ColumnOrName) -> Column:
    value = _c(column).cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def missing_as_null(column: ColumnOrName) -> Column:
    """NaN as null, so that one kind of missing value is left."""
    value = _c(column).cast("double")
    return F.when(F.isnan(value), None).otherwise(value)


def month_features(day: ColumnOrName) -> dict[str, Column]:
    """Calendar columns of a date; weekday counts from Monday = 0."""
    d = _c(day)
    dim, dom, wd = F.dayofmonth(F.last_day(d)), F.dayofmonth(d), F.weekday(d)
    angle = 2 * 3.141592653589793 * wd / 7
    return {
        "weekday": wd, "day": dom, "days_in_month": dim, "weekend": (wd >= 5).cast("int"), "month_start": (dom <= 3).cast("int"),
        "month_end": (dom >= dim - 2).cast("int"), "day_share": dom / 31.0, "to_month_end": (dim - dom) / 31.0,
        "weekday_sin": F.sin(angle), "weekday_cos": F.cos(angle),
    }


def salted_hash(salt: str, key: ColumnOrName) -> Column:
    """Lower-case hex SHA-256 of ``salt|key``."""
    return F.sha2(F.concat(F.lit(f"{salt}|"), _c(key).cast("string")).cast("binary"), 256)


def list_hash(keys: ColumnOrName) -> Column:
    """SHA-256 of the sorted keys of an array, one a line, with a line end after the last."""
    lines = F.array_join(F.transform(F.array_sort(_c(keys)), lambda k: k.cast("string")), "\n")
    return F.sha2(F.concat(lines, F.lit("\n")).cast("binary"), 256)


def joined_where(labels: Sequence[tuple[Column, str]], by: str = ",") -> Column:
    """The labels whose condition holds, joined."""
    return F.concat_ws(by, *[F.when(cond, label) for cond, label in labels])


# Scores of a forecast: error, curve, daily total.

def relative_error(actual: ColumnOrName, predicted: ColumnOrName) -> Column:
    """|predicted - actual| / |actual|; 0 for 0 against 0, infinite for anything else against 0."""
    a, p = _c(actual).cast("double"), _c(predicted).cast("double")
    return F.when(a == 0, F.when(p == 0, 0.0).otherwise(float("inf"))).otherwise(F.try_divide(F.abs(p - a), F.abs(a)))


def relative_error_floored(actual: ColumnOrName, predicted: ColumnOrName) -> Column:
    """|predicted - actual| / max(|actual|, 1)."""
    a, p = _c(actual).cast("double"), _c(predicted).cast("double")
    return F.abs(p - a) / F.greatest(F.abs(a), F.lit(1.0))


def score_curve(error: ColumnOrName, power: int = 1, tolerance: float = 0.3, top: float = 10.0) -> Column:
    """``top`` for no error down to 0 at ``tolerance``, along the given power."""
    if power not in (1, 2, 3) or tolerance <= 0:
        raise ValueError("power is 1, 2 or 3 and the tolerance above zero")
    return top * F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - _c(error) / tolerance)), F.lit(float(power)))


def daily_score(purchase: ColumnOrName, redeem: ColumnOrName, weights: tuple[float, float] = (0.45, 0.55)) -> Column:
    return weights[0] * _c(purchase) + weights[1] * _c(redeem)
