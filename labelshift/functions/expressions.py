"""Column expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
PROBABILITY_FLOOR = 1e-12


def nan_to_null(value: Column) -> Column:
    """Spark orders NaN above every number, so missing must be null."""
    return F.when(~F.isnan(value), value)


def to_number(value: Column, data_type: str) -> Column:
    """Coerce to double; text that is not a plain number becomes null."""
    if data_type == "string":
        text = F.trim(value)
        return F.when(text.rlike(NUMERIC_PATTERN), text.try_cast("double"))
    number = value.cast("double")
    return nan_to_null(number) if data_type in ("double", "float") else number


def expit(value: Column) -> Column:
    return F.when(value >= 0, 1.0 / (1.0 + F.exp(-value))).otherwise(
        F.exp(value) / (1.0 + F.exp(value))
    )


def counted(weight: Column | None = None) -> Column:
    """Number of records; ``weight`` is the number of equal records that a row stands for."""
    return F.count(F.lit(1)) if weight is None else F.sum(weight)


def total(value: Column, weight: Column | None = None) -> Column:
    return F.sum(value) if weight is None else F.sum(weight * value)


def mean(value: Column, weight: Column | None = None) -> Column:
    """Mean over the records whose value is not null."""
    return F.avg(value) if weight is None else F.sum(weight * value) / F.sum(F.when(value.isNotNull(), weight))


def logit(value: Column) -> Column:
    return F.log(value / (1.0 - value))


def log_add_exp(left: Column, right: Column) -> Column:
    return F.greatest(left, right) + F.log1p(F.exp(-F.abs(left - right)))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def clip_probability(value: Column) -> Column:
    return clip(value, PROBABILITY_FLOOR, 1.0 - PROBABILITY_FLOOR)


def ratio(numerator: Column, denominator: Column, default: float | None) -> Column:
    """``numerator / denominator`` with a declared value for a zero denominator."""
    return F.when(denominator == 0, F.lit(default).cast("double")).otherwise(
        numerator.cast("double") / denominator
    )


def is_close(left: Column, right: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(left - right) <= F.lit(atol) + F.lit(rtol) * F.abs(right)


def indicator(condition: Column) -> Column:
    """1.0 where true, 0.0 where false or null."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def count_true(condition: Column) -> Column:
    return F.count_if(condition)


def share_true(condition: Column) -> Column:
    return F.avg(indicator(condition))


def bucket_right(value: Column, cuts: Column, n_cuts: int) -> Column:
    """Number of cuts at or below the value; ``cuts`` is a sorted array column."""
    total = F.lit(0)
    for index in range(n_cuts):
        total = total + F.when(F.get(cuts, F.lit(index)) <= value, 1).otherwise(0)
    return total


def mapped(value: Column, groups: dict[str, Sequence[int]]) -> Column:
    """Code-to-name lookup as one hash-set test per name."""
    result = None
    for name, codes in groups.items():
        test = value.isin(*codes)
        result = F.when(test, name) if result is None else result.when(test, name)
    return result


def number_label(value: Column) -> Column:
    """Label of a parameter by 12 significant digits, with the point written as ``p``.

    The same rule as ``plans.specifications.label_number`` on the driver: powers below 1e-4 and
    from 1e12 on are written with an exponent.
    """
    number = value.cast("double")
    text = F.format_string("%.11e", F.abs(number))
    digits = F.translate(F.substring_index(text, "e", 1), ".", "")
    power = F.substring_index(text, "e", -1)
    exponent = power.cast("int")
    ahead = exponent + 1  # digits before the point
    plain = F.when(
        exponent >= 0, F.concat(F.substring(digits, F.lit(1), ahead), F.lit("."), F.substring(digits, ahead + 1, F.lit(12)))
    ).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -ahead), digits))
    short = F.regexp_replace(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 11)), r"\.?0+$", "")
    shown = F.when(
        (exponent < -4) | (exponent >= 12), F.concat(short, F.lit("e"), power)
    ).otherwise(F.regexp_replace(plain, r"\.?0*$", ""))
    sign = F.when(number < 0, "-").otherwise("")
    return F.when(number == 0, "0").otherwise(F.concat(sign, F.translate(shown, ".", "p")))


def safe_name(value: Column) -> Column:
    return F.regexp_replace(value, r"[^\p{Alnum}_-]", "_")


def rounded(columns: Iterable[str], digits: int = 6) -> list[Column]:
    return [F.round(F.col(name), digits).alias(name) for name in columns]
