"""Column builders of the scalar operators. Missing is NULL: NaN becomes NULL at read and never enters an expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def numeric(c: Column) -> Column:
    """As double; text that is no number and NaN are NULL."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def text(c: Column) -> Column:
    return c.cast("string")


def token(c: Column) -> Column:
    """A category as text, with ``nan`` for missing."""
    return F.coalesce(text(c), F.lit("nan"))


def log1p(x: Column) -> Column:
    """ln(1 + x); NULL for x <= -1."""
    return F.when(x > -1, F.log1p(x))


def sqrt(x: Column) -> Column:
    """Square root with negatives clipped to 0."""
    return F.when(x.isNotNull(), F.sqrt(F.greatest(x, F.lit(0.0))))


def square(x: Column) -> Column:
    return x * x


def divide(x: Column, y: Column) -> Column:
    """x / y; NULL for y = 0."""
    return F.try_divide(x, y)


def reciprocal(x: Column) -> Column:
    return F.try_divide(F.lit(1.0), x)


def is_null(x: Column) -> Column:
    return x.isNull().cast("double")


def cross(a: Column, b: Column) -> Column:
    return F.concat(token(a), F.lit("_x_"), token(b))


def is_equal(a: Column, b: Column) -> Column:
    """1.0 or 0.0; two missing values are equal."""
    return a.eqNullSafe(b).cast("double")


def row_sum(xs: list[Column]) -> Column:
    """Sum of what is there; 0.0 if nothing is."""
    return reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in xs])


def row_mean(xs: list[Column]) -> Column:
    count = reduce(lambda a, b: a + b, [x.isNotNull().cast("double") for x in xs])
    return F.try_divide(row_sum(xs), count)


def row_max(xs: list[Column]) -> Column:
    return F.greatest(*xs)


def row_min(xs: list[Column]) -> Column:
    return F.least(*xs)


def row_std(xs: list[Column]) -> Column:
    """Sample standard deviation of what is there; NULL for fewer than two values."""
    mean = row_mean(xs)
    squares = row_sum([(x - mean) * (x - mean) for x in xs])
    count = reduce(lambda a, b: a + b, [x.isNotNull().cast("double") for x in xs])
    return F.when(count > 1, F.sqrt(squares / (count - 1)))


def bucket(x: Column, edges: list[float]) -> Column:
    """The number of edges below x: right-closed bins. NULL stays, and minus infinity is NULL."""
    below = reduce(lambda a, b: a + b, [(x > F.lit(float(e))).cast("int") for e in edges])
    return F.when(x > F.lit(float("-inf")), below)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))
