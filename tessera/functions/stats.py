"""Statistics of evaluations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def precision(correct: Column, wrong: Column) -> Column:
    return _ratio(correct, correct + wrong)


def recall(correct: Column, wrong: Column, missing: Column) -> Column:
    return _ratio(correct, correct + wrong + missing)


def f1(p: Column, r: Column) -> Column:
    """Null, not zero, where precision or recall is null or zero."""
    return F.when((p > 0) & (r > 0), 2 * p * r / (p + r))


def wilson(successes: Column, n: Column, z: float = Z) -> Column:
    """The 95 % interval as a struct of low and high; nothing observed gives (0, 1)."""
    p, z2 = successes / n, z * z
    centre, spread = (p + z2 / (2 * n)) / (1 + z2 / n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.struct(F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), centre - spread)).alias("low"), F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), centre + spread)).alias("high"))


def kappa(a: Column, b: Column) -> Column:
    """Cohen's kappa of two boolean raters, as an aggregate; null without rows or where chance agreement is total."""
    x, y = a.cast("double"), b.cast("double")
    observed = F.avg((a == b).cast("double"))
    expected = F.avg(x) * F.avg(y) + (1 - F.avg(x)) * (1 - F.avg(y))
    return F.when((F.count("*") > 0) & (expected < 1), (observed - expected) / (1 - expected))


def cost(tokens_in: Column, tokens_out: Column, rate_in: float, rate_out: float) -> Column:
    return tokens_in / 1e6 * rate_in + tokens_out / 1e6 * rate_out


def upper_median(values: Column) -> Column:
    """The element at half the count in sorted order (not the mean of two)."""
    return F.element_at(F.array_sort(values), (F.size(values) / 2).cast("int") + 1)
