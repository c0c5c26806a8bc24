"""Statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of k successes in n trials to 12 places, kept within 0 and 1; (0, 0) without trials."""
    p, z2 = k / n, z * z
    middle, width = (p + z2 / (2 * n)) / (1 + z2 / n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    some = n > 0
    return (
        F.when(some, F.greatest(F.lit(0.0), F.round(middle - width, 12))).otherwise(0.0),
        F.when(some, F.least(F.lit(1.0), F.round(middle + width, 12))).otherwise(0.0),
    )


def log_dice(f_ab: Column, f_a: Column, f_b: Column) -> Column:
    return 14 + F.log2(2 * f_ab / (f_a + f_b))


def pmi(f_ab: Column, f_a: Column, f_b: Column, total: Column, window: int) -> Column:
    """Pointwise mutual information for a window of ``window`` tokens at either side."""
    return F.log2(f_ab * total / (f_a * f_b * 2 * window))


def log_likelihood(f_ab: Column, f_a: Column, f_b: Column, total: Column) -> Column:
    """Dunning's log-likelihood ratio of a 2x2 table; 0 if a cell would be negative."""
    a, b, c = f_ab.cast("double"), (f_a - f_ab).cast("double"), (f_b - f_ab).cast("double")
    d = (total - f_a - f_b + f_ab).cast("double")
    n = a + b + c + d

    def term(cell: Column, row: Column, column: Column) -> Column:
        return F.when(cell > 0, cell * F.ln(cell * n / (row * column))).otherwise(0.0)

    value = 2 * (term(a, a + b, a + c) + term(b, a + b, b + d) + term(c, c + d, a + c) + term(d, c + d, b + d))
    return F.when((a < 0) | (b < 0) | (c < 0) | (d < 0), 0.0).otherwise(value)


def share(condition: Column) -> Column:
    """Aggregate: share of rows for which the condition holds; null counts as no."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))
