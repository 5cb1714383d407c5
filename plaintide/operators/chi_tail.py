"""P-value of a chi-square statistic, applied to the one-row result of a test."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.pandas_udf(DoubleType())
def chi_square_tail(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail probability of the chi-square distribution (one row per test)."""
    return pd.Series([_gamma_tail(k / 2.0, x / 2.0) for x, k in zip(statistic, dof)])


def _gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    value = d
    for i in range(1, 100_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return value * scale
