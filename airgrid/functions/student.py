"""Quantiles of Student's t for result rows."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tasks get the functions themselves, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODES, WEIGHTS = np.polynomial.legendre.leggauss(64)


def _upper_half(t: float, df: float) -> float:
    """P(0 < T < t) by Gauss-Legendre quadrature of the density in the angle atan(t / sqrt(df))."""
    angle = math.atan(t / math.sqrt(df))
    theta = angle * (NODES + 1) / 2
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return scale * float(np.sum(WEIGHTS * np.cos(theta) ** (df - 1))) * angle / 2


def t_quantile_value(p: float, df: float) -> float:
    """Quantile for p above one half, by bisection."""
    lo, hi = 0.0, 1.0
    while _upper_half(hi, df) < p - 0.5 and hi < 1e12:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if _upper_half(mid, df) < p - 0.5:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


@F.pandas_udf(T.DoubleType())
def _t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    known = {}
    out = []
    for a, b in zip(p, df):
        if b is None or not b > 0:
            out.append(None)
            continue
        if (a, b) not in known:
            known[(a, b)] = t_quantile_value(a, b)
        out.append(known[(a, b)])
    return pd.Series(out, dtype="float64")


def t_quantile(p: float, df: Column) -> Column:
    """Two-column form for small result tables; NULL where df is not positive."""
    return _t_quantile(F.lit(float(p)), df.cast("double"))
