"""Standard normal distribution: cumulative probability and its inverse as column expressions.

Cumulative: Hart's double-precision rational form (West 2005). Inverse: Acklam's approximation
(relative error below 1.2e-9).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients, highest power first.
CDF_TOP = (
    0.0352624965998911,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
CDF_BOTTOM = (
    0.0883883476483184,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
INV_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
INV_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
INV_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
INV_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
INV_TAIL = 0.02425
FAR = 5.0
FRACTION_TERMS = 30


def polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def _log_far(z: Column) -> Column:
    """log P(Z > z) for z >= 5 by the continued fraction of the tail."""
    fraction = z
    for k in range(FRACTION_TERMS, 0, -1):
        fraction = z + F.lit(float(k)) / fraction
    return -z * z / 2 - F.log(fraction) - F.lit(0.5 * math.log(2 * math.pi))


def log_cdf(x: Column) -> Column:
    """log P(Z <= x) for every x, without a clamp: rational form to 5 deviations, beyond that the
    continued fraction, whose logarithm does not underflow."""
    z = F.abs(x)
    near = -z * z / 2 + F.log(polynomial(z, CDF_TOP) / polynomial(z, CDF_BOTTOM))
    tail = F.when(z < FAR, near).otherwise(_log_far(z))
    return F.when(x > 0, F.log1p(-F.exp(tail))).otherwise(tail)


def cdf(x: Column) -> Column:
    """P(Z <= x)."""
    return F.exp(log_cdf(x))


def inverse(p: Column) -> Column:
    """x with P(Z <= x) = p for 0 < p < 1."""

    def tail(q: Column) -> Column:
        s = F.sqrt(-2 * F.log(q))
        return polynomial(s, INV_C) / polynomial(s, INV_D)

    q = p - 0.5
    r = q * q
    middle = polynomial(r, INV_A) * q / polynomial(r, INV_B)
    return F.when(p < INV_TAIL, tail(p)).when(p > 1 - INV_TAIL, -tail(1 - p)).otherwise(middle)


def with_inverse(df: DataFrame, p: str, out: str) -> DataFrame:
    """``df`` with ``inverse`` of the column ``p`` as ``out``. What is used more than once is a column of its own
    and computed once; as one expression it makes code that the virtual machine does not compile."""
    q, r, s = F.col("_q"), F.col("_r"), F.col("_s")
    steps = df.withColumns({"_q": F.col(p) - 0.5, "_s": F.sqrt(-2 * F.log(F.least(F.col(p), 1 - F.col(p))))})
    steps = steps.withColumn("_r", q * q)
    tail = polynomial(s, INV_C) / polynomial(s, INV_D)
    middle = polynomial(r, INV_A) * q / polynomial(r, INV_B)
    value = F.when(F.abs(q) <= 0.5 - INV_TAIL, middle).otherwise(F.when(q < 0, tail).otherwise(-tail))
    return steps.withColumn(out, value).drop("_q", "_r", "_s")
