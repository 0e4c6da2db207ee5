"""Statistical expressions that Spark does not offer by name."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F

# fixed values: numerators and denominators of the rational approximations of the error function
# by W. J. Cody (Math. Comp. 23, 1969), for |x| up to 0.46875, up to 4, and beyond; each list goes from
# the highest power down
ERF_NEAR = (
    (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2,
     3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3,
     2.84423683343917062e3),
)
ERF_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1,
     2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3,
     1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2,
     1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3,
     1.23033935480374942e3),
)
ERF_FAR = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1,
     1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1,
     6.05183413124413191e-2, 2.33520497626869185e-3),
)


def _ratio(of: Column, terms: tuple) -> Column:
    """Quotient of two polynomials, by Horner's rule."""
    over, under = (reduce(lambda acc, c: acc * of + F.lit(c), t[1:], F.lit(t[0])) for t in terms)
    return over / under


def erf(x: Column) -> Column:
    """Error function as a column expression, to within 1e-15 of 1; NaN stays NaN."""
    y = F.abs(x)
    square = y * y
    # divisors are kept away from zero, as both sides of a condition may be computed
    wide = F.greatest(y, F.lit(1.0))
    inverse = F.lit(1.0) / (wide * wide)
    tail = (F.lit(1 / math.sqrt(math.pi)) - inverse * _ratio(inverse, ERF_FAR)) / wide
    rest = F.exp(-square) * F.when(y <= 4, _ratio(y, ERF_MIDDLE)).otherwise(tail)
    far = F.when(y > 6, F.lit(1.0)).otherwise(F.lit(1.0) - rest)
    result = F.when(y <= 0.46875, x * _ratio(square, ERF_NEAR)).otherwise(F.signum(x) * far)
    return F.when(F.isnan(x), x).otherwise(result)


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / F.lit(math.sqrt(2 * math.pi))


def norm_cdf(x: Column) -> Column:
    return (F.lit(1.0) + erf(x / F.lit(math.sqrt(2.0)))) / 2


def chi2_pdf(x: Column) -> Column:
    """Density with one degree of freedom: 0 below zero, infinite at zero."""
    positive = F.exp(-x / 2) / F.sqrt(F.lit(2 * math.pi) * F.when(x > 0, x))
    return F.when(x < 0, F.lit(0.0)).when(x == 0, F.lit(math.inf)).otherwise(positive)


def chi2_cdf(x: Column) -> Column:
    return F.when(x <= 0, F.lit(0.0)).otherwise(erf(F.sqrt(F.greatest(x, F.lit(0.0)) / 2)))


def expon_pdf(x: Column) -> Column:
    return F.when(x < 0, F.lit(0.0)).otherwise(F.exp(-x))


def expon_cdf(x: Column) -> Column:
    return F.when(x < 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.exp(-x))


def neat(x: Column, digits: int = 6) -> Column:
    """Round and turn a negative zero into zero."""
    return F.round(x, digits) + F.lit(0.0)
