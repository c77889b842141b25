"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: published rational approximation of the normal tail --------
# (Hart 1968, algorithm 5666, as given by West 2005), highest power first.
TAIL_NUMERATOR = [
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
TAIL_DENOMINATOR = [
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]
TAIL_SWITCH = 7.07106781186547
ROOT_TWO_PI = 2.506628274631
# ---- end of fixed values -------------------------------------------------------


def _horner(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def bind(x: Column, use) -> Column:
    """``use(x)`` with ``x`` evaluated once, however often ``use`` reads it.

    Without it a filter on the result repeats the whole expression of ``x``.
    """
    return F.get(F.transform(F.array(x), use), F.lit(0))


def upper_tail(x: Column) -> Column:
    """1 - Phi(x) for x >= 0, about 14 digits; Spark has no erf."""
    density = F.exp(-(x * x) / F.lit(2.0))
    near = density * _horner(x, TAIL_NUMERATOR) / _horner(x, TAIL_DENOMINATOR)
    fraction = x + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = x + F.lit(k) / fraction
    return F.when(x < TAIL_SWITCH, near).otherwise(density / fraction / F.lit(ROOT_TWO_PI))


def two_sided_p(z: Column) -> Column:
    return F.lit(2.0) * bind(F.abs(z), upper_tail)


def two_proportion_z(ca: Column, na: Column, cb: Column, nb: Column) -> Column:
    """Pooled two-proportion z; 0 where the pooled rate leaves no variance."""
    ca, na, cb, nb = (c.cast("double") for c in (ca, na, cb, nb))
    pooled = (ca + cb) / (na + nb)
    se = F.sqrt(pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / na + F.lit(1.0) / nb))
    return bind(se, lambda s: F.when(s > 0, (ca / na - cb / nb) / s).otherwise(F.lit(0.0)))


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def kolmogorov_tail(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p-value of a two-sample distance."""
    lam = F.sqrt(n.cast("double") * m / (n + m)) * d
    term = lambda k: (
        F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0))
        * F.exp(F.lit(-2.0) * lam * lam * k.cast("double") * k.cast("double"))
    )
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + term(k))
    return F.when(lam < 0.04, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def hash_number(*parts: Column) -> Column:
    """32-bit number from md5, the same in every engine."""
    joined = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long")


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(x.cast("double"), digits) + F.lit(0.0)
