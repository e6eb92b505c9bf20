"""Column expressions on arrays of doubles."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0.0)


def vsum(x: Column) -> Column:
    return F.aggregate(x, _zero(), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return vsum(F.zip_with(x, y, lambda a, b: a * b))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def vmap(x: Column, f) -> Column:
    return F.transform(x, f)


def plus(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def minus(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a - b)


def scale(x: Column, by: Column | float) -> Column:
    return F.transform(x, lambda v: v * by)


def min_abs(x: Column) -> Column:
    return F.array_min(F.transform(x, lambda v: F.abs(v)))


def max_abs(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda v: F.abs(v)))


def argmin(x: Column) -> Column:
    """Place of the least value, from 0; the first of equal ones."""
    return F.array_position(x, F.array_min(x)) - 1


def argmax(x: Column) -> Column:
    return F.array_position(x, F.array_max(x)) - 1


def logsumexp(x: Column) -> Column:
    """ln of the sum of exp, without overflow."""
    return F.array_max(x) + F.ln(F.aggregate(F.transform(x, lambda v: F.exp(v - F.array_max(x))), _zero(), lambda a, v: a + v))


def safe_log(x: Column) -> Column:
    """ln x, and 0 at 0."""
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(0.0))


def simplex_project(x: Column, smoothing: float = 0.0) -> Column:
    """Onto the simplex: normalise, clip below at 0, add smoothing, normalise."""
    clipped = F.transform(F.transform(x, lambda v: v / vsum(x)), lambda v: F.greatest(v, F.lit(0.0)) + F.lit(smoothing))
    return F.transform(clipped, lambda v: v / vsum(clipped))


def bias(x: Column) -> Column:
    """x with the constant 1 in front."""
    return F.concat(F.array(F.lit(1.0)), x)


def outside(x: Column, low: float, high: float) -> Column:
    """Whether no coordinate lies strictly between low and high."""
    return ~F.exists(x, lambda v: (v > low) & (v < high))


def hamming(a: Column, b: Column) -> Column:
    """Share of places at which two label arrays differ; a longer one differs in its rest."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda z: z)) / F.greatest(F.size(a), F.size(b))


def sym_expand2(x: Column, d: int) -> Column:
    """Products x_i x_j for i <= j with multiplicity: 1 on the diagonal, 2 beside it."""
    return F.array(*(F.lit(1.0 if i == j else 2.0) * x[i] * x[j] for i in range(d) for j in range(i, d)))


def sym_expand3(x: Column, d: int) -> Column:
    """Products x_i x_j x_k for i <= j <= k with multiplicity 1, 3 or 6."""
    many = {1: 1.0, 2: 3.0, 3: 6.0}
    return F.array(*(F.lit(many[len({i, j, k})]) * x[i] * x[j] * x[k] for i, j, k in itertools.combinations_with_replacement(range(d), 3)))


def exponents(d: int, degree: int) -> list[tuple[int, ...]]:
    """All exponents of d variables with that total degree, in lexicographic order."""
    return [e for e in itertools.product(range(degree + 1), repeat=d) if sum(e) == degree]


def power_embed(x: Column, table: list[tuple[float, ...]]) -> Column:
    """For each row of exponents the product of x_i to that power."""
    one = lambda e: F.aggregate(F.zip_with(x, F.array(*(F.lit(float(p)) for p in e)), lambda v, p: F.pow(v, p)), F.lit(1.0), lambda a, v: a * v)
    return F.array(*map(one, table))


def poly_embed(x: Column, d: int, degree: int) -> Column:
    return power_embed(x, exponents(d, degree))


def fractional_embed(x: Column, table: list[tuple[float, ...]]) -> Column:
    """Products of sign(x_i) |x_i|^p; the sign counts where p is 0 too."""
    one = lambda e: F.aggregate(F.zip_with(x, F.array(*(F.lit(float(p)) for p in e)), lambda v, p: F.signum(v) * F.pow(F.abs(v), p)), F.lit(1.0), lambda a, v: a * v)
    return F.array(*map(one, table))


def fourier_embed(x: Column, d: int, degree: int) -> Column:
    """cos of the dot product with every vector of frequencies 0 .. degree - 1."""
    return F.array(*(F.cos(dot(x, F.array(*(F.lit(float(p)) for p in ps)))) for ps in itertools.product(range(degree), repeat=d)))
