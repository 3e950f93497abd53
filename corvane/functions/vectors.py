"""Elementwise vector functions on array<double> columns, JVM-side.

A per-row value such as a norm or a mean is spread over an array and zipped with the vector.  Used
inside a ``transform`` lambda it would be evaluated once per element instead of once per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body(s)`` with ``s.<name>`` bound to each value, evaluated once per row.

    Not for arguments of Python functions: Catalyst does not extract a Python function whose argument
    holds a lambda that refers to an outer lambda's variable.
    """
    bound = F.struct(*[v.alias(n) for n, v in values.items()])
    return F.transform(F.array(bound), body)[0]


def _spread(value: Column, x: Column) -> Column:
    return F.array_repeat(value, F.size(x))


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def inner_product(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2_norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(x), F.lit(0.0), lambda acc, v: acc + v * v))


def _nonzero(n: Column) -> Column:
    return F.when(n == 0.0, F.lit(1.0)).otherwise(n)


def l2_normalize(x: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    x = doubles(x)
    return F.zip_with(x, _spread(_nonzero(l2_norm(x)), x), lambda v, n: v / n)


def cosine(a: Column, b: Column) -> Column:
    """Inner product of the two unit vectors; 0 when either vector is zero."""
    return inner_product(a, b) / _nonzero(l2_norm(a) * l2_norm(b))


def l2_distance(a: Column, b: Column, eps: float = 0.0) -> Column:
    shift = F.lit(float(eps))
    return l2_norm(F.zip_with(doubles(a), doubles(b), lambda x, y: x - y + shift))


def pairwise_distance(a: Column, b: Column) -> Column:
    """Distance with the small constant added to every difference, as the triplet loss uses it."""
    return l2_distance(a, b, eps=1e-6)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(x: Column, factor: Column) -> Column:
    return F.zip_with(x, _spread(factor, x), lambda v, f: v * f)


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def sigmoid(v: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-v))


def layer_norm(x: Column, gamma: Column | None = None, beta: Column | None = None, eps: float = 1e-5) -> Column:
    """Per-row standardization with population variance, then optional scale and shift."""
    x = doubles(x)
    centred = F.zip_with(x, _spread(total(x) / F.size(x), x), lambda v, m: v - m)
    variance = F.aggregate(centred, F.lit(0.0), lambda acc, v: acc + v * v) / F.size(x)
    out = F.zip_with(centred, _spread(F.sqrt(variance + F.lit(eps)), x), lambda v, s: v / s)
    if gamma is not None:
        out = F.zip_with(out, gamma, lambda v, g: v * g)
    return out if beta is None else add(out, beta)
