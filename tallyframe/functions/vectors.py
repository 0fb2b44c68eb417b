"""Expressions over array columns, evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Whatever a lambda mentions is evaluated again for every element. As the
    element of a one-element array the value is bound before the inner lambda
    runs, which keeps the work linear in the length of the vector.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shifted(vec: Column) -> Column:
    """The vector less its maximum, in double precision."""
    return _once(
        F.array_max(vec).cast("double"),
        lambda top: F.transform(vec, lambda x: x.cast("double") - top),
    )


def _sum(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x)


def scale_vector(vec: Column, divisor: float) -> Column:
    """Every element divided by ``divisor``, in double precision."""
    return F.transform(vec, lambda x: x.cast("double") / F.lit(float(divisor)))


def softmax(vec: Column) -> Column:
    """Class probabilities of a vector of logits, shifted by its maximum."""
    return _once(
        F.transform(_shifted(vec), lambda x: F.exp(x)),
        lambda weights: _once(_sum(weights), lambda total: F.transform(weights, lambda x: x / total)),
    )


def cross_entropy_loss(logits: Column, label: Column) -> Column:
    """``-log(softmax(logits)[label])`` for a zero-based class index.

    An index outside the vector gives null.
    """
    return _once(
        _shifted(logits),
        lambda v: F.log(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x))) - F.get(v, label),
    )
