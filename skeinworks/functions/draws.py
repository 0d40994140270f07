"""Keyed draws: functions of their keys alone, whatever the partitioning, order or retries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*keys: Column | str | int) -> Column:
    """A double in [0, 1) from the keys; strings that are not columns are names of purposes."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def pick(items: Column, u: Column) -> Column:
    """A uniform element of an array; null where it is empty."""
    return F.get(items, F.floor(u * F.size(items)).cast("int"))


def subset(items: Column, k: Column, u) -> Column:
    """The ``k`` elements of an array with the smallest draws ``u(element)``."""
    drawn = F.array_sort(F.transform(items, lambda x: F.struct(u(x).alias("u"), x.alias("x"))))
    return F.transform(F.slice(drawn, F.lit(1), k), lambda s: s["x"])


def between(u: Column, low: Column, high: Column) -> Column:
    """A uniform integer from ``low`` to ``high``, both included."""
    return (low + F.floor(u * (high - low + 1))).cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once per row even where ``body`` uses it for every element of an array.

    A column that a projection computes may be moved into the functions that use it; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(value: Column, name: str) -> Column:
    """``value`` as column ``name`` that is computed once, where it stands.

    Filters and later projections on a plain column are moved into its expression, which is then computed for each of
    them; they are not moved below a generator.
    """
    return F.explode(F.array(value)).alias(name)
