"""Monoids: named ways to combine values, each with a native Spark aggregate where there is one.

A monoid has a zero (the aggregate of nothing) or, as a semigroup, none.  User
monoids combine two Columns; they must be associative and commutative, as the
order of a distributed bag isn't defined.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Combine = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Monoid:
    name: str
    combine: Combine
    zero: object = None
    native: Callable[[Column], Column] | None = None
    whole: Callable[[Column], Column] | None = None  #: of an array, where combining two results isn't enough

    def agg(self, x: Column, zero: bool = True, strict: bool = False) -> Column:
        """The aggregate of ``x`` over a group; of nothing: the zero, else null (or an error if ``strict``)."""
        if self.native is not None:
            out = self.native(x)
        else:
            values = F.collect_list(x)
            rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
            # starts from the first value, so a semigroup needs no zero and the type is the values' own
            out = F.when(F.size(values) > 0, F.aggregate(rest, F.get(values, F.lit(0)), self.combine))
        if self.zero is not None and zero:
            return F.coalesce(out, F.lit(self.zero))
        if strict:
            return F.when(F.count(x) > 0, out).otherwise(F.raise_error(F.lit(f"{self.name}: nothing to reduce")))
        return out

    def fold(self, array: Column, zero: bool = True) -> Column:
        """The same over an array value."""
        if self.whole is not None:
            return self.whole(array)
        rest = F.slice(array, 2, F.greatest(F.size(array) - 1, F.lit(0)))
        out = F.when(F.size(array) > 0, F.aggregate(rest, F.get(array, F.lit(0)), self.combine))
        return F.coalesce(out, F.lit(self.zero)) if self.zero is not None and zero else out


_MONOIDS: dict[str, Monoid] = {}


def monoid(name: str, zero: object = None, combine: Combine | None = None, native: Callable[[Column], Column] | None = None) -> Monoid:
    """Registers a monoid (``zero=None``: a semigroup) and returns it."""
    if combine is None:
        raise ValueError("a monoid needs a function of two columns")
    out = _MONOIDS[name] = Monoid(name, combine, zero, native)
    return out


def get(name: str | Monoid) -> Monoid:
    if isinstance(name, Monoid):
        return name
    if name not in _MONOIDS:
        raise KeyError(f"no monoid {name!r}; known: {sorted(_MONOIDS)}")
    return _MONOIDS[name]


monoid("+", 0, lambda a, b: a + b, F.sum)
monoid("*", 1, lambda a, b: a * b, F.product)
monoid("&&", True, lambda a, b: a & b, F.bool_and)
monoid("||", False, lambda a, b: a | b, F.bool_or)
monoid("count", 0, lambda a, b: a + b, lambda x: F.count(F.lit(1)))
monoid("min", None, F.least, F.min)
monoid("max", None, F.greatest, F.max)


def _no_mean(a: Column, b: Column) -> Column:
    raise TypeError("a mean can't be made of two means: keep sum and count, and divide at the end")


_MONOIDS["avg"] = Monoid("avg", _no_mean, None, F.avg, lambda x: F.try_divide(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), F.size(x).cast("double")))
monoid("++", None, F.concat, lambda x: F.flatten(F.collect_list(x)))


def arg_min(key: Column, value: Column) -> Column:
    """The value with the smallest key of a group (ties: the smallest value)."""
    return F.min_by(value, F.struct(key, value))


def arg_max(key: Column, value: Column) -> Column:
    """The value with the largest key of a group (ties: the largest value)."""
    return F.max_by(value, F.struct(key, value))
