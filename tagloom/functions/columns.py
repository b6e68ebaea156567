"""Column functions beyond Spark's own that the engine's programs use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_range(i: Column, first: Column | int, last: Column | int, step: Column | int = 1) -> Column:
    """Whether i is in the inclusive range first, first + step, ... up to last."""
    i, first, last, step = (x if isinstance(x, Column) else F.lit(x) for x in (i, first, last, step))
    return (i >= first) & (i <= last) & ((i - first) % step == 0)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def add(a: Column, b: Column) -> Column:
    """Element-wise sum of two arrays."""
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def mean_vector(v: Column, dims: int) -> Column:
    """Aggregate: element-wise mean of arrays of ``dims`` numbers."""
    return F.array(*[F.avg(v[i]) for i in range(dims)])


def cons(x: Column, xs: Column) -> Column:
    return F.concat(F.array(x), xs)


def case(value: Column, *arms: tuple[Callable[[Column], Column] | Column | object, object], default: object = None) -> Column:
    """``value match { case p => e; ... }``: the first arm whose pattern (a value, or a predicate on the value) fits."""
    out = F.lit(default) if not isinstance(default, Column) else default
    for pattern, result in reversed(arms):
        test = pattern(value) if callable(pattern) else value.eqNullSafe(pattern)
        result = result(value) if callable(result) else result
        out = F.when(test, result).otherwise(out)
    return out


def links(html: Column) -> Column:
    """All link targets of a page."""
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))
