"""Nested parallelism: per-group logic, written once and planned for all groups at once.

A group is a *tag*.  A bag inside each group is one flat DataFrame with tag
columns (:class:`InnerBag`), a value per group is a DataFrame with one row a tag
(:class:`InnerScalar`), and the set of all tags is a :class:`Context`, so groups
that are empty still exist.  Operators add columns, joins and aggregates keyed by
the tag, so a function over these objects runs once, on the driver, and yields
one Catalyst plan whatever the number of groups.

Aggregates of one bag stay symbolic until they are needed: arithmetic between
them becomes one ``groupBy`` with several aggregates, not a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.functions import monoids
from tagloom.session import cut, hinted

Expr = Column | Callable[..., Column] | str


def joined(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join on equally named columns in which null equals null; the keys appear once."""
    if not on:
        return a.crossJoin(b)  # only sides of one row (a context without tags) come here
    twins = {c: f"__{c}" for c in on}
    right = b.withColumnsRenamed(twins)
    out = a.join(right, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(t)) for c, t in twins.items()]), how)
    if how in ("left_semi", "left_anti"):
        return out
    if how in ("full", "full_outer", "outer", "right", "right_outer"):
        out = out.withColumns({c: F.coalesce(F.col(c), F.col(t)) for c, t in twins.items()})
    return out.drop(*twins.values())


def _column(e: Expr) -> Column:
    if isinstance(e, Column):
        return e
    return F.col(e) if isinstance(e, str) else F.lit(e)


class Context:
    """The tags that exist: distinct rows of the tag columns."""

    def __init__(self, tags: DataFrame, names: Sequence[str], known: int | None = None):
        self.names, self.tags, self.known = tuple(names), tags.select(*names), known

    def count(self) -> int:
        """The number of tags (an action, once)."""
        if self.known is None:
            self.known = self.tags.count()
        return self.known

    def const(self, value: object) -> InnerScalar:
        """The same value for every tag."""
        return InnerScalar(self, frame=self.tags.withColumn("value", _column(value) if isinstance(value, Column) else F.lit(value)))

    def restrict(self, tags: DataFrame) -> Context:
        return Context(tags, self.names)


class InnerScalar:
    """One value for each tag: a frame (tags, value), or aggregates of one bag and an expression over them."""

    def __init__(self, ctx: Context, frame: DataFrame | None = None, source: DataFrame | None = None, aggs: dict[str, tuple[Column, object, bool]] | None = None, expr: Column | None = None):
        self.ctx, self._frame, self.source, self.aggs = ctx, frame, source, aggs or {}
        self.expr = F.col("value") if expr is None else expr

    @property
    def df(self) -> DataFrame:
        """Tag columns and ``value``."""
        names = self.ctx.names
        if self._frame is None:
            got = self.source.groupBy(*names).agg(*[a.alias(n) for n, (a, _, _) in self.aggs.items()])
            if all(keep for _, _, keep in self.aggs.values()):
                got = joined(self.ctx.tags, got, names, "left").withColumns({n: F.coalesce(F.col(n), F.lit(z)) if z is not None else F.col(n) for n, (_, z, _) in self.aggs.items()})
            self._frame = got.select(*names, self.expr.alias("value"))
            self.expr, self.aggs, self.source = F.col("value"), {}, None
        return self._frame.select(*names, self.expr.alias("value"))

    def apply(self, f: Callable[[Column], Column]) -> InnerScalar:
        """A function of the value."""
        return InnerScalar(self.ctx, self._frame, self.source, self.aggs, f(self.expr))

    def binary(self, other: object, f: Callable[[Column, Column], Column], strict: bool = False) -> InnerScalar:
        """A function of this value and another scalar's of the same tag (or a constant)."""
        if not isinstance(other, InnerScalar):
            return self.apply(lambda x: f(x, _column(other) if isinstance(other, Column) else F.lit(other)))
        if self._frame is None and other._frame is None and self.source is other.source:
            return InnerScalar(self.ctx, None, self.source, self.aggs | other.aggs, f(self.expr, other.expr))
        if self._frame is not None and self._frame is other._frame:
            return InnerScalar(self.ctx, self._frame, expr=f(self.expr, other.expr))
        left, right = self.df.withColumnRenamed("value", "__a"), other.df.withColumnRenamed("value", "__b")
        if strict:
            both = joined(left.withColumn("__l", F.lit(True)), right.withColumn("__r", F.lit(True)), self.ctx.names, "full")
            whole = F.col("__l").isNotNull() & F.col("__r").isNotNull()
            frame = both.select(*self.ctx.names, F.when(whole, f(F.col("__a"), F.col("__b"))).otherwise(F.raise_error(F.lit("the scalars have different tags"))).alias("value"))
        else:
            frame = joined(left, right, self.ctx.names).select(*self.ctx.names, f(F.col("__a"), F.col("__b")).alias("value"))
        return InnerScalar(self.ctx, frame)

    def ternary(self, second: InnerScalar, third: InnerScalar, f: Callable[[Column, Column, Column], Column]) -> InnerScalar:
        pair = self.binary(second, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return pair.binary(third, lambda p, c: f(p["a"], p["b"], c))

    def __add__(self, o):
        return self.binary(o, lambda a, b: a + b)

    def __radd__(self, o):
        return self.binary(o, lambda a, b: b + a)

    def __sub__(self, o):
        return self.binary(o, lambda a, b: a - b)

    def __rsub__(self, o):
        return self.binary(o, lambda a, b: b - a)

    def __mul__(self, o):
        return self.binary(o, lambda a, b: a * b)

    def __rmul__(self, o):
        return self.binary(o, lambda a, b: b * a)

    def __truediv__(self, o):
        """Null where the divisor is 0."""
        return self.binary(o, lambda a, b: F.try_divide(a.cast("double"), b.cast("double")))

    def __gt__(self, o):
        return self.binary(o, lambda a, b: a > b)

    def __lt__(self, o):
        return self.binary(o, lambda a, b: a < b)

    def __ge__(self, o):
        return self.binary(o, lambda a, b: a >= b)

    def __le__(self, o):
        return self.binary(o, lambda a, b: a <= b)

    def __and__(self, o):
        return self.binary(o, lambda a, b: a & b)

    def __or__(self, o):
        return self.binary(o, lambda a, b: a | b)

    def __invert__(self):
        return self.apply(lambda a: ~a)

    def equals(self, o):
        return self.binary(o, lambda a, b: a.eqNullSafe(b))

    def to_bag(self) -> InnerBag:
        """A bag of one element for each tag."""
        return InnerBag(self.ctx, self.df)

    def persist(self) -> InnerScalar:
        return InnerScalar(self.ctx, self.df.persist())

    def unlift(self, name: str = "value", tags: bool = True) -> DataFrame:
        """A flat DataFrame: the values, with their tags or without."""
        out = self.df.withColumnRenamed("value", name)
        return out if tags else out.select(name)

    def drop_level(self) -> InnerBag:
        """The values as bags of the outer level: the innermost tag goes."""
        names = self.ctx.names[:-1]
        return InnerBag(Context(self.df.select(*names).distinct(), names), self.df.drop(self.ctx.names[-1]))


class Grouped:
    """An inner bag by keys, to be aggregated within each tag."""

    def __init__(self, bag: InnerBag, keys: dict[str, Column]):
        self.bag, self.keys = bag, keys

    def agg(self, **aggs: Column) -> InnerBag:
        by = [*self.bag.ctx.names, *(k.alias(n) for n, k in self.keys.items())]
        return self.bag._with(self.bag.df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()]))

    def reduce(self, name: str, monoid: str | monoids.Monoid, value: Expr) -> InnerBag:
        return self.agg(**{name: monoids.get(monoid).agg(_column(value))})


class InnerBag:
    """A bag inside every tag; ``df`` holds tag columns and element columns."""

    def __init__(self, ctx: Context, df: DataFrame):
        self.ctx, self.df = ctx, df

    def _with(self, df: DataFrame) -> InnerBag:
        return InnerBag(self.ctx, df)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.ctx.names]

    # ---- elements
    def select(self, *cols: Expr, **named: Expr) -> InnerBag:
        return self._with(self.df.select(*self.ctx.names, *cols, *[_column(e).alias(n) for n, e in named.items()]))

    def with_columns(self, **named: Expr) -> InnerBag:
        return self._with(self.df.withColumns({n: _column(e) for n, e in named.items()}))

    def where(self, condition: Column | str) -> InnerBag:
        return self._with(self.df.where(condition))

    def explode(self, name: str, array: Expr) -> InnerBag:
        return self._with(self.df.withColumn(name, F.explode(_column(array))))

    def distinct(self) -> InnerBag:
        return self._with(self.df.distinct())

    def union(self, other: InnerBag) -> InnerBag:
        return self._with(self.df.unionByName(other.df))

    def intersect(self, other: InnerBag) -> InnerBag:
        """Elements that equal some element of the other bag of their tag, as often as here."""
        return self._with(joined(self.df, other.df.distinct(), self.df.columns, "left_semi"))

    def minus(self, other: InnerBag) -> InnerBag:
        """Elements that equal no element of the other bag of their tag."""
        return self._with(joined(self.df, other.df.distinct(), self.df.columns, "left_anti"))

    def sample(self, n: int, seed: int = 0, order_by: Expr | None = None) -> InnerBag:
        """At most ``n`` elements of each tag: exactly n if there are so many. ``order_by`` replaces chance."""
        order = F.rand(seed) if order_by is None else order_by
        by = order if isinstance(order, (list, tuple)) else [order]
        return self._with(self.df.withColumn("__n", F.row_number().over(W.partitionBy(*self.ctx.names).orderBy(*by))).where(F.col("__n") <= n).drop("__n"))

    # ---- values of each tag
    def _agg(self, agg: Column, zero: object, keep: bool) -> InnerScalar:
        name = f"__{hashlib.sha1(str(agg._jc).encode()).hexdigest()[:16]}"  # the same in every run
        return InnerScalar(self.ctx, source=self.df, aggs={name: (agg, zero, keep)}, expr=F.col(name))

    def count(self, empties: str = "keep") -> InnerScalar:
        """Elements of each tag; tags without any have 0 (``keep``) or are left out (``drop``)."""
        return self._agg(F.count(F.lit(1)), 0, _keep(empties))

    def is_empty(self) -> InnerScalar:
        return self.count("keep").apply(lambda n: n == 0)

    def sum(self, value: Expr, empties: str = "drop", zero: object = 0) -> InnerScalar:
        return self._agg(F.sum(_column(value)), zero, _keep(empties))

    def avg(self, value: Expr, empties: str = "drop") -> InnerScalar:
        return self._agg(F.avg(_column(value)), None, _keep(empties))

    def min(self, value: Expr, empties: str = "drop") -> InnerScalar:
        return self._agg(F.min(_column(value)), None, _keep(empties))

    def max(self, value: Expr, empties: str = "drop") -> InnerScalar:
        return self._agg(F.max(_column(value)), None, _keep(empties))

    def reduce(self, monoid: str | monoids.Monoid, value: Expr, empties: str = "drop") -> InnerScalar:
        m = monoids.get(monoid)
        return self._agg(m.agg(_column(value)), m.zero, _keep(empties))

    def aggregate(self, agg: Column, empties: str = "drop", zero: object = None) -> InnerScalar:
        """Any Spark aggregate."""
        return self._agg(agg, zero, _keep(empties))

    def collect_list(self, value: Expr, empties: str = "drop", ordered: bool = False) -> InnerScalar:
        """Each tag's elements as an array (of one executor's size at most)."""
        out = F.collect_list(_column(value))
        scalar = self._agg(F.sort_array(out) if ordered else out, None, _keep(empties))
        return scalar.apply(lambda a: F.coalesce(a, F.array())) if _keep(empties) else scalar

    def group_by(self, *names: str, **keys: Expr) -> Grouped:
        return Grouped(self, {n: F.col(n) for n in names} | {n: _column(e) for n, e in keys.items()})

    # ---- joins
    def join(self, other: InnerBag, on: Sequence[str] = (), how: str = "inner") -> InnerBag:
        """Equi-join within a tag. The other bag may have fewer tag levels: then its tags are a part of these."""
        shared = [t for t in self.ctx.names if t in other.ctx.names]
        return self._with(joined(self.df, other.df, [*shared, *on], how))

    def join_flat(self, flat: DataFrame, on: Sequence[str], how: str = "inner") -> InnerBag:
        """Equi-join with a bag that isn't nested, the same for every tag."""
        return self._with(joined(self.df, flat, list(on), how))

    def prepared(self, *keys: str) -> InnerBag:
        """Dealt by tags and keys and persisted, for joins in a loop."""
        return self._with(self.df.repartition(*self.ctx.names, *keys).persist())

    def with_closure(self, scalar: InnerScalar, name: str = "closure", strategy: str = "auto") -> InnerBag:
        """Each element with its tag's value of a scalar (of these tags, or of outer ones)."""
        side = hinted(scalar.df.withColumnRenamed("value", name), scalar.ctx.known, strategy)
        return self._with(joined(self.df, side, [t for t in self.ctx.names if t in scalar.ctx.names]))

    def with_bag_closure(self, other: InnerBag, name: str = "closure") -> InnerBag:
        """Each element with the whole other bag of its tag as an array of structs; an empty array if it has none."""
        packed = other.df.groupBy(*other.ctx.names).agg(F.collect_list(F.struct(*other.columns)).alias(name))
        out = joined(self.df, packed, [t for t in self.ctx.names if t in other.ctx.names], "left")
        return self._with(out.withColumn(name, F.coalesce(name, F.array())))

    def with_flat_closure(self, flat: DataFrame, rows: int | None = None) -> InnerBag:
        """Each element with every row of a flat bag, which is broadcast if its size is known to be small."""
        return self._with(self.df.crossJoin(hinted(flat, rows)))

    # ---- levels
    def lift_map(self, f: Callable[[InnerBag], InnerScalar], tag: str = "__element") -> InnerBag:
        """``f`` for each element as a group of its own, one level deeper; the results are this level's elements."""
        tagged = cut(self.df.withColumn(tag, F.monotonically_increasing_id()))
        names = (*self.ctx.names, tag)
        out = f(InnerBag(Context(tagged.select(*names), names), tagged))
        return InnerBag(self.ctx, out.df.select(*self.ctx.names, "value"))

    def nest(self, *by: str) -> Nested:
        """The groups of each tag, one level deeper."""
        return nest(self.df, [*self.ctx.names, *by])

    def unlift(self, tags: bool = True) -> DataFrame:
        return self.df if tags else self.df.drop(*self.ctx.names)

    def persist(self) -> InnerBag:
        return self._with(self.df.persist())


def _keep(empties: str) -> bool:
    if empties not in ("keep", "drop"):
        raise ValueError("empties: keep or drop")
    return empties == "keep"


class Nested:
    """A bag of (outer value, inner bag)."""

    def __init__(self, outer: InnerScalar, inner: InnerBag):
        self.ctx, self.outer, self.inner = inner.ctx, outer, inner

    def map(self, f: Callable[[InnerScalar, InnerBag], tuple[InnerScalar, InnerBag]]) -> Nested:
        return Nested(*f(self.outer, self.inner))

    def map_to_scalar(self, f: Callable[..., InnerScalar], name: str = "value", tags: bool = True) -> DataFrame:
        """``f(outer, inner)`` of all groups, as a flat DataFrame."""
        return f(self.outer, self.inner).unlift(name, tags)

    def filter_outer(self, condition: Callable[[Column], Column]) -> Nested:
        """The groups whose outer value passes; all layers lose the others."""
        kept = self.outer.df.where(condition(F.col("value")))
        ctx = self.ctx.restrict(kept)
        return Nested(InnerScalar(ctx, kept), InnerBag(ctx, joined(self.inner.df, ctx.tags, ctx.names, "left_semi")))

    def cartesian(self, other: Nested, suffixes: tuple[str, str] = ("_1", "_2"), when: Callable[..., Column] | None = None) -> NestedPair:
        """All pairs of groups (``when``: a condition on the renamed tags); inner bags meet every pair that they are in."""
        first = {n: n + suffixes[0] for n in self.ctx.names}
        second = {n: n + suffixes[1] for n in other.ctx.names}
        left, right = self.ctx.tags.withColumnsRenamed(first), other.ctx.tags.withColumnsRenamed(second)
        condition = when({n: F.col(n) for n in (*first.values(), *second.values())}) if when else F.lit(True)
        ctx = Context(left.join(right, condition), (*first.values(), *second.values()))
        sides = []
        for bag, names in ((self.inner, first), (other.inner, second)):
            sides.append(InnerBag(ctx, joined(ctx.tags, bag.df.withColumnsRenamed(names), list(names.values()))))
        a = joined(ctx.tags, self.outer.df.withColumnsRenamed(first | {"value": "__a"}), list(first.values()))
        both = joined(a, other.outer.df.withColumnsRenamed(second | {"value": "__b"}), list(second.values()))
        outer = InnerScalar(ctx, both.select(*ctx.names, F.struct(F.col("__a").alias("_1"), F.col("__b").alias("_2")).alias("value")))
        return NestedPair(outer, *sides)

    def split(self) -> dict[tuple, DataFrame]:
        """One DataFrame a group, on the driver's side: the plan that a loop over groups would use, for comparison."""
        out = {}
        for row in self.ctx.tags.collect():
            test = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(row[n]) for n in self.ctx.names])
            out[tuple(row)] = self.inner.df.where(test).drop(*self.ctx.names)
        return out


class NestedPair:
    """A bag of (outer value, inner bag, inner bag)."""

    def __init__(self, outer: InnerScalar, first: InnerBag, second: InnerBag):
        self.ctx, self.outer, self.first, self.second = first.ctx, outer, first, second

    def map_to_scalar(self, f: Callable[..., InnerScalar], name: str = "value", tags: bool = True) -> DataFrame:
        return f(self.outer, self.first, self.second).unlift(name, tags)

    def filter_outer(self, condition: Callable[[Column], Column]) -> NestedPair:
        kept = self.outer.df.where(condition(F.col("value")))
        ctx = self.ctx.restrict(kept)
        return NestedPair(InnerScalar(ctx, kept), *(InnerBag(ctx, joined(b.df, ctx.tags, ctx.names, "left_semi")) for b in (self.first, self.second)))


def _outer(ctx: Context) -> InnerScalar:
    """The key itself: one column's value, or a struct of several."""
    value = F.col(ctx.names[0]) if len(ctx.names) == 1 else F.struct(*ctx.names)
    return InnerScalar(ctx, ctx.tags.withColumn("value", value))


def _keyed(df: DataFrame, by: Sequence[str] | dict[str, Expr]) -> tuple[DataFrame, list[str]]:
    if isinstance(by, dict):
        return df.withColumns({n: _column(e) for n, e in by.items()}), list(by)
    return df, [by] if isinstance(by, str) else list(by)


def nest(df: DataFrame, by: Sequence[str] | dict[str, Expr] | str) -> Nested:
    """A flat DataFrame as groups. The data isn't moved; only the distinct keys are found, when needed."""
    df, names = _keyed(df, by)
    ctx = Context(df.select(*names).distinct(), names)
    return Nested(_outer(ctx), InnerBag(ctx, df))


def conest(a: DataFrame, b: DataFrame, by: Sequence[str] | str) -> NestedPair:
    """Two flat DataFrames grouped by the same keys; a key of either is a group."""
    names = [by] if isinstance(by, str) else list(by)
    ctx = Context(a.select(*names).union(b.select(*names)).distinct(), names)
    return NestedPair(_outer(ctx), InnerBag(ctx, a), InnerBag(ctx, b))


def lift_map(df: DataFrame, f: Callable[[InnerBag], InnerScalar], tag: str = "__element", name: str = "value") -> DataFrame:
    """``f`` for each row as a group of its own; the results as a flat DataFrame."""
    tagged = cut(df.withColumn(tag, F.monotonically_increasing_id()))
    return f(InnerBag(Context(tagged.select(tag), [tag]), tagged)).unlift(name, tags=False)
