"""The comprehension query language: nested queries in, one Catalyst plan out.

A comprehension's row context is a DataFrame with one column for each bound
variable.  Generators over bags are cross products with the conditions left in
``where``, from which Catalyst makes joins, whatever the nesting; generators over
arrays explode.  A correlated sub-query extends the (numbered) outer rows by its
own generators and is grouped back by row number with the monoid's zero for rows
without a match; ``some`` and ``all`` as conditions become semi and anti joins; an
uncorrelated sub-query becomes one row that is broadcast.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions import monoids
from tagloom.lang.syntax import Parser, free, pattern_vars
from tagloom.operators.control import repeat
from tagloom.session import cut

_fresh = itertools.count()


class Bag:
    """A distributed bag: a DataFrame whose column ``value`` holds the elements."""

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def of(cls, df: DataFrame) -> Bag:
        if df.columns == ["value"]:
            return cls(df)
        return cls(df.select((F.col(df.columns[0]) if len(df.columns) == 1 else F.struct(*df.columns)).alias("value")))

    def rows(self) -> DataFrame:
        """Flat columns: a struct's fields, else ``value``."""
        return self.df.select("value.*") if isinstance(self.df.schema["value"].dataType, T.StructType) else self.df


class Compiler:
    def __init__(self, spark: SparkSession, env: dict[str, object], ops: dict[str, Callable] | None = None):
        self.spark, self.env, self.ops = spark, env, ops or {}
        self.sources: dict[str, str] = {}  # what each generator's column iterates over

    def source(self, e) -> str:
        name = f"__g{next(_fresh)}"
        self.sources[name] = e[1] if e[0] == "var" else e[0]
        return name

    def lineage(self, df: DataFrame) -> Column:
        """The generators' elements that a row was made of."""
        return F.array(*[F.struct(F.lit(self.sources[c]).alias("source"), F.to_json(F.struct(F.col(c).alias("value"))).alias("row")) for c in df.columns if c in self.sources])

    # ---- values outside of rows
    def value(self, e):
        """A closed expression: a Bag, or a Column over no row."""
        return self.eval(e, Row(self.spark.range(1).select(F.lit(0).alias("__unit")), {}))[0]

    def scalar(self, e):
        """A closed expression's single value, on the driver."""
        if e[0] == "lit":
            return e[1]
        row = Row(self.spark.range(1).select(F.lit(0).alias("__unit")), {})
        v, row = self.eval(e, row)
        return v if isinstance(v, Bag) else row.df.select(v.alias("v")).first()[0]

    # ---- expressions; the row context may gain columns
    def eval(self, e, row: Row):
        kind = e[0]
        if kind == "lit":
            return F.lit(e[1]), row
        if kind == "var":
            if e[1] in row.vars:
                return row.vars[e[1]], row
            if e[1] not in self.env:
                raise NameError(f"unknown name {e[1]!r}")
            v = self.env[e[1]]
            if isinstance(v, DataFrame):
                return Bag.of(v), row
            return (F.lit(v) if not isinstance(v, (Column, Bag)) and not callable(v) and not isinstance(v, (list, tuple)) else F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else v), row
        if kind == "select":
            return self.select(e, row)
        if kind in ("some", "all"):
            op, zero = ("||", False) if kind == "some" else ("&&", True)
            return self.sub_reduce(monoids.get(op), ("select", False, e[2], e[1], None, None, None, None, None), row, zero)
        if kind == "reduce":
            return self.reduce(e[1], e[2], row)
        if kind in ("tuple", "record"):
            parts, out = [], []
            for i, x in enumerate(e[1]):
                name, x = (f"_{i + 1}", x) if kind == "tuple" else x
                v, row = self.eval(x, row)
                out.append(self.local(v).alias(name))
                parts.append(name)
            return F.struct(*out), row
        if kind == "list":
            vs = []
            for x in e[1]:
                v, row = self.eval(x, row)
                vs.append(v)
            return F.array(*vs), row
        if kind == "let":
            for p, x in e[1]:
                v, row = self.eval(x, row)
                row = row.with_vars(v if isinstance(v, Bag) else None, {p[1]: v}) if p[0] == "var" else self.bind(p, v, row)
            return self.eval(e[2], row)
        if kind == "if":
            (c, row), = [self.eval(e[1], row)]
            a, row = self.eval(e[2], row)
            b, row = self.eval(e[3], row)
            return F.when(c, a).otherwise(b), row
        if kind == "match":
            v, row = self.eval(e[1], row)
            arms = []
            for p, guard, x in e[2]:
                tests, names = match(p, v, row)
                inner = row.with_vars(None, names)
                if guard:
                    g, inner = self.eval(guard, inner)
                    tests.append(g)
                r, inner = self.eval(x, inner)
                row = Row(inner.df, row.vars)
                test = F.lit(True)
                for t in tests:
                    test = test & t
                arms.append((test, r))
            out = F.lit(None)
            for test, r in reversed(arms):
                out = F.when(test, r).otherwise(out)
            return out, row
        if kind in ("neg", "not"):
            v, row = self.eval(e[1], row)
            return (-v if kind == "neg" else ~v), row
        if kind == "field":
            v, row = self.eval(e[1], row)
            if isinstance(v, Bag):
                if e[2] == "head":  # with an order: the top row of each partition, then of these
                    return self.one_row(v.df.limit(1).withColumnRenamed("value", "__agg"), row)
                raise TypeError(f"a bag has no field {e[2]}")
            if e[2] in _OF_ARRAYS and isinstance(row.type_of(v), (T.ArrayType, type(None))):
                return _OF_ARRAYS[e[2]](v), row
            return v.getField(e[2]), row
        if kind == "index":
            v, row = self.eval(e[1], row)
            i, row = self.eval(e[2][0], row)
            return F.get(v, i), row
        if kind == "method":
            return self.method(e, row)
        if kind == "call":
            args = []
            for a in e[2]:
                v, row = self.eval(a, row)
                args.append(v)
            if e[1] == "range":
                return Bag(self.range_frame(e[2])), row
            if e[1] == "trace":  # shows a bag; a row's value can only be shown as a column
                if isinstance(args[0], Bag):
                    args[0].df.show()
                else:
                    print(f"trace: {args[0]}")
                return args[0], row
            f = self.env.get(e[1])
            if not callable(f):
                raise NameError(f"unknown function {e[1]!r}")
            out = f(*[a.rows() if isinstance(a, Bag) else a for a in args])
            return (Bag.of(out) if isinstance(out, DataFrame) else out), row
        if kind == "op":
            return self.operator(e, row)
        if kind == "repeat":
            return self.repeat(e), row
        raise SyntaxError(f"can't compile {kind}")

    def range_frame(self, args) -> DataFrame:
        n = [self.scalar(a) for a in args]
        step = n[2] if len(n) > 2 else 1
        return self.spark.range(n[0], n[1] + (1 if step > 0 else -1), step).withColumnRenamed("id", "value")

    def local(self, v) -> Column:
        if isinstance(v, Bag):
            raise TypeError("a distributed bag can't be a value of a row here: use a sub-query with a condition on the row")
        return v

    def method(self, e, row: Row):
        v, row = self.eval(e[1], row)
        name, args = e[2], e[3]
        casts = {"toInt": "int", "toLong": "long", "toDouble": "double", "toFloat": "float", "toString": "string"}
        if name in casts:
            return v.cast(casts[name]), row
        if args and args[0][0] == "lambda":
            var, body = args[0][1][0], args[0][2]
            if name == "reduce":
                one, two = args[0][1]
                both = lambda x, y: self.eval(body, row.with_vars(None, {one: x, two: y}))[0]
                if isinstance(v, Bag):
                    raise TypeError("reduce a bag by a monoid: op/bag")
                return F.when(F.size(v) > 0, F.aggregate(F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), F.get(v, F.lit(0)), both)), row
            f = lambda x: self.eval(body, row.with_vars(None, {var: x}))[0]
            if isinstance(v, Bag):
                x = self.eval(body, Row(v.df, row.vars | {var: F.col("value")}))[0]
                return Bag(v.df.where(x) if name == "filter" else v.df.select(x.alias("value"))), row
            return {"map": F.transform, "filter": F.filter, "exists": F.exists, "forall": F.forall}[name](v, f), row
        more = []
        for a in args:
            x, row = self.eval(a, row)
            more.append(x)
        if name == "take":
            return (Bag(v.df.limit(self.scalar(args[0]))) if isinstance(v, Bag) else F.slice(v, F.lit(1), more[0])), row
        f = self.env.get(name) or getattr(F, name)
        return f(v, *more), row

    def operator(self, e, row: Row):
        _, op, x, y = e
        if op in ("union", "intersect", "minus", "++"):
            a, row = self.eval(x, row)
            b, row = self.eval(y, row)
            if isinstance(a, Bag) or isinstance(b, Bag):
                a, b = (v if isinstance(v, Bag) else Bag(self.spark.range(1).select(F.explode(v).alias("value"))) for v in (a, b))
                if op in ("union", "++"):
                    return Bag(a.df.union(b.df)), row
                other = b.df.distinct().withColumnRenamed("value", "__v")
                how = "left_semi" if op == "intersect" else "left_anti"
                return Bag(a.df.join(other, F.col("value").eqNullSafe(F.col("__v")), how)), row
            keep = lambda v: F.array_contains(b, v)
            return (F.concat(a, b) if op in ("union", "++") else F.filter(a, keep) if op == "intersect" else F.filter(a, lambda v: ~keep(v))), row
        if op == "member":
            n = f"__m{next(_fresh)}"
            b = self.env.get(y[1]) if y[0] == "var" and y[1] not in row.vars else None
            if isinstance(b, DataFrame) or y[0] in ("select", "op"):
                return self.eval(("some", [("gen", ("var", n), y, False)], ("op", "==", ("var", n), x)), row)
        a, row = self.eval(x, row)
        b, row = self.eval(y, row)
        if op == "member":
            return F.array_contains(b, a), row
        if op in self.ops:
            return self.ops[op](a, b), row
        if op == "::":
            return F.concat(F.array(a), b), row
        if op == "/":
            whole = all(isinstance(row.type_of(v), T.IntegralType) for v in (a, b))
            return (F.try_divide(a, b).cast("bigint") if whole else F.try_divide(a.cast("double"), b.cast("double"))), row
        if op == "+" and any(isinstance(row.type_of(v), T.StringType) for v in (a, b)):
            return F.concat(a.cast("string"), b.cast("string")), row
        return {"==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "&&": lambda: a & b, "||": lambda: a | b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: a % b, "^": lambda: a.bitwiseXOR(b), "&": lambda: a.bitwiseAND(b), "|": lambda: a.bitwiseOR(b)}[op](), row

    # ---- comprehensions
    def bind(self, p, v: Column, row: Row) -> Row:
        tests, names = match(p, v, row)
        df = row.df
        for t in tests:
            df = df.where(t)
        return Row(df, row.vars | names).named(names)

    def quals(self, quals, where, row: Row) -> Row:
        conds = []
        for q in quals:
            if q[0] == "cond":
                conds.append(q[1])
            elif q[0] == "bind":
                v, row = self.eval(q[2], row)
                row = row.with_vars(None, {q[1][1]: v}) if isinstance(v, Bag) and q[1][0] == "var" else self.bind(q[1], v, row)
            else:
                v, row = self.eval(q[2], row)
                name = self.source(q[2])
                if isinstance(v, Bag):
                    side = v.df.withColumnRenamed("value", name)
                    if q[3] and estimated_bytes(side) <= SMALL_BYTES:  # a marked small side ("<--") is broadcast if it is one
                        side = F.broadcast(side)
                    row = Row(row.df.crossJoin(side), row.vars)
                else:
                    row = Row(row.df.withColumn(name, F.explode(v)), row.vars)
                row = self.bind(q[1], F.col(name), row)
        for c in [*conds, *([where] if where else [])]:
            for part in conjuncts(c):
                row = self.filter(part, row)
        return row

    def filter(self, c, row: Row) -> Row:
        if c[0] in ("some", "all") or c[0] == "not" and c[1][0] in ("some", "all"):
            flip, c = (c[0] == "not", c[1]) if c[0] == "not" else (False, c)
            gens = [q for q in c[1] if q[0] == "gen"]
            simple = len(c[1]) == 1 and len(gens) == 1 and not has_query(c[2])
            if simple and not (free(gens[0][2]) & row.vars.keys()):
                side, _ = self.eval(gens[0][2], row)
                if isinstance(side, Bag):
                    name = f"__g{next(_fresh)}"
                    inner = self.bind(gens[0][1], F.col(name), Row(side.df.withColumnRenamed("value", name), {}))
                    test, _ = self.eval(c[2], Row(row.df.crossJoin(inner.df), row.vars | inner.vars))
                    if c[0] == "all":
                        test = ~F.coalesce(test, F.lit(False))
                    return Row(row.df.join(inner.df, test, "left_semi" if (c[0] == "some") != flip else "left_anti"), row.vars)
            c = ("not", c) if flip else c
        v, row = self.eval(c, row)
        return Row(row.df.where(v), row.vars)

    def select(self, e, row: Row):
        """A bag, if it depends on no variable of a row; else an array for each row."""
        if free(e) & row.vars.keys():
            row, key = numbered(row)
            value, df = self.correlated(e, row, key)
            got = df.groupBy(key).agg(F.collect_list(value).alias("__agg"))
            return self.back(row, got, key, lambda c: F.coalesce(c, F.array()))
        return Bag(self.comprehension(e, Row(self.spark.range(1).select(F.lit(0).alias("__unit")), {}))), row

    def comprehension(self, e, base: Row) -> DataFrame:
        _, distinct, head, quals, where, group, second, having, order = e
        if len(quals) and quals[0][0] == "gen" and not base.vars:
            first, _ = self.eval(quals[0][2], base)
            if isinstance(first, Bag):  # start from the first bag, not from a product with one row
                name = self.source(quals[0][2])
                base, quals = self.bind(quals[0][1], F.col(name), Row(first.df.withColumnRenamed("value", name), {})), quals[1:]
        row = self.quals(quals, where, base)
        if group:
            return self.grouped(e, row)
        if order:
            keys = []
            for x, desc in order:
                k, row = self.eval(x, row)
                keys.append(k.desc() if desc else k)
            v, row = self.eval(head, row)
            out = row.df.select(self.local(v).alias("value"), *[k.alias(f"__k{i}") for i, k in enumerate([self.eval(x, row)[0] for x, _ in order])])
            out = out.distinct() if distinct else out
            return out.orderBy(*[F.col(f"__k{i}").desc() if d else F.col(f"__k{i}") for i, (_, d) in enumerate(order)]).select("value")
        v, row = self.eval(head, row)
        out = row.df.select(self.local(v).alias("value"))
        return out.distinct() if distinct else out

    def grouped(self, e, row: Row, by: list[str] | None = None, outer: dict[str, Column] | None = None) -> DataFrame:
        """Groups of a select; ``by`` are further key columns, which stay, and ``outer`` the variables that they decide."""
        by, outer = by or [], outer or {}
        _, distinct, head, quals, where, (pattern, key), second, having, order = e
        sides = [(row, pattern, key)]
        if second:
            q2, w2, (p2, k2) = second
            sides.append((self.quals(q2, w2, Row(self.spark.range(1).select(F.lit(0).alias("__unit")), {})), p2, k2))
        exprs = [head, *([having] if having else []), *[o[0] for o in order or []]]
        frames, names, all_reduces = [], {}, {}
        for s, (r, p, k) in enumerate(sides):
            if k is None:
                k = ("var", p[1]) if p[0] == "var" else ("tuple", [("var", x[1]) for x in p[1]])
            v, r = self.eval(k, r)
            keys = pattern_vars(p)
            lifted = {n: c for n, c in r.vars.items() if n not in keys and n not in outer}
            aggs: dict[str, tuple] = {}
            for x in exprs:
                for red in reductions(x, set(lifted)):
                    m = monoids.get(red[1])
                    arg, _ = self.eval(red[2], Row(r.df, r.vars)) if red[1] != "count" else (F.lit(1), None)
                    all_reduces[repr(red)] = name = f"__a{len(all_reduces)}"
                    aggs[name] = (m.agg(arg), m.zero)
            reduced = {repr(red) for x in exprs for red in reductions(x, set(lifted))}
            for n in sorted(set().union(*[loose(x, reduced) for x in exprs]) & lifted.keys()):
                aggs[f"__l{s}_{n}"] = (F.collect_list(lifted[n]), None)
                names[n] = f"__l{s}_{n}"
            used = set().union(*[free(x) for x in exprs]) & outer.keys()
            for n in sorted(used):
                aggs[f"__o{s}_{n}"] = (F.first(outer[n]), None)
                names[n] = f"__o{s}_{n}"
            got = r.df.groupBy(*by, v.alias("__key")).agg(*[a.alias(n) for n, (a, _) in aggs.items()]) if aggs else r.df.select(*by, v.alias("__key")).distinct()
            frames.append((got, aggs))
        if len(frames) == 1:
            df = frames[0][0]
        else:
            a, b = frames[0][0], frames[1][0].withColumnRenamed("__key", "__key2")
            df = a.join(b, F.col("__key").eqNullSafe(F.col("__key2")), "full_outer").withColumn("__key", F.coalesce("__key", "__key2"))
            for _, aggs in frames:
                df = df.withColumns({n: F.coalesce(F.col(n), F.lit(z)) if z is not None else F.coalesce(F.col(n), F.array()) if n.startswith("__l") else F.col(n) for n, (_, z) in aggs.items()})
        known = Row(df, {n: F.col(c) for n, c in names.items()})
        known = self.bind(pattern, F.col("__key"), known)
        swap = lambda x: substitute(x, all_reduces)
        known = Row(known.df, known.vars | {n: F.col(n) for n in all_reduces.values()})
        if having:
            h, known = self.eval(swap(having), known)
            known = Row(known.df.where(h), known.vars)
        ks = []
        for x, desc in order or []:
            k, known = self.eval(swap(x), known)
            ks.append((k, desc))
        v, known = self.eval(swap(head), known)
        out = known.df.select(*by, v.alias("value"), *[k.alias(f"__k{i}") for i, (k, _) in enumerate(ks)])
        out = out.distinct() if distinct else out
        if ks:
            out = out.orderBy(*[F.col(f"__k{i}").desc() if d else F.col(f"__k{i}") for i, (_, d) in enumerate(ks)])
        return out.select(*by, "value")

    # ---- reductions and sub-queries
    def reduce(self, op: str, e, row: Row):
        m = monoids.get(op)
        if e[0] == "select":
            return self.sub_reduce(m, e, row, m.zero)
        v, row = self.eval(e, row)
        if isinstance(v, Bag):
            got = v.df.agg(m.agg(F.lit(1) if op == "count" else F.col("value")).alias("__agg"))
            return self.one_row(got, row)
        if op == "count":
            return F.size(v).cast("long"), row
        if op == "avg":
            return F.try_divide(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), F.size(v).cast("double")), row
        if op in ("min", "max"):
            return (F.array_min if op == "min" else F.array_max)(v), row
        return m.fold(v), row

    def one_row(self, got: DataFrame, row: Row):
        name = f"__s{next(_fresh)}"
        # one row, by construction
        return F.col(name), Row(row.df.crossJoin(F.broadcast(got.withColumnRenamed("__agg", name))), row.vars)

    def correlated(self, e, row: Row, key: str) -> tuple[Column, DataFrame]:
        """The sub-query's elements for each outer row (numbered by ``key``)."""
        _, distinct, head, quals, where, group, second, *_ = e
        if second:
            raise SyntaxError("a correlated sub-query with two groupings isn't supported")
        inner = self.quals(quals, where, row)
        if group:  # groups of the outer row: its number is one more key
            return F.col("value"), self.grouped(e, Row(inner.df, inner.vars), [key], row.vars)
        v, inner = self.eval(head, inner)
        if distinct:
            return F.col("value"), inner.df.select(key, v.alias("value")).distinct()
        return v, inner.df

    def sub_reduce(self, m: monoids.Monoid, e, row: Row, zero):
        if not (free(e) & row.vars.keys()):
            df = self.comprehension(e, Row(self.spark.range(1).select(F.lit(0).alias("__unit")), {}))
            return self.one_row(df.agg(m.agg(F.lit(1) if m.name == "count" else F.col("value")).alias("__agg")), row)
        row, key = numbered(row)
        value, df = self.correlated(e, row, key)
        got = df.groupBy(key).agg(m.agg(F.lit(1) if m.name == "count" else value).alias("__agg"))
        return self.back(row, got, key, lambda c: F.coalesce(c, F.lit(zero)) if zero is not None else c)

    def back(self, row: Row, got: DataFrame, key: str, default: Callable[[Column], Column]):
        name, other = f"__s{next(_fresh)}", f"__r{next(_fresh)}"
        side = got.withColumnsRenamed({"__agg": name, key: other})
        df = row.df.join(side, F.col(key) == F.col(other), "left").drop(other)
        return default(F.col(name)), Row(df, row.vars)

    def repeat(self, e):
        _, p, init, step, until, limit = e
        names = [p[1]] if p[0] == "var" else [x[1] for x in p[1]]
        inits = [init] if p[0] == "var" else init[1]
        steps = [step] if p[0] == "var" else step[1]
        start = {}
        for n, x in zip(names, inits, strict=True):
            v = self.value(x)
            start[n] = v.df if isinstance(v, Bag) else self.spark.range(1).select(F.explode(v).alias("value"))

        def run(s):
            inner = Compiler(self.spark, self.env | s, self.ops)
            out = {}
            for n, x in zip(names, steps, strict=True):
                v = inner.value(x)
                out[n] = v.df if isinstance(v, Bag) else self.spark.range(1).select(F.explode(v).alias("value"))
            return out

        test = None if until is None else lambda s: Compiler(self.spark, self.env | s, self.ops).scalar(until)
        out = repeat(start, run, test, None if limit is None else self.scalar(limit))
        return Bag(out[names[0]]) if len(names) == 1 else tuple(Bag(out[n]) for n in names)


_OF_ARRAYS: dict[str, Callable[[Column], Column]] = {
    "length": F.size,
    "size": F.size,
    "head": lambda v: F.get(v, F.lit(0)),
    "last": lambda v: F.element_at(v, -1),
    "tail": lambda v: F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))),
    "isEmpty": lambda v: F.size(v) == 0,
    "nonEmpty": lambda v: F.size(v) > 0,
    "sum": lambda v: monoids.get("+").fold(v),
    "distinct": F.array_distinct,
    "reverse": F.reverse,
}


class Row:
    """A row context: a DataFrame and the Column of each variable."""

    def __init__(self, df: DataFrame, names: dict[str, Column]):
        self.df, self.vars = df, names

    def with_vars(self, _, names: dict[str, object]) -> Row:
        return Row(self.df, self.vars | names)

    def named(self, names: dict[str, Column]) -> Row:
        """The new variables as columns of their own, so that later joins can't confuse them."""
        fresh = {n: f"__v{next(_fresh)}_{n}" for n in names}
        return Row(self.df.withColumns({fresh[n]: c for n, c in names.items()}), self.vars | {n: F.col(fresh[n]) for n in names})

    def type_of(self, c: Column):
        try:
            return self.df.select(c.alias("x")).schema["x"].dataType
        except Exception:  # noqa: BLE001  a lambda's variable has no type outside of its lambda
            return None


def numbered(row: Row) -> tuple[Row, str]:
    """The rows with a number, and its column; each sub-query has one of its own, so they can be nested."""
    key = f"__row{next(_fresh)}"
    return Row(cut(row.df.withColumn(key, F.monotonically_increasing_id())), row.vars), key


SMALL_BYTES = 10_000_000  #: a marked side is broadcast up to this size


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def match(p, v: Column, row: Row) -> tuple[list[Column], dict[str, Column]]:
    """Conditions under which a pattern fits a value, and its variables; a tuple pattern goes by position."""
    kind = p[0]
    if kind == "any":
        return [], {}
    if kind == "var":
        return [], {p[1]: v}
    if kind == "lit":
        return [v == F.lit(p[1])], {}
    if kind == "as":
        tests, names = match(p[2], v, row)
        return tests, names | {p[1]: v}
    if kind == "tuple":
        kind = row.type_of(v)
        fields = kind.names if isinstance(kind, T.StructType) else [f"_{i + 1}" for i in range(len(p[1]))]
        if len(fields) != len(p[1]):
            raise TypeError(f"a pattern of {len(p[1])} for a tuple of {len(fields)}")
        tests, names = [], {}
        for i, x in enumerate(p[1]):
            t, n = match(x, v.getField(fields[i]), row)
            tests += t
            names |= n
        return tests, names
    if kind == "list":
        fixed = [x for x in p[1] if x[0] != "rest"]
        open_end = len(fixed) < len(p[1])  # rest@_* at the end
        tests, names = [F.size(v) >= len(fixed) if open_end else F.size(v) == len(fixed)], {}
        for i, x in enumerate(fixed):
            t, n = match(x, F.get(v, F.lit(i)), row)
            tests += t
            names |= n
        if open_end:
            names[p[1][-1][1]] = F.slice(v, F.lit(len(fixed) + 1), F.greatest(F.size(v) - len(fixed), F.lit(0)))
        return tests, names
    head, rest = match(p[1], F.get(v, F.lit(0)), row), match(p[2], F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), row)
    return [F.size(v) > 0, *head[0], *rest[0]], head[1] | rest[1]


def conjuncts(c) -> list:
    return conjuncts(c[2]) + conjuncts(c[3]) if c[0] == "op" and c[1] == "&&" else [c]


def has_query(e) -> bool:
    return e[0] in ("select", "some", "all", "reduce") or any(has_query(x) for x in e[1:] if isinstance(x, tuple) and x and isinstance(x[0], str)) or any(has_query(y) for x in e[1:] if isinstance(x, list) for y in x if isinstance(y, tuple) and y and isinstance(y[0], str))


def children(e) -> list:
    out = []
    for x in e[1:]:
        if isinstance(x, tuple) and x and isinstance(x[0], str):
            out.append(x)
        elif isinstance(x, list):
            out += [y if isinstance(y[0], str) and not (len(y) == 2 and isinstance(y[1], tuple) and e[0] == "record") else y[1] for y in x if isinstance(y, tuple) and y]
    return out


def reductions(e, lifted: set[str]) -> list:
    """Reductions whose argument is made of lifted variables: they become aggregates of the group."""
    if e[0] == "reduce" and not has_query(e[2]) and free(e[2]) & lifted:
        return [e]
    if e[0] in ("select", "some", "all"):
        return []
    return [r for x in children(e) for r in reductions(x, lifted)]


def loose(e, reduced: set[str]) -> set[str]:
    """Variables that are used outside of those reductions."""
    if repr(e) in reduced:
        return set()
    if e[0] in ("select", "some", "all", "var"):
        return free(e)
    return set().union(*[loose(x, reduced) for x in children(e)]) if children(e) else set()


def substitute(e, names: dict[str, str]):
    if not isinstance(e, tuple):
        return [substitute(x, names) for x in e] if isinstance(e, list) else e
    if e and isinstance(e[0], str) and repr(e) in names:
        return ("var", names[repr(e)])
    return tuple(substitute(x, names) if isinstance(x, (tuple, list)) else x for x in e)


def query(spark: SparkSession, text: str, explain: bool = False, ops: dict[str, Callable] | None = None, **env: object) -> DataFrame | tuple[DataFrame, ...]:
    """One query as a DataFrame (a ``repeat`` over several bags: one for each); ``env``: DataFrames, values and functions on Columns by name."""
    parser = Parser(text, {n for n in monoids._MONOIDS if n.isidentifier()}, {o: 6 for o in ops or {}})
    tree = parser.expr()
    parser.take("")
    compiler = Compiler(spark, env, ops)
    row = Row(spark.range(1).select(F.lit(0).alias("__unit")), {})
    v, row = compiler.eval(tree, row)
    if isinstance(v, tuple):  # a repeat over several bags
        return tuple(b.rows() for b in v)
    out = v.rows() if isinstance(v, Bag) else row.df.select(v.alias("value"))
    if explain:
        print(tree)
        out.explain("formatted")
    return out


def debug(spark: SparkSession, text: str, erased: bool = False, **env: object) -> DataFrame:
    """``value, kept, lineage`` of a select: each result with the generators' elements behind it.

    With ``erased`` rows that the condition drops stay, with ``kept`` false. A
    grouped select's lineage is that of the whole group.
    """
    parser = Parser(text, {n for n in monoids._MONOIDS if n.isidentifier()})
    e = parser.expr()
    parser.take("")
    if e[0] != "select":
        raise SyntaxError("debug needs a select")
    _, _, head, quals, where, group, *_ = e
    compiler = Compiler(spark, env)
    row = compiler.quals(quals, None if erased else where, Row(spark.range(1).select(F.lit(0).alias("__unit")), {}))
    kept = F.lit(True)
    if erased and where:
        test, row = compiler.eval(where, row)
        kept = F.coalesce(test, F.lit(False))
    if group:
        p, k = group
        key, row = compiler.eval(k or (("var", p[1]) if p[0] == "var" else ("tuple", [("var", x[1]) for x in p[1]])), row)
        every = F.array_sort(F.flatten(F.collect_list(compiler.lineage(row.df))))
        return row.df.where(kept).groupBy(key.alias("value")).agg(F.lit(True).alias("kept"), every.alias("lineage"))
    value, row = compiler.eval(head, row)
    return row.df.select(value.alias("value"), kept.alias("kept"), compiler.lineage(row.df).alias("lineage"))


def queries(spark: SparkSession, text: str, **env: object) -> list[DataFrame]:
    """Several queries, separated by semicolons."""
    return [query(spark, part, **env) for part in text.split(";") if part.strip()]


def define(text: str) -> Callable:
    """A query macro ``def f(x, y) = query`` as a function of (spark, x, y)."""
    head, _, body = text.strip().removeprefix("def ").partition("=")
    name, _, params = head.strip().rstrip(")").partition("(")
    names = [p.split(":")[0].strip() for p in params.split(",") if p.strip()]

    def macro(spark: SparkSession, *args: object, **env: object) -> DataFrame:
        return query(spark, body, **(env | dict(zip(names, args, strict=True))))

    macro.__name__ = name.strip()
    return macro
