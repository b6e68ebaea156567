"""The loop language: imperative programs over sparse arrays, run as bulk operations.

    var C: matrix[Double] = matrix();
    for i = 0, n-1 do
      for j = 0, n-1 do { C[i,j] := 0.0; for k = 0, n-1 do C[i,j] += A[i,k]*B[k,j]; };

Every statement runs for all iterations of its loops at once, before the next
statement starts.  A loop over a range isn't a product with the range: an array
that is read at an index is scanned, the loop variable is taken from its index,
and the range becomes a condition.  Two reads of one array at the same index
share one scan.  Where two matrices share one index that is added up (a matrix
product), and the products outnumber what two grids of blocks hold, the blocks
travel and the products are combined where they arise.  What the last statement
writes is not cut: its plan can't grow any more.  Reads of absent cells contribute nothing; ``:=`` on an array is
a right-biased merge, ``+=`` groups by the destination and merges with the
operator.  ``x := x + e`` is an increment for associative operators; ``x := x - e``
adds -e; other such updates inside of a loop are errors.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import monoids
from tagloom.functions.columns import in_range
from tagloom.lang.query import Bag, Compiler, Row, conjuncts
from tagloom.lang.syntax import Parser, free
from tagloom.operators.arrays import index_columns, merge
from tagloom.session import cut

_fresh = itertools.count()
_EXTENTS = {"length": "i", "rows": "i", "cols": "j"}
_ZEROS = {"Int": 0, "Long": 0, "Double": 0.0, "Boolean": False, "String": ""}
_SQL = {"Int": "int", "Long": "bigint", "Double": "double", "Boolean": "boolean", "String": "string"}


class LoopParser(Parser):
    def program(self) -> list:
        out = []
        while self.tok != "" or self.kind() == "str":
            out.append(self.statement())
            while self.maybe(";"):
                pass
        return out

    def statement(self):
        if self.maybe("{"):
            body = []
            while self.tok != "}":
                body.append(self.statement())
                while self.maybe(";"):
                    pass
            self.take("}")
            return ("block", body)
        if self.maybe("var"):
            n = self.name()
            self.take(":")
            kind = self.type()
            return ("var", n, kind, self.expr() if self.maybe("=") else None)
        if self.kind() == "id" and self.tok == "external":  # given by the caller
            self.take()
            n = self.name()
            self.take(":")
            return ("external", n, self.type())
        if self.kind() == "id" and self.tok == "def":
            return self.function()
        if self.tok == "for":
            self.take()
            n = self.pattern()
            if self.maybe("in"):
                source = ("in", self.expr())
            else:
                self.take("=")
                source = ("range", self.many(self.expr))
            self.take("do")
            return ("for", n, source, self.statement())
        if self.maybe("while"):
            self.take("(")
            c = self.expr()
            self.take(")")
            return ("while", c, self.statement())
        if self.maybe("if"):
            self.take("(")
            c = self.expr()
            self.take(")")
            then, other = self.statement(), None
            at = self.i
            while self.maybe(";"):
                pass
            if self.maybe("else"):
                other = self.statement()
            else:
                self.i = at
            return ("if", c, then, other)
        at = self.i
        dest = self.postfix(self.atom())
        if self.tok not in (":=", "+=", "*=", "&&=", "||="):  # no destination: an expression by itself
            self.i = at
            return ("expr", self.expr())
        op = self.take(":=", "+=", "*=", "&&=", "||=")
        e = self.expr()
        if op != ":=":
            return ("inc", dest, op[:-1], e)
        if e[0] == "op" and e[2] == dest and e[1] in ("+", "*", "&&", "||", "-", "/", *self.monoids, *self.extra):
            if e[1] == "-":
                return ("inc", dest, "+", ("neg", e[3]))
            if e[1] in monoids._MONOIDS:
                return ("inc", dest, e[1], e[3])
            return ("set", dest, e)
        return ("set", dest, e)

    extra: tuple = ()

    def function(self):
        """``def f(a: T, ...): T return e``; the body may be a block that declares variables first."""
        self.take("def")
        n = self.name()
        self.take("(")
        params = self.many(lambda: (self.name(), self.take(":"), self.type())[0], ")")
        self.take(")")
        self.take(":")
        self.type()
        block, local = self.maybe("{"), []
        while block and self.maybe("var"):
            x = self.name()
            self.take(":")
            self.type()
            self.take("=")
            local.append((("var", x), self.expr()))
            self.take(";")
        self.take("return")
        e = self.expr()
        if local:
            e = ("let", local, e)
        if block:
            self.maybe(";")
            self.take("}")
        return ("def", n, params, e)

    def type(self):
        n = self.take() if self.tok != "(" else ""
        if self.maybe("[") or not n and self.maybe("("):
            args = self.many(self.type)
            self.take("]", ")")
            return (n or "tuple", args)
        return (n, [])


class Program:
    """Runs a parsed program; ``env`` holds arrays (DataFrames), values, and functions on Columns."""

    BLOCK, BLOCKED_FROM = 16_000_000, 100_000_000  #: products of a block; products from which there are blocks

    def __init__(self, spark: SparkSession, env: dict[str, object], ops=None):
        self.last = False
        self.spark, self.env, self.ops = spark, dict(env), ops or {}
        self.kinds: dict[str, tuple] = {}
        self.extents: dict[tuple[str, str], tuple[DataFrame, int]] = {}

    def run(self, statements: list) -> dict[str, object]:
        for k, s in enumerate(statements):
            inner = s
            while inner[0] == "for":
                inner = inner[3]
            self.last = k == len(statements) - 1 and inner[0] in ("inc", "set")
            self.execute(s, [])
        return self.env

    # ---- statements, under the loops and conditions around them
    def execute(self, s, around: list) -> None:
        kind = s[0]
        if kind == "block":
            for group in self.fused(s[1], around):
                if len(group) > 1:
                    self.increments(group, around)
                else:
                    self.execute(group[0], around)
        elif kind == "var":
            self.declare(s)
        elif kind == "external":
            if s[1] not in self.env:
                raise NameError(f"{s[1]} is external, but wasn't given")
            self.kinds[s[1]] = s[2]
        elif kind == "def":
            _, n, params, e = s
            self.env[n] = lambda *args: Compiler(self.spark, self.env, self.ops).eval(e, Row(self.spark.range(1), dict(zip(params, args, strict=True))))[0]
        elif kind == "for":
            self.execute(s[3], [*around, ("loop", s[1], s[2])])
        elif kind == "if":
            if not around:  # decided once, so the else branch can't see what the then branch did
                if self.scalar(s[1]):
                    self.execute(s[2], around)
                elif s[3]:
                    self.execute(s[3], around)
                return
            before = dict(self.env)
            self.execute(s[2], [*around, ("cond", s[1], before)])
            if s[3]:
                self.execute(s[3], [*around, ("cond", ("not", s[1]), before)])
        elif kind == "while":
            if around:
                raise SyntaxError("while inside for")
            while self.scalar(s[1]):
                self.execute(s[2], [])
        elif kind == "expr":
            if around:
                raise SyntaxError("an expression's value would be lost inside a loop or condition")
            Compiler(self.spark, self.env, self.ops).value(self.sized(s[1], self.env))
        else:
            self.assign(s, around)

    def fused(self, statements: list, around: list) -> list[list]:
        """Runs of scalar increments inside a loop that read the same array cells and none of each other's targets."""
        out: list[list] = []
        for x in statements:
            alone = not around or x[0] != "inc" or x[1][0] != "var" or isinstance(self.env.get(x[1][1]), DataFrame)
            if not alone and out and out[-1][0][0] == "inc" and out[-1][0][1][0] == "var":
                before = out[-1]
                seen: list[dict] = [{}, {}]
                self.reads(before[0][3], seen[0])
                self.reads(x[3], seen[1])
                targets = {y[1][1] for y in before}
                if seen[0].keys() == seen[1].keys() and not targets & (free(x[3]) | {x[1][1]}):
                    before.append(x)
                    continue
            out.append([x])
        return out

    def increments(self, group: list, around: list) -> None:
        """Several scalar increments by one aggregate over one scan."""
        row, values = self.context(around, [x[3] for x in group])
        out = row.df.agg(*[self.grown(x[1][1], monoids.get(x[2]), v).alias(x[1][1]) for x, v in zip(group, values, strict=True)]).first()
        self.env |= out.asDict()

    def grown(self, target: str, m: monoids.Monoid, value: Column) -> Column:
        """A scalar with all iterations' values combined into it, within the aggregate."""
        old, got = self.env[target], m.agg(value, zero=False)
        if old is None:
            return got
        return F.when(got.isNull(), F.lit(old)).otherwise(m.combine(F.lit(old), got))

    def scalar(self, e):
        return Compiler(self.spark, self.env, self.ops).scalar(self.sized(e, self.env))

    def sized(self, e, env: dict[str, object]):
        """``V.length``, ``M.rows`` and ``M.cols`` as numbers: one more than the largest index."""
        if isinstance(e, list):
            return [self.sized(x, env) for x in e]
        if not isinstance(e, tuple) or not e:
            return e
        if e[0] == "field" and e[1][0] == "var" and e[2] in _EXTENTS:
            array, index = env.get(e[1][1]), _EXTENTS[e[2]]
            if isinstance(array, DataFrame) and index in array.columns and "v" in array.columns:
                df, n = self.extents.get((e[1][1], index), (None, 0))
                if df is not array:
                    n = array.agg(F.coalesce(F.max(index) + 1, F.lit(0))).first()[0]
                    self.extents[e[1][1], index] = (array, n)
                return ("lit", n)
        return tuple(self.sized(x, env) for x in e)

    def declare(self, s) -> None:
        _, n, (kind, args), init = s
        self.kinds[n] = (kind, args)
        if kind in ("vector", "matrix", "map"):
            if init is None or init[0] == "call" and init[1] == kind and not init[2]:
                value = _SQL.get(args[-1][0], "double")
                index = "i bigint" if kind == "vector" else "i bigint, j bigint" if kind == "matrix" else f"k {_SQL.get(args[0][0], 'string')}"
                self.env[n] = self.spark.createDataFrame([], f"{index}, v {value}")
                self.env[n]._tagloom_empty = True
            else:
                self.env[n] = self.env[init[1]]
        elif init is not None:
            self.env[n] = self.scalar(init)
        else:
            self.env[n] = _ZEROS.get(kind)

    def assign(self, s, around: list) -> None:
        _, dest, *rest = s
        op, e = rest if s[0] == "inc" else (None, rest[0])
        target = dest[1] if dest[0] == "var" else dest[1][1]
        indices = [] if dest[0] == "var" else dest[2]
        if not around and dest[0] == "var":
            if isinstance(self.env.get(target), DataFrame):
                v = Compiler(self.spark, self.env, self.ops).value(e)
                self.env[target] = v.rows() if isinstance(v, Bag) else self.env[target]
            elif op is None:
                self.env[target] = self.scalar(e)
            else:
                self.env[target] = self.scalar(("op", op, dest, e) if op not in self.ops else ("op", op, dest, e))
            return
        if op is None and dest[0] == "var":
            raise SyntaxError(f"{target} := ... inside a loop has no order: use an increment")
        if op is not None and len(indices) == 2 and (new := self.product(target, op, indices, e, around)) is not None:
            self.write(target, new, op)
            return
        row, columns = self.context(around, [*indices, e])
        *at, value = columns
        if dest[0] == "var":
            self.env[target] = row.df.agg(self.grown(target, monoids.get(op), value).alias("v")).first()[0]
            return
        old = self.env[target]
        keys = index_columns(old)
        new = row.df.select(*[c.alias(k) for c, k in zip(at, keys, strict=True)], value.cast(old.schema["v"].dataType).alias("v"))
        if op is not None:
            new = new.groupBy(*keys).agg(monoids.get(op).agg(F.col("v"), zero=False).alias("v"))
        elif not self.unique(indices, around):
            new = new.groupBy(*keys).agg(F.max("v").alias("v"))  # no order among iterations: the largest
        self.write(target, new, op)

    def write(self, target: str, new: DataFrame, op: str | None) -> None:
        """The cells of ``new`` merged into an array; an array that is still empty becomes ``new``."""
        old = self.env[target]
        out = new.select(*[F.col(f.name).cast(f.dataType) for f in old.schema]) if getattr(old, "_tagloom_empty", False) else merge(old, new, op)
        self.env[target] = out if self.last else cut(out)

    def product(self, target: str, op: str, indices: list, e, around: list) -> DataFrame | None:
        """``C[p,q] += e`` over p, q, k where e reads X at p and k and Y at k and q, by blocks; None where that isn't the form, or isn't less.

        Rows of X are dealt to R row blocks and copied for each of C column blocks, those
        of Y the other way round; a task joins and combines all products of its cells.
        """
        if any(a[0] != "loop" or a[1][0] != "var" or a[2][0] != "range" for a in around):
            return None
        ranges = {a[1][1]: self.sized(a[2][1], self.env) for a in around}
        seen: dict[str, str] = {}
        value = self.reads(self.sized(e, self.env), seen)
        found = [(name, *self.keys[k]) for k, name in seen.items()]
        if len(found) != 2 or any(len(i) != 2 or any(v[0] != "var" for v in i) for _, _, i in found) or any(v[0] != "var" for v in indices):
            return None
        names = [[v[1] for v in i] for _, _, i in found]
        both, every, dest = set(names[0]) & set(names[1]), {*names[0], *names[1]}, [v[1] for v in indices]
        if len(both) != 1 or len(every) != 3 or every != ranges.keys() or len(around) != 3 or len(set(dest)) != 2 or set(dest) != every - both or any(free(b) & every for r in ranges.values() for b in r):
            return None
        shared, compiler, sides = both.pop(), Compiler(self.spark, self.env, self.ops), []
        for (_, array, _), own, index, read in zip(found, names, ("__p", "__q"), ("__a", "__b"), strict=True):
            df = self.env[array]
            x = df.select(*[F.col(c).cast("long").alias("__k" if v == shared else index) for c, v in zip(index_columns(df), own, strict=True)], F.col("v").alias(read))
            for v, c in ((shared, "__k"), (next(v for v in own if v != shared), index)):
                x = x.where(in_range(F.col(c), *[compiler.eval(b, Row(x, {}))[0] for b in ranges[v]]))
            sides.append(x)
        x, y = sides
        counts = x.groupBy("__k").agg(F.count("*").alias("m")).join(y.groupBy("__k").agg(F.count("*").alias("n")), "__k")
        total, m, n, low, high = counts.agg(F.sum(F.col("m").cast("double") * F.col("n")), F.sum("m"), F.sum("n"), F.min("__k"), F.max("__k")).first()
        if total is None or total <= self.BLOCKED_FROM:
            return None
        blocks = math.ceil(total / self.BLOCK)
        rows = min(blocks, max(1, round(math.sqrt(blocks * m / n))))
        cols = math.ceil(blocks / rows)
        if m * cols + n * rows >= total:
            return None
        block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
        copies = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        x = x.where(F.col("__k").between(low, high)).withColumn("__r", block("__p", rows)).withColumn("__c", copies(cols))
        y = y.where(F.col("__k").between(low, high)).withColumn("__c", block("__q", cols)).withColumn("__r", copies(rows))
        tasks = 4 * rows * cols  # few blocks share a task
        # else the join deals both sides anew by all its keys, and all products are dealt once more by their cells
        self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        df = x.repartition(tasks, "__r", "__c").join(y.repartition(tasks, "__r", "__c"), ["__r", "__c", "__k"])
        at = {shared: F.col("__k"), **{v: F.col(c) for own, c in zip(names, ("__p", "__q"), strict=True) for v in own if v != shared}}
        got, row = compiler.eval(value, Row(df, at | {found[0][0]: F.col("__a"), found[1][0]: F.col("__b")}))
        old = self.env[target]
        keys = index_columns(old)
        new = row.df.select("__r", "__c", *[at[v].alias(k) for v, k in zip(dest, keys, strict=True)], got.cast(old.schema["v"].dataType).alias("v"))
        return new.groupBy("__r", "__c", *keys).agg(monoids.get(op).agg(F.col("v"), zero=False).alias("v")).select(*keys, "v")

    @staticmethod
    def unique(indices: list, around: list) -> bool:
        """Whether every iteration writes its own cell: the indices are just the loops' variables."""
        loops = [a[1] for a in around if a[0] == "loop"]
        return all(p[0] == "var" for p in loops) and {i[1] for i in indices if i[0] == "var"} == {p[1] for p in loops} and all(i[0] == "var" for i in indices)

    # ---- the rows of all iterations
    def context(self, around: list, exprs: list) -> tuple[Row, list[Column]]:
        row = Row(self.spark.range(1).select(F.lit(0).alias("__unit")), {})
        ranges, conds, before = {}, [], self.env
        compiler = Compiler(self.spark, self.env, self.ops)
        around = [("cond", self.sized(a[1], a[2]), a[2]) if a[0] == "cond" else ("loop", a[1], self.sized(a[2], self.env)) for a in around]
        exprs = [self.sized(x, self.env) for x in exprs]
        for a in around:
            if a[0] == "cond":
                conds += conjuncts(a[1])
                before = a[2]
            elif a[2][0] == "in":
                row = self.scan(a[1], a[2][1], row, compiler)
            else:
                ranges[a[1][1]] = a[2][1]
        seen: dict[str, str] = {}
        exprs = [self.reads(x, seen) for x in exprs]
        conds = [self.reads(x, seen) for x in conds]
        todo = [(name, eval_key) for eval_key, name in seen.items()]
        todo = [(name, self.keys[k]) for name, k in todo]
        # arrays whose indices bind range variables come first; the others are conditions by then
        while todo:
            todo.sort(key=lambda x: sum(self.solvable(i, ranges, row) is None and not self.known(i, row, ranges) for i in x[1][1]))
            name, (array, indices) = todo.pop(0)
            for i in indices:  # an index over several range variables: all but one need their ranges
                loose = [v for v in free(i) if v in ranges and v not in row.vars]
                for v in loose if self.solvable(i, ranges, row) is None else []:
                    row = self.spread(v, ranges, row)
            df = before.get(array) if isinstance(before.get(array), DataFrame) else self.env[array]
            keys = index_columns(df)
            cols = {c: f"__{name}_{c}" for c in df.columns}
            row = Row(row.df.crossJoin(df.withColumnsRenamed(cols)), row.vars | {name: F.col(cols["v"])})
            for k, i in zip(keys, indices, strict=True):
                solved = self.solvable(i, ranges, row)
                if solved is not None:
                    v, value, whole = solved(F.col(cols[k]))
                    row = row.with_vars(None, {v: value})
                    row = self.within(v, ranges[v], Row(row.df.where(whole), row.vars))
                else:
                    c, row = compiler.eval(i, row)
                    row = Row(row.df.where(F.col(cols[k]) == c), row.vars)
        for v in ranges:
            if v not in row.vars:
                row = self.spread(v, ranges, row)
        for c in conds:
            row = compiler.filter(c, row)
        out = []
        for x in exprs:
            v, row = compiler.eval(x, row)
            out.append(v)
        return row, out

    keys: dict = {}

    def reads(self, e, seen: dict[str, str]):
        """The expression with array reads replaced by names; equal reads share one."""
        if not isinstance(e, tuple):
            return [self.reads(x, seen) for x in e] if isinstance(e, list) else e
        if e and e[0] == "index" and e[1][0] == "var" and isinstance(self.env.get(e[1][1]), DataFrame):
            k = repr(e)
            if k not in seen:
                inner = [self.reads(i, seen) for i in e[2]]
                seen[k] = f"__read{next(_fresh)}"
                self.keys = self.keys | {k: (e[1][1], inner)}
            return ("var", seen[k])
        return tuple(self.reads(x, seen) if isinstance(x, (tuple, list)) else x for x in e)

    @staticmethod
    def known(i, row: Row, ranges: dict) -> bool:
        return not (free(i) & (ranges.keys() - row.vars.keys()))

    def solvable(self, i, ranges: dict, row: Row):
        """For an index that is an affine function of one unbound range variable: how to get it from the index."""
        loose = [v for v in free(i) if v in ranges and v not in row.vars]
        if len(loose) != 1 or any(x.startswith("__read") and x not in row.vars for x in free(i)):
            return None
        v, compiler = loose[0], Compiler(self.spark, self.env, self.ops)

        def invert(e, k: Column, whole: Column):
            if e == ("var", v):
                return k, whole
            if e[0] != "op" or e[1] not in ("+", "-", "*"):
                return None
            left = v in free(e[2])
            if left and v in free(e[3]):
                return None
            c = compiler.eval(e[3] if left else e[2], row)[0]
            inner = e[2] if left else e[3]
            if e[1] == "+":
                return invert(inner, k - c, whole)
            if e[1] == "-":
                return invert(inner, k + c if left else c - k, whole)
            return invert(inner, F.try_divide(k, c).cast("bigint"), whole & (c != 0) & (F.try_mod(k, c) == 0))

        if invert(i, F.lit(0), F.lit(True)) is None:
            return None
        return lambda k: (v, *invert(i, k, F.lit(True)))

    def within(self, v: str, bounds: list, row: Row) -> Row:
        compiler = Compiler(self.spark, self.env, self.ops)
        ends = [compiler.eval(b, row)[0] for b in bounds]
        return Row(row.df.where(in_range(row.vars[v], *ends)), row.vars)

    def spread(self, v: str, ranges: dict, row: Row) -> Row:
        """The range itself, where no array gives the variable."""
        compiler = Compiler(self.spark, self.env, self.ops)
        ends = [compiler.eval(b, row)[0] for b in ranges[v]]
        name = f"__{v}{next(_fresh)}"
        if not any(free(b) & row.vars.keys() for b in ranges[v]):
            n = [self.scalar(b) for b in ranges[v]]
            frame = self.spark.range(n[0], n[1] + 1, n[2] if len(n) > 2 else 1).withColumnRenamed("id", name)
            return Row(row.df.crossJoin(frame), row.vars | {v: F.col(name)})
        return Row(row.df.withColumn(name, F.explode(F.sequence(*ends))), row.vars | {v: F.col(name)})

    def scan(self, p, e, row: Row, compiler: Compiler) -> Row:
        """``for v in A``: a vector's or matrix' values, a map's (k, v), a bag's elements."""
        source = self.env.get(e[1]) if e[0] == "var" else None
        if isinstance(source, DataFrame):
            kind = self.kinds.get(e[1], ("", []))[0]
            if kind in ("vector", "matrix") or not kind and source.columns in (["i", "v"], ["i", "j", "v"]):
                source = source.select(F.col("v").alias("value"))
            bag = Bag.of(source)
        else:
            bag, row = compiler.eval(e, row)
        name = f"__f{next(_fresh)}"
        if isinstance(bag, Bag):
            row = Row(row.df.crossJoin(bag.df.withColumnRenamed("value", name)), row.vars)
        else:
            row = Row(row.df.withColumn(name, F.explode(bag)), row.vars)
        return compiler.bind(p, F.col(name), row)


def program(spark: SparkSession, text: str, ops=None, **env: object) -> dict[str, object]:
    """Runs a loop program; the result is its variables: arrays as DataFrames, scalars as values."""
    parser = LoopParser(text, {n for n in monoids._MONOIDS if n.isidentifier()}, {o: 6 for o in ops or {}})
    parser.extra = tuple(ops or ())
    return Program(spark, env, ops).run(parser.program())


__all__ = ["Program", "program"]
