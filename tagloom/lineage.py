"""Row-level lineage: each row carries the input rows that it came from, through every operator.

A traced frame has one more column, ``_lineage``: an array of (source, row) with
the row as JSON.  With ``tree=True`` the sources also start a tree: the column
``_tree`` holds, as JSON, how joins and groups were made of those rows, down to
the sources.  Errors of an expression can become rows with a message in
``_error`` in place of ending the query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINEAGE, TREE, ERROR = "_lineage", "_tree", "_error"


def _node(kind: str, *below: Column) -> Column:
    return F.concat(F.lit(f'{{"{kind}":['), F.concat_ws(",", *below), F.lit("]}"))


class Traced:
    """A DataFrame with lineage."""

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def source(cls, df: DataFrame, name: str, keys: Sequence[str] | None = None, tree: bool = False) -> Traced:
        """An input; ``keys`` (else all columns) tell its rows apart."""
        row = F.struct(*(keys or df.columns))
        out = df.withColumn(LINEAGE, F.array(F.struct(F.lit(name).alias("source"), F.to_json(row).alias("row"))))
        return cls(out.withColumn(TREE, F.to_json(F.struct(F.lit(name).alias("source"), row.alias("row")))) if tree else out)

    @property
    def carried(self) -> list[str]:
        """The columns that hold lineage."""
        return [c for c in (LINEAGE, TREE) if c in self.df.columns]

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in (LINEAGE, TREE)]

    def select(self, *cols: Column | str) -> Traced:
        return Traced(self.df.select(*cols, *self.carried))

    def with_columns(self, **named: Column) -> Traced:
        return Traced(self.df.withColumns(named))

    def where(self, condition: Column | str) -> Traced:
        return Traced(self.df.where(condition))

    def marked(self, condition: Column, name: str = "_kept") -> Traced:
        """Like ``where``, but rows that fail stay, marked false: what was erased can be looked at."""
        return Traced(self.df.withColumn(name, F.coalesce(condition, F.lit(False))))

    def explode(self, name: str, array: Column) -> Traced:
        return Traced(self.df.withColumn(name, F.explode(array)))

    def join(self, other: Traced, on: Sequence[str], how: str = "inner") -> Traced:
        if self.carried != other.carried:
            raise ValueError("both sides of a join need a tree, or neither")
        right = other.df.withColumnsRenamed({LINEAGE: "__other", TREE: "__tree"})
        out = self.df.join(right, list(on), how)
        if "__other" not in out.columns:  # a semi or anti join
            return Traced(out)
        if TREE in self.carried:  # an outer join's missing side has no branch
            out = out.withColumn(TREE, _node("join", F.col(TREE), F.col("__tree"))).drop("__tree")
        both = F.concat(F.coalesce(LINEAGE, F.array()), F.coalesce("__other", F.array()))
        return Traced(out.withColumn(LINEAGE, both).drop("__other"))

    def union(self, other: Traced) -> Traced:
        return Traced(self.df.unionByName(other.df))

    def group_by(self, *keys: str | Column, **aggs: Column) -> Traced:
        """Aggregates; a group's lineage is that of all its rows, in a fixed order."""
        every = [F.array_sort(F.flatten(F.collect_list(LINEAGE))).alias(LINEAGE)]
        if TREE in self.carried:
            every.append(_node("group", F.array_sort(F.collect_list(TREE))).alias(TREE))
        return Traced(self.df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()], *every))

    def distinct(self) -> Traced:
        return self.group_by(*self.columns)

    def guarded(self, name: str, value: Column, ok: Column, message: str) -> Traced:
        """A column that is null, with a message in ``_error``, for rows that aren't ``ok``."""
        error = F.when(~F.coalesce(ok, F.lit(False)), F.lit(message))
        before = F.col(ERROR) if ERROR in self.df.columns else F.lit(None).cast("string")
        return Traced(self.df.withColumns({name: F.when(ok, value), ERROR: F.coalesce(before, error)}))

    def inputs(self) -> DataFrame:
        """One row for each result row and each input row behind it."""
        return self.df.withColumn("_in", F.explode(LINEAGE)).select(*self.columns, "_in.source", "_in.row")
