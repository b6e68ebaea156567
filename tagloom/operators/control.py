"""Control flow: repeat, and a do-while loop that every group leaves on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.nested import Context, InnerBag, InnerScalar, joined
from tagloom.session import cut, is_cut

State = dict[str, DataFrame]


def repeat(state: State, step: Callable[[State], State], until: Callable[[State], object] | None = None, limit: int | None = None, until_post: bool = False) -> State:
    """Do-while over DataFrames. ``until`` sees the state *before* the step that has just run (``until_post``: after it)."""
    if until is None and limit is None:
        raise ValueError("repeat needs until or limit")
    done = 0
    while True:
        after = {k: cut(v) if isinstance(v, DataFrame) else v for k, v in step(state).items()}
        done += 1
        stop = False
        if until is not None:
            answer = until(after if until_post else state)
            stop = bool(answer.first()[0]) if isinstance(answer, DataFrame) else bool(answer)
        state = after
        if stop or limit is not None and done >= limit:
            return state


def _tally(flag: DataFrame) -> tuple[int, int]:
    """How many tags there are and how many of them go on."""
    return tuple(flag.agg(F.count(F.lit(1)), F.count(F.when(F.col("__go"), 1))).first())


def lifted_do_while(ctx: Context, state: dict[str, InnerBag | InnerScalar], body: Callable[[Context, dict], tuple[dict, InnerScalar]], limit: int = 10_000) -> dict[str, InnerBag | InnerScalar]:
    """Iterates all tags at once until each tag's condition is false.

    ``body(active, state)`` returns the next state and a condition for each
    active tag; tags whose condition is false are finished.  Each round cuts the
    plan once for each part of the state that the body hasn't cut itself, and runs
    one small action; rows are parted, by a condition that is cut then, only in
    rounds in which some tags finish and others don't.
    """
    active = Context(cut(ctx.tags), ctx.names)
    kinds = {n: type(v) for n, v in state.items()}
    finished: dict[str, list[DataFrame]] = {n: [] for n in state}
    for _ in range(limit):
        out, go_on = body(active, state)
        flag = go_on.df.withColumnRenamed("value", "__go")
        seen, left = _tally(flag)
        if 0 < left < seen:
            flag = cut(flag)
            seen, left = _tally(flag)
        if seen != active.count():
            raise ValueError(f"the condition has {seen} tags, {active.count()} are active")
        if left:
            going = active.restrict(flag.where("__go"))
            going.known = left
        state = {}
        for n, v in out.items():
            if left in (0, seen):  # all tags have finished, or none: nothing to part
                whole = v.df if is_cut(v.df) else cut(v.df)
                if left:
                    state[n] = kinds[n](going, whole)
                else:
                    finished[n].append(whole)
                continue
            both = cut(joined(v.df, flag, ctx.names))
            finished[n].append(both.where(~F.coalesce("__go", F.lit(False))).drop("__go"))
            state[n] = kinds[n](going, both.where("__go").drop("__go"))
        if not left:
            break
        active = going
    else:
        raise RuntimeError(f"the loop has not ended after {limit} rounds")
    result = {}
    for n, parts in finished.items():
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        result[n] = kinds[n](ctx, df)
    return result
