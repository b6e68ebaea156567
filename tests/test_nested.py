import json

import pytest
from pyspark.sql import functions as F

from tagloom.catalogue import QUERIES
from tagloom.functions import monoids
from tagloom.lineage import Traced
from tagloom.operators.control import lifted_do_while, repeat
from tagloom.operators.nested import Context, InnerBag, InnerScalar, nest
from tagloom.tasks.workloads import average_distances


@pytest.fixture(scope="module")
def bag(spark):
    tags = spark.createDataFrame([("a",), ("b",), ("c",)], "g string")
    return InnerBag(Context(tags, ["g"]), spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 5)], "g string, x int"))


def values(s):
    return {r[0]: r[1] for r in s.unlift().collect()}


def test_empties(bag):
    assert values(bag.count()) == {"a": 3, "b": 1, "c": 0}
    assert values(bag.count("drop")) == {"a": 3, "b": 1}
    assert values(bag.is_empty()) == {"a": False, "b": False, "c": True}
    assert values(bag.sum("x")) == {"a": 4, "b": 5}
    assert values(bag.sum("x", "keep")) == {"a": 4, "b": 5, "c": 0}
    assert values(bag.collect_list("x", ordered=True)) == {"a": [1, 1, 2], "b": [5]}
    assert values(bag.collect_list("x", "keep", ordered=True))["c"] == []


def test_one_aggregation_for_scalars_of_one_bag(bag):
    plan = (bag.sum("x") / bag.count("drop") + bag.max("x")).df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan


def test_null_tags_are_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, x int")
    g = nest(df, "g")
    assert values(g.inner.sum("x") + g.inner.count()) == {None: 5, "a": 4}
    assert g.inner.with_closure(g.inner.max("x"), "m").df.count() == 3


def test_strict_merge_rejects_other_tags(bag):
    with pytest.raises(Exception, match="different tags"):
        bag.count().binary(bag.sum("x").apply(lambda x: x), lambda a, b: a + b).df.collect()
        InnerScalar(bag.ctx, bag.ctx.const(1).df).binary(InnerScalar(bag.ctx, bag.sum("x").df), lambda a, b: a + b, strict=True).df.collect()


def test_do_while_stops_each_tag_by_itself(spark):
    ctx = Context(spark.createDataFrame([("a",), ("b",)], "g string"), ["g"])
    start = InnerScalar(ctx, spark.createDataFrame([("a", 1), ("b", 5)], "g string, value int"))

    def body(active, s):
        new = InnerScalar(active, s["x"].apply(lambda x: x + 1).df)
        return {"x": new}, new < 4

    assert values(lifted_do_while(ctx, {"x": start}, body)["x"]) == {"a": 4, "b": 6}


def test_repeat_needs_an_end(spark):
    with pytest.raises(ValueError):
        repeat({}, lambda s: s)


def test_semigroup_of_nothing(spark):
    none = spark.createDataFrame([], "x int")
    assert none.agg(monoids.get("max").agg(F.col("x"))).first()[0] is None
    assert none.agg(monoids.get("+").agg(F.col("x"))).first()[0] == 0
    with pytest.raises(Exception, match="nothing to reduce"):
        none.agg(monoids.get("max").agg(F.col("x"), strict=True)).collect()


def test_trees_of_outer_joins_and_groups(spark):
    a = Traced.source(spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), "A", ["k"], tree=True)
    b = Traced.source(spark.createDataFrame([(1, 5)], "k int, b int"), "B", ["k"], tree=True)
    got = {r["k"]: r["_tree"] for r in a.join(b, ["k"], "left").df.collect()}
    assert json.loads(got[1]) == {"join": [{"source": "A", "row": {"k": 1}}, {"source": "B", "row": {"k": 1}}]}
    assert json.loads(got[2]) == {"join": [{"source": "A", "row": {"k": 2}}]}
    whole = a.group_by(F.lit(0).alias("g")).df.first()
    assert json.loads(whole["_tree"]) == {"group": [{"source": "A", "row": {"k": 1}}, {"source": "A", "row": {"k": 2}}]}
    assert [r["k"] for r in a.join(b, ["k"], "left_anti").inputs().select("k").collect()] == [2]
    with pytest.raises(ValueError, match="a tree"):
        a.join(Traced.source(spark.range(1).withColumnRenamed("id", "k"), "C"), ["k"])


def test_shortest_paths_count_once_or_each(spark):
    # from 1 two paths lead to 4, and one from there to 5
    edges = spark.createDataFrame([("g", a, b) for a, b in [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 1)]], "g string, src int, dst int")
    graphs = nest(edges, "g")
    sources = InnerBag(graphs.ctx, spark.createDataFrame([("g", 1)], "g string, source int"))
    assert values(average_distances(graphs, sources)) == {"g": (0 + 1 + 1 + 2 + 3) / 5}
    assert values(average_distances(graphs, sources, dedupe=False)) == {"g": (0 + 1 + 1 + 2 * 2 + 2 * 3) / 7}


def test_order_by(spark, sf):
    prices = [r["p"] for r in QUERIES["lang_order_by"](spark, sf).collect()]
    assert len(prices) == spark.read.parquet(f"{sf}/orders.parquet").count() and prices == sorted(prices, reverse=True)


def test_lifted_equals_loop_over_groups(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "user_id")
    g = nest(df, "event_type")
    lifted = values(g.inner.distinct().count())
    assert lifted == {k[0]: part.distinct().count() for k, part in g.split().items()}
