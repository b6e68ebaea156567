"""One query for each operator on nested bags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import monoids
from tagloom.operators.nested import InnerBag, conest, lift_map, nest
from tagloom.registry import query, table

_E = "(SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, user_id, event_type, value FROM events)"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id", "event_type", "value")


@query(f"SELECT day, round(count(*) FILTER (n = 1) / count(*)::DOUBLE, 6) AS rate FROM (SELECT day, user_id, count(*) AS n FROM {_E} GROUP BY ALL) GROUP BY day")
def bounce_rate_per_day(spark: SparkSession, sf: str) -> DataFrame:
    return bounce_rate(events(spark, sf), "day")


@query(f"SELECT event_type, round(count(*) FILTER (n = 1) / count(*)::DOUBLE, 6) AS rate FROM (SELECT event_type, user_id, count(*) AS n FROM {_E} GROUP BY ALL) GROUP BY event_type")
def bounce_rate_per_type(spark: SparkSession, sf: str) -> DataFrame:
    return bounce_rate(events(spark, sf), "event_type")


def bounce_rate(visits: DataFrame, by: str, visitor: str = "user_id") -> DataFrame:
    """Share of each group's visitors that came once; 0.0 for groups without such a visitor."""

    def rate(_, group: InnerBag):
        visitors = group.group_by(visitor).agg(n=F.count(F.lit(1)))
        once = visitors.aggregate(F.count(F.when(F.col("n") == 1, 1)), "keep", 0)
        return (once / visitors.count()).apply(lambda x: F.round(x, 6))

    return nest(visits, by).map_to_scalar(rate, "rate")


@query(f"SELECT event_type, user_id * 2 + 1 AS twice FROM {_E}")
def lifted_map(spark: SparkSession, sf: str) -> DataFrame:
    return nest(events(spark, sf), "event_type").inner.select(twice=F.col("user_id") * 2 + 1).unlift()


@query(f"SELECT event_type, event_id FROM {_E} WHERE value > 50")
def lifted_filter(spark: SparkSession, sf: str) -> DataFrame:
    return nest(events(spark, sf), "event_type").inner.where("value > 50").select("event_id").unlift()


@query(f"SELECT event_type, event_id, unnest([user_id, user_id + 1]) AS x FROM {_E}")
def lifted_flat_map(spark: SparkSession, sf: str) -> DataFrame:
    return nest(events(spark, sf), "event_type").inner.explode("x", F.array("user_id", F.col("user_id") + 1)).select("event_id", "x").unlift()


@query(f"SELECT DISTINCT event_type, user_id FROM {_E}")
def lifted_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return nest(events(spark, sf), "event_type").inner.select("user_id").distinct().unlift()


@query(f"SELECT day, user_id FROM {_E} WHERE value < 20 UNION ALL SELECT day, user_id FROM {_E} WHERE value > 80")
def lifted_union(spark: SparkSession, sf: str) -> DataFrame:
    bag = nest(events(spark, sf), "day").inner
    return bag.where("value < 20").select("user_id").union(bag.where("value > 80").select("user_id")).unlift()


@query(f"SELECT day, user_id FROM {_E} a WHERE value < 50 AND EXISTS (SELECT 1 FROM {_E} b WHERE b.value > 90 AND b.day = a.day AND b.user_id = a.user_id)")
def lifted_intersect(spark: SparkSession, sf: str) -> DataFrame:
    bag = nest(events(spark, sf), "day").inner
    return bag.where("value < 50").select("user_id").intersect(bag.where("value > 90").select("user_id")).unlift()


@query(f"SELECT day, user_id FROM {_E} a WHERE value < 50 AND NOT EXISTS (SELECT 1 FROM {_E} b WHERE b.value > 90 AND b.day = a.day AND b.user_id = a.user_id)")
def lifted_minus(spark: SparkSession, sf: str) -> DataFrame:
    bag = nest(events(spark, sf), "day").inner
    return bag.where("value < 50").select("user_id").minus(bag.where("value > 90").select("user_id")).unlift()


@query(f"SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id % 97, event_id) AS n FROM {_E}) WHERE n <= 7")
def lifted_sample(spark: SparkSession, sf: str) -> DataFrame:
    bag = nest(events(spark, sf), "event_type").inner
    return bag.sample(7, order_by=[F.col("event_id") % 97, F.col("event_id")]).select("event_id").unlift()


_TAGS = f"(SELECT DISTINCT user_id FROM {_E})"


@query(f"SELECT user_id, count(b.event_id) AS n FROM {_TAGS} t LEFT JOIN (SELECT * FROM {_E} WHERE value > 99) b USING (user_id) GROUP BY user_id")
def lifted_count(spark: SparkSession, sf: str) -> DataFrame:
    """Users without such an event count 0."""
    return nest(events(spark, sf), "user_id").inner.where("value > 99").count().unlift("n")


@query(f"SELECT user_id, count(*) AS n FROM {_E} WHERE value > 99 GROUP BY user_id")
def lifted_count_nonempty(spark: SparkSession, sf: str) -> DataFrame:
    return nest(events(spark, sf), "user_id").inner.where("value > 99").count("drop").unlift("n")


@query(f"SELECT user_id, count(b.event_id) = 0 AS empty FROM {_TAGS} t LEFT JOIN (SELECT * FROM {_E} WHERE value > 99) b USING (user_id) GROUP BY user_id")
def lifted_is_empty(spark: SparkSession, sf: str) -> DataFrame:
    return nest(events(spark, sf), "user_id").inner.where("value > 99").is_empty().unlift("empty")


@query(f"SELECT user_id, round(coalesce(sum(b.value), 0), 4) AS s FROM {_TAGS} t LEFT JOIN (SELECT * FROM {_E} WHERE value > 99) b USING (user_id) GROUP BY user_id")
def lifted_add_empties(spark: SparkSession, sf: str) -> DataFrame:
    return nest(events(spark, sf), "user_id").inner.where("value > 99").sum("value", "keep", 0.0).apply(lambda x: F.round(x, 4)).unlift("s")


@query(f"SELECT day, round(sum(value), 4) AS s, round(avg(value), 6) AS a, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM {_E} GROUP BY day")
def lifted_sum_average(spark: SparkSession, sf: str) -> DataFrame:
    """Four scalars of one bag: one aggregation."""
    bag = nest(events(spark, sf), "day").inner
    both = bag.sum("value").ternary(bag.avg("value"), bag.min("value").binary(bag.max("value"), lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))), lambda s, a, m: F.struct(F.round(s, 4).alias("s"), F.round(a, 6).alias("a"), F.round(m["lo"], 6).alias("lo"), F.round(m["hi"], 6).alias("hi")))
    return both.unlift().select("day", "value.*")


@query(f"SELECT event_type, user_id, round(sum(value), 4) AS s FROM {_E} GROUP BY ALL")
def lifted_reduce_by_key(spark: SparkSession, sf: str) -> DataFrame:
    out = nest(events(spark, sf), "event_type").inner.group_by("user_id").reduce("s", "+", "value")
    return out.unlift().withColumn("s", F.round("s", 4))


@query(f"SELECT event_type, user_id, count(*) AS n, max(event_id) AS last FROM {_E} GROUP BY ALL")
def lifted_aggregate_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return nest(events(spark, sf), "event_type").inner.group_by("user_id").agg(n=F.count(F.lit(1)), last=F.max("event_id")).unlift()


@query(f"SELECT day, string_agg(event_id, ',' ORDER BY event_id) AS ids FROM {_E} WHERE value > 90 GROUP BY day")
def lifted_collect(spark: SparkSession, sf: str) -> DataFrame:
    ids = nest(events(spark, sf), "day").inner.where("value > 90").collect_list("event_id", ordered=True)
    return ids.apply(lambda a: F.array_join(a.cast("array<string>"), ",")).unlift("ids")


@query(f"SELECT a.day, a.user_id, a.event_id AS x, b.event_id AS y FROM {_E} a JOIN {_E} b ON a.day = b.day AND a.user_id = b.user_id WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def lifted_join(spark: SparkSession, sf: str) -> DataFrame:
    bag = nest(events(spark, sf), "day").inner
    a = bag.where("event_type = 'click'").select("user_id", x="event_id")
    return a.join(bag.where("event_type = 'purchase'").select("user_id", y="event_id"), ["user_id"]).unlift()


@query(f"SELECT e.day, e.event_id, n_name FROM {_E} e JOIN nation ON user_id % 25 = n_nationkey")
def lifted_join_flat(spark: SparkSession, sf: str) -> DataFrame:
    """The other side isn't nested: the same for every tag."""
    bag = nest(events(spark, sf), "day").inner.select("event_id", n_nationkey=(F.col("user_id") % 25).cast("int"))
    return bag.join_flat(table(spark, sf, "nation").select("n_nationkey", "n_name"), ["n_nationkey"]).select("event_id", "n_name").unlift()


@query(f"SELECT a.day, a.event_type, a.user_id, t.n FROM (SELECT DISTINCT day, event_type, user_id FROM {_E}) a JOIN (SELECT day, user_id, count(*) AS n FROM {_E} GROUP BY ALL) t ON a.day = t.day AND a.user_id = t.user_id")
def lifted_join_less_lifted(spark: SparkSession, sf: str) -> DataFrame:
    """A bag of two tag levels with one of the outer level."""
    e = events(spark, sf)
    inner = nest(e, ["day", "event_type"]).inner.select("user_id").distinct()
    return inner.join(nest(e, "day").inner.group_by("user_id").agg(n=F.count(F.lit(1))), ["user_id"]).unlift()


@query(f"SELECT a.day, a.event_id FROM {_E} a WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM {_E} b WHERE b.event_type = 'purchase' AND b.day = a.day AND b.user_id = a.user_id)")
def lifted_left_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    bag = nest(events(spark, sf), "day").inner
    return bag.where("event_type = 'click'").join(bag.where("event_type = 'purchase'").select("user_id"), ["user_id"], "left_anti").select("event_id").unlift()


@query(f"SELECT coalesce(a.day, b.day) AS day, coalesce(a.user_id, b.user_id) AS user_id, a.n AS clicks, b.n AS purchases FROM (SELECT day, user_id, count(*) AS n FROM {_E} WHERE event_type = 'click' GROUP BY ALL) a FULL JOIN (SELECT day, user_id, count(*) AS n FROM {_E} WHERE event_type = 'purchase' GROUP BY ALL) b ON a.day = b.day AND a.user_id = b.user_id")
def lifted_full_outer_join(spark: SparkSession, sf: str) -> DataFrame:
    bag = nest(events(spark, sf), "day").inner
    a = bag.where("event_type = 'click'").group_by("user_id").agg(clicks=F.count(F.lit(1)))
    return a.join(bag.where("event_type = 'purchase'").group_by("user_id").agg(purchases=F.count(F.lit(1))), ["user_id"], "full").unlift()


@query(f"SELECT event_type, event_id FROM {_E} e JOIN (SELECT event_type, avg(value) AS m FROM {_E} GROUP BY 1) USING (event_type) WHERE value > m * 1.9")
def lifted_with_closure(spark: SparkSession, sf: str) -> DataFrame:
    """A scalar of the group is used in a function of its elements."""
    bag = nest(events(spark, sf), "event_type").inner
    return bag.with_closure(bag.avg("value"), "mean").where("value > mean * 1.9").select("event_id").unlift()


@query(f"SELECT a.day, a.event_id, (SELECT count(*) FROM {_E} b WHERE b.day = a.day AND b.event_type = 'purchase' AND b.value < a.value) AS below FROM {_E} a WHERE a.event_type = 'click'")
def lifted_with_bag_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Each element sees another bag of its group as a whole; days without purchases give an empty one."""
    bag = nest(events(spark, sf), "day").inner
    out = bag.where("event_type = 'click'").with_bag_closure(bag.where("event_type = 'purchase'").select(v="value"), "them")
    return out.select("event_id", below=F.size(F.filter("them", lambda x: x["v"] < F.col("value"))).cast("long")).unlift()


@query("SELECT s_nationkey, n_nationkey, round(sum(s_acctbal) + n_nationkey, 4) AS x FROM supplier, nation GROUP BY s_nationkey, n_nationkey")
def lifted_half_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Every tag meets the same flat bag (25 rows)."""
    sums = nest(table(spark, sf, "supplier"), "s_nationkey").inner.sum("s_acctbal").to_bag()
    flat = table(spark, sf, "nation").select("n_nationkey")
    return sums.with_flat_closure(flat, rows=25).select("n_nationkey", x=F.round(F.col("value") + F.col("n_nationkey"), 4)).unlift()


@query("WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) SELECT c.k AS c_nationkey, s.k AS s_nationkey, c.n * s.n AS n FROM c JOIN s ON c.k < s.k")
def lifted_cartesian(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of groups: customers of one nation, suppliers of a later one."""
    a = nest(table(spark, sf, "customer").select("c_nationkey", "c_custkey"), "c_nationkey")
    b = nest(table(spark, sf, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey")
    pairs = a.cartesian(b, ("", ""), when=lambda t: t["c_nationkey"] < t["s_nationkey"])
    return pairs.map_to_scalar(lambda _, x, y: x.count() * y.count(), "n")


@query(f"SELECT day, count(*) AS n FROM {_E} WHERE right(day, 1) = '5' GROUP BY day")
def lifted_filter_outer(spark: SparkSession, sf: str) -> DataFrame:
    return nest(events(spark, sf), "day").filter_outer(lambda d: d.endswith("5")).map_to_scalar(lambda _, g: g.count(), "n")


@query("WITH k AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9900 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) SELECT k, (SELECT count(*) FROM customer WHERE c_nationkey = k AND c_acctbal > 9900) - (SELECT count(*) FROM supplier WHERE s_nationkey = k AND s_acctbal > 9000) AS d FROM k")
def lifted_cogroup(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"), "c_custkey")
    b = table(spark, sf, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("k"), "s_suppkey")
    return conest(a, b, "k").map_to_scalar(lambda _, x, y: x.count() - y.count(), "d")


@query("SELECT (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) * 10 + n_regionkey AS value FROM nation")
def lifted_map_with_udf(spark: SparkSession, sf: str) -> DataFrame:
    """A lifted function for every row of a flat bag: each row is a group."""
    suppliers = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")

    def f(one: InnerBag):
        found = one.join_flat(suppliers, ["n_nationkey"]).count()
        return found * 10 + one.max("n_regionkey").apply(lambda x: x.cast("long"))

    return lift_map(table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), f)


@query(f"SELECT day, event_type, count(*) * 100 + t.n AS x FROM {_E} JOIN (SELECT day, count(*) AS n FROM {_E} GROUP BY 1) t USING (day) GROUP BY day, event_type, t.n")
def lifted_two_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Groups inside groups: a scalar of the outer level is used in the inner one."""
    outer = nest(events(spark, sf), "day")
    inner = outer.inner.nest("event_type")
    counts = inner.inner.count().to_bag().with_closure(outer.inner.count(), "n")
    return counts.select(x=F.col("value") * 100 + F.col("n")).unlift()


@query(f"SELECT day, 7 AS value FROM {_E} GROUP BY day")
def lifted_const(spark: SparkSession, sf: str) -> DataFrame:
    return nest(events(spark, sf), "day").ctx.const(7).unlift()


@query(f"SELECT event_type, user_id AS partner FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id DESC) AS k FROM (SELECT event_type, user_id, count(*) AS n FROM {_E} GROUP BY ALL)) WHERE k = 1")
def top_partner_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent user of each type; ties go to the largest id."""
    bag = nest(events(spark, sf), "event_type").inner.group_by("user_id").agg(n=F.count(F.lit(1)))
    return bag.aggregate(monoids.arg_max(F.col("n"), F.col("user_id"))).unlift("partner")


@query(f"SELECT event_type, max(user_id % 64) + min(user_id % 64) AS x FROM {_E} GROUP BY event_type")
def lifted_user_monoid(spark: SparkSession, sf: str) -> DataFrame:
    """Two user-defined semigroups over one bag."""
    larger = monoids.Monoid("larger", lambda a, b: F.when(a > b, a).otherwise(b))
    smaller = monoids.Monoid("smaller", lambda a, b: F.when(a < b, a).otherwise(b))
    bag = nest(events(spark, sf), "event_type").inner
    return (bag.reduce(larger, F.col("user_id") % 64) + bag.reduce(smaller, F.col("user_id") % 64)).unlift("x")


@query(f"SELECT event_type, count(*) AS n FROM {_E} WHERE value > 10 GROUP BY event_type")
def split_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a lifted count, as a loop over groups would do it: one plan a group (for comparison)."""
    parts = nest(events(spark, sf), "event_type").split()
    out = [df.where("value > 10").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k[0]).alias("event_type"), "n") for k, df in parts.items()]
    done = out[0]
    for x in out[1:]:
        done = done.union(x)
    return done
