"""End-to-end nested workloads: per-group iteration, closures and joins over many groups at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import monoids
from tagloom.operators.control import lifted_do_while, repeat
from tagloom.operators.nested import Context, InnerBag, InnerScalar, Nested, joined, nest
from tagloom.registry import query, table
from tagloom.session import cut

def both_ways(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Every edge and its reverse, by one pass over the edges."""
    ends = F.explode(F.array(F.struct(F.col(src).alias("__a"), F.col(dst).alias("__b")), F.struct(F.col(dst).alias("__a"), F.col(src).alias("__b"))))
    return edges.withColumn("__ends", ends).withColumns({src: F.col("__ends.__a"), dst: F.col("__ends.__b")}).drop("__ends")


# ---------------------------------------------------------------- PageRank per group


def pagerank_groups(edges: Nested, damping: float = 0.85, epsilon: float | None = None, steps: int | None = None) -> InnerBag:
    """``page, rank`` of every group's graph (bag of src, dst); each group stops on its own, by ``epsilon`` or after ``steps``."""
    ctx = edges.ctx
    pages = InnerBag(ctx, cut(edges.inner.explode("page", F.array("src", "dst")).select("page").distinct().df))
    # a self loop for every page, so no rank is lost; repeated edges count
    links = edges.inner.select("src", "dst").union(pages.select(src="page", dst="page"))
    degrees = links.group_by("src").agg(degree=F.count(F.lit(1)))
    links = InnerBag(ctx, cut(links.join(degrees, ["src"]).df)).prepared("src")
    sizes = pages.count("drop")
    ranks = pages.with_closure(sizes, "n").select("page", "n", rank=F.lit(1.0) / F.col("n"))
    state = {"ranks": InnerBag(ctx, cut(ranks.df))}
    done = 0

    def body(active: Context, s: dict):
        nonlocal done
        done += 1
        old = s["ranks"]
        sent = old.join(InnerBag(ctx, links.df.withColumnRenamed("src", "page")), ["page"])
        # the self loops bring each page's old rank along, so one join is enough
        own = F.max(F.when(F.col("page") == F.col("dst"), F.col("rank")))
        new = sent.group_by(page="dst").agg(got=F.sum(F.col("rank") / F.col("degree")), n=F.max("n"), old=own)
        new = new.select("page", "n", "old", rank=F.lit(1 - damping) / F.col("n") + F.lit(damping) * F.col("got"))
        new = InnerBag(active, cut(new.df))
        go_on = active.const(done < steps) if steps is not None else new.sum(F.abs(F.col("rank") - F.col("old"))) > epsilon
        return {"ranks": new}, go_on

    return lifted_do_while(ctx, state, body)["ranks"].select("page", "rank")


def _line_edges(spark: SparkSession, sf: str) -> Nested:
    x = table(spark, sf, "lineitem").select("l_returnflag", F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"))
    return nest(both_ways(x), "l_returnflag")


_EDGES = "SELECT l_returnflag AS g, 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem"


def _pagerank_sql(steps: int) -> str:
    parts = [
        f"e0 AS ({_EDGES} UNION ALL SELECT g, dst, src FROM ({_EDGES}))",
        "pages AS (SELECT g, src AS page FROM e0 UNION SELECT g, dst FROM e0)",
        "n AS (SELECT g, count(*) AS n FROM pages GROUP BY g)",
        "e AS MATERIALIZED (SELECT g, src, dst FROM e0 UNION ALL SELECT g, page, page FROM pages)",
        "d AS MATERIALIZED (SELECT g, src, count(*) AS degree FROM e GROUP BY ALL)",
        "r0 AS MATERIALIZED (SELECT g, page, 1.0::DOUBLE / n AS rank FROM pages JOIN n USING (g))",
    ]
    parts += [f"r{i + 1} AS MATERIALIZED (SELECT e.g, e.dst AS page, 0.15::DOUBLE / any_value(n.n) + 0.85::DOUBLE * sum(r.rank / d.degree) AS rank FROM e JOIN d ON e.g = d.g AND e.src = d.src JOIN r{i} r ON r.g = e.g AND r.page = e.src JOIN n ON n.g = e.g GROUP BY e.g, e.dst)" for i in range(steps)]
    return "WITH " + ", ".join(parts)


@query(_pagerank_sql(4) + " SELECT g AS l_returnflag, page, round(rank, 9) AS rank FROM r4")
def pagerank_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return pagerank_groups(_line_edges(spark, sf), steps=4).with_columns(rank=F.round("rank", 9)).unlift()


_EPSILON, _ENOUGH = 0.1, 20  # a step moves at most 2 * 0.85 ** step, so 20 steps are always enough
_MOVED = " UNION ALL ".join(f"SELECT a.g, {i} AS step, sum(abs(a.rank - b.rank)) AS moved FROM r{i} a JOIN r{i - 1} b USING (g, page) GROUP BY a.g" for i in range(1, _ENOUGH + 1))
_ALL_RANKS = " UNION ALL ".join(f"SELECT g, {i} AS step, page, rank FROM r{i}" for i in range(1, _ENOUGH + 1))


@query(_pagerank_sql(_ENOUGH) + f", last AS (SELECT g, min(step) AS step FROM ({_MOVED}) WHERE moved <= {_EPSILON} GROUP BY g) SELECT g AS l_returnflag, page, round(rank, 9) AS rank FROM ({_ALL_RANKS}) JOIN last USING (g, step)")
def pagerank_per_group_until_stable(spark: SparkSession, sf: str) -> DataFrame:
    """Each group iterates until its own ranks move by no more than epsilon in all."""
    return pagerank_groups(_line_edges(spark, sf), epsilon=_EPSILON).with_columns(rank=F.round("rank", 9)).unlift()


# ---------------------------------------------------------------- k-means, many initialisations


def kmeans_runs(points: DataFrame, starts: DataFrame, steps: int = 11, digits: int = 6) -> tuple[InnerBag, InnerScalar]:
    """Centroids of every run (starts: run, x, y) after ``steps`` and each run's sum of squared distances.

    All runs share the flat points (x, y, w = how often); a run's centroids are
    few, so the points are never repeated for a run in storage: they meet the
    broadcast centroids of all runs. Empty clusters vanish.
    """
    ctx = Context(starts.select("run").distinct(), ["run"])
    points = points.persist()

    def nearest(centroids: InnerBag) -> DataFrame:
        means = centroids.df.groupBy("run").agg(F.sort_array(F.collect_list(F.struct(F.col("x").alias("cx"), F.col("y").alias("cy")))).alias("means"))
        # one row a run: bounded by runs x k
        both = points.crossJoin(F.broadcast(means))
        d = lambda c: (c["cx"] - F.col("x")) * (c["cx"] - F.col("x")) + (c["cy"] - F.col("y")) * (c["cy"] - F.col("y"))
        return both.select("run", "x", "y", "w", F.array_min(F.transform("means", lambda c: F.struct(F.round(d(c), 9).alias("d"), c["cx"].alias("cx"), c["cy"].alias("cy")))).alias("b")).select("run", "x", "y", "w", "b.d", "b.cx", "b.cy")

    def body(active: Context, s: dict):
        w = F.sum("w")
        new = nearest(s["means"]).groupBy("run", "cx", "cy").agg(F.round(F.sum(F.col("x") * F.col("w")) / w, digits).alias("x"), F.round(F.sum(F.col("y") * F.col("w")) / w, digits).alias("y"))
        step = InnerScalar(active, s["step"].apply(lambda x: x + 1).df)
        return {"means": InnerBag(active, new.select("run", "x", "y").distinct()), "step": step}, step < steps

    state = {"means": InnerBag(ctx, cut(starts)), "step": InnerScalar(ctx, ctx.tags.withColumn("value", F.lit(0)))}
    means = lifted_do_while(ctx, state, body)["means"]
    cost = InnerBag(ctx, nearest(means)).sum(F.col("d") * F.col("w"))
    return means, cost


_RUNS, _K, _STEPS = 3, 4, 5


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).cast("int").cast("double").alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))


def _starts(spark: SparkSession) -> DataFrame:
    return spark.range(_RUNS * _K).select((F.col("id") % _RUNS).alias("run"), ((F.col("id") * 7) % 50 + 1).cast("double").alias("x"), ((F.col("id") * 3) % 11).cast("double").alias("y"))


def _kmeans_sql() -> str:
    parts = [
        "p AS (SELECT l_quantity AS x, floor(l_discount * 100)::INT::DOUBLE AS y, count(*) AS w FROM lineitem GROUP BY ALL)",
        f"m0 AS (SELECT id % {_RUNS} AS run, ((id * 7) % 50 + 1)::DOUBLE AS x, ((id * 3) % 11)::DOUBLE AS y FROM range({_RUNS * _K}) t(id))",
    ]
    near = "SELECT run, x, y, w, d, cx, cy FROM (SELECT m.run, p.x, p.y, p.w, round((m.x - p.x) * (m.x - p.x) + (m.y - p.y) * (m.y - p.y), 9) AS d, m.x AS cx, m.y AS cy, row_number() OVER (PARTITION BY m.run, p.x, p.y ORDER BY round((m.x - p.x) * (m.x - p.x) + (m.y - p.y) * (m.y - p.y), 9), m.x, m.y) AS k FROM p, {} m) WHERE k = 1"
    for i in range(_STEPS):
        parts += [f"a{i} AS ({near.format(f'm{i}')})", f"m{i + 1} AS (SELECT DISTINCT run, round(sum(x * w) / sum(w), 6) AS x, round(sum(y * w) / sum(w), 6) AS y FROM a{i} GROUP BY run, cx, cy)"]
    return "WITH " + ", ".join([*parts, f"z AS ({near.format(f'm{_STEPS}')})"])


@query(_kmeans_sql() + f" SELECT run, x, y FROM m{_STEPS}")
def kmeans_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return kmeans_runs(_points(spark, sf), _starts(spark), _STEPS)[0].unlift()


@query(_kmeans_sql() + " SELECT round(min(s), 2) AS best FROM (SELECT run, sum(d * w) AS s FROM z GROUP BY run)")
def kmeans_best_run(spark: SparkSession, sf: str) -> DataFrame:
    """The smallest sum of squared distances over all runs."""
    return kmeans_runs(_points(spark, sf), _starts(spark), _STEPS)[1].unlift("s").agg(F.round(F.min("s"), 2).alias("best"))


# ---------------------------------------------------------------- average distances (three levels)


def average_distances(graphs: Nested, sources: InnerBag, dedupe: bool = True) -> InnerScalar:
    """Mean breadth-first distance from each group's sources (``source``) to what they reach, the source itself included.

    Tags are (group, source); all searches of all groups advance together and
    each ends when its own frontier is empty. A step is one join with the edges and
    one aggregate that keeps each vertex's least distance. ``dedupe=False`` counts
    a vertex once for each shortest path, as a frontier with repeats would.
    """
    group = graphs.ctx.names
    names = (*group, "source")
    ctx = Context(sources.df.select(*names), names)
    edges = graphs.inner.prepared("src")
    state = {"seen": InnerBag(ctx, ctx.tags.withColumns({"vertex": F.col("source"), "distance": F.lit(0), "paths": F.lit(1.0)}))}
    level = 0

    def body(active: Context, s: dict):
        nonlocal level
        seen = InnerBag(active, s["seen"].df)
        frontier = seen.where(F.col("distance") == level).select("paths", src="vertex")
        level += 1
        reached = frontier.join(edges, ["src"]).select(vertex="dst", distance=F.lit(level), paths="paths")
        earlier = F.max(F.when(F.col("distance") < level, F.col("paths")))
        paths = F.coalesce(earlier, F.lit(1.0) if dedupe else F.sum("paths"))
        new = InnerBag(active, cut(seen.union(reached).group_by("vertex").agg(distance=F.min("distance"), paths=paths).df))
        return {"seen": new}, new.max("distance").equals(level)

    seen = InnerBag(graphs.ctx, lifted_do_while(ctx, state, body)["seen"].df)
    return seen.sum(F.col("distance") * F.col("paths")) / seen.sum("paths")


def _trade(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers that traded, by the customer's nation."""
    o, c, l = (table(spark, sf, t) for t in ("orders", "customer", "lineitem"))
    x = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).select("c_nationkey", F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    return both_ways(x)


def _first_sources(graphs: Nested, n: int) -> InnerBag:
    return graphs.inner.select(source="src").distinct().sample(n, order_by="source")


_TRADE = "SELECT DISTINCT c_nationkey AS g, 'c' || c_custkey AS src, 's' || l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
@query(f"""WITH RECURSIVE x AS MATERIALIZED ({_TRADE}), e AS MATERIALIZED (SELECT g, src, dst FROM x UNION ALL SELECT g, dst, src FROM x),
    s AS (SELECT g, src FROM (SELECT g, src, row_number() OVER (PARTITION BY g ORDER BY src) AS k FROM (SELECT DISTINCT g, src FROM e)) WHERE k <= 2),
    b(g, source, vertex, distance) AS (SELECT g, src, src, 0 FROM s UNION SELECT b.g, b.source, e.dst, b.distance + 1 FROM b JOIN e ON b.g = e.g AND b.vertex = e.src WHERE b.distance < 14),
    m AS (SELECT g, source, vertex, min(distance) AS d FROM b GROUP BY ALL)
    SELECT g AS c_nationkey, round(avg(d), 6) AS distance FROM m GROUP BY g""")
def average_distances_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """Edges from all line items; the SQL's bound on the distance lies above the longest one."""
    graphs = nest(cut(_trade(spark, sf)), "c_nationkey")
    return average_distances(graphs, _first_sources(graphs, 2)).apply(lambda x: F.round(x, 6)).unlift("distance")


# ---------------------------------------------------------------- pairwise correlation


def pairwise_correlation(cells: DataFrame, rows: int | Column, column: str = "j", row: str = "i", value: str = "v") -> DataFrame:
    """Pearson correlation of every two columns of a sparse matrix (absent cells are 0), as groups joined with groups."""
    cells = cells.select(column, row, value)
    nested = nest(cells, column)
    pairs = nested.cartesian(nested, when=lambda t: t[f"{column}_1"] < t[f"{column}_2"])

    def correlation(_, a: InnerBag, b: InnerBag) -> InnerScalar:
        both = InnerBag(a.ctx, joined(a.df.withColumnRenamed(value, "__x"), b.df.withColumnRenamed(value, "__y"), [*a.ctx.names, row], "full"))
        x, y = F.coalesce("__x", F.lit(0.0)), F.coalesce("__y", F.lit(0.0))
        n = F.lit(rows) if isinstance(rows, int) else rows
        sums = both.aggregate(F.struct(F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy")))
        return sums.apply(lambda s: F.try_divide(n * s["xy"] - s["x"] * s["y"], F.sqrt(n * s["xx"] - s["x"] * s["x"]) * F.sqrt(n * s["yy"] - s["y"] * s["y"])))

    return pairs.map_to_scalar(correlation, "corr")


_COO = "SELECT user_id AS i, event_type AS j, sum(value) AS v FROM events GROUP BY ALL"


@query(f"""WITH c AS ({_COO}), n AS (SELECT count(DISTINCT i) AS n FROM c), t AS (SELECT DISTINCT j FROM c),
    f AS (SELECT i, j, coalesce(v, 0) AS v FROM (SELECT DISTINCT i FROM c) CROSS JOIN t LEFT JOIN c USING (i, j))
    SELECT a.j AS j_1, b.j AS j_2, round(corr(a.v, b.v), 6) AS corr FROM f a JOIN f b ON a.i = b.i AND a.j < b.j GROUP BY ALL""")
def pairwise_corr(spark: SparkSession, sf: str) -> DataFrame:
    cells = cut(table(spark, sf, "events").groupBy(F.col("user_id").alias("i"), F.col("event_type").alias("j")).agg(F.sum("value").alias("v")))
    rows = cells.select("i").distinct().count()
    return pairwise_correlation(cells, rows).withColumn("corr", F.round("corr", 6))


# ---------------------------------------------------------------- loops over flat data


@query("SELECT n_nationkey * 64 + 63 AS x FROM nation")
def repeat_until(spark: SparkSession, sf: str) -> DataFrame:
    """The condition sees the state before the step: after 24 has grown to 799, one more step is made."""
    start = table(spark, sf, "nation").select(F.col("n_nationkey").alias("x"))
    return repeat({"s": start}, lambda s: {"s": s["s"].select((2 * F.col("x") + 1).alias("x"))}, until=lambda s: s["s"].agg(F.max("x") > 500))["s"]


@query("SELECT n_nationkey * 32 + 31 AS x FROM nation")
def repeat_limit(spark: SparkSession, sf: str) -> DataFrame:
    start = table(spark, sf, "nation").select(F.col("n_nationkey").alias("x"))
    return repeat({"s": start}, lambda s: {"s": s["s"].select((2 * F.col("x") + 1).alias("x"))}, limit=5)["s"]


@query("SELECT g, CASE WHEN g = 0 THEN 4 ELSE greatest(g * 3 + 1, 4) END AS value FROM range(3) t(g)")
def lifted_do_while_scalars(spark: SparkSession, sf: str) -> DataFrame:
    """x -> x + 1 while x + 1 < 4 from 0, 3 and 6: each group stops on its own and the body runs once at least."""
    tags = spark.range(3).select(F.col("id").alias("g"))
    ctx = Context(tags, ["g"])

    def body(active: Context, s: dict):
        new = InnerScalar(active, s["x"].apply(lambda x: x + 1).df)
        return {"x": new}, new < 4

    return lifted_do_while(ctx, {"x": InnerScalar(ctx, tags.withColumn("value", F.col("g") * 3))}, body)["x"].unlift()


@query("SELECT o_custkey, max(o_totalprice) AS best, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def arg_max_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"), monoids.arg_max(F.col("o_totalprice"), F.col("o_orderkey")).alias("o_orderkey"))
