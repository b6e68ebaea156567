"""Queries in the comprehension language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.lang.query import define, query as ask
from tagloom.registry import query, table

_CUSTOMERS = "(SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer)"


def _env(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {
        "C": table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"),
        "O": table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"),
        "N": table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"),
        "R": table(spark, sf, "region").select("r_regionkey", "r_name"),
        "S": table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"),
        "L": table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", "l_discount"),
    }


def lang(name: str, text: str, columns: list[str], sql: str, doubles: tuple[str, ...] = (), **more) -> None:
    """Registers a query text under ``lang_<name>``; its result's columns get these names, sums of doubles are rounded."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return ask(spark, text, **_env(spark, sf), **more).toDF(*columns).withColumns({c: F.round(c, 4) for c in doubles})

    run.__doc__ = text
    query(f"SELECT {', '.join(f'round({c}, 4) AS {c}' if c in doubles else c for c in columns)} FROM ({sql})", f"lang_{name}")(run)


lang("count", "count/O", ["n"], "SELECT count(*) AS n FROM orders")
lang("avg_filter", "let m = avg/(select p from (o,c,p) <- O where o%2==0) in (m+0.0)", ["m"], "SELECT avg(o_totalprice) AS m FROM orders WHERE o_orderkey % 2 = 0", ("m",))
lang("projection", "select (k+1, n) from (k,n,r) <- N where r < 3", ["k", "n"], "SELECT n_nationkey + 1 AS k, n_name AS n FROM nation WHERE n_regionkey < 3")
lang("refutable_pattern", "select n from (k,n,2) <- N", ["n"], "SELECT n_name AS n FROM nation WHERE n_regionkey = 2")
lang("equi_join", "select (c, o) from (k,c,n,b) <- C, (o,k2,p) <- O where k == k2 && p > 100000.0", ["c", "o"], f"SELECT c_name AS c, o_orderkey AS o FROM {_CUSTOMERS} JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000")
lang("small_side_join", "select (c, n) from (k,c,a,b) <- C, (a2,n,r) <-- N where a == a2", ["c", "n"], f"SELECT c_name AS c, n_name AS n FROM {_CUSTOMERS} JOIN nation ON c_nationkey = n_nationkey")
lang("multiway_join", "select (c, n, r) from (k,c,a,b) <- C, (a2,n,q) <- N, (q2,r) <- R where a == a2 && q == q2", ["c", "n", "r"], f"SELECT c_name AS c, n_name AS n, r_name AS r FROM {_CUSTOMERS} JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
lang("theta_join", "select (a, b) from (i,a,_) <- N, (j,b,_) <- N where i < j", ["a", "b"], "SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey")
lang("cross", "count/(select (a,b) from (i,a,_) <- N, (r,b) <- R)", ["n"], "SELECT count(*) AS n FROM nation, region")
lang("group_by", "select (f, s, count/q, max/q) from (o,f,s,q,d) <- L group by (f,s)", ["f", "s", "n", "m"], "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n, max(l_quantity) AS m FROM lineitem GROUP BY ALL")
lang("group_having_order", "select (c, count/o) from (o,c,p) <- O group by c having count/o > 12 order by (count/o desc, c asc)", ["c", "n"], "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
lang("group_key_expression", "select (k, count/o) from (o,c,p) <- O group by k: c % 10", ["k", "n"], "SELECT o_custkey % 10 AS k, count(*) AS n FROM orders GROUP BY 1")
lang("nested_group_values", "select (r, joined(n)) from (k,n,r) <- N group by r", ["r", "n"], "SELECT n_regionkey AS r, string_agg(n_name, ',' ORDER BY n_name) AS n FROM nation GROUP BY 1", joined=lambda x: F.array_join(F.sort_array(x), ","))
lang("distinct", "select distinct (f, s) from (o,f,s,q,d) <- L", ["f", "s"], "SELECT DISTINCT l_returnflag AS f, l_linestatus AS s FROM lineitem")
lang("order_by", "select (p, o) from (o,c,p) <- O order by (p desc)", ["p", "o"], "SELECT o_totalprice AS p, o_orderkey AS o FROM orders")
lang("corr_scalar_sum", "select c from (k,c,n,b) <- C where b < +/(select p from (o,k2,p) <- O where k2 == k) / 100.0", ["c"], f"SELECT c_name AS c FROM {_CUSTOMERS} WHERE c_acctbal < coalesce((SELECT sum(o_totalprice) FROM orders WHERE o_custkey = c_custkey), 0) / 100.0")
lang("corr_count_zero", "select (c, count/(select o from (o,k2,p) <- O where k2 == k && p > 200000.0)) from (k,c,n,b) <- C", ["c", "n"], f"SELECT c_name AS c, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS n FROM {_CUSTOMERS}")
lang("nested_collect", "select (n, count/(select c from (k,c,a,b) <- C where a == i && b > 9000.0)) from (i,n,_) <- N", ["n", "rich"], f"SELECT n_name AS n, (SELECT count(*) FROM {_CUSTOMERS} WHERE c_nationkey = n_nationkey AND c_acctbal > 9000) AS rich FROM nation")
lang("some", "select n from (i,n,_) <- N where some (s,a,b) <- S: a == i && b > 9000.0", ["n"], "SELECT n_name AS n FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
lang("all", "select n from (i,n,_) <- N where all (s,a,b) <- S: a != i || b > 0.0", ["n"], "SELECT n_name AS n FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND NOT s_acctbal > 0)")
lang("member", "select c from (k,c,n,b) <- C where k member (select o2 from (o,o2,p) <- O where p > 300000.0)", ["c"], f"SELECT c_name AS c FROM {_CUSTOMERS} WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
lang("union", "(select n from (i,n,r) <- N where r == 1) union (select n from (i,n,r) <- N where i < 10)", ["n"], "SELECT n_name AS n FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_name FROM nation WHERE n_nationkey < 10")
lang("intersect", "(select r from (i,n,r) <- N where i < 20) intersect (select r from (i,n,r) <- N where i > 21)", ["r"], "SELECT n_regionkey AS r FROM nation a WHERE n_nationkey < 20 AND EXISTS (SELECT 1 FROM nation b WHERE b.n_nationkey > 21 AND b.n_regionkey = a.n_regionkey)")
lang("minus", "(select r from (i,n,r) <- N where i < 20) minus (select r from (i,n,r) <- N where i > 21)", ["r"], "SELECT n_regionkey AS r FROM nation a WHERE n_nationkey < 20 AND NOT EXISTS (SELECT 1 FROM nation b WHERE b.n_nationkey > 21 AND b.n_regionkey = a.n_regionkey)")
lang("cogroup", "select (k, +/b, count/s) from (c,nm,n,b) <- C where b > 9500.0 group by k: n from (s,a,x) <- S where x > 5000.0 group by k: a", ["k", "b", "s"], f"SELECT coalesce(a.k, b.k) AS k, coalesce(a.b, 0.0) AS b, coalesce(b.s, 0) AS s FROM (SELECT c_nationkey AS k, sum(c_acctbal) AS b FROM {_CUSTOMERS} WHERE c_acctbal > 9500 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS s FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k", ("b",))
lang("match", 'select (n, r match { case 0 => "zero" case x by x > 2 => "large" case _ => "other" }) from (i,n,r) <- N', ["n", "size"], "SELECT n_name AS n, CASE WHEN n_regionkey = 0 THEN 'zero' WHEN n_regionkey > 2 THEN 'large' ELSE 'other' END AS size FROM nation")
lang("if_else", 'select (n, if (r > 2) "large" else "small") from (i,n,r) <- N', ["n", "size"], "SELECT n_name AS n, CASE WHEN n_regionkey > 2 THEN 'large' ELSE 'small' END AS size FROM nation")
lang("product_monoid", "select (f, +/q, avg/d, min/q, max/q) from (o,f,s,q,d) <- L group by f", ["f", "q", "d", "lo", "hi"], "SELECT l_returnflag AS f, sum(l_quantity) AS q, avg(l_discount) AS d, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1", ("q", "d"))
lang("repeat_until", "repeat w = (select i from (i,n,r) <- N where i < 4) step (select 3*x + 1 from x <- w) until max/w > 50", ["x"], "SELECT n_nationkey * 81 + 40 AS x FROM nation WHERE n_nationkey < 4")
lang("placeholders", "select (n, xs.map(_ + 1).reduce(_ * _), xs.filter(_ > r).size) from (n,r,xs) <- (select (n, r, List(i, r, 2)) from (i,n,r) <- N)", ["n", "p", "more"], "SELECT n_name AS n, (n_nationkey + 1) * (n_regionkey + 1) * 3 AS p, (n_nationkey > n_regionkey)::INT + (2 > n_regionkey)::INT AS more FROM nation")
lang("case_lambda", 'select (n, xs.map { case 0 => "none" case x by x > 2 => "many" case _ => "few" }.head) from (n,xs) <- (select (n, List(r)) from (i,n,r) <- N)', ["n", "size"], "SELECT n_name AS n, CASE WHEN n_regionkey = 0 THEN 'none' WHEN n_regionkey > 2 THEN 'many' ELSE 'few' END AS size FROM nation")
lang("rest_pattern", "select (n, a, others.size) from (n, List(a, others@_*)) <- (select (n, List(i, r, 7)) from (i,n,r) <- N)", ["n", "a", "others"], "SELECT n_name AS n, n_nationkey AS a, 2 AS others FROM nation")
lang("top_one", "let best = (select (p, o) from (o,c,p) <- O order by (p desc, o asc)).head in best#2", ["o"], "SELECT o_orderkey AS o FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
lang("nested_group_by", "select (n, z, q) from (n, xs) <- (select (n, (select (z, count/k + r) from (k,c,a,b) <- C where a == i group by z: b > 5000.0)) from (i,n,r) <- N), (z,q) <- xs", ["n", "rich", "q"], f"SELECT n_name AS n, c_acctbal > 5000 AS rich, count(*) + any_value(n_regionkey) AS q FROM nation JOIN {_CUSTOMERS} ON c_nationkey = n_nationkey GROUP BY ALL")
lang("nested_customers_orders", "select (c, x) from (c, xs) <- (select (c, (select p from (o,k2,p) <- O where k2 == k && p > +/(select b2 from (k3,c3,n3,b2) <- C where k3 == k2) * 40.0)) from (k,c,n,b) <- C where n == 3), x <- xs", ["c", "p"], f"SELECT c_name AS c, o_totalprice AS p FROM {_CUSTOMERS} JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3 AND o_totalprice > c_acctbal * 40.0")
lang("integer_division", "select (i, i / 4) from (i,n,r) <- N", ["i", "q"], "SELECT n_nationkey AS i, n_nationkey // 4 AS q FROM nation")
lang("user_function", "select twice(i) from (i,n,r) <- N", ["t"], "SELECT n_nationkey * 2 AS t FROM nation", twice=lambda x: x * 2)
lang("dependent_generator", "select (r, x) from (r, ns) <- (select (r, n) from (k,n,r) <- N group by r), x <- ns", ["r", "x"], "SELECT n_regionkey AS r, n_name AS x FROM nation")

_rich = define("def rich(xs, least) = select c from (k,c,n,b) <- xs where b > least")


@query(f"SELECT c_name AS value FROM {_CUSTOMERS} WHERE c_acctbal > 9800")
def lang_macro(spark: SparkSession, sf: str) -> DataFrame:
    return _rich(spark, _env(spark, sf)["C"], 9800.0)


# ---------------------------------------------------------------- whole workloads as query text

_KMEANS_STEP = "SELECT m, round(avg(x), 6) AS a, round(avg(y), 6) AS c FROM (SELECT x, y, arg_min(m, ((x - a) * (x - a) + (y - c) * (y - c), m)) AS m FROM p, {} GROUP BY k, x, y) GROUP BY m"


@query("WITH p AS (SELECT c_custkey AS k, c_acctbal / 100.0 AS x, c_nationkey * 4.0 AS y FROM customer), m0 AS (SELECT n_nationkey AS m, n_nationkey * 20.0 AS a, n_regionkey * 24.0 AS c FROM nation WHERE n_nationkey < 5), " + ", ".join(f"m{i + 1} AS ({_KMEANS_STEP.format(f'm{i}')})" for i in range(3)) + " SELECT m, a, c FROM m3")
def lang_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    """Five means of all customers by balance and nation, three steps."""
    text = """repeat M = (select (i, i * 20.0, r * 24.0) from (i,n,r) <- N where i < 5)
        step (select (m, r6(avg/x), r6(avg/y)) from (b,x,y) <-
                (select (min/(select ((x-a)*(x-a) + (y-c)*(y-c), m) from (m,a,c) <- M), x, y) from (x,y) <- P)
              group by m: b#2)
        limit 3"""
    points = table(spark, sf, "customer").select((F.col("c_acctbal") / 100.0).alias("x"), (F.col("c_nationkey") * 4.0).alias("y"))
    return ask(spark, text, P=points, r6=lambda x: F.round(x, 6), **_env(spark, sf)).toDF("m", "a", "c")


_TRADES = "e AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS d FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem), k AS (SELECT s, count(*) AS k FROM e GROUP BY s), n AS (SELECT count(*) AS n FROM k), r0 AS (SELECT s AS p, 1.0::DOUBLE / n AS r FROM k, n)"
_RANK_STEP = "SELECT e.d AS p, 0.15 / any_value(n.n) + 0.85 * sum(r.r / k.k) AS r FROM e JOIN k USING (s) JOIN {} r ON r.p = e.s CROSS JOIN n GROUP BY e.d"


@query(f"WITH {_TRADES}, " + ", ".join(f"r{i + 1} AS ({_RANK_STEP.format(f'r{i}')})" for i in range(3)) + " SELECT p, round(r, 10) AS r FROM r3")
def lang_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks of all suppliers and parts that trade, by what flows along each edge."""
    x = table(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("s"), F.concat(F.lit("p"), "l_partkey").alias("d")).distinct()
    edges = x.union(x.select("d", "s"))
    degrees = ask(spark, "select (s, count/d) from (s,d) <- E group by s", E=edges)
    n = degrees.count()
    text = "repeat R = (select (s, 1.0 / n) from (s,k) <- D) step (select (d, 0.15 / n + 0.85 * (+/g)) from (s,d) <- E, (t,k) <- D, (p,r) <- R, g = r / k where s == t && p == s group by d) limit 3"
    return ask(spark, text, E=edges, D=degrees, n=n).toDF("p", "r").withColumn("r", F.round("r", 10))


_CELLS = "(SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum("l_quantity").alias("v"))


@query(f"SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM {_CELLS} a JOIN {_CELLS} b ON a.j = b.j GROUP BY ALL")
def lang_matrix_multiply(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers by parts, times its transpose."""
    m = _cells(spark, sf)
    return ask(spark, "select (i, l, +/z) from (i,j,a) <- M, (l,k,b) <- M, z = a * b where j == k group by (i,l)", M=m).toDF("i", "j", "v")


def _factor_sql() -> str:
    """Two gradient steps of R ~ P x Q with 2 factors, rate 0.002 and penalty 0.02."""
    factors = f"r AS {_CELLS}, p0 AS (SELECT i, f, 0.3 + (i + f) % 5 / 10 AS p FROM (SELECT DISTINCT i FROM r), (SELECT unnest([0, 1]) AS f)), q0 AS (SELECT j, f, 0.3 + (j + 2 * f) % 7 / 10 AS q FROM (SELECT DISTINCT j FROM r), (SELECT unnest([0, 1]) AS f))"
    out = [factors]
    for n in range(2):
        out += [
            f"e{n} AS (SELECT r.i, r.j, any_value(v) / 50 - sum(p * q) AS e FROM r JOIN p{n} p ON p.i = r.i JOIN q{n} q ON q.j = r.j AND q.f = p.f GROUP BY r.i, r.j)",
            f"p{n + 1} AS (SELECT p.i, p.f, any_value(p) + 0.002 * (2 * sum(e * q) - 0.02 * any_value(p)) AS p FROM p{n} p JOIN e{n} e ON e.i = p.i JOIN q{n} q ON q.j = e.j AND q.f = p.f GROUP BY p.i, p.f)",
            f"q{n + 1} AS (SELECT q.j, q.f, any_value(q) + 0.002 * (2 * sum(e * p) - 0.02 * any_value(q)) AS q FROM q{n} q JOIN e{n} e ON e.j = q.j JOIN p{n} p ON p.i = e.i AND p.f = q.f GROUP BY q.j, q.f)",
        ]
    return "WITH " + ", ".join(out) + " SELECT i, f, round(p, 8) AS p FROM p2"


@query(_factor_sql())
def lang_factorization(spark: SparkSession, sf: str) -> DataFrame:
    """Factors of suppliers by parts: a repeat over two bags, each step from the state before it."""
    r = _cells(spark, sf).withColumn("v", F.col("v") / 50)
    fs = F.explode(F.array(F.lit(0), F.lit(1)))
    p = r.select("i").distinct().select("i", fs.alias("f")).withColumn("p", F.lit(0.3) + (F.col("i") + F.col("f")) % 5 / 10)
    q = r.select("j").distinct().select("j", fs.alias("f")).withColumn("q", F.lit(0.3) + (F.col("j") + 2 * F.col("f")) % 7 / 10)
    error = "(select (i, j, max/v - (+/z)) from (i,j,v) <- R, (i2,f,p) <- P, (j2,g,q) <- Q, z = p * q where i == i2 && j == j2 && f == g group by (i,j))"
    text = f"""repeat (P, Q) = (P0, Q0)
        step ((select (i, f, max/p + 0.002 * (2.0 * (+/z) - 0.02 * (max/p))) from (i,f,p) <- P, (i2,j,e) <- {error}, (j2,g,q) <- Q, z = e * q where i == i2 && j == j2 && f == g group by (i,f)),
              (select (j, f, max/q + 0.002 * (2.0 * (+/z) - 0.02 * (max/q))) from (j,f,q) <- Q, (i,j2,e) <- {error}, (i2,g,p) <- P, z = e * p where j == j2 && i == i2 && f == g group by (j,f)))
        limit 2"""
    return ask(spark, text, R=r, P0=p, Q0=q)[0].toDF("i", "f", "p").withColumn("p", F.round("p", 8))
