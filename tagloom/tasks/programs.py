"""Programs in the loop language, and the same operators of the array layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.columns import links
from tagloom.loops.program import program
from tagloom.operators import arrays
from tagloom.registry import query, table
from tagloom.session import cut, stored


def _one(spark: SparkSession, **values: object) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


@query("SELECT round(avg(l_extendedprice), 4) AS x, count(*) AS n FROM lineitem")
def loop_average(spark: SparkSession, sf: str) -> DataFrame:
    out = program(spark, "var s: Double = 0.0; var n: Long = 0; for a in A do { s += a; n += 1; }; var x: Double = s / n;", A=table(spark, sf, "lineitem").select("l_extendedprice"))
    return _one(spark, x=round(out["x"], 4), n=out["n"])


@query("SELECT sum(l_quantity) AS s, count(*) AS n FROM lineitem WHERE l_quantity < 25")
def loop_conditional_sum(spark: SparkSession, sf: str) -> DataFrame:
    out = program(spark, "var s: Double = 0.0; var n: Long = 0; for a in A do if (a < 25.0) { s += a; n += 1; };", A=table(spark, sf, "lineitem").select("l_quantity"))
    return _one(spark, s=out["s"], n=out["n"])


@query("SELECT bool_and(length(o_orderpriority) > 2) AS ok, bool_or(o_orderpriority = '1-URGENT') AS some FROM orders")
def loop_equal_and_match(spark: SparkSession, sf: str) -> DataFrame:
    """All strings pass, some string matches."""
    out = program(spark, 'var ok: Boolean = true; var hit: Boolean = false; for w in W do { ok &&= size(w) > 2; hit ||= w == "1-URGENT"; };', W=table(spark, sf, "orders").select("o_orderpriority"), size=F.length)
    return _one(spark, ok=out["ok"], some=out["hit"])


@query("SELECT k, count(*) AS v FROM (SELECT unnest(string_split(text, ' ')) AS k FROM documents) GROUP BY k")
def loop_word_count(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").select(F.explode(F.split("text", " ", -1)).alias("w"))
    return program(spark, "var C: map[String,Long] = map(); for w in W do C[w] += 1;", W=words)["C"]


@query("SELECT k, count(*) AS v FROM (SELECT l_linenumber AS k FROM lineitem) GROUP BY k")
def loop_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return program(spark, "var H: map[Int,Long] = map(); for p in P do H[p] += 1;", P=table(spark, sf, "lineitem").select("l_linenumber"))["H"]


@query("SELECT k, sum(v) AS v FROM (SELECT l_suppkey AS k, l_quantity AS v FROM lineitem) GROUP BY k")
def loop_group_by(spark: SparkSession, sf: str) -> DataFrame:
    return program(spark, "var G: map[Long,Double] = map(); for (k,v) in V do G[k] += v;", V=table(spark, sf, "lineitem").select("l_suppkey", "l_quantity"))["G"]


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def loop_linear_regression(spark: SparkSession, sf: str) -> DataFrame:
    """The normal equations: five sums of one loop, one scan."""
    text = """var n: Long = 0; var a: Double = 0.0; var b: Double = 0.0; var aa: Double = 0.0; var ab: Double = 0.0;
        for (q, price) in P do { n += 1; a += q; b += price; aa += q*q; ab += q*price; };
        var slope: Double = (n*ab - a*b) / (n*aa - a*a); var intercept: Double = (b - slope*a) / n;"""
    out = program(spark, text, P=table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice"))
    return _one(spark, slope=round(out["slope"], 6), intercept=round(out["intercept"], 3))


@query("WITH RECURSIVE t(n, x) AS (SELECT 0, 1.0::DOUBLE UNION ALL SELECT n + 1, x * 1.5 FROM t WHERE n < 6) SELECT max(x) AS x FROM t")
def loop_while(spark: SparkSession, sf: str) -> DataFrame:
    out = program(spark, "var n: Int = 0; var x: Double = 1.0; while (n < 6) { n := n + 1; x := x * 1.5; };")
    return _one(spark, x=out["x"])


@query("WITH d AS (SELECT vec_id AS i, unnest(generate_series(0, len(embedding) - 1)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT a.j AS i, b.j AS j, round(covar_samp(a.v, b.v), 8) AS v FROM d a JOIN d b ON a.i = b.i GROUP BY ALL")
def pca_covariance(spark: SparkSession, sf: str) -> DataFrame:
    """Over all dimensions of the embeddings."""
    x = table(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")).withColumn("v", F.col("v").cast("double"))
    x = cut(x.withColumn("j", F.col("j").cast("long")))
    rows, dims = x.agg(F.countDistinct("i"), F.max("j") + 1).first()
    return arrays.covariance(x, rows, dims).withColumn("v", F.round("v", 8))


@query("WITH d AS (SELECT vec_id AS i, unnest(generate_series(0, len(embedding) - 1)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT a.j AS i, b.j AS j, round(covar_samp(a.v, b.v), 8) AS v FROM d a JOIN d b ON a.i = b.i GROUP BY ALL")
def loop_pca_covariance(spark: SparkSession, sf: str) -> DataFrame:
    """The covariance matrix as a loop program: sums of columns, then products of what each cell is off its mean."""
    x = table(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v"))
    x = cut(x.select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")))
    text = """external n: Long; var S: vector[Double] = vector(); var C: matrix[Double] = matrix();
        for r = 0, X.rows-1 do for a = 0, X.cols-1 do S[a] += X[r,a];
        for r = 0, X.rows-1 do for a = 0, X.cols-1 do for b = 0, X.cols-1 do C[a,b] += (X[r,a] - S[a]/n) * (X[r,b] - S[b]/n) / (n-1);"""
    return program(spark, text, X=x, n=x.agg(F.countDistinct("i")).first()[0])["C"].withColumn("v", F.round("v", 8))


_RANKS = ", ".join(f"p{s} AS (SELECT v.i, 0.15::DOUBLE / any_value(n) + 0.85::DOUBLE * coalesce(sum(p.v / c.c), 0) AS v FROM v LEFT JOIN e ON e.j = v.i LEFT JOIN p{s - 1} p ON p.i = e.i LEFT JOIN c ON c.i = e.i GROUP BY v.i)" for s in (1, 2, 3))


@query(
    f"""WITH e AS (SELECT DISTINCT l_suppkey AS i, l_partkey AS j FROM lineitem), m AS (SELECT greatest(max(i), max(j)) + 1 AS n FROM e),
    v AS (SELECT unnest(generate_series(0, n - 1)) AS i, n FROM m), c AS (SELECT i, count(*) AS c FROM e GROUP BY i), p0 AS (SELECT i, 1.0::DOUBLE / n AS v FROM v), {_RANKS}
    SELECT i, round(v, 10) AS v FROM p3"""
)
def loop_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    """Three rounds over the graph whose edges lead from each supplier's number to its parts' numbers."""
    e = cut(table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("long").alias("i"), F.col("l_partkey").cast("long").alias("j")).distinct().withColumn("v", F.lit(1.0)))
    text = """var n: Long = E.rows; if (E.cols > n) n := E.cols;
        var D: vector[Double] = vector(); for a = 0, n-1 do for b = 0, n-1 do D[a] += E[a,b];
        var P: vector[Double] = vector(); for a = 0, n-1 do P[a] := 1.0 / n;
        var rounds: Int = 0;
        while (rounds < 3) {
            var Q: vector[Double] = vector();
            for b = 0, n-1 do Q[b] := 0.15 / n;
            for a = 0, n-1 do for b = 0, n-1 do Q[b] += 0.85 * P[a] * E[a,b] / D[a];
            P := Q; rounds += 1;
        };"""
    return program(spark, text, E=e)["P"].withColumn("v", F.round("v", 10))


# ---------------------------------------------------------------- matrices of all cells of supplier x part


def _matrix(spark: SparkSession, sf: str, extra: int = 0) -> DataFrame:
    x = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("i"), (F.col("l_partkey") + extra).alias("j"), "l_quantity")
    return stored(x.groupBy("i", "j").agg(F.sum("l_quantity").alias("v")))


def _cells(extra: int = 0) -> str:
    return f"(SELECT l_suppkey AS i, l_partkey + {extra} AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


@query(f"SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {_cells()} a JOIN {_cells(1)} b ON a.j = b.i GROUP BY ALL")
def loop_matrix_multiply(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that no product reaches stay absent: explicit zeros would be suppliers x parts many."""
    m = _matrix(spark, sf)
    n = m.withColumn("j", F.col("j") + 1)
    i, k = m.agg(F.max("i"), F.max("j")).first()
    j = None if k is None else k + 1
    text = "var Z: matrix[Double] = matrix(); for part = 0, parts do for row = 0, rows do for col = 0, cols do Z[row,col] += N[part,col] * M[row,part];"
    return program(spark, text, M=m, N=n, rows=i, cols=j, parts=k)["Z"]


@query(f"SELECT i, j, a.v + b.v AS v FROM {_cells()} a JOIN {_cells()} b USING (i, j)")
def loop_matrix_add(spark: SparkSession, sf: str) -> DataFrame:
    m = _matrix(spark, sf)
    i, j = m.agg(F.max("i"), F.max("j")).first()
    return program(spark, "var R: matrix[Double] = matrix(); for i = 0, ni do for j = 0, nj do R[i,j] := M[i,j]+N[i,j];", M=m, N=m, ni=i, nj=j)["R"]


@query(f"SELECT sum(v) AS s FROM {_cells()} WHERE i % 2 = 0 AND j = i + 1")
def loop_affine_index(spark: SparkSession, sf: str) -> DataFrame:
    m = _matrix(spark, sf)
    out = program(spark, "var s: Double = 0.0; for i = 0, ni, 2 do s += M[i,i+1];", M=m, ni=m.agg(F.max("i")).first()[0])
    return _one(spark, s=out["s"])


@query(f"SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {_cells()} a JOIN {_cells(1)} b ON a.j = b.i GROUP BY ALL")
def array_multiply(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.multiply(_matrix(spark, sf), _matrix(spark, sf, 1))


@query(f"SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, coalesce(a.v, 0) + coalesce(b.v, 0) AS v FROM {_cells()} a FULL JOIN {_cells(1)} b ON a.i = b.i AND a.j = b.j")
def array_increment(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.increment(_matrix(spark, sf), _matrix(spark, sf, 1))


@query(f"SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, coalesce(b.v, a.v) AS v FROM {_cells()} a FULL JOIN (SELECT i, j, -v AS v FROM {_cells(1)}) b ON a.i = b.i AND a.j = b.j")
def array_update(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.update(_matrix(spark, sf), _matrix(spark, sf, 1).withColumn("v", -F.col("v")))


_FACTORIZATION = f"""WITH r AS (SELECT i, j, v / 50 AS v FROM {_cells()}), f AS (SELECT unnest([0, 1]) AS f),
    p AS (SELECT i, f, 0.3 + (i + f) % 5 / 10 AS p FROM (SELECT DISTINCT i FROM r), f), q AS (SELECT j, f, 0.3 + (j + f) % 5 / 10 AS q FROM (SELECT DISTINCT j FROM r), f),
    e AS (SELECT r.i, r.j, any_value(v) - sum(p * q) AS e FROM r JOIN p ON p.i = r.i JOIN q ON q.j = r.j AND q.f = p.f GROUP BY r.i, r.j),
    p1 AS (SELECT p.i, p.f, any_value(p) + 0.002 * (2 * sum(e * q) - 0.02 * count(*) * any_value(p)) AS p FROM p JOIN e ON e.i = p.i JOIN q ON q.j = e.j AND q.f = p.f GROUP BY p.i, p.f),
    q1 AS (SELECT q.j, q.f, any_value(q) + 0.002 * (2 * sum(e * p) - 0.02 * count(*) * any_value(q)) AS q FROM q JOIN e ON e.j = q.j JOIN p ON p.i = e.i AND p.f = q.f GROUP BY q.j, q.f),
    e1 AS (SELECT r.i, r.j, any_value(v) - sum(p * q) AS e FROM r JOIN p1 ON p1.i = r.i JOIN q1 ON q1.j = r.j AND q1.f = p1.f GROUP BY r.i, r.j)
    SELECT 0 AS step, round(sum(e * e), 4) AS error FROM e UNION ALL SELECT 1, round(sum(e * e), 4) FROM e1"""


@query(_FACTORIZATION)
def matrix_factorization(spark: SparkSession, sf: str) -> DataFrame:
    """Squared error of R ~ P x Q, over the known cells of suppliers by parts, before and after a gradient step."""
    r = cut(_matrix(spark, sf).withColumn("v", F.col("v") / 50))
    f = F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))
    p = cut(r.select("i").distinct().select("i", f.alias("j")).withColumn("v", F.lit(0.3) + (F.col("i") + F.col("j")) % 5 / 10))
    q = cut(r.select("j").distinct().select(f.alias("i"), "j").withColumn("v", F.lit(0.3) + (F.col("i") + F.col("j")) % 5 / 10))
    errors = []
    for step in range(2):
        e = arrays.errors(r, p, q)
        errors.append(e.agg(F.lit(step).alias("step"), F.round(F.sum(F.col("v") * F.col("v")), 4).alias("error")))
        if step < 1:
            p, q = (cut(x) for x in arrays.factorize_step(r, p, q))
    return errors[0].union(errors[1])


@query(_FACTORIZATION)
def loop_factorization(spark: SparkSession, sf: str) -> DataFrame:
    """The same step as a loop program; a condition on a known cell keeps the product to these."""
    r = cut(_matrix(spark, sf).withColumn("v", F.col("v") / 50))
    f = F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))
    p = cut(r.select("i").distinct().select("i", f.alias("j")).withColumn("v", F.lit(0.3) + (F.col("i") + F.col("j")) % 5 / 10))
    q = cut(r.select("j").distinct().select(f.alias("i"), "j").withColumn("v", F.lit(0.3) + (F.col("i") + F.col("j")) % 5 / 10))
    cells = "for i = 0, R.rows-1 do for j = 0, R.cols-1 do"
    off = f"""var W: matrix[Double] = matrix(); var E: matrix[Double] = matrix();
        {cells} for f = 0, 1 do if (R[i,j] > 0.0) W[i,j] += P[i,f] * Q[f,j];
        {cells} E[i,j] := R[i,j] - W[i,j];"""
    text = f"""{off} var before: Double = 0.0; {cells} before += E[i,j] * E[i,j];
        var U: matrix[Double] = P; var V: matrix[Double] = Q;
        {cells} for f = 0, 1 do U[i,f] += 0.002 * (2.0 * E[i,j] * Q[f,j] - 0.02 * P[i,f]);
        {cells} for f = 0, 1 do V[f,j] += 0.002 * (2.0 * E[i,j] * P[i,f] - 0.02 * Q[f,j]);
        P := U; Q := V; {off} var after: Double = 0.0; {cells} after += E[i,j] * E[i,j];"""
    out = program(spark, text, R=r, P=p, Q=q)
    return _one(spark, step=0, error=round(out["before"], 4)).union(_one(spark, step=1, error=round(out["after"], 4)))


@query("""SELECT link AS k, string_agg(page_id::VARCHAR, ',' ORDER BY page_id) AS v FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1)) AS link FROM pages) GROUP BY link""")
def reverse_index(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "pages").select("page_id", F.explode(links(F.col("html"))).alias("k"))
    return found.groupBy("k").agg(F.array_join(F.sort_array(F.collect_list("page_id")).cast("array<string>"), ",").alias("v"))


@query("SELECT i, o_orderkey FROM (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i, o_orderkey FROM orders) WHERE i < 100")
def indexed_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Rows numbered in order, without one task that sees all of them."""
    return arrays.with_index(table(spark, sf, "orders"), ["o_totalprice", "o_orderkey"]).where("i < 100").select("i", "o_orderkey")
