"""The query and loop languages over a small table of stations, against answers made in plain Python."""

import random

import pytest

from tagloom.functions import monoids
from tagloom.lang.query import debug, define, queries, query
from tagloom.lang.syntax import Parser
from tagloom.loops.program import Program, program
from tagloom.streaming.incremental import monoid_of

# name, line, height, temperatures
STATIONS = [("Brenner", 1, 1371, [4, 7, 1]), ("Gotthard", 2, 2106, [0, -3]), ("Furka", 2, 2429, []), ("Arlberg", 1, 1793, [2, 2, 9, 5]), ("Semmering", 3, 984, [11]), ("Bernina", 4, 2328, [-5, -1, 3])]
LINES = [(1, "east"), (2, "centre"), (3, "far east"), (5, "north")]
NAMES = {k: n for k, n in LINES}


@pytest.fixture(scope="module")
def env(spark):
    s = spark.createDataFrame(STATIONS, "name string, line long, height long, temps array<long>").cache()
    ln = spark.createDataFrame(LINES, "id long, title string").cache()
    ln.count()  # a cached table's size is known once it is filled
    return {"St": s, "Ln": ln, "Num": spark.range(1, 31)}


CASES = {
    "count/St": [len(STATIONS)],
    "max/(select h from (_,_,h,_) <- St)": [max(h for _, _, h, _ in STATIONS)],
    "avg/(select 2*n from n <- Num where n % 3 == 0)": [33.0],
    "select (s, h / 100) from (s,_,h,_) <- St where h > 2000": [(s, h // 100) for s, _, h, _ in STATIONS if h > 2000],
    "select s from (s,2,_,_) <- St": [s for s, n, _, _ in STATIONS if n == 2],
    "select (s, t) from (s,_,_,ts) <- St, t <- ts where t < 0": [(s, t) for s, _, _, ts in STATIONS for t in ts if t < 0],
    "select (s, +/ts, count/ts) from (s,_,_,ts) <- St": [(s, sum(ts), len(ts)) for s, _, _, ts in STATIONS],
    "select (s, avg/ts) from (s,_,_,ts) <- St where ts.nonEmpty": [(s, sum(ts) / len(ts)) for s, _, _, ts in STATIONS if ts],
    "select (s, n) from (s,l,_,_) <- St, (k,n) <- Ln where k == l": [(s, NAMES[n]) for s, n, _, _ in STATIONS if n in NAMES],
    "count/(select (a,b) from (a,_,h,_) <- St, (b,_,g,_) <- St where h < g)": [15],
    "select (l, count/s, max/h) from (s,l,h,_) <- St group by l": [(1, 2, 1793), (2, 2, 2429), (3, 1, 984), (4, 1, 2328)],
    "select l from (s,l,h,_) <- St group by l having +/h > 2200": [1, 2, 4] if 1371 + 1793 > 2200 else [],
    "select (b, count/s) from (s,_,h,_) <- St group by b: h / 1000": [(0, 1), (1, 2), (2, 3)],
    "select (k, count/s, count/n) from (s,l,_,_) <- St group by k: l from (i,n) <- Ln group by k: i": [(1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 1, 0), (5, 0, 1)],
    "select (n, count/(select s from (s,l,_,_) <- St where l == k)) from (k,n) <- Ln": [(n, sum(l == k for _, l, _, _ in STATIONS)) for k, n in LINES],
    "select (n, +/(select h from (_,l,h,_) <- St where l == k)) from (k,n) <- Ln": [(n, sum(h for _, l, h, _ in STATIONS if l == k)) for k, n in LINES],
    "select n from (k,n) <- Ln where some (_,l,h,_) <- St: l == k && h > 2000": ["centre"],
    "select n from (k,n) <- Ln where all (_,l,h,_) <- St: l != k || h > 1500": ["centre", "north"],
    "some (_,_,h,_) <- St: h > 2400": [True],
    "all (_,_,h,_) <- St: h > 1000": [False],
    "let low = 1000, high = 2000 in high - low": [1000],
    "select if (h > 2000) \"pass\" else \"saddle\" from (_,_,h,_) <- St where h > 1500": ["pass", "pass", "pass", "saddle"],
    "select (s, ts.map(t => t * 10).sum) from (s,_,_,ts) <- St where ts.exists(t => t > 8)": [("Arlberg", 180), ("Semmering", 110)],
    "select (s, ts.map(_ + 1).reduce(_ + _)) from (s,_,_,ts) <- St where ts.size > 2": [("Brenner", 15), ("Arlberg", 22), ("Bernina", 0)],
    "select (s, ts.filter { case 2 => false case t by t > 4 => true case _ => false }.size) from (s,1,_,ts) <- St": [("Brenner", 1), ("Arlberg", 2)],
    "select (s, a, more.size) from (s,_,_,List(a, more@_*)) <- St": [(s, ts[0], len(ts) - 1) for s, _, _, ts in STATIONS if ts],
    "select t from (_,_,_,t::rest) <- St where rest.size == 1": [0],
    "select (s, zs@List(11)) from (s,_,_,zs@List(11)) <- St".replace("(s, zs@List(11)) from", "(s, zs.head) from"): [("Semmering", 11)],
    "(select l from (_,l,_,_) <- St where l > 2) minus (select k from (k,_) <- Ln)": [4],
    "(select l from (_,l,_,_) <- St) intersect (select k from (k,_) <- Ln where k > 2)": [3],
    "select s from (s,l,_,_) <- St where l member List(3, 4)": ["Bernina", "Semmering"],
    "select x from x <- range(5, 20, 5)": [5, 10, 15, 20],
    "repeat w = List(1, 5) step w.map(_ * 3) limit 2": [9, 45],
    "repeat w = Num step (select n from n <- w where n % 2 == 0) limit 1": [n for n in range(1, 31) if n % 2 == 0],
    "let top = (select (h, s) from (s,_,h,_) <- St order by (h desc)).head in top#2": ["Furka"],
}


@pytest.mark.parametrize("text", CASES)
def test_query(spark, env, text):
    got = [r[0] if len(r) == 1 else tuple(r) for r in query(spark, text, **env).collect()]
    assert sorted(got) == sorted(CASES[text])


def test_nested_results(spark, env):
    """Bags in rows keep rows without elements; a sub-query may group, and one may lie in another."""
    got = {r[0]: sorted(r[1]) for r in query(spark, "select (n, (select s from (s,l,_,_) <- St where l == k)) from (k,n) <- Ln", **env).collect()}
    assert got == {n: sorted(s for s, l, _, _ in STATIONS if l == k) for k, n in LINES}
    got = {r[0]: sorted(map(tuple, r[1])) for r in query(spark, "select (n, (select (b, count/s, k) from (s,l,h,_) <- St where l <= k group by b: h > 2000)) from (k,n) <- Ln", **env).collect()}
    want = {n: sorted((b, sum(l <= k and (h > 2000) == b for _, l, h, _ in STATIONS), k) for b in (False, True) if any(l <= k and (h > 2000) == b for _, l, h, _ in STATIONS)) for k, n in LINES}
    assert got == want
    text = "select (n, (select (s, count/(select t from (t,l2,g,_) <- St where l2 == l && g < h)) from (s,l,h,_) <- St where l == k)) from (k,n) <- Ln"
    got = {r[0]: sorted(map(tuple, r[1])) for r in query(spark, text, **env).collect()}
    assert got == {n: sorted((s, sum(l2 == l and g < h for _, l2, g, _ in STATIONS)) for s, l, h, _ in STATIONS if l == k) for k, n in LINES}


def test_repeat_over_two_bags(spark, env):
    a, b = query(spark, "repeat (a, b) = (List(1, 2), List(10)) step (b, (select x + y from x <- a, y <- b)) limit 2")
    assert (sorted(r[0] for r in a.collect()), sorted(r[0] for r in b.collect())) == ([11, 12], [21, 22])


def test_equi_join_and_small_sides(spark, env):
    join = "select (s,n) from (s,l,_,_) <- St, (k,n) <{} Ln where k == l"
    plan = query(spark, join.format("-"), **env)._jdf.queryExecution()
    assert "CartesianProduct" not in plan.executedPlan().toString() and "NestedLoop" not in plan.executedPlan().toString()
    assert "strategy=broadcast" not in plan.optimizedPlan().toString()
    assert "strategy=broadcast" in query(spark, join.format("--"), **env)._jdf.queryExecution().optimizedPlan().toString()


def test_errors_are_raised(spark, env):
    for bad in ("select from s", "repeat w = Num step w", "select y from y <- missing"):
        with pytest.raises((SyntaxError, NameError)):
            query(spark, bad, **env)
    with pytest.raises(SyntaxError):
        Parser("1 *").expr()


def test_programs(spark):
    a = spark.createDataFrame([(0, 1.5), (1, -4.0), (2, 2.5), (5, 8.0)], "i long, v double")
    out = program(spark, "var pos: Double = 0.0; var cnt: Int = 0; var neg: Double = 0.0; for k = 0, 9 do { cnt += 1; pos += A[k]; neg += A[k] * A[k]; }; var r: Double = pos / 4;", A=a)
    assert (out["pos"], out["neg"], out["r"]) == (pytest.approx(8.0), pytest.approx(88.5), pytest.approx(2.0))
    assert out["cnt"] == 10  # reads no cell, so it isn't held to those that exist
    assert program(spark, "var s: Double = 0.0; for i = 1, 9, 4 do s += A[i];", A=a)["s"] == pytest.approx(4.0)
    rev = program(spark, "var R: vector[Double] = vector(); for i = 0, 5 do R[i] := A[5-i];", A=a)["R"]
    assert {r.i: r.v for r in rev.collect()} == {0: 8.0, 3: 2.5, 4: -4.0, 5: 1.5}
    both = program(spark, "var up: Double = 0.0; var down: Double = 0.0; for v in A do { if (v > 0.0) up += v; else down += v; };", A=a)
    assert (both["up"], both["down"]) == (pytest.approx(12.0), pytest.approx(-4.0))


def test_increments_of_one_loop_are_one_job(spark):
    rows, tracker = spark.range(50).select("id"), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fused", "fused")
    out = program(spark, "var a: Long = 0; var b: Long = 5; var c: Long = 0; for x in X do { a += x; b += x*x; c += 1; };", X=rows)
    jobs = len(tracker.getJobIdsForGroup("fused"))
    spark.sparkContext._jsc.clearJobGroup()
    assert (out["a"], out["b"], out["c"]) == (1225, 40430, 50) and jobs <= 3  # adaptive execution runs a stage as a job


def test_means_are_not_combined(spark):
    x = spark.createDataFrame([([1.0, 2.0, 6.0],)], "xs array<double>")
    from pyspark.sql import functions as F

    assert x.select(monoids.get("avg").fold(F.col("xs"))).first()[0] == 3.0
    with pytest.raises(TypeError):
        monoids.get("avg").combine(F.lit(1), F.lit(2))


def test_monoid_inference():
    assert monoid_of("count/St", "St").ops == ("count",)
    assert monoid_of("select (l, +/h) from (_,l,h,_) <- St group by l", "St").kind == "group"
    assert monoid_of("select (p,q) from p <- St, q <- St", "St").kind == "none"
    assert monoid_of("select p from p <- St where p > 7", "St").kind == "bag"


def test_lineage_of_a_query(spark, env):
    rows = debug(spark, "select n from (k,n) <- Ln, (s,l,h,_) <- St where l == k && h > 1700", **env).collect()
    assert sorted(r.value for r in rows) == ["centre", "centre", "east"]
    assert all([s.source for s in r.lineage] == ["Ln", "St"] for r in rows)
    everything = debug(spark, "select n from (k,n) <- Ln where k > 2", erased=True, **env).collect()
    assert len(everything) == 4 and sum(r.kept for r in everything) == 2
    groups = debug(spark, "select (l, count/s) from (s,l,_,_) <- St group by l", **env).collect()
    assert {r.value: len(r.lineage) for r in groups} == {1: 2, 2: 2, 3: 1, 4: 1}


def test_macros_and_several_queries(spark, env):
    f = define("def over(xs: bag, m: Long) = select s from (s,_,h,_) <- xs where h >= m")
    assert sorted(r[0] for r in f(spark, env["St"], 2106).collect()) == ["Bernina", "Furka", "Gotthard"]
    a, b = queries(spark, "count/Ln; +/(select k from (k,_) <- Ln)", **env)
    assert (a.first()[0], b.first()[0]) == (4, 11)


def test_user_functions(spark, env):
    got = query(spark, "select half(h) from (s,3,h,_) <- St", half=lambda x: x / 2, **env)
    assert [r[0] for r in got.collect()] == [492.0]


def test_sizes_expressions_and_functions(spark, capsys):
    m = spark.createDataFrame([(0, 4, 1.0), (2, 1, 3.0)], "i long, j long, v double")
    v = spark.createDataFrame([(5, 1.0)], "i long, v double")
    text = """def area(x: Double): Double { var y: Double = x * x; var z: Double = y + x; return z };
        var n: Long = V.length; var cells: Long = M.rows * M.cols; var s: Double = 0.0;
        for i = 0, M.rows - 1 do for j = 0, M.cols - 1 do s += area(M[i,j]);
        var none: matrix[Double] = matrix(); var empty: Long = none.rows;
        var W: vector[Double] = vector(); for i = 0, n - 1 do W[i] := 1.0; n := W.length; trace(M);"""
    out = program(spark, text, M=m, V=v)
    assert (out["n"], out["cells"], out["s"], out["empty"]) == (6, 15, 14.0, 0)
    assert "3.0" in capsys.readouterr().out
    with pytest.raises(SyntaxError):
        program(spark, "var s: Double = 0.0; for i = 0, 3 do s + 1.0;")


def test_product_by_blocks(spark, monkeypatch):
    """A product's cells are combined where its blocks meet: two exchanges of the factors, none of products, no cut of the result."""
    rng = random.Random(5)
    a = {(rng.randrange(9), rng.randrange(12)): rng.randrange(1, 9) for _ in range(300)}
    b = {(rng.randrange(3, 14), rng.randrange(10)): rng.randrange(1, 9) for _ in range(300)}
    frame = lambda m: spark.createDataFrame([(i, j, float(v)) for (i, j), v in m.items()], "i int, j int, v double")
    want: dict = {}
    for (i, k), v in a.items():
        for (k2, j), w in b.items():
            if k == k2 and i <= 7:
                want[i, j] = want.get((i, j), 0) + v * w
    monkeypatch.setattr(Program, "BLOCK", 200)
    monkeypatch.setattr(Program, "BLOCKED_FROM", 0)
    for text in ("Z[r,c] += A[r,k]*B[k,c]", "Z[c,r] += B[k,c]*A[r,k]"):
        z = program(spark, f"var Z: matrix[Double] = matrix(); for k = 0, 20 do for r = 0, 7 do for c = 0, 20 do {text};", A=frame(a), B=frame(b))["Z"]
        plan = z._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(__r") == 2 and plan.count("Exchange") == 2
        got = {(r.i, r.j): r.v for r in z.collect()}
        assert got == (want if text.startswith("Z[r") else {(j, i): v for (i, j), v in want.items()})
        more = program(spark, f"for k = 0, 20 do for r = 0, 7 do for c = 0, 20 do {text};", A=frame(a), B=frame(b), Z=frame({(0, 0): 1, (90, 90): 2}))["Z"]
        more = {(r.i, r.j): r.v for r in more.collect()}
        assert more == {k: got.get(k, 0) + {(0, 0): 1, (90, 90): 2}.get(k, 0) for k in got.keys() | {(0, 0), (90, 90)}}
