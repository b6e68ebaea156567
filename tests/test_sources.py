import pytest
from pyspark.sql import functions as F

from tagloom.functions import columns as cols
from tagloom.lineage import Traced
from tagloom.loops.program import program
from tagloom.operators import arrays
from tagloom.operators.nested import nest
from tagloom.sources import generators, readers
from tagloom.streaming.incremental import merge_results, sessions, windowed


def test_readers(spark, tmp_path):
    (tmp_path / "g.txt").write_text("3,2,1\n8\n0,8,9\n")
    got = {r.node: r.neighbours for r in readers.adjacency(spark, str(tmp_path / "g.txt")).collect()}
    assert got == {3: [2, 1], 8: [], 0: [8, 9]}
    (tmp_path / "m.txt").write_text("1 2 0.5\n2 1 4\n")
    (tmp_path / "m.mtd").write_text('{"data_type": "matrix",\n "rows": 7, "cols": 3}')
    m = readers.coo_matrix(spark, str(tmp_path / "m.txt"))
    assert sorted(map(tuple, m.collect())) == [(1, 2, 0.5), (2, 1, 4.0)] and readers.matrix_rows(spark, str(tmp_path / "m.mtd")) == 7
    files = readers.whole_files(spark, str(tmp_path / "g.txt")).collect()
    assert len(files) == 1 and files[0].content.endswith("9\n") and files[0].path.endswith("g.txt")
    assert readers.text_lines(spark, str(tmp_path / "g.txt"), 2).count() == 3
    readers.write_text(m, str(tmp_path / "out"))
    readers.write_text(m, str(tmp_path / "out"))
    assert sorted(r.value for r in readers.text_lines(spark, str(tmp_path / "out")).collect()) == ["1,2,0.5", "2,1,4.0"]
    readers.write_matrix(m, str(tmp_path / "mat"))
    assert readers.coo_matrix(spark, str(tmp_path / "mat")).count() == 2
    assert readers.partition_sizes(m).agg(F.sum("count")).first()[0] == 2 and readers.estimated_bytes(m) > 0
    readers.force(m)


def test_generators_repeat(spark):
    for make in (lambda: generators.visits(spark, 3000, 8), lambda: generators.day_graph(spark, 2000, 50, 4, 1.2), lambda: generators.rmat(spark, 1000, 6), lambda: generators.points(spark, 100), lambda: generators.grid_points(spark, 100), lambda: generators.sparse_matrix(spark, 30, 30, 0.2)):
        a, b = make(), make().repartition(5)
        assert a.exceptAll(b).count() == 0 and a.count() == b.count() > 0
    assert generators.visits(spark, 25_001, 8).count() == 25_001
    assert [r[0] for r in generators.inclusive_range(spark, 5, 1, -2).collect()] == [5, 3, 1]
    skewed = {r.grp: r["count"] for r in generators.visits(spark, 5000, 8, 2.0).groupBy("grp").count().collect()}
    assert skewed[0] > 2500


def test_arrays(spark):
    v = spark.createDataFrame([(0, 1.0), (1, 2.0)], "i long, v double")
    w = spark.createDataFrame([(1, 5.0), (2, 7.0)], "i long, v double")
    as_dict = lambda df: {r.i: r.v for r in df.collect()}
    assert as_dict(arrays.update(v, w)) == {0: 1.0, 1: 5.0, 2: 7.0}
    assert as_dict(arrays.increment(v, w)) == {0: 1.0, 1: 7.0, 2: 7.0}
    twice = v.union(spark.createDataFrame([(1, 9.0)], "i long, v double"))
    assert as_dict(arrays.distinct_cells(twice, [F.col("v")])) == {0: 1.0, 1: 9.0}
    with pytest.raises(Exception, match="several values"):
        arrays.distinct_cells(twice, [F.col("v")], strict=True).collect()
    cells = [(0, j, float(j + 1)) for j in range(3)] + [(1, j, 2.0 * (j + 1)) for j in range(3)] + [(3, j, 99.0) for j in range(3)]
    cov = arrays.covariance(spark.createDataFrame(cells, "i long, j long, v double"), 3, 3)
    assert {(r.i, r.j): round(r.v, 6) for r in cov.collect()}[0, 0] == 1.0
    numbered = arrays.with_index(spark.range(1000).select((F.lit(1000) - F.col("id")).alias("x")), ["x"])
    assert numbered.where("x <> i + 1").count() == 0


def test_columns(spark):
    row = spark.range(1).select(
        cols.in_range(F.lit(7), 1, 9, 3).alias("a"), cols.in_range(F.lit(8), 1, 9, 3).alias("b"), cols.ratio(F.lit(1), F.lit(0)).alias("c"),
        cols.squared_distance(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(4.0), F.lit(6.0))).alias("d"), cols.case(F.lit(3), (lambda x: x > 5, "big"), (3, "three"), default="other").alias("e"),
        cols.links(F.lit('<a href="x"></a><a class="k" href="y">')).alias("f"), cols.cons(F.lit(1), F.array(F.lit(2))).alias("g"),
    ).first()
    assert tuple(row) == (True, False, None, 25.0, "three", ["x", "y"], [1, 2])


def test_lineage(spark):
    a = Traced.source(spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, s string"), "a", ["s"])
    b = Traced.source(spark.createDataFrame([(2, 10)], "k int, n int"), "b", ["k"])
    out = a.join(b, ["k"]).group_by("k", n=F.count(F.lit(1)))
    rows = {(r.source, r.row) for r in out.inputs().collect()}
    assert rows == {("a", '{"s":"y"}'), ("a", '{"s":"z"}'), ("b", '{"k":2}')}
    assert a.marked(F.col("k") > 1).df.count() == 3 and a.where("k > 1").distinct().df.count() == 2
    bad = a.guarded("q", F.lit(1) / (F.col("k") - 1), F.col("k") != 1, "zero").df.where("_error is not null")
    assert [r.s for r in bad.collect()] == ["x"]


def test_functions_and_externals_in_programs(spark):
    a = spark.createDataFrame([(0, 3.0), (1, 4.0)], "i long, v double")
    text = "external A: vector[Double]; def sq(x: Double): Double return x*x; var s: Double = 0.0; for v in A do s += sq(v);"
    assert program(spark, text, A=a)["s"] == 25.0
    with pytest.raises(NameError):
        program(spark, text)


def test_merged_results_equal_the_whole(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id").alias("x"))
    q = lambda d: d.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.max("x").alias("m"))
    merged = merge_results(q(df.where("x < 40")), q(df.where("x >= 40")), ["k"], {"n": "count", "s": "+", "m": "max"})
    assert merged.exceptAll(q(df)).count() == 0 and merged.count() == 7


def test_event_time_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:10", "a"), ("2024-01-01 00:00:50", "a"), ("2024-01-01 00:09:00", "a")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in windowed(df, "t", "1 minute", "1 minute", None, ["k"], n=F.count(F.lit(1))).collect()) == [1, 2]
    assert windowed(df, "t", "1 minute", "2 minutes", "1 minute", ["k"], n=F.count(F.lit(1))).count() == 4
    assert sorted(r.n for r in sessions(df, "t", "1 minute", "2 minutes", ["k"], n=F.count(F.lit(1))).collect()) == [1, 2]


def test_filters_and_columns_reach_the_scan(spark, sf):
    df = nest(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_returnflag").inner.where("l_quantity > 40").sum("l_extendedprice").df
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,40.0)" in plan and "l_orderkey" not in plan
