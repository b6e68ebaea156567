"""Registered queries read whole tables."""

import collections
import re

from tagloom.catalogue import ORACLES, QUERIES


def test_no_query_takes_a_part_by_id():
    assert [n for n in QUERIES if n.endswith("_whole")] == []
    part = re.compile(r"(doc_id|custkey|orderkey|event_id|suppkey|partkey) % \d+ = ")
    assert [n for n, sql in ORACLES.items() if part.search(sql) and n not in ("lang_avg_filter",)] == []


def test_words_of_all_documents_count(spark, sf):
    want = collections.Counter(w for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").collect() for w in r.text.split(" "))
    got = QUERIES["loop_word_count"](spark, sf)
    assert {r[0]: r[1] for r in got.collect()} == want


def test_all_dimensions_and_customers(spark, sf):
    dims = len(spark.read.parquet(f"{sf}/embeddings.parquet").first().embedding)
    assert QUERIES["pca_covariance"](spark, sf).count() == dims * dims
    assert QUERIES["lang_small_side_join"](spark, sf).count() == spark.read.parquet(f"{sf}/customer.parquet").count()
