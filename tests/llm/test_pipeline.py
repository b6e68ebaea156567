"""The registered corpus queries and the pipeline."""

import collections
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tagloom.llm.queries import ORACLES, QUERIES
from tests.test_catalogue import rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, duck, name):
    df, rel = QUERIES[name](spark, sf), duck.sql(ORACLES[name])
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


def test_one_query_for_each_operator():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, "12345 --"), (10**6 + 2, "")], "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.lit(0).cast("long")})
    docs, counts = docs.union(odd), [docs.count() + 3]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    assert counts[1] == counts[0] - 3 and counts[2] < counts[1] and counts[3] <= counts[2] and counts[4] < counts[3]
    used = collections.defaultdict(int)
    for r in docs.collect():
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048


def test_run_against_brute_force(spark, sf):
    """All that follows language ID, done again in plain Python: lines, near copies, benchmark passages, ids and places."""
    import re

    from tests.llm.test_operators import brute_links, check_pieces, shingles, union
    from tokenizers import Tokenizer

    source = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in corpus_pipeline.identify_language(spark, source, sf).select("doc_id", "text").collect()}
    assert {r.doc_id for r in source.collect() if not re.search(r"[^\W\d_]", r.text or "")} == {r.doc_id for r in source.collect()} - texts.keys()
    seen, cut = set(), {}
    for d in sorted(texts):
        lines, gone = texts[d].split("\n"), set()
        for a in range(len(lines)):  # runs of one text line, alone or with the empty lines before or behind it
            z = a
            while z < len(lines) and not lines[z]:
                z += 1
            runs = [(a, z + 1)] if z < len(lines) else []
            z = a + 1
            while lines[a] and z < len(lines) and not lines[z]:
                z += 1
                runs.append((a, z))
            for x, y in runs:
                if (run := tuple(lines[x:y])) in seen:
                    gone |= set(range(x, y))
                seen.add(run)
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone or kept.strip(" "):
            cut[d] = kept
    sets = {d: shingles(t) for d, t in cut.items()}
    of = union(brute_links(sets), sets)
    word, items = re.compile(r"\w+"), set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = word.findall(r.text.lower())
        items |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    clean = {d: t for d, t in cut.items() if of[d] == d and not any(tuple(w[k : k + 10]) in items for w in [word.findall(t.lower())] for k in range(len(w) - 9))}
    assert len(clean) < len(cut) < len(texts) or len(clean) < len(texts) - 10
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == clean.keys()
    tok = Tokenizer.from_file(corpus_pipeline.packing.tokenizer_path())
    check_pieces(rows, {d: [*tok.encode(t, add_special_tokens=False).ids, 0] for d, t in clean.items()})


def test_stages_on_odd_tables(spark, sf):
    """Empty tables, repeated rows and columns that bear the names of the operators' own."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    docs = docs.union(docs.limit(5)).withColumns({c: F.lit(f"own {c}") for c in ("score", "lang_pred", "_removed", "_lines", "_runs", "doc", "key", "t", "dh", "th")})
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, sf)
            assert out.columns == some.columns
            rows = out.collect()
            assert len(rows) <= 45 and all(r[c] == f"own {c}" for r in rows for c in ("score", "lang_pred", "_removed", "_lines", "_runs", "doc", "key", "t", "dh", "th")), name
        corpus_pipeline.STAGES[-1][1](spark, some, sf).collect()


def test_unlearned_languages_go(spark, sf):
    rng = random.Random(12)
    scripts = ["абвгдежзийклмнопрстуфхцчшщыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "".join(map(chr, rng.sample(range(0xAC00, 0xD7A4), 300))), "abcdefghijklmnopqrstuvwxyz"]
    texts = [(10**6 + i, " ".join("".join(rng.choice(scripts[i % 4]) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(12, 200)))) for i in range(400)]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    stay = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.union(more), sf).select("doc_id").collect()}
    assert {r.doc_id for r in docs.where(F.col("text").rlike(r"\p{L}")).collect()} <= stay
    assert [sum(i in stay for i, _ in texts[k::4]) for k in range(3)] == [0, 0, 0] and sum(i in stay for i, _ in texts[3::4]) <= 5
