"""The corpus operators against brute-force versions and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.llm import common as C
from tagloom.llm import components, decontamination, embedding_dedup, language_id, line_dedup, ngram_join, packing, pii, substring_dedup, toxicity, url_filter

LONG = "ab " * 30_000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, LONG), (7, "x" * 50_000), (8, "Ünïcödé 漢字 🙂 text\nwith lines\n\nand more"), (9, "one"), (10, "." * 20_000)]


def frame(spark, rows):
    """Documents with extra columns of names that operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"key": F.lit("k"), "score": F.lit(7), "v": F.lit(None).cast("string"), "b": F.lit(1), "len": F.lit(2)})


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, [*ODD, (None, "null id with some words in it"), (4, "one")]).cache()


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").cache()


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---------------------------------------------------------------- shared pieces


def test_packed_arrays_come_back():
    for arrays in ([np.arange(1000, dtype=np.uint64), np.zeros(0, np.int64), np.array([1.5, -2.0])], [np.zeros(0, np.uint8)]):
        for a, b in zip(arrays, C.unpack(C.pack(*arrays)), strict=True):
            assert a.dtype == b.dtype and (a == b).all()


def test_words_are_those_of_the_contract():
    import pyarrow as pa

    rng = random.Random(1)
    some = ["".join(rng.choice("aé \n\t\x0b\x0c\r\x1c\xa0b") for _ in range(rng.randint(0, 30))) for _ in range(500)] + [None, ""]
    data, offsets = C.string_buffers(pa.array(some))
    hashes, first = C.word_hashes(data, offsets)
    names = {}
    for i, t in enumerate(some):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert first[i + 1] - first[i] == len(words)
        for w, h in zip(words, hashes[first[i] : first[i + 1]].tolist(), strict=True):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5001 + i) for i in range(100)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = union(pairs, {x for p in pairs for x in p})
    assert got == {n: c for n, c in want.items() if any(n in p and p[0] != p[1] for p in pairs)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_alone_and_by_rounds(spark):
    """Few edges are solved without a shuffle; more, by rounds, with the same result."""
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges = spark.createDataFrame(pairs, "u long, v long").repartition(16)
    sc = spark.sparkContext._jsc.sc()
    before = sc.newShuffleId()
    found = components.components(edges)
    assert sc.newShuffleId() - before <= 3
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in components.components(edges, alone=0).collect()}


def test_ngram_routing_without_bitmaps(spark):
    """What a task sends to buckets holds no bitmaps, so it grows little with the number of buckets."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(1500)) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    size = {n: sum(len(x) for b in ngram_join._prefixes(5, 80, n, np.zeros(0, np.uint64))([batch]) for x in b.column(1).to_pylist()) for n in (8, 64)}
    tokens = 40 * 300
    assert size[8] < 8 * tokens and size[64] < 16 * tokens


# ---------------------------------------------------------------- 1 toxicity


def tokens(g, text):
    return [g.classify(w) for w in text.split()]


def test_transducers_mark_clauses():
    g = toxicity.Grammar({"idiot$": 5.0, "vequ": 4.0})
    assert g.classify("vequxyz")[:2] == ("insult", 4.0) and g.classify("idiots")[0] == "other"
    of = lambda text: {k: v for k, v in g.clause(tokens(g, text)).items() if v}
    assert of("they are an idiot") == {"insult": 5.0, "aimed": 5.0} and of("idiot") == {"insult": 5.0}
    assert of("such idiot") == {"insult": 7.5} and of("idiot idiot") == {"insult": 11.25}
    assert of("not an idiot") == {"negated": 5.0} and of("never ever would one be idiot") == {"insult": 5.0}
    assert of("someone said idiot") == {"reported": 5.0} and of('" idiot " idiot') == {"reported": 5.0, "insult": 5.0}
    assert of("i will kill you") == {"threat": 2.0} and of("kill time") == {} and of("i will not kill you") == {"negated": 2.0}
    assert of("kill a b you") == {"threat": 1.0} and of("kill a b c you") == {}
    assert of("go go to hell") == {"insult": 3.0} and of("go to go to shut up") == {"insult": 2.0} and of("i know where you live") == {"threat": 4.0}


def test_composed_machine_equals_its_parts():
    """Against a brute-force reading: each transducer by itself, the clause's amounts added up by hand."""
    g, rng = toxicity.Grammar({"idiot$": 5.0, "vequ": 4.0}), random.Random(14)
    vocabulary = ["idiot", "vequa", "not", "said", '"', "you", "kill", "will", "such", "shut", "up", "go", "to", "hell", "drop", "dead", "house", "tree"]
    for _ in range(500):
        words, runs = [rng.choice(vocabulary) for _ in range(rng.randint(0, 14))], []
        for p in toxicity.parts():
            state, marks = p.start, []
            for w in words:
                state, mark, weight = p.read(state, g.classify(w)[0], w)
                marks.append((mark, weight))
            runs.append(marks)
        want, place = collections.Counter(), ""
        for k, w in enumerate(words):
            kind, weight, _ = g.classify(w)
            of = {m: x for m, x in (r[k] for r in runs) if m}
            if kind in ("insult", "threat"):
                place = next((p for p in ("negated", "reported") if p in of), "")
            bad = weight * of.get("insult", 0) + of.get("insult phrase", 0)
            want[place or "insult"] += bad
            want[place or "threat"] += of.get("threat", 0) + of.get("threat phrase", 0)
            want["aimed"] += (bad or (weight if kind == "insult" else 1)) if "aimed" in of else 0
        assert {k: v for k, v in g.clause(tokens(g, " ".join(words))).items() if v} == {k: v for k, v in want.items() if v}


def test_toxicity_query(spark, sf, tmp_path):
    """Held-out labels change nothing, the others do; the sign follows the score."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    got = []
    for name, table in (("a", labels), ("b", flipped), ("c", labels.limit(0))):
        (tmp_path / name).mkdir()
        docs.withColumns({"lang": F.lit("x"), "source": F.lit(name)}).write.parquet(str(tmp_path / name / "documents.parquet"))
        table.union(table).write.parquet(str(tmp_path / name / "labels.parquet"))
        got.append({r.doc_id: r for r in toxicity.op1_toxicity(spark, str(tmp_path / name)).collect()})
    assert got[0] == got[1] and len(got[0]) == docs.count()
    for i, r in got[0].items():
        assert (r.held_out, r.predicted) == (zlib.crc32(str(i).encode()) % 5 == 0, int(r.score >= 0.5)) and 0 <= r.score <= 1
    marks = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    assert len({r.score for r in got[2].values()}) == 1
    right = [(got[0][i].predicted == y) for i, y in marks.items() if got[0][i].held_out]
    assert sum(right) >= 0.9 * len(right)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_toxicity_finds_planted_words(spark, odd):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    rows, marks = [], []
    for i in range(400):
        t = [word() for _ in range(60)]
        if i % 8 == 0:
            t[rng.randrange(60)] = rng.choice(["zumpel", "kroxan", "kroxuri", "kroxete"])
        rows.append((i, " ".join(t)))
        marks.append((i, int(i % 8 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, y in marks)
    assert toxicity.score(odd, model).count() == len(ODD) + 2
    empty = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(odd, empty).where("score is null or score not between 0 and 1").count() == 0


# ---------------------------------------------------------------- 2 decontamination


def test_reparameterised_question_is_caught(spark):
    items = spark.createDataFrame([(1, "A train leaves Paris with Anna at 12.5 km per hour and Anna returns after 3 hours, how far did the train travel in total?"), (2, "Short one here now ok"), (3, "no"), (4, None), (None, "Short one here now ok")], "item_id long, text string")
    docs = frame(spark, [
        (1, "xx yy. A train leaves Rome with Berta at 99 km per hour and Berta returns after 7 hours, how far did the train travel in total? zz"),
        (2, "A train leaves Rome with Berta at 99 km per hour and Clara returns after 7 hours, how far did the train travel in total?"),
        (3, None), (4, ""), (5, "he said short one here now ok"), (None, "Short one here now ok"), (6, LONG), (6, LONG), (7, "." * 50_000), (8, "A train leaves Paris"),
    ])
    got = {(r.doc_id, r.item_id): r.slots for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(1, 1): 6, (5, 2): 0}
    # the shuffled join gives the same
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items, broadcast_windows=0).collect()} == set(got)
    assert decontamination.contaminated(docs.limit(0), items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0


def test_consistent_parts_are_caught(spark):
    text = "A shop has {} apples and then some other things happen in the long story until {} of them are gone, so how many apples does the shop have left in the end?"
    items = spark.createDataFrame([(1, text.format(5, 5)), (2, "the boy has 5 red balls and 3 green cubes")], "item_id long, text string")
    docs = frame(spark, [(1, text.format(5, 6)), (2, text.format(6, 5)), (3, "so the boy has 4 red balls and 4 green cubes"), (4, "the boy has 5 red balls or 3 green cubes"), (5, text.format(7, 7))])
    got = {(r.doc_id, r.item_id): (r.start, r.words, r.slots) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(1, 1): (0, 16, 1), (2, 1): (4, 29, 1), (3, 2): (1, 10, 2), (5, 1): (0, 33, 1)}


def test_clashing_ids_are_judged_one_by_one(spark):
    long = "A train leaves the town at noon and returns after three hours, how far did the old train travel in total that day?"
    items = spark.createDataFrame([(1, "Short one here now ok"), (1, long), (2, "the sum of 1,2,3,4,5,6,7,8,9,10,11.5 and nothing else")], "item_id long, text string")
    docs = frame(spark, [(1, "so short one here now ok"), (1, "nothing of that"), (2, long), (2, "x " + long), (3, "the sum of 9,8,7,6,5,4,3,2,1,0,1.5 and nothing else"), (3, None)])
    got = {(r.doc_id, r.item_id): (r.start, r.words) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(1, 1): (1, 5), (2, 1): (0, 23), (3, 2): (0, 7)}


def test_names_at_any_place_are_caught(spark):
    text = "Tom has 5 marbles. Tom gives 3 of them to a friend.{}Tom buys 4 more marbles, so how many are left? "
    items = spark.createDataFrame([(1, text.format(" ")), (2, "Short one here with a few words now ok")], "item_id long, text string")
    docs = frame(spark, [
        (1, text.format("\n").replace("Tom", "Ben").replace("5", "7")), (2, text.format("  ").replace("Tom", "Ben")), (3, text.format(' "').replace("Tom", "Ben")),
        (4, "he said Short one here with a few words now ok"), (5, "he said short one here with a few words now ok"), (6, text.format(" ").replace("Tom has", "Ben has").replace("Tom buys", "Max buys").replace("marbles.", "books.")),
    ])
    got = {(r.doc_id, r.item_id): r.slots for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(1, 1): 4, (2, 1): 4, (3, 1): 4, (4, 2): 0, (5, 2): 0}


def test_template_and_tagged_words_agree(spark):
    rng = random.Random(4)
    bits = ["Anna", " ", "km", "12.5", "3,4,5", "a", "B", "é", ".", ",", "\n", "-", "7", " Bob", "x1.5", "5kg", "in", "1.2.3.", "É", "A1"]
    df = spark.createDataFrame([(i, "".join(rng.choice(bits) for _ in range(40))) for i in range(1000)], "i long, t string")
    assert df.where(decontamination.template_of(F.col("t")) != decontamination.template(decontamination.tagged(F.col("t")))).count() == 0


def test_leaks_of_the_table(spark, sf, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    word = re.compile(r"\w+")
    index = collections.defaultdict(set)
    for i, t in items.items():
        w = word.findall(t.lower())
        for k in range(len(w) - 9):
            index[tuple(w[k : k + 10])].add(i)
    want = {(d, i) for d, t in texts.items() for w in [word.findall(t.lower())] for k in range(len(w) - 9) for i in index.get(tuple(w[k : k + 10]), ())}
    assert {(r.doc_id, r.item_id) for r in decontamination.op2_decontamination(spark, sf).collect()} == want


# ---------------------------------------------------------------- 3 packing


def check_pieces(rows, ids_of, length=2048):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for d, ids in ids_of.items():
        ids = np.array(ids, "<u4")
        want = [(k, k * length, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(ids[i : i + length] for i in range(0, len(ids), length))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[d]) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= length
    return bins


def test_packing_round_trip(spark, sf, documents, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    docs = documents.repartition(20)
    rows = packing.pack_documents(docs, packing.tokenizer_path()).collect()
    bins = check_pieces(rows, {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts.items()})
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // 2048) * 1.06 + 1  # partitions of ten documents leave little choice


def test_packing_fills_sequences(spark):
    """About as few sequences as packing all pieces in one place, whatever the tree's nodes may hold."""
    rng = np.random.default_rng(15)
    docs = spark.createDataFrame([(i, "the " * int(n)) for i, n in enumerate(rng.integers(100, 2600, 1500))], "doc_id long, text string").repartition(40)
    for node_bins in (200_000, 60):
        rows = packing.pack_documents(docs, packing.tokenizer_path(), node_bins=node_bins).collect()
        bins = check_pieces(rows, {})
        whole = packing.best_fit(np.array([r.length for r in rows]), 2048)[2]
        assert len(bins) <= len(whole) * (1.04 if node_bins > 60 else 1.06)


def test_packing_odd_rows(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack_documents(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), packing.tokenizer_path()).collect()
    check_pieces(rows, {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t in ODD})
    assert packing.pack_documents(odd.limit(0), packing.tokenizer_path()).count() == 0
    assert packing.pack_documents(odd, packing.tokenizer_path()).where("doc_id is null").count() == 1


def test_words_encode_like_texts():
    import pyarrow as pa

    words, rng = packing.Words(packing.tokenizer_path()), random.Random(5)
    some = ["".join(rng.choice("ab'sdtlREVeé ñ\t\n\x0b\x0c\r\x1c  ́Σς12<|endoftext|>!?.,漢🙂ﬁ") for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["x <|endoftext|> y", "A, b. <|ENDOFTEXT|>"]
    for part in (some, some[:-2]):
        ids, b = packing.encode_texts(words, pa.array(part))
        for i, t in enumerate(part):
            assert ids[b[i] : b[i + 1]].tolist() == [*words.tokenizer.encode(t, add_special_tokens=False).ids, 0]


# ---------------------------------------------------------------- 4 language


def test_language(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = language_id.identify(docs).where(language_id.held_out())
    right, n = out.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert right >= 0.95 * n
    prototypes = language_id.train(docs)
    got = {(r.doc_id, r.text): r for r in language_id.predict(odd, prototypes).collect()}
    for i in (1, 2, 3, 10):
        r = got[i, dict(ODD)[i]]
        assert (r.lang_pred, r.score) == ("und", 0.0)
    assert set(language_id.predict(odd, {}).select("lang_pred").toPandas().lang_pred) == {"und"}
    assert language_id.predict(odd.limit(0), prototypes).count() == 0
    assert language_id.train(docs.limit(0)) == {}


# ---------------------------------------------------------------- 5 urls


def test_urls(spark, sf, duck):
    rows = [(1, None), (2, "nothing"), (3, "http://A.NET/x?y#z"), (4, "http://a.net"), (5, "x://www.example.net/en/a"), (6, "x://example.com/de/"), (7, "x://b.org/fr/?q"), (8, "x://spam-farm.example.com/"), (9, "x://free-bets.example.com"), (10, "x://freebets.com/betsfree"), (11, "a://b://c.net/d"), (12, ""), (12, ""), (13, "x://knet/"), (14, "x://a.org/?free=1&free=2")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(0))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    assert got[1] == got[2] == got[12] == ("", "", None, "allow")
    assert got[3] == ("a.net", "/x", "net/", "block") and got[4] == ("a.net", "", None, "allow")
    assert got[5][2:] == ("example.net/en/", "allow") and got[6][2:] == ("example.com/de/", "block") and got[7][2:] == ("org/fr/", "allow")
    assert [got[i][3] for i in (8, 9, 10, 13, 14)] == ["block", "block", "allow", "allow", "allow"]
    assert got[11][:2] == ("b:", "//c.net/d")
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- 6 n-gram join


def shingles(t):
    w = (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_links(sets):
    ids = sorted(sets)
    return [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]


def check_join(rows, texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    want = union(brute_links(sets), sets)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])


def near_copies(n, seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base, passage, out = [word() for _ in range(120)], [word() for _ in range(60)], {}
    for i in range(n):
        t = list(base) if i % 3 == 0 else [word() for _ in range(60)] + passage if i % 3 == 1 else [word() for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 5)):
            if t:
                t[rng.randrange(len(t))] = word()
        out[i] = " ".join(t)
    return out


@pytest.mark.parametrize("block", [1000, 20])
def test_ngram_join(spark, block):
    docs = near_copies(300)
    df = frame(spark, list(docs.items())).repartition(7)
    check_join(ngram_join.link_documents(df, block=block).collect(), docs)


def test_ngram_join_odd_rows(spark, odd):
    rows = ngram_join.link_documents(odd).collect()
    assert len(rows) == len(ODD) + 2
    check_join(rows, dict(ODD))
    assert ngram_join.link_documents(odd.limit(0)).count() == 0


def test_signature_bounds_are_safe():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 500, rng.integers(1, 2000), dtype=np.uint64)) for _ in range(60)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * 0.95)], rng.integers(1000, 2000, 3, dtype=np.uint64)])) for s in sets]
    sig = ngram_join.Signatures.of(sets)
    i, j = np.triu_indices(len(sets), 1)
    may = sig.may_link(i, j, 80)
    for a, b, m in zip(i.tolist(), j.tolist(), may.tolist(), strict=True):
        both = len(np.intersect1d(sets[a], sets[b]))
        assert m or 100 * both < 80 * (len(sets[a]) + len(sets[b]) - both)
    forest = ngram_join.Forest(len(sets))
    tree = ngram_join.Node(np.array(sorted(range(len(sets)), key=lambda k: len(sets[k]))), sig)
    exact = lambda a, b: ngram_join.enough(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), 80)
    ngram_join.dual(tree, tree, sig, forest, 80, exact)
    want = union([(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if exact(a, b)], range(len(sets)))
    assert {k: forest.find(k) for k in want} == want


# ---------------------------------------------------------------- 7 embeddings


def test_embeddings(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] * rng.uniform(0.5, 3) + rng.normal(size=16) * rng.choice([0, 0.05, 0.2, 0.32])).tolist()) for i in range(300)]
    rows += [(310, [1e200] * 16), (311, [1e200] * 15 + [1.1e200]), (312, [1e-200] * 16), (313, [1.0, 2.0]), (314, [2.0, 4.0]), (315, [5.0])]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, [0.0] * 16), (304, [float("nan")] * 16), (305, [None] + [1.0] * 15), (306, [float("inf")] * 16), (307, []), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rep": F.lit(1), "n": F.lit("x")})
    good = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, v in good.items()}
    pairs = [(a, b) for a in good for b in good if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    want, n = union(pairs, [r[0] for r in rows if r[0] is not None]), collections.Counter(x for p in pairs for x in p)
    assert len(pairs) > 200
    for block in (4096, 32):
        got = embedding_dedup.link_embeddings(df, block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.vec_id is None:
                assert (r.n_links, r.component_id, r.kept) == (0, None, False)
            else:
                assert (r.n_links, r.component_id, r.kept) == (n[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id)
    assert embedding_dedup.link_embeddings(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 8 PII

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def entities(t):
    out = []
    for k, (n, r) in enumerate(BASE):
        for m in re.finditer(r, t):
            g, d = m[0], re.sub("[^0-9]", "", m[0])
            if n == "ip" and any(int(p.lstrip("0")[:4] or 0) > 255 for p in g.split(".")) or n == "card" and not (12 <= len(d) <= 19 and luhn(d)) or n == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_entities(spark):
    rng = random.Random(9)
    some = ["".join(rng.choice("a.b@c-_%+ ()0123456789 -.@🙂é\n") for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    some += ["4111 1111 1111 1111 and 4111-1111-1111-1111", "x@y.com_foo@bar.com", "1.2.3.4.5.6.7.8.9", "+1 (702) 555-0742", "a" * 100_000, "1 " * 50_000, "a@" + "b." * 30_000 + "c", "." * 50_000, "0001.002.3.255 1.2.3.256", "", "10.0.0.1 and 192.168.0.7, 8.8.8.8 0.0.0.0 01.002.3.4 256.0.0.1 1.2.3.0000", "0" * 50_000 + ".0.0." + "0" * 50_000]
    some += [" ".join(".".join(rng.choice(["0", "00", "7", "10", "099", "255", "256", "1000", str(rng.randrange(300))]) for _ in range(rng.choice([3, 4, 4, 4, 5]))) for _ in range(6)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(some)), "i long, text string")
    got = {r.i: [tuple(x) for x in r.base] for r in df.select("i", pii.base_spans(F.col("text")).alias("base")).collect()}
    assert got == {i: entities(t) for i, t in enumerate(some)}


def test_context_finds_unseen_identifiers(spark, odd):
    rows = [(i, f"some words here token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" and user id: abc{i:05d}x") for i in range(8)]
    rows += [(100 + i, f"please mail contact person{i}@mail.example.com now") for i in range(9)] + [(200, "please mail contact person-99-unreachable now"), (201, "nothing 12 here")]
    out = {r.doc_id: [tuple(x) for x in r.spans] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows[:8]:
        at = t.index('"') + 1
        assert (at, 4, at + 40) in out[i]
    assert out[100] == entities(rows[8][1]) and out[201] == []
    assert pii.find_pii(odd).count() == len(ODD) + 2
    assert pii.find_pii(odd.limit(0)).count() == 0


def test_contexts_of_base_entities_find_others(spark):
    """No seed word: contexts of mail addresses and phones hold identifiers that no expression knows, and those lead on."""
    rows = [(i, f"for questions write to person{i}@mail.example.com today") for i in range(12)] + [(20 + i, f"my number is +49 170 55501{i:02d} ok") for i in range(9)]
    rows += [(40, "for questions write to staff_member_77 today"), (41, "my number is (0170) 555 0199 ok"), (42, "we met on day12345 there"), (43, "see staff_member_77"), (44, None), (None, "my number is (0170) 555 0188 ok"), (40, "my number is 0170 555 0177 ok"), (40, "hi")]
    out = collections.defaultdict(list)
    for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        out[r.doc_id].append([tuple(x) for x in r.spans])
    at = lambda t, v: (t.index(v), 4, t.index(v) + len(v))
    assert sorted(out[40]) == sorted([[], [at(rows[21][1], "staff_member_77")], [at("my number is 0170 555 0177 ok", "0170 555 0177")]])
    assert out[41] == [[at(rows[22][1], "(0170) 555 0199")]] and out[None] == [[at(rows[26][1], "(0170) 555 0188")]]
    assert out[42] == [[]] and out[43] == [[at("see staff_member_77", "staff_member_77")]] and out[44] == [[]]
    for i, t in rows[:21]:
        assert out[i] == [entities(t)]


def test_long_values_are_covered_whole(spark):
    values = [hashlib.sha1(str(i).encode()).hexdigest() * 15 for i in range(6)] + ["abcdefgh" * 8 + str(i) for i in range(6)]
    rows = [(i, f"some words here token = {v} and more") for i, v in enumerate(values)]
    out = {r.doc_id: [tuple(x) for x in r.spans] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        at = t.index("= ") + 2
        assert (at, 4, at + len(values[i])) in out[i]


# ---------------------------------------------------------------- 9 lines


def brute_lines(docs, need):
    lines = {d: t.split("\n") if t is not None else [] for d, t in docs.items()}
    first, gone = {}, collections.defaultdict(set)
    for d in sorted(lines):
        for a in range(len(lines[d])):
            for b in range(a, len(lines[d])):
                run = tuple(lines[d][a : b + 1])
                if sum(map(len, run)) >= need and first.setdefault(run, (d, a)) != (d, a):
                    gone[d] |= set(range(a, b + 1))
    return lines, gone


def test_lines(spark):
    rng = random.Random(10)
    docs = {}
    for i in range(60):
        docs[i] = "\n".join(rng.choice(["", "a", "bb", "ccc ccc", "é" * 12, "long line of some twenty", f"unique {i} {rng.random()}"]) for _ in range(rng.randint(0, 14)))
        if i > 30 and i % 4 == 0:
            docs[i] = docs[i - 20] + "\n" + docs[i]
    docs[60] = None
    lines, gone = brute_lines(docs, 20)
    df = frame(spark, [*docs.items(), (None, "long line of some twenty")])
    out = line_dedup.remove_repeated_lines(df, min_chars=20).collect()
    assert len(out) == len(docs) + 1 and sum(map(len, gone.values())) > 50
    for r in out:
        if r.doc_id is None:
            assert r._removed == 0
            continue
        cut = gone.get(r.doc_id, set())
        assert (r._lines, r._removed) == (len(lines[r.doc_id]), len(cut))
        assert r.text == (None if docs[r.doc_id] is None else "\n".join(x for k, x in enumerate(lines[r.doc_id]) if k not in cut))
        assert {k for a, b in r._runs or [] for k in range(a, b)} == cut


def test_lines_odd_rows(spark, odd):
    assert line_dedup.remove_repeated_lines(odd).count() == len(ODD) + 2
    assert line_dedup.remove_repeated_lines(odd.limit(0)).count() == 0
    out = collections.defaultdict(list)
    for r in line_dedup.remove_repeated_lines(odd).collect():
        out[r.doc_id].append(r._removed)
    assert (out[5], out[6], out[4], out[9]) == ([0], [1], [0, 0], [1])


# ---------------------------------------------------------------- 10 substrings


def test_substrings(spark, documents, texts):
    first, words = {}, {d: (t or "").encode().split() for d, t in texts.items()}
    for d in sorted(words):
        for k in range(len(words[d]) - 12):
            first.setdefault(tuple(words[d][k : k + 13]), d)
    for r in substring_dedup.remove_repeated_windows(documents).collect():
        w = words[r.doc_id]
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < r.doc_id:
                gone |= set(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256, r.kept.encode()) == (len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept)
        assert {k for a, b in r.intervals for k in range(a, b)} == gone


def test_substrings_odd_rows(spark, odd):
    rows = substring_dedup.remove_repeated_windows(odd).collect()
    assert len(rows) == len(ODD) + 2
    got = {r.doc_id: (r.n_words, r.n_removed) for r in rows}
    assert got[5] == (30_000, 0) and got[6] == (30_000, 30_000) and got[1] == got[2] == got[3] == (0, 0)
    assert substring_dedup.remove_repeated_windows(odd.limit(0)).count() == 0


def test_lines_of_repeated_ids(spark):
    """Texts of one id are documents of their own in the order of their hashes; equal rows are one document."""
    rng = random.Random(13)
    line = lambda: rng.choice(["", "a", "bb bb", f"own {rng.random()}", "shared line", "another"])
    rows = [(i // 4, "\n".join(line() for _ in range(rng.randint(1, 10)))) for i in range(60)]
    rows += [rows[3], rows[3], (7, "x\ny\nz\n" + "\n".join(f"line {k % 3000}" for k in range(6000)))]
    df = frame(spark, rows).withColumns({c: F.lit(1) for c in ("doc", "_doc", "th", "runs", "_gone", "_removed", "_lines", "_runs")})
    order = {(r.doc_id, r.text): (r.doc_id, r.h) for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    names = sorted(order.values())
    lines, gone = {}, {}
    texts = {names.index(v): k[1] for k, v in order.items()}
    first = {}
    for d in sorted(texts):
        lines[d], gone[d] = texts[d].split("\n"), set()
        for a in range(len(lines[d])):
            for b in range(a, min(a + 12, len(lines[d]))):  # runs of empty lines are shorter than that
                run = tuple(lines[d][a : b + 1])
                if any(run) and first.setdefault(run, (d, a)) != (d, a):
                    gone[d] |= set(range(a, b + 1))
    got = line_dedup.remove_repeated_lines(df).withColumn("kept", F.col("text"))
    want = collections.Counter((names[d][0], "\n".join(x for k, x in enumerate(lines[d]) if k not in gone[d])) for d in texts)
    want[rows[3][0], next("\n".join(x for k, x in enumerate(lines[d]) if k not in gone[d]) for d, t in texts.items() if t == rows[3][1] and names[d][0] == rows[3][0])] += 2
    assert collections.Counter((r.doc_id, r.kept) for r in got.collect()) == want
    assert sorted(got.columns) == sorted({*df.columns, "kept"})


def test_short_shared_lines_go(spark):
    """With the operator's own least length: any line of a character that was seen goes, empty lines alone stay."""
    docs = {i: f"unique {i}\n\nAll rights reserved.\nunique too {i}\n}}\n{i} end" for i in range(6)} | {6: "\n\n", 7: "\n\n", 8: "}"}
    lines, gone = brute_lines(docs, 1)
    for r in line_dedup.remove_repeated_lines(frame(spark, list(docs.items()))).collect():
        assert {k for a, b in r._runs or [] for k in range(a, b)} == gone.get(r.doc_id, set())
        assert ("All rights reserved." in r.text) == (r.doc_id == 0) and (r.doc_id < 6 or (r.text == "") == (r.doc_id == 8))
