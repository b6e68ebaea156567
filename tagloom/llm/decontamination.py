"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, names (capitalised words inside a sentence) and units behind a number
become typed placeholders, so a question whose quantities were changed keeps
its template.  Other capitalised words (at the start of a sentence or line,
behind a quote or two spaces) can be names or not: a window with some of them has
two hashes, one of each reading, on both sides, and where the words are compared
such a word meets its equal in any case or any name.  Windows of ``width`` template words of the benchmark are hashed
and joined with those of all documents; hits of one alignment (document, item,
offset) that follow each other make a run, and a run is divided where its words
don't really equal the item's and at slots that contradict those before: a slot
value of the item meets one value in the document, and distinct names or units
meet distinct ones (numbers may coincide).  It is also divided at all slots that
changed, which leaves verbatim parts.  A part is accepted when it has
``min_words`` words (or the whole item).

The benchmark's windows are counted first: up to ``broadcast_windows`` they are
broadcast, beyond that the join shuffles.  Documents are read once for hits;
only those with hits are read again for their slots.

Nulls and odd rows: null texts have no windows; items with fewer than
``least_words`` words are too short to accuse anyone and are skipped; items
shorter than a window are matched whole; repeated rows of a document or an item
give one row, and texts that share an id are judged one by one (the longest run
of any counts); null ids take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.llm import common as C

WIDTH, MIN_WORDS, LEAST_WORDS = 8, 13, 4
BROADCAST_WINDOWS = 1_000_000
# Units that may follow a number.
UNITS = "km|m|cm|mm|mi|miles?|ft|feet|inch(?:es)?|kg|g|mg|lbs?|pounds?|tons?|l|ml|litres?|liters?|h|hours?|min|minutes?|s|seconds?|days?|weeks?|months?|years?|usd|eur|dollars?|euros?|cents?|percent|degrees?|kmh|mph|kwh|w|kw|v"
_NUMBER, _NAME, _UNIT = "\ue001", "\ue002", "\ue003"  #: private-use signs; documents' own ones are blanked


_POINT = "\ue004"  #: stands for the point or comma inside a number's value
_MAYBE = "\ue005"  #: a capitalised word that may be a name; its value stays
_SIGNS = f"{_NUMBER}{_NAME}{_UNIT}{_POINT}{_MAYBE}"
_BETWEEN = rf"[^\p{{L}}\p{{M}}\p{{N}}{_SIGNS}]+"
_NUMBERS = r"[0-9](?<![\p{L}\p{N}.,].)[0-9]*+(?:[.,][0-9]++)*+(?![\p{N}])"
_NAMES = r"\p{Lu}(?<=[\p{Ll},] \p{Lu})\p{Ll}++"
_CAPITALS = rf"\p{{Lu}}(?<![\p{{L}}\p{{M}}\p{{N}}{_SIGNS}]\p{{Lu}})\p{{Ll}}++(?![\p{{L}}\p{{M}}\p{{N}}{_SIGNS}])"


def _words(text: Column, keep: bool) -> Column:
    """Template words of a text; a slot is its kind's sign, with the value behind it if ``keep``.

    Expressions that few texts need run only where a plain search finds a reason.
    """
    value = "$0" if keep else ""
    x = F.when(text.rlike(f"[{_SIGNS}]"), F.translate(text, _SIGNS, " " * len(_SIGNS))).otherwise(text)
    x = F.regexp_replace(x, _NAMES, f" {_NAME}{value} ")
    numbers = F.regexp_replace(x, _NUMBERS, f" {_NUMBER}{value} ")
    if keep:
        numbers = F.regexp_replace(numbers, rf"(?:(?<={_NUMBER})|\G(?!\A))([0-9]++)[.,](?=[0-9])", f"$1{_POINT}")
    units = F.regexp_replace(numbers, rf"(?i)({_NUMBER}[^ ]*+ ++)({UNITS})(?![\p{{L}}\p{{N}}])", f"$1{_UNIT}{'$2' if keep else ''} ")
    x = F.when(text.rlike("[0-9]"), units).otherwise(x)
    x = F.regexp_replace(x, _CAPITALS, f"{_MAYBE}$0")
    return F.array_remove(F.split(F.lower(x), _BETWEEN), "")


def tagged(text: Column) -> Column:
    """Template words with the slots' values."""
    return _words(text, True)


def template_of(text: Column) -> Column:
    """Template words of a text, the same as ``template(tagged(text))``."""
    return _words(text, False)


def template(words: Column) -> Column:
    """The words with slots reduced to their kinds."""
    return F.transform(words, lambda w: F.when(w.rlike(f"^[{_NUMBER}{_NAME}{_UNIT}]"), F.substring(w, 1, 1)).otherwise(w))


def windows(hashes: str, width: int) -> Column:
    """A hash for each window of an array of word hashes; short texts have none."""
    at = F.sequence(F.lit(0), F.size(hashes) - width)
    return F.when(F.size(hashes) >= width, F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)])))


_DOC = ["doc_id", "dh"]  #: the name of a document: its id and its text's hash


def _all_windows(df: DataFrame, key: list[str], widths: list[int], place: str) -> DataFrame:
    """Windows of both readings; the second only where it is another."""
    plain = F.transform("t", lambda w: F.xxhash64(_plain(w)))
    names = F.transform("t", lambda w: F.xxhash64(F.when(w.startswith(_MAYBE), _NAME).otherwise(w)))
    out, df = None, df.select(*key, plain.alias("t"), names.alias("t2"))
    for w in widths:
        both = F.arrays_zip(windows("t", w).alias("a"), windows("t2", w).alias("b"))
        part = df.select(*key, F.posexplode(both).alias(place, "ab"))
        part = part.select(*key, place, F.explode(F.when(F.col("ab.a") == F.col("ab.b"), F.array("ab.a")).otherwise(F.array("ab.a", "ab.b"))).alias("h")).withColumn("w", F.lit(w))
        out = part if out is None else out.union(part)
    return out


def _plain(w: Column) -> Column:
    return F.when(w.startswith(_MAYBE), F.substring(w, 2, 1 << 30)).otherwise(w)


def _named(w: Column) -> Column:
    return w.rlike(f"^[{_NAME}{_MAYBE}]")


def _pair(i: Column, d: Column) -> Column:
    """Two words; where both may be names, equal ones keep the sign of that (no slots, but others mustn't contradict them) and different ones are names."""
    value = lambda w: F.when(_named(w), F.substring(w, 2, 1 << 30)).otherwise(w)
    literal = (i.startswith(_MAYBE) | d.startswith(_MAYBE)) & (value(i) == value(d))
    name = lambda w: F.concat(F.lit(_NAME), value(w))
    maybe = lambda w: F.concat(F.lit(_MAYBE), value(w))
    return F.when(literal & _named(i) & _named(d), F.struct(maybe(i).alias("i"), maybe(d).alias("d"))).when(literal, F.struct(value(i).alias("i"), value(d).alias("d"))).when(_named(i) & _named(d), F.struct(name(i).alias("i"), name(d).alias("d"))).otherwise(F.struct(_plain(i).alias("i"), _plain(d).alias("d")))


def _is_slot(p: Column) -> Column:
    return p["i"].rlike(f"^[{_NUMBER}{_NAME}{_UNIT}]")


def _equal(p: Column) -> Column:
    """Words of one template: equal ones, or slots of one kind."""
    return (p["i"] == p["d"]) | (_is_slot(p) & (F.substring(p["i"], 1, 1) == F.substring(p["d"], 1, 1)))


def _changes(pairs: str) -> Column:
    """Places of all words that aren't verbatim."""
    return F.filter(F.transform(pairs, lambda p, k: F.when(p["i"] != p["d"], k)), lambda k: k.isNotNull())


def _contradictions(pairs: str) -> Column:
    """Places where words differ or a slot contradicts one since the last such place."""
    places = F.filter(F.transform(pairs, lambda p, k: F.struct(k.alias("k"), *[F.translate(p[c], _MAYBE, _NAME).alias(c) for c in "id"])), lambda p: ~_equal(p) | _is_slot(p))
    fresh = F.array().cast("array<struct<i:string,d:string>>")
    start = F.struct(fresh.alias("seen"), F.array().cast("array<int>").alias("breaks"))

    def step(s: Column, p: Column) -> Column:
        clash = lambda q: ((q["i"] == p["i"]) & (q["d"] != p["d"])) | ((q["i"] != p["i"]) & (q["d"] == p["d"]) & ~p["i"].startswith(_NUMBER))
        bad = ~_equal(p) | F.exists(s["seen"], clash)
        seen = F.when(bad, fresh).otherwise(F.array_union(s["seen"], F.array(F.struct(p["i"].alias("i"), p["d"].alias("d")))))
        return F.struct(seen.alias("seen"), F.when(bad, F.array_append(s["breaks"], p["k"])).otherwise(s["breaks"]).alias("breaks"))

    return F.aggregate(places, start, step, lambda s: s["breaks"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, min_words: int = MIN_WORDS, least_words: int = LEAST_WORDS, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``doc_id, item_id, start, words, coverage, slots`` of each accepted run (the longest of a document and item)."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), tagged(F.col(item_text)).alias("tags")).where("item_id is not null").dropDuplicates(["item_id", "tags"])
    items = items.withColumns({"item": F.xxhash64("item_id", F.array_join("tags", " ")), "t": template(F.col("tags")), "size": F.size("tags")})
    items = C.checkpoint(items.where(F.col("size") >= least_words))
    # at most ``width`` numbers
    short = sorted(r[0] for r in items.where(F.col("size") < width).select("size").distinct().collect())
    long = items.where(F.col("size") >= width)
    index = _all_windows(long, ["item"], [width], "ipos")
    for w in short:
        index = index.union(_all_windows(items.where(F.col("size") == w), ["item"], [w], "ipos"))
    index = C.checkpoint(index.distinct())
    small = index.count() <= broadcast_windows
    words = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("dh", F.xxhash64("text"))
    found = _all_windows(words.select(*_DOC, template_of(F.col("text")).alias("t")), _DOC, [width, *short], "pos")
    hits = found.join(F.broadcast(index) if small else index, ["w", "h"]).select(*_DOC, "item", "pos", (F.col("pos") - F.col("ipos")).alias("shift"), "w").distinct()
    island = F.col("pos") - F.row_number().over(W.partitionBy(*_DOC, "item", "shift", "w").orderBy("pos"))
    runs = hits.withColumn("island", island).groupBy(*_DOC, "item", "shift", "w", "island").agg(F.min("pos").alias("start"), (F.count("*") + F.col("w") - 1).cast("int").alias("words"))
    runs = runs.join(items.select("item", "size"), "item").where(F.col("words") >= F.least(F.lit(min_words), "size"))
    runs = C.checkpoint(runs.select(*_DOC, "item", "shift", "start", "words"))
    # the runs' own words, from the few documents that have a run
    hit = words.join(runs.select(*_DOC).distinct(), _DOC, "left_semi").dropDuplicates(_DOC).select(*_DOC, tagged(F.col("text")).alias("d"))
    both = runs.join(hit, _DOC).join(items.select("item", "item_id", "tags", "size"), "item")
    both = both.withColumns({"d": F.slice("d", F.col("start") + 1, F.col("words")), "i": F.slice("tags", F.col("start") - F.col("shift") + 1, F.col("words"))})
    both = both.withColumn("pairs", F.zip_with("i", "d", _pair))
    both = both.select("doc_id", "item_id", "start", "size", "pairs", F.explode(F.array_distinct(F.array(_contradictions("pairs"), _changes("pairs")))).alias("breaks"))
    # parts lie between the breaks, which are places in the run
    edges = F.concat(F.array(F.lit(-1)), "breaks", F.array(F.size("pairs")))
    spans = F.transform(F.sequence(F.lit(0), F.size("breaks")), lambda k: F.struct((F.get(edges, k) + 1).alias("at"), (F.get(edges, k + 1) - F.get(edges, k) - 1).alias("words")))
    parts = both.withColumn("part", F.explode(F.filter(spans, lambda x: x["words"] >= F.least(F.lit(min_words), "size"))))
    inside = F.slice("pairs", F.col("part.at") + 1, F.col("part.words"))
    parts = parts.select("doc_id", "item_id", "size", (F.col("start") + F.col("part.at")).cast("int").alias("start"), F.col("part.words").alias("words"), F.size(F.array_distinct(F.filter(inside, _is_slot))).alias("n"))
    best = F.max_by(F.struct("start", "words", (F.col("words") / F.col("size")).alias("coverage"), F.col("n").alias("slots")), F.struct("words", -F.col("start")))
    return parts.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "start", "words", F.round("coverage", 4).alias("coverage"), "slots")


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLES: dict[str, str] = {}
