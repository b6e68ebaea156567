"""PII by bootstrapped contextual extraction, in DataFrame operations only.

Base entities (email, ip, card, phone) come from regular expressions whose
quantifiers are possessive, so they take one pass over any text.  A match's
place is the length of all parts and matches before it (``split`` and
``regexp_extract_all`` walk over the same matches).

Candidates are identifier-like values (a token with a digit, digits in groups
with signs between them, a word behind ``=``, ``:`` or ``#``) and all base entities,
each with its lexical context: a keyword with ``=``, ``:`` or ``#``, or the one or two
words before.  Patterns (a context, and a context with the shape of the value)
and values form a graph over the whole corpus.  Base entities, and values behind
a seed keyword, are seeds; in each round a pattern's confidence is its values'
mean score (with one doubt added) and a value's score the best confidence of its
patterns, until no pattern moves any more.  So the context of mail addresses or
phones finds identifiers of other shapes, and these their other contexts.  What
confident patterns or confident values hold and no base entity covers is added as
kind ``id``.

The graph is aggregated by (pattern, value) with map-side combine before any
join, so a pattern or value that fills a third of the rows is one row a task;
joins of occurrences with accepted patterns can be split by adaptive execution.

Nulls and odd rows: a null text is empty; rows with a null or repeated id each
get the spans of their own text (added spans are joined by hashes of id and text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import common as C

KINDS = ("email", "ip", "card", "phone", "id")
_SPAN = "array<struct<start:int,kind:int,end:int>>"
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9]++(?:[ -][0-9]++){0,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_PART = "(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)|0++)(?![0-9])"
# Keywords whose values seed the patterns.
SEED_WORDS = "token|tokens|secret|key|api_key|apikey|access_key|password|passwd|pwd|passwort|clave|ssn|iban|passport|license_no|account|account_no|auth|bearer|credential"
_SIGN = "A-Za-z0-9@._%+/-"
_GROUPED = r"(?<![A-Za-z0-9])[+(]?[0-9](?:[ ().-]{0,2}+[0-9]){6,}+"
_TOKEN = rf"(?<![{_SIGN}])(?=[A-Za-z@._%+/-]*+[0-9])[A-Za-z0-9][{_SIGN}]{{4,}}+"
_KEYED = rf"""(?<=[=:#]["'(]?|[=:#] ["'(]?)[A-Za-z][{_SIGN}]{{7,}}+"""
VALUE = rf"{_GROUPED}(?![{_SIGN}])|{_TOKEN}|{_KEYED}"
CONTEXT_CHARS = 80  #: where the one or two words before a value are looked for
_CONTEXT = r"""(?<![\p{L}_])(?:[\p{L}_]++ ?[=:#] ?|(?:[\p{L}_]++ ){1,2})["'(]?$"""


def _places(text: Column, pattern: str) -> Column:
    """``array<struct<m, start>>`` of all matches, leftmost and without overlap."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<m:string,start:int>>").alias("out"))
    step = lambda s, x: F.struct((s["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"), F.array_append(s["out"], F.struct(x["m"].alias("m"), (s["at"] + F.length(x["p"])).alias("start"))).alias("out"))
    zipped = F.arrays_zip(F.slice(parts, 1, F.size(found)).alias("p"), found.alias("m"))
    return F.aggregate(zipped, start, step, lambda s: s["out"])


def _spans(text: Column, kind: int, pattern: str, might: Column, good) -> Column:
    """Spans of one kind; the search runs only in texts that ``might`` have one."""
    kept = F.filter(_places(text, pattern), lambda x: good(x["m"]))
    spans = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["m"])).alias("end")))
    return F.when(might, spans).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """All base entities of a text in order: ``array<struct<start, kind, end>>``."""
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    has = lambda x: F.contains(text, F.lit(x))
    numbers = text.rlike("[0-9]")
    every = [
        _spans(text, 0, EMAIL, has("@"), lambda m: F.lit(True)),
        _spans(text, 1, IP, numbers & has("."), lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        _spans(text, 2, CARD, numbers, lambda m: F.length(digits(m)).between(12, 19) & F.call_function("luhn_check", digits(m))),
        _spans(text, 3, PHONE, has("+"), lambda m: F.length(digits(m)).between(9, 15)),
    ]
    return F.array_sort(F.concat(*every))


def _shape(value: Column) -> Column:
    return (
        F.when(value.contains("@"), "mail").when(value.rlike("^[0-9]+$"), "digits").when(value.rlike("^[0-9a-f]{16,}$"), "hex")
        .when(value.rlike("^[0-9.+/() -]+$"), "number").when(value.rlike("^[A-Za-z]+[0-9]+$"), "letters digits").when(value.rlike("^[A-Za-z]+$"), "letters").otherwise("mixed")
    )


_ROW = ("r1", "r2")  #: the name of a row: two hashes of its id and text


def candidates(docs: DataFrame) -> DataFrame:
    """``r1, r2, start, end, patterns, value, seed, covered`` of every identifier-like value and base entity (docs: r1, r2, text, base)."""
    text = F.col("text")
    near = lambda start: F.substring(text, F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_CHARS)))
    item = lambda value, start, covered: F.struct(value.alias("value"), start.alias("start"), near(start).alias("left"), F.lit(covered).alias("covered"))
    keyed = text.rlike("[=:#]") | text.rlike("[0-9]")
    some = F.when(keyed, F.transform(_places(text, VALUE), lambda x: item(F.regexp_replace(x["m"], "[._%+/-]+$", ""), x["start"], False)))
    free = F.filter(some, lambda x: (F.length(x["value"]) >= 5) & ~F.exists("base", lambda b: (b["start"] < x["start"] + F.length(x["value"])) & (b["end"] > x["start"])))
    base = F.transform("base", lambda b: item(F.substring(text, b["start"] + 1, b["end"] - b["start"]), b["start"], True))
    rows = docs.select(*_ROW, F.explode(F.concat(F.coalesce(free, F.slice(base, 1, 0)), base)).alias("x")).select(*_ROW, "x.*")
    context = F.trim(F.lower(F.regexp_replace(F.regexp_extract("left", _CONTEXT, 0), r"""[\s"'(]+""", " ")))
    rows = rows.withColumn("context", context)
    seed = F.col("covered") | F.col("context").rlike(rf"^(?:{SEED_WORDS}) ?[=:#]")
    patterns = F.when(F.col("context") != "", F.array("context", F.concat_ws("|", "context", _shape(F.col("value"))))).otherwise(F.array().cast("array<string>"))
    return rows.select(*_ROW, "start", (F.col("start") + F.length("value")).alias("end"), patterns.alias("patterns"), "value", seed.cast("double").alias("seed"), "covered")


def bootstrap(found: DataFrame, support: int = 4, confidence: float = 0.75, settled: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Confident patterns and confident values of a corpus' candidates; scores only grow, and rounds end when no confidence grows by ``settled``."""
    edges = C.checkpoint(found.select(F.explode("patterns").alias("pattern"), "value", "seed").groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    seeds = C.checkpoint(edges.groupBy("value").agg(F.max("seed").alias("seed")))
    score, before = seeds.withColumnRenamed("seed", "score"), None
    while True:
        patterns = edges.join(score, "value").groupBy("pattern").agg(F.count("*").alias("n"), F.sum("score").alias("s")).where(F.col("n") >= support)
        patterns = C.checkpoint(patterns.select("pattern", (F.col("s") / (F.col("n") + 1)).alias("conf")).where("conf >= 0.5"))
        best = edges.join(patterns, "pattern").groupBy("value").agg(F.max("conf").alias("conf"))
        last, score = score, C.checkpoint(seeds.join(best, "value", "left").select("value", F.greatest("seed", F.coalesce("conf", F.lit(0.0))).alias("score")))
        grown = patterns if before is None else patterns.join(before.withColumnRenamed("conf", "old"), "pattern", "left").where(F.col("conf") - F.coalesce("old", F.lit(0.0)) >= settled)
        done = grown.isEmpty()
        if before is not None:
            C.forget(before)
            C.forget(last)
        if done:
            return patterns.where(F.col("conf") >= confidence).select("pattern"), score.where(F.col("score") >= confidence).select("value")
        before = patterns


def _joined(spans: Column) -> Column:
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, base, spans`` (arrays of start, kind, end) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    names = {"r1": F.xxhash64("doc_id", "text"), "r2": F.xxhash64(F.lit(7), "text", "doc_id")}
    whole = whole.withColumns({"base": base_spans(F.col("text")), **names})
    found = C.checkpoint(candidates(whole))
    patterns, values = bootstrap(found, **options)
    spare = found.where(~F.col("covered")).select(*_ROW, "start", "end", "value", "patterns")
    by_pattern = spare.withColumn("pattern", F.explode("patterns")).join(patterns, "pattern", "left_semi").select(*_ROW, "start", "end")
    extra = by_pattern.union(spare.join(values, "value", "left_semi").select(*_ROW, "start", "end"))
    extra = extra.groupBy(*_ROW).agg(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end")).alias("extra"))
    spans = F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "extra")))
    return whole.select("doc_id", "base", *_ROW).join(extra, [*_ROW], "left").select("doc_id", "base", spans.alias("spans"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(C.read(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", lambda x, k=k: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


QUERIES = {"op8_pii": op8_pii}
ORACLES: dict[str, str] = {}
