"""Language ID by hyperdimensional profiles.

Every letter has a random +-1 vector.  A letter trigram is the product (the
binding) of its letters' vectors, each permuted by its place; a text is the sum
(the bundle) of its trigrams, and a language is the bundle of all its training
texts.  A text belongs to the language whose prototype has the largest cosine.

Training needs no shuffle of texts: a partition adds up one bundle a language,
and those are summed by (language, dimension) with map-side combine.  What
reaches the driver is one vector a language, whatever the size of the corpus.

Nulls and odd rows: a text that is null or has no letter is ``und`` with score
0; rows without a language, or without an id, are never learned from; without
any training row every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm import common as C

DIMENSIONS = 1024
CHUNK = 400_000  #: characters that are profiled at a time (bounds memory; no text is cut)
MAX_LANGUAGES = 10_000  #: more distinct labels than this are an error: they aren't languages
_SEED = 4242
_STATE: dict = {}


def _tables() -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """For each code point its lower-case letter, or 0; and the letters' vectors so far."""
    if not _STATE:
        low = np.fromiter((ord(c.lower()[0]) if c.isalpha() else 0 for c in map(chr, range(0x110000))), np.int32, 0x110000)
        _STATE.update(low=low, vectors={})
    return _STATE["low"], _STATE["vectors"]


def _letters(points: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """One row a letter; the word edge (0) has a vector, too."""
    known = _tables()[1]
    for p in points.tolist():
        if (p, dims, seed) not in known:
            known[p, dims, seed] = np.where(np.random.default_rng([seed, p]).integers(0, 2, dims), 1, -1).astype(np.int8)
    return np.stack([known[p, dims, seed] for p in points.tolist()])


def profile(texts: list[str], dims: int = DIMENSIONS, seed: int = _SEED, owner: np.ndarray | None = None, owners: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The bundle of each text (or of each owner of texts) and whether a text has a letter."""
    owner = np.arange(len(texts)) if owner is None else owner
    owners = owners or len(texts)
    low = _tables()[0]
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    letters = np.concatenate([[0], low[codes], [0]])
    keep = letters != 0
    edge = ~keep
    keep[1:] |= edge[1:] & (letters[:-1] != 0)
    keep[0] = True
    at = np.flatnonzero(keep)
    seq = letters[at]
    place = np.searchsorted(ends, np.maximum(at - 1, 0), "right")
    has = np.zeros(len(texts), bool)
    has[place[seq != 0]] = True
    middle = np.flatnonzero(seq[1:-1] != 0) + 1  # a trigram's middle is a letter, so no trigram spans two words
    if not len(middle):
        return np.zeros((owners, dims), np.float32), has
    used = np.unique(seq)
    short = np.zeros(int(used[-1]) + 1, np.int64)
    short[used] = np.arange(len(used))
    seq, who, n = short[seq], owner[place[middle]], len(used)
    if n <= 400:
        key = (seq[middle - 1] * n + seq[middle]) * n + seq[middle + 1]
        grams = np.flatnonzero(np.bincount(key, minlength=0))
        index = np.zeros(int(grams[-1]) + 1, np.int64)
        index[grams] = np.arange(len(grams))
        index = index[key]
    else:
        grams, index = np.unique((seq[middle - 1] * n + seq[middle]) * n + seq[middle + 1], return_inverse=True)
    vectors = _letters(used, dims, seed)
    first, second = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
    out = np.zeros((owners, dims), np.float32)
    step = max(256, 4_000_000 // max(dims, owners))
    order = np.argsort(index, kind="stable") if len(grams) > step else None
    for lo in range(0, len(grams), step):  # so many distinct trigrams at a time
        g = grams[lo : lo + step]
        if order is None:
            cell = who * len(g) + index
        else:
            part = order[np.searchsorted(index, lo, sorter=order) : np.searchsorted(index, lo + step, sorter=order)]
            cell = who[part] * len(g) + index[part] - lo
        counts = np.bincount(cell, minlength=owners * len(g)).reshape(owners, len(g)).astype(np.float32)
        bound = first[g // (n * n)] * second[g // n % n] * vectors[g % n]
        out += counts @ bound.astype(np.float32)
    return out, has


def _chunks(texts: list[str]) -> Iterator[slice]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and (size + len(t) > CHUNK or i - lo >= 512):
            yield slice(lo, i)
            lo, size = i, 0
        size += len(t)
    if texts:
        yield slice(lo, len(texts))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """A prototype for each language of ``labelled``."""
    C.importable(labelled)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for part in _chunks(texts):
                names, owner = np.unique(np.array(langs[part], object).astype(str), return_inverse=True)
                for name, v in zip(names.tolist(), profile(texts[part], dims, owner=owner, owners=len(names))[0], strict=True):
                    total[name] = total.get(name, 0) + v.astype(np.float64)
        for name, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dims), pa.array(range(dims), pa.int32()), pa.array(v)], ["lang", "k", "v"])

    rows = (
        labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
        .mapInArrow(lambda b: C.released(bundle(b)), "lang string, k int, v double")
        .groupBy("lang", "k").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "v")))["v"].alias("v"))
        .limit(MAX_LANGUAGES + 1).collect()
    )
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = {r.lang: np.array(r.v, np.float64) for r in rows}
    return {k: (v / np.linalg.norm(v)).astype(np.float32) for k, v in sorted(found.items()) if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", dims: int = DIMENSIONS, keep: list[str] | None = None, names_out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` (the cosine, not below 0), or other ``names_out``; they replace columns of their names."""
    C.importable(docs)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names_out]
    inside = text_col in kept  # then the text travels once
    text_name = text_col if inside else C.fresh(docs, "text")
    source = docs.select(*kept) if inside else docs.select(*kept, F.col(text_col).alias(text_name))
    text_at = source.columns.index(text_name)
    names, matrix = list(prototypes), np.stack([*prototypes.values()]) if prototypes else np.zeros((0, dims), np.float32)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs, scores = [t or "" for t in b.column(text_at).to_pylist()], [], []
            for part in _chunks(texts):
                bundles, has = profile(texts[part], dims)
                if not names:
                    langs += ["und"] * len(has)
                    scores += [0.0] * len(has)
                    continue
                cosine = bundles @ matrix.T / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-9)
                best = cosine.argmax(axis=1)
                langs += [names[k] if h else "und" for k, h in zip(best.tolist(), has.tolist(), strict=True)]
                scores += np.where(has, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0).astype(float).tolist()
            columns, fields = b.columns[: len(kept)], list(b.schema)[: len(kept)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=pa.schema([*fields, pa.field(names_out[0], pa.string()), pa.field(names_out[1], pa.float64())]))

    schema = T.StructType([*source.schema.fields[: len(kept)], T.StructField(names_out[0], T.StringType()), T.StructField(names_out[1], T.DoubleType())])
    return source.mapInArrow(lambda b: C.released(label(b)), schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(C.text_crc(id_col), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dims: int = DIMENSIONS, keep: list[str] | None = None, names_out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Learns from three quarters of the labelled documents and labels all of them."""
    learn = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col))
    return predict(docs, train(learn, text_col, lang_col, dims), text_col, dims, keep, names_out)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify(C.read(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
ORACLES: dict[str, str] = {}
