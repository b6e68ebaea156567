"""A corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of
``docs``.  A stage's decisions take effect on its rows:

* language_id drops texts without a letter and texts whose profile is like no
  learned language: cosine under ``NOISE``, four deviations of that of random
  vectors, or under ``LEAST_COSINE`` where fewer than ``FEW_LETTERS`` letters are
  too few to tell;
* line_dedup cuts runs of lines that an earlier document has, and drops a
  document of which nothing is left;
* ngram_join keeps the document with the smallest id of each group of near copies;
* decontamination drops documents that hold a benchmark passage;
* packing returns the pieces of all remaining documents and their places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import common, decontamination, language_id, line_dedup, ngram_join, packing

LEAST_COSINE = 0.02
FEW_LETTERS = 24
NOISE = 4 / language_id.DIMENSIONS**0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lang, score = common.fresh(docs, "lang_pred"), common.fresh(docs, "score")
    labelled = language_id.identify(docs, names_out=(lang, score))
    few = F.length(F.regexp_replace("text", r"\P{L}+", "")) < FEW_LETTERS
    like = (F.col(score) >= NOISE) | ((F.col(score) >= LEAST_COSINE) & few)
    return labelled.where((F.col(lang) != "und") & like).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prefix = common.fresh(docs, "line_dedup_")  # apart from the table's own columns
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    cut = line_dedup.remove_repeated_lines(docs, prefix=prefix)
    removed = F.col(f"{prefix}removed") > 0
    emptied = removed & (F.trim(F.coalesce("text", F.lit(""))) == "")
    length = F.when(removed, F.length("text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    if length is not None:
        cut = cut.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return cut.where(~emptied).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    links = ngram_join.link_documents(docs)
    copies = links.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(docs, common.read(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", dedup_documents),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Hyperdimensional profiles and tokenizers have no SQL form; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.checkpoint(docs)
    return docs
