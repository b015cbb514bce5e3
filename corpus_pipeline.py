"""From documents to packed training sequences: quality rules, toxicity, near-duplicates, benchmark
decontamination, packing. Each stage takes what the one before kept, as Parquet, and all but the
last return the columns of documents.

Rows without an id are kept by all stages that do not judge their text; rows that repeat an id and
a text become one in the near-duplicate stage. Columns may have any names, and repeat: stages work
on numbered columns and give the names back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.llm import decontaminate, near_dups, packing, quality, toxicity
from orbitweave.llm.common import crc32_of, table, written
from orbitweave.llm.queries import tokenizer_path


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ..., and where the first column of each name went."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), {old: new for old, new in reversed(list(zip(docs.columns, names, strict=True)))}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's perplexity bands."""
    rows, at = numbered(docs)
    return quality.assess(rows, lang=at["lang"], text=at["text"]).where("kept").select(*rows.columns).toDF(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold. The model learns from the labelled
    documents of this stage's input that are not held out."""
    rows, at = numbered(docs)
    held_out = F.coalesce(crc32_of(at["doc_id"]) % 4 == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias(at["doc_id"]), "toxic")
    model = toxicity.fit(rows.where(~held_out), labels, doc_id=at["doc_id"], text=at["text"])
    return toxicity.score(rows, model, text=at["text"]).where(F.col("toxic_score") < toxicity.THRESHOLD).select(*rows.columns).toDF(*docs.columns)


def near_dups_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates."""
    rows, at = numbered(docs)
    doc_id, text = at["doc_id"], at["text"]
    rows = rows.withColumn("_key", F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    found = near_dups.near_duplicates(rows, doc_id=doc_id, text=text, keep=["_key"])
    kept = found.where(F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_kept"), F.col("_key").alias("_text")).distinct()
    one = rows.join(kept, (F.col(doc_id) == F.col("_kept")) & (F.col("_key") == F.col("_text")), "left_semi").dropDuplicates([doc_id, "_key"])
    return one.unionByName(rows.where(F.col(doc_id).isNull())).drop("_key").toDF(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark phrases. A document of which no word is left goes;
    n_chars follows the text."""
    rows, at = numbered(docs)
    text = F.col(at["text"])
    found = decontaminate.scan(rows, table(spark, sf_dir, "benchmark"), text=at["text"], remove=True)
    cut = F.size("spans") > 0
    found = found.where(~(cut & (F.trim(F.regexp_replace(text, "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", " ")) == "")))
    if "n_chars" in at:
        n = F.col(at["n_chars"])
        found = found.withColumn(at["n_chars"], F.when(cut, F.length(text).cast(dict(rows.dtypes)[at["n_chars"]])).otherwise(n))
    return found.select(*rows.columns).toDF(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    rows, at = numbered(docs)
    return packing.pack_documents(rows, tokenizer_path(), doc_id=at["doc_id"], text=at["text"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_dups_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The stages fit models and search indexes, which SQL can't express; tests hold each stage's operator
#: against a brute-force version, and the stages against what they must leave.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
