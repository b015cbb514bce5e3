"""The registered queries of the training-data operators and their DuckDB equivalents. Each query
is a thin layer: it reads whole tables, calls its operator and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.llm import audit, decontaminate, html_text, importance, langid, licences, link_trust, near_dups, oracles, packing, quality, sharding, toxicity, warc
from orbitweave.llm.common import crc32_of, table, written

N_SHARDS = 40


def op1_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc32_of("doc_id") % 5 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", "text"), model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc32_of("doc_id") % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs.where(~held_out), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"), F.when(F.col("toxic_score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"), F.size("toxic_spans").alias("n_spans"))


def op3_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    hit = decontaminate.n_hit(F.col("spans"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses_of_pages(table(spark, sf_dir, "pages")), keep=["page_id"])
    return records.withColumn("block", F.decode("block", "UTF-8"))


def op5_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]).withColumn("stated_licences", F.concat_ws(",", "stated_licences"))


def op6_two_pass_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_perplexity_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    # the text is left out of the written rows
    return quality.assess(docs, keep=["doc_id"]).select("doc_id", *quality.COUNTS, "base_failed", "kept", "log_ppl")


def op9_odd_sketch_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op10_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = [1.0] * N_SHARDS
    text = F.coalesce("text", F.lit(""))
    rows = sharding.assign_shards(docs, "doc_id", weights)
    rows = sharding.assign_shards(rows, "doc_id", [*weights, 1.0], "grown_shard")
    rows = written(rows.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "shard", "grown_shard"), "shards")
    return sharding.numbered(rows, "shard", ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judge(table(spark, sf_dir, "pages"), keep=["page_id"])


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_centroid_language": op1_centroid_language,
        "op2_crf_toxicity": op2_crf_toxicity,
        "op3_fm_index_decontamination": op3_fm_index_decontamination,
        "op4_warc_derivatives": op4_warc_derivatives,
        "op5_licence_digests": op5_licence_digests,
        "op6_two_pass_html": op6_two_pass_html,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_perplexity_quality": op8_perplexity_quality,
        "op9_odd_sketch_near_dups": op9_odd_sketch_near_dups,
        "op10_rendezvous_shards": op10_rendezvous_shards,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_link_trust": op12_link_trust,
        "op13_source_audit": op13_source_audit,
    }


def oracle_sql() -> dict[str, str]:
    """The others fit models, read markup or use tokenizers, which SQL can't express; tests compare op1,
    op7 and op8 with brute-force versions, hold op2 to its marginals by enumeration and its held-out
    labels, op4 to round trips and op6 to pages made by hand."""
    return oracles.all_sql(N_SHARDS)
