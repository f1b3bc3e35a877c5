"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.llm import (
    bag_minhash, collocations, exact_dedup, line_dedup, lz_fingerprint, merkle_audit, mixing, packing, pii, substring_dedup, toxicity,
    url_filters, whitening,
)
from driftwatch.llm.tables import documents, text_of

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
START = 1_704_067_200  # 2024-01-01 00:00 UTC


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(documents(spark, sf_dir))


def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a fetch time: the table has none, so ids are spread over thirty days."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", (START + F.col("page_id") * 7919 % (30 * 86_400)).alias("fetched_at"))


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated entries: every seventh page reports its host, parent domain or section a day or more after it was fetched."""
    pages = fetched_pages(spark, sf_dir).where("page_id % 7 = 0")
    host = url_filters.host_of(F.col("url"))
    turn = (F.col("page_id") / 7).cast("bigint") % 12
    pattern = (F.when(turn % 3 == 0, host).when(turn % 3 == 1, F.regexp_replace(host, r"^[^.]*\.", ""))
               .otherwise(url_filters.section_of(F.col("url"))))
    action = F.when(turn < 6, "block").when(turn < 9, "unlist").otherwise("allow")
    listed = START + (F.col("page_id") * 104_729 + 86_400) % (30 * 86_400)
    return pages.select(pattern.alias("pattern"), action.alias("action"), listed.alias("listed_at"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(fetched_pages(spark, sf_dir), list_entries(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every document is asked for, so it is carried along; the groups come by refinement."""
    digest = F.sha2(exact_dedup.normalised(text_of("text")), 256)
    groups = exact_dedup.copy_groups(documents(spark, sf_dir), carry={"text_sha256": digest})
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = substring_dedup.repeated_spans(documents(spark, sf_dir))
    return spans.select("doc_id", "start", "end", "words", "keep_doc_id", "keep_start")


def op6_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size")


def op7_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprints(documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(documents(spark, sf_dir), VOCABULARY)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def damaged(records: DataFrame) -> DataFrame:
    """A second replica: some records altered in place, some overwritten with zeros, some lost."""
    body = (F.when(F.col("record_id") % 97 == 13, F.translate("record", "<", "("))
            .when(F.col("record_id") % 131 == 7, F.repeat(F.lit("0"), F.col("length").cast("int"))).otherwise(F.col("record")))
    return records.where("record_id % 211 != 5").withColumn("record", body)


def op10_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = merkle_audit.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return merkle_audit.audit(records, damaged(records))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pii.personal_data(docs, pii.train(docs)).drop("base")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_line_dedup, op2_url_filters, op3_mixing, op4_exact_dedup, op5_substring_dedup, op6_bag_minhash,
        op7_lz_fingerprint, op8_best_fit_packing, op9_toxicity, op10_merkle_audit,
        op11_collocations, op12_personal_data, op13_whitening,
    )
}
