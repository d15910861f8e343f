"""Queries of the training-data operators with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveloom.llm import embed_dedup, license_scan, line_dedup, mixing, packing, simhash, sql, topk, toxicity, url_filter, warc

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
URL_DEFAULT = "allow"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.known_licenses(spark))


def op2_warc_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses_of_pages(table(spark, sf_dir, "pages")))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules, default=URL_DEFAULT)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("__lines").cast("long").alias("n_lines"), F.col("__dropped").cast("long").alias("n_dropped"), "text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_warc_derivative": op2_warc_derivative,
    "op3_topk_search": op3_topk_search,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_mixing": op5_mixing,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": sql.LICENSES,
    "op2_warc_derivative": sql.WARC,
    "op3_topk_search": sql.TOP_K,
    "op4_embedding_near_dedup": sql.EMBED_DEDUP,
    "op5_mixing": sql.MIXING,
    "op7_url_filter": sql.url_filter(URL_RULES, URL_DEFAULT),
}
