"""The registered queries of this subpackage, each over its whole table with production parameters."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.llm import (
    collocations, contamination, html, lines, mixing, ngrams, packing, quality, repeats, simhash, spelling, toxicity, warc,
)
from clientele.llm.frames import documents


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "lang", "text")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.archive_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir, "doc_id", "source", "text"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.without_fuzzy_lines(documents(spark, sf_dir, "doc_id", "text"))
    return cut.select("row.doc_id", "n_lines", "n_removed", F.col("kept_text").alias("text"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.without_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.bigram_scores(documents(spark, sf_dir, "doc_id", "text")).drop("perplexity")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(documents(spark, sf_dir, "doc_id", "lang", "source", "text"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir, "lang", "text"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir, "doc_id", "text"))
    return packed.select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir, "doc_id", "text"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_warc": op2_warc,
    "op3_decontamination": op3_decontamination,
    "op4_simhash": op4_simhash,
    "op5_mixing": op5_mixing,
    "op6_lines": op6_lines,
    "op7_repeats": op7_repeats,
    "op8_ngrams": op8_ngrams,
    "op9_html": op9_html,
    "op10_quality": op10_quality,
    "op11_collocations": op11_collocations,
    "op12_packing": op12_packing,
    "op13_spelling": op13_spelling,
}
