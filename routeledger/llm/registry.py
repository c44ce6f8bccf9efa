"""Queries that apply each operator to its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeledger.llm import chat, clusters, decontaminate, fingerprints, lines, minhash, passages, phrases, pii, search, toxicity, urls
from routeledger.llm.packing import pack, word_tokenizer
from routeledger.llm.shared import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document that others repeat."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), word_tokenizer())


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page."""
    return urls.filter_urls(table(spark, sf_dir, "pages"), urls.CONTRACT_RULES)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from the labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of the conversations in order, with linked tool calls, as canonical JSON."""
    return chat.format_chats(table(spark, sf_dir, "conversations"), chat.TOOLS)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of alike texts of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines, as a digest."""
    return lines.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it holds."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for every row whose vec_id is divisible by 100."""
    vectors = search.usable(table(spark, sf_dir, "embeddings"))
    return search.top_k(vectors, vectors.where(search.every(100)))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints of every document and of its edited text, and how alike they are."""
    return fingerprints.compared_with_next(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector of 64 components."""
    return clusters.clusters(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_url_filters": op3_url_filters,
    "op4_toxicity": op4_toxicity,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_pii": op9_pii,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_document_fingerprints": op11_document_fingerprints,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLES: dict[str, str | None] = {"op5_chat_formatting": chat.ORACLE, "op3_url_filters": urls.ORACLE, "op7_line_dedup": lines.ORACLE, "op12_phrase_collocations": phrases.ORACLE, "op13_centroid_clustering": clusters.ORACLE}
