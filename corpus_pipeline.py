"""A corpus pipeline of five operators, each stage over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeledger.llm import decontaminate, lines, minhash, packing, toxicity
from routeledger.llm.shared import table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels that are not held out, does not reject. Null and empty texts score as the
    model's intercept does and stay, as rows without doc_id and repeated rows do if their text is not rejected."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.train(table(spark, sf_dir, "documents"), labels)
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that are boilerplate of their source; a null source is one. All rows stay, null texts as they are."""
    cut = lines.drop_boilerplate(docs)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return cut.select(*(n_chars if c == "n_chars" else c for c in docs.columns))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, and one row of each doc_id. Documents without words, and rows without doc_id, all stay."""
    return minhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; rows without doc_id stay."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens; a null text is an empty one, of one piece."""
    return packing.pack(docs, packing.word_tokenizer())


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_boilerplate),
    ("minhash_near_dedup", without_copies),
    ("benchmark_decontamination", without_benchmark),
    ("best_fit_packing", packed),
]

#: Model training, near-duplicate search and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents; each one's rows are written as Parquet and read again as the next one's."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
