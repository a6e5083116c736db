"""A training corpus from documents: five stages, each one operator over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import jaccard_join, line_dedup, packing, suffix_dedup, toxicity
from tickloom.llm._stage import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity is 0.3 or more, by models of the labelled ones among ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = docs.select(*COLUMNS)
    return toxicity.score(docs, toxicity.train(docs, labels)).where("toxicity < 0.3").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines found in ten documents or more; every document stays, if need be with an empty text."""
    kept = line_dedup.drop_frequent_lines(docs, 10, carry=("lang", "source"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of documents linked at a similarity of 0.8 the one of the smallest id; rows of one id share a fate."""
    linked = jaccard_join.link_documents(docs)
    kept = staged(linked.where("doc_id <=> component_id").select(F.col("doc_id").alias("_id")).distinct(), "kept")
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of 100 bytes that also start earlier in the corpus; characters that a cut leaves broken go too."""
    cut = suffix_dedup.remove_repeats(docs, 100, carry=("lang", "source"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens: a row for each piece."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: Language models, tokenizers and transitive links are beyond SQL; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
