"""A corpus pipeline over documents: toxic texts go, near duplicates and leaked benchmark texts go, sources are mixed, and what stays is sharded.

Each stage takes (spark, docs, sf_dir) and gets all rows its predecessor kept. All but the last return the columns of
documents, whatever else they are called: a stage's own columns never clash with them. An empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontaminate, hilbert, mixing, ngram_join, toxicity
from veilspark.llm._spark import removed, run_dir
from veilspark.llm.queries import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8. The lexicon is fitted on the labelled documents of the input.

    Rows are judged one by one by their text: null and empty texts stay, repeated rows share their fate, null ids are
    judged like others (they only can't be labelled). Very long texts are read whole. There are no ties to break.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3. Of each group of linked documents the one of smallest id stays.

    Null ids come last, of equal ids the least text hash is first. Rows equal in id and text are one document, of which one
    row stays. Null, empty and blank texts are linked with nothing and stay. Very long texts are compared whole.
    """
    return ngram_join.keep_first(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7. Documents that hold ten words in a row of a benchmark item, or all words of a shorter item, go.

    Rows are judged one by one by their text: null and empty texts stay, repeated rows and ids don't matter. Items
    without words leak into nothing. Very long texts are scanned whole.
    """
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10. Documents are sampled towards tempered shares of source, language and fitted topic.

    A null source or language is a group of its own; texts without words are the topic empty, weigh nothing and stay with
    the probability asked for all. The draw hashes the id, so rows that share an id (or have none) and a cell share their fate.
    """
    return mixing.sample_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2. Each document's place: shard and slot along the Hilbert curve.

    Null and empty texts have 16 bytes and are one group; repeated rows and null ids each have a slot; rows that agree
    in all that orders them may take each other's. Null sources and languages come before all others.
    """
    return hilbert.shard_documents(docs).select("doc_id", "size", "text_crc32", F.col("curve").alias("hilbert_index"), "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("hilbert_shards", shard),
]

#: Scores and the curve have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is written and read again, and removed once the next one stands."""
    docs, before = table(spark, sf_dir, "documents"), None
    root = f"{run_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        if before:
            removed(spark, before)
        before = f"{root}/{name}"
    return docs
