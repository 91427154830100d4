"""A pipeline from raw documents to packed sequences; each stage calls one operator of ``factgraph.llm``.

Each stage gets what the one before kept, written as Parquet and read again. All but the last return the columns of
``documents``, and other columns that the table has, whatever their names. Every stage takes nulls in any column, empty and
very long texts, repeated rows and empty tables; what it does with them stands at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factgraph.llm import exact_dedup, jaccard_join, packing, quality_model, quality_rules
from factgraph.llm.common import forget, written
from factgraph.llm.queries import tokenizer_file


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, trained on the labels of ``sf_dir``, keeps.

    Null and empty texts are rejected, texts in languages without trusted text kept. Rows that share an identifier go only if
    all of them are rejected; rows without one count as sharing it.
    """
    return quality_model.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules, without the lines that are common on their host, and ``n_chars`` to match.

    Null and empty texts have no words and are rejected; a null source is the empty host. Rows that share an identifier go
    only if all of them are rejected.
    """
    return quality_rules.clean(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest identifier, of repeated rows one; a null text equals an empty one."""
    return exact_dedup.drop_duplicates(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the row with the smallest identifier; a row without words, or without an identifier and links, stays."""
    return jaccard_join.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document's tokens with their sequence and offset; a null or empty text is its end token alone."""
    return packing.pack(packing.pieces(docs, tokenizer_file()))


STAGES = [("quality classifier", classify), ("quality rules", rules), ("exact dedup", exact), ("n-gram Jaccard join", near), ("best-fit packing", pack)]

#: SQL has no model of characters, no similarity join and no packing; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; of the others only the tables that the next one reads are kept meanwhile."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}")
        if before is not None:
            forget(before)
        before = docs
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
