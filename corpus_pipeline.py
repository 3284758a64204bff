"""The corpus pipeline: toxicity, near-duplicates, repeated passages, mix, packing.

Near-duplicates are documents whose shingles have a Jaccard similarity of `NEAR` percent or more, or that such links
connect; op7_minhash has its own threshold of 85.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import minhash, mixing, packing, suffix_dedup, toxicity
from lectern.llm.queries import tokenizer_path
from lectern.llm.shared import let_go, shared_folder, stored, table

#: Jaccard similarity of near-duplicates, in percent.
NEAR = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. Null and empty texts have the background's score and stay; so do null ids, repeated rows and other columns."""
    return toxicity.filtered(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id.

    Null, empty and blank texts are near nothing, and rows with a null id take part in nothing: they stay. Of rows that
    repeat an id that stays, the one whose text has the least hash does.
    """
    found = minhash.near_duplicates(docs, percent=NEAR).where("doc_id is not null")
    judged = stored(found.groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"))
    alone = docs.join(judged.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    if judged.where("kept").isEmpty():
        return alone
    row = F.struct(*(F.col(c) for c in docs.columns))
    repeated = docs.join(judged.where("kept").select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.xxhash64("text")).alias("row"))
    return alone.unionByName(repeated.select("row.*"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat an earlier passage. All rows stay, those left without text too; null texts stay null, and null ids keep their texts."""
    return suffix_dedup.reduced(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in its order. Those without words, null and empty texts among them, are never taken."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents with their ids and their places in sequences; row tells a document's copies apart. A text without tokens is its closing id."""
    return packing.packed_documents(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mix", mix_sources),
    ("packing", pack_sequences),
]

#: SQL expresses neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        let_go(spark)
    return docs
