"""Frequency, TF-IDF, score, deduplication and coverage-aware choice of candidates, each per document."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions import text as X
from . import whole


def by_type(kind: Column, which: int) -> Column:
    """Bonus (0) or priority (1) of a candidate's type."""
    out = F.lit(None)
    for name, values in C.CANDIDATE_TYPES.items():
        out = F.when(kind == name, F.lit(values[which])).otherwise(out)
    return out


def frequency(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "normalized_text").agg(F.count("*").cast("int").alias("frequency"))


def with_tfidf(rows: DataFrame) -> DataFrame:
    """Adds tfidf, see `whole.tfidf`. All counts are a document's own: rows must be dealt by doc_id, and are sorted by it. Rows without one weigh 0."""
    schema = T.StructType([*rows.schema.fields, T.StructField("tfidf", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole.documents(batches):
            yield from table.append_column("tfidf", pa.array(whole.tfidf(table))).to_batches()

    made = rows.sortWithinPartitions("doc_id", "normalized_text").mapInArrow(run, schema)
    return made.withColumn("tfidf", F.when(F.col("doc_id").isNotNull(), F.col("tfidf")).otherwise(0.0))


def tfidf(rows: DataFrame) -> DataFrame:
    """doc_id, sentence_index, normalized_text, tfidf: the largest weight of the phrase or of one of its words, 0 if none is a feature."""
    asked = rows.select("doc_id", "sentence_index", "normalized_text", "source_sentence").repartition("doc_id")
    return with_tfidf(asked).groupBy("doc_id", "sentence_index", "normalized_text").agg(F.max("tfidf").alias("tfidf"))


def score(tfidf_score: Column, kind: Column, count: Column, sentence: Column, normal: Column) -> Column:
    total = (
        tfidf_score
        + by_type(kind, 0)
        + C.FREQUENCY_BONUS * F.least(F.greatest(count - 1, F.lit(0)), F.lit(3))
        + C.SENTENCE_BONUS * F.least(F.length(sentence) / 180, F.lit(1.0))
        - C.LENGTH_PENALTY * F.greatest(F.size(X.candidate_tokens(normal)) - 3, F.lit(0))
    )
    return F.bround(total, 6)


def scored(rows: DataFrame) -> DataFrame:
    """Adds frequency and importance_score; what follows by document needs no other exchange."""
    same = Window.partitionBy("doc_id", "normalized_text")
    counted = rows.where("doc_id IS NOT NULL").repartition("doc_id").withColumn("frequency", F.count("*").over(same).cast("int"))
    value = score(F.col("tfidf"), F.col("candidate_type"), F.col("frequency"), F.col("source_sentence"), F.col("normalized_text"))
    return with_tfidf(counted).withColumn("importance_score", value).drop("tfidf").repartition("doc_id")


def deduplicated(rows: DataFrame) -> DataFrame:
    """The strongest occurrence of each phrase in a document."""
    best = Window.partitionBy("doc_id", "normalized_text").orderBy(F.desc("importance_score"), F.desc(by_type(F.col("candidate_type"), 1)), "sentence_index", F.lower("text"), "emit_order")
    return rows.withColumn("_no", F.row_number().over(best)).where("_no = 1").drop("_no")


def ranked(rows: DataFrame) -> DataFrame:
    """Adds rank (from 1)."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("importance_score"), F.desc(by_type(F.col("candidate_type"), 1)), "normalized_text", "sentence_index")
    return rows.withColumn("rank", F.row_number().over(order))


def rank(rows: DataFrame) -> DataFrame:
    return ranked(deduplicated(scored(rows)))


def diverse(rows: DataFrame, limit: int = C.CANDIDATE_LIMIT) -> DataFrame:
    """The best candidates, each paragraph's later ones less by a penalty; pick is their order (from 1).

    A paragraph's r-th best candidate is always taken r-th of it, at its score less (r - 1) penalties, and these only
    fall; so the greedy choice is one sort.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1.")
    own = Window.partitionBy("doc_id", "page_number", "paragraph_index").orderBy(F.desc("importance_score"), "normalized_text", "sentence_index")
    less = F.col("importance_score") - C.COVERAGE_PENALTY * (F.row_number().over(own) - 1)
    pick = Window.partitionBy("doc_id").orderBy(F.desc("_less"), F.desc("importance_score"), "normalized_text", "sentence_index")
    return rows.withColumn("_less", less).withColumn("pick", F.row_number().over(pick)).where(F.col("pick") <= limit).drop("_less")

