"""Labelled rows for classifiers: which are held out, and a bounded sample of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Bytes of the sample's texts, at most: what the driver holds.
SAMPLE_BYTES = 48 << 20


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 4, is 2. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int] | int) -> list[tuple[str, int]]:
    """(text, label) of labelled rows that are not held out, in the order of a hash of the id: `most` at most, of each label if it is a dictionary.

    Ids are chosen from the labels alone; their number is bounded by `most`, so they may be broadcast to the scan of texts.
    Each id gives one text (of rows that repeat it, the least), and ids are taken in their order while their texts fit
    into `SAMPLE_BYTES`; one that doesn't fit is passed over. If an id's labels differ, the larger one holds.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.max("_label").alias("_label")).withColumn("_order", F.xxhash64("_id"))
    if isinstance(most, int):
        chosen = known.orderBy("_order", "_id").limit(most)
    else:
        parts = [known.where(F.col("_label") == k).orderBy("_order", "_id").limit(n) for k, n in sorted(most.items())]
        chosen = parts[0]
        for part in parts[1:]:
            chosen = chosen.union(part)
    texts = docs.select(F.col("doc_id").alias("_doc"), F.coalesce("text", F.lit("")).alias("_text"))
    found = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_order", "_id", "_label").agg(F.min("_text").alias("_text"))
    found = stored(found.withColumn("_bytes", F.octet_length("_text")))
    fitting, left = [], SAMPLE_BYTES
    for row in sorted(found.select("_order", "_id", "_bytes").collect()):
        if row["_bytes"] <= left:
            left -= row["_bytes"]
            fitting.append(row["_id"])
    passed = found.count() - len(fitting)
    rows = (found.where(F.col("_id").isin(fitting)) if passed else found).select("_order", "_id", "_label", "_text").collect()
    rows.sort(key=lambda r: (r["_order"], r["_id"]))
    return [(r["_text"], r["_label"]) for r in rows]
