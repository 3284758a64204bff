"""Sentences with page and paragraph provenance, context subjects, and chunks.

A document's sentences are numbered inside its own row, by positions in nested arrays: no shuffle and no window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as X

SENTENCE_END = rf"(?<=[.!?])[{X.SPACE}]+"


def split_sentences(paragraph: Column) -> Column:
    """The default splitter: white space behind a full stop, question or exclamation mark."""
    return F.split(paragraph, SENTENCE_END)


def usable(text: Column, minimum: int) -> Column:
    return (F.length(text) >= minimum) & text.rlike(r"[\p{L}\p{N}]")


def sentences(docs: DataFrame, *, minimum: int = C.MIN_SENTENCE, splitter: Callable[[Column], Column] = split_sentences) -> DataFrame:
    """doc_id, sentence_index, text, page_number, paragraph_index of each usable sentence.

    docs has doc_id and text, and may have pages (array of page_number, text), which take the text's place where there
    are any. Paragraphs count across pages, those whose sentences are all dropped too.
    """
    if minimum < 1:
        raise ValueError("minimum_sentence_length must be at least 1.")
    whole = F.array(F.struct(F.lit(None).cast("int").alias("page_number"), F.coalesce("text", F.lit("")).alias("text")))
    units = whole
    if "pages" in docs.columns:
        pages = F.transform("pages", lambda p: F.struct(p["page_number"].cast("int").alias("page_number"), F.coalesce(p["text"], F.lit("")).alias("text")))
        units = F.when(F.size("pages") > 0, pages).otherwise(whole)
    paragraphs = F.flatten(F.transform(units, lambda u: F.transform(X.paragraphs_of(X.cleaned(u["text"])), lambda p: F.struct(u["page_number"].alias("page_number"), p.alias("text")))))
    kept = lambda p: F.filter(F.transform(splitter(p["text"]), X.collapse), lambda s: usable(s, minimum))
    found = F.flatten(F.transform(paragraphs, lambda p, i: F.transform(kept(p), lambda s: F.struct(s.alias("text"), p["page_number"].alias("page_number"), i.cast("int").alias("paragraph_index")))))
    rows = docs.select("doc_id", F.posexplode(found).alias("sentence_index", "s"))
    return rows.select("doc_id", F.col("sentence_index").cast("int").alias("sentence_index"), "s.text", "s.page_number", "s.paragraph_index")


def with_subject(rows: DataFrame) -> DataFrame:
    """Adds subject: the latest named one in the same paragraph, the sentence itself included."""
    own = F.when(~X.generic_framing(F.col("text")), X.context_subject(F.col("text")))
    upto = Window.partitionBy("doc_id", "paragraph_index").orderBy("sentence_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("subject", F.last(own, ignorenulls=True).over(upto))


# --- chunks ----------------------------------------------------------------------------------------------------------

CHUNK = "chunk_index int, text string, sentences array<struct<sentence_index:int,text:string,page_number:int,paragraph_index:int>>, page_numbers array<int>, estimated_token_count int"


def words(text: str) -> int:
    return len(text.split())


def tokenizer_size(tokenizer) -> Callable[[str], int]:
    """Sizes by a tokenizer that encodes with its special tokens."""
    if not callable(getattr(tokenizer, "encode", None)):
        raise TypeError("The tokenizer must offer encode(text, add_special_tokens=True).")

    def size(text: str) -> int:
        return len(tokenizer.encode(text, add_special_tokens=True))

    return size


def fill(sizes: list[int], target: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of consecutive sentences: a chunk closes when the next one would pass the target; the following one starts with the longest tail within the overlap that leaves room."""
    out: list[tuple[int, int]] = []
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > target:
            out.append((start, i))
            tail, held = i, 0
            while tail > start and held + sizes[tail - 1] <= overlap:
                tail -= 1
                held += sizes[tail]
            while tail < i and held + size > target:
                held -= sizes[tail]
                tail += 1
            start = tail
        held += size
    if sizes and (not out or out[-1] != (start, len(sizes))):
        out.append((start, len(sizes)))
    return out


def chunks(rows: DataFrame, *, target: int = C.CHUNK_TARGET, overlap: int = C.CHUNK_OVERLAP, size: Callable[[str], int] = words) -> DataFrame:
    """doc_id and chunks of consecutive sentences within a budget; a sentence is never split."""
    if target < 1:
        raise ValueError("target_size must be at least 1.")
    if not 0 <= overlap < target:
        raise ValueError("overlap_size must be non-negative and smaller than target_size.")
    names = ["sentence_index", "text", "page_number", "paragraph_index"]
    together = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("s"))
    if size is words:
        return _chunks(together, target, overlap)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, own in zip(frame["doc_id"], frame["s"]):
                for k, (a, b) in enumerate(fill([size(x["text"]) for x in own], target, overlap)):
                    part = [dict(x) for x in own[a:b]]
                    text = " ".join(x["text"] for x in part)
                    numbers = list(dict.fromkeys(x["page_number"] for x in part if x["page_number"] is not None))
                    out.append((doc_id, k, text, part, numbers, size(text)))
            yield pd.DataFrame(out, columns=["doc_id", "chunk_index", "text", "sentences", "page_numbers", "estimated_token_count"])

    return together.mapInPandas(run, f"doc_id {kind}, {CHUNK}")


def _chunks(together: DataFrame, target: int, overlap: int) -> DataFrame:
    """Chunks by words: only the sizes of documents that need more than one chunk leave the JVM."""

    @F.arrow_udf("array<struct<a:int,b:int>>")
    def cut(lists: pa.Array) -> pa.Array:
        return pa.array([None if own is None else [{"a": a, "b": b} for a, b in fill(own, target, overlap)] for own in lists.to_pylist()], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))

    add = lambda sizes: F.aggregate(sizes, F.lit(0), lambda n, k: n + k)
    sized = X.fixed(together, _sizes=F.transform("s", lambda x: X.split_count(x["text"])))
    sized = X.fixed(sized, _several=add(F.col("_sizes")) > target)
    ranges = F.coalesce(cut(F.when(F.col("_several"), F.col("_sizes"))), F.array(F.struct(F.lit(0).alias("a"), F.size("s").alias("b"))))
    each = sized.select("doc_id", "s", "_sizes", F.posexplode(ranges).alias("chunk_index", "_r"))
    part = lambda name: F.slice(name, F.col("_r.a") + 1, F.col("_r.b") - F.col("_r.a"))
    made = each.select("doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), part("s").alias("sentences"), add(part("_sizes")).alias("estimated_token_count"))
    pages = F.array_distinct(F.filter(F.transform("sentences", lambda x: x["page_number"]), lambda n: n.isNotNull()))
    return made.select("doc_id", "chunk_index", F.array_join(F.transform("sentences", lambda x: x["text"]), " ").alias("text"), "sentences", pages.alias("page_numbers"), "estimated_token_count")
