"""Mixing sources to target weights by weighted fair queueing.

Sources in the order of code points, null last, weigh 5, 2, 1, repeating. They share the total of all sizes; a target
stops at `MOST` times its source's size, and the excess is shared anew by weight until none is above. Documents of a
source queue in the order of a hash; a copy e (from 0) of a document ends at e * source_size + the cumulative size, and
its virtual finish time is that end over the target. All copies are sorted by range by finish time (then source, hash and
end) and numbered, and the mix ends where the running total would pass the budget, the total of all sizes. A document is
taken once for each of its copies before.

Scale: the texts are read once, for their sizes; what follows works on written tables of ids and sizes. Every running sum
(`running`: sizes of a source's documents, places of sources, caps of sources, sizes of all copies) is made by ranges: the
table is dealt by ranges of its order, `RANGE` rows each, so there are as many as the rows ask for; sums of ranges add up
over that small table, and each range adds them to its own. So neither a source with a third of all rows, nor as many
sources as documents, make a large window. `mixed` shuffles texts to their copies, and the copies into the mix's order.

Cases: null text has size 0; a document of size 0 is never taken; a source of size 0 has target 0. The null source and
the empty one are sources of their own. Rows that repeat an id queue one by one. An empty table gives no rows. `mix`
returns its own columns only; `mixed` (the pipeline's form) keeps the documents' columns, whatever their names, in the
order of the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import spare, stored

WEIGHTS = (5, 2, 1)
MOST = 3
#: Rows of a range.
RANGE = 1 << 16
SEED = "mix"


def size_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(rows: DataFrame, by: list[str], **sums: str) -> DataFrame:
    """rows, a written table, with no (each row's place, from 1, in the order of by) and, for each name in sums, the total of that column up to the row and with it."""
    parts = max(1, -(-rows.count() // RANGE))
    dealt = stored(rows.repartitionByRange(parts, *by).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(F.count("*").alias("_no"), *(F.sum(c).alias(f"_{name}") for name, c in sums.items()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # of ranges, not of rows
    starts = stored(totals.select("_range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_no", *(f"_{name}" for name in sums)))))
    upto = Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = [(F.col("_no") + F.row_number().over(upto)).alias("no"), *((F.col(f"_{name}") + F.sum(c).over(upto)).alias(name) for name, c in sums.items())]
    return dealt.join(starts, "_range").select(*rows.columns, *own)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From (source, source_size): adds place (from 0), start (the sizes of the sources before) and target.

    In the order of cap over weight the capped sources come first: one is capped if that ratio is below the level that
    the sources before it leave. The first one that is not capped has the level of all that follow.
    """
    spelt = stored(sources.withColumn("nameless", F.col("source").isNull()).withColumn("spelt", F.encode(F.coalesce("source", F.lit("")), "UTF-8")))
    placed = running(spelt, ["nameless", "spelt"], ends="source_size").withColumn("place", F.col("no") - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    placed = placed.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    placed = stored(placed.select("source", "source_size", "place", (F.col("ends") - F.col("source_size")).alias("start"), "weight", "cap", "ratio"))
    whole = placed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    left = F.lit(float(whole["size"] or 0)) - (F.col("caps") - F.col("cap"))
    shares = (F.lit(whole["weight"] or 0) - (F.col("weights") - F.col("weight"))).cast("double")
    judged = stored(running(placed, ["ratio", "place"], caps="cap", weights="weight").withColumn("level", left / shares).withColumn("capped", F.col("ratio") < F.col("level")))
    first = judged.where(~F.col("capped")).agg(F.min(F.struct("ratio", "place", "level"))["level"]).first()[0]
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.lit(first).cast("double"))
    return judged.select("source", "source_size", "place", "start", target.alias("target"))


def _keys(doc_id: Column, source: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a row's id, source and text."""
    parts = [doc_id, source, source.isNull(), text, text.isNull()]
    return F.xxhash64(*parts), F.xxhash64(F.lit(SEED), *reversed(parts))


def _sized(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    name, source, text = F.col(id_column), F.col(source_column), F.col(text_column)
    order = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(name.cast("string"), F.lit(""))).cast("binary"))
    ka, kb = _keys(name, source, text)
    return docs.select(name.alias("doc_id"), source.alias("source"), size_of(text).alias("size"), order.alias("order"), ka.alias("ka"), kb.alias("kb"))


#: The order of the queue. `ends` tells all copies apart.
_ORDER = ["vft", "place", "order", "ends"]


def _queue(light: DataFrame) -> tuple[DataFrame, DataFrame, int | None]:
    """Of light, a written table of what `_sized` selects: its rows with source_size, target, place and ends; all copies (e) of those that have words, numbered in the queue's order; and the number of the first copy that the mix has no room for."""
    shares = stored(targets(light.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))))
    rows = stored(light.join(shares.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of"))
    summed = running(rows, ["place", "order", "doc_id", "size", "ka", "kb"], upto="size")
    placed = stored(summed.withColumn("ends", F.col("upto") - F.col("start")).drop("upto", "no", "start"))
    copies = placed.where("size > 0 and target > 0").withColumn("e", F.explode(F.array(*(F.lit(e).cast("long") for e in range(MOST)))))
    copies = copies.withColumn("ends", F.col("e") * F.col("source_size") + F.col("ends")).withColumn("vft", F.col("ends") / F.col("target"))
    queue = stored(running(stored(copies), _ORDER, total="size"))
    budget = placed.agg(F.sum("size")).first()[0] or 0
    return placed, queue, queue.where(F.col("total") > budget).agg(F.min("no")).first()[0]


def mix(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken (words) and position (of the first copy in the mix, from 1; null if none is taken) of each row."""
    placed, queue, end = _queue(stored(_sized(docs, id_column, text_column, source_column)))
    firsts = queue.where("e = 0")
    copies = F.lit(0)
    if end is None:
        copies = F.lit(MOST)
    else:
        cut = queue.where(F.col("no") == end).first()
        limit = F.struct(*(F.lit(cut[c]).alias(c) for c in _ORDER))
        for e in range(MOST):
            ends = e * F.col("source_size") + F.col("ends")
            copies = copies + (F.struct((ends / F.col("target")).alias("vft"), "place", "order", ends.alias("ends")) < limit).cast("int")
    position = F.when(F.col("no") < end, F.col("no")) if end is not None else F.col("no")
    some = firsts.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), position.cast("long").alias("position"))
    none = placed.where("not (size > 0 and target > 0)").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("position"))
    return some.unionByName(none)


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of the mix in its order: those of docs, each as often as it is taken."""
    light = stored(_sized(docs, "doc_id", "text", "source"))
    _, queue, end = _queue(light)
    taken = queue if end is None else queue.where(F.col("no") < end)
    names = docs.columns
    ka, kb, own, position = spare(names, "_ka", "_kb", "_own", "_position")
    keys = _keys(F.col("doc_id"), F.col("source"), F.col("text"))
    rows = docs.withColumn(ka, keys[0]).withColumn(kb, keys[1])
    places = taken.select(F.col("ka").alias(ka), F.col("kb").alias(kb), (F.col("ends") - F.col("e") * F.col("source_size")).alias(own), F.col("no").alias(position))
    on = [ka, kb]
    if not light.groupBy("ka", "kb").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        # Rows that share id, source and text are alike; their places in the queue are dealt out by number.
        places = places.withColumn(own, F.dense_rank().over(Window.partitionBy(ka, kb).orderBy(own)).cast("long"))
        rows = rows.withColumn(own, F.row_number().over(Window.partitionBy(ka, kb).orderBy(F.lit(0))).cast("long"))
        on.append(own)
    else:
        places = places.drop(own)
    return rows.join(places, on).orderBy(position).select(*names)
