"""URL filters by a sort-merge range join.

A rule's host, its labels reversed and each closed by U+0001, is a prefix of the keys of exactly that host and its
subdomains: the rule is an interval of the sorted keys, and the intervals nest as hosts do. URLs and rules are sorted
together by range; a sweep of each range keeps a stack with one slot for each depth of nesting, which holds the last rule
host opened at that depth. A slot is active while the key still starts with the slot's key. Rules that are open where a
range begins are those of its first key's own prefixes, and an equality join finds them. Everything is DataFrame functions.

Scale: rules and URLs are dealt by ranges of their keys, and URLs of one key by a hash, so a host with a third of all rows
spreads over many ranges; no rule is copied but to the ranges that begin inside it. Two shuffles of page id, host and
path; the html column is never read. The rules come as a list of the caller's, of any length.

Cases: a null URL, or one without `://`, has an empty host and path and gets the default verdict. Repeated rows stay.
Any characters may occur in a host, U+0001 too. Of rules that fit, the longest (host and path) wins; between equal ones
the longer host, then the text. Columns of the input other than the id and the URL are not carried.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shuffle_partitions, stored

#: Ranges for each shuffle partition.
RANGES = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_END = "\u0001"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def parse(text: str) -> Rule:
    """`block net/` or `allow example.net/en/`."""
    verdict, _, where = text.partition(" ")
    host, slash, path = where.partition("/")
    if verdict not in ("allow", "block") or not host or not slash:
        raise ValueError(f"not a rule: {text!r}")
    return Rule(verdict, host.translate(str.maketrans(_UPPER, _LOWER)), slash + path)


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"^(?:(?!://)[\s\S])*+://[^/?#]*([^?#]*)", 1)), F.lit(""))


def key_of(host: Column) -> Column:
    plain = F.replace(F.replace(host, F.lit("\u0002"), F.lit("\u0002\u0003")), F.lit(_END), F.lit("\u0002\u0004"))
    return F.concat(F.array_join(F.reverse(F.split(plain, r"\.", -1)), _END), F.lit(_END))


def judge(pages: DataFrame, rules: Sequence[str], *, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule (text without verdict, else null) and verdict of each row."""
    parsed = sorted({parse(r) for r in rules})
    spark = pages.sparkSession
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.xxhash64("page_id", "url").alias("spread"))
    if not parsed:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    depths = sorted({r.host.count(".") for r in parsed})
    # One open event (kind 0) for each host with rules.
    opened = (
        spark.createDataFrame(parsed, "verdict string, host string, path string")
        .groupBy("host")
        .agg(F.collect_list(F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("hosts"), F.concat("host", "path").alias("rule"), "path", "verdict")).alias("rules"))
        .select(key_of(F.col("host")).alias("key"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("spread"), (F.size(F.split("host", r"\.", -1)) - 1).alias("depth"), "rules", *(F.lit(None).cast(t).alias(n) for n, t in (("page_id", pages.schema[id_column].dataType), ("host", "string"), ("path", "string"))))
    )
    asked = rows.select(key_of(F.col("host")).alias("key"), F.lit(1).alias("kind"), "spread", F.lit(None).cast("int").alias("depth"), F.lit(None).cast(opened.schema["rules"].dataType).alias("rules"), "page_id", "host", "path")
    ranges = RANGES * shuffle_partitions(spark)
    dealt = stored(opened.unionByName(asked).repartitionByRange(ranges, "key", "kind", "spread").withColumn("range", F.spark_partition_id()))
    # The rules whose intervals hold the first key of a range: those of its prefixes that end with a label.
    first = dealt.where("kind = 1").groupBy("range").agg(F.min("key").alias("least"))
    labels = F.split("least", _END)
    inside = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), _END), F.lit(_END)))
    begun = first.select("range", F.explode(inside).alias("key")).join(opened, "key")
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = [F.last(F.when(F.col("depth") == d, F.struct("key", "rules")), ignorenulls=True).over(sweep).alias(f"slot{d}") for d in depths]
    swept = dealt.unionByName(begun.select(*dealt.columns)).select("kind", "key", "page_id", "host", "path", *slots).where("kind = 1")
    active = [F.when(F.startswith(F.col("key"), F.col(f"slot{d}.key")), F.col(f"slot{d}.rules")) for d in depths]
    stack = F.flatten(F.filter(F.array(*active), lambda x: x.isNotNull()))
    best = F.array_max(F.filter(stack, lambda r: F.startswith(F.col("path"), r["path"])))
    return swept.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
