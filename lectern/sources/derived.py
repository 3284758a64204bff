"""Corpora made from the tables by expressions that Spark and the SQL of the tests share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NATION = "replace(n_name, '_', ' ')"
NATION_FACTS = (
    f"concat({NATION}, ': overview of trade. The goal is to measure ', CAST(n_nationkey * 3 + 5 AS STRING), ' percent of exports. ', {NATION}, ' includes ', r_name, ' region. ', "
    f"{NATION}, ' stores ', CAST(n_nationkey + 10 AS STRING), ' kg of grain. ', {NATION}, ' converts solar energy into electric power. Vaccines are used to treat common illness in ', {NATION}, '. "
    f"The treaty was signed on March ', CAST(n_nationkey % 27 + 1 AS STRING), ', 19', CAST(50 + n_nationkey AS STRING), ' by ', r_name, '. ', {NATION}, ' is a member of ', r_name, '. Trade with ', r_name, ' means growth for ', {NATION}, '.')"
)
PART_FACTS = (
    "concat('The term ', p_name, ' is defined as a ', lower(p_type), ' part. ', p_name, ' refers to item ', p_brand, ' in the list. A common task of ', p_name, ' is to hold ', CAST(p_size AS STRING), ' million units. ', "
    "'Engine ', CAST(p_partkey AS STRING), ' performs ', CAST(p_size AS STRING), ' percent of the work.')"
)
PARAGRAPHS = (
    "CASE doc_id % 4 WHEN 0 THEN replace(text, '{nl}', '{cr}{nl}{cr}{nl}') WHEN 1 THEN replace(text, '{nl}', '{nl} {nl}{nl}') WHEN 2 THEN replace(replace(text, ' the ', '{nb}the{bell} '), '{nl}', '{nl}{nl}') "
    "ELSE replace(replace(text, 'th', 't-{nl}h'), '. ', '.{tab} {nl}{nl}') END"
).format(nl="\n", cr="\r", nb=" ", bell="\x07", tab="\t")

# Fixed tags of a small lexicon.
LEXICON = {
    "NNP": "AFRICA AMERICA ASIA EUROPE MIDDLE EAST NATION March Engine".split(),
    "NN": "trade goal region grain energy power illness treaty growth member term part item list task work ring widget".split(),
    "NNS": "exports Vaccines units".split(),
    "JJ": "solar electric common small red".split(),
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: sentences about nations and parts."""
    nations = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    a = nations.selectExpr("CAST(1000000000 + n_nationkey AS BIGINT) AS doc_id", f"{NATION_FACTS} AS text")
    return a.unionByName(_table(spark, sf_dir, "part").selectExpr("CAST(2000000000 + p_partkey AS BIGINT) AS doc_id", f"{PART_FACTS} AS text"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with blank lines, hard blanks, control characters and words cut at a line's end."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.expr(PARAGRAPHS.replace("\\", "\\\\")).alias("text"))


def lexicon(spark: SparkSession) -> DataFrame:
    """token, tag. Made of literals, whose size the planner knows: a table of Python's rows has none, and tokens would be shuffled by their texts for it."""
    entries = F.array(*(F.struct(F.lit(token).alias("token"), F.lit(tag).alias("tag")) for tag, tokens in LEXICON.items() for token in tokens))
    return spark.range(1, numPartitions=1).select(F.inline(entries))


def workflow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("begin", "complete", "record", "submit", "reset")))
    rows = _table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.get(kinds, (F.col("event_id") * 7 % 11 % 5).cast("int")).alias("event"), F.col("props").alias("payload"))
