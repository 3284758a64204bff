"""Candidate answers: definitions, dates and quantities, relations, runs of tagged tokens."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as X
from .segment import with_subject

_EDGE = rf"(?<![{X.WORD}])"
_END = rf"(?![{X.WORD}])"
# Patterns of answers. \b of the plain forms is spelt out for all alphabets.
_YEAR = r"(?:1[5-9]\d{2}|20\d{2}|21\d{2})"
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
DEFINITION = rf"(?i)^\s*([A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z][A-Za-z0-9-]*){{0,4}}?)\s+(?:is\s+defined\s+as|refers\s+to|means|is){_END}"
YEAR = rf"{_EDGE}{_YEAR}{_END}"
DATE = rf"(?i){_EDGE}(?:{_MONTH}\s+\d{{1,2}}(?:,\s*|\s+){_YEAR}|\d{{1,2}}\s+{_MONTH}\s+{_YEAR}){_END}"
QUANTITY = rf"(?i){_EDGE}\d+(?:\.\d+)?%|{_EDGE}\d+(?:\.\d+)?\s*(?:percent(?:age)?|thousand|million|billion|kilometers?|kilometres?|meters?|metres?|kilograms?|kg|km){_END}"
_SUBJECT = rf"([A-Z][{X.WORD} -]{{1,50}}?)\s+"
#: Pattern, its groups of subject (0: none), relation and answer, and the words of which it holds one.
RELATIONS = (
    (rf"(?i){_SUBJECT}(converts)\s+.+?\s+into\s+([^.]+)", 1, 2, 3, ("converts",)),
    (rf"(?i){_SUBJECT}(stores|predicts|includes|performs)\s+([^.]+)", 1, 2, 3, ("stores", "predicts", "includes", "performs")),
    (rf"(?i){_SUBJECT}(is|are)\s+used\s+to\s+[{X.WORD}]+\s+([^.]+)", 1, 2, 3, ("used",)),
    (r"(?i)(?:a|an|the|one)\s+(common task|example|goal|purpose|use|benefit|function)\s+(?:of|is)\s+([^.]+)", 0, 1, 2, ("common task", "example", "goal", "purpose", "use", "benefit", "function")),
)
TOKEN = rf"[{X.WORD}]+|[^{X.WORD}{X.SPACE}]+"
# Tags of nouns, and of what noun phrases hold.
PROPER, NOUNS, PHRASE = ("NNP", "NNPS"), ("NN", "NNS", "NNP", "NNPS"), ("NN", "NNS", "NNP", "NNPS", "JJ", "JJR", "JJS")
UNKNOWN_TAG = "VBZ"

_BASE = ["doc_id", "sentence_index", "paragraph_index", "page_number"]
CANDIDATE = [*_BASE, "text", "normalized_text", "source_sentence", "candidate_type", "subject", "relation", "emit_order"]


def usable(normal: str, tokens: str, words: str, sentence: Column, most: Column | int) -> Column:
    """Of columns: the normalised text, its tokens, and those of them that are words."""
    length, stop = F.length(normal), F.array(*map(F.lit, C.STOPWORDS))
    whole = F.when(F.size(words) > 3, F.col(normal) == X.normalize_candidate(sentence)).otherwise(False)
    return (
        (length >= C.CANDIDATE_MIN_CHARS)
        & (length <= C.CANDIDATE_MAX_CHARS)
        & (F.size(words) > 0)
        & (F.size(tokens) <= most)
        & ~F.forall(words, lambda t: F.array_contains(stop, F.lower(t)))
        & ~whole
    )


_RAW = [*_BASE, "sentence", "raw", "candidate_type", "subject", "relation", "emit_order"]


def _made(rows: DataFrame) -> DataFrame:
    """Usable candidates of raw ones (_RAW), whatever their types: cleaned and judged in one place of a plan."""
    most = F.when(F.col("candidate_type") == "relation phrase", C.RELATION_MAX_TOKENS).otherwise(C.CANDIDATE_MAX_TOKENS)
    made = X.fixed(rows, text=X.strip(X.collapse(F.col("raw")), " ,;:\\-"))
    made = X.fixed(made, normalized_text=X.normalize_candidate(F.col("text")))
    made = X.fixed(made, _tokens=X.candidate_tokens(F.col("normalized_text")))
    made = X.fixed(made, _words=F.filter("_tokens", lambda t: t != "%"))
    made = made.where(usable("normalized_text", "_tokens", "_words", F.col("sentence"), most))
    return made.select(*_BASE, "text", "normalized_text", F.col("sentence").alias("source_sentence"), "candidate_type", "subject", "relation", "emit_order")


FOUND = "array<struct<raw:string,candidate_type:string,subject:string,relation:string,emit_order:array<int>>>"


def _order(*parts: Column | int) -> Column:
    return F.array(*(p.cast("int") if isinstance(p, Column) else F.lit(p) for p in parts))


def _found(raw: Column, kind: str, order: Column, subject: Column | None = None, relation: Column | None = None) -> Column:
    """An element of FOUND."""
    none = F.lit(None).cast("string")
    parts = {"raw": raw, "candidate_type": F.lit(kind), "subject": none if subject is None else subject, "relation": none if relation is None else relation, "emit_order": order}
    return F.struct(*(v.alias(k) for k, v in parts.items()))


def _listed(rows: DataFrame, *found: Column) -> DataFrame:
    """Raw candidates (_RAW) of sentences from arrays of them: one generator, so one reading of the sentences, whatever their kinds."""
    named = rows if "sentence" in rows.columns else rows.withColumn("sentence", F.col("text"))
    return named.select(*_BASE, "sentence", F.inline(F.concat(*(f.cast(FOUND) for f in found)))).select(*_RAW)


def _definitions() -> list[Column]:
    term = F.regexp_replace(F.regexp_extract("text", DEFINITION, 1), r"(?i)^(?:the\s+)?term\s+", "")
    return [F.when(F.col("text").rlike(DEFINITION), F.array(_found(term, "definition term", _order(0, 0, 0)))).otherwise(F.array().cast(FOUND))]


def _patterns() -> list[Column]:
    def every(k: int, pattern: str, kind: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda raw, i: _found(raw, kind, _order(1 + k, i, 0)))

    return [every(k, *x) for k, x in enumerate(((DATE, "date/year"), (YEAR, "date/year"), (QUANTITY, "quantity/percentage")))]


def _relations() -> list[Column]:
    out = []
    for k, (pattern, subject, relation, answer, words) in enumerate(RELATIONS):
        # Most sentences hold none of the words, and are not searched.
        worth = reduce(or_, (F.contains(F.lower("text"), F.lit(w)) for w in words))
        every = lambda g: F.regexp_extract_all("text", F.lit(pattern), F.lit(g))
        groups = [every(relation).alias("relation"), every(answer).alias("raw")] + ([every(subject).alias("own")] if subject else [])

        def one(m: Column, i: Column) -> Column:
            named = F.coalesce(F.nullif(m["own"], F.lit("")), F.col("subject")) if subject else F.col("subject")  # noqa: B023
            return _found(m["raw"], "relation phrase", _order(4 + k, i, 0), X.strip(named), F.lower(m["relation"]))  # noqa: B023

        out.append(F.when(worth, F.transform(F.arrays_zip(*groups), one)).otherwise(F.array().cast(FOUND)))
    return out


def definitions(rows: DataFrame) -> DataFrame:
    """The term that a sentence starts by defining."""
    return _made(_listed(rows, *_definitions()))


def patterns(rows: DataFrame) -> DataFrame:
    """All dates, then years, then quantities."""
    return _made(_listed(rows, *_patterns()))


def relations(rows: DataFrame) -> DataFrame:
    """Answers of relation patterns; rows has subject, which stands in where a pattern names none."""
    return _made(_listed(rows, *_relations()))


def tagged(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The sentences' tokens with tags by a lexicon (token, tag); unknown ones are verbs. The planner chooses how to join."""
    tokens = rows.select(*_BASE, F.col("text").alias("sentence"), F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    known = lexicon.groupBy(F.col("token").alias("_token")).agg(F.min("tag").alias("tag"))
    return tokens.join(known, F.col("token") == F.col("_token"), "left").drop("_token").withColumn("tag", F.coalesce("tag", F.lit(UNKNOWN_TAG)))


def raw_runs(tokens: DataFrame) -> DataFrame:
    """A sentence's tagged tokens meet once, in one row; runs are ranges of places in it."""
    t = tokens.where(F.col("tag").isin(*sorted({*PROPER, *NOUNS, *PHRASE}))).groupBy(*_BASE, "sentence").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "tag"))).alias("t"))
    of = lambda tags: F.filter("t", lambda x: x["tag"].isin(*tags))
    own = X.fixed(t, proper=of(PROPER), phrase=of(PHRASE), nouns=of(NOUNS))

    def edges(name: str, step: int) -> Column:
        """Places whose neighbour on that side does not adjoin."""
        return F.filter(F.transform(name, lambda x, i: F.when(~F.coalesce(F.get(name, i + step)["pos"] == x["pos"] + step, F.lit(False)), i)), lambda i: i.isNotNull())

    own = X.fixed(own, **{f"{name}_{side}": edges(name, step) for name in ("proper", "phrase") for side, step in (("from", -1), ("to", 1))})

    def runs(name: str, k: int, kind: str) -> Column:
        def one(first: Column, i: Column) -> Column:
            last = F.get(f"{name}_to", i)
            raw = F.array_join(F.transform(F.slice(name, first + 1, last - first + 1), lambda x: x["token"]), " ")
            return _found(raw, kind, _order(8, F.get(name, last)["pos"] + 1, k))

        return F.transform(f"{name}_from", one)

    single = F.transform("nouns", lambda x: _found(x["token"], "general concept", _order(8, x["pos"], 2)))
    return _listed(own, runs("proper", 0, "proper noun"), runs("phrase", 1, "noun phrase"), single)


def tagged_runs(tokens: DataFrame) -> DataFrame:
    """Runs of proper nouns, runs of nouns and adjectives, and single nouns, in the order in which a reader meets their ends."""
    return _made(raw_runs(tokens))


def without_fragments(rows: DataFrame) -> DataFrame:
    """Drops concepts and noun phrases of one or two terms that are part of a relation's answer in the same sentence."""
    own = F.array_distinct(X.terms(F.col("normalized_text")))
    sentence = Window.partitionBy("doc_id", "sentence_index")
    held = X.fixed(rows, _own=own).withColumn("_answers", F.collect_set(F.when(F.col("candidate_type") == "relation phrase", F.col("_own"))).over(sentence))
    inside = F.exists("_answers", lambda a: (F.size(F.array_except("_own", a)) == 0) & (F.size("_own") < F.size(a)))
    fragment = F.col("candidate_type").isin("general concept", "noun phrase") & (F.size("_own") <= 2) & inside
    return held.where(~fragment).select(*CANDIDATE)


def extract(rows: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """All candidates of sentences; tagged ones only with a lexicon."""
    found = _listed(with_subject(rows), *_definitions(), *_patterns(), *_relations())
    if lexicon is not None:
        found = found.unionByName(raw_runs(tagged(rows, lexicon)))
    return without_fragments(_made(found))
