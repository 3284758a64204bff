"""Text functions: each takes Columns and returns a Column of built-in functions.

Word characters are letters, numbers and the underscore of any alphabet; white space is that of Unicode. Java's own
classes are narrower, so both are spelt out.
"""

from __future__ import annotations

from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x85\p{Z}"


def strip(text: Column, chars: str = SPACE) -> Column:
    return F.regexp_replace(text, f"^[{chars}]+|[{chars}]+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def terms(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(collapse(text), " "), lambda w: w != "")


def paragraphs_of(text: Column) -> Column:
    """Non-empty paragraphs (between blank lines), their lines joined by blanks."""
    lines = lambda p: F.filter(F.transform(F.split(p, "\n"), lambda x: strip(F.regexp_replace(x, "[ \t]+", " "))), lambda x: x != "")
    return F.filter(F.transform(F.split(text, rf"\n[{SPACE}]*\n+"), lambda p: F.array_join(lines(p), " ")), lambda p: p != "")


def cleaned(text: Column, repair: bool = False) -> Column:
    """Line ends, hard blanks and control characters set right; words cut at a line's end joined if asked."""
    text = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), " ", " ")
    text = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.regexp_replace(text, "(?<=[A-Za-z])-\n(?=[a-z])", "") if repair else text


def normalize_text(text: Column, repair: bool = False) -> Column:
    return F.array_join(paragraphs_of(cleaned(text, repair)), "\n\n")


def ingest_code(normal: Column, low: int = C.MIN_TEXT, high: int = C.MAX_TEXT) -> Column:
    """error_code of a normalised text, null if it passes."""
    n = F.length(normal)
    return F.when(normal.isNull() | (n == 0), "EMPTY_TEXT").when(n < low, "INSUFFICIENT_TEXT").when(n > high, "TOO_LARGE")


def topic_code(query: Column) -> Column:
    return F.when(F.length(collapse(query)) < C.MIN_TOPIC, "INVALID_TOPIC")


# Headings that end an article.
TRAILING = "references|notes|bibliography|further reading|external links|see also"


def capped_article(extract: Column, cap: int = C.MAX_TEXT) -> Column:
    """The leading whole paragraphs before a closing section that fit the cap; the first that doesn't ends it."""
    body = F.get(F.split(extract, rf"(?im)^\s*({TRAILING})\s*$", 2), F.lit(0))
    parts = paragraphs_of(cleaned(body, repair=True))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def add(state: Column, p: Column) -> Column:
        n = state["n"] + F.length(p) + F.when(F.size(state["kept"]) > 0, 2).otherwise(0)
        fits = ~state["full"] & (n <= cap)
        return F.struct(F.when(fits, F.concat(state["kept"], F.array(p))).otherwise(state["kept"]).alias("kept"), F.when(fits, n).otherwise(state["n"]).alias("n"), (~fits).alias("full"))

    return F.array_join(F.aggregate(parts, start, add, lambda s: s["kept"]), "\n\n")


@F.arrow_udf(T.StringType())
def _unescaped(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unescape(t) for t in texts.to_pylist()], pa.string())


def plain_text(html: Column) -> Column:
    """Tags go, then entities are read, named and numeric ones by HTML's own rules, then white space collapses. Only texts that hold an ampersand leave the JVM."""
    text = F.regexp_replace(html, "<[^>]+>", "")
    some = F.contains(text, F.lit("&"))
    return collapse(F.when(some, _unescaped(F.when(some, text))).otherwise(text))


def article_url(title: Column) -> Column:
    quoted = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        quoted = F.replace(quoted, F.lit(a), F.lit(b))
    return F.concat(F.lit(C.ARTICLE_BASE), quoted)


def normalize_candidate(text: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(text), f"[^{WORD}{SPACE}%]+", " "))


def casefold(text: Column) -> Column:
    """Lower case, and the one common letter whose folded form differs."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalize_question(text: Column) -> Column:
    return collapse(F.regexp_replace(casefold(text), f"[^{WORD}{SPACE}]+", " "))


normalize_answer = normalize_question


def candidate_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)?|%"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(terms(text))


def split_count(text: Column) -> Column:
    """How many parts Python's split() makes."""
    return F.size(F.regexp_extract_all(text, F.lit(rf"[^{SPACE}\x1c-\x1f]+"), F.lit(0)))


def fixed(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that later filters read, made once: a filter is not moved below the row that a generator makes."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def context_subject(sentence: Column) -> Column:
    """A heading before a colon, else a leading subject."""
    heading = F.regexp_extract(sentence, r"^\s*([A-Z][A-Za-z0-9 -]{1,50}):", 1)
    leading = F.regexp_extract(sentence, r"^\s*([A-Z][A-Za-z0-9 -]{1,50}?)\s+(?:is|are|uses|converts|stores)", 1)
    return F.coalesce(F.nullif(F.trim(heading), F.lit("")), F.nullif(F.trim(leading), F.lit("")))


def generic_framing(sentence: Column) -> Column:
    return sentence.rlike(r"(?i)^\s*(?:a|an|the|one)\s+(?:common task|goal|purpose|example|use|benefit|function)(?![\p{L}\p{N}_])")


def bag(text: Column) -> Column:
    """The set of folded words without marks at their ends."""
    return F.array_distinct(F.filter(F.transform(terms(casefold(text)), lambda w: F.regexp_replace(w, "^[.,;:!?]+|[.,;:!?]+$", "")), lambda w: w != ""))


def similarity(x: Column, y: Column) -> Column:
    """Jaccard of two bags; 0 if either is empty."""
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), both / F.greatest(F.size(x) + F.size(y) - both, F.lit(1))).otherwise(0.0)


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5) of a text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    at = lambda i, n: F.substring(digest, i, n)
    variant = F.lower(F.hex(F.conv(at(17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat(at(1, 8), F.lit("-"), at(9, 4), F.lit("-5"), at(14, 3), F.lit("-"), variant, at(19, 2), F.lit("-"), at(21, 12))


def source_identity(source_type: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.encode(source_type, "UTF-8"), F.unhex(F.lit("00")), F.encode(text, "UTF-8")), 256)


def standalone(candidate: Column) -> Column:
    """A pattern for the literal candidate where no word character adjoins it."""
    literal = F.replace(candidate, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit(f"(?iu)(?<![{WORD}])\\Q"), literal, F.lit(f"\\E(?![{WORD}])"))


def around(sentence: Column, candidate: Column) -> Column:
    """What stands between the candidate's occurrences: two parts where there is exactly one."""
    return F.split(sentence, standalone(candidate), -1)


def occurs(sentence: Column, candidate: Column) -> Column:
    return F.regexp_like(sentence, standalone(candidate))


def variants(text: Column, normal: Column) -> Column:
    return F.array_distinct(F.array(text, normal))


def preview(prompt: Column) -> Column:
    return F.when(F.length(prompt) <= 72, prompt).otherwise(F.concat(F.substring(prompt, 1, 69), F.lit("…")))


def result_label(title: Column, description: Column) -> Column:
    return F.when(F.length(description) > 0, F.concat(title, F.lit(" — "), description)).otherwise(title)
