"""Distractors and the four question types.

The sides of the joins here grow with the corpus, and written tables are estimated by their compressed files: so they are
merged, and never sent to the driver to be broadcast.
"""

from __future__ import annotations

import random
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as X

QUESTION = [
    "doc_id", "question_id", "question_type", "prompt", "correct_answer", "accepted_answer_variants", "choices", "boolean_answer", "source_sentence", "normalized_text",
    "sentence_index", "paragraph_index", "page_number", "difficulty", "candidate_importance", "source", "model_id", "choice_seed", "statement_truth", "replaced_with", "blank_token",
]
CHOICES = "array<struct<id:string,text:string,is_correct:boolean>>"


def check_difficulty(difficulty: str) -> str:
    if difficulty not in C.DIFFICULTIES:
        raise ValueError(f"difficulty must be one of {C.DIFFICULTIES}.")
    return difficulty


def distractors(candidates: DataFrame, *, difficulty: str, limit: int = 3) -> DataFrame:
    """doc_id, normalized_text, distractor (text), distractor_normalized, place: of each candidate the alternatives of a like type, best first.

    A document's candidates are few once ranked; both sides of the join share one exchange by doc_id.
    """
    check_difficulty(difficulty)
    if limit < 1:
        raise ValueError("limit must be at least 1.")
    # What pairs are judged by is made once for each candidate, not for each pair.
    own = {
        "normalized_text": F.col("normalized_text"), "candidate_type": F.col("candidate_type"), "length": F.length("text"), "folded": X.casefold(F.col("normalized_text")), "bag": X.bag(F.col("source_sentence")),
        "sentence": X.casefold(F.col("source_sentence")), "text": F.col("text"), "shown": X.casefold(F.col("text")), "importance_score": F.col("importance_score"), "sentence_index": F.col("sentence_index"),
    }
    target = candidates.select("doc_id", *(c.alias(f"t_{name}") for name, c in own.items() if name not in ("text", "shown", "importance_score", "sentence_index")))
    other = candidates.select("doc_id", *(c.alias(f"o_{name}") for name, c in own.items() if name != "sentence"))
    like = (F.col("t_candidate_type") == F.col("o_candidate_type")) | (F.col("t_candidate_type").isin(*C.CONCEPT_TYPES) & F.col("o_candidate_type").isin(*C.CONCEPT_TYPES))
    a, b = F.col("t_folded"), F.col("o_folded")
    apart = (F.instr(a, b) == 0) & (F.instr(b, a) == 0)
    unnamed = F.instr(F.col("t_sentence"), F.col("o_shown")) == 0
    near = X.similarity(F.col("t_bag"), F.col("o_bag"))
    plausible = {"Easy": -near, "Medium": near * 0.5, "Hard": near}[difficulty]
    far = F.abs(F.col("t_length") - F.col("o_length"))
    ranks = [F.desc("_plausible"), F.col("_far"), F.desc("o_importance_score"), F.col("o_normalized_text"), F.col("o_sentence_index")]
    eligible = target.join(other.hint("merge"), "doc_id").where(like & apart & unnamed).withColumn("_plausible", plausible).withColumn("_far", far)
    first = Window.partitionBy("doc_id", "t_normalized_text", "o_normalized_text").orderBy(*ranks)
    place = Window.partitionBy("doc_id", "t_normalized_text").orderBy(*ranks)
    unique = eligible.withColumn("_no", F.row_number().over(first)).where("_no = 1")
    out = unique.withColumn("place", F.row_number().over(place)).where(F.col("place") <= limit)
    return out.select("doc_id", F.col("t_normalized_text").alias("normalized_text"), F.col("o_text").alias("distractor"), F.col("o_normalized_text").alias("distractor_normalized"), "place")


def question_id(kind: Column, normal: Column, sentence_index: Column, sentence: Column, prompt: Column) -> Column:
    return X.uuid5(C.QUESTION_NAMESPACE, F.concat_ws("|", kind, normal, sentence_index.cast("string"), sentence, prompt))


def _question(rows: DataFrame, kind: str, difficulty: str, *, truth: Column | None = None, **extra: Column) -> DataFrame:
    """rows has prompt and the candidate's columns."""
    check_difficulty(difficulty)
    text = F.col("text") if truth is None else F.when(truth, "True").otherwise("False")
    accepted = X.variants(F.col("text"), F.col("normalized_text")) if truth is None else F.array(text)
    empty = {"choices": CHOICES, "source": "string", "model_id": "string", "choice_seed": "int", "statement_truth": "boolean", "replaced_with": "string", "blank_token": "string"}
    more = {name: extra.get(name, F.lit(None)).cast(kind_) for name, kind_ in empty.items()}
    named = F.lit(kind)
    kept = [c for c in rows.columns if c not in ("question_type", "question_id", "source", "model_id", "choices", "difficulty")]
    built = rows.select(
        *kept,
        named.alias("question_type"), question_id(named, F.col("normalized_text"), F.col("sentence_index"), F.col("source_sentence"), F.col("prompt")).alias("question_id"),
        text.alias("correct_answer"), accepted.alias("accepted_answer_variants"), (F.lit(None).cast("boolean") if truth is None else truth).alias("boolean_answer"),
        F.lit(difficulty).alias("difficulty"), F.col("importance_score").alias("candidate_importance"), *(v.alias(k) for k, v in more.items()),
    )
    carried = [c for c in ("pick", "rank") if c in rows.columns]
    return built.select(*QUESTION, *carried)


def fill_in(candidates: DataFrame, difficulty: str = "Medium") -> DataFrame:
    """One blank where the candidate occurs exactly once and four words stay around it."""
    parts = X.around(F.col("source_sentence"), F.col("text"))
    rows = X.fixed(candidates, _parts=parts).where(F.size("_parts") == 2)
    rows = rows.where(F.size(X.terms(F.concat(F.get("_parts", F.lit(0)), F.get("_parts", F.lit(1))))) >= 4)
    rows = X.fixed(rows, prompt=F.concat(F.get("_parts", F.lit(0)), F.lit(C.BLANK), F.get("_parts", F.lit(1))))
    rows = rows.where(F.size(F.split("prompt", C.BLANK, -1)) == 2)
    return _question(rows, "Fill-in-the-Blank", difficulty, source=F.lit("deterministic"), blank_token=F.lit(C.BLANK))


def true_statements(candidates: DataFrame, difficulty: str = "Medium") -> DataFrame:
    rows = candidates.where((F.size(X.around(F.col("source_sentence"), F.col("text"))) == 2) & (X.collapse(F.col("source_sentence")) != ""))
    return _question(rows.withColumn("prompt", F.col("source_sentence")), "True/False", difficulty, truth=F.lit(True), source=F.lit("original statement"), statement_truth=F.lit(True))


def false_statements(candidates: DataFrame, difficulty: str = "Medium") -> DataFrame:
    """The best distractor in the candidate's place."""
    best = distractors(candidates, difficulty=difficulty, limit=1).select("doc_id", "normalized_text", F.col("distractor").alias("_best"))
    parts = X.around(F.col("source_sentence"), F.col("text"))
    rows = X.fixed(candidates.join(best.hint("merge"), ["doc_id", "normalized_text"]), _parts=parts).where((F.size("_parts") == 2) & (X.collapse(F.col("source_sentence")) != ""))
    rows = X.fixed(rows, prompt=F.concat(F.get("_parts", F.lit(0)), F.col("_best"), F.get("_parts", F.lit(1))))
    rows = rows.where(X.normalize_candidate(F.col("prompt")) != X.normalize_candidate(F.col("source_sentence")))
    return _question(rows, "True/False", difficulty, truth=F.lit(False), source=F.lit("controlled replacement"), statement_truth=F.lit(False), replaced_with=F.col("_best"))


def short_answer(stems: DataFrame, difficulty: str = "Medium") -> DataFrame:
    """stems: candidates with question, model_id and error_code (null: the stem is good). Some relations have a prompt of their own."""
    relation, subject = F.col("relation"), F.col("subject")
    # Prompts of relations.
    own = (
        F.when(relation == "common task", F.concat(F.lit("What is a common task of "), subject, F.lit("?")))
        .when(relation == "stores", F.concat(F.lit("What does "), subject, F.lit(" store?")))
        .when(relation == "converts", F.concat(F.lit("What does "), subject, F.lit(" convert energy into?")))
        .when(relation == "are", F.concat(F.lit("What are "), subject, F.lit(" used to treat?")))
    )
    own = F.when(subject != "", own)
    prompt = F.coalesce(own, F.when(F.col("error_code").isNull(), F.col("question")))
    rows = stems.withColumn("prompt", prompt).where(F.col("prompt").isNotNull())
    return _question(rows, "Short Answer", difficulty, source=F.lit("t5"), model_id=F.col("model_id"))


def shuffled(question: str, texts: list[str], seed: int) -> list[tuple[str, str, bool]]:
    """Choices (id, text, is_correct); the first text is the correct one before they are shuffled."""
    order = [(text, i == 0) for i, text in enumerate(texts)]
    random.Random(f"{seed}:{question}").shuffle(order)
    space = uuid.UUID(C.QUESTION_NAMESPACE)
    return [(str(uuid.uuid5(space, f"{question}|{text.casefold()}")), text, right) for text, right in order]


def multiple_choice(stems: DataFrame, candidates: DataFrame, difficulty: str = "Medium", seed: int = C.CHOICE_SEED) -> DataFrame:
    """Four choices where a good stem and three distractors exist. Only the shuffle, whose order is Python's own, leaves the JVM."""
    three = distractors(candidates, difficulty=difficulty, limit=3).groupBy("doc_id", "normalized_text").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "distractor"))), lambda d: d["distractor"]).alias("_others")).where(F.size("_others") == 3)
    rows = stems.where(F.col("error_code").isNull()).withColumn("prompt", F.col("question")).join(three.hint("merge"), ["doc_id", "normalized_text"])
    texts = F.concat(F.array("text"), F.col("_others"))
    rows = rows.withColumn("_texts", texts).where(F.size(F.array_distinct(F.transform("_texts", X.normalize_candidate))) == 4)
    key = question_id(F.lit("Multiple Choice"), F.col("normalized_text"), F.col("sentence_index"), F.col("source_sentence"), F.col("prompt"))

    @F.pandas_udf(CHOICES)
    def choose(ids: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([[{"id": i, "text": t, "is_correct": r} for i, t, r in shuffled(q, list(own), seed)] for q, own in zip(ids, lists)])

    rows = rows.withColumn("_choices", choose(key, F.col("_texts")))
    return _question(rows, "Multiple Choice", difficulty, source=F.lit("t5"), model_id=F.col("model_id"), choice_seed=F.lit(seed), choices=F.col("_choices"))


def alternated(true_ones: DataFrame, false_ones: DataFrame, place: str) -> DataFrame:
    """One True/False question of each candidate at most, by turns: a false statement follows a true one, a true one everything else.

    While it is a true statement's turn, a candidate without one is tried as a false one; in a false statement's turn a
    candidate without one is passed over. The turn is a running state, folded over a document's few candidates.
    """
    marks = true_ones.select("doc_id", place, "normalized_text", F.lit(True).alias("t")).unionByName(false_ones.select("doc_id", place, "normalized_text", F.lit(False).alias("t")))
    each = marks.groupBy("doc_id", place, "normalized_text").agg(F.bool_or("t").alias("can_t"), F.bool_or(~F.col("t")).alias("can_f"))
    listed = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(place, "normalized_text", "can_t", "can_f"))).alias("each"))
    start = F.struct(F.lit(False).alias("turn"), F.array().cast("array<struct<normalized_text:string,truth:boolean>>").alias("made"))

    def step(state: Column, x: Column) -> Column:
        truth = F.when(~state["turn"] & x["can_t"], F.lit(True)).when(x["can_f"], F.lit(False))
        made = F.when(truth.isNull(), state["made"]).otherwise(F.concat(state["made"], F.array(F.struct(x["normalized_text"].alias("normalized_text"), truth.alias("truth")))))
        return F.struct(F.coalesce(truth, state["turn"]).alias("turn"), made.alias("made"))

    chosen = listed.select("doc_id", F.inline(F.aggregate("each", start, step, lambda s: s["made"]))).withColumnRenamed("truth", "boolean_answer")
    return true_ones.unionByName(false_ones).join(chosen.hint("merge"), ["doc_id", "normalized_text", "boolean_answer"])


def true_false(candidates: DataFrame, difficulty: str = "Medium", place: str = "pick") -> DataFrame:
    return alternated(true_statements(candidates, difficulty), false_statements(candidates, difficulty), place)


def preview(questions: DataFrame, place: str = "pick", per_type: int = 1) -> DataFrame:
    """The first questions of each type in a document."""
    if per_type < 1:
        raise ValueError("per_type_limit must be at least 1.")
    order = Window.partitionBy("doc_id", "question_type").orderBy(place)
    return questions.withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= per_type).drop("_no")

