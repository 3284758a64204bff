"""The registry of the engine's own queries: each takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import config as C
from .functions import text as X
from .operators import assembly, builders, candidates, grading, quality, ranking, segment
from .operators import stems as S
from .plans import quiz
from .plans.staging import staged
from .sources import corpus, derived
from .streaming import workflow

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return segment.sentences(_docs(spark, d))


def _fact_sentences(spark: SparkSession, d: str) -> DataFrame:
    return staged(segment.sentences(derived.facts(spark, d)))


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    return staged(candidates.extract(_fact_sentences(spark, d), derived.lexicon(spark)))


def _picked(spark: SparkSession, d: str) -> DataFrame:
    return staged(ranking.diverse(ranking.rank(_extracted(spark, d))))


def _worked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sentences, picked candidates and stems of the facts, each made once."""
    rows = _fact_sentences(spark, d)
    picked = staged(ranking.diverse(ranking.rank(staged(candidates.extract(rows, derived.lexicon(spark))))))
    return rows, picked, staged(S.stems(picked, segment.chunks(rows)))


# --- text ------------------------------------------------------------------------------------------------------------


@query
def fill_blank_definitions(spark, d):
    """Fill-in questions from the terms that documents define."""
    found = candidates.definitions(_sentences(spark, d)).withColumn("importance_score", F.lit(0.0))
    return builders.fill_in(found).select("doc_id", "sentence_index", "question_id", "prompt", "correct_answer")


@query
def normalize_text(spark, d):
    return derived.paragraphs(spark, d).select("doc_id", X.normalize_text(F.col("text"), repair=True).alias("text"))


@query
def ingest_gate(spark, d):
    return corpus.gated(_docs(spark, d), high=20_000).select("doc_id", "character_count", "error_code")


@query
def plain_text_html(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", X.plain_text(F.col("html")).alias("text"))


@query
def article_cap(spark, d):
    closed = F.concat(F.col("text"), F.lit("\n\nSee also\nnothing to read here"))
    return derived.paragraphs(spark, d).select("doc_id", X.capped_article(closed, 2000).alias("text"))


@query
def article_urls(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", X.article_url(F.concat_ws("/", "p_name", F.lit("a*~(é)"), "p_brand")).alias("url"))


@query
def normalize_candidate(spark, d):
    return _sentences(spark, d).select("doc_id", "sentence_index", X.normalize_candidate(F.col("text")).alias("normalized"))


@query
def normalize_question_text(spark, d):
    return _sentences(spark, d).select("doc_id", "sentence_index", X.normalize_question(F.col("text")).alias("normalized"))


@query
def source_identity(spark, d):
    return _docs(spark, d).select("doc_id", X.source_identity(F.lit("text"), F.coalesce("text", F.lit(""))).alias("identity"))


# --- segments --------------------------------------------------------------------------------------------------------


@query
def sentences(spark, d):
    return _sentences(spark, d)


@query
def paragraph_sentences(spark, d):
    """Sentences of texts with many paragraphs."""
    return segment.sentences(derived.paragraphs(spark, d))


@query
def paged_sentences(spark, d):
    """Sentences of conversations, each turn a page."""
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    pages = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: F.struct(t["turn"].cast("int").alias("page_number"), t["text"].alias("text")))
    docs = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(pages.alias("pages")).withColumn("text", F.lit(""))
    return segment.sentences(docs)


@query
def context_subject(spark, d):
    rows = segment.with_subject(_fact_sentences(spark, d).unionByName(_sentences(spark, d)))
    return rows.select("doc_id", "sentence_index", "subject")


@query
def chunks(spark, d):
    rows = segment.chunks(_sentences(spark, d), target=120, overlap=20)
    return rows.select("doc_id", "chunk_index", "text", F.size("sentences").alias("n_sentences"), "estimated_token_count")


# --- candidates ------------------------------------------------------------------------------------------------------

_SHOWN = ["doc_id", "sentence_index", "text", "normalized_text", "candidate_type"]


@query
def definition_candidates(spark, d):
    return candidates.definitions(_sentences(spark, d)).select(*_SHOWN)


@query
def pattern_candidates(spark, d):
    return candidates.patterns(_fact_sentences(spark, d).unionByName(_sentences(spark, d))).select(*_SHOWN)


@query
def relation_candidates(spark, d):
    rows = segment.with_subject(_fact_sentences(spark, d))
    return candidates.relations(rows).select(*_SHOWN, "subject", "relation")


@query
def pos_candidates(spark, d):
    return candidates.tagged_runs(candidates.tagged(_fact_sentences(spark, d), derived.lexicon(spark))).select(*_SHOWN)


@query
def relation_fragment_antijoin(spark, d):
    return _extracted(spark, d).select(*_SHOWN)


@query
def candidate_frequency(spark, d):
    return ranking.frequency(_extracted(spark, d))


@query
def tfidf_scores(spark, d):
    rows = ranking.tfidf(_extracted(spark, d))
    return rows.select("doc_id", "sentence_index", "normalized_text", F.bround("tfidf", 6).alias("tfidf"))


@query
def dedup_candidates(spark, d):
    return ranking.deduplicated(ranking.scored(_extracted(spark, d))).select(*_SHOWN, "frequency", "importance_score")


@query
def rank_candidates(spark, d):
    return ranking.rank(_extracted(spark, d)).select(*_SHOWN, "importance_score", "rank")


@query
def diverse_candidates(spark, d):
    return _picked(spark, d).select(*_SHOWN, "importance_score", "pick")


# --- questions -------------------------------------------------------------------------------------------------------


def _distractors(spark, d, difficulty):
    return builders.distractors(_picked(spark, d), difficulty=difficulty)


@query
def distractors_easy(spark, d):
    return _distractors(spark, d, "Easy")


@query
def distractors_medium(spark, d):
    return _distractors(spark, d, "Medium")


@query
def distractors_hard(spark, d):
    return _distractors(spark, d, "Hard")


@query
def fill_in_questions(spark, d):
    return builders.fill_in(_picked(spark, d)).select("doc_id", "question_id", "prompt", "correct_answer")


@query
def true_statements(spark, d):
    return builders.true_statements(_picked(spark, d)).select("doc_id", "question_id", "prompt", "correct_answer")


@query
def false_statements(spark, d):
    return builders.false_statements(_picked(spark, d)).select("doc_id", "question_id", "prompt", "correct_answer", "replaced_with")


@query
def true_false_questions(spark, d):
    """By turns, per document."""
    return builders.true_false(_picked(spark, d)).select("doc_id", "question_id", "prompt", "boolean_answer", "pick")


@query
def focused_context(spark, d):
    rows = _fact_sentences(spark, d)
    picked = staged(ranking.diverse(ranking.rank(staged(candidates.extract(rows, derived.lexicon(spark))))))
    return S.contexts(picked, segment.chunks(rows, target=40, overlap=12), budget=24).select("doc_id", "normalized_text", "context", "error_code")


@query
def prompt_highlight(spark, d):
    return _picked(spark, d).select("doc_id", "normalized_text", S.prompt(F.col("source_sentence"), F.col("source_sentence"), F.col("text")).alias("prompt"))


@query
def stems_template(spark, d):
    return _worked(spark, d)[2].select("doc_id", "normalized_text", "question", "model_id")


@query
def stems_antijoin(spark, d):
    picked = _picked(spark, d)
    done = picked.where("candidate_type IN ('date/year', 'proper noun')")
    return S.remaining(picked, done).select("doc_id", "normalized_text")


@query
def short_answer_questions(spark, d):
    return builders.short_answer(_worked(spark, d)[2]).select("doc_id", "question_id", "prompt", "correct_answer")


def _by_text(choices):
    """Choices in the order of their texts, which SQL can say; their own order is Python's shuffle."""
    ordered = F.array_sort(F.transform(choices, lambda c: F.struct(c["text"].alias("text"), c["id"].alias("id"), c["is_correct"].alias("is_correct"))))
    return F.transform(ordered, lambda c: F.struct(c["id"].alias("id"), c["text"].alias("text"), c["is_correct"].alias("is_correct")))


@query
def multiple_choice_questions(spark, d):
    _, picked, stems = _worked(spark, d)
    shown = F.transform(_by_text(F.col("choices")), lambda c: F.concat_ws("=", c["id"], c["text"], c["is_correct"].cast("string")))
    return builders.multiple_choice(stems, picked).select("doc_id", "question_id", "prompt", F.array_join(shown, "|").alias("choices"))


def _stem_questions(spark, d):
    """Multiple Choice and Short Answer questions, most of them damaged in one way or another: by way, a number from 0 to 7."""
    _, picked, stems = _worked(spark, d)
    columns = [*builders.QUESTION, "pick"]
    both = builders.multiple_choice(stems, picked).select(*columns).unionByName(builders.short_answer(stems).select(*columns))
    rows = staged(both.withColumn("choices", _by_text(F.col("choices"))).withColumn("way", (F.col("pick") + F.col("sentence_index")) % 8))
    way, mc, answer, accepted = F.col("way"), F.col("question_type") == "Multiple Choice", F.col("correct_answer"), F.col("accepted_answer_variants")
    choice = lambda c, text=None, right=None: F.struct(c["id"].alias("id"), (c["text"] if text is None else text).alias("text"), (c["is_correct"] if right is None else right).alias("is_correct"))
    first = F.get("choices", F.lit(0))["text"]
    choices = (
        F.when(way == 1, F.slice("choices", 1, 3))
        .when(way == 2, F.transform("choices", lambda c, i: choice(c, F.when(i == 0, " ").otherwise(c["text"]))))
        .when(way == 3, F.transform("choices", lambda c, i: choice(c, F.when(i == 1, first).otherwise(c["text"]))))
        .when(way == 4, F.transform("choices", lambda c: choice(c, right=F.lit(True))))
        .when(way == 5, F.filter("choices", lambda c: ~c["is_correct"]))
        .when(way == 6, F.transform("choices", lambda c: choice(c, F.when(c["is_correct"], c["text"]).otherwise(F.concat(answer, F.lit(" too"))))))
        .otherwise(F.col("choices"))
    )
    prompt = (
        F.when(way == 1, F.concat("prompt", F.lit(".")))
        .when(way == 4, F.concat(F.lit("Is this about "), answer, F.lit("?")))
        .when(way == 5, F.col("source_sentence"))
        .when(way == 6, F.when(F.col("pick") % 2 == 0, "Who said that it was so?").otherwise("How many were there, and what task had they?"))
        .otherwise(F.col("prompt"))
    )
    other = F.when(way == 2, F.array().cast("array<string>")).when(way == 3, F.array(F.lit("something else"), answer)).otherwise(accepted)
    return rows.select("*").withColumns({"choices": F.when(mc, choices), "prompt": F.when(mc, F.col("prompt")).otherwise(prompt), "accepted_answer_variants": F.when(mc, accepted).otherwise(other)})


@query
def validate_stem_questions(spark, d):
    return quality.validated(_stem_questions(spark, d)).select("doc_id", "question_id", "question_type", F.array_join("errors", "|").alias("errors"), "quality_score")


def _graded_stems(spark, d):
    """Answers to sound and damaged questions: right, wrong, unknown, blank and missing choices; right, shouted, longer, blank, missing and wrong texts."""
    questions = staged(_stem_questions(spark, d).withColumn("quiz_id", F.concat(F.lit("quiz-"), F.col("doc_id").cast("string"))))
    turn, answer = (F.col("pick") + 2 * F.col("sentence_index")) % 7, F.col("correct_answer")
    pick = lambda right: F.get(F.filter("choices", lambda c: c["is_correct"] == F.lit(right)), F.lit(0))["id"]
    chosen = F.when(turn == 0, pick(True)).when(turn == 1, pick(False)).when(turn == 2, "no such choice").when(turn == 3, " ").when(turn == 5, answer).when(turn == 6, pick(True))
    said = F.when(turn == 0, answer).when(turn == 1, F.concat(F.upper(answer), F.lit("! "))).when(turn == 2, F.concat(answer, F.lit(" indeed"))).when(turn == 3, " ").when(turn == 5, "something else").when(turn == 6, F.concat(F.lit("so, "), answer, F.lit(" of course")))
    text = F.when(F.col("question_type") == "Multiple Choice", chosen).otherwise(said)
    answers = questions.select("quiz_id", "question_id", text.alias("answer_text"), F.lit(None).cast("boolean").alias("answer_bool")).where(F.col("answer_text").isNotNull())
    return grading.graded(questions, answers)


@query
def score_stem_answers(spark, d):
    return grading.review(_graded_stems(spark, d)).drop("source_sentence")


@query
def preview_questions(spark, d):
    picked = _picked(spark, d)
    both = builders.fill_in(picked).unionByName(builders.true_false(picked))
    return builders.preview(both, per_type=2).select("doc_id", "question_id", "question_type", "prompt")


def _questions(spark, d):
    picked = _picked(spark, d)
    columns = [*builders.QUESTION, "pick"]
    parts = [builders.fill_in(picked), builders.true_statements(picked), builders.false_statements(picked)]
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns))
    return staged(out)


@query
def validate_questions(spark, d):
    return quality.validated(_questions(spark, d)).select("doc_id", "question_id", F.array_join("errors", "|").alias("errors"), "is_valid")


@query
def quality_score(spark, d):
    return quality.validated(_questions(spark, d)).select("doc_id", "question_id", "quality_score")


@query
def exact_duplicates(spark, d):
    return quality.exact_duplicates(quality.validated(_questions(spark, d))).select("doc_id", "question_id", "same_prompt", "same_fact")


@query
def near_duplicate_pairs(spark, d):
    return quality.near_pairs(_questions(spark, d), 0.5)


@query
def dedup_greedy(spark, d):
    return quality.deduplicated(quality.validated(_questions(spark, d))).select("doc_id", "question_id", "quality_score", "place")


# --- quizzes ---------------------------------------------------------------------------------------------------------


@query
def quotas(spark, d):
    """Quotas of all sizes of quizzes over all orders of types."""
    kinds = F.array(*map(F.lit, C.QUESTION_TYPES))
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("request_id"), (F.col("o_orderkey") % 12 + 1).cast("int").alias("n"), F.slice(kinds, F.lit(1), (F.col("o_custkey") % 4 + 1).cast("int")).alias("types"))
    return assembly.quotas(orders)


def _quiz(spark, d):
    return quiz.quizzes(corpus.documents(derived.facts(spark, d)), lexicon=derived.lexicon(spark))


@query
def quizzes(spark, d):
    return _quiz(spark, d)[0].drop("source_metadata")


def _attempts(spark, d):
    """(questions of one quiz for each document, answers made from them: right, shouted, wrong, missing, of the wrong kind)."""
    order = Window.partitionBy("doc_id").orderBy("question_id")
    questions = _questions(spark, d).withColumn("quiz_id", F.concat(F.lit("quiz-"), F.col("doc_id").cast("string"))).withColumn("no", F.row_number().over(order))
    way = F.col("no") % 6
    flagged = F.col("question_type") == "True/False"
    text = F.when(way == 0, F.col("correct_answer")).when(way == 1, F.concat(F.lit("  "), F.upper("correct_answer"), F.lit("! "))).when(way == 2, F.lit("something else")).when(way == 3, F.lit(" ")).when(way == 5, F.lit("True"))
    flag = F.when(way.isin(0, 1), F.col("boolean_answer")).when(way == 2, ~F.col("boolean_answer"))
    answers = questions.select("quiz_id", "question_id", F.when(~flagged | way.isin(3, 5), text).alias("answer_text"), F.when(flagged, flag).alias("answer_bool"))
    return questions, answers.where(F.col("answer_text").isNotNull() | F.col("answer_bool").isNotNull())


@query
def score_answers(spark, d):
    return grading.graded(*_attempts(spark, d)).select("quiz_id", "question_id", "is_correct", "status", "normalized_user_answer")


@query
def score_quiz(spark, d):
    return grading.quiz_scores(grading.graded(*_attempts(spark, d)))


@query
def score_by_type(spark, d):
    return grading.type_scores(grading.graded(*_attempts(spark, d)))


@query
def review(spark, d):
    return grading.review(grading.graded(*_attempts(spark, d)))


# --- states and connectors -------------------------------------------------------------------------------------------


@query
def workflow_fold(spark, d):
    return workflow.fold(derived.workflow_events(spark, d))


@query
def topic_fold(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    n = F.col("event_id") % 5
    kind = F.get(F.array(*map(F.lit, ("query", "results", "select", "document", "select"))), n.cast("int"))
    user = F.col("user_id").cast("string")
    payload = F.when(n == 0, F.concat(F.lit(" topic  "), user)).when(n == 1, F.concat(F.lit("topic "), user, F.lit("\t1,2,"), user)).when(n == 3, F.concat(F.lit("topic\t"), user)).otherwise(F.lit("2"))
    return workflow.fold_topics(rows.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), kind.alias("event"), payload.alias("payload"))).select("session_id", "query", F.array_join("page_ids", ",").alias("page_ids"), "selected", "document", "rejected")


@query
def topic_search_json(spark, d):
    """Recorded search payloads, one for each page."""
    rows = spark.read.parquet(f"{d}/pages.parquet")
    hit = lambda i: F.struct((F.col("page_id") + i).alias("pageid"), F.concat(F.lit("Page "), (F.col("page_id") + i).cast("string")).alias("title"), F.lit("<b>about</b> this &amp; that").alias("snippet"))
    hits = F.when(F.col("page_id") % 3 == 0, F.array(hit(0))).when(F.col("page_id") % 3 == 1, F.array(hit(0), hit(1))).otherwise(F.array(hit(0), hit(1), hit(2), hit(3), hit(4), hit(5)))
    payload = F.to_json(F.struct(F.struct(hits.alias("search")).alias("query")))
    return corpus.search_results(rows.select(F.col("url").alias("query"), payload.alias("payload")))


@query
def pdf_gate(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.encode(F.concat(F.when(F.col("doc_id") % 2 == 0, "%PDF-1.7\n").otherwise(""), F.coalesce("text", F.lit(""))), "UTF-8").alias("content"))
    return corpus.pdf_gate(rows).select("path", "error_code")
