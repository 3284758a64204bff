"""The quiz engine's behaviour on small literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from lectern import config as C
from lectern.functions import text as X
from lectern.operators import assembly, builders, candidates, grading, quality, ranking, segment
from lectern.operators import stems as S
from lectern.plans import quiz
from lectern.sources import corpus
from lectern.streaming import workflow


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_normalisation_keeps_paragraphs(spark):
    assert one(spark, X.normalize_text, "First  has\t gaps\r\nand a line.\r\n \r\n\r\nSecond one\x07.") == "First has gaps and a line.\n\nSecond one."
    assert one(spark, lambda c: X.normalize_text(c, repair=True), "a hyphen-\nated word") == "a hyphenated word"
    codes = [r["error_code"] for r in corpus.gated(texts(spark, "", " \x01", None, "short", "x" * 60), high=59).orderBy("doc_id").collect()]
    assert codes == ["EMPTY_TEXT", "EMPTY_TEXT", "EMPTY_TEXT", "INSUFFICIENT_TEXT", "TOO_LARGE"]


def test_article_is_cut_at_paragraphs_and_closing_sections(spark):
    assert one(spark, lambda c: X.capped_article(c, 80), "A" * 70 + "\n\n" + "B" * 70) == "A" * 70
    assert one(spark, X.capped_article, "Body text.\n\nReferences\nmore") == "Body text."


def test_scalars(spark):
    assert one(spark, X.plain_text, "<b>a</b> &amp; &lt;i&gt;  b") == "a & <i> b"
    assert one(spark, X.plain_text, "caf&eacute; &#233;&#xE9; &notit; &amp;lt; <i>x</i>&nbsp;y") == "café éé ¬it; &lt; x y"
    assert one(spark, X.plain_text, "plain") == "plain" and one(spark, X.plain_text, None) is None
    assert one(spark, X.article_url, "a b/c~*é") == C.ARTICLE_BASE + "a_b/c~%2A%C3%A9"
    assert one(spark, X.normalize_candidate, " The  75% Rule! ") == "the 75% rule"
    assert one(spark, X.normalize_question, "Straße, 5%?") == "strasse 5"
    import uuid

    assert one(spark, lambda c: X.uuid5(C.QUESTION_NAMESPACE, c), "naïve|1") == str(uuid.uuid5(uuid.UUID(C.QUESTION_NAMESPACE), "naïve|1"))
    assert one(spark, X.context_subject, "Deep Sea: notes") == "Deep Sea" and one(spark, X.context_subject, "no subject") is None


def test_sentences_have_provenance(spark):
    rows = segment.sentences(texts(spark, "Ok. ...! This is the first usable sentence.\n\nThis is another usable sentence.")).collect()
    assert [(r["sentence_index"], r["paragraph_index"]) for r in rows] == [(0, 0), (1, 1)]
    docs = spark.createDataFrame([(1, "", [(1, "A sentence on page one."), (2, "A sentence on page two.")])], "doc_id long, text string, pages array<struct<page_number:int,text:string>>")
    assert [r["page_number"] for r in segment.sentences(docs).collect()] == [1, 2]
    with pytest.raises(ValueError):
        segment.sentences(docs, minimum=0)


def test_chunk_budgets():
    assert segment.fill([2, 2, 2, 2], 4, 0) == [(0, 2), (2, 4)]
    assert segment.fill([2, 2, 2, 2], 6, 2) == [(0, 3), (2, 4)]
    assert segment.fill([10], 4, 1) == [(0, 1)] and segment.fill([], 4, 1) == []


def sentences(spark, *rows):
    return spark.createDataFrame([(1, i, t, None, p) for i, (t, p) in enumerate(rows)], "doc_id long, sentence_index int, text string, page_number int, paragraph_index int")


def test_candidates(spark):
    lexicon = spark.createDataFrame([("Albert", "NNP"), ("Einstein", "NNP"), ("energy", "NN"), ("light", "NN"), ("bright", "JJ")], "token string, tag string")
    rows = sentences(spark, ("Photosynthesis is defined as a process.", 0), ("Albert Einstein saw 75 percent on March 15, 1947.", 0), ("A plant converts bright light into chemical energy.", 0))
    found = {(r["text"], r["candidate_type"]) for r in candidates.extract(rows, lexicon).collect()}
    assert {("Photosynthesis", "definition term"), ("Albert Einstein", "proper noun"), ("75 percent", "quantity/percentage"), ("March 15, 1947", "date/year"), ("1947", "date/year"), ("chemical energy", "relation phrase")} <= found
    assert ("energy", "general concept") not in found and ("bright light", "noun phrase") in found


def test_subject_is_inherited_in_its_paragraph_only(spark):
    rows = segment.with_subject(sentences(spark, ("Solar Power: an overview", 0), ("The goal is to heat water.", 0), ("The goal is to wait.", 1)))
    assert [r["subject"] for r in rows.orderBy("sentence_index").collect()] == ["Solar Power", "Solar Power", None]


def test_diversity_prefers_new_paragraphs(spark):
    rows = spark.createDataFrame([(1, "alpha", 0.9, 0, 0), (1, "beta", 0.88, 0, 1), (1, "gamma", 0.84, 1, 2), (2, "beta", 0.88, 0, 1)], "doc_id long, normalized_text string, importance_score double, paragraph_index int, sentence_index int").withColumn("page_number", F.lit(None).cast("int"))
    assert [r["normalized_text"] for r in ranking.diverse(rows, 2).where("doc_id = 1").orderBy("pick").collect()] == ["alpha", "gamma"]


CAND = "doc_id long, text string, normalized_text string, source_sentence string, sentence_index int, paragraph_index int, page_number int, importance_score double, candidate_type string, subject string, relation string, pick int"


def cands(spark, *rows):
    return spark.createDataFrame([(1, t, t.lower(), s, i, 0, None, 0.5, kind, None, None, i + 1) for i, (t, s, kind) in enumerate(rows)], CAND)


def test_builders(spark):
    own = cands(spark, ("Paris", "Paris is the capital city of France today.", "proper noun"), ("Rome", "Rome is a very old city in Italy.", "proper noun"), ("DNA", "DNA helps DNA repair damage in cells.", "definition term"))
    assert [r["prompt"] for r in builders.fill_in(own).orderBy("pick").collect()] == ["________ is the capital city of France today.", "________ is a very old city in Italy."]
    false = builders.false_statements(own).orderBy("pick").collect()
    assert false[0]["prompt"] == "Rome is the capital city of France today." and false[0]["correct_answer"] == "False" and len(false) == 2
    assert [r["boolean_answer"] for r in builders.true_false(own).orderBy("pick").collect()] == [True, False]
    got = builders.shuffled("id", ["a", "b", "c", "d"], 17)
    assert got == builders.shuffled("id", ["a", "b", "c", "d"], 17) and sum(r for _, _, r in got) == 1
    with pytest.raises(ValueError):
        builders.distractors(own, difficulty="Odd")


def test_turns_pass_over_candidates_without_a_false_statement(spark):
    own = cands(spark, *((n, f"{n} is a thing that people know well.", k) for n, k in (("Ab", "date/year"), ("Cd", "relation phrase"), ("Ef", "proper noun"), ("Gh", "proper noun"))))
    got = [(r["normalized_text"], r["boolean_answer"]) for r in builders.true_false(own).orderBy("pick").collect()]
    assert got == [("ab", True), ("ef", False), ("gh", True)]


def test_stems(spark):
    assert S.focused(["a b", "c d e f", "g", "h"], 2, 4) == "a b g h"
    assert S.focused(["a b c"], 0, 2) is None
    own = cands(spark, ("DNA", "DNA helps DNA repair damage in cells.", "definition term"))
    text = own.select(S.prompt(F.col("source_sentence"), F.col("source_sentence"), F.col("text")).alias("p")).first()["p"]
    assert text == "generate question: <hl> DNA <hl> helps DNA repair damage in cells. </s>"
    asked = own.withColumn("context", F.col("source_sentence")).withColumn("error_code", F.lit(None).cast("string"))
    for question, code in (("What repairs damage in cells?", None), ("What does DNA repair here?", "ANSWER_EXPOSED"), ("Too short?", "QUESTION_LENGTH"), ("No question mark here", "INCOMPLETE_QUESTION"), ("What is <hl> this thing?", "PROMPT_ARTIFACT")):
        assert S.generated(asked, lambda p, a, s, q=question: [q] * len(p)).first()["error_code"] == code


def test_quality(spark):
    own = cands(spark, ("Paris", "Paris is the capital city of France today.", "proper noun"))
    good = quality.validated(builders.fill_in(own)).first()
    assert good["is_valid"] and abs(good["quality_score"] - (0.35 + 0.15 + 0.1 + 0.15 + 0.1 + 0.05)) < 1e-9
    bad = builders.fill_in(own).withColumn("prompt", F.lit("________ ________ of")).withColumn("correct_answer", F.lit("Oslo"))
    assert {quality.ERRORS["grounding"], quality.ERRORS["fill_blank"], quality.ERRORS["fill_context"]} <= set(quality.validated(bad).first()["errors"])
    assert quality.alike("What is the capital of France?", ["What is the capital of Franc?"], 0.6)
    assert not quality.alike("What is the capital of France?", ["Who wrote this long novel?"], 0.55)
    twice = quality.validated(builders.fill_in(own).unionByName(builders.fill_in(own)))
    assert quality.deduplicated(twice).count() == 1


def test_quotas_and_arguments():
    assert list(assembly.quota_of(5, ["a", "b", "c"]).values()) == [2, 2, 1] and assembly.quota_of(0, ["a"]) == {}
    with pytest.raises(ValueError):
        assembly.check(13, ["a"])
    with pytest.raises(ValueError):
        assembly.check(3, [])


def test_grading(spark):
    schema = "quiz_id string, question_id string, question_type string, prompt string, correct_answer string, accepted_answer_variants array<string>, boolean_answer boolean, choices array<struct<id:string,text:string,is_correct:boolean>>, source_sentence string"
    q = lambda i, kind, answer, variants, flag=None, choices=None: ("z", i, kind, "p", answer, variants, flag, choices, "s")
    questions = spark.createDataFrame([q("f", "Fill-in-the-Blank", "75 percent", ["75%"]), q("s", "Short Answer", "cellular respiration", []), q("t", "True/False", "False", ["False"], False), q("u", "True/False", "True", ["True"], True), q("m", "Multiple Choice", "A", [], None, [("1", "A", True), ("2", "B", False)]), q("n", "Short Answer", "DNA", [])], schema)
    answers = spark.createDataFrame([("z", "f", " 75   PERCENT! ", None), ("z", "s", "respiration cellular", None), ("z", "t", None, False), ("z", "u", "True", None), ("z", "m", "1", None), ("z", "x", "?", None)], "quiz_id string, question_id string, answer_text string, answer_bool boolean")
    rows = grading.graded(questions, answers)
    assert {r["question_id"]: r["status"] for r in rows.collect()} == {"f": "Correct", "s": "Correct", "t": "Correct", "u": "Incorrect", "m": "Correct", "n": "Unanswered"}
    total = grading.quiz_scores(rows).first()
    assert (total["total"], total["correct"], total["incorrect"], total["unanswered"], total["percentage"]) == (6, 4, 1, 1, 66.67)
    assert [r["question_type"] for r in grading.type_scores(rows).orderBy("type_order").collect()] == list(C.QUESTION_TYPES)
    assert {r["question_id"]: r["your_answer"] for r in grading.review(rows).collect()}["m"] == "A"


def test_workflow(spark):
    events = [(1, k, e, str(k)) for k, e in enumerate(("begin", "submit", "complete", "record", "submit", "record"))] + [(2, 0, "complete", "")]
    got = {r["session_id"]: (r["stage"], r["answers"], r["steps"], r["rejected"]) for r in workflow.fold(spark.createDataFrame(events, "session_id long, seq long, event string, payload string")).collect()}
    assert got == {1: ("REVIEW", "4", 4, 2), 2: ("CREATE", None, 0, 1)}


def test_workflow_stream(spark, tmp_path):
    schema = "session_id long, seq long, event string"
    spark.createDataFrame([(1, 0, "begin"), (1, 1, "complete"), (2, 0, "submit")], schema).write.parquet(str(tmp_path / "in"))
    run = workflow.stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("wf").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {tuple(r) for r in spark.table("wf").collect()} == {(1, "ATTEMPT", 2, 0), (2, "CREATE", 0, 1)}


def test_sources(spark):
    files = spark.createDataFrame([("a", bytearray(b"%PDF-1 x")), ("b", bytearray(b"none")), ("c", bytearray(b"%PDF-1 locked"))], "path string, content binary")

    def parser(content):
        if b"locked" in content:
            raise ValueError("ENCRYPTED_PDF")
        return ["A page of text that is long enough to be of some use here.", ""]

    got = {r["path"]: (r["error_code"], r["page_count"]) for r in corpus.pdf_documents(files, parser).collect()}
    assert got == {"a": (None, 2), "b": ("INVALID_PDF", 0), "c": ("ENCRYPTED_PDF", 0)}
    searches = spark.createDataFrame([("one", '{"query":{"search":[{"pageid":1,"title":"A","snippet":"<i>x</i>"}]}}'), ("two", '{"query":{"search":[{"pageid":1,"title":"A"},{"pageid":2,"title":"B"}]}}'), ("none", '{"query":{"search":[]}}'), ("x", "{}"), ("bad", "[]")], "query string, payload string")
    rows = corpus.search_results(searches)
    assert {r["query"]: r["error_code"] for r in rows.collect()} == {"one": None, "two": None, "none": "NO_RESULTS", "x": "INVALID_TOPIC", "bad": "API"}
    assert {r["query"]: (r["page_id"], r["error_code"]) for r in corpus.unambiguous(rows).collect()} == {"one": (1, None), "two": (None, "AMBIGUOUS")}


def test_quiz_is_whole_deterministic_and_separate_per_document(spark):
    text = "Paris is the capital city of France today. Rome is a very old city in Italy. Berlin is a large city in Germany. Madrid means a lot to people in Spain."
    docs = corpus.documents(texts(spark, text, text.replace("Paris", "Lyon")))
    first = {r["doc_id"]: tuple(r) for r in quiz.quizzes(docs, count=4, seed=99)[0].collect()}
    again = {r["doc_id"]: tuple(r) for r in quiz.quizzes(docs.where("doc_id = 0"), count=4, seed=99)[0].collect()}
    assert first[0] == again[0] and len(first) == 2
    partial = quiz.quizzes(docs, count=12, types=["Multiple Choice"], generator=None)[0].first()
    assert partial["actual_question_count"] == 0 and len(partial["warnings"]) == 2


def test_article_payloads(spark):
    text = "A paragraph of an article that is long enough to be of use to a reader."
    page = lambda **more: {"pageid": 7, "title": "Deep Sea", "extract": text} | more
    cases = {
        "list": ({"query": {"pages": [page()]}}, None),
        "object": ({"query": {"pages": {"7": page(pageprops={"wikibase": "Q1"})}}}, None),
        "two": ({"query": {"pages": [page(), page()]}}, "API"),
        "none": ({"query": {"pages": []}}, "API"),
        "text": ({"query": {"pages": "x"}}, "API"),
        "scalar": ({"query": {"pages": ["x"]}}, "API"),
        "error": ({"error": {"code": 1}}, "API"),
        "missing": ({"query": {"pages": [{"pageid": 7, "missing": True}]}}, "NO_RESULTS"),
        "empty missing": ({"query": {"pages": [{"pageid": 7, "missing": ""}]}}, "NO_RESULTS"),
        "untitled": ({"query": {"pages": [{"extract": text}]}}, "API"),
        "number": ({"query": {"pages": [page(title=5)]}}, "API"),
        "props": ({"query": {"pages": [page(pageprops=[1])]}}, "API"),
        "disambiguation": ({"query": {"pages": [page(pageprops={"disambiguation": ""})]}}, "DISAMBIGUATION"),
        "by title": ({"query": {"pages": [page(title="Sea (disambiguation)")]}}, "DISAMBIGUATION"),
        "short": ({"query": {"pages": [page(extract="Short.")]}}, "NO_TOPIC_TEXT"),
        "broken": (None, "API"),
    }
    rows = spark.createDataFrame([(k, f"  {name} ", "{" if p is None else json.dumps(p)) for k, (name, (p, _)) in enumerate(cases.items())], "page_id long, requested_topic string, payload string")
    found = corpus.articles(corpus.parsed_articles(rows))
    got = {r["doc_id"]: r["error_code"] for r in found.collect()}
    assert [got[k] for k in range(len(cases))] == [code for _, code in cases.values()]
    docs = {r["doc_id"]: r for r in corpus.usable(found).collect()}
    assert set(docs) == {0, 1} and docs[0]["text"] == text
    assert docs[0]["source_metadata"] == {"source_type": "topic", "requested_topic": "list", "source_provider": "Wikipedia", "article_title": "Deep Sea", "article_url": C.ARTICLE_BASE + "Deep_Sea"}


def test_pdf_files_reach_a_quiz(spark):
    page = "Copper is a metal that people use for wires. The term alloy refers to a mix of metals that stay together."
    files = spark.createDataFrame([("file:/a/one.pdf", bytearray(b"%PDF-1 x"))], "path string, content binary")
    docs = corpus.usable(corpus.pdf_documents(files, lambda content: [page, "", page.replace("Copper", "Tin")]))
    row = docs.first()
    assert row["doc_id"] == "file:/a/one.pdf" and row["source_metadata"] == {"source_type": "pdf", "page_count": "3", "filename": "one.pdf"}
    made, questions = quiz.quizzes(docs, count=2, types=("Fill-in-the-Blank", "True/False"))
    assert made.first()["actual_question_count"] == 2 and {r["page_number"] for r in questions.collect()} <= {1, 3}


def test_own_metadata_holds(spark):
    rows = spark.createDataFrame([(1, "text", "x", None, {"source_type": "mine", "k": "v"})], "doc_id long, source_type string, text string, error_code string, source_metadata map<string,string>")
    assert corpus.usable(rows).first()["source_metadata"] == {"source_type": "mine", "k": "v"}


def test_requests_are_made_where_their_rows_are(spark):
    answers = {"1": ({"query": 1}, None), "2": (None, "NETWORK")}
    rows = spark.createDataFrame([("1", {"id": "1"}), ("2", {"id": "2"})], "query string, parameters map<string,string>")
    got = {r["query"]: (r["payload"], r["fetch_error"]) for r in corpus.fetched(rows, "http://x", lambda url, p: answers[p["id"]]).collect()}
    assert got == {"1": ('{"query": 1}', None), "2": (None, "NETWORK")}


def test_the_last_of_repeated_stems_wins(spark):
    rows = spark.createDataFrame([(1, "a", "first", 1), (1, "a", "last", 2), (1, "b", "own", 1)], "doc_id long, normalized_text string, question string, n int")
    assert {r["question"] for r in S.last_of(rows, "n").collect()} == {"last", "own"}


def test_sessions_keep_source_quiz_and_answers(spark):
    empty = {"source_type": None, "text": None, "configuration": None, "seed": None, "quiz_id": None, "question_ids": None, "answers": None}
    said = lambda **a: empty | {"answers": {k: ({"text": v, "flag": None} if isinstance(v, str) else {"text": None, "flag": v}) for k, v in a.items()}}
    begin = empty | {"source_type": "text", "text": "whole", "configuration": {"count": "2"}, "seed": 5}
    complete = empty | {"quiz_id": "quiz", "question_ids": ["q1", "q2"]}
    events = [
        (1, 1, "record", said(q1="early")), (1, 2, "begin", begin), (1, 3, "begin", begin), (1, 4, "complete", complete), (1, 5, "record", said(q1="wrong", other="x")), (1, 6, "submit", said(q1="Copper!", q2=True, other="x")), (1, 7, "record", said(q1="late")),
        (2, 1, "begin", begin), (2, 2, "complete", complete), (2, 3, "record", said(q2=False)), (2, 4, "reset", empty),
        (3, 1, "begin", begin), (3, 2, "complete", complete), (3, 3, "submit", said(q2=False)),
    ]
    frame = spark.createDataFrame(events, f"session_id long, seq long, event string, payload {workflow.PAYLOAD}")
    sessions = workflow.fold_sessions(frame)
    got = {r["session_id"]: r for r in sessions.collect()}
    import hashlib

    one_ = got[1]
    assert (one_["stage"], one_["steps"], one_["rejected"], one_["seed"], one_["configuration"], one_["quiz_id"]) == ("REVIEW", 4, 3, 5, {"count": "2"}, "quiz")
    assert one_["source_identity"] == hashlib.sha256(b"text\0whole").hexdigest()
    assert {k: tuple(v) for k, v in one_["answers"].items()} == {"q1": ("Copper!", None), "q2": (None, True)}
    assert (got[2]["stage"], got[2]["quiz_id"], got[2]["answers"], got[2]["seed"]) == ("CREATE", None, None, None)
    questions = spark.createDataFrame(
        [("quiz", "q1", "Fill-in-the-Blank", "copper", ["copper"], None, None), ("quiz", "q2", "True/False", "True", ["True"], True, None)],
        "quiz_id string, question_id string, question_type string, correct_answer string, accepted_answer_variants array<string>, boolean_answer boolean, choices array<struct<id:string,text:string,is_correct:boolean>>",
    )
    scores = {r["session_id"]: (r["total"], r["correct"], r["incorrect"], r["unanswered"]) for r in workflow.results(sessions, questions).collect()}
    assert scores == {"1": (2, 2, 0, 0), "3": (2, 0, 1, 1)}


def test_extraction_reads_sentences_once_and_sends_no_tokens(spark):
    from lectern.sources import derived

    rows = spark.createDataFrame([(1, 0, "The red ring of Engine March is a common task in 1999.", None, 0)], "doc_id long, sentence_index int, text string, page_number int, paragraph_index int")
    found = candidates.extract(rows, derived.lexicon(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate ") <= 12 and plan.count("Join ") <= 1 and "hashpartitioning(token" not in plan
    runs = {(r.text, r.candidate_type, *r.emit_order) for r in candidates.tagged_runs(candidates.tagged(rows, derived.lexicon(spark))).collect()}
    assert runs == {
        ("Engine March", "proper noun", 8, 6, 0), ("red ring", "noun phrase", 8, 3, 1), ("Engine March", "noun phrase", 8, 6, 1), ("common task", "noun phrase", 8, 10, 1),
        ("ring", "general concept", 8, 2, 2), ("Engine", "general concept", 8, 4, 2), ("March", "general concept", 8, 5, 2), ("task", "general concept", 8, 9, 2),
    }


def test_greedy_choice_counts_each_prompt_once(spark, monkeypatch):
    counted = []
    grams = quality.character_grams
    monkeypatch.setattr(quality, "character_grams", lambda text: counted.append(text) or grams(text))
    rows = [quality_row(f"The {w} of {v} is held in {w}.", w, v) for w in ("ring", "rings", "part", "engine") for v in ("Paris", "London", "the sea")]
    accepted, kept = quality.Accepted(0.5), []
    for row in rows:
        if not accepted.repeats(row):
            accepted.add(row)
            kept.append(row)
    assert len(counted) <= len({r.prompt for r in rows})
    plain: list = []
    for row in rows:
        if not quality.duplicate(row, plain, 0.5):
            plain.append(row)
    assert kept == plain and 1 < len(kept) < len(rows)


def quality_row(prompt, answer, sentence):
    from types import SimpleNamespace

    return SimpleNamespace(prompt=prompt, correct_answer=answer, source_sentence=sentence)


def test_rules_are_made_before_they_are_filtered(spark):
    kinds = {c: "string" for c in ("question_type", "prompt", "correct_answer", "source_sentence", "source")} | {"sentence_index": "int", "page_number": "int", "boolean_answer": "boolean", "candidate_importance": "double"}
    kinds |= {"accepted_answer_variants": "array<string>", "choices": builders.CHOICES}
    rows = spark.createDataFrame([("Short Answer", "Who said  that it was so?", "a ring", "It is a ring of red.", None, 0, None, None, 0.5, ["a ring"], None)], ", ".join(f"{c} {k}" for c, k in kinds.items()))
    judged = quality.validated(rows)
    assert "filter(_errors" in judged._jdf.queryExecution().optimizedPlan().toString()
    assert judged.first()["errors"] == [quality.ERRORS["mismatch"]] and not {"_errors", "_prompt", "_folded"} & {*judged.columns}


def test_tfidf_is_counted_for_whole_documents_at_once(spark):
    """Against weights reckoned one by one; no row is made for each n-gram."""
    import math
    import re
    from collections import Counter

    rows = [(d, i, s, p) for d, i, s, p in (
        (1, 0, "Red rings hold red rings.", "red rings"), (1, 0, "Red rings hold red rings.", "hold"), (1, 1, "A blue ring is not red.", "blue ring"), (1, 1, "A blue ring is not red.", "x-ray"),
        (2, 0, "Red rings hold red rings.", "red rings"), (2, 0, "Red rings hold red rings.", "one two three four five six"), (2, 1, "Ünder Straße 5%", "75 % stra"),
    )]
    frame = spark.createDataFrame(rows, "doc_id long, sentence_index int, source_sentence string, normalized_text string")
    grams = lambda s: Counter(" ".join(w[i : i + n]) for w in [re.findall(r"\w{2,}", s.lower())] for n in range(1, 6) for i in range(len(w) - n + 1))
    want = {}
    for d, i, s, p in rows:
        own = {t: grams(t) for x, _, t, _ in rows if x == d}
        w = {g: tf * (math.log((1 + len(own)) / (1 + sum(g in c for c in own.values()))) + 1) for g, tf in own[s].items()}
        tokens = [t for t in re.findall(r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)?", p)]
        want[d, i, p] = max(w.get(f, 0.0) for f in {" ".join(tokens), *tokens}) / math.sqrt(sum(x * x for x in w.values()))
    made = ranking.tfidf(frame)
    got = {(r["doc_id"], r["sentence_index"], r["normalized_text"]): r["tfidf"] for r in made.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_scores_and_ranks_take_two_exchanges(spark):
    rows = spark.createDataFrame([(1, 0, "red", "Red rings hold red rings.", "noun phrase", "red", [1], 0, None), (1, 0, "red", "Red rings hold red rings.", "proper noun", "Red", [2], 0, None)],
        "doc_id long, sentence_index int, normalized_text string, source_sentence string, candidate_type string, text string, emit_order array<int>, paragraph_index int, page_number int")
    out = ranking.diverse(ranking.rank(rows))
    assert [(r["text"], r["frequency"], r["pick"]) for r in out.collect()] == [("Red", 2, 1)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") <= 2


def test_near_pairs_compare_questions_in_blocks(spark, monkeypatch):
    """Against all pairs reckoned one by one; documents straddle batches, and blocks are small. No row is made for two questions' shared n-grams."""
    import pyarrow as pa

    from lectern.operators import whole

    prompts = {d: [f"The {'red blue green'.split()[(i + d) % 3]} ring {i} of {d} holds {i % 2} units" for i in range(7)] + ["", "a"] for d in (1, 2, 3)}
    frame = spark.createDataFrame([(d, f"q{i}", p) for d, own in prompts.items() for i, p in enumerate(own)], "doc_id long, question_id string, prompt string")
    want = {(d, f"q{i}", f"q{j}") for d, own in prompts.items() for i in range(9) for j in range(i + 1, 9) if _cosine(own, i, j) >= 0.5}
    made = quality.near_pairs(frame, 0.5)
    assert {(r["doc_id"], r["a"], r["b"]) for r in made.collect()} == want and want
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    table = pa.table({"doc_id": [d for d in prompts for _ in range(9)], "words": [p.lower().split() for own in prompts.values() for p in own]})
    usual = list(zip(*(x.tolist() for x in whole.near(table, 0.3)[:2])))
    monkeypatch.setattr(whole, "ROWS", 2)
    monkeypatch.setattr(whole, "COLUMNS", 5)
    assert sorted(zip(*(x.tolist() for x in whole.near(table, 0.3)[:2]))) == sorted(usual)
    for step in (1, 4, 9, 27):
        parts = [t for t in whole.documents(table.to_batches(max_chunksize=step))]
        assert pa.concat_tables(parts).equals(table.combine_chunks()) and all(len(set(t["doc_id"].to_pylist()) & set(u["doc_id"].to_pylist())) == 0 for i, t in enumerate(parts) for u in parts[:i])


def _cosine(prompts, i, j):
    import math
    from collections import Counter

    counts = [quality.character_grams(p) for p in prompts]
    spread = Counter(g for c in counts for g in c)
    w = [{g: tf * (math.log((1 + len(prompts)) / (1 + spread[g])) + 1) for g, tf in c.items()} for c in counts]
    norm = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1.0
    return sum(x * w[j].get(g, 0) for g, x in w[i].items()) / (norm(w[i]) * norm(w[j]))


def test_pairs_of_candidates_are_judged_by_what_is_made_once(spark):
    rows = [(1, t.lower(), t, f"{t} is here.", "proper noun", 0.5, k, 0, None, k) for k, t in enumerate(("Alpha", "Beta", "Gamma"))]
    own = spark.createDataFrame(rows, "doc_id long, normalized_text string, text string, source_sentence string, candidate_type string, importance_score double, sentence_index int, paragraph_index int, page_number int, pick int")
    made = builders.distractors(own, difficulty="Hard")
    assert {(r["normalized_text"], r["distractor"], r["place"]) for r in made.collect()} == {("alpha", "Gamma", 1), ("alpha", "Beta", 2), ("beta", "Alpha", 1), ("beta", "Gamma", 2), ("gamma", "Alpha", 1), ("gamma", "Beta", 2)}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "split(" not in above and "lower(" not in above


def test_stems_need_one_python_step_and_chunks_only_where_documents_are_long(spark):
    docs = texts(spark, "Alpha rings are here now. Beta rings are there now.", " ".join(f"Sentence number {i} has exactly seven words." for i in range(60)))
    rows = segment.sentences(docs)
    plain = {(r["doc_id"], r["chunk_index"]): (r["text"], r["estimated_token_count"]) for r in segment.chunks(rows, size=lambda t: len(t.split())).collect()}
    made = segment.chunks(rows)
    assert {(r["doc_id"], r["chunk_index"]): (r["text"], r["estimated_token_count"]) for r in made.collect()} == plain and len(plain) == 3
    held = spark.createDataFrame([(0, 0, "Alpha", "Alpha rings are here now.", 1), (1, 30, "30", "Sentence number 30 has exactly seven words.", 1)], "doc_id long, sentence_index int, text string, source_sentence string, pick int")
    for budget in (416, 30, 3):
        own = {r["doc_id"]: (r["context"], r["error_code"]) for r in S.contexts(held, made, budget=budget).collect()}
        assert own == {r["doc_id"]: (r["context"], r["error_code"]) for r in S.contexts(held, made, budget=budget, size=lambda t: len(t.split())).collect()}
    plan = S.stems(held, made)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "InPandas" not in plan
    for sentence, answer in (("Red, red; redder RED_ red", "red"), ("a.a.a", "a"), ("aaa aa", "aa"), ("Straße STRASSE", "straße"), ("x", "y"), ("5% of 5%", "5%")):
        import re

        assert S.without(sentence, answer) == re.sub(rf"(?<!\w){re.escape(answer)}(?!\w)", " ", sentence, flags=re.I)


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_statements_are_made_without_sending_a_table_to_the_driver(spark):
    """Tables as small as these would be broadcast if the planner chose; large ones that are well compressed too."""
    rows = [(1, t.lower(), t, f"{t} is here with them now.", "proper noun", 0.5, k, 0, None, k) for k, t in enumerate(("Alpha", "Beta", "Gamma"))]
    own = spark.createDataFrame(rows, "doc_id long, normalized_text string, text string, source_sentence string, candidate_type string, importance_score double, sentence_index int, paragraph_index int, page_number int, pick int")
    made = builders.false_statements(own)
    assert sorted(r["prompt"] for r in made.collect()) == ["Alpha is here with them now."] * 2 + ["Gamma is here with them now."]
    assert "Broadcast" not in plan_of(made) and "SortMergeJoin" in plan_of(made)


def test_answers_are_graded_without_sending_a_table_to_the_driver(spark):
    kinds = "quiz_id string, question_id string, question_type string, correct_answer string, accepted_answer_variants array<string>, boolean_answer boolean, choices array<struct<id:string,text:string,is_correct:boolean>>"
    questions = spark.createDataFrame([("q", "1", "True/False", "True", ["True"], True, None), ("q", "2", "True/False", "True", ["True"], True, None)], kinds)
    answers = spark.createDataFrame([("q", "1", None, True)], "quiz_id string, question_id string, answer_text string, answer_bool boolean")
    made = grading.graded(questions, answers)
    assert {(r["question_id"], r["status"]) for r in made.collect()} == {("1", "Correct"), ("2", "Unanswered")}
    assert "Broadcast" not in plan_of(made) and "SortMergeJoin" in plan_of(made)


def test_stems_and_choices_are_made_without_sending_a_table_to_the_driver(spark):
    rows = [(1, t.lower(), t, f"{t} rings are here.", "proper noun", 0.5, k, 0, None, k + 1) for k, t in enumerate(("Alpha", "Beta", "Gamma", "Delta"))]
    own = spark.createDataFrame(rows, "doc_id long, normalized_text string, text string, source_sentence string, candidate_type string, importance_score double, sentence_index int, paragraph_index int, page_number int, pick int")
    held = segment.chunks(spark.createDataFrame([(1, r[6], r[3], None, 0) for r in rows], "doc_id long, sentence_index int, text string, page_number int, paragraph_index int"))
    asked = S.stems(own, held)
    made = builders.multiple_choice(asked, own)
    left = S.remaining(own, asked.where("normalized_text = 'beta'"))
    assert sorted(r["correct_answer"] for r in made.collect()) == ["Alpha", "Beta", "Delta", "Gamma"] and left.count() == 3
    for table in (asked, made, left):
        assert "Broadcast" not in plan_of(table) and "SortMergeJoin" in plan_of(table)


def test_quizzes_are_assembled_without_sending_a_table_to_the_driver(spark):
    kinds = "doc_id long, pick int, question_id string, question_type string, prompt string, correct_answer string, source_sentence string, page_number int, paragraph_index int, sentence_index int, quality_score double"
    pool = spark.createDataFrame([(1, 1, "a", "True/False", "Alpha is here.", "True", "Alpha is here.", None, 0, 0, 0.9)], kinds)
    docs = spark.createDataFrame([(1, {"k": "v"}), (2, {})], "doc_id long, source_metadata map<string,string>")
    made = assembly.assemble(pool, docs, count=1, types=["True/False"], difficulty="Easy", seed=1)
    assert {r["doc_id"]: r["question_ids"] for r in made.collect()} == {1: ["a"], 2: []}
    rows = [(1, t.lower(), t, f"{t} is here with them now.", "proper noun", 0.5, k, 0, None, k) for k, t in enumerate(("Alpha", "Beta", "Gamma"))]
    own = spark.createDataFrame(rows, "doc_id long, normalized_text string, text string, source_sentence string, candidate_type string, importance_score double, sentence_index int, paragraph_index int, page_number int, pick int")
    turns = builders.true_false(own)
    assert sorted((r["pick"], r["boolean_answer"]) for r in turns.collect()) == [(0, True), (1, False), (2, True)]
    for table in (made, turns):
        assert "Broadcast" not in plan_of(table) and "SortMergeJoin" in plan_of(table)
