"""DuckDB SQL for the queries that fold, that ask by stems, or that hold questions of choices and short answers.

What the engine decides by Python's own means is left out: whether a stem is too similar to its sentence by `difflib`
(the equality of results says that the template's stems never are), and the shuffled order of choices.
"""

from __future__ import annotations

from . import config as C
from .oracle import _A, _P, _RULES, _SN, _STEPS, _W, ERRORS, _distractors, _id, chain, fold, n_candidate, n_question, occurs, parts, plain, q, step, terms, uuid5

# By turns: a false statement follows a true one.
_KEPT = "doc_id, pick, normalized_text, boolean_answer"
step("marks", "trues falses", f"SELECT doc_id, pick, normalized_text, bool_or(boolean_answer) AS can_t, bool_or(NOT boolean_answer) AS can_f, row_number() OVER (PARTITION BY doc_id ORDER BY pick, encode(normalized_text)) AS i FROM (SELECT {_KEPT} FROM trues UNION ALL SELECT {_KEPT} FROM falses) GROUP BY doc_id, pick, normalized_text")
_TRUTH = "CASE WHEN NOT turn AND can_t THEN true WHEN can_f THEN false END"
fold("turns", "marks", f"""SELECT DISTINCT doc_id, 0::BIGINT AS i, false AS turn, NULL::VARCHAR AS normalized_text, NULL::BOOLEAN AS truth FROM marks
    UNION ALL SELECT m.doc_id, m.i, coalesce({_TRUTH}, turn), m.normalized_text, {_TRUTH} FROM turns t JOIN marks m ON m.doc_id = t.doc_id AND m.i = t.i + 1""")
_TF = "doc_id, question_id, question_type, prompt, boolean_answer, normalized_text, pick"
step("by_turns", "trues falses turns", f"SELECT s.* FROM (SELECT {_TF} FROM trues UNION ALL SELECT {_TF} FROM falses) s JOIN turns t ON s.doc_id = t.doc_id AND s.normalized_text = t.normalized_text AND s.boolean_answer = t.truth")


def size(x: str) -> str:
    return f"len({terms(x)})"


def chunked(name: str, source: str, target: int, overlap: int) -> None:
    """Steps: a document's sentences and running sums of words, places of its chunks (from a up to b), chunks."""
    step(f"{name}_sums", source, f"SELECT doc_id, list(text ORDER BY sentence_index) AS texts, list_concat([0::BIGINT], list(upto ORDER BY sentence_index)) AS c FROM (SELECT doc_id, sentence_index, text, sum({size('text')}) OVER (PARTITION BY doc_id ORDER BY sentence_index)::BIGINT AS upto FROM {source}) GROUP BY doc_id")
    # The first sentence that doesn't fit behind place a closes the chunk; the next one starts with the longest tail that stays within the overlap and leaves room.
    close = lambda a: f"coalesce(list_filter(range({a} + 1, len(c) - 1), lambda i_: c[i_ + 2] - c[{a} + 1] > {target})[1], len(c) - 1)"
    tail = f"list_filter(range(a, b + 1), lambda t_: t_ = b OR (c[b + 1] - c[t_ + 1] <= {overlap} AND c[b + 2] - c[t_ + 1] <= {target}))[1]"
    fold(f"{name}_at", f"{name}_sums", f"""SELECT doc_id, c, 0::BIGINT AS k, 0::BIGINT AS a, {close('0')} AS b FROM {name}_sums
        UNION ALL SELECT doc_id, c, k, a, {close('a')} FROM (SELECT doc_id, c, k + 1 AS k, {tail} AS a FROM {name}_at WHERE b < len(c) - 1)""")
    step(name, f"{name}_at {name}_sums", f"SELECT s.doc_id, k, a, b, texts[a + 1:b] AS texts, s.c[b + 1] - s.c[a + 1] AS size FROM {name}_at p JOIN {name}_sums s ON p.doc_id = s.doc_id")


chunked("doc_chunks", "doc_s", 120, 20)
chunked("fact_chunks", "fact_s", 40, 12)

# A candidate's sentence in its first chunk grows by its neighbours, left and right by turns, within the budget.
step("homes", "picked fact_chunks", "SELECT p.doc_id, normalized_text, sentence_index, source_sentence, text, texts, sentence_index - a + 1 AS own FROM picked p LEFT JOIN fact_chunks f ON p.doc_id = f.doc_id AND sentence_index >= a AND sentence_index < b QUALIFY row_number() OVER (PARTITION BY p.doc_id, normalized_text ORDER BY k) = 1")
fold("grown", "homes", f"""SELECT doc_id, normalized_text, texts, own, 1::BIGINT AS turn, {size('texts[own]')} AS held, texts[own] AS context FROM homes WHERE {size('texts[own]')} <= 24
    UNION ALL SELECT doc_id, normalized_text, texts, own, turn + 1, CASE WHEN fits THEN held + more ELSE held END, CASE WHEN NOT fits THEN context WHEN turn % 2 = 1 THEN texts[spot] || ' ' || context ELSE context || ' ' || texts[spot] END FROM (
      SELECT *, spot BETWEEN 1 AND len(texts) AND held + more <= 24 AS fits FROM (SELECT *, {size('texts[spot]')} AS more FROM (SELECT *, CASE WHEN turn % 2 = 1 THEN own - (turn + 1) // 2 ELSE own + (turn + 1) // 2 END AS spot FROM grown WHERE turn <= 2 * (len(texts) - 1))))""")
step("contexts", "homes grown", f"""SELECT h.doc_id, h.normalized_text, g.context, CASE WHEN NOT {occurs('source_sentence', 'text')} THEN 'CANDIDATE_NOT_IN_SENTENCE' WHEN h.texts IS NULL THEN 'NO_CHUNK' WHEN g.context IS NULL THEN 'SENTENCE_OVER_BUDGET' END AS error_code
    FROM homes h LEFT JOIN (SELECT * FROM grown QUALIFY row_number() OVER (PARTITION BY doc_id, normalized_text ORDER BY turn DESC) = 1) g ON h.doc_id = g.doc_id AND h.normalized_text = g.normalized_text""")


def artifact(x: str) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(a)})" for a in C.ARTIFACTS) + ")"


_REST = plain("array_to_string(" + parts("source_sentence", "text") + ", ' ')")
step("asking", "picked", f"SELECT *, regexp_extract_all({_REST}, '[{_W}]+')[1:8] AS kept FROM picked WHERE {occurs('source_sentence', 'text')} AND {size('source_sentence')} <= {C.CONTEXT_TOKENS}")
step("stem", "asking", "SELECT *, 'Which answer fits the statement about ' || array_to_string(kept, ' ') || '?' AS question FROM asking WHERE len(kept) > 0")
step("stems", "stem", f"SELECT * FROM stem WHERE length(question) BETWEEN {C.QUESTION_MIN} AND {C.QUESTION_MAX} AND NOT {artifact('lower(question)')} AND NOT {occurs('question', 'text')} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pick) <= {C.STEMS_ATTEMPTED}")
_OWN_PROMPT = "CASE WHEN subject <> '' THEN CASE relation WHEN 'common task' THEN 'What is a common task of ' || subject || '?' WHEN 'stores' THEN 'What does ' || subject || ' store?' WHEN 'converts' THEN 'What does ' || subject || ' convert energy into?' WHEN 'are' THEN 'What are ' || subject || ' used to treat?' END END"
step("short", "stems", f"SELECT *, {_id('Short Answer')} AS question_id, 'Short Answer' AS question_type, text AS correct_answer FROM (SELECT *, coalesce({_OWN_PROMPT}, question) AS prompt FROM stems)")
step("three", "pairs", f"SELECT doc_id, normalized_text, list(distractor ORDER BY place) AS others FROM ({_distractors('Medium')}) GROUP BY doc_id, normalized_text HAVING count(*) = 3")
step("mc_raw", "stems three", f"SELECT *, {_id('Multiple Choice')} AS question_id, 'Multiple Choice' AS question_type, text AS correct_answer FROM (SELECT s.*, question AS prompt, list_concat([text], others) AS texts FROM stems s JOIN three t ON s.doc_id = t.doc_id AND s.normalized_text = t.normalized_text) WHERE len(list_distinct(list_transform(texts, lambda x_: {n_candidate('x_')}))) = 4")
_CHOICE_ID = uuid5(C.QUESTION_NAMESPACE, "question_id || '|' || replace(lower(choice), 'ß', 'ss')")
step("mc_each", "mc_raw", f"SELECT doc_id, question_id, choice, is_correct, {_CHOICE_ID} AS id FROM (SELECT doc_id, question_id, unnest(texts) AS choice, generate_subscripts(texts, 1) = 1 AS is_correct FROM mc_raw)")
step("mc", "mc_raw mc_each", "SELECT r.*, choices FROM mc_raw r JOIN (SELECT doc_id, question_id, list({'id': id, 'text': choice, 'is_correct': is_correct} ORDER BY encode(choice), id) AS choices FROM mc_each GROUP BY doc_id, question_id) e ON r.doc_id = e.doc_id AND r.question_id = e.question_id")

# Sound and damaged questions.
_BOTH = "doc_id, question_id, question_type, prompt, correct_answer, normalized_text, source_sentence, sentence_index, page_number, importance_score, pick"
step("whole", "mc short", f"SELECT {_BOTH}, choices, true AS mc, (pick + sentence_index) % 8 AS way FROM mc UNION ALL SELECT {_BOTH}, NULL, false, (pick + sentence_index) % 8 FROM short")


def choice(text: str = "x_.text", right: str = "x_.is_correct") -> str:
    return f"{{'id': x_.id, 'text': {text}, 'is_correct': {right}}}"


step("damaged", "whole", f"""SELECT * REPLACE (
    CASE WHEN mc THEN CASE way WHEN 1 THEN choices[1:3] WHEN 2 THEN list_transform(choices, lambda x_, i_: {choice("CASE WHEN i_ = 1 THEN ' ' ELSE x_.text END")}) WHEN 3 THEN list_transform(choices, lambda x_, i_: {choice("CASE WHEN i_ = 2 THEN choices[1].text ELSE x_.text END")})
      WHEN 4 THEN list_transform(choices, lambda x_: {choice(right='true')}) WHEN 5 THEN list_filter(choices, lambda x_: NOT x_.is_correct) WHEN 6 THEN list_transform(choices, lambda x_: {choice("CASE WHEN x_.is_correct THEN x_.text ELSE correct_answer || ' too' END")}) ELSE choices END END AS choices,
    CASE WHEN mc THEN prompt ELSE CASE way WHEN 1 THEN prompt || '.' WHEN 4 THEN 'Is this about ' || correct_answer || '?' WHEN 5 THEN source_sentence WHEN 6 THEN CASE WHEN pick % 2 = 0 THEN 'Who said that it was so?' ELSE 'How many were there, and what task had they?' END ELSE prompt END END AS prompt),
    CASE WHEN NOT mc AND way = 2 THEN [] WHEN NOT mc AND way = 3 THEN ['something else', correct_answer] ELSE list_distinct([correct_answer, normalized_text]) END AS accepted FROM whole""")
step("damaged_folded", "damaged", f"SELECT *, {_P} AS np, {_A} AS na, {_SN} AS ns FROM damaged")
_SAID = n_question("x_.text")
_MORE_RULES = {
    "prompt": "trim(prompt) = ''",
    "answer": "trim(correct_answer) = ''",
    "length": f"length(trim(prompt)) NOT BETWEEN {C.QUESTION_MIN} AND {C.QUESTION_MAX}",
    "artifact": artifact("replace(lower(trim(prompt)), 'ß', 'ss')"),
    "identical": "np = ns",
    "grounding": "NOT contains(ns, na)",
    "leak": occurs("prompt", "correct_answer"),
    "mismatch": _RULES["mismatch"],
    "mc_four": "mc AND len(choices) <> 4",
    "mc_empty": "mc AND len(list_filter(choices, lambda x_: trim(x_.text) = '')) > 0",
    "mc_duplicate": f"mc AND len(list_distinct(list_transform(choices, lambda x_: {_SAID}))) <> len(choices)",
    "mc_one": "mc AND len(list_filter(choices, lambda x_: x_.is_correct)) <> 1",
    "mc_correct": f"mc AND len(list_filter(choices, lambda x_: {_SAID} = na)) <> 1",
    "mc_overlap": f"mc AND len(list_filter(choices, lambda x_: NOT x_.is_correct AND (contains(na, {_SAID}) OR contains({_SAID}, na)))) > 0",
    "short_stem": "NOT mc AND NOT ends_with(trim(prompt), '?')",
    "short_variants": "NOT mc AND len(accepted) = 0",
    "short_variant": f"NOT mc AND len(list_filter(accepted, lambda v_: {n_question('v_')} <> na)) > 0",
}
_MORE_ERRORS = "list_filter([" + ", ".join(f"CASE WHEN {rule} THEN {q(ERRORS[name])} END" for name, rule in _MORE_RULES.items()) + "], lambda e_: e_ IS NOT NULL)"
step("damaged_judged", "damaged_folded", f"SELECT *, {_MORE_ERRORS} AS errors FROM damaged_folded")
step("damaged_valued", "damaged_judged", _STEPS["valued"][1].replace("FROM judged", "FROM damaged_judged"))

# Answers to them: a choice's id, or a text that is right, nearly right or wrong.
_RIGHT, _WRONG = "list_filter(choices, lambda x_: x_.is_correct)[1].id", "list_filter(choices, lambda x_: NOT x_.is_correct)[1].id"
step("told", "damaged", f"""SELECT *, CASE WHEN mc THEN CASE turn WHEN 0 THEN {_RIGHT} WHEN 1 THEN {_WRONG} WHEN 2 THEN 'no such choice' WHEN 3 THEN ' ' WHEN 5 THEN correct_answer WHEN 6 THEN {_RIGHT} END
    ELSE CASE turn WHEN 0 THEN correct_answer WHEN 1 THEN upper(correct_answer) || '! ' WHEN 2 THEN correct_answer || ' indeed' WHEN 3 THEN ' ' WHEN 5 THEN 'something else' WHEN 6 THEN 'so, ' || correct_answer || ' of course' END END AS answer_text FROM (SELECT *, (pick + 2 * sentence_index) % 7 AS turn FROM damaged)""")


def bag(x: str) -> str:
    return f"list_distinct(list_filter(string_split({n_question(x)}, ' '), lambda w_: w_ <> ''))"


step("weighed", "told", f"SELECT *, trim(coalesce(answer_text, '')) = '' AS missing, {n_question('answer_text')} AS nt, {bag('answer_text')} AS aw, {bag('correct_answer')} AS ew, list_transform(list_concat([correct_answer], accepted), lambda v_: {n_question('v_')}) AS fine FROM told")
_SHARE = "len(list_intersect(aw, ew))::DOUBLE / greatest(len({}), 1) >= " + str(C.OVERLAP)
step("marked", "weighed", f"""SELECT *, CASE WHEN missing THEN 'Unanswered' WHEN coalesce(CASE WHEN mc THEN answer_text = {_RIGHT} ELSE list_contains(fine, nt)
    OR (len(aw) >= {C.OVERLAP_TOKENS} AND len(ew) >= {C.OVERLAP_TOKENS} AND {_SHARE.format('aw')} AND {_SHARE.format('ew')}) END, false) THEN 'Correct' ELSE 'Incorrect' END AS status FROM weighed""")

# Near-duplicates: 3- to 5-grams inside padded words.
step("prompts", "questions", f"SELECT DISTINCT ON (doc_id, question_id) doc_id, question_id, {terms('lower(prompt)')} AS ws FROM questions")
step("padded", "prompts", "SELECT doc_id, question_id, ' ' || unnest(ws) || ' ' AS w FROM prompts")
step("char_grams", "padded", "SELECT doc_id, question_id, substr(w, i, n) AS g FROM (SELECT doc_id, question_id, w, n, unnest(range(1, greatest(length(w) - n + 1, 1) + 1)) AS i FROM padded, (VALUES (3), (4), (5)) s(n) WHERE n = 3 OR length(w) >= n)")
step("gram_tf", "char_grams", "SELECT doc_id, question_id, g, count(*) AS tf FROM char_grams GROUP BY ALL")
step("gram_w", "gram_tf prompts", "SELECT *, tf * (ln((1 + n)::DOUBLE / (1 + count(*) OVER (PARTITION BY doc_id, g))) + 1) AS w FROM gram_tf JOIN (SELECT doc_id, count(*) AS n FROM prompts GROUP BY doc_id) USING (doc_id)")
step("gram_unit", "gram_w", "SELECT doc_id, question_id, g, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, question_id)) AS w FROM gram_w")

_PREVIEW = "CASE WHEN length(prompt) <= 72 THEN prompt ELSE substr(prompt, 1, 69) || '…' END"
_FRESH = "event = 'results' OR (event = 'query' AND query <> 'topic ' || u)"
_CHOSEN = "event = 'select' AND list_contains(ids, '2')"

SQL: dict[str, str] = {
    "true_false_questions": chain("by_turns", "SELECT doc_id, question_id, prompt, boolean_answer, pick FROM by_turns"),
    "preview_questions": chain("by_turns fill", "SELECT doc_id, question_id, question_type, prompt FROM (SELECT doc_id, question_id, question_type, prompt, pick FROM fill UNION ALL SELECT doc_id, question_id, question_type, prompt, pick FROM by_turns) QUALIFY row_number() OVER (PARTITION BY doc_id, question_type ORDER BY pick) <= 2"),
    "chunks": chain("doc_chunks", "SELECT doc_id, k::INT AS chunk_index, array_to_string(texts, ' ') AS text, (b - a)::INT AS n_sentences, size::INT AS estimated_token_count FROM doc_chunks"),
    "focused_context": chain("contexts", "SELECT doc_id, normalized_text, context, error_code FROM contexts"),
    "stems_template": chain("stems", "SELECT doc_id, normalized_text, question, 'template' AS model_id FROM stems"),
    "short_answer_questions": chain("short", "SELECT doc_id, question_id, prompt, correct_answer FROM short"),
    "multiple_choice_questions": chain("mc", "SELECT doc_id, question_id, prompt, array_to_string(list_transform(choices, lambda x_: x_.id || '=' || x_.text || '=' || x_.is_correct::VARCHAR), '|') AS choices FROM mc"),
    "validate_stem_questions": chain("damaged_valued", "SELECT doc_id, question_id, question_type, array_to_string(errors, '|') AS errors, quality_score FROM damaged_valued"),
    "score_stem_answers": chain("marked", f"SELECT 'quiz-' || doc_id AS quiz_id, question_id, status, {_PREVIEW} AS prompt_preview, CASE WHEN status = 'Unanswered' THEN 'No answer' WHEN mc THEN coalesce(list_filter(choices, lambda x_: x_.id = answer_text)[1].text, 'Invalid choice') ELSE answer_text END AS your_answer, correct_answer FROM marked"),
    "near_duplicate_pairs": chain("gram_unit", "SELECT * FROM (SELECT a.doc_id, a.question_id AS a, b.question_id AS b, round_even(sum(a.w * b.w), 6) AS similarity FROM gram_unit a JOIN gram_unit b ON a.doc_id = b.doc_id AND a.g = b.g AND a.question_id < b.question_id GROUP BY ALL) WHERE similarity >= 0.5"),
    "topic_fold": f"""WITH RECURSIVE e AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, ['query', 'results', 'select', 'document', 'select'][event_id % 5 + 1] AS event, user_id::VARCHAR AS u FROM events),
        walk AS (
          SELECT DISTINCT session_id, 0::BIGINT AS i, '' AS query, []::VARCHAR[] AS ids, NULL::VARCHAR AS selected, NULL::VARCHAR AS document, 0 AS rejected FROM e
          UNION ALL
          SELECT w.session_id, e.i, CASE WHEN event IN ('query', 'results') THEN 'topic ' || u ELSE query END, CASE WHEN event = 'results' THEN ['1', '2', u] WHEN {_FRESH} THEN [] ELSE ids END,
            CASE WHEN {_FRESH} THEN NULL WHEN {_CHOSEN} THEN '2' ELSE selected END, CASE WHEN {_FRESH} OR ({_CHOSEN}) THEN NULL WHEN event = 'document' AND selected IS NOT NULL THEN u ELSE document END,
            rejected + CASE WHEN (event = 'select' AND NOT list_contains(ids, '2')) OR (event = 'document' AND selected IS NULL) THEN 1 ELSE 0 END
          FROM walk w JOIN e ON e.session_id = w.session_id AND e.i = w.i + 1)
        SELECT session_id, query, array_to_string(ids, ',') AS page_ids, selected, document, rejected FROM walk QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY i DESC) = 1""",
}
