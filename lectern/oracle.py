"""DuckDB SQL that the engine's own queries are held against, composed of named steps.

The regular expressions of DuckDB have no look-around. Where a word's edge matters, U+0002 is put on both sides of every
character that is no word character, so that an edge is always a character of its own; it is removed afterwards.
"""

from __future__ import annotations

from . import config as C
from .sources import derived

# Fixed values, stated here once more, so that they are not taken from what they test: HTML's entities in the pages
# (ampersand last), headings that end an article, tags of nouns and of what noun phrases hold, reasons against questions.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&nbsp;": "\u00a0", "&copy;": "©", "&middot;": "·", "&hellip;": "…", "&mdash;": "—", "&ndash;": "–", "&amp;": "&"}
TRAILING = "references|notes|bibliography|further reading|external links|see also"
PROPER, NOUNS, PHRASE = ("NNP", "NNPS"), ("NN", "NNS", "NNP", "NNPS"), ("NN", "NNS", "NNP", "NNPS", "JJ", "JJR", "JJS")
ERRORS = {
    "prompt": "Question prompt is empty.",
    "answer": "Correct answer is empty.",
    "length": "Question prompt is outside the supported length range.",
    "provenance": "Question provenance is incomplete.",
    "artifact": "Question contains a generation artifact.",
    "identical": "Question prompt is effectively identical to its source sentence.",
    "grounding": "Correct answer is not grounded in the recorded source sentence.",
    "leak": "Question prompt directly reveals its expected answer.",
    "mismatch": "Question wording does not match the semantic type of its answer.",
    "mc_four": "Multiple Choice requires exactly four choices.",
    "mc_empty": "Multiple Choice contains an empty choice.",
    "mc_duplicate": "Multiple Choice contains duplicate choices.",
    "mc_one": "Multiple Choice requires exactly one correct choice.",
    "mc_correct": "Multiple Choice must include the correct answer exactly once.",
    "mc_overlap": "A distractor overlaps the correct answer.",
    "tf_boolean": "True/False requires a boolean answer.",
    "tf_true": "True statement is not grounded in the original source statement.",
    "tf_false": "False statement is not a valid controlled factual replacement.",
    "fill_blank": "Fill-in-the-Blank requires exactly one blank.",
    "fill_absent": "Fill-in-the-Blank answer is absent from the original source.",
    "fill_context": "Fill-in-the-Blank removes too much source context.",
    "short_stem": "Short Answer requires a complete question stem.",
    "short_variants": "Short Answer requires accepted answer variants.",
    "short_variant": "Short Answer contains an unsupported accepted-answer variant.",
}

_W, _S = r"\p{L}\p{N}_", r"\s\x{85}\p{Z}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{_S}]+', ' ', 'g'))"


def strip(x: str, chars: str = _S) -> str:
    return f"regexp_replace({x}, '^[{chars}]+|[{chars}]+$', '', 'g')"


def terms(x: str) -> str:
    return f"list_filter(string_split({collapse(x)}, ' '), lambda w_: w_ <> '')"


def cleaned(x: str, repair: bool = False) -> str:
    x = f"regexp_replace(replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), chr(160), ' '), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"
    # A repaired cut takes its neighbours along; twice, as neighbours may be shared.
    for _ in range(2 if repair else 0):
        x = f"regexp_replace({x}, '([A-Za-z])-\\n([a-z])', '\\1\\2', 'g')"
    return x


def paragraphs(x: str) -> str:
    line = strip("regexp_replace(l_, '[ \\t]+', ' ', 'g')")
    lines = f"array_to_string(list_filter(list_transform(string_split(p_, chr(10)), lambda l_: {line}), lambda l_: l_ <> ''), ' ')"
    return f"list_filter(list_transform(string_split_regex({x}, '\\n[{_S}]*\\n+'), lambda p_: {lines}), lambda p_: p_ <> '')"


def normalize(x: str, repair: bool = False) -> str:
    return f"array_to_string({paragraphs(cleaned(x, repair))}, chr(10) || chr(10))"


def n_candidate(x: str) -> str:
    return collapse(f"regexp_replace(lower({x}), '[^{_W}{_S}%]+', ' ', 'g')")


def n_question(x: str) -> str:
    return collapse(f"regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^{_W}{_S}]+', ' ', 'g')")


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)?|%')"


def edged(x: str) -> str:
    return f"regexp_replace({x}, '([^{_W}])', chr(2) || '\\1' || chr(2), 'g')"


def parts(sentence: str, candidate: str) -> str:
    """What stands between standalone occurrences, edges still marked."""
    return f"string_split_regex(chr(2) || {edged(sentence)} || chr(2), '(?i)\\x02' || regexp_escape({edged(candidate)}) || '\\x02')"


def occurs(text: str, candidate: str) -> str:
    return f"len({parts(text, candidate)}) > 1"


def plain(x: str) -> str:
    return f"replace({x}, chr(2), '')"


def uuid5(namespace: str, name: str) -> str:
    h = f"sha1(unhex('{namespace.replace('-', '')}') || encode({name}))"
    return f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || printf('%02x', (('0x' || substr(h, 17, 2))::INT & 63) | 128) || substr(h, 19, 2) || '-' || substr(h, 21, 12) FROM (SELECT {h} AS h))"


def usable(text: str, normal: str, sentence: str, most: int) -> str:
    word = f"list_filter({tokens(normal)}, lambda t_: t_ <> '%')"
    stop = "[" + ", ".join(map(q, C.STOPWORDS)) + "]"
    return (
        f"(length({normal}) BETWEEN {C.CANDIDATE_MIN_CHARS} AND {C.CANDIDATE_MAX_CHARS} AND len({word}) > 0 AND len({tokens(normal)}) <= {most} "
        f"AND len(list_filter({word}, lambda t_: NOT list_contains({stop}, lower(t_)))) > 0 AND NOT ({normal} = {n_candidate(sentence)} AND len({word}) > 3))"
    )


# --- steps -----------------------------------------------------------------------------------------------------------

_STEPS: dict[str, tuple[tuple[str, ...], str]] = {}


def step(name: str, needs: str, sql: str) -> None:
    _STEPS[name] = (tuple(needs.split()), sql)


def chain(last: str, sql: str) -> str:
    """WITH all steps that the last ones need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in _STEPS[name][0]:
            visit(n)
        if name not in order:
            order.append(name)

    for name in last.split():
        visit(name)
    once = {n: "" if n in _FOLDS else "MATERIALIZED " for n in order}
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {once[n]}({_STEPS[n][1]})" for n in order) + "\n" + sql


#: Steps that refer to themselves.
_FOLDS: set[str] = set()


def fold(name: str, needs: str, sql: str) -> None:
    step(name, needs, sql)
    _FOLDS.add(name)


def _sentences(source: str, minimum: int = C.MIN_SENTENCE) -> str:
    """source has doc_id, page_no, text."""
    split = "string_split(regexp_replace(p, '([.!?])[" + _S + "]+', '\\1' || chr(1), 'g'), chr(1))"
    return f"""
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY unit, pi, si) - 1)::INT AS sentence_index, s AS text, page_number, paragraph_index FROM (
    SELECT doc_id, unit, page_number, paragraph_index, pi, si, {collapse('raw')} AS s FROM (
      SELECT doc_id, unit, page_number, paragraph_index, pi, unnest({split}) AS raw, generate_subscripts({split}, 1) AS si FROM (
        SELECT doc_id, unit, page_number, p, pi, (row_number() OVER (PARTITION BY doc_id ORDER BY unit, pi) - 1)::INT AS paragraph_index FROM (
          SELECT doc_id, unit, page_number, unnest(ps) AS p, generate_subscripts(ps, 1) AS pi FROM (SELECT doc_id, unit, page_number, {paragraphs(cleaned('text'))} AS ps FROM ({source}))))))
  WHERE length(s) >= {minimum} AND regexp_matches(s, '[\\p{{L}}\\p{{N}}]')"""


_UNIT = "SELECT doc_id, 0 AS unit, NULL::INT AS page_number, coalesce(text, '') AS text FROM "
_FACTS = (
    f"SELECT CAST(1000000000 + n_nationkey AS BIGINT) AS doc_id, {derived.NATION_FACTS} AS text FROM nation JOIN region ON n_regionkey = r_regionkey "
    f"UNION ALL SELECT CAST(2000000000 + p_partkey AS BIGINT), {derived.PART_FACTS} FROM part"
)
_PARAGRAPHS = f"SELECT doc_id, {derived.PARAGRAPHS} AS text FROM documents"
step("doc_s", "", _sentences(_UNIT + "documents"))
step("para_s", "", _sentences(_UNIT + f"({_PARAGRAPHS})"))
step("paged_s", "", _sentences("SELECT conv_id AS doc_id, turn AS unit, turn::INT AS page_number, coalesce(text, '') AS text FROM conversations"))
step("fact_s", "", _sentences(_UNIT + f"({_FACTS})"))
step("both_s", "doc_s fact_s", "SELECT * FROM doc_s UNION ALL SELECT * FROM fact_s")

_GENERIC = f"regexp_matches(text, '(?i)^\\s*(?:a|an|the|one)\\s+(?:common task|goal|purpose|example|use|benefit|function)(?:[^{_W}]|$)')"
_OWN = "coalesce(nullif(trim(regexp_extract(text, '^\\s*([A-Z][A-Za-z0-9 -]{1,50}):', 1)), ''), nullif(trim(regexp_extract(text, '^\\s*([A-Z][A-Za-z0-9 -]{1,50}?)\\s+(?:is|are|uses|converts|stores)', 1)), ''))"


def _subjects(source: str) -> str:
    return f"SELECT *, last_value(CASE WHEN NOT {_GENERIC} THEN {_OWN} END IGNORE NULLS) OVER (PARTITION BY doc_id, paragraph_index ORDER BY sentence_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS subject FROM {source}"


step("both_subject", "both_s", _subjects("both_s"))
step("fact_subject", "fact_s", _subjects("fact_s"))

_KEYS = "doc_id, sentence_index, paragraph_index, page_number"


def _made(source: str, kind: str) -> str:
    """source has the keys, sentence, raw, subject, relation, emit_order."""
    most = C.RELATION_MAX_TOKENS if kind == "relation phrase" else C.CANDIDATE_MAX_TOKENS
    return f"""SELECT {_KEYS}, text, normalized_text, sentence AS source_sentence, {q(kind)} AS candidate_type, subject, relation, emit_order FROM (
    SELECT *, {n_candidate('text')} AS normalized_text FROM (SELECT *, {strip(collapse('raw'), ' ,;:-')} AS text FROM ({source}))) WHERE {usable('text', 'normalized_text', 'sentence', most)}"""


_NONE = "NULL::VARCHAR AS subject, NULL::VARCHAR AS relation"
_DEFINITION = f"(?i)^\\s*([A-Za-z][A-Za-z0-9-]*(?:\\s+[A-Za-z][A-Za-z0-9-]*){{0,4}}?)\\s+(?:is\\s+defined\\s+as|refers\\s+to|means|is)(?:[^{_W}]|$)"


def _definitions(source: str) -> str:
    return _made(f"SELECT {_KEYS}, text AS sentence, regexp_replace(regexp_extract(text, '{_DEFINITION}', 1), '(?i)^(?:the\\s+)?term\\s+', '') AS raw, {_NONE}, [0, 0, 0] AS emit_order FROM {source} WHERE regexp_matches(text, '{_DEFINITION}')", "definition term")


_YEAR = r"(?:1[5-9]\d{2}|20\d{2}|21\d{2})"
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_PATTERNS = (
    (rf"(?i)\b(?:{_MONTH}\s+\d{{1,2}}(?:,\s*|\s+){_YEAR}|\d{{1,2}}\s+{_MONTH}\s+{_YEAR})\b", "date/year"),
    (rf"\b{_YEAR}\b", "date/year"),
    (r"(?i)\b\d+(?:\.\d+)?%|\b\d+(?:\.\d+)?\s*(?:percent(?:age)?|thousand|million|billion|kilometers?|kilometres?|meters?|metres?|kilograms?|kg|km)\b", "quantity/percentage"),
)


def _patterns(source: str) -> str:
    out = []
    for k, (pattern, kind) in enumerate(_PATTERNS):
        every = f"regexp_extract_all(text, {q(pattern)})"
        out.append(_made(f"SELECT {_KEYS}, text AS sentence, unnest({every}) AS raw, {_NONE}, [{1 + k}, generate_subscripts({every}, 1) - 1, 0] AS emit_order FROM {source}", kind))
    return "\nUNION ALL\n".join(out)


_RELATIONS = (
    (rf"(?i)([A-Z][{_W} -]{{1,50}}?)\s+(converts)\s+.+?\s+into\s+([^.]+)", 1, 2, 3),
    (rf"(?i)([A-Z][{_W} -]{{1,50}}?)\s+(stores|predicts|includes|performs)\s+([^.]+)", 1, 2, 3),
    (rf"(?i)([A-Z][{_W} -]{{1,50}}?)\s+(is|are)\s+used\s+to\s+[{_W}]+\s+([^.]+)", 1, 2, 3),
    (r"(?i)(?:a|an|the|one)\s+(common task|example|goal|purpose|use|benefit|function)\s+(?:of|is)\s+([^.]+)", 0, 1, 2),
)


def _relations(source: str) -> str:
    out = []
    for k, (pattern, subject, relation, answer) in enumerate(_RELATIONS):
        every = lambda g: f"regexp_extract_all(text, {q(pattern)}, {g})"
        own = f"coalesce(nullif(unnest({every(subject)}), ''), subject)" if subject else "subject"
        inner = f"SELECT {_KEYS}, text AS sentence, unnest({every(answer)}) AS raw, {own} AS named, unnest({every(relation)}) AS rel, generate_subscripts({every(answer)}, 1) - 1 AS i FROM {source} WHERE regexp_matches(text, {q(pattern)})"
        out.append(_made(f"SELECT {_KEYS}, sentence, raw, {strip('named')} AS subject, lower(rel) AS relation, [{4 + k}, i, 0] AS emit_order FROM ({inner})", "relation phrase"))
    return "\nUNION ALL\n".join(out)


step("doc_defs", "doc_s", _definitions("doc_s"))
step("defs", "fact_s", _definitions("fact_s"))
step("pats", "fact_s", _patterns("fact_s"))
step("both_pats", "both_s", _patterns("both_s"))
step("rels", "fact_subject", _relations("fact_subject"))
step("lexicon", "", "SELECT * FROM (VALUES " + ", ".join(f"({q(t)}, {q(tag)})" for tag, ts in derived.LEXICON.items() for t in ts) + ") l(token, tag)")
_TOKENS = f"regexp_extract_all(text, '[{_W}]+|[^{_W}{_S}]+')"
step("tagged", "fact_s lexicon", f"SELECT t.*, coalesce(l.tag, 'VBZ') AS tag FROM (SELECT {_KEYS}, text AS sentence, unnest({_TOKENS}) AS token, generate_subscripts({_TOKENS}, 1) - 1 AS pos FROM fact_s) t LEFT JOIN lexicon l ON t.token = l.token")


def _runs() -> str:
    out = []
    inside = lambda tags: ", ".join(map(q, tags))
    for k, (tags, kind) in enumerate(((PROPER, "proper noun"), (PHRASE, "noun phrase"))):
        island = f"SELECT *, pos - row_number() OVER (PARTITION BY doc_id, sentence_index ORDER BY pos) AS island FROM tagged WHERE tag IN ({inside(tags)})"
        out.append(_made(f"SELECT {_KEYS}, sentence, string_agg(token, ' ' ORDER BY pos) AS raw, {_NONE}, [8, max(pos) + 1, {k}] AS emit_order FROM ({island}) GROUP BY {_KEYS}, sentence, island", kind))
    out.append(_made(f"SELECT {_KEYS}, sentence, token AS raw, {_NONE}, [8, pos, 2] AS emit_order FROM tagged WHERE tag IN ({inside(NOUNS)})", "general concept"))
    return "\nUNION ALL\n".join(out)


step("runs", "tagged", _runs())
step("every", "defs pats rels runs", "SELECT * FROM defs UNION ALL SELECT * FROM pats UNION ALL SELECT * FROM rels UNION ALL SELECT * FROM runs")
step("sets", "every", f"SELECT *, list_distinct({terms('normalized_text')}) AS own FROM every")
step("cand", "sets", """SELECT * FROM sets s WHERE NOT (candidate_type IN ('general concept', 'noun phrase') AND len(own) <= 2 AND EXISTS (
    SELECT 1 FROM sets r WHERE r.candidate_type = 'relation phrase' AND r.doc_id = s.doc_id AND r.sentence_index = s.sentence_index AND list_has_all(r.own, s.own) AND len(s.own) < len(r.own)))""")
step("freq", "cand", "SELECT doc_id, normalized_text, count(*)::INT AS frequency FROM cand GROUP BY ALL")
step("texts", "cand", f"SELECT DISTINCT doc_id, source_sentence, regexp_extract_all(lower(source_sentence), '[{_W}]{{2,}}') AS words FROM cand")
step("grams", "texts", "SELECT doc_id, source_sentence, array_to_string(words[i:i + n - 1], ' ') AS feature FROM texts, range(1, 6) a(n), LATERAL (SELECT unnest(range(1, len(words) - n + 2)) AS i) WHERE len(words) >= n")
step("tf", "grams", "SELECT doc_id, source_sentence, feature, count(*) AS tf FROM grams GROUP BY ALL")
step("raw_w", "tf texts", """SELECT tf.*, tf.tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN (SELECT doc_id, feature, count(*) AS df FROM tf GROUP BY ALL) USING (doc_id, feature)
    JOIN (SELECT doc_id, count(*) AS n FROM texts GROUP BY ALL) USING (doc_id)""")
step("weights", "raw_w", "SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, source_sentence)) AS weight FROM raw_w")
step("asked", "cand", f"SELECT DISTINCT doc_id, sentence_index, normalized_text, source_sentence, list_filter({tokens('normalized_text')}, lambda t_: t_ <> '%') AS ts FROM cand")
step("tfidf", "asked weights", """SELECT a.doc_id, a.sentence_index, a.normalized_text, coalesce(max(weight), 0) AS tfidf FROM (SELECT *, unnest(list_distinct(list_concat([array_to_string(ts, ' ')], ts))) AS feature FROM asked) a
    LEFT JOIN weights w ON a.doc_id = w.doc_id AND a.source_sentence = w.source_sentence AND a.feature = w.feature GROUP BY ALL""")
_BONUS = "CASE candidate_type " + " ".join(f"WHEN {q(k)} THEN {v[0]}::DOUBLE" for k, v in C.CANDIDATE_TYPES.items()) + " END"
_PRIORITY = "CASE candidate_type " + " ".join(f"WHEN {q(k)} THEN {v[1]}" for k, v in C.CANDIDATE_TYPES.items()) + " END"
step("scored", "cand tfidf freq", f"""SELECT c.*, frequency, round_even(tfidf + {_BONUS} + 0.05::DOUBLE * least(greatest(frequency - 1, 0), 3) + 0.05::DOUBLE * least(length(source_sentence)::DOUBLE / 180, 1.0::DOUBLE)
    - 0.02::DOUBLE * greatest(len({tokens('c.normalized_text')}) - 3, 0), 6) AS importance_score, {_PRIORITY} AS priority
    FROM cand c JOIN tfidf t USING (doc_id, sentence_index, normalized_text) JOIN freq f USING (doc_id, normalized_text)""")
step("dedup", "scored", "SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id, normalized_text ORDER BY importance_score DESC, priority DESC, sentence_index, lower(text), emit_order) = 1")
step("ranked", "dedup", "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY importance_score DESC, priority DESC, encode(normalized_text), sentence_index)::INT AS rank FROM dedup")
step("less", "ranked", "SELECT *, importance_score - 0.08::DOUBLE * (row_number() OVER (PARTITION BY doc_id, page_number, paragraph_index ORDER BY importance_score DESC, encode(normalized_text), sentence_index) - 1) AS less FROM ranked")
step("picked", "less", f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY less DESC, importance_score DESC, encode(normalized_text), sentence_index)::INT AS pick FROM less QUALIFY pick <= {C.CANDIDATE_LIMIT}")

_BAG = lambda x: f"list_distinct(list_filter(list_transform({terms(f'replace(lower({x}), chr(223), chr(115) || chr(115))')}, lambda w_: regexp_replace(w_, '^[.,;:!?]+|[.,;:!?]+$', '', 'g')), lambda w_: w_ <> ''))"
step("bags", "picked", f"SELECT *, {_BAG('source_sentence')} AS bag FROM picked")
_CONCEPT = "(" + ", ".join(map(q, C.CONCEPT_TYPES)) + ")"
step("pairs", "bags", f"""SELECT t.doc_id, t.normalized_text, o.text AS distractor, o.normalized_text AS distractor_normalized, o.importance_score AS score, o.sentence_index AS si, abs(length(t.text) - length(o.text)) AS far,
    CASE WHEN len(t.bag) > 0 AND len(o.bag) > 0 THEN len(list_intersect(t.bag, o.bag))::DOUBLE / len(list_distinct(list_concat(t.bag, o.bag))) ELSE 0 END AS near
    FROM bags t JOIN bags o ON t.doc_id = o.doc_id WHERE (t.candidate_type = o.candidate_type OR (t.candidate_type IN {_CONCEPT} AND o.candidate_type IN {_CONCEPT}))
    AND NOT contains(t.normalized_text, o.normalized_text) AND NOT contains(o.normalized_text, t.normalized_text) AND NOT contains(lower(t.source_sentence), lower(o.text))""")


def _distractors(difficulty: str, limit: int = 3) -> str:
    plausible = {"Easy": "near", "Medium": "-near * 0.5::DOUBLE", "Hard": "-near"}[difficulty]
    order = f"{plausible}, far, score DESC, encode(distractor_normalized), si"
    first = f"SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY doc_id, normalized_text, distractor_normalized ORDER BY {order}) = 1"
    return f"SELECT doc_id, normalized_text, distractor, distractor_normalized, row_number() OVER (PARTITION BY doc_id, normalized_text ORDER BY {order})::INT AS place FROM ({first}) QUALIFY place <= {limit}"


def _id(kind: str, prompt: str = "prompt") -> str:
    return uuid5(C.QUESTION_NAMESPACE, f"{q(kind)} || '|' || normalized_text || '|' || sentence_index || '|' || source_sentence || '|' || {prompt}")


def _fill(source: str) -> str:
    inner = f"SELECT *, {parts('source_sentence', 'text')} AS ps FROM {source}"
    whole = plain("ps[1]") + " || " + plain("ps[2]")
    return f"SELECT *, 'Fill-in-the-Blank' AS question_type, {_id('Fill-in-the-Blank')} AS question_id, text AS correct_answer, NULL::BOOLEAN AS boolean_answer FROM (SELECT *, {plain('ps[1]')} || '{C.BLANK}' || {plain('ps[2]')} AS prompt FROM ({inner}) WHERE len(ps) = 2 AND len({terms(whole)}) >= 4) WHERE len(string_split(prompt, '{C.BLANK}')) = 2"


step("doc_fill", "doc_defs", _fill("doc_defs"))
step("fill", "picked", _fill("picked"))
step("trues", "picked", f"SELECT *, 'True/False' AS question_type, {_id('True/False')} AS question_id, 'True' AS correct_answer, true AS boolean_answer FROM (SELECT *, source_sentence AS prompt FROM picked WHERE len({parts('source_sentence', 'text')}) = 2)")
step("best", "pairs", _distractors("Medium", 1))
step("falses", "picked best", f"""SELECT *, 'True/False' AS question_type, {_id('True/False')} AS question_id, 'False' AS correct_answer, false AS boolean_answer FROM (
    SELECT *, {plain('ps[1]')} || distractor || {plain('ps[2]')} AS prompt FROM (SELECT p.*, b.distractor, {parts('source_sentence', 'text')} AS ps FROM picked p JOIN best b USING (doc_id, normalized_text)) WHERE len(ps) = 2)
    WHERE {n_candidate('prompt')} <> {n_candidate('source_sentence')}""")
_Q = "doc_id, question_id, question_type, prompt, correct_answer, boolean_answer, source_sentence, sentence_index, page_number, importance_score"
step("questions", "fill trues falses", f"SELECT {_Q} FROM fill UNION ALL SELECT {_Q} FROM trues UNION ALL SELECT {_Q} FROM falses")
_P, _A, _SN = n_question("trim(prompt)"), n_question("correct_answer"), n_question("source_sentence")
step("folded", "questions", f"SELECT *, {_P} AS np, {_A} AS na, {_SN} AS ns, question_type = 'True/False' AS tf, question_type = 'Fill-in-the-Blank' AS fl FROM questions")
_ACTION = "(starts_with(na, 'to ') OR len(list_filter(string_split(na, ' '), lambda t_: ends_with(t_, 'ing'))) > 0)"
_RULES = {
    "prompt": "trim(prompt) = ''",
    "answer": "trim(correct_answer) = ''",
    "length": f"length(trim(prompt)) NOT BETWEEN {C.QUESTION_MIN} AND {C.QUESTION_MAX}",
    "grounding": "NOT tf AND NOT contains(ns, na)",
    "mismatch": f"((contains(np, 'what task') OR contains(np, 'common task')) AND NOT {_ACTION}) OR ((contains(np, 'purpose') OR contains(np, 'goal')) AND NOT {_ACTION}) OR (contains(np, 'how many') AND NOT regexp_matches(na, '[0-9]')) "
    "OR (starts_with(np, 'who ') AND NOT regexp_matches(correct_answer, '(^| )\\p{Lu}'))",
    "tf_true": "tf AND boolean_answer AND np <> ns",
    "tf_false": "tf AND NOT boolean_answer AND np = ns",
    "fill_blank": f"fl AND len(string_split(prompt, '{C.BLANK}')) <> 2",
    "fill_absent": "fl AND NOT contains(ns, na)",
    "fill_context": f"fl AND len({terms(f'''replace(prompt, '{C.BLANK}', '')''')}) < 4",
}
_ERRORS = "list_filter([" + ", ".join(f"CASE WHEN {rule} THEN {q(ERRORS[name])} END" for name, rule in _RULES.items()) + "], lambda e_: e_ IS NOT NULL)"
step("judged", "folded", f"SELECT *, {_ERRORS} AS errors FROM folded")
step("valued", "judged", f"""SELECT *, CASE WHEN len(errors) > 0 THEN 0.0::DOUBLE ELSE round_even(least(0.35::DOUBLE + 0.15::DOUBLE + CASE WHEN page_number IS NULL THEN 0.1::DOUBLE ELSE 0.15::DOUBLE END
    + CASE WHEN length(prompt) BETWEEN 12 AND 160 THEN 0.15::DOUBLE ELSE 0.08::DOUBLE END + CASE WHEN len({terms('correct_answer')}) <= 5 THEN 0.1::DOUBLE ELSE 0.04::DOUBLE END
    + least(greatest(importance_score, 0.0::DOUBLE), 1.0::DOUBLE) * 0.1::DOUBLE, 1.0::DOUBLE), 6) END AS quality_score FROM judged""")

step("numbered", "folded", "SELECT *, 'quiz-' || doc_id AS quiz_id, row_number() OVER (PARTITION BY doc_id ORDER BY question_id) % 6 AS way FROM folded")
step("answered", "numbered", """SELECT *, CASE WHEN tf AND way NOT IN (3, 5) THEN NULL ELSE CASE way WHEN 0 THEN correct_answer WHEN 1 THEN '  ' || upper(correct_answer) || '! ' WHEN 2 THEN 'something else' WHEN 3 THEN ' ' WHEN 5 THEN 'True' END END AS answer_text,
    CASE WHEN tf THEN CASE WHEN way IN (0, 1) THEN boolean_answer WHEN way = 2 THEN NOT boolean_answer END END AS answer_bool FROM numbered""")
step("given", "answered", f"SELECT *, answer_bool IS NULL AND trim(coalesce(answer_text, '')) = '' AS missing, {n_question('answer_text')} AS nt FROM answered")
step("graded", "given", """SELECT *, CASE WHEN missing THEN 'Unanswered' WHEN is_correct THEN 'Correct' ELSE 'Incorrect' END AS status,
    CASE WHEN NOT missing THEN CASE WHEN tf THEN CASE WHEN answer_bool THEN 'True' WHEN NOT answer_bool THEN 'False' END ELSE nt END END AS normalized_user_answer
    FROM (SELECT *, NOT missing AND coalesce(CASE WHEN tf THEN answer_bool = boolean_answer ELSE nt = na END, false) AS is_correct FROM given)""")

_SHOWN = "doc_id, sentence_index, text, normalized_text, candidate_type"
_COUNTS = "count(*) AS total, count(*) FILTER (status = 'Correct') AS correct, count(*) FILTER (status = 'Incorrect') AS incorrect, count(*) FILTER (status = 'Unanswered') AS unanswered"
_HTML = "regexp_replace(html, '<[^>]+>', '', 'g')"
for _name, _value in ENTITIES.items():
    _HTML = f"replace({_HTML}, {q(_name)}, {q(_value)})"
_GATE = "CASE WHEN n = 0 THEN 'EMPTY_TEXT' WHEN n < 50 THEN 'INSUFFICIENT_TEXT' WHEN n > 20000 THEN 'TOO_LARGE' END"
_ARTICLE = paragraphs(cleaned(f"string_split_regex(text || chr(10) || chr(10) || 'See also' || chr(10) || 'nothing to read here', '(?im)^\\s*(?:{TRAILING})\\s*$')[1]", repair=True))

SQL: dict[str, str] = {
    "fill_blank_definitions": chain("doc_fill", "SELECT doc_id, sentence_index, question_id, prompt, correct_answer FROM doc_fill"),
    "normalize_text": f"SELECT doc_id, {normalize('text', True)} AS text FROM ({_PARAGRAPHS})",
    "ingest_gate": f"SELECT doc_id, n::INT AS character_count, {_GATE} AS error_code FROM (SELECT doc_id, length({normalize('text')}) AS n FROM documents)",
    "plain_text_html": f"SELECT page_id, {collapse(_HTML)} AS text FROM pages",
    "article_cap": f"""SELECT doc_id, coalesce((SELECT string_agg(p, chr(10) || chr(10) ORDER BY i) FROM (SELECT p, i, sum(length(p) + 2) OVER (ORDER BY i) - 2 AS upto FROM (SELECT unnest(ps) AS p, generate_subscripts(ps, 1) AS i)) WHERE upto <= 2000), '') AS text
        FROM (SELECT doc_id, {_ARTICLE} AS ps FROM ({_PARAGRAPHS}))""",
    "article_urls": f"SELECT p_partkey, '{C.ARTICLE_BASE}' || replace(replace(replace(url_encode(replace(p_name || '/a*~(é)/' || p_brand, ' ', '_')), '%2F', '/'), '%7E', '~'), '*', '%2A') AS url FROM part",
    "normalize_candidate": chain("doc_s", f"SELECT doc_id, sentence_index, {n_candidate('text')} AS normalized FROM doc_s"),
    "normalize_question_text": chain("doc_s", f"SELECT doc_id, sentence_index, {n_question('text')} AS normalized FROM doc_s"),
    "source_identity": "SELECT doc_id, sha256(encode('text') || unhex('00') || encode(coalesce(text, ''))) AS identity FROM documents",
    "sentences": chain("doc_s", "SELECT * FROM doc_s"),
    "paragraph_sentences": chain("para_s", "SELECT * FROM para_s"),
    "paged_sentences": chain("paged_s", "SELECT * FROM paged_s"),
    "context_subject": chain("both_subject", "SELECT doc_id, sentence_index, subject FROM both_subject"),
    "definition_candidates": chain("doc_defs", f"SELECT {_SHOWN} FROM doc_defs"),
    "pattern_candidates": chain("both_pats", f"SELECT {_SHOWN} FROM both_pats"),
    "relation_candidates": chain("rels", f"SELECT {_SHOWN}, subject, relation FROM rels"),
    "pos_candidates": chain("runs", f"SELECT {_SHOWN} FROM runs"),
    "relation_fragment_antijoin": chain("cand", f"SELECT {_SHOWN} FROM cand"),
    "candidate_frequency": chain("freq", "SELECT * FROM freq"),
    "tfidf_scores": chain("tfidf", "SELECT doc_id, sentence_index, normalized_text, round_even(tfidf, 6) AS tfidf FROM tfidf"),
    "dedup_candidates": chain("dedup", f"SELECT {_SHOWN}, frequency, importance_score FROM dedup"),
    "rank_candidates": chain("ranked", f"SELECT {_SHOWN}, importance_score, rank FROM ranked"),
    "diverse_candidates": chain("picked", f"SELECT {_SHOWN}, importance_score, pick FROM picked"),
    **{f"distractors_{d.lower()}": chain("pairs", _distractors(d)) for d in C.DIFFICULTIES},
    "fill_in_questions": chain("fill", "SELECT doc_id, question_id, prompt, correct_answer FROM fill"),
    "true_statements": chain("trues", "SELECT doc_id, question_id, prompt, correct_answer FROM trues"),
    "false_statements": chain("falses", "SELECT doc_id, question_id, prompt, correct_answer, distractor AS replaced_with FROM falses"),
    "prompt_highlight": chain("picked", f"SELECT doc_id, normalized_text, CASE WHEN len(ps) > 1 AND NOT contains(source_sentence, '<hl>') THEN 'generate question: ' || head || '<hl> ' || substr(source_sentence, length(head) + 1, length(text)) || ' <hl>' || substr(source_sentence, length(head) + length(text) + 1) || ' </s>' END AS prompt FROM (SELECT *, {plain('ps[1]')} AS head FROM (SELECT *, {parts('source_sentence', 'text')} AS ps FROM picked))"),
    "stems_antijoin": chain("picked", "SELECT p.doc_id, p.normalized_text FROM picked p WHERE NOT EXISTS (SELECT 1 FROM picked d WHERE d.doc_id = p.doc_id AND d.normalized_text = p.normalized_text AND d.candidate_type IN ('date/year', 'proper noun'))"),
    "validate_questions": chain("judged", "SELECT doc_id, question_id, array_to_string(errors, '|') AS errors, len(errors) = 0 AS is_valid FROM judged"),
    "quality_score": chain("valued", "SELECT doc_id, question_id, quality_score FROM valued"),
    "exact_duplicates": chain("judged", "SELECT doc_id, question_id, count(*) OVER (PARTITION BY doc_id, np) AS same_prompt, count(*) OVER (PARTITION BY doc_id, na, ns) AS same_fact FROM judged WHERE len(errors) = 0"),
    "quotas": f"""SELECT o_orderkey AS request_id, (generate_subscripts(ts, 1) - 1)::INT AS position, unnest(ts) AS question_type, (n // len(ts) + CASE WHEN generate_subscripts(ts, 1) - 1 < n % len(ts) THEN 1 ELSE 0 END)::INT AS quota
        FROM (SELECT o_orderkey, o_orderkey % 12 + 1 AS n, [{', '.join(map(q, C.QUESTION_TYPES))}][1:o_custkey % 4 + 1] AS ts FROM orders)""",
    "score_answers": chain("graded", "SELECT quiz_id, question_id, is_correct, status, normalized_user_answer FROM graded"),
    "score_quiz": chain("graded", f"SELECT *, round_even(correct * 100.0::DOUBLE / total, 2) AS percentage FROM (SELECT quiz_id, {_COUNTS} FROM graded GROUP BY quiz_id)"),
    "score_by_type": chain("graded", f"SELECT quiz_id, question_type, {_COUNTS}, list_position([{', '.join(map(q, C.QUESTION_TYPES))}], question_type)::INT AS type_order FROM graded GROUP BY quiz_id, question_type"),
    "review": chain("graded", "SELECT quiz_id, question_id, status, CASE WHEN length(prompt) <= 72 THEN prompt ELSE substr(prompt, 1, 69) || '…' END AS prompt_preview, CASE WHEN status = 'Unanswered' THEN 'No answer' ELSE coalesce(answer_text, CASE WHEN answer_bool THEN 'True' WHEN NOT answer_bool THEN 'False' END) END AS your_answer, correct_answer, source_sentence FROM graded"),
    "workflow_fold": """WITH RECURSIVE e AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, ['begin', 'complete', 'record', 'submit', 'reset'][event_id * 7 % 11 % 5 + 1] AS event, props AS payload FROM events),
        walk AS (
          SELECT DISTINCT session_id, 0::BIGINT AS i, 'CREATE' AS stage, NULL::VARCHAR AS answers, 0 AS steps, 0 AS rejected FROM e
          UNION ALL
          SELECT session_id, i, coalesce(nxt, stage), CASE WHEN nxt IS NULL THEN answers WHEN event IN ('record', 'submit') THEN payload WHEN event = 'reset' THEN NULL ELSE answers END, steps + (nxt IS NOT NULL)::INT, rejected + (nxt IS NULL)::INT FROM (
            SELECT w.session_id, e.i, w.stage, w.answers, w.steps, w.rejected, e.event, e.payload, CASE WHEN event = 'reset' THEN 'CREATE' WHEN event = 'begin' AND stage = 'CREATE' THEN 'GENERATING' WHEN event = 'complete' AND stage = 'GENERATING' THEN 'ATTEMPT'
              WHEN event = 'record' AND stage = 'ATTEMPT' THEN 'ATTEMPT' WHEN event = 'submit' AND stage = 'ATTEMPT' THEN 'REVIEW' END AS nxt FROM walk w JOIN e ON e.session_id = w.session_id AND e.i = w.i + 1))
        SELECT session_id, stage, answers, steps, rejected FROM walk QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY i DESC) = 1""",
    "topic_search_json": f"""SELECT url AS query, i::INT AS place, page_id + i AS page_id, 'Page ' || (page_id + i) AS title, 'about this & that' AS description, '{C.ARTICLE_BASE}Page_' || (page_id + i) AS article_url, NULL::VARCHAR AS error_code
        FROM pages, range(5) r(i) WHERE i <= CASE page_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 4 END""",
    "pdf_gate": "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 2 = 0 OR contains(substr(text, 1, 1024), '%PDF-') THEN NULL ELSE 'INVALID_PDF' END AS error_code FROM documents",
}
