"""Parameters of the quiz engine.

Fixed values: limits, weights, word lists and identifiers that results depend on are stated here as they must be.
"""

from __future__ import annotations

from dataclasses import dataclass

# Ingestion limits.
MIN_TEXT, MAX_TEXT = 50, 50_000
MIN_TOPIC, SEARCH_LIMIT, HTTP_SECONDS = 2, 5, 10
PDF_BYTES, PDF_PAGES = 10 * 1024 * 1024, 50
MIN_SENTENCE = 15
CHUNK_TARGET, CHUNK_OVERLAP = 240, 40

# Candidates.
CANDIDATE_MIN_CHARS, CANDIDATE_MAX_CHARS = 2, 80
CANDIDATE_MAX_TOKENS, RELATION_MAX_TOKENS = 5, 12
CANDIDATE_LIMIT = 12
COVERAGE_PENALTY, FREQUENCY_BONUS, SENTENCE_BONUS, LENGTH_PENALTY = 0.08, 0.05, 0.05, 0.02
STOPWORDS = (
    "a an and are as at be by for from he her him i in is it its me of on or our she that the their them they this to we with you your"
).split()

# Types of candidates with bonus, priority.
CANDIDATE_TYPES = {
    "proper noun": (0.16, 5),
    "noun phrase": (0.06, 3),
    "date/year": (0.12, 4),
    "quantity/percentage": (0.12, 4),
    "definition term": (0.25, 6),
    "general concept": (0.0, 2),
    "relation phrase": (0.22, 7),
}
CONCEPT_TYPES = ("definition term", "noun phrase", "general concept")

# Questions.
QUESTION_TYPES = ("Multiple Choice", "True/False", "Fill-in-the-Blank", "Short Answer")
DIFFICULTIES = ("Easy", "Medium", "Hard")
BLANK = "________"
QUESTION_MIN, QUESTION_MAX = 12, 240
CHOICE_SEED = 17
QUIZ_MIN, QUIZ_MAX = 1, 12
CANDIDATES_ATTEMPTED = STEMS_ATTEMPTED = 24
NEAR_DUPLICATE, QUALITY_CUTOFF, COVERAGE_BONUS = 0.82, 0.55, 0.08
OVERLAP, OVERLAP_TOKENS = 0.8, 2
STEM_SIMILARITY = 0.85
QUESTION_NAMESPACE = "82d42780-60ca-4ecf-a293-8d628d96e6da"
QUIZ_NAMESPACE = "1dafb7f2-7432-42cb-9b18-5cb76dc52e1f"
ARTIFACTS = ("<hl>", "</s>", "generate question:")

# Question generation.
MODEL_ID = "valhalla/t5-base-qa-qg-hl"
CONTEXT_TOKENS = 416
BEAMS, NEW_TOKENS, PREVIEW = 4, 64, 3
ARTICLE_BASE = "https://en.wikipedia.org/wiki/"


@dataclass(frozen=True)
class Settings:
    """What a deployment may set."""

    min_text: int = MIN_TEXT
    max_text: int = MAX_TEXT
    pdf_bytes: int = PDF_BYTES
    pdf_pages: int = PDF_PAGES
    min_sentence: int = MIN_SENTENCE
    chunk_target: int = CHUNK_TARGET
    chunk_overlap: int = CHUNK_OVERLAP
    candidate_limit: int = CANDIDATE_LIMIT
    context_tokens: int = CONTEXT_TOKENS
    preview: int = PREVIEW
    choice_seed: int = CHOICE_SEED


@dataclass(frozen=True)
class StemSettings:
    beams: int = BEAMS
    new_tokens: int = NEW_TOKENS
    context_tokens: int = CONTEXT_TOKENS
    limit: int = PREVIEW

    def __post_init__(self):
        if self.context_tokens < 1:
            raise ValueError("max_tokens must be at least 1.")
        if self.limit < 1:
            raise ValueError("preview_limit must be at least 1.")
