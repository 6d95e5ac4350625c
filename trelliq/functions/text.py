"""Text rules as column expressions. The patterns spell out Unicode classes, so Java and RE2 read them alike."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Unicode has it, letters and digits, ASCII punctuation.
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LETTER = r"[\p{L}\p{N}_]"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
START, END = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def whole(alternatives: str) -> str:
    """Pattern of the alternatives as whole words."""
    return f"{START}(?:{alternatives}){END}"


#: Word lists of the rules below.
PATIENT_REFERENCE = whole("the patient'?s?|his|her")
GENERIC_OUTCOME = whole("outcome|condition|fare|result|after|following")
SEED_ENTITY = whole("mg|ml|therapy|syndrome|scale|score|surgery|diagnosis|treatment|disease|infection|tumor|cancer|fracture|artery|vein|nerve|biopsy|lesion|carcinoma|virus|bacteria|antibiotic|chemotherapy|radiotherapy")
REFERRING = whole("the patient'?s?|this patient|the above|the case|his|her|him|their|they")
UNDERSPECIFIED = whole("outcome|condition|fare|result|after|following|prognosis|follow[- ]?up|history|status")
DEFINITE_REFERENCES = [
    ("the_patient", f"{START}the{SPACE}+patient(?:{END}|s['’]{LETTER})"),
    ("this_patient", f"{START}(?:this|that|our){SPACE}+patient{END}"),
    ("bare_patient_poss", f"^{SPACE}*patient['’]s{END}"),
    ("the_case_subject", f"{START}the{SPACE}+(?:man|woman|boy|girl|infant|baby|neonate|child){END}"),
    ("poss_pronoun", f"{START}(?:his|her|their){SPACE}+[a-z]"),
    ("subject_pronoun", f"{START}(?:he|she){SPACE}+(?:was|were|is|had|has|did|received|underwent){END}"),
]
QUESTION_START = f"^{SPACE}*(?:what|how|why|when|where|which|who|does|is|are|can|was|were){END}"
QUESTION_WORDS = ["what", "how", "why", "when", "where", "which", "who", "is", "are", "was", "were", "does", "do", "did", "can", "should", "would", "will"]
STOPWORDS = ["the", "a", "an", "of", "in", "on", "for", "and", "or", "to", "is", "was", "were", "with", "at", "by", "from", "that", "this", "what", "how", "did", "does", "patient", "patients"]
TRUE_LABELS = ["1", "1.0", "true", "yes", "y"]


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return text.isNull() | ~text.rlike(f"[^{SPACE[1:]}")  # ends at the first other character


def n_tokens(text: Column) -> Column:
    """Number of tokens between white space; 0 for null and blank texts."""
    return F.when(blank(text), 0).otherwise(F.size(F.split(trimmed(text), f"{SPACE}+")))


def n_words(text: Column) -> Column:
    """Number of runs of letters, digits and underscores; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"{LETTER}+"), F.lit(0))), F.lit(0))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def compatible(text: Column) -> Column:
    """NFKC; only texts beyond ASCII go through Python."""
    ascii_only = text.rlike(r"^[\x00-\x7f]*$")
    return F.when(ascii_only, text).otherwise(nfkc(F.when(~ascii_only, text)))


def without_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def matching_form(text: Column) -> Column:
    """NFKC, lower case, ASCII punctuation deleted, white space collapsed."""
    return F.trim(F.regexp_replace(without_punctuation(F.lower(compatible(text))), f"{SPACE}+", " "))


def query_form(text: Column) -> Column:
    """Lower case, each run of anything but a-z and 0-9 one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def has(text: Column, pattern: str) -> Column:
    return F.lower(text).rlike(pattern)


def definite_reference(text: Column) -> Column:
    """Name of the first definite reference in order of priority, or null."""
    return F.coalesce(*(F.when(has(text, p), F.lit(name)) for name, p in DEFINITE_REFERENCES))


def is_question(text: Column) -> Column:
    """A question word at the start, or a question mark at the end."""
    return has(text, QUESTION_START) | F.endswith(trimmed(text), F.lit("?"))


def query_type(text: Column) -> Column:
    """'question' or 'keyword' by the exact first token."""
    first = F.get(F.split(F.lower(trimmed(text)), f"{SPACE}+"), F.lit(0))
    return F.when(F.endswith(trimmed(text), F.lit("?")) | first.isin(QUESTION_WORDS), "question").otherwise("keyword")


def content_tokens(text: Column) -> Column:
    """Distinct tokens longer than two characters that are no stop words, punctuation deleted."""
    tokens = F.split(without_punctuation(F.lower(text)), f"{SPACE}+")
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(STOPWORDS)))


def jaccard_overlap(query: Column, passage: Column) -> Column:
    a, b = content_tokens(query), content_tokens(passage)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def ascii_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def containment_overlap(query: Column, passage: Column) -> Column:
    """Share of the query's tokens that the passage has; 0 without tokens."""
    q = ascii_tokens(query)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, ascii_tokens(passage))), F.size(q)), F.lit(0.0))


def true_label(label: Column) -> Column:
    return F.coalesce(F.lower(F.trim(label.cast("string"))).isin(TRUE_LABELS), F.lit(False))
