"""Text rules on sentences made for them, with the results written out by hand."""

import pytest
from pyspark.sql import functions as F

from trelliq.functions import text as t
from trelliq.functions.encoders import hashed, hashed_vectors

#: text: tokens, words, matching form, query form, first definite reference, question mark or start, first word asks, content tokens.
CASES = {
    "Where did the patient travel?": (5, 5, "where did the patient travel", "where did the patient travel", "the_patient", True, True, ["where", "travel"]),
    "signs in the  patients' notes": (5, 5, "signs in the patients notes", "signs in the patients notes", None, False, False, ["signs", "notes"]),
    "The patient\u2019s knee": (3, 4, "the patient\u2019s knee", "the patient s knee", "the_patient", False, False, ["patient\u2019s", "knee"]),
    "our patient, again": (3, 3, "our patient again", "our patient again", "this_patient", False, False, ["our", "again"]),
    "other patients of ours": (4, 4, "other patients of ours", "other patients of ours", None, False, False, ["other", "ours"]),
    "  patient's gait today": (3, 4, "patients gait today", "patient s gait today", "bare_patient_poss", False, False, ["gait", "today"]),
    "which ward took the  NEONATE": (5, 5, "which ward took the neonate", "which ward took the neonate", "the_case_subject", True, True, ["which", "ward", "took", "neonate"]),
    "the manual and her notes": (5, 5, "the manual and her notes", "the manual and her notes", "poss_pronoun", False, False, ["manual", "her", "notes"]),
    "whether he had slept": (4, 4, "whether he had slept", "whether he had slept", "subject_pronoun", False, False, ["whether", "had", "slept"]),
    "theirs, not ours": (3, 3, "theirs not ours", "theirs not ours", None, False, False, ["theirs", "not", "ours"]),
    "who's on call": (3, 4, "whos on call", "who s on call", None, True, False, ["whos", "call"]),
    "Should one wait": (3, 3, "should one wait", "should one wait", None, False, True, ["should", "one", "wait"]),
    "canal width": (2, 2, "canal width", "canal width", None, False, False, ["canal", "width"]),
    "Caf\u00e9 \ufb01le\u2026 x_y-z": (3, 4, "caf\u00e9 file xyz", "caf le x y z", None, False, False, ["caf\u00e9", "\ufb01le\u2026", "xyz"]),
    "": (0, 0, "", "", None, False, False, []),
    " \u00a0 ": (0, 0, "", "", None, False, False, []),
    None: (0, 0, None, None, None, None, None, None),
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(CASES)], "i int, x string")
    x = t.F.col("x")
    columns = [t.n_tokens(x), t.n_words(x), t.matching_form(x), t.query_form(x), t.definite_reference(x), t.is_question(x), t.query_type(x) == "question", t.content_tokens(x)]
    return {r["i"]: tuple(r)[1:] for r in df.select("i", *(c.alias(f"c{n}") for n, c in enumerate(columns))).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rules(found, i):
    x, wanted = list(CASES.items())[i]
    if x is None:
        assert found[i][:5] == wanted[:5] and found[i][7] is None
    else:
        assert found[i] == wanted


def test_true_labels(spark):
    given = [("1", True), ("1.0", True), ("Yes", True), (" y ", True), ("true", True), ("0", False), ("", False), (None, False), ("no", False)]
    df = spark.createDataFrame(given, "x string, want boolean")
    assert df.filter(t.true_label(t.F.col("x")) != t.F.col("want")).count() == 0


def test_encoder(spark):
    df = spark.createDataFrame([("a", "one two"), ("b", ""), ("c", "two one")], "key string, text string").repartition(2)
    rows = {r["key"]: r["embedding"] for r in hashed(df, 16).collect()}
    assert rows["a"] == rows["c"] == hashed_vectors(["one two"], 16)[0].tolist() and not any(rows["b"])


def test_blank_texts_and_matching_forms_at_every_white_space(spark):
    points = [c for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(chr(c), f"{chr(c)} {chr(c)}", f"{chr(c)}A  b{chr(c)}") for c in points], "one string, run string, text string")
    same = [(t.blank(F.col(x)) == (t.trimmed(F.col(x)) == "")).alias(x) for x in ("one", "run", "text")]
    found = rows.select(*same, (t.matching_form(F.col("text")) == t.trimmed(t.matching_form(F.col("text")))).alias("form"), t.blank(F.col("one")).alias("is_blank")).collect()
    assert all(r["one"] and r["run"] and r["text"] and r["form"] for r in found) and sum(r["is_blank"] for r in found) == 29
