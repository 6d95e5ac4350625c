"""Contentless positives, context-dependent queries, query style and overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trelliq.functions import text as t


def degenerate_passages(corpus: DataFrame, least: int = 6) -> DataFrame:
    """(id, n_tokens) of passages with fewer than ``least`` tokens between white space."""
    return corpus.select("id", t.n_tokens(F.col("text")).alias("n_tokens")).filter(F.col("n_tokens") < least)


def degenerate_cascade(queries: DataFrame, corpus: DataFrame, least: int = 6) -> DataFrame:
    """(query_id, pos_id, n_positives) of queries that keep a positive with content; pos_id is the first one left."""
    bad = degenerate_passages(corpus, least).select(F.col("id").alias("pos"))
    left = queries.select("query_id", F.explode("alt_pos_ids").alias("pos")).join(bad, "pos", "left_anti")
    return left.groupBy("query_id").agg(F.min("pos").alias("pos_id"), F.count("*").alias("n_positives"))


def with_content(rows: DataFrame, least: int = 8) -> DataFrame:
    """Rows whose positive text has ``least`` words or more."""
    return rows.filter(t.n_words(F.col("pos")) >= least)


def anaphoric_flags(queries: DataFrame) -> DataFrame:
    """(query_id, eda, notebook): the two rules that need no vocabulary."""
    q = F.col("query")
    eda = t.has(q, t.PATIENT_REFERENCE) & t.has(q, t.GENERIC_OUTCOME) & ~t.has(q, t.SEED_ENTITY)
    notebook = t.has(q, t.REFERRING) & t.has(q, t.UNDERSPECIFIED) & ~t.has(q, t.SEED_ENTITY)
    return queries.select("query_id", eda.alias("eda"), notebook.alias("notebook"))


def anaphoric_by_vocabulary(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, matched_pattern, n_terms, is_anaphoric, is_generic); ``terms`` has (query_id, n_terms)."""
    joined = queries.select("query_id", t.definite_reference(F.col("query")).alias("matched_pattern")).join(terms.select("query_id", "n_terms"), "query_id", "left")
    none = F.coalesce("n_terms", F.lit(0)) == 0
    flag = F.col("matched_pattern").isNotNull() & none
    return joined.select("query_id", "matched_pattern", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), flag.alias("is_anaphoric"), (none & ~flag).alias("is_generic"))


def anaphoric_report(flags: DataFrame) -> DataFrame:
    """(pattern, n, flagged, saved) by first matched pattern; queries without one under 'none'."""
    return flags.groupBy(F.coalesce("matched_pattern", F.lit("none")).alias("pattern")).agg(
        F.count("*").alias("n"), F.count_if("is_anaphoric").alias("flagged"), F.count_if(F.col("matched_pattern").isNotNull() & ~F.col("is_anaphoric")).alias("saved")
    )


def agreement(pairs: DataFrame) -> DataFrame:
    """Confusion counts and precision, recall, f1, accuracy of (label, predicted); an empty denominator gives 0."""
    c = pairs.agg(*(F.count_if((F.col("label") == a) & (F.col("predicted") == b)).alias(n) for n, a, b in (("tp", True, True), ("fp", False, True), ("fn", True, False), ("tn", False, False))))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def seeded(seed: int, *parts: str):
    """A hash of the parts that every engine computes alike; ranks by it are seeded permutations."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def stratified_sample(flags: DataFrame, flag: str, per_stratum: int, seed: int = 42) -> DataFrame:
    """(query_id, flag): the first ``per_stratum`` of each stratum in seeded order."""
    nth = F.row_number().over(Window.partitionBy(flag).orderBy("h", "query_id"))
    return flags.withColumn("h", seeded(seed, "query_id")).withColumn("nth", nth).filter(F.col("nth") <= per_stratum).select("query_id", flag)


def entity_flags(queries: DataFrame, terms: DataFrame | None = None, detect=None) -> tuple[DataFrame, str]:
    """((query_id, has_entity), source) by the best detector at hand.

    ``detect`` (a column expression over the query, such as a model's UDF) comes first, then ``terms`` found in queries
    (query_id, term) by a gazetteer, then the seed words. Rates of different sources are not to be compared.
    """
    if detect is not None:
        return queries.select("query_id", F.coalesce(detect(F.col("query")), F.lit(False)).alias("has_entity")), "model"
    if terms is not None:
        named = terms.select("query_id", F.lit(True).alias("named")).distinct()
        return queries.select("query_id").join(named, "query_id", "left").select("query_id", F.coalesce("named", F.lit(False)).alias("has_entity")), "gazetteer"
    return queries.select("query_id", F.coalesce(t.has(F.col("query"), t.SEED_ENTITY), F.lit(False)).alias("has_entity")), "seed words (not validated)"


#: Mentions that a detector may find but that name nothing.
NO_ENTITY = [
    "patient", "patients", "condition", "conditions", "outcome", "outcomes", "symptom", "symptoms", "treatment", "treatments", "therapy", "therapies", "diagnosis", "disease", "illness",
    "medication", "medications", "drug", "drugs", "hospital", "discharge", "admission", "procedure", "surgery", "operation", "history", "followup", "follow up", "care", "doctor",
    "physician", "clinician", "test", "tests", "result", "results", "management", "complication", "complications", "case", "study", "report", "problem", "problems",
]


def gazetteer_hits(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, term): the terms (in matching form) that stand in a query's matching form as whole words.

    Runs of words as long as the longest term are looked up by hash; what is found is then compared as it stands."""
    forms = queries.select("query_id", t.matching_form(F.col("query")).alias("form")).filter("form IS NOT NULL")
    words = F.regexp_extract_all("form", F.lit(f"{t.LETTER}+"), F.lit(0))
    own = terms.select("term", F.array_join(F.regexp_extract_all("term", F.lit(f"{t.LETTER}+"), F.lit(0)), " ").alias("run"), F.size(F.regexp_extract_all("term", F.lit(f"{t.LETTER}+"), F.lit(0))).alias("n")).filter("n > 0")
    sizes = own.select("n").distinct()
    runs = forms.withColumn("w", words).crossJoin(F.broadcast(sizes)).filter("size(w) >= n")  # as many rows as terms have lengths
    runs = runs.select("query_id", "form", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " ")))).alias("run"))
    return runs.join(own, "run").filter(F.contains("form", F.col("term"))).select("query_id", "term").distinct()


def anaphoric_by_gazetteer(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, has_entity, is_anaphoric): the notebook rule with the gazetteer as its detector (see ``entity_flags``)."""
    flags, _ = entity_flags(queries, gazetteer_hits(queries, terms))
    q = F.col("query")
    joined = queries.select("query_id", "query").join(flags, "query_id")
    return joined.select("query_id", "has_entity", (t.has(q, t.REFERRING) & t.has(q, t.UNDERSPECIFIED) & ~F.col("has_entity")).alias("is_anaphoric"))


def label_scores(labels: DataFrame) -> DataFrame:
    """(variant, n_labeled, tp, fp, fn, tn, precision, recall, f1, accuracy) of (predicted, label), text cells as a label file has
    them; blank labels are left out, rates have four digits, halves to even. An empty denominator gives 0 in the row
    'zero' and null in the row 'undefined'."""
    rows = labels.filter(F.trim("label") != "").select(t.true_label(F.col("label")).alias("label"), F.coalesce(F.lower("predicted") == "true", F.lit(False)).alias("predicted"))
    c = rows.agg(F.count("*").alias("n_labeled"), *(F.count_if((F.col("label") == a) & (F.col("predicted") == b)).alias(n) for n, a, b in (("tp", True, True), ("fp", False, True), ("fn", True, False), ("tn", False, False))))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    c = c.withColumns({"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "accuracy": F.try_divide(tp + tn, F.col("n_labeled"))})
    c = c.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    rates = ["precision", "recall", "f1", "accuracy"]
    counts = ["n_labeled", "tp", "fp", "fn", "tn"]
    zero = c.select(F.lit("zero").alias("variant"), *counts, *(F.coalesce(F.bround(r, 4), F.lit(0.0)).alias(r) for r in rates))
    return zero.unionByName(c.select(F.lit("undefined").alias("variant"), *counts, *(F.bround(r, 4).alias(r) for r in rates)))


def anaphoric_summary(flags: DataFrame) -> DataFrame:
    """(n, n_referring, n_flagged, flagged_rate, n_saved, entity_rate, n_generic) of the flags of ``anaphoric_by_vocabulary``."""
    n, flagged, referring = F.count("*"), F.count_if("is_anaphoric"), F.count("matched_pattern")
    return flags.agg(
        n.alias("n"), referring.alias("n_referring"), flagged.alias("n_flagged"), F.round(F.try_divide(flagged, n), 6).alias("flagged_rate"), (referring - flagged).alias("n_saved"),
        F.round(F.try_divide(F.count_if(F.col("n_terms") > 0), n), 6).alias("entity_rate"), F.count_if("is_generic").alias("n_generic"),
    )


def refilled_sample(flags: DataFrame, flag: str, n: int, seed: int = 42) -> DataFrame:
    """(query_id, flag): up to half of ``n`` flagged rows in seeded order, and unflagged ones until there are ``n``."""
    both = stratified_sample(flags, flag, n, seed)  # at most 2n rows
    nth = F.row_number().over(Window.partitionBy(flag).orderBy(seeded(seed, "query_id"), "query_id"))
    taken = F.least(F.lit(n // 2), F.count_if(flag).over(Window.partitionBy()))
    return both.withColumn("nth", nth).withColumn("taken", taken).filter(F.when(F.col(flag), F.col("nth") <= n // 2).otherwise(F.col("nth") <= F.lit(n) - F.col("taken"))).select("query_id", flag)


def content_stats(rows: DataFrame, least: int = 8) -> DataFrame:
    """(n_before, n_dropped, n_after) of dropping positives with fewer than ``least`` words."""
    short = t.n_words(F.col("pos")) < least
    return rows.agg(F.count("*").alias("n_before"), F.count_if(short).alias("n_dropped"), F.count_if(~short).alias("n_after"))


def content_examples(rows: DataFrame, n: int, least: int = 8) -> DataFrame:
    """(query_id, pos, n_words) of ``n`` rows that ``with_content`` drops, in the order of their id."""
    return rows.select("query_id", "pos", t.n_words(F.col("pos")).alias("n_words")).filter(F.col("n_words") < least).orderBy("query_id").limit(n)
