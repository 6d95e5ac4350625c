"""A controlled vocabulary from descriptor records, and the terms of it that queries name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


MOST_WORDS = 5
LEAST_LENGTH = 3

#: Acronym-shaped tokens and capitalized words that name nothing, instrument nouns.
ACRONYM_STOPS = ["AND", "THE", "FOR", "WAS", "WERE", "WHAT", "HOW", "WHY", "WHEN", "ICU", "ER", "OR", "PT", "US", "UK", "USA", "I", "II", "III", "IV", "V", "VI", "NO", "YES", "OK", "TV", "PC", "ID", "AM", "PM"]
LEAD_STOPS = ["what", "which", "who", "when", "where", "how", "why", "the", "these", "those", "this", "that", "any", "other", "another", "diagnostic", "imaging", "lab", "laboratory", "blood", "urine", "clinical", "scale", "score", "follow", "screening", "routine", "initial", "final", "first", "second", "third", "further", "additional", "special", "standard"]
MEASURES = "scale|score|angle|grade|grading|index|classification|criteria|stage|staging|sign|test|maneuver|manoeuvre|ratio|scoring"

#: General descriptors that count as no entity.
GENERIC_TERMS = [
    "patients", "patient care", "patient discharge", "patient admission", "hospitalization", "hospitals", "hospital units", "aftercare",
    "length of stay", "ambulatory care", "critical care", "nursing care", "postoperative care", "preoperative care", "perioperative care",
    "intraoperative care", "terminal care", "primary health care", "delivery of health care", "continuity of patient care",
    "patient readmission", "patient transfer", "referral and consultation", "follow-up studies", "convalescence", "recovery of function",
    "treatment outcome", "outcome assessment, health care", "prognosis", "disease progression", "remission induction", "recurrence",
    "health status", "disease management", "symptom assessment", "signs and symptoms", "diagnosis", "diagnosis, differential",
    "physical examination", "medical history taking", "vital signs", "clinical deterioration", "disease attributes",
    "therapeutics", "surgical procedures, operative", "general surgery", "drug therapy", "combined modality therapy",
    "medication therapy management", "pharmaceutical preparations", "prescriptions", "self care", "patient education as topic", "counseling",
    "pain", "fever", "surgery", "treatment", "care", "therapy", "symptoms", "outcome", "recovery", "admission", "discharge",
    "complications", "procedure", "medication", "medications", "examination", "findings", "history", "management", "plan", "condition", "status",
    "birth", "death", "life", "time", "hours", "months", "years", "day", "weight", "growth", "sleep", "diet", "exercise", "family", "home",
    "work", "risk", "safety", "quality of life", "physicians", "nurses", "caregivers", "parents", "mothers", "fathers", "child", "infant",
    "adult", "aged", "adolescent", "male", "female", "humans", "men", "women", "role", "affect", "address", "health", "disease", "pressure",
    "back", "attention", "control", "reference values", "records", "reports", "physical functional performance", "activities of daily living",
]

#: Labels of the disease branches.
BRANCHES = {
    "C01": "Infections", "C04": "Neoplasms", "C05": "Musculoskeletal", "C06": "Digestive", "C07": "Stomatognathic", "C08": "Respiratory",
    "C09": "Otorhinolaryngologic", "C10": "Nervous System", "C11": "Eye", "C12": "Urogenital", "C14": "Cardiovascular", "C15": "Hemic & Lymphatic",
    "C16": "Congenital/Neonatal", "C17": "Skin & Connective Tissue", "C18": "Nutritional & Metabolic", "C19": "Endocrine", "C20": "Immune System",
    "C21": "Environmentally Induced", "C22": "Animal Diseases", "C23": "Pathological Conditions", "C25": "Chemically-Induced", "C26": "Wounds & Injuries",
}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row (``value``) for each record of a descriptor file; bytes that are no UTF-8 come replaced."""
    return spark.read.option("lineSep", "*NEWRECORD").text(path)


def parsed_records(records: DataFrame) -> DataFrame:
    """(preferred, tree_numbers, entry_terms) of records with a preferred term; values end at the first bar."""
    lines = F.filter(F.split("value", r"\r?\n"), lambda line: F.contains(line, F.lit(" = ")))
    pairs = F.transform(lines, lambda line: F.struct(F.substring_index(line, " = ", 1).alias("k"), F.trim(F.substring_index(F.regexp_replace(line, "^.*? = ", ""), "|", 1)).alias("v")))
    pairs = F.filter(pairs, lambda p: p["v"] != "")

    def of(*keys: str):
        return F.transform(F.filter(F.col("pairs"), lambda p: p["k"].isin(*keys)), lambda p: p["v"])

    out = records.select(pairs.alias("pairs")).select(F.try_element_at(of("MH"), F.lit(-1)).alias("preferred"), of("MN").alias("tree_numbers"), of("ENTRY", "PRINT ENTRY").alias("entry_terms"))
    return out.filter("preferred IS NOT NULL")


def variants(term):
    """Lower-case reading of a term, and the one with its comma-separated parts reversed."""
    low = F.trim(F.lower(term))
    parts = F.filter(F.transform(F.split(low, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.filter(F.array_distinct(F.array(low, F.when(F.size(parts) > 1, F.array_join(F.reverse(parts), " ")).otherwise(low))), lambda x: x != "")


def vocabulary(parsed: DataFrame, least: int = LEAST_LENGTH, generic: list[str] = GENERIC_TERMS) -> DataFrame:
    """(term, n_words, tree_numbers): all readings of all names; a generic preferred term takes its whole record away."""
    block = F.array(*map(F.lit, generic))
    kept = parsed.filter(~F.arrays_overlap(variants(F.col("preferred")), block))
    names = kept.select("tree_numbers", F.explode(F.array_distinct(F.flatten(F.transform(F.concat(F.array("preferred"), "entry_terms"), variants)))).alias("term"))
    names = names.filter(~F.array_contains(block, F.col("term")) & (F.length("term") >= least))
    return names.groupBy("term").agg(F.array_sort(F.flatten(F.collect_list("tree_numbers"))).alias("tree_numbers")).withColumn("n_words", F.size(F.split("term", " ")))


#: The shapes of names that need no vocabulary.
TOKEN = r"[\p{L}\p{N}_]+"
EPONYM = r"(?<![\p{L}\p{N}_])[A-Z][a-z]{2,}-[A-Z][a-z]{2,}(?![\p{L}\p{N}_])"
MEASURE = rf"(?<![\p{{L}}\p{{N}}_])[A-Z][A-Za-z]{{2,}}(?:-[A-Z][A-Za-z]{{2,}})?\s+(?:{MEASURES})s?(?![\p{{L}}\p{{N}}_])"
PHRASE_TOKEN = r"[a-z0-9]+(?:[-'][a-z0-9]+)*"


def found_terms(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(query_id, term, place): names in each query in order of kind (acronym, eponym, instrument, phrases from long to
    short, single words), each once whatever its case. A lead word is looked up with and without its final s."""
    own = queries.select("query_id", "query").filter("query IS NOT NULL")

    def shaped(kind: int, values):
        return own.select("query_id", F.lit(kind).alias("kind"), F.posexplode(values).alias("at", "term"))

    q = F.col("query")
    lead = lambda m: F.lower(F.regexp_extract(m, r"^[A-Za-z]+", 0))
    acronyms = F.filter(F.regexp_extract_all(q, F.lit(TOKEN), F.lit(0)), lambda w: w.rlike("^[A-Z][A-Z0-9]{1,7}$") & ~w.isin(ACRONYM_STOPS))
    measures = F.filter(F.regexp_extract_all(q, F.lit(MEASURE), F.lit(0)), lambda m: ~lead(m).isin(LEAD_STOPS) & ~F.regexp_replace(lead(m), "s+$", "").isin(LEAD_STOPS))
    names = shaped(0, acronyms).unionByName(shaped(1, F.regexp_extract_all(q, F.lit(EPONYM), F.lit(0)))).unionByName(shaped(2, measures))

    tokens = own.select("query_id", F.regexp_extract_all(F.lower(q), F.lit(PHRASE_TOKEN), F.lit(0)).alias("w"))
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.size("w"), F.lit(MOST_WORDS))))
    grams = tokens.filter("size(w) > 0").select("query_id", "w", sizes.alias("n"))
    grams = grams.select("query_id", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))).alias("at", "term"))
    words = vocab.select("term", F.when(F.col("n_words") == 1, 1).otherwise(0).alias("single"))
    phrases = grams.join(words, "term").filter((F.col("n") > 1) | (F.col("single") == 1)).select("query_id", (F.lit(10) - F.col("n")).alias("kind"), "at", "term")
    first = names.unionByName(phrases).groupBy("query_id", F.lower("term").alias("low")).agg(F.min(F.struct("kind", "at", "term")).alias("first"))
    return first.select("query_id", F.col("first.term").alias("term"), (F.col("first.kind") * 100000 + F.col("first.at")).alias("place"))


def topic_coverage(terms: DataFrame, vocab: DataFrame, top: int = 18) -> DataFrame:
    """(code, label, n): most frequent disease branches of (id, term) rows, each branch once an id; ``top`` is the report's length."""
    codes = vocab.select(F.col("term").alias("low"), F.explode("tree_numbers").alias("number")).filter(F.col("number").startswith("C") & (F.length("number") >= 3))
    hits = terms.withColumn("low", F.lower("term")).join(codes, "low").select("query_id", F.substring("number", 1, 3).alias("code")).distinct()
    labels = F.coalesce(*(F.when(F.col("code") == c, F.lit(name)) for c, name in BRANCHES.items()), F.col("code"))
    return hits.groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(top).select("code", labels.alias("label"), "n")


def numbers_of(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """(query_id, number): the distinct tree numbers of the terms of each id."""
    own = vocab.select(F.col("term").alias("low"), F.explode("tree_numbers").alias("number"))
    return terms.withColumn("low", F.lower("term")).join(own, "low").select("query_id", "number").distinct()


def categories(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """(query_id, categories, subcategories) as JSON lists in order: first letters of the tree numbers, and the first three
    characters of those in the disease and anatomy trees."""
    number = F.col("number")
    sub = F.when(number.substr(1, 1).isin("A", "C") & (F.length("number") >= 3), number.substr(1, 3))
    return numbers_of(terms, vocab).groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_set(number.substr(1, 1)))).alias("categories"), F.to_json(F.array_sort(F.collect_set(sub))).alias("subcategories"))


def uncovered(ids: DataFrame, terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """(n_passages, n_uncovered): rows of ``ids`` (query_id) in all, and those with no term in the disease or anatomy trees."""
    hit = numbers_of(terms, vocab).filter(F.col("number").substr(1, 1).isin("A", "C") & (F.length("number") >= 3)).select("query_id", F.lit(True).alias("hit")).distinct()
    return ids.join(hit, "query_id", "left").agg(F.count("*").alias("n_passages"), F.count_if(F.col("hit").isNull()).alias("n_uncovered"))
