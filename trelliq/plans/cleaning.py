"""Queries of the cleaning half: counts, defects, duplicates, texts, filters, vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trelliq.functions import text as t
from trelliq.operators import dedup, eda, filters, integrity, negatives, vocab
from trelliq.plans import sql as s
from trelliq.session import new_place, written
from trelliq.sources import readers, writers
from trelliq.sources.tables import table

#: Descriptor records in the words of the tables: inverted, generic, with synonyms, without a preferred term.
RECORDS = """
MH = Velaromegaly
MN = C10.597.622
PRINT ENTRY = Velar Enlargement|T047|NON
ENTRY = Scaphelopathy|T047
*NEWRECORD
MH = Nephrelitis, Cavolous
MN = C12.777.419
MN = C23.550.470
ENTRY = Galvaremia
*NEWRECORD
MH = Drug Therapy
MN = E02.319
ENTRY = Pharmacotherapy
*NEWRECORD
MN = C04.557
ENTRY = Nameless Growth
*NEWRECORD
MH = Brachocele
MN = A01.236
MN = C05.116
ENTRY = Tibreloma|x|y
ENTRY = Fundulosis
*NEWRECORD
MH = Pain
MN = C23.888
ENTRY = Ache"""


def load(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [table(spark, folder, n) for n in names]


def load_counts(spark, folder):
    out = None
    for name in ("corpus", "merged", "negative_scores", "split_rows", "documents"):
        one = table(spark, folder, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def count_guard(spark, folder):
    """Queries and passages against the counts a loader expects."""
    corpus, merged = load(spark, folder, "corpus", "merged")
    expected = [("corpus", "ids", corpus.agg(F.countDistinct("id").alias("a"), F.count("*").alias("b"))), ("merged", "query_ids", merged.agg(F.countDistinct("query_id").alias("a"), F.count("*").alias("b")))]
    rows = [df.select(F.lit(n).alias("name"), F.lit(u).alias("unit"), F.col("a").alias("n_distinct"), F.col("b").alias("n_rows"), (F.col("a") == F.col("b")).alias("as_expected")) for n, u, df in expected]
    return rows[0].unionByName(rows[1])


def kept(spark, folder) -> DataFrame:
    corpus, merged = load(spark, folder, "corpus", "merged")
    return integrity.drop_defects(merged, corpus)


def cleaned(spark, folder) -> DataFrame:
    return integrity.clean_edges(kept(spark, folder), table(spark, folder, "corpus"))


def merged_groups(spark, folder) -> tuple[DataFrame, DataFrame]:
    rows = kept(spark, folder)
    return dedup.consolidated(rows, integrity.clean_edges(rows, table(spark, folder, "corpus")))


def assigned(spark, folder) -> DataFrame:
    """Kept rows with the split that ``split_rows`` gives them."""
    splits = table(spark, folder, "split_rows").filter("split IS NOT NULL").select("query_id", "split").distinct()
    return kept(spark, folder).join(splits, "query_id")


def defect_masks(spark, folder):
    corpus, merged = load(spark, folder, "corpus", "merged")
    return integrity.defect_summary(merged, corpus).withColumn("rate", F.round("rate", 9))


def orphan_negatives(spark, folder):
    corpus, merged = load(spark, folder, "corpus", "merged")
    return integrity.orphan_negatives(merged, corpus)


def drop_defects(spark, folder):
    return kept(spark, folder).select("query_id", "query", "pos_id")


def clean_negatives(spark, folder):
    e = cleaned(spark, folder)
    return e.groupBy("query_id").agg(F.count("*").alias("n"), integrity.in_order("neg_id", "place").alias("neg_ids"))


def self_negative_edges(spark, folder):
    return integrity.edges(kept(spark, folder), "query_id", "pos_id").filter("neg_id = pos_id").select("query_id", "neg_id", "place")


def passage_canonical(spark, folder):
    return dedup.canonical_passages(table(spark, folder, "corpus"))


def passage_dup_stats(spark, folder):
    return dedup.passage_duplicates(table(spark, folder, "corpus"))


def remap_negatives(spark, folder):
    return dedup.remapped_edges(kept(spark, folder), table(spark, folder, "corpus")).select("query_id", "pos_id", "place", "neg_id")


def query_dup_stats(spark, folder):
    return dedup.query_duplicates(kept(spark, folder))


def consolidate_queries(spark, folder):
    queries, negatives = merged_groups(spark, folder)
    lists = negatives.groupBy("query_id").agg(integrity.in_order("neg_id", "rank").alias("neg_ids"))
    return queries.join(lists, "query_id", "left").select("query_id", "query", "pos_id", F.to_json("alt_pos_ids").alias("alt_pos_ids"), F.coalesce("neg_ids", F.lit("[]")).alias("neg_ids"))


def exact_dup_groups(spark, folder):
    return dedup.exact_groups(assigned(spark, folder))


def resolve_straddlers(spark, folder):
    return dedup.straddlers(assigned(spark, folder))


def length_stats(spark, folder):
    corpus, merged = load(spark, folder, "corpus", "merged")
    return eda.length_stats(corpus, "text").withColumn("field", F.lit("passage")).unionByName(eda.length_stats(merged, "query").withColumn("field", F.lit("query")))


def length_histogram(spark, folder):
    return eda.histogram(table(spark, folder, "corpus"), F.length("text"), 40)


def token_counts(spark, folder):
    text = F.col("text")
    return table(spark, folder, "corpus").select("id", t.n_tokens(text).alias("n_tokens"), t.n_words(text).alias("n_words"))


def degenerate_passages(spark, folder):
    return filters.degenerate_passages(table(spark, folder, "corpus"))


def degenerate_cascade(spark, folder):
    return filters.degenerate_cascade(merged_groups(spark, folder)[0], table(spark, folder, "corpus"))


def degenerate_positives(spark, folder):
    return filters.with_content(kept(spark, folder)).select("query_id", "pos_id", t.n_words(F.col("pos")).alias("n_words"))


def anaphoric_eda(spark, folder):
    return filters.anaphoric_flags(kept(spark, folder)).select("query_id", F.col("eda").alias("is_anaphoric"))


def anaphoric_n(spark, folder):
    return filters.anaphoric_flags(kept(spark, folder)).select("query_id", F.col("notebook").alias("is_anaphoric"))


def records_file(spark) -> str:
    """The example records as a descriptor file in the shared folder."""
    path = new_place(spark, "descriptors")
    spark.createDataFrame([(RECORDS,)], "value string").coalesce(1).write.text(path)
    return path


def parsed(spark) -> DataFrame:
    return vocab.parsed_records(vocab.read_records(spark, records_file(spark)))


def terms(spark, folder) -> DataFrame:
    return vocab.found_terms(kept(spark, folder), readers.vocabulary_file(spark, records_file(spark)))


def anaphoric_flags(spark, folder, rows: DataFrame | None = None) -> DataFrame:
    rows = written(kept(spark, folder).select("query_id", "query"), "kept") if rows is None else rows
    found = vocab.found_terms(rows, readers.vocabulary_file(spark, records_file(spark)))
    return filters.anaphoric_by_vocabulary(rows, found.groupBy("query_id").agg(F.count("*").alias("n_terms")))


def anaphoric_p(spark, folder):
    return anaphoric_flags(spark, folder)


def anaphoric_report(spark, folder):
    return filters.anaphoric_report(anaphoric_flags(spark, folder))


def filter_agreement(spark, folder):
    """The vocabulary rule as label, the notebook rule as prediction."""
    rows = written(kept(spark, folder).select("query_id", "query"), "kept")
    a = anaphoric_flags(spark, folder, rows).select("query_id", F.col("is_anaphoric").alias("label"))
    b = filters.anaphoric_flags(rows).select("query_id", F.col("notebook").alias("predicted"))
    rates = ("precision", "recall", "f1", "accuracy")
    return filters.agreement(a.join(b, "query_id")).withColumns({c: F.round(c, 9) for c in rates})


def sample_labels(spark, folder) -> DataFrame:
    """A label file as annotators hand it back (cells '1', 'yes', '0', blank or missing), written as CSV and read again.

    The cells stand in for hand labels: they follow the first digit of a hash of the query's id."""
    digit = F.substring(F.md5("query_id"), 1, 1)
    cell = F.when(digit < "4", "1").when(digit < "8", "yes").when(digit < "c", "0").when(digit < "e", " ")
    rows = validation_sample(spark, folder).join(kept(spark, folder).select("query_id", "query"), "query_id")
    path = new_place(spark, "labels")
    writers.csv(rows.select("query_id", "query", F.col("is_anaphoric").cast("string").alias("predicted"), cell.alias("label")), path)
    return readers.labels_csv(spark, path)


def hand_label_scores(spark, folder):
    """Agreement of the notebook rule with labels from a file, empty denominators as 0 in one row and as null in the other."""
    return filters.label_scores(sample_labels(spark, folder))


def anaphoric_gazetteer(spark, folder):
    """The notebook rule with entities from a gazetteer file (the names of the example records)."""
    path = new_place(spark, "gazetteer")
    names = parsed(spark).select(F.explode(F.concat(F.array("preferred"), "entry_terms")).alias("value"))
    names.unionByName(spark.createDataFrame([("Follow-up",), ("MRI",)], "value string")).coalesce(1).write.text(path)
    return filters.anaphoric_by_gazetteer(kept(spark, folder), readers.gazetteer(spark, path))


def anaphoric_summary(spark, folder):
    """Counts over all kept queries: with a reference, flagged, saved by a term, with a term at all, generic."""
    f = anaphoric_flags(spark, folder)
    return filters.anaphoric_summary(f)


def validation_sample_p(spark, folder):
    """100 queries for annotators: up to half of them flagged, the rest unflagged."""
    return filters.refilled_sample(anaphoric_flags(spark, folder), "is_anaphoric", 100)


def degenerate_stats(spark, folder):
    return filters.content_stats(kept(spark, folder))


def degenerate_examples(spark, folder):
    """Report of ten queries whose positive has too few words, in the order of their id."""
    return filters.content_examples(kept(spark, folder), 10)


def anaphoric_examples(spark, folder):
    """Report of six flagged and six saved queries, in the order of their id."""
    rows = kept(spark, folder).select("query_id", "query")
    f = rows.join(filters.anaphoric_flags(rows), "query_id").withColumn("referring", t.has(F.col("query"), t.REFERRING)).filter("referring")
    kinds = [f.filter(F.col("notebook") == flag).orderBy("query_id").limit(6).select("query_id", F.lit(name).alias("kind"), t.trimmed(F.col("query")).alias("query")) for name, flag in (("flagged", True), ("saved", False))]
    return kinds[0].unionByName(kinds[1])


def term_categories(spark, folder):
    """(query_id, categories, subcategories) of the terms that a query names; subcategories of diseases and anatomy only."""
    return vocab.categories(terms(spark, folder), readers.vocabulary_file(spark, records_file(spark)))


def passage_topics(spark, folder):
    """Topical coverage of the passages, as their number by disease branch; top 18."""
    return vocab.topic_coverage(*passage_terms(spark, folder))


def topic_uncovered(spark, folder):
    """(n_passages, n_uncovered): passages that name no disease or body part."""
    found, words = passage_terms(spark, folder)
    return vocab.uncovered(table(spark, folder, "corpus").select(F.col("id").alias("query_id")), found, words)


def passage_terms(spark, folder) -> tuple[DataFrame, DataFrame]:
    words = readers.vocabulary_file(spark, records_file(spark))
    own = table(spark, folder, "corpus").select(F.col("id").alias("query_id"), F.col("text").alias("query"))
    return written(vocab.found_terms(own, words).select("query_id", "term"), "terms"), words


def edges_with_reuse(spark, folder):
    """Listed negatives with the number of queries that list them."""
    return negatives.with_reuse(integrity.edges(kept(spark, folder), "query_id")).select("query_id", "place", "neg_id", "neg_reuse_count")


def relevant_sets(spark, folder):
    """(query_id, id): every accepted positive of a consolidated query."""
    queries, _ = merged_groups(spark, folder)
    return queries.select("query_id", F.explode("alt_pos_ids").alias("id"))


def reuse_histogram(spark, folder):
    """(n_queries, n_negatives): how many negatives are listed by how many queries."""
    return negatives.reuse(integrity.edges(table(spark, folder, "merged"), "query_id")).groupBy("n_queries").agg(F.count("*").alias("n_negatives"))


def overlap_histogram(spark, folder):
    k = kept(spark, folder)
    return eda.histogram(k, t.containment_overlap(F.col("query"), F.col("pos")), 50)


def similarity_histogram(spark, folder):
    return eda.histogram(table(spark, folder, "negative_scores"), F.col("neg_similarity"), 80).withColumn("low", F.round("low", 6))


def qrels_histogram(spark, folder):
    """(grade, n, known, n_queries) of graded judgments: positives 2, listed negatives 0, repeated negatives 7 (unknown)."""
    k = kept(spark, folder)
    rows = k.select(F.col("query_id").alias("query-id"), F.col("pos_id").alias("corpus-id"), F.lit(2).alias("score"))
    listed = integrity.edges(k, "query_id").groupBy("query_id", "neg_id").agg(F.when(F.count("*") > 1, 7).otherwise(0).alias("score"))
    own, histogram = readers.graded(rows.unionByName(listed.select(F.col("query_id").alias("query-id"), F.col("neg_id").alias("corpus-id"), "score")))
    return histogram.crossJoin(F.broadcast(own.agg(F.countDistinct("query_id").alias("n_queries"))))


def validation_sample(spark, folder):
    return filters.stratified_sample(anaphoric_n(spark, folder), "is_anaphoric", 75)


def vocab_records(spark, folder):
    return parsed(spark).select("preferred", F.to_json("tree_numbers").alias("tree_numbers"), F.to_json("entry_terms").alias("entry_terms"))


def vocab_terms(spark, folder):
    return vocab.vocabulary(parsed(spark)).select("term", "n_words", F.to_json("tree_numbers").alias("tree_numbers"))


def clinical_terms(spark, folder):
    return terms(spark, folder).groupBy("query_id").agg(F.count("*").alias("n_terms"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]), "; ").alias("terms"))


def topic_coverage(spark, folder):
    return vocab.topic_coverage(terms(spark, folder), vocab.vocabulary(parsed(spark)))


def query_style(spark, folder):
    return kept(spark, folder).select("query_id", t.is_question(F.col("query")).alias("is_question"))


def query_style_p(spark, folder):
    return kept(spark, folder).select("query_id", t.query_type(F.col("query")).alias("style"))


def style_by_split(spark, folder):
    rates = assigned(spark, folder).groupBy("split").agg(F.count("*").alias("n"), F.avg(t.is_question(F.col("query")).cast("double")).alias("share"))
    spread = F.broadcast(rates.agg((F.max("share") - F.min("share")).alias("spread")))
    return rates.crossJoin(spread).select("split", "n", F.round("share", 9).alias("share"), F.round("spread", 9).alias("spread"))


def length_by_style(spark, folder):
    return eda.by_style(kept(spark, folder))


def jaccard_overlap(spark, folder):
    return kept(spark, folder).select("query_id", F.round(t.jaccard_overlap(F.col("query"), F.col("pos")), 9).alias("overlap"))


def containment_overlap(spark, folder):
    return kept(spark, folder).select("query_id", F.round(t.containment_overlap(F.col("query"), F.col("pos")), 9).alias("overlap"))


def overlap_stats(spark, folder):
    return eda.overlap_stats(kept(spark, folder))


def adapt_schema(spark, folder):
    """Consolidated queries in the other pipeline's columns: alternates dropped, a literal split added."""
    queries, negatives = merged_groups(spark, folder)
    lists = negatives.groupBy("query_id").agg(integrity.in_order("neg_id", "rank").alias("neg_id"))
    return queries.join(lists, "query_id", "left").select("query_id", "query", F.lit("train").alias("split"), "pos_id", F.coalesce("neg_id", F.lit("[]")).alias("neg_id"))


QUERIES = {
    f.__name__: f
    for f in (
        load_counts, count_guard, defect_masks, orphan_negatives, drop_defects, clean_negatives, self_negative_edges, passage_canonical, passage_dup_stats,
        remap_negatives, query_dup_stats, consolidate_queries, exact_dup_groups, resolve_straddlers, length_stats, length_histogram, token_counts,
        degenerate_passages, degenerate_cascade, degenerate_positives, anaphoric_eda, anaphoric_n, anaphoric_p, anaphoric_report, filter_agreement,
        validation_sample, vocab_records, vocab_terms, clinical_terms, topic_coverage, query_style, query_style_p, style_by_split, length_by_style,
        jaccard_overlap, containment_overlap, overlap_stats, adapt_schema, hand_label_scores, anaphoric_gazetteer, anaphoric_summary, validation_sample_p, degenerate_stats,
        degenerate_examples, anaphoric_examples, term_categories, passage_topics, topic_uncovered, edges_with_reuse, relevant_sets, reuse_histogram, overlap_histogram,
        similarity_histogram, qrels_histogram,
    )
}

DEFECTS = " UNION ALL ".join(f"SELECT '{d}' AS defect, count(*) FILTER (WHERE {d}) AS n, round(count(*) FILTER (WHERE {d})::DOUBLE / count(*), 9) AS rate FROM flags" for d in integrity.DEFECTS)
ASSIGNED = f"{s.KEPT}, assigned AS (SELECT k.*, r.split FROM kept k JOIN (SELECT DISTINCT query_id, split FROM split_rows WHERE split IS NOT NULL) r USING (query_id))"
QFORMS = f"{s.KEPT}, f AS (SELECT {s.matching_form('query')} AS form, pos_id FROM kept), g AS (SELECT form, count(*) AS n, count(DISTINCT pos_id) AS p FROM f GROUP BY form)"
EDA_RULE = f"{s.has('query', t.PATIENT_REFERENCE)} AND {s.has('query', t.GENERIC_OUTCOME)} AND NOT {s.has('query', t.SEED_ENTITY)}"
N_RULE = f"{s.has('query', t.REFERRING)} AND {s.has('query', t.UNDERSPECIFIED)} AND NOT {s.has('query', t.SEED_ENTITY)}"
IS_QUESTION = f"({s.has('query', t.QUESTION_START)} OR ends_with({s.trimmed('query')}, '?'))"
FIRST_WORD = f"regexp_split_to_array(lower({s.trimmed('query')}), '{t.SPACE}+')[1]"
STYLE = f"CASE WHEN ends_with({s.trimmed('query')}, '?') OR {FIRST_WORD} IN ({', '.join(s.lit(w) for w in t.QUESTION_WORDS)}) THEN 'question' ELSE 'keyword' END"
FIRST_PATTERN = "CASE " + " ".join(f"WHEN {s.has('query', p)} THEN '{n}'" for n, p in t.DEFINITE_REFERENCES) + " END"
VOCAB = """vocab(term, n, numbers) AS (VALUES ('velaromegaly', 1, ['C10.597.622']), ('velar enlargement', 2, ['C10.597.622']), ('scaphelopathy', 1, ['C10.597.622']),
    ('nephrelitis, cavolous', 2, ['C12.777.419', 'C23.550.470']), ('cavolous nephrelitis', 2, ['C12.777.419', 'C23.550.470']), ('galvaremia', 1, ['C12.777.419', 'C23.550.470']),
    ('brachocele', 1, ['A01.236', 'C05.116']), ('tibreloma', 1, ['A01.236', 'C05.116']), ('fundulosis', 1, ['A01.236', 'C05.116']))"""
NO_LOOK = vocab.MEASURE.replace(r"(?<![\p{L}\p{N}_])", r"\b").replace(r"(?![\p{L}\p{N}_])", r"\b")
EPONYM = vocab.EPONYM.replace(r"(?<![\p{L}\p{N}_])", r"\b").replace(r"(?![\p{L}\p{N}_])", r"\b")
STOPS = ", ".join(f"'{w}'" for w in vocab.ACRONYM_STOPS)
LEADS = ", ".join(f"'{w}'" for w in vocab.LEAD_STOPS)
def terms_sql(rows: str) -> str:
    """terms(query_id, term, place) of ``rows``, a table with (query_id, query)."""
    return f"""{VOCAB},
    shapes AS (SELECT query_id, list_filter(regexp_extract_all(query, '{vocab.TOKEN}'), lambda w: regexp_matches(w, '^[A-Z][A-Z0-9]{{1,7}}$') AND w NOT IN ({STOPS})) AS a,
        regexp_extract_all(query, '{EPONYM}') AS e,
        list_filter(regexp_extract_all(query, '{NO_LOOK}'), lambda m: lower(regexp_extract(m, '^[A-Za-z]+')) NOT IN ({LEADS})
            AND regexp_replace(lower(regexp_extract(m, '^[A-Za-z]+')), 's+$', '') NOT IN ({LEADS})) AS m,
        regexp_extract_all(lower(query), '{s.lit(vocab.PHRASE_TOKEN)[1:-1]}') AS w FROM {rows}),
    sizes AS (SELECT shapes.*, unnest(range(1, least(len(w), 5) + 1)) AS n FROM shapes),
    grams AS (SELECT query_id, n, i - 1 AS spot, array_to_string(w[i : i + n - 1], ' ') AS term FROM (SELECT query_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sizes)),
    hits AS (SELECT query_id, 0 AS kind, unnest(a) AS term, generate_subscripts(a, 1) - 1 AS spot FROM shapes
        UNION ALL SELECT query_id, 1, unnest(e), generate_subscripts(e, 1) - 1 FROM shapes UNION ALL SELECT query_id, 2, unnest(m), generate_subscripts(m, 1) - 1 FROM shapes
        UNION ALL SELECT query_id, 10 - g.n, g.term, g.spot FROM grams g JOIN vocab v ON v.term = g.term WHERE g.n > 1 OR v.n = 1),
    terms AS (SELECT query_id, arg_min(term, kind * 100000 + spot) AS term, min(kind * 100000 + spot) AS place FROM hits GROUP BY query_id, lower(term))"""


TERMS = f"{s.KEPT}, {terms_sql('kept')}"
PASSAGE_TERMS = f"passages AS (SELECT id AS query_id, text AS query FROM corpus WHERE text IS NOT NULL), {terms_sql('passages')}"
ANAPHORIC_P = f"""{TERMS}, n AS (SELECT query_id, count(*) AS n FROM terms GROUP BY 1),
    p AS (SELECT query_id, {FIRST_PATTERN} AS matched_pattern, coalesce(n.n, 0) AS n_terms FROM kept LEFT JOIN n USING (query_id)),
    flagged AS (SELECT query_id, matched_pattern, n_terms, matched_pattern IS NOT NULL AND n_terms = 0 AS is_anaphoric,
        n_terms = 0 AND NOT (matched_pattern IS NOT NULL AND n_terms = 0) AS is_generic FROM p)"""
BLOCKS = " UNION ALL ".join(f"SELECT {s.lit(b)} AS block" for b in RECORDS.split("*NEWRECORD"))
PARSED = f"""pairs AS (SELECT block, list_transform(list_filter(string_split(block, chr(10)), lambda x: contains(x, ' = ')), lambda x:
        {{'k': string_split(x, ' = ')[1], 'v': trim(string_split(regexp_replace(x, '^.*? = ', ''), '|')[1])}}) AS p FROM ({BLOCKS})),
    parsed AS (SELECT list_filter(p, lambda x: x.k = 'MH')[-1].v AS preferred, list_transform(list_filter(p, lambda x: x.k = 'MN'), lambda x: x.v) AS numbers,
        list_transform(list_filter(p, lambda x: x.k IN ('ENTRY', 'PRINT ENTRY')), lambda x: x.v) AS entries FROM pairs)"""
GENERIC = "[" + ", ".join(s.lit(x) for x in vocab.GENERIC_TERMS) + "]"


def variants_sql(x: str) -> str:
    parts = f"list_filter(list_transform(string_split(lower({x}), ','), lambda y: trim(y)), lambda y: y <> '')"
    return f"list_distinct([lower({x}), CASE WHEN len({parts}) > 1 THEN array_to_string(list_reverse({parts}), ' ') ELSE lower({x}) END])"


def histogram_sql(value: str, rows: str, bins: int, digits: int = 9) -> str:
    return f"""v AS (SELECT CAST({value} AS DOUBLE) AS v FROM {rows}), e AS (SELECT min(v) AS lo, (max(v) - min(v)) / {bins} AS w FROM v),
        b AS (SELECT CAST(CASE WHEN w = 0 THEN 0 ELSE least(floor((v - lo) / w), {bins - 1}) END AS BIGINT) AS bin, lo, w FROM v, e WHERE v IS NOT NULL)
        SELECT bin, round(lo + bin * w, {digits}) AS low, count(*) AS n FROM b GROUP BY bin, lo, w"""


GAZETTEER = ["velaromegaly", "velar enlargement", "scaphelopathy", "nephrelitis cavolous", "galvaremia", "drug therapy", "pharmacotherapy", "brachocele", "tibreloma", "fundulosis", "pain", "ache"]
SAMPLE_LABELS = f"""{s.KEPT}, f AS (SELECT query_id, {N_RULE} AS p FROM kept), r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY md5('42:' || query_id), query_id) AS nth FROM f),
    l AS (SELECT p, CASE WHEN d < '4' THEN '1' WHEN d < '8' THEN 'yes' WHEN d < 'c' THEN '0' END AS label FROM (SELECT p, substr(md5(query_id), 1, 1) AS d FROM r WHERE nth <= 75)),
    x AS (SELECT label IN ('1', 'yes') AS l, p FROM l WHERE label IS NOT NULL),
    c AS (SELECT count(*) AS n_labeled, count(*) FILTER (WHERE l AND p) AS tp, count(*) FILTER (WHERE NOT l AND p) AS fp, count(*) FILTER (WHERE l AND NOT p) AS fn, count(*) FILTER (WHERE NOT l AND NOT p) AS tn FROM x)"""


def scores_sql(variant: str, empty: str) -> str:
    """Rates of one variant; f1 of two rates that are both zero is empty too."""
    p, r = "tp / nullif(tp + fp, 0)", "tp / nullif(tp + fn, 0)"
    f1 = f"2 * ({p}) * ({r}) / nullif(({p}) + ({r}), 0)"
    return f"SELECT '{variant}' AS variant, n_labeled, tp, fp, fn, tn, " + ", ".join(f"coalesce(round_even({e}, 4), {empty}) AS {n}" for n, e in (("precision", p), ("recall", r), ("f1", f1), ("accuracy", "(tp + tn) / nullif(n_labeled, 0)"))) + " FROM c"


SQL = {
    "hand_label_scores": f"WITH {SAMPLE_LABELS} {scores_sql('zero', '0.0::DOUBLE')} UNION ALL {scores_sql('undefined', 'NULL')}",
    "anaphoric_gazetteer": f"""WITH {s.KEPT}, w AS (SELECT query_id, query, {s.matching_form("query")} AS form FROM kept),
        g AS (SELECT query_id, query, regexp_matches(form, '(^|[^\\p{{L}}\\p{{N}}_])({"|".join(sorted((x for x in GAZETTEER if len(x) > 3), key=len, reverse=True))})($|[^\\p{{L}}\\p{{N}}_])') AS has_entity FROM w)
        SELECT query_id, has_entity, {s.has("query", t.REFERRING)} AND {s.has("query", t.UNDERSPECIFIED)} AND NOT has_entity AS is_anaphoric FROM g""",
    "anaphoric_summary": f"""WITH {ANAPHORIC_P} SELECT count(*) AS n, count(matched_pattern) AS n_referring, count(*) FILTER (WHERE is_anaphoric) AS n_flagged, round(count(*) FILTER (WHERE is_anaphoric) / count(*), 6) AS flagged_rate,
        count(matched_pattern) - count(*) FILTER (WHERE is_anaphoric) AS n_saved, round(count(*) FILTER (WHERE n_terms > 0) / count(*), 6) AS entity_rate, count(*) FILTER (WHERE is_generic) AS n_generic FROM flagged""",
    "validation_sample_p": f"""WITH {ANAPHORIC_P}, r AS (SELECT query_id, is_anaphoric, row_number() OVER (PARTITION BY is_anaphoric ORDER BY md5('42:' || query_id), query_id) AS nth FROM flagged)
        SELECT query_id, is_anaphoric FROM r WHERE CASE WHEN is_anaphoric THEN nth <= 50 ELSE nth <= 100 - least(50, (SELECT count(*) FROM flagged WHERE is_anaphoric)) END""",
    "degenerate_stats": f"WITH {s.KEPT} SELECT count(*) AS n_before, count(*) FILTER (WHERE {s.n_words('pos')} < 8) AS n_dropped, count(*) FILTER (WHERE {s.n_words('pos')} >= 8) AS n_after FROM kept",
    "degenerate_examples": f"WITH {s.KEPT} SELECT query_id, pos, {s.n_words('pos')} AS n_words FROM kept WHERE {s.n_words('pos')} < 8 ORDER BY query_id LIMIT 10",
    "anaphoric_examples": f"""WITH {s.KEPT}, f AS (SELECT query_id, {s.trimmed("query")} AS query, {N_RULE} AS flag FROM kept WHERE {s.has("query", t.REFERRING)}),
        r AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY query_id) AS nth FROM f) SELECT query_id, CASE WHEN flag THEN 'flagged' ELSE 'saved' END AS kind, query FROM r WHERE nth <= 6""",
    "term_categories": f"""WITH {TERMS}, h AS (SELECT DISTINCT query_id, number FROM (SELECT query_id, unnest(numbers) AS number FROM terms JOIN vocab ON vocab.term = lower(terms.term)))
        SELECT query_id, to_json(list_sort(list_distinct(list(number[1]))))::VARCHAR AS categories, to_json(list_sort(list_distinct(list(CASE WHEN number[1] IN ('A', 'C') AND length(number) >= 3 THEN number[1:3] END))))::VARCHAR AS subcategories
        FROM h GROUP BY 1""",
    "passage_topics": f"""WITH {PASSAGE_TERMS}, codes AS (SELECT term AS low, unnest(numbers) AS number FROM vocab), hits2 AS (SELECT DISTINCT query_id, substr(number, 1, 3) AS code FROM terms JOIN codes ON codes.low = lower(terms.term) WHERE number LIKE 'C%')
        SELECT code, CASE code {" ".join(f"WHEN '{c}' THEN {s.lit(n)}" for c, n in vocab.BRANCHES.items())} ELSE code END AS label, count(*) AS n FROM hits2 GROUP BY code ORDER BY n DESC, code LIMIT 18""",
    "topic_uncovered": f"""WITH {PASSAGE_TERMS}, codes AS (SELECT term AS low, unnest(numbers) AS number FROM vocab)
        SELECT count(*) AS n_passages, count(*) FILTER (WHERE id NOT IN (SELECT query_id FROM terms JOIN codes ON codes.low = lower(terms.term) WHERE number[1] IN ('A', 'C'))) AS n_uncovered FROM corpus""",
    "edges_with_reuse": f"""WITH {s.CLEAN}, e AS (SELECT query_id, neg_id, place FROM listed WHERE neg_id IS NOT NULL), c AS (SELECT neg_id, count(DISTINCT query_id) AS neg_reuse_count FROM e GROUP BY 1)
        SELECT query_id, place, neg_id, neg_reuse_count FROM e JOIN c USING (neg_id)""",
    "relevant_sets": f"WITH {s.CONSOLIDATED} SELECT rep AS query_id, unnest(alts) AS id FROM reps",
    "reuse_histogram": """WITH r AS (SELECT neg_id, count(DISTINCT query_id) AS n_queries FROM (SELECT query_id, unnest(neg_id) AS neg_id FROM merged) WHERE neg_id IS NOT NULL GROUP BY 1)
        SELECT n_queries, count(*) AS n_negatives FROM r GROUP BY 1""",
    "overlap_histogram": f"WITH {s.KEPT}, {histogram_sql(s.containment('query', 'pos'), 'kept', 50)}",
    "similarity_histogram": f"WITH {histogram_sql('neg_similarity', 'negative_scores', 80, 6)}",
    "qrels_histogram": f"""WITH {s.CLEAN}, q AS (SELECT query_id, 2 AS grade FROM kept UNION ALL SELECT query_id, CASE WHEN count(*) > 1 THEN 7 ELSE 0 END FROM listed WHERE neg_id IS NOT NULL GROUP BY query_id, neg_id)
        SELECT grade, count(*) AS n, grade IN (0, 1, 2) AS known, (SELECT count(DISTINCT query_id) FROM q) AS n_queries FROM q GROUP BY 1""",
    "load_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("corpus", "merged", "negative_scores", "split_rows", "documents")),
    "count_guard": """SELECT 'corpus' AS name, 'ids' AS unit, count(DISTINCT id) AS n_distinct, count(*) AS n_rows, count(DISTINCT id) = count(*) AS as_expected FROM corpus
        UNION ALL SELECT 'merged', 'query_ids', count(DISTINCT query_id), count(*), count(DISTINCT query_id) = count(*) FROM merged""",
    "defect_masks": f"WITH {s.KEPT} {DEFECTS}",
    "orphan_negatives": "SELECT DISTINCT n AS neg_id FROM (SELECT unnest(neg_id) AS n FROM merged) WHERE n IS NOT NULL AND n NOT IN (SELECT id FROM corpus WHERE id IS NOT NULL)",
    "drop_defects": f"WITH {s.KEPT} SELECT query_id, query, pos_id FROM kept",
    "clean_negatives": f"WITH {s.CLEAN} SELECT query_id, count(*) AS n, to_json(list(neg_id ORDER BY place))::VARCHAR AS neg_ids FROM clean GROUP BY 1",
    "self_negative_edges": f"WITH {s.CLEAN} SELECT query_id, neg_id, place FROM listed WHERE neg_id = pos_id",
    "passage_canonical": f"WITH {s.CANON} SELECT id, canonical_id FROM canon",
    "passage_dup_stats": f"""WITH {s.CANON}, z AS (SELECT canonical_id, count(*) AS n FROM canon GROUP BY 1)
        SELECT CAST(sum(n) AS BIGINT) AS n_ids, count(*) AS n_texts, CAST(sum(n) AS BIGINT) - count(*) AS n_merged, max(n) AS largest_group FROM z""",
    "remap_negatives": f"""WITH {s.CLEAN}, {s.CANON}, r AS (SELECT c.query_id, p.canonical_id AS pos_id, c.place, n.canonical_id AS neg_id FROM clean c JOIN canon n ON n.id = c.neg_id JOIN canon p ON p.id = c.pos_id),
        d AS (SELECT *, row_number() OVER (PARTITION BY query_id, neg_id ORDER BY place) AS nth FROM r WHERE neg_id <> pos_id)
        SELECT query_id, pos_id, place, neg_id FROM d WHERE nth = 1""",
    "query_dup_stats": f"""WITH {QFORMS} SELECT CAST(sum(n) AS BIGINT) AS n_queries, count(*) AS n_groups, count(*) FILTER (WHERE n > 1) AS n_repeated, max(n) AS largest_group,
        count(*) FILTER (WHERE n > 1 AND p > 1) AS n_many_positives FROM g""",
    "consolidate_queries": f"""WITH {s.CONSOLIDATED} SELECT r.rep AS query_id, r.query, r.alts[1] AS pos_id, to_json(r.alts)::VARCHAR AS alt_pos_ids,
        coalesce((SELECT to_json(list(neg_id ORDER BY rank))::VARCHAR FROM ranked k WHERE k.rep = r.rep), '[]') AS neg_ids FROM reps r""",
    "exact_dup_groups": f"""WITH {ASSIGNED} SELECT {s.query_form("query")} AS form, count(*) AS n, count(DISTINCT split) AS n_splits, arg_min(query, query_id) AS example, count(DISTINCT split) > 1 AS straddles,
            to_json(list_sort(list_distinct(list(split))))::VARCHAR AS splits, to_json(list_sort(list(query_id)))::VARCHAR AS query_ids
        FROM assigned GROUP BY 1 HAVING count(*) > 1""",
    "resolve_straddlers": f"""WITH {ASSIGNED}, p AS (SELECT query_id, split, {s.query_form("query")} AS form, CASE split WHEN 'test' THEN 2 WHEN 'val' THEN 1 WHEN 'train' THEN 0 END AS rank FROM assigned)
        SELECT query_id, split FROM (SELECT *, max(rank) OVER (PARTITION BY form) AS best FROM p) WHERE rank < best""",
    "length_stats": " UNION ALL ".join(
        f"SELECT '{field}' AS field, count(*) AS n, min(l) AS shortest, max(l) AS longest, round(avg(l), 9) AS mean, median(l::DOUBLE) AS median FROM (SELECT length({s.trimmed(c)}) AS l FROM {tab} WHERE {c} IS NOT NULL)"
        for field, tab, c in (("passage", "corpus", "text"), ("query", "merged", "query"))
    ),
    "length_histogram": """WITH v AS (SELECT length(text)::DOUBLE AS v FROM corpus WHERE text IS NOT NULL), e AS (SELECT min(v) AS lo, (max(v) - min(v)) / 40 AS w FROM v),
        b AS (SELECT CAST(CASE WHEN w = 0 THEN 0 ELSE least(floor((v - lo) / w), 39) END AS BIGINT) AS bin, lo, w FROM v, e)
        SELECT bin, round(lo + bin * w, 9) AS low, count(*) AS n FROM b GROUP BY bin, lo, w""",
    "token_counts": f"SELECT id, {s.n_tokens('text')} AS n_tokens, {s.n_words('text')} AS n_words FROM corpus",
    "degenerate_passages": f"SELECT id, {s.n_tokens('text')} AS n_tokens FROM corpus WHERE {s.n_tokens('text')} < 6",
    "degenerate_cascade": f"""WITH {s.CONSOLIDATED}, a AS (SELECT rep AS query_id, unnest(alts) AS pos FROM reps)
        SELECT query_id, min(pos) AS pos_id, count(*) AS n_positives FROM a WHERE pos NOT IN (SELECT id FROM corpus WHERE {s.n_tokens("text")} < 6) GROUP BY 1""",
    "degenerate_positives": f"WITH {s.KEPT} SELECT query_id, pos_id, {s.n_words('pos')} AS n_words FROM kept WHERE {s.n_words('pos')} >= 8",
    "anaphoric_eda": f"WITH {s.KEPT} SELECT query_id, {EDA_RULE} AS is_anaphoric FROM kept",
    "anaphoric_n": f"WITH {s.KEPT} SELECT query_id, {N_RULE} AS is_anaphoric FROM kept",
    "anaphoric_p": f"WITH {ANAPHORIC_P} SELECT * FROM flagged",
    "anaphoric_report": f"""WITH {ANAPHORIC_P} SELECT coalesce(matched_pattern, 'none') AS pattern, count(*) AS n, count(*) FILTER (WHERE is_anaphoric) AS flagged,
        count(*) FILTER (WHERE matched_pattern IS NOT NULL AND NOT is_anaphoric) AS saved FROM flagged GROUP BY 1""",
    "filter_agreement": f"""WITH {ANAPHORIC_P}, x AS (SELECT is_anaphoric AS l, {N_RULE} AS p FROM flagged JOIN kept USING (query_id)),
        c AS (SELECT count(*) FILTER (WHERE l AND p) AS tp, count(*) FILTER (WHERE NOT l AND p) AS fp, count(*) FILTER (WHERE l AND NOT p) AS fn, count(*) FILTER (WHERE NOT l AND NOT p) AS tn FROM x)
        SELECT tp, fp, fn, tn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 9) AS recall,
        round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) AS f1, round(CASE WHEN tp + fp + fn + tn = 0 THEN 0 ELSE (tp + tn) / (tp + fp + fn + tn) END, 9) AS accuracy FROM c""",
    "validation_sample": f"""WITH {s.KEPT}, f AS (SELECT query_id, {N_RULE} AS is_anaphoric FROM kept),
        r AS (SELECT *, row_number() OVER (PARTITION BY is_anaphoric ORDER BY md5('42:' || query_id), query_id) AS nth FROM f) SELECT query_id, is_anaphoric FROM r WHERE nth <= 75""",
    "vocab_records": f"WITH {PARSED} SELECT preferred, to_json(numbers)::VARCHAR AS tree_numbers, to_json(entries)::VARCHAR AS entry_terms FROM parsed WHERE preferred IS NOT NULL",
    "vocab_terms": f"""WITH {PARSED}, ok AS (SELECT * FROM parsed WHERE preferred IS NOT NULL AND len(list_intersect({variants_sql("preferred")}, {GENERIC})) = 0),
        names AS (SELECT DISTINCT preferred, numbers, unnest({variants_sql("name")}) AS term FROM (SELECT preferred, numbers, unnest(list_concat([preferred], entries)) AS name FROM ok))
        SELECT term, len(string_split(term, ' ')) AS n_words, to_json(list_sort(flatten(list(numbers))))::VARCHAR AS tree_numbers FROM names
        WHERE length(term) >= 3 AND NOT list_contains({GENERIC}, term) GROUP BY term""",
    "clinical_terms": f"WITH {TERMS} SELECT query_id, count(*) AS n_terms, string_agg(term, '; ' ORDER BY place, term) AS terms FROM terms GROUP BY 1",
    "topic_coverage": f"""WITH {TERMS}, codes AS (SELECT term AS low, unnest(numbers) AS number FROM vocab),
        hits2 AS (SELECT DISTINCT query_id, substr(number, 1, 3) AS code FROM terms JOIN codes ON codes.low = lower(terms.term) WHERE number LIKE 'C%')
        SELECT code, CASE code {" ".join(f"WHEN '{c}' THEN {s.lit(n)}" for c, n in vocab.BRANCHES.items())} ELSE code END AS label, count(*) AS n FROM hits2 GROUP BY code ORDER BY n DESC, code LIMIT 18""",
    "query_style": f"WITH {s.KEPT} SELECT query_id, {IS_QUESTION} AS is_question FROM kept",
    "query_style_p": f"WITH {s.KEPT} SELECT query_id, {STYLE} AS style FROM kept",
    "style_by_split": f"""WITH {ASSIGNED}, r AS (SELECT split, count(*) AS n, avg({IS_QUESTION}::INT::DOUBLE) AS share FROM assigned GROUP BY 1)
        SELECT split, n, round(share, 9) AS share, round((SELECT max(share) - min(share) FROM r), 9) AS spread FROM r""",
    "length_by_style": f"WITH {s.KEPT} SELECT {STYLE} AS style, count(*) AS n, median(length(query)::DOUBLE) AS median_length, round(avg({s.containment('query', 'pos')}), 9) AS mean_overlap FROM kept GROUP BY 1",
    "jaccard_overlap": f"WITH {s.KEPT} SELECT query_id, round({s.jaccard('query', 'pos')}, 9) AS overlap FROM kept",
    "containment_overlap": f"WITH {s.KEPT} SELECT query_id, round({s.containment('query', 'pos')}, 9) AS overlap FROM kept",
    "overlap_stats": f"""WITH {s.KEPT}, o AS (SELECT {s.jaccard("query", "pos")} AS o FROM kept) SELECT count(*) AS n, round(avg(o), 9) AS mean, round(median(o), 9) AS median,
        round(avg((o = 0)::INT), 9) AS zero_rate FROM o""",
    "adapt_schema": f"""WITH {s.CONSOLIDATED} SELECT r.rep AS query_id, r.query, 'train' AS split, r.alts[1] AS pos_id,
        coalesce((SELECT to_json(list(neg_id ORDER BY rank))::VARCHAR FROM ranked k WHERE k.rep = r.rep), '[]') AS neg_id FROM reps r""",
}
