"""Registered queries of the operators here, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trelliq.llm.component_splits import related_groups, split_groups
from trelliq.llm.format_duplicates import format_classes
from trelliq.llm.mixing import mix
from trelliq.llm.near_duplicates import expanded_pairs, link_counts, near_duplicates
from trelliq.llm.shared_spans import shared_shares, shared_spans
from trelliq.llm.split_overlap import cross_split_overlaps, overlap_report
from trelliq.llm.tokens import TOKENIZERS, token_ids
from trelliq.plans.mining import COMPONENTS
from trelliq.sources.tables import table

SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}


def texts_of_both(spark: SparkSession, folder: str) -> DataFrame:
    corpus = table(spark, folder, "corpus").select(F.lit("corpus").alias("tab"), "id", "text")
    merged = table(spark, folder, "merged").select(F.lit("merged").alias("tab"), F.col("query_id").alias("id"), F.col("query").alias("text"))
    return corpus.unionByName(merged)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return format_classes(texts_of_both(spark, folder), "id", "text", by="tab")[1]


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    return format_classes(texts_of_both(spark, folder), "id", "text", by="tab")[0]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = related_groups(table(spark, folder, "merged"), "query_id", "pos_id")
    return groups.filter("n > 1 AND group_id <> id").select("group_id", F.col("id").alias("query_id"))


def p2_splits(spark: SparkSession, folder: str) -> DataFrame:
    groups = related_groups(table(spark, folder, "merged"), "query_id", "pos_id")
    return split_groups(groups, SHARES).select(F.col("id").alias("query_id"), "group_id", "split")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return expanded_pairs(*near_duplicates(table(spark, folder, "corpus"), "id", "text", words_in_shingle=3, threshold=0.5))


def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    return link_counts(*near_duplicates(table(spark, folder, "corpus"), "id", "text"))


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return cross_split_overlaps(table(spark, folder, "merged"), table(spark, folder, "split_rows"), words_in_shingle=1, threshold=0.75)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    a, b = F.col("eval_id"), F.col("train_id")
    return p4_pairs(spark, folder).select(F.least(a, b).alias("query_id_a"), F.greatest(a, b).alias("query_id_b"), "via")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap_report(table(spark, folder, "merged"), table(spark, folder, "split_rows"), words_in_shingle=1, threshold=0.75)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_ids(table(spark, folder, "documents"), "doc_id", "text", TOKENIZERS)


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans(table(spark, folder, "documents"), "doc_id", "text")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return shared_shares(docs, shared_spans(docs, "doc_id", "text"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_splits, p3_found, p3_links, p4_found, p4_report, p6_ids, p7_mixture, p7_shares, p8_found, p8_shares)}

WORDS = r"[\p{L}\p{N}]+"


def bare_sql(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


PARTS = f"list_transform(string_split(p, ':'), lambda x: {bare_sql('x')})"
CANONICAL = f"""texts AS (SELECT DISTINCT 'corpus' AS tab, id, text FROM corpus WHERE id IS NOT NULL UNION SELECT DISTINCT 'merged', query_id, query FROM merged WHERE query_id IS NOT NULL),
    cut AS (SELECT *, list_transform(list_filter(regexp_split_to_array(text, '[,;|\\r\\n]'), lambda p: {bare_sql("p")} <> ''), lambda p: {PARTS}) AS ps FROM texts),
    canon AS (SELECT tab, id, CASE WHEN len(ps) >= 3 AND len(list_filter(ps, lambda q: len(q) = 2 AND q[1] <> '' AND q[2] <> '')) = len(ps)
        THEN 'r' || array_to_string(list_sort(list_transform(ps, lambda q: q[1] || chr(1) || q[2])), chr(2)) WHEN {bare_sql("text")} <> '' THEN 't' || {bare_sql("text")} END AS c FROM cut)"""


def sets_sql(rows: str, text: str, n: int) -> str:
    """sets(id, items) of the distinct runs of n words, and their explosion; rows is (id, text)."""
    return f"""w AS (SELECT id, regexp_extract_all(lower({text}), '{WORDS}') AS w FROM ({rows}) WHERE {text} IS NOT NULL),
    sets AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i : i + {n - 1}], ' ')))) AS items FROM w WHERE len(w) >= {n})"""


def pairs_sql(sets: str, threshold: float, more: str) -> str:
    return f"""e AS (SELECT id, len(items) AS n, unnest(items) AS item FROM {sets}),
    c AS (SELECT a.id AS a, b.id AS b, a.n + b.n AS n, count(*) AS k FROM e a JOIN e b ON a.item = b.item AND {more} GROUP BY 1, 2, 3),
    alike AS (SELECT a, b FROM c WHERE k / (n - k) >= {threshold})"""


P4 = f"""side AS (SELECT DISTINCT query_id, split FROM split_rows WHERE split IN ('train', 'val', 'test')), rows AS (SELECT DISTINCT query_id AS id, query FROM merged WHERE query_id IN (SELECT query_id FROM side)),
    {sets_sql("SELECT * FROM rows", "query", 1)}, tagged AS (SELECT s.*, side.split FROM sets s JOIN side ON side.query_id = s.id),
    e AS (SELECT id, split, len(items) AS n, unnest(items) AS item FROM tagged),
    c AS (SELECT a.id AS a, b.id AS b, a.n + b.n AS n, count(*) AS k FROM e a JOIN e b ON a.item = b.item AND a.split <> 'train' AND b.split = 'train' GROUP BY 1, 2, 3),
    named AS (SELECT DISTINCT m.query_id, pos_id, split FROM merged m JOIN side USING (query_id) WHERE pos_id IS NOT NULL),
    found AS (SELECT a AS eval_id, b AS train_id, 'query' AS via FROM c WHERE k / (n - k) >= 0.75
        UNION SELECT x.query_id, y.query_id, 'pos_id' FROM named x JOIN named y USING (pos_id) WHERE x.split <> 'train' AND y.split = 'train')"""

SPANS = """d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 160),
        g AS (SELECT doc_id, i, substr(text, i, 160) AS gram FROM (SELECT doc_id, text, unnest(range(1, length(text) - 158)) AS i FROM d)),
        two AS (SELECT gram FROM g GROUP BY 1 HAVING min(doc_id) < max(doc_id)), h AS (SELECT doc_id, i FROM g WHERE gram IN (SELECT gram FROM two)),
        o AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 160 THEN 0 ELSE 1 END AS opens FROM h),
        r AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
        spans AS (SELECT doc_id, min(i) - 1 AS start_at, max(i) + 159 AS end_at FROM r GROUP BY doc_id, run)"""

SQL: dict[str, str] = {
    "p1_found": f"""WITH {CANONICAL} SELECT tab, keep_id, copy_id FROM (SELECT DISTINCT tab, min(id) OVER (PARTITION BY tab, c) AS keep_id, id AS copy_id FROM canon WHERE c IS NOT NULL)
        WHERE keep_id <> copy_id""",
    "p1_classes": f"WITH {CANONICAL} SELECT tab, min(id) AS keep_id, count(DISTINCT id) AS n_records FROM canon GROUP BY tab, coalesce(c, '-' || id)",
    "p2_found": f"WITH {COMPONENTS} SELECT component AS group_id, query_id FROM comp WHERE component <> query_id",
    "p2_splits": f"""WITH {COMPONENTS}, sizes AS (SELECT component, count(*) AS n FROM comp GROUP BY 1), whole AS (SELECT sum(n) AS a FROM sizes),
        line AS (SELECT component, n, a, CASE WHEN n > 0.01::DOUBLE * a THEN -n ELSE 0 END AS giant, CASE WHEN n > 0.01::DOUBLE * a THEN '' ELSE md5('42:' || component) END AS h FROM sizes, whole),
        m AS (SELECT component, a, sum(n) OVER (ORDER BY giant, h, component ROWS UNBOUNDED PRECEDING) - n / 2 AS middle FROM line)
        SELECT query_id, component AS group_id, CASE WHEN middle <= 0.8::DOUBLE * a THEN 'train' WHEN middle <= (0.8::DOUBLE + 0.1::DOUBLE) * a THEN 'val' ELSE 'test' END AS split FROM comp JOIN m USING (component)""",
    "p3_found": f"WITH {sets_sql('SELECT id, text FROM corpus', 'text', 3)}, {pairs_sql('sets', 0.5, 'a.id < b.id')} SELECT a AS id_a, b AS id_b FROM alike",
    "p3_links": f"""WITH {sets_sql("SELECT id, text FROM corpus", "text", 5)}, cls AS (SELECT id, min(id) OVER (PARTITION BY items) AS class_id, count(*) OVER (PARTITION BY items) AS n_copies FROM sets),
        reps AS (SELECT * FROM sets WHERE id IN (SELECT class_id FROM cls)), {pairs_sql("reps", 0.8, "a.id <> b.id")}, links AS (SELECT a, count(*) AS k FROM alike GROUP BY 1)
        SELECT id, class_id, n_copies, coalesce(k, 0) AS n_links FROM cls LEFT JOIN links ON links.a = cls.class_id""",
    "p4_found": f"WITH {P4} SELECT least(eval_id, train_id) AS query_id_a, greatest(eval_id, train_id) AS query_id_b, via FROM found",
    "p4_report": f"""WITH {P4}, place AS (SELECT DISTINCT query_id, split, source FROM split_rows)
        SELECT p.split, p.source, via, count(DISTINCT eval_id) AS n_queries, count(*) AS n_pairs FROM found JOIN place p ON p.query_id = eval_id GROUP BY 1, 2, 3""",
    "p8_found": f"WITH {SPANS} SELECT doc_id, start_at, end_at FROM spans",
    "p8_shares": f"""WITH {SPANS}, sizes AS (SELECT doc_id, max(coalesce(length(text), 0)) AS n_chars FROM documents WHERE doc_id IS NOT NULL GROUP BY 1),
        f AS (SELECT doc_id, CAST(sum(end_at - start_at) AS BIGINT) AS n_shared, count(*) AS n_spans FROM spans GROUP BY 1)
        SELECT doc_id, n_chars, coalesce(n_shared, 0) AS n_shared, coalesce(n_spans, 0) AS n_spans, CASE WHEN n_chars > 0 THEN coalesce(n_shared, 0) / n_chars ELSE 0.0::DOUBLE END AS share
        FROM sizes LEFT JOIN f USING (doc_id)""",
}
