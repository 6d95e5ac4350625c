"""Pieces of DuckDB SQL that say the same as the column expressions of functions/text.py."""

from __future__ import annotations

from trelliq.functions.text import LETTER, SPACE, STOPWORDS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def blank(x: str) -> str:
    return f"({x} IS NULL OR {trimmed(x)} = '')"


def n_tokens(x: str) -> str:
    return f"CASE WHEN {blank(x)} THEN 0 ELSE len(regexp_split_to_array({trimmed(x)}, '{SPACE}+')) END"


def n_words(x: str) -> str:
    return f"coalesce(len(regexp_extract_all({x}, '{LETTER}+')), 0)"


def no_punctuation(x: str) -> str:
    return f"regexp_replace({x}, '[!-/:-@\\[-`{{-~]', '', 'g')"


def compatible(x: str) -> str:
    """NFKC of the compatibility characters that the tables hold."""
    for code, to in ((0xA0, " "), (0x2009, " "), (0x2026, "..."), (0x2011, chr(0x2010)), (0xB4, " " + chr(0x301))):
        x = f"replace({x}, chr({code}), '{to}')"
    return x


def matching_form(x: str) -> str:
    collapsed = f"regexp_replace({no_punctuation(f'lower({compatible(x)})')}, '{SPACE}+', ' ', 'g')"
    return trimmed(collapsed)


def query_form(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches(lower({x}), {lit(pattern)})"


def content_tokens(x: str) -> str:
    stops = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_distinct(list_filter(regexp_split_to_array({no_punctuation(f'lower({x})')}, '{SPACE}+'), lambda w: length(w) > 2 AND w NOT IN ({stops})))"


def jaccard(a: str, b: str) -> str:
    a, b = content_tokens(a), content_tokens(b)
    both = f"len(list_intersect({a}, {b}))"
    union = f"(len({a}) + len({b}) - {both})"
    return f"CASE WHEN {union} = 0 THEN 0.0 ELSE {both}::DOUBLE / {union} END"


def containment(q: str, p: str) -> str:
    q, p = (f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))" for x in (q, p))
    return f"CASE WHEN len({q}) > 0 THEN coalesce(len(list_intersect({q}, {p}))::DOUBLE / len({q}), 0.0) ELSE 0.0 END"


#: Rows of ``merged`` with their defects, those kept, and their cleaned edges.
KEPT = f"""
    known AS (SELECT DISTINCT id FROM corpus),
    flags AS (SELECT m.*, {blank("m.query")} AS null_query, {blank("m.pos")} AS null_pos, k.id IS NULL AS orphan_pos,
        coalesce(len(m.neg_id) = 0, true) AS no_negatives, coalesce(list_contains(m.neg_id, m.pos_id), false) AS self_negative,
        row_number() OVER (PARTITION BY m.query_id ORDER BY m.loaded_at NULLS FIRST, m.pos_id NULLS FIRST,
            md5(array_to_string(m.neg_id, ',')) NULLS FIRST) > 1 AS duplicate_query_id
        FROM merged m LEFT JOIN known k ON k.id = m.pos_id),
    kept AS (SELECT * FROM flags WHERE NOT (null_query OR null_pos OR orphan_pos OR duplicate_query_id))"""

CLEAN = f"""{KEPT},
    listed AS (SELECT query_id, pos_id, unnest(neg_id) AS neg_id, generate_subscripts(neg_id, 1) - 1 AS place FROM kept),
    clean AS (SELECT query_id, pos_id, place, neg_id FROM (
        SELECT l.*, row_number() OVER (PARTITION BY l.query_id, l.neg_id ORDER BY l.place) AS nth
        FROM listed l JOIN known ON known.id = l.neg_id WHERE l.neg_id <> l.pos_id) WHERE nth = 1)"""

CANON = f"""
    forms AS (SELECT id, {matching_form("text")} AS form FROM corpus),
    canon AS (SELECT id, CASE WHEN form IS NULL THEN id ELSE min(id) OVER (PARTITION BY form) END AS canonical_id FROM forms)"""

CONSOLIDATED = f"""{CLEAN},
    qforms AS (SELECT query_id, query, pos_id, {matching_form("query")} AS form FROM kept),
    reps AS (SELECT form, min(query_id) AS rep, arg_min(query, query_id) AS query, list_sort(list_distinct(list(pos_id))) AS alts FROM qforms GROUP BY form),
    united AS (SELECT r.rep, c.neg_id, min((c.query_id, c.place)) AS spot FROM clean c JOIN qforms USING (query_id) JOIN reps r USING (form)
        WHERE NOT list_contains(r.alts, c.neg_id) GROUP BY r.rep, c.neg_id),
    ranked AS (SELECT rep, neg_id, row_number() OVER (PARTITION BY rep ORDER BY spot) AS rank FROM united)"""

PARTITION = """
    ids AS (SELECT id, row_number() OVER (ORDER BY md5('42:' || id), id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT id FROM corpus WHERE id IS NOT NULL)),
    part AS (SELECT id, CASE WHEN r <= round_even(n * 0.8, 0) THEN 'train' WHEN r <= round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'val' ELSE 'test' END AS split FROM ids)"""
