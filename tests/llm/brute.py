"""Plain versions of the problems, straight from their statements; small inputs only."""

import re
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\W_]+")


def bare(text):
    return "".join(c for c in text.lower() if c.isalnum())


def canonical(text):
    if text is None or not bare(text):
        return None
    pieces = [p for p in re.split(r"[,;|\r\n]", text) if bare(p)]
    pairs = [tuple(map(bare, p.split(":"))) for p in pieces]
    if len(pairs) >= 3 and all(len(p) == 2 and all(p) for p in pairs):
        return ("record", tuple(sorted(pairs)))
    return ("text", bare(text))


def format_copies(rows):
    """rows: (tab, id, text)."""
    groups = defaultdict(set)
    for tab, i, text in rows:
        if i is not None and (c := canonical(text)):
            groups[tab, c].add(i)
    return {(tab, min(ids), i) for (tab, _), ids in groups.items() for i in ids if i != min(ids)}


def format_sizes(rows):
    groups = defaultdict(set)
    for tab, i, text in rows:
        if i is not None:
            groups[tab, canonical(text) or ("none", i)].add(i)
    return Counter((tab, min(ids), len(ids)) for (tab, _), ids in groups.items())


def groups(rows):
    """rows: (id, key); the set of frozensets of tied ids, singletons too."""
    by_key, parent = defaultdict(set), {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, key in rows:
        if i is not None:
            root(i)
            if key is not None:
                by_key[key].add(i)
    for ids in by_key.values():
        first, *rest = ids
        for x in rest:
            parent[root(x)] = root(first)
    out = defaultdict(set)
    for x in list(parent):
        out[root(x)].add(x)
    return {frozenset(g) for g in out.values()}


def shingles(text, n):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def similar_pairs(rows, n, threshold):
    """rows: (id, text)."""
    sets = {i: s for i, t in rows if i is not None and (s := shingles(t, n))}
    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    found = set()
    for i, s in sets.items():
        common = Counter(j for x in s for j in by[x] if j > i)
        found |= {(i, j) for j, c in common.items() if c / (len(s) + len(sets[j]) - c) >= threshold}
    return found


def split_overlaps(records, splits, n, threshold):
    """records: (query_id, query, pos_id); splits: (query_id, split)."""
    split = {q: s for q, s in splits if q is not None and s is not None}
    sets, keys = {}, defaultdict(set)
    for q, text, pos in records:
        if q is not None:
            sets[q] = shingles(text, n)
            if pos is not None:
                keys[q].add(pos)
    train = [q for q in sets if split.get(q) == "train"]
    found = set()
    by_word, by_pos = defaultdict(set), defaultdict(set)
    for t in train:
        for w in sets[t]:
            by_word[w].add(t)
        for p in keys[t]:
            by_pos[p].add(t)
    for e in sets:
        if split.get(e) in ("val", "test"):
            found |= {(e, t, "query") for t in {t for w in sets[e] for t in by_word[w]} if jaccard(sets[e], sets[t]) >= threshold}
            found |= {(e, t, "pos_id") for p in keys[e] for t in by_pos[p]}
    return found


def shared_runs(docs, length):
    """docs: (id, text)."""
    where = defaultdict(set)
    for i, t in docs:
        if i is not None and t:
            for at in range(len(t) - length + 1):
                where[t[at : at + length]].add(i)
    found = set()
    for i, t in docs:
        if i is None or not t:
            continue
        shared = [False] * len(t)
        for at in range(len(t) - length + 1):
            if len(where[t[at : at + length]]) > 1:
                shared[at : at + length] = [True] * length
        for m in re.finditer(b"\x01+", bytes(shared)):
            found.add((i, m.start(), m.end()))
    return found


__all__ = ["combinations"]
