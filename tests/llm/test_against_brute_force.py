"""Every operator against its plain version: on the smallest tables and on rows made to be awkward."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from trelliq.llm import queries as q
from trelliq.llm.component_splits import components, related_groups, split_groups
from trelliq.llm.format_duplicates import format_classes
from trelliq.llm.near_duplicates import expanded_pairs, link_counts, near_duplicates
from trelliq.llm.shared_spans import merged_runs, shared_shares, shared_spans
from trelliq.llm.split_overlap import cross_split_overlaps, overlap_report
from trelliq.sources.tables import table

SMALL = "/root/testdata/sf0.001"


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def once(df, *columns):
    """The rows as a set, after making sure that none comes twice."""
    found = rows(df, *columns)
    assert len(found) == len(set(found))
    return set(found)


# Problem 1

AWKWARD = ["", "   ", None, "!!", "A b", "a-B", "a_b", "ab", "a: 1, b: 2; c: 3", "C:3\nA:1 | b : 2,", "c 3 a 1 b 2", "a:1,b:2", "a1b2", "x:1,y:2,z", "É: 1, ö: 2, ü: 3", "Ö:2;Ü:3;é:1",
           "a:1,a:1,b:2", "b:2,a:1", "a:1:2,b:2,c:3", ":1,b:2,c:3", "ΣΑΣ", "σας", "ẞ", "ß", "１２", "12", "a b", "y" * 50_000, "Y" * 50_000]


def test_format_classes_on_tables(spark):
    given = [("corpus", *r) for r in rows(table(spark, SMALL, "corpus"), "id", "text")] + [("merged", *r) for r in rows(table(spark, SMALL, "merged"), "query_id", "query")]
    assert once(q.p1_found(spark, SMALL), "tab", "keep_id", "copy_id") == brute.format_copies(given)
    assert once(q.p1_classes(spark, SMALL), "tab", "keep_id", "n_records") == set(brute.format_sizes(given))


def test_format_classes_awkward(spark):
    given = [("t", f"i{n:02}", t) for n, t in enumerate(AWKWARD)] + [("t", "i04", "A b"), ("u", "i05", "ab"), ("t", None, "ab")]
    df = spark.createDataFrame(given, "tab string, id string, text string").withColumn("h", F.lit(1)).withColumn("canon", F.lit("x")).repartition(3)
    classes, copies = format_classes(df, "id", "text", by="tab")
    assert once(copies, "tab", "keep_id", "copy_id") == brute.format_copies(given)
    assert once(classes, "tab", "keep_id", "n_records") == set(brute.format_sizes(given))


def test_format_classes_in_many_ranges(spark):
    given = [("", f"{n:05}", f"text {n // 2}") for n in range(20_000)]
    df = spark.createDataFrame(given, "tab string, id string, text string").repartition(4)
    classes, copies = format_classes(df, "id", "text", range_bits=1 << 15)
    assert copies.count() == 10_000 and classes.count() == 10_000


def test_one_id_with_two_texts_and_unshuffled_singletons(spark):
    df = spark.createDataFrame([("x", "foo one"), ("x", "bar two"), ("y", "baz"), ("z", None), ("z", "!")], "id string, text string")
    classes, copies = format_classes(df, "id", "text")
    assert sorted(rows(classes, "keep_id", "n_records")) == [("x", 1), ("x", 1), ("y", 1), ("z", 1)] and copies.count() == 0
    union, project, filtered = classes._jdf.queryExecution().optimizedPlan().toString().splitlines()[:3]
    assert union.startswith("Union") and project.startswith(":- Project") and "Filter" in filtered and "NOT again" in filtered and "NOT bare" in filtered


def test_format_classes_empty(spark):
    classes, copies = format_classes(spark.createDataFrame([], "id string, text string"), "id", "text")
    assert classes.count() == 0 and copies.count() == 0


# Problem 2


def grouped(df):
    out = {}
    for g, i, n in rows(df, "group_id", "id", "n"):
        out.setdefault(g, []).append((i, n))
    assert all(min(i for i, _ in m) == g and all(n == len(m) for _, n in m) for g, m in out.items())
    return {frozenset(i for i, _ in m) for m in out.values()}


def test_groups_on_tables(spark):
    merged = table(spark, SMALL, "merged")
    found = related_groups(merged, "query_id", "pos_id")
    assert grouped(found) == brute.groups(rows(merged, "query_id", "pos_id"))


@pytest.mark.parametrize("small_edges", [0, 5, 10_000])
def test_groups_of_any_shape(spark, small_edges):
    r = random.Random(small_edges)
    chain = [(f"c{n:03}", f"k{n + d}") for n in range(90) for d in (0, 1)]
    star = [(f"s{n:03}", "hub") for n in range(200)]
    loose = [(f"r{r.randrange(80)}", f"q{r.randrange(90)}") for _ in range(90)]
    given = chain + star + loose + [("n1", None), ("n1", None), (None, "k1"), (None, None), ("c000", "k0")]
    df = spark.createDataFrame(given, "x string, y string").withColumn("id", F.lit(1)).withColumn("key", F.lit(1)).repartition(5)
    assert grouped(related_groups(df, "x", "y", small_edges)) == brute.groups(given)


@pytest.mark.parametrize("shape", ["chain", "star", "fans"])
def test_levels_follow_the_logarithm_of_nodes(spark, shape):
    """Each level leaves at most half of the nodes, whatever the degrees."""
    if shape == "chain":
        edges = [(f"n{i:04}", f"n{i + 1:04}") for i in range(500)]
    elif shape == "star":
        edges = [("hub", f"n{i:04}") for i in range(500)]
    else:
        edges = [(f"s{i:02}", f"s{i + 1:02}") for i in range(18)] + [(f"s{i:02}", f"f{i:02}x{j}") for i in range(19) for j in range(i)]
    sizes = []
    found = components(spark.createDataFrame(edges, "src string, dst string").repartition(3), 0, sizes=sizes)
    labels = rows(found, "node", "label")
    assert len(labels) == len({x for e in edges for x in e}) and len({x for _, x in labels}) == 1
    assert all(2 * b <= a for a, b in zip(sizes, sizes[1:])) and len(sizes) <= len(labels).bit_length(), sizes


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "src string, dst string")).count() == 0
    assert related_groups(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_splits_keep_groups_and_shares(spark):
    r = random.Random(3)
    given = [(f"g{g}", f"g{g}i{n}") for g in range(600) for n in range(r.choice((1, 1, 2, 5)))] + [("giant", f"x{n}") for n in range(600)]
    groups = spark.createDataFrame(given, "group_id string, id string")
    shares = {"train": 0.8, "val": 0.1, "test": 0.1}
    found = rows(split_groups(groups.repartition(3), shares), "group_id", "id", "split")
    assert sorted((g, i) for g, i, _ in found) == sorted(given)
    assert len({(g, s) for g, _, s in found}) == len({g for g, _ in given})
    for s, share in shares.items():
        assert abs(sum(x == s for *_, x in found) / len(given) - share) < 0.01
    assert sorted(found) == sorted(rows(split_groups(groups.repartition(7), shares), "group_id", "id", "split"))
    assert split_groups(groups.limit(0), shares).count() == 0


# Problem 3


@pytest.mark.parametrize(("n", "threshold"), [(3, 0.5), (5, 0.8), (1, 0.6), (2, 0.9)])
def test_near_duplicates_on_tables(spark, n, threshold):
    corpus = table(spark, SMALL, "corpus")
    found = expanded_pairs(*near_duplicates(corpus, "id", "text", n, threshold))
    assert once(found, "id_a", "id_b") == brute.similar_pairs(rows(corpus, "id", "text"), n, threshold)


@pytest.mark.parametrize(("n", "threshold", "common"), [(1, 0.5, 256), (1, 0.8, 4), (2, 0.5, 8), (3, 0.5, 2), (3, 0.7, 256)])
def test_near_duplicates_of_every_size(spark, n, threshold, common):
    """Sizes from one word to some hundred, edits that land on both sides of the threshold, very common phrases."""
    r = random.Random(n)
    given = [("e", ""), ("n", None), (None, "a b c d"), ("w", "one"), ("p", "... !!")]
    for base in range(60):
        size = r.choice((2, 3, 4, 6, 9, 14, 20, 35, 70, 150))
        words = [r.choice(("the", "of", "was", f"w{r.randrange(3000)}", f"w{r.randrange(3000)}", f"w{r.randrange(3000)}")) for _ in range(size)]
        given.append((f"b{base}", " ".join(words)))
        for copy in range(r.randrange(6)):
            own = words[:]
            for _ in range(r.randrange(0, max(2, size // 4))):
                own[r.randrange(len(own))] = f"w{r.randrange(3000)}"
            given.append((f"b{base}c{copy}", " ".join(own) + r.choice(("", ".", "!"))))
    given += [(f"same{n}", "Same words, again and again") for n in range(40)] + [("same0", "Same words, again and again")]
    df = spark.createDataFrame(given, "id string, text string").withColumn("class_id", F.lit(1)).withColumn("features", F.lit(2)).repartition(4)
    members, links = near_duplicates(df, "id", "text", n, threshold, common)
    assert once(expanded_pairs(members, links), "id_a", "id_b") == brute.similar_pairs(given, n, threshold)
    assert all(abs(s - round(s, 12)) < 1e-9 and s >= threshold for (s,) in rows(links, "similarity"))
    counts = {i: (c, k) for i, c, k in rows(link_counts(members, links), "id", "n_copies", "n_links")}
    if n <= 3:
        assert counts["same3"][0] == 40


def test_near_duplicates_with_heavy_features(spark):
    """Most features of the sets are in every third row; pairs are found by the rest or by the prefix."""
    r = random.Random(5)
    common = [f"c{n}" for n in range(12)]
    given = [(f"{n:03}", " ".join(r.sample(common, 8) + [f"w{r.randrange(60)}" for _ in range(r.randrange(3))])) for n in range(300)]
    df = spark.createDataFrame(given, "id string, text string").repartition(4)
    found = expanded_pairs(*near_duplicates(df, "id", "text", 1, 0.7, common=4))
    assert once(found, "id_a", "id_b") == brute.similar_pairs(given, 1, 0.7)


def test_near_duplicates_empty(spark):
    members, links = near_duplicates(spark.createDataFrame([], "id string, text string"), "id", "text")
    assert members.count() == 0 and links.count() == 0


# Problem 4


def counted(found, places):
    """The report of pairs, one by one."""
    ids, pairs = {}, {}
    for e, t, via in found:
        for q_, s, o in places:
            if q_ == e:
                ids.setdefault((s, o, via), set()).add(e)
                pairs[s, o, via] = pairs.get((s, o, via), 0) + 1
    return {k: (len(ids[k]), pairs[k]) for k in pairs}


def test_overlap_report_of_a_hot_class(spark):
    """100,000 copies on each side: counted, never paired; and records on both sides."""
    n = 100_000
    text = F.when(F.col("id") % 4 < 2, "Same words in a hot query").otherwise(F.concat(F.lit("own "), F.col("id")))
    records = spark.range(2 * n).select(F.col("id").cast("string").alias("query_id"), text.alias("query"), F.lit("p").alias("pos_id"))
    splits = spark.range(2 * n).select(F.col("id").cast("string").alias("query_id"), F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"), F.lit("s").alias("source"))
    found = {v: (k, m) for v, k, m in rows(overlap_report(records, splits, 1, 0.8), "via", "n_queries", "n_pairs")}
    assert found == {"query": (n // 2, (n // 2) ** 2), "pos_id": (n, n * n)}
    both = spark.createDataFrame([("a", "train", "s"), ("a", "val", "s"), ("b", "train", "s"), ("c", "train", "s"), ("c", "test", None)], "query_id string, split string, source string")
    given = [("a", "one two", "p"), ("b", "two one", "q"), ("c", "three", "p")]
    own = spark.createDataFrame(given, "query_id string, query string, pos_id string")
    report = {(s, o, v): (k, m) for s, o, v, k, m in rows(overlap_report(own, both, 1, 0.8), "split", "source", "via", "n_queries", "n_pairs")}
    assert report == counted(set(rows(cross_split_overlaps(own, both, 1, 0.8), "eval_id", "train_id", "via")), set(rows(both, "query_id", "split", "source")))


@pytest.mark.parametrize("hot", [0, 3, 8, 1000])
def test_overlap_report_of_records_with_many_passages(spark, hot):
    """Several passages a record, a few of them in most: each pair counts once, whichever passages it shares."""
    r = random.Random(hot)
    given = [(f"q{i}", f"text {i}", p) for i in range(60) for p in {r.choice(("h1", "h1", "h2", f"p{r.randrange(20)}")) for _ in range(r.randrange(1, 5))}]
    splits = [(f"q{i}", r.choice(("train", "val", "test")), r.choice(("a", None))) for i in range(60)]
    own, sides = spark.createDataFrame(given, "query_id string, query string, pos_id string"), spark.createDataFrame(splits, "query_id string, split string, source string")
    report = {(s, o, v): (k, m) for s, o, v, k, m in rows(overlap_report(own, sides, 2, 0.9, hot), "split", "source", "via", "n_queries", "n_pairs")}
    assert report == counted(brute.split_overlaps(given, [x[:2] for x in splits], 2, 0.9), set(splits))


def test_long_records_send_rows_and_no_copies(spark):
    """The prefix rows of records of 10,000 words are as wide as those of short ones."""
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(10**9)}" for _ in range(10_000)) for _ in range(4)]
    given = [(str(i), t if i < 4 else texts[i - 4].replace("w1", "x1"), None) for i, t in enumerate(texts * 2)]
    df = spark.createDataFrame(given, "query_id string, query string, pos_id string")
    splits = spark.createDataFrame([(str(i), "train" if i < 4 else "test") for i in range(8)], "query_id string, split string")
    assert once(cross_split_overlaps(df, splits, 1, 0.75), "eval_id", "train_id", "via") == brute.split_overlaps(given, [tuple(x) for x in splits.collect()], 1, 0.75) != set()


def test_overlaps_on_tables(spark):
    merged, splits = table(spark, SMALL, "merged"), table(spark, SMALL, "split_rows")
    found = once(q.p4_pairs(spark, SMALL), "eval_id", "train_id", "via")
    assert found == brute.split_overlaps(rows(merged, "query_id", "query", "pos_id"), rows(splits, "query_id", "split"), 1, 0.75)
    places = set(rows(splits, "query_id", "split", "source"))
    report = {(s, o, v): (n, k) for s, o, v, n, k in rows(q.p4_report(spark, SMALL), "split", "source", "via", "n_queries", "n_pairs")}
    assert report == counted(found, places)


@pytest.mark.parametrize(("n", "threshold"), [(1, 0.75), (2, 0.5), (5, 0.8)])
def test_overlaps_awkward(spark, n, threshold):
    r = random.Random(n)
    records, splits = [], []
    for i in range(240):
        base = r.randrange(30)
        words = [f"w{base * 10 + j}" for j in range(3 + base % 9)]
        if r.random() < 0.7:
            words[r.randrange(len(words))] = f"x{r.randrange(9)}"
        records += [(f"q{i}", " ".join(words), r.choice((None, f"p{r.randrange(150)}")))] * r.choice((1, 1, 2))
        splits += [(f"q{i}", r.choice(("train", "train", "val", "test", None)))] * r.choice((0, 1, 1, 2))
    splits = list({q: (q, s) for q, s in splits}.values()) * 2
    records += [("e1", "", "p1"), ("e2", None, None), (None, "w1 w2 w3", "p1")]
    splits += [("e1", "test"), ("e2", "train"), (None, "train")]
    a = spark.createDataFrame(records, "query_id string, query string, pos_id string").withColumn("key", F.lit(1)).withColumn("side", F.lit(1))
    b = spark.createDataFrame(splits, "query_id string, split string").withColumn("source", F.lit(None).cast("string")).withColumn("query", F.lit("z"))
    found = cross_split_overlaps(a.repartition(3), b, n, threshold)
    assert once(found, "eval_id", "train_id", "via") == brute.split_overlaps(records, splits, n, threshold)
    wanted = brute.split_overlaps(records, splits, n, threshold)
    for hot in (1000, 2, 0):
        report = {(s, o, v): (k, m) for s, o, v, k, m in rows(overlap_report(a, b, n, threshold, hot), "split", "source", "via", "n_queries", "n_pairs")}
        assert report == counted(wanted, {(q_, s, None) for q_, s in splits})


def test_overlaps_empty(spark):
    a = spark.createDataFrame([], "query_id string, query string, pos_id string")
    assert cross_split_overlaps(a, spark.createDataFrame([], "query_id string, split string")).count() == 0


# Problem 8


def test_spans_on_tables(spark):
    docs = table(spark, SMALL, "documents")
    found = once(q.p8_found(spark, SMALL), "doc_id", "start_at", "end_at")
    assert found == brute.shared_runs(rows(docs, "doc_id", "text"), 160)
    shares = {d: (n, s) for d, n, s in rows(q.p8_shares(spark, SMALL), "doc_id", "n_chars", "n_shared")}
    assert set(shares) == {d for (d,) in rows(docs, "doc_id")}
    assert sum(s for _, s in shares.values()) == sum(e - b for _, b, e in found)


def awkward_documents(r):
    letters = "abcde \n\U0001f44dé"
    fresh = lambda n: "".join(r.choice(letters) for _ in range(n))
    parts = [fresh(n) for n in (19, 20, 21, 25, 40, 60, 100, 300)] + ["ab" * 60, "z" * 200]
    docs = [(0, None), (1, ""), (2, "short"), (None, parts[-1]), (3, "q" * 20), (4, "q" * 19), (5, "q" * 500)]
    for i in range(10, 90):
        text = ""
        for _ in range(r.randrange(1, 6)):
            p = r.choice(parts)
            a = r.choice((0, 0, r.randrange(len(p))))
            text += r.choice(("", fresh(r.randrange(30)))) + p[a : a + r.choice((19, 20, 22, 50, 400))]
        docs.append((i, text))
    return docs + docs[20:24] + [(200, docs[30][1]), (201, docs[30][1])]


def plain_tree_windows(h, width):
    """(token, first start, starts) of the nodes of the Cartesian tree over ``h`` that hold a whole window, from a stack."""
    n = len(h)
    left, right, stack = [0] * n, [n] * n, []
    for i in range(n):
        while stack and h[stack[-1]] > h[i]:
            right[stack.pop()] = i
        left[i] = stack[-1] + 1 if stack else 0
        stack.append(i)
    nodes = ((c, max(left[c], c - width + 1), min(c, right[c] - width)) for c in range(n))
    return sorted((c, a, b - a + 1) for c, a, b in nodes if b >= a)


def test_compact_windows_are_the_wide_nodes_of_the_tree():
    import numpy as np

    from trelliq.llm.shared_spans import compact_windows, gram_hashes, text_codes

    r = random.Random(3)
    texts = ["".join(r.choice("abcdef") for _ in range(n)) for n in (40, 41, 100, 700)] + ["abc" * 60]
    sig, piece, begin, count, off = compact_windows(texts, 40, 9)
    low = (1 << 22) - 1
    for i, t in enumerate(texts):
        h = gram_hashes(text_codes(t), 9)
        packed = [(int(x) & ~low) | k for k, x in enumerate(h)]
        mine = piece == i
        found = sorted(zip((begin + off)[mine].tolist(), begin[mine].tolist(), count[mine].tolist()))
        assert found == plain_tree_windows(packed, 40 - 9 + 1)
        assert (sig[mine] == h[(begin + off)[mine]].view(np.int64)).all()


@pytest.mark.parametrize("broken", [0, 1])
def test_spans_when_hashes_collide(spark, monkeypatch, broken):
    """Starts whose keys collide are told apart by their text."""
    import numpy as np

    from trelliq.llm import shared_spans as module

    rows_ = {"text": ["abcdefgh", "abcdefgh", "abcdXfgh", "zzzzefgh"], "n_starts": [5] * 4, "off": [2] * 4, "sig": [7] * 4}
    starts = module.Starts(rows_, 4)
    if broken:
        starts.keys = [np.zeros(len(k), np.uint64) for k in starts.keys]
    leader = starts.groups()
    span = lambda j: rows_["text"][starts.row[j]][starts.start[j] : starts.start[j] + 4]
    for a in range(20):
        for b in range(20):
            same = span(a) == span(b) and (broken or starts.start[a] == starts.start[b])
            assert (leader[a] == leader[b]) == same


@pytest.mark.parametrize(("seed", "gram", "max_group"), [(1, None, 4096), (2, 1, 4096), (3, 20, 4096), (4, None, 2), (5, 5, 1)])
def test_spans_awkward(spark, seed, gram, max_group):
    docs = awkward_documents(random.Random(seed))
    df = spark.createDataFrame(docs, "doc bigint, body string").withColumn("id", F.lit("x")).withColumn("text", F.lit("y")).withColumn("at", F.lit(1)).repartition(4)
    found = once(shared_spans(df, "doc", "body", 20, gram, max_group), "doc", "start_at", "end_at")
    assert found == brute.shared_runs(docs, 20)


def test_spans_across_pieces_of_a_long_text(spark, monkeypatch):
    from trelliq.llm import shared_spans as module

    monkeypatch.setattr(module, "CHUNK", 64)
    docs = [("a", "".join(chr(97 + (i * i) % 23) for i in range(400))), ("b", "x" * 30 + "".join(chr(97 + (i * i) % 23) for i in range(100, 300)))]
    found = [list(module.pieces([t for _, t in docs], 20))]
    starts = sorted((row, at + i) for rows_, offsets, texts in found[0] for row, at, t in zip(rows_, offsets, texts) for i in range(len(t) - 19))
    assert starts == [(n, i) for n, (_, t) in enumerate(docs) for i in range(len(t) - 19)]


def test_spans_of_string_ids_and_empty(spark):
    text = "".join(chr(97 + (i * 7 + i // 5) % 26) for i in range(100))
    docs = [("b", text), ("a", "--" + text[10:80]), ("b", text)]
    df = spark.createDataFrame(docs, "id string, text string")
    assert once(shared_spans(df, "id", "text", 30), "id", "start_at", "end_at") == brute.shared_runs(docs, 30)
    none = shared_spans(df.limit(0), "id", "text", 30)
    assert none.count() == 0 and shared_shares(df.limit(0), none, "id", "text").count() == 0


def test_very_long_texts(spark):
    """One character, a short period, and long texts that share most of what they have."""
    r = random.Random(9)
    long = "".join(r.choice("abcdefgh ") for _ in range(60_000))
    docs = [(1, "a" * 40_000), (2, "b" + "a" * 39_000), (3, "ab" * 20_000), (4, "-" + "ab" * 100 + "-"), (5, long), (6, "x" + long[:30_000] + "y" + long[30_000:]), (7, long[100:120])]
    df = spark.createDataFrame(docs, "id bigint, text string").repartition(3)
    assert once(shared_spans(df, "id", "text", 100), "id", "start_at", "end_at") == brute.shared_runs(docs, 100)
    texts = [(str(i), t) for i, t in docs]
    named = spark.createDataFrame(texts, "id string, text string")
    assert once(expanded_pairs(*near_duplicates(named, "id", "text", 3, 0.8)), "id_a", "id_b") == brute.similar_pairs(texts, 3, 0.8) == {("5", "6")}
    splits = spark.createDataFrame([(i, "test" if i == "6" else "train") for i, _ in texts], "query_id string, split string")
    records = named.selectExpr("id AS query_id", "text AS query", "CAST(NULL AS STRING) AS pos_id")
    assert once(cross_split_overlaps(records, splits, 3, 0.8), "eval_id", "train_id", "via") == {("6", "5", "query")}


def test_merged_runs(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 2, 3), (1, 11, 12), (2, 4, 6)], "id int, start_at bigint, end_at bigint")
    assert once(merged_runs(df), "id", "start_at", "end_at") == {(1, 0, 9), (1, 11, 12), (2, 4, 6)}


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_same_as_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SMALL}/{file}'")
    wanted = con.execute(q.SQL[name]).fetch_df()
    found = q.QUERIES[name](spark, SMALL)
    assert sorted(found.columns) == sorted(wanted.columns)
    assert sorted(rows(found, *sorted(wanted.columns)), key=str) == sorted(wanted[sorted(wanted.columns)].astype(object).where(wanted.notna(), None).itertuples(index=False, name=None), key=str)
