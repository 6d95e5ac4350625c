"""Problem 4: records of evaluation splits that stand in the training split too, exactly or almost.

Method: exact prefix-filter bipartite join. Records with the same set of words are one set (so copies are never paired
with each other); words are ordered from rare to common over all sets; two sets of similarity ``threshold`` or more share
a word among their first ``n - ceil(threshold * n) + 1``. Evaluation prefixes are the index, training prefixes probe
it; sizes and positions are compared in the join itself, then the overlap is verified. No pair is lost.
Records that name the same passages are likewise one class, and reports multiply class sizes instead of listing pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trelliq.llm.words import shingles, words
from trelliq.session import written

TRAIN, EVAL = 1, 2
SKETCH_WORDS = 2
#: A passage of more classes of records than this is hot.
HOT = 1000


def at_least(share: float, n: Column) -> Column:
    """The smallest integer that is ``share`` of ``n`` or more; the small term undoes rounding of doubles."""
    return F.ceil(F.lit(share) * n - F.lit(1e-9))


def sketch(items: str, word: int) -> Column:
    """64 bits of a set: each of its items flips one bit of one of SKETCH_WORDS words; the distance of two sketches never exceeds
    that of the sets."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def flipped(bits: Column, item: Column) -> Column:
        at = F.pmod(F.xxhash64(item, F.lit(7)), F.lit(64 * SKETCH_WORDS)).cast("int")
        return bits.bitwiseXOR(F.when(F.floor(at / 64) == word, F.call_function("shiftleft", one, at % 64)).otherwise(zero))

    return F.aggregate(items, zero, flipped)


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(eval_key, train_key) of similar sets across sides; ``sets`` has (key, items array<string>, sides).

    Prefix rows hold a word's hash, the key, the size, the position and a sketch, so a long record sends a number of rows but
    no copies of itself; the words are fetched once for each pair that the filters leave.
    """
    counts = sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("df"))
    items = sets.select("key", F.explode("items").alias("item")).join(counts, "item")
    ordered = items.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("o"))
    ordered = sets.select("key", "sides").join(ordered, "key").select("key", "sides", F.transform("o", lambda x: x["item"]).alias("items"), F.size("o").alias("n"))
    words_of = [f"s{i}" for i in range(SKETCH_WORDS)]
    ordered = written(ordered.select("*", *(sketch("items", i).alias(w) for i, w in enumerate(words_of))), "ordered")

    def prefixes(side: int) -> DataFrame:
        p = (F.col("n") - at_least(threshold, F.col("n")) + 1).cast("int")
        rows = ordered.filter(F.col("sides").bitwiseAND(side) != 0)
        return rows.select("key", "n", *words_of, F.posexplode(F.slice("items", F.lit(1), p)).alias("pos", "item")).withColumn("item", F.xxhash64("item"))

    e, t = prefixes(EVAL).alias("e"), prefixes(TRAIN).alias("t")
    reach, both = F.least(F.col("e.n") - F.col("e.pos"), F.col("t.n") - F.col("t.pos")), F.col("e.n") + F.col("t.n")
    apart = sum((F.bit_count(F.col(f"e.{w}").bitwiseXOR(F.col(f"t.{w}"))) for w in words_of), F.lit(0))
    pairs = (
        e.join(t, F.col("e.item") == F.col("t.item"))
        .filter((F.col("e.n") >= at_least(threshold, F.col("t.n"))) & (F.col("t.n") >= at_least(threshold, F.col("e.n"))))
        .filter(reach >= at_least(threshold / (1 + threshold), both))
        .filter(apart <= F.lit((1 - threshold) / (1 + threshold)) * both + F.lit(1e-9))
        .select(F.col("e.key").alias("eval_key"), F.col("t.key").alias("train_key"))
        .distinct()
    )

    def of(side: str) -> DataFrame:
        return ordered.select(F.col("key").alias(f"{side}_key"), F.col("items").alias(f"{side}_items"))

    common, both = F.size(F.array_intersect("eval_items", "train_items")), F.size("eval_items") + F.size("train_items")
    found = written(pairs, "pairs").join(of("eval"), "eval_key").join(of("train"), "train_key")
    return found.filter(common / (both - common) >= threshold).select("eval_key", "train_key")


def sides_of(splits: DataFrame, train: str = "train", evaluation: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """(query_id, side) of the records that have a side; rows with a null or another split are left out."""
    side = F.when(F.col("split") == train, TRAIN).when(F.col("split").isin(*evaluation), EVAL)
    return splits.select("query_id", side.alias("side")).filter("query_id IS NOT NULL AND side IS NOT NULL").distinct()


def overlap_classes(records: DataFrame, splits: DataFrame, words_in_shingle: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, near, kinds): members(via, key, query_id, side), near(eval_key, train_key) of similar classes of queries, and
    kinds(key, sides, pos_id) of the classes by passages.

    A class is a set of words for via 'query' and a set of pos_ids for via 'pos_id'. So records that are alike, or that
    name the same hot passage, are one class, and a pair of classes stands for all pairs of their members. A query_id
    has one query; of several the smallest counts.
    """
    sides = written(sides_of(splits), "sides")
    own = records.filter("query_id IS NOT NULL").groupBy("query_id").agg(F.min("query").alias("query"))
    worded = own.join(sides, "query_id").select("query_id", "side", words(F.col("query")).alias("words"))
    # Written before anything looks at the items: a filter would push their computation down and repeat it.
    worded = written(worded.select("query_id", "side", shingles("words", words_in_shingle).alias("items")), "members").filter("size(items) > 0")
    key = F.unhex(F.md5(F.array_join("items", " ")))
    worded = worded.withColumn("key", key)
    near = similar_sets(worded.groupBy("key").agg(F.first("items").alias("items"), F.expr("bit_or(side)").alias("sides")), threshold)

    named = records.select("query_id", "pos_id").filter("query_id IS NOT NULL AND pos_id IS NOT NULL").distinct().join(sides, "query_id")
    # A record's passages are its own few; their digest is the class of all records with just these.
    placed = written(named.groupBy("query_id", "side").agg(F.array_sort(F.collect_set("pos_id")).alias("pos_ids")).withColumn("key", F.unhex(F.md5(F.to_json("pos_ids")))), "named")
    kinds = placed.groupBy("key").agg(F.first("pos_ids").alias("pos_ids"), F.expr("bit_or(side)").alias("sides")).select("key", "sides", F.explode("pos_ids").alias("pos_id"))

    members = worded.select(F.lit("query").alias("via"), "key", "query_id", "side").unionByName(placed.select(F.lit("pos_id").alias("via"), "key", "query_id", "side"))
    return members, near, kinds


def sharing(kinds: DataFrame, value: str = "pos_id") -> DataFrame:
    """(eval_key, train_key) of the classes of ``kinds`` (key, sides, value) across sides that have a value in common."""

    def of(side: int, name: str) -> DataFrame:
        return kinds.filter(F.col("sides").bitwiseAND(side) != 0).select(value, F.col("key").alias(name))

    return of(EVAL, "eval_key").join(of(TRAIN, "train_key"), value).select("eval_key", "train_key").distinct()


def cross_split_overlaps(records: DataFrame, splits: DataFrame, words_in_shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """(eval_id, train_id, via) of every overlap across splits; via is 'query' or 'pos_id'.

    ``records`` has (query_id, query, pos_id), ``splits`` (query_id, split). Null ids, splits and pos_ids never match;
    records whose query has too few words have no match by query; repeated rows count once; records without a split are
    left out. Extra columns are ignored, whatever their names. Empty tables give an empty frame.
    """
    members, near, kinds = overlap_classes(records, splits, words_in_shingle, threshold)
    pairs = near.select(F.lit("query").alias("via"), "eval_key", "train_key").unionByName(sharing(kinds).select(F.lit("pos_id").alias("via"), "eval_key", "train_key"))

    def side(n: int, key: str, name: str) -> DataFrame:
        return members.filter(F.col("side") == n).select("via", F.col("key").alias(key), F.col("query_id").alias(name))

    found = pairs.join(side(EVAL, "eval_key", "eval_id"), ["via", "eval_key"]).join(side(TRAIN, "train_key", "train_id"), ["via", "train_key"])
    return found.filter("eval_id <> train_id").select("eval_id", "train_id", "via")


def partners_by_passage(kinds: DataFrame, train: DataFrame, hot: int = HOT) -> DataFrame:
    """(key, n): training records that share a passage with an evaluation class, each counted once; ``train`` has (key, n).

    A passage of more than ``hot`` classes is hot. Classes with the same hot passages count as one there, so a record that
    names a hot passage beside others is not paired with all records that do so too; pairs by the other passages are
    then formed and count where the two share no hot one."""
    often = kinds.groupBy("pos_id").agg(F.count("*").alias("c")).filter(F.col("c") > hot).select("pos_id", F.lit(True).alias("hot"))
    marked = written(kinds.join(often, "pos_id", "left"), "marked")
    hots = F.array_sort(F.collect_set(F.when(F.col("hot"), F.col("pos_id"))))
    heads = written(marked.groupBy("key").agg(F.first("sides").alias("sides"), hots.alias("hots")).withColumn("head", F.unhex(F.md5(F.to_json("hots")))), "heads")
    named = heads.filter("size(hots) > 0").groupBy(F.col("head").alias("key")).agg(F.first("hots").alias("hots"), F.expr("bit_or(sides)").alias("sides"))
    met = written(sharing(named.select("key", "sides", F.explode("hots").alias("pos_id"))), "met")
    of_head = heads.join(train, "key").groupBy(F.col("head").alias("train_key")).agg(F.sum("n").alias("n"))
    by_hot = met.join(of_head, "train_key").groupBy(F.col("eval_key").alias("head")).agg(F.sum("n").alias("n"))
    by_hot = heads.filter(F.col("sides").bitwiseAND(EVAL) != 0).join(by_hot, "head").select("key", "n")
    head = heads.select("key", "head")
    rare = sharing(marked.filter("hot IS NULL").select("key", "sides", "pos_id"))
    rare = rare.join(head.select(F.col("key").alias("eval_key"), F.col("head").alias("a")), "eval_key").join(head.select(F.col("key").alias("train_key"), F.col("head").alias("b")), "train_key")
    rare = rare.join(met.select(F.col("eval_key").alias("a"), F.col("train_key").alias("b")), ["a", "b"], "left_anti")
    by_rare = rare.join(train.withColumnRenamed("key", "train_key"), "train_key").groupBy(F.col("eval_key").alias("key")).agg(F.sum("n").alias("n"))
    return by_hot.unionByName(by_rare).groupBy("key").agg(F.sum("n").alias("n"))


def overlap_report(records: DataFrame, splits: DataFrame, words_in_shingle: int = 5, threshold: float = 0.8, hot: int = HOT) -> DataFrame:
    """(split, source, via, n_queries, n_pairs): overlaps counted by evaluation split and source (null source kept).

    The counts are sums and products of class sizes, so no pair of records is formed, however many records a class or a
    passage has. Defined for the same awkward rows as ``cross_split_overlaps``.
    """
    members, near, kinds = overlap_classes(records, splits, words_in_shingle, threshold)
    members = written(members, "members")
    train = written(members.filter(F.col("side") == TRAIN).groupBy("via", "key").agg(F.count("*").alias("n")), "train")
    by_query = near.join(train.filter("via = 'query'").select(F.col("key").alias("train_key"), "n"), "train_key").groupBy(F.col("eval_key").alias("key")).agg(F.sum("n").alias("n"))
    by_passage = partners_by_passage(kinds, train.filter("via = 'pos_id'").select("key", "n"), hot)
    partners = by_query.withColumn("via", F.lit("query")).unionByName(by_passage.withColumn("via", F.lit("pos_id")))
    # A record on both sides is no partner of its own.
    both = members.filter(F.col("side") == TRAIN).select("via", "key", "query_id", F.lit(1).alias("itself"))
    held = members.filter(F.col("side") == EVAL).drop("side").join(partners, ["via", "key"]).join(both, ["via", "key", "query_id"], "left")
    held = held.select("via", "query_id", (F.col("n") - F.coalesce("itself", F.lit(0))).alias("n")).filter("n > 0")
    places = splits.select("query_id", "split", "source").distinct()
    return held.join(places, "query_id").groupBy("split", "source", "via").agg(F.count("*").alias("n_queries"), F.sum("n").alias("n_pairs"))
