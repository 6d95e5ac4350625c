"""Problem 3: records that share most of their content although small edits set them apart.

Method: PartEnum. Each record is the set of its word shingles, and similarity bounds by how many features two sets may
differ. The feature domain is cut into parts, and a signature is what a set holds of some parts; subsets of parts are
enumerated until two similar sets must have one in common. ``design`` says how fine the parts are:

* From a similarity of 0.7 on, sets fall into bands of sizes such that partners lie in the same or the next band. The domain is
  cut by hash into ``n1`` partitions of N2 parts, and each choice of N2 - 1 parts of a partition is a signature. As at
  most ``k`` features differ, some partition has at most one of them. Empty projections would join everything, so they are no
  signatures; small sets, and sets that may share few rare features, therefore sign by the finest parts too.
* Below 0.7 sets may differ in so many features that a coarse part either holds one or is empty. There each feature is a
  part of its own. Of a set's features in order of rarity, any ``size - least overlap + c`` first ones hold c of those
  shared with a partner, so signatures are the single rare features among the first ``size - overlap + 1``, and where
  common features stand there, subsets of two common ones among the first ``size - overlap + 2``. No pair is lost.

Features of more than COMMON records are common, at every size of the table; no group of a signature with a rare one has
more rows. Rarity is read from shared files (``rarities``), so nothing that grows is broadcast. Subsets of common features
also carry a band of sizes: position bounds the overlap that is left, and with it the sizes of partners, so records that
have just a common passage between them never meet. Signature rows hold the overlap left and a parity sketch, whose
distance never exceeds the true one; most false candidates fall in the join itself. Pairs are verified on the whole sets.
Equal sets are one class before anything is joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trelliq.llm.batches import by_size, by_text
from trelliq.llm.bloom import Layout, fraction, opened, range_files, range_of, scattered
from trelliq.llm.shared_spans import spread
from trelliq.session import ship, written

#: A feature of more records than this is common.
COMMON = 256
#: Parts of a partition; one is left out of each signature.
N2 = 3
#: Sets of at most so many features, and sets that may share as few rare ones with a partner, also sign by single features.
THIN = 32
#: Common features of which all subsets of two are signed, at most.
SUBSETS = 24
SKETCH_WORDS = 4
#: Features that are signed at once.
CHUNK = 1 << 18
WORD = re.compile(r"[^\W_]+")
KEEP_WORDS = 200_000


# Feature sets


class Words(dict):
    """Hashes of the words met so far, forgotten when there are KEEP_WORDS of them."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= KEEP_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def feature_sets(texts: list[str], n: int, known: Words) -> tuple[np.ndarray, np.ndarray]:
    """(features, sizes): the sorted distinct 64-bit hashes of the runs of ``n`` words of each lower-cased text, end to end."""
    lists = [WORD.findall(t) for t in texts]
    counts = np.array([len(x) for x in lists], np.int64)
    flat = np.fromiter(map(known.__getitem__, chain.from_iterable(lists)), np.uint64, int(counts.sum()))
    runs = np.maximum(counts - n + 1, 0)
    row = np.repeat(np.arange(len(texts)), runs)
    at = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(np.cumsum(counts) - counts, runs)
    h = np.zeros(len(row), np.uint64)
    for k in range(n):
        h = spread(h * np.uint64(0x9E3779B97F4A7C15) + flat[at + k] + np.uint64(k + 1))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.empty(0, np.int64)
    return h[new].view(np.int64), np.bincount(row[new], minlength=len(texts)).astype(np.int64)


def hashed_sets(df: DataFrame, n: int) -> DataFrame:
    """(id, key, features) of the rows of ``df`` (id, text: lower-cased) with a feature; equal keys mean equal sets."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = Words()
        for whole in batches:
            for batch in by_text(whole, 1):
                flat, sizes = feature_sets(batch.column(1).to_pylist(), n, known)
                ends = np.r_[0, np.cumsum(sizes)]
                some = pa.array(np.flatnonzero(sizes))
                keys = pa.array([xxhash.xxh3_128_digest(flat[a:b].tobytes()) for a, b in zip(ends, ends[1:])], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([c.take(some) for c in (batch.column(0), keys, lists)], names=["id", "key", "features"])

    return df.mapInArrow(build, "id string, key binary, features array<bigint>")


# Rarity


class Table:
    """Bytes of one range: at the place of a feature the number of binary digits of its count, the largest of a place."""

    def __init__(self, layout: Layout):
        self.layout, self.digits = layout, np.zeros(layout.bits, np.uint8)

    def add(self, feature: pa.Array, df: pa.Array) -> None:
        np.maximum.at(self.digits, slot(feature.to_numpy(), self.layout), np.ceil(np.log2(df.to_numpy())).astype(np.uint8))

    def done(self) -> bytes:
        return self.digits.tobytes()


def slot(h: np.ndarray, layout: Layout) -> np.ndarray:
    return fraction(scattered(scattered(h)), layout.bits)


def rarities(counts: DataFrame, layout: Layout) -> str:
    """Folder of the tables of ``counts`` (feature, df); a feature that is left out counts as the rarest.

    Where features share a place the most common one counts, so a common feature is common for every set."""

    @F.pandas_udf("int")
    def place(h: pd.Series) -> pd.Series:
        return pd.Series(range_of(h.to_numpy(), layout).astype(np.int32))

    ship(counts.sparkSession)
    return range_files(counts.select(place("feature").alias("range"), "feature", "df"), "rarity", lambda: Table(layout), 3)


def rarity(folder: str, layout: Layout, h: np.ndarray) -> np.ndarray:
    """Binary digits of the count of each feature: 0 for the rarest."""
    found = np.zeros(len(h), np.uint8)
    for own, digits in opened(folder).split(h, layout):
        found[own] = digits[slot(h[own], layout)]
    return found


# Signatures


def least_overlap(threshold: float, n: np.ndarray) -> np.ndarray:
    """Features that a set of ``n`` shares with any partner, at least."""
    return np.ceil(threshold * n - 1e-9).astype(np.int64)


@cache
def band_starts(ratio: float, longest: int) -> np.ndarray:
    """Smallest size of each band, growing by ``ratio``, up to one beyond ``longest``."""
    out = [1]
    while out[-1] <= longest:
        out.append(max(out[-1] + 1, int(out[-1] * ratio + 1e-9) + 1))
    return np.array(out, np.int64)


def band_of(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.searchsorted(starts, n, side="right") - 1


def design(threshold: float, largest: int) -> int:
    """Number of partitions for sets of at most ``largest`` features: of the ``k`` features in which two of them may differ,
    some partition has at most one; 0 below a similarity of 0.7, where only the finest parts will do."""
    k = int((1 - threshold) / (1 + threshold) * 2 * largest + 1e-9)
    return 0 if threshold < 0.7 else 2 * (k + 1) if largest <= THIN else k // 2 + 1


#: Roles of signature rows, as bits: two rows with a bit in common are not compared with each other.
LARGER, FEW = 1, 2


def signatures(flat: np.ndarray, sizes: np.ndarray, digits: np.ndarray, threshold: float, common: int = COMMON) -> tuple[np.ndarray, ...]:
    """(row, signature, reach, role) of sets given as concatenated feature hashes with their rarity.

    reach is the overlap of a pair that has its first shared feature there, at most.
    """
    own, mixed = np.repeat(np.arange(len(sizes)), sizes), spread(flat.view(np.uint64))
    is_common = digits > np.ceil(np.log2(common))
    # By rarity, then hash; features of a set come in one order everywhere, which settles the ties of the shortened hash.
    order = np.lexsort(((digits.astype(np.uint64) << np.uint64(57)) | (mixed >> np.uint64(7)), own))
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - np.repeat(starts, sizes)
    least = least_overlap(threshold, sizes)
    rare = sizes - np.bincount(own, weights=is_common, minlength=len(sizes)).astype(np.int64)
    # With coarse parts, the finest are for sets that may share THIN rare features or fewer; both sides of such a pair sign.
    whole = (threshold < 0.7) | (sizes <= THIN) | (least - (sizes - rare) <= THIN)
    first = sizes - least + 1
    at = np.flatnonzero((place < first[own]) & whole[own] & ~is_common[order])
    out = [(own[at], spread(mixed[order[at]] + np.uint64(1)), sizes[own[at]] - place[at], np.zeros(len(at), np.int64))]
    for i in np.flatnonzero(whole & (rare < first)).tolist():
        n = int(sizes[i])
        out += common_signatures(i, mixed[order[starts[i] + rare[i] : starts[i] + n]], int(rare[i]), n, threshold)
    if threshold >= 0.7:
        out += coarse_signatures(mixed[~is_common], own[~is_common], sizes, threshold)
    row, sig, reach, role = (np.concatenate(x) for x in zip(*out))
    return row, sig.view(np.int64), reach.astype(np.int32), role.astype(np.int8)


def common_signatures(row: int, features: np.ndarray, before: int, n: int, threshold: float) -> list[tuple[np.ndarray, ...]]:
    """Signatures by the common ``features`` of a set of ``n``, in order behind ``before`` rare ones.

    A pair that shares no rare feature shares two common ones among the first ``n - least + 2`` of either, and nothing
    before the first of them. Subsets of two are signed where there are at most SUBSETS features to choose from. Sets with
    more sign by one, and so do the others, which do not meet each other there. What is left behind the shared features
    bounds the overlap and so the size of the partner: a set meets larger ones in its own band of sizes, and smaller
    ones in theirs.
    """
    least = int(least_overlap(threshold, np.array([n]))[0])
    ahead, some = n - least + 1 - before, min(len(features), n - least + 2 - before)
    few = least > 1 and some <= SUBSETS
    one = np.arange(min(ahead, len(features)))
    kinds = [(spread(features[one] + np.uint64(3)), n - before - one, FEW if few else 0)]
    if few and some > 1:
        i, j = np.array(list(combinations(range(some), 2))).T
        kinds.append((spread(features[i] ^ spread(features[j] + np.uint64(5))), 1 + n - before - j, 0))
    starts = band_starts(1.25, int(n / threshold) + 1)
    low, mine = band_of(starts, np.array([least, n])).tolist()
    out = []
    for key, reach, role in kinds:
        most = np.floor(reach * (1 + threshold) / threshold + 1e-9).astype(np.int64) - n
        for band in range(low, mine + 1):
            use = most >= starts[band]
            # Only a set that may have a partner of its own size or more can be the smaller one of a pair.
            larger = np.where((most >= n) & (band == mine), 0, LARGER)
            out.append((np.full(int(use.sum()), row), spread(key[use] + np.uint64(band + 11)), reach[use], role | larger[use]))
    return out


def coarse_signatures(f: np.ndarray, own: np.ndarray, sizes: np.ndarray, threshold: float) -> list[tuple[np.ndarray, ...]]:
    """Signatures of the choices of N2 - 1 parts of each partition, for a set's band of sizes and the next."""
    starts = band_starts(1 / threshold, int(sizes.max(initial=1)))
    band, out = band_of(starts, sizes), []
    for instance in np.unique(np.r_[band, band + 1]).tolist():
        inside = np.isin(band[own], (instance, instance - 1))
        if not inside.any():
            continue
        x, who = f[inside], own[inside]
        largest = int(starts[instance + 1]) - 1 if instance + 1 < len(starts) else int(starts[-1] / threshold + 1e-9)
        n1 = design(threshold, largest)
        part = fraction(spread(x + np.uint64(2 * instance + 3)), n1 * N2)
        for number, subset in enumerate(combinations(range(N2), N2 - 1)):
            chosen = np.isin(part % N2, subset)
            key = who[chosen] * n1 + part[chosen] // N2
            by = np.argsort(key, kind="stable")
            key = key[by]
            if not len(key):
                continue
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            content = np.add.reduceat(spread(x[chosen][by] ^ np.uint64(0x9E3779B97F4A7C15)), first)
            salt = (np.uint64(instance * 64 + number) << np.uint64(32)) + (key[first] % n1).astype(np.uint64)
            row = key[first] // n1
            out.append((row, spread(content + spread(salt)), sizes[row], np.zeros(len(row), np.int64)))
    return out


def sketches(flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """SKETCH_WORDS parity words of each (non-empty) set: every feature flips one bit."""
    bit = spread(flat.view(np.uint64) + np.uint64(77)) % np.uint64(64 * SKETCH_WORDS)
    value = np.left_shift(np.uint64(1), bit & np.uint64(63))
    starts = np.cumsum(sizes) - sizes
    return [np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == w, value, np.uint64(0)), starts).view(np.int64) for w in range(SKETCH_WORDS)]


SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]


def signed_classes(classes: DataFrame, threshold: float, common: int) -> DataFrame:
    """(sig, class_id, n, reach, role, sketch words) of ``classes`` (class_id, features)."""
    counts = classes.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("df")).filter("df > 2")
    counts = written(counts, "counts")
    layout = Layout.of(counts.count())
    folder = rarities(counts, layout)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, whole.column(1).value_lengths().to_numpy(), CHUNK):
                lists = batch.column(1)
                sizes = lists.value_lengths().to_numpy().astype(np.int64)
                flat = lists.flatten().to_numpy()
                row, sig, reach, role = signatures(flat, sizes, rarity(folder, layout, flat), threshold, common)
                columns = [batch.column(0), pa.array(sizes.astype(np.int32)), *map(pa.array, sketches(flat, sizes))]
                for at in range(0, len(row), CHUNK):
                    own = pa.array(row[at : at + CHUNK])
                    ids, n, *words = (c.take(own) for c in columns)
                    yield pa.RecordBatch.from_arrays([pa.array(sig[at : at + CHUNK]), ids, n, pa.array(reach[at : at + CHUNK]), pa.array(role[at : at + CHUNK]), *words], names=["sig", "class_id", "n", "reach", "role", *SKETCH])

    return classes.select("class_id", "features").mapInArrow(sign, "sig bigint, class_id string, n int, reach int, role tinyint, " + ", ".join(f"{s} bigint" for s in SKETCH))


def candidates(signed: DataFrame, threshold: float) -> DataFrame:
    """(class_a, class_b) of classes that have a signature in common and pass the bounds of size, reach and sketch."""
    a, b = signed.alias("a"), signed.alias("b")
    both, small = F.col("a.n") + F.col("b.n"), F.lit(1e-9)
    apart = sum((F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}"))) for s in SKETCH), F.lit(0))
    return (
        a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.class_id") < F.col("b.class_id")))
        .filter(F.col("a.role").bitwiseAND(F.col("b.role")) == 0)
        .filter(F.least("a.n", "b.n") >= F.lit(threshold) * F.greatest("a.n", "b.n") - small)
        .filter(F.least("a.reach", "b.reach") >= F.lit(threshold / (1 + threshold)) * both - small)
        .filter(apart <= F.lit((1 - threshold) / (1 + threshold)) * both + small)
        .select(F.col("a.class_id").alias("class_a"), F.col("b.class_id").alias("class_b"))
        .distinct()
    )


def near_duplicates(df: DataFrame, id_col: str, text_col: str, words_in_shingle: int = 5, threshold: float = 0.8, common: int = COMMON) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    members(class_id, id): every id with a shingle set, class_id the smallest id with the same set. links(class_a,
    class_b, similarity), class_a < class_b: all pairs of classes with a Jaccard similarity of ``threshold`` or more.
    Null ids and texts and texts with fewer words than a shingle have no row; repeated rows count once; extra columns
    are ignored, whatever their names. An empty table gives two empty frames.
    """
    ship(df.sparkSession)
    texts = df.select(F.col(id_col).cast("string").alias("id"), F.lower(F.col(text_col)).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    sets = written(hashed_sets(texts, words_in_shingle), "sets")
    classes = written(sets.groupBy("key").agg(F.min("id").alias("class_id"), F.first("features").alias("features")), "classes")
    members = sets.select("key", "id").distinct().join(classes.select("key", "class_id"), "key").select("class_id", "id")
    signed = written(signed_classes(classes, threshold, common), "signatures")
    fa = classes.select(F.col("class_id").alias("class_a"), F.col("features").alias("fa"))
    fb = classes.select(F.col("class_id").alias("class_b"), F.col("features").alias("fb"))
    shared = F.size(F.array_intersect("fa", "fb"))
    links = written(candidates(signed, threshold), "pairs").join(fa, "class_a").join(fb, "class_b").select("class_a", "class_b", (shared / (F.size("fa") + F.size("fb") - shared)).alias("similarity"))
    return members, links.filter(F.col("similarity") >= threshold)


def expanded_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all similar pairs of ids, those within a class included."""
    a = members.select(F.col("class_id").alias("class_a"), F.col("id").alias("x"))
    b = members.select(F.col("class_id").alias("class_b"), F.col("id").alias("y"))
    within = members.alias("m").join(members.alias("o"), (F.col("m.class_id") == F.col("o.class_id")) & (F.col("m.id") < F.col("o.id"))).select(F.col("m.id").alias("id_a"), F.col("o.id").alias("id_b"))
    across = links.join(a, "class_a").join(b, "class_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return within.unionByName(across)


def link_counts(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, n_copies, n_links) of every record: its class, the records in it, the other classes it links to."""
    ends = links.select(F.col("class_a").alias("class_id")).unionByName(links.select(F.col("class_b").alias("class_id")))
    n_links = ends.groupBy("class_id").agg(F.count("*").alias("n_links"))
    sizes = members.groupBy("class_id").agg(F.count("*").alias("n_copies"))
    return members.join(sizes.join(n_links, "class_id", "left").fillna(0, ["n_links"]), "class_id").select("id", "class_id", "n_copies", "n_links")
