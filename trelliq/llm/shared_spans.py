"""Problem 8: spans of at least a given length that stand word for word in another document.

Method: compact windows. The tokens are all runs of ``gram`` characters, a span of ``length`` characters is a window of
``length - gram + 1`` tokens, and its signature is the smallest token hash in it. A compact window is a node of the
Cartesian tree over the hashes: the range in which one token stays the smallest. Only ranges as wide as a window matter;
the block-wise sliding minima below find just those, with the token they hang on. Equal spans have equal signatures
at equal places, so one hash function finds all of them, and windows that share a signature are the only candidates.

1. A scan counts signatures by hash range; those of two texts or more go into Bloom filters (bloom.py), those of more
   than MAX_GROUP windows into a list beside them. Both are shared files.
2. A second scan keeps the windows whose signature may recur. They are shuffled by signature once, and the windows of
   a signature are joined as intervals around their common token: equal ones are one, those of two documents are shared
   as a whole, the others start by start. Starts agree by a 128-bit key of span, signature and place, and by their text.
3. Windows of the listed signatures are never brought together: equal ones (signature, place and 128-bit digest) are
   combined before they are shuffled, the others become one row a start, combined likewise.

No pair of documents is ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trelliq.llm.bloom import BITS_PER_HASH, PARTS, RANGE_BITS, Layout, Seen, has, opened, positions, put, range_files, unpacked
from trelliq.session import ship, written

CHUNK = 1 << 20
POSITION_BITS = 22
#: Signatures with more windows than this are compared as rows instead of in one task.
MAX_GROUP = 4096
#: Windows sent on at once; a text of one character has a window at each place.
MOST_WINDOWS = 1 << 15

#: Odd multipliers of two independent polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _powers or len(_powers[base][0]) < n:
        _powers[base] = tuple(np.cumprod(np.full(n, x, np.uint64)) for x in (base, pow(base, -1, 1 << 64)))
    up, down = _powers[base]
    return up[:n], down[:n]


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(codes: np.ndarray, q: int, base: int = BASES[0]) -> np.ndarray:
    """Hash of the q characters from each place, by differences of one polynomial's prefix sums."""
    n = len(codes)
    if n < q:
        return np.empty(0, np.uint64)
    up, down = powers(n, base)
    x = (codes.astype(np.uint64) + np.uint64(0x1B873593)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(x * up, out=sums[1:])
    return spread((sums[q:] - sums[: n - q + 1]) * down[: n - q + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def text_codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pieces(texts: list[str | None], length: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """(row of each piece, its offset, its text), in lists of about CHUNK characters; every span lies in one piece.

    Pieces of a long text overlap by ``length - 1`` characters: each start of a span belongs to one piece.
    """
    rows, offsets, out, size = [], [], [], 0
    for row, text in enumerate(texts):
        if text is None or len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, CHUNK):
            piece = text[at : at + CHUNK + length - 1]
            if size + len(piece) > 2 * CHUNK and out:
                yield rows, offsets, out
                rows, offsets, out, size = [], [], [], 0
            rows.append(row)
            offsets.append(at)
            out.append(piece)
            size += len(piece)
    if out:
        yield rows, offsets, out


def compact_windows(texts: list[str], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(signature, piece, first start, number of starts, distance of the token from the first start) of all windows."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    h = gram_hashes(text_codes("".join(texts)), gram)
    low = np.uint64((1 << POSITION_BITS) - 1)
    packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    m = sliding_min(packed, length - gram + 1)
    edge = np.zeros(len(m) + 1, np.int8)
    edge[starts] += 1
    np.add.at(edge, ends - length + 1, -1)
    inside = np.flatnonzero(np.cumsum(edge[:-1]))
    m = m[inside]
    first = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
    count = np.diff(np.r_[first, len(m)])
    token = (m[first] & low).astype(np.int64)
    begin = inside[first]
    piece = np.searchsorted(ends, begin, side="right")
    return h[token].view(np.int64), piece, begin - starts[piece], count, token - begin


WINDOW = ["sig", "off", "n_starts", "region"]
WINDOWS = "sig bigint, off int, n_starts int, region binary, at bigint, text string, hot boolean"


def signatures(df: DataFrame, length: int, gram: int, layout: Layout) -> DataFrame:
    """PARTS of the signatures of ``df`` (id, text)."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Seen(layout)
        for batch in batches:
            for _, _, texts in pieces(batch.column(1).to_pylist(), length):
                sig, piece, *_ = compact_windows(texts, length, gram)
                order = np.lexsort((sig, piece))
                sig, piece = sig[order], piece[order]
                yield from own.add(sig, np.r_[True, (sig[1:] != sig[:-1]) | (piece[1:] != piece[:-1])] if len(sig) else None)
        yield from own.rest()

    return df.mapInArrow(fill, PARTS)


class Recurring:
    """The signatures of one range that stand in two texts or more: a file of the number of hot ones, these in order, and a
    Bloom filter of all."""

    def __init__(self, max_group: int):
        self.max_group, self.held = max_group, []

    def add(self, hashes: pa.Array, counts: pa.Array) -> None:
        self.held += [unpacked(*parts) for parts in zip(hashes, counts)]

    def done(self) -> bytes | None:
        h, at = np.unique(np.concatenate([h for h, _, _ in self.held]), return_inverse=True)
        n, texts = (np.bincount(at, weights=np.concatenate([x[i] for x in self.held]), minlength=len(h)) for i in (1, 2))
        if not (recurs := texts > 1).any():
            return None
        bits = max(64, -(-BITS_PER_HASH * int(recurs.sum()) // 64) * 64)
        bitmap = np.zeros(bits // 8, np.uint8)
        put(bitmap, positions(h[recurs], bits))
        hot = h[recurs & (n > self.max_group)]
        return np.array([len(hot)], np.int64).tobytes() + hot.tobytes() + bitmap.tobytes()


def recurring(folder: str, layout: Layout, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each signature may stand in two texts, whether it is hot); the first is never false for one that does."""
    found, hot = np.zeros(len(sig), bool), np.zeros(len(sig), bool)
    for own, data in opened(folder).split(sig, layout):
        n = int(data[:8].view(np.int64)[0])
        listed, bitmap = data[8 : 8 + 8 * n].view(np.int64), data[8 + 8 * n :]
        found[own] = has(bitmap, positions(sig[own], len(bitmap) * 8))
        if n:
            hot[own] = listed[np.minimum(np.searchsorted(listed, sig[own]), n - 1)] == sig[own]
    return found, hot


def repeated_windows(df: DataFrame, length: int, gram: int, layout: Layout, folder: str) -> DataFrame:
    """(id, WINDOWS) whose signature recurs; only hot ones have a digest of their text (region)."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, offsets, texts in pieces(batch.column(1).to_pylist(), length):
                sig, piece, begin, count, off = compact_windows(texts, length, gram)
                found, hot = recurring(folder, layout, sig)
                all_kept = np.flatnonzero(found)
                for cut in range(0, len(all_kept), MOST_WINDOWS):
                    kept = all_kept[cut : cut + MOST_WINDOWS]
                    s, p, b, n, o, hots = (x[kept] for x in (sig, piece, begin, count, off, hot))
                    own = [texts[i][j : j + k + length - 1] for i, j, k in zip(p.tolist(), b.tolist(), n.tolist())]
                    region = [digest(t) if x else None for t, x in zip(own, hots.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(np.array(rows)[p])), pa.array(s), pa.array(o.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(region, pa.binary()), pa.array(b + np.array(offsets)[p]), pa.array(own, pa.string()), pa.array(hots)],
                        names=["id", *WINDOW, "at", "text", "hot"],
                    )

    return df.mapInArrow(keep, f"id {df.schema['id'].dataType.simpleString()}, {WINDOWS}")


def digest(text: str) -> bytes:
    """128 bits that stand for a text."""
    import xxhash

    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


class Starts:
    """Every span start in windows: its row, its place in the row's window, and a 128-bit key of two words.

    The key covers signature, place against the common token, and span."""

    def __init__(self, rows: dict[str, list], length: int):
        texts, n = rows["text"], np.array(rows["n_starts"], np.int64)
        self.length, self.codes = length, text_codes("".join(texts))
        sizes = n + length - 1
        self.row = np.repeat(np.arange(len(texts)), n)
        self.start = np.arange(len(self.row)) - np.repeat(np.cumsum(n) - n, n)
        self.at = (np.cumsum(sizes) - sizes)[self.row] + self.start
        place = (np.array(rows["off"], np.int64)[self.row] - self.start).astype(np.uint64)
        sig = np.array(rows["sig"], np.int64).view(np.uint64)[self.row]
        self.keys = [spread(spread(gram_hashes(self.codes, length, base)[self.at] + sig * np.uint64(2 * i + 1)) + place * np.uint64(2 * i + 3)) for i, base in enumerate(BASES)]

    def same_text(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the spans at ``a`` and at ``b`` (numbers of starts, in order) have the same text, pair by pair.

        Behind a pair whose both sides follow the one before by one character, only the last character is new."""
        x, y = self.at[a], self.at[b]
        on = np.zeros(len(x), bool)
        on[1:] = (x[1:] == x[:-1] + 1) & (y[1:] == y[:-1] + 1)
        last = self.length - 1
        if (self.codes[x[on] + last] != self.codes[y[on] + last]).any():
            return False
        x, y, span = x[~on], y[~on], np.arange(self.length)
        return all((self.codes[x[i : i + 4096, None] + span] == self.codes[y[i : i + 4096, None] + span]).all() for i in range(0, len(x), 4096))

    def groups(self) -> np.ndarray:
        """For each start the number of the first one (in order of key) with the same signature, place and text."""
        order = np.lexsort(self.keys)
        a, b = (k[order] for k in self.keys)
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(order) else order
        leader = np.empty(len(order), np.int64)
        leader[order] = np.repeat(order[first], np.diff(np.r_[first, len(order)]))
        many = np.flatnonzero(leader != np.arange(len(leader)))
        if not self.same_text(many, leader[many]):  # two texts with one 128-bit key: compare the texts themselves
            seen: dict = {}
            leader = np.array([seen.setdefault((int(k), int(m), self.codes[i : i + self.length].tobytes()), j) for j, (k, m, i) in enumerate(zip(*self.keys, self.at))], np.int64)
        return leader


def stretches_of(rows: dict[str, list], length: int, kind: pa.DataType) -> pa.RecordBatch:
    """(id, start_at, end_at) of the shared stretches of whole groups of windows with one signature."""
    # Equal windows are one. Ids are compared only for equality and order, so any orderable type becomes its rank.
    seen: dict = {}
    one = np.array([seen.setdefault(x, len(seen)) for x in zip(rows["sig"], rows["off"], rows["text"])], np.int64)
    sigs, offs, texts = zip(*seen)
    ids = {x: i for i, x in enumerate(sorted(set(rows["id"])))}
    rank = np.array([ids[x] for x in rows["id"]], np.int64)
    lo, hi = np.full(len(seen), len(ids)), np.full(len(seen), -1)
    np.minimum.at(lo, one, rank)
    np.maximum.at(hi, one, rank)
    n = np.array([len(t) - length + 1 for t in texts], np.int64)
    group = np.unique(np.array(sigs, np.int64), return_inverse=True)[1]
    n_windows, n_open = np.bincount(group), np.bincount(group, weights=lo == hi)
    use = np.flatnonzero(((n_windows > 1) & (n_open > 0))[group])
    shared, begin, end = [np.flatnonzero(lo < hi)], [np.zeros(int((lo < hi).sum()), np.int64)], [n[lo < hi] + length - 1]
    if len(use):
        starts = Starts({"text": [texts[i] for i in use], "off": [offs[i] for i in use], "sig": [sigs[i] for i in use], "n_starts": n[use]}, length)
        leader, window, start = starts.groups(), use[starts.row], starts.start
        least, most = np.full(len(window), len(ids)), np.full(len(window), -1)
        np.minimum.at(least, leader, lo[window])
        np.maximum.at(most, leader, hi[window])
        mask = (least < most)[leader] & (lo == hi)[window]
        window, start = window[mask], start[mask]
        # Hits of one window closer than a span make one stretch.
        new = np.flatnonzero(np.r_[True, (window[1:] != window[:-1]) | (start[1:] - start[:-1] > length)]) if len(window) else np.empty(0, np.int64)
        last = np.r_[new[1:], len(window)] - 1 if len(new) else new
        shared.append(window[new])
        begin.append(start[new])
        end.append(start[last] + length)
    shared, begin, end = map(np.concatenate, (shared, begin, end))
    # From the distinct windows back to all rows.
    order = np.argsort(one, kind="stable")
    first, many = np.searchsorted(one[order], shared), np.bincount(one, minlength=len(seen))[shared]
    which = np.repeat(np.arange(len(shared)), many)
    row = order[first[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)]
    at = np.array(rows["at"], np.int64)[row]
    return pa.RecordBatch.from_arrays([pa.array([rows["id"][i] for i in row.tolist()], kind), pa.array(at + begin[which]), pa.array(at + end[which])], names=["id", "start_at", "end_at"])


def joined_groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """``stretches_of`` windows that come sorted by signature, in lots of whole groups."""
    names = ["id", "sig", "off", "at", "text"]
    held: dict[str, list] = {c: [] for c in names}
    kind = None
    for batch in batches:
        kind = batch.schema.field("id").type
        for c in names:
            held[c] += batch.column(c).to_pylist()
        if len(held["sig"]) > 4 * MAX_GROUP:  # all groups but the last are whole
            cut = len(held["sig"])
            while cut and held["sig"][cut - 1] == held["sig"][-1]:
                cut -= 1
            if cut:
                yield stretches_of({c: held[c][:cut] for c in names}, length, kind)
                held = {c: held[c][cut:] for c in names}
    if held["sig"]:
        yield stretches_of(held, length, kind)


def grams_as_rows(windows: DataFrame, length: int) -> DataFrame:
    """(WINDOW, from, upto) of stretches that distinct windows (WINDOW, lo, hi, text) share with another document of their
    signature: one row a start, combined before the shuffle, so a signature may have any number of windows."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                starts = Starts(part.select(["sig", "off", "n_starts", "text"]).to_pydict(), length)
                own = part.take(pa.array(starts.row))
                place = own.column("off").to_numpy() - starts.start
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(c) for c in (*WINDOW, "lo", "hi")), pa.array(starts.start.astype(np.int32)), pa.array(place.astype(np.int32)), *(pa.array(k.view(np.int64)) for k in starts.keys)],
                    names=[*WINDOW, "lo", "hi", "from", "place", "k0", "k1"],
                )

    kind = windows.schema["lo"].dataType.simpleString()
    rows = windows.mapInArrow(explode, f"sig bigint, off int, n_starts int, region binary, lo {kind}, hi {kind}, from int, place int, k0 bigint, k1 bigint")
    key = ["sig", "place", "k0", "k1"]
    two = rows.groupBy(*key).agg(F.min("lo").alias("a"), F.max("hi").alias("b")).filter("a < b").select(*key)
    hits = rows.filter("lo = hi").join(two, key)
    return hits.select(*WINDOW, "from", (F.col("from") + length).alias("upto"))


def hot_stretches(windows: DataFrame, length: int) -> DataFrame:
    """(id, start_at, end_at) of shared stretches of windows whose signatures have any number of them."""
    # Equal windows of a task become one before anything is shuffled, text and all.
    distinct = written(windows.groupBy(*WINDOW).agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.first("text").alias("text")), "distinct")
    hits = grams_as_rows(distinct, length)
    whole = distinct.filter("lo < hi").select(*WINDOW, F.lit(0).alias("from"), (F.col("n_starts") + (length - 1)).alias("upto"))
    return windows.select("id", "at", *WINDOW).join(whole.unionByName(hits), WINDOW).select("id", (F.col("at") + F.col("from")).alias("start_at"), (F.col("at") + F.col("upto")).alias("end_at"))


def shared_spans(docs: DataFrame, id_col: str, text_col: str, length: int = 160, gram: int | None = None, max_group: int = MAX_GROUP, range_bits: int = RANGE_BITS) -> DataFrame:
    """(id, start_at, end_at) of each longest unbroken run of shared characters of every document.

    A character is shared when it lies in ``length`` consecutive characters (code points, compared exactly) that also
    stand in a row with another id. Rows with a null id or text and texts shorter than ``length`` share nothing; an id
    names one text, and repeated rows of it do not share with each other. Extra columns are ignored, whatever their names. An empty table gives an
    empty frame.
    """
    gram = gram or max(1, length * 2 // 5)
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL").filter(F.length("text") >= length)
    n_chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    layout = Layout.of(2 * n_chars // (length - gram + 2), range_bits)
    folder = range_files(signatures(own, length, gram, layout), "recurring", lambda: Recurring(max_group), 3)
    windows = written(repeated_windows(own, length, gram, layout, folder), "windows")
    cold = windows.filter("NOT hot").select("id", "sig", "off", "at", "text").repartition("sig").sortWithinPartitions("sig")
    found = cold.mapInArrow(lambda batches: joined_groups(batches, length), f"id {own.schema['id'].dataType.simpleString()}, start_at bigint, end_at bigint")
    hot = windows.filter("hot")
    if hot.head(1):
        found = found.unionByName(hot_stretches(hot, length))
    return merged_runs(found).withColumnRenamed("id", id_col)


def merged_runs(stretches: DataFrame) -> DataFrame:
    """Longest unbroken runs of (id, start_at, end_at) stretches that touch or overlap."""
    before = Window.partitionBy("id").orderBy("start_at", "end_at").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("id").orderBy("start_at", "end_at").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.when(F.col("start_at") <= F.max("end_at").over(before), 0).otherwise(1)
    runs = stretches.withColumn("opens", opens).withColumn("run", F.sum("opens").over(upto))
    return runs.groupBy("id", "run").agg(F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at")).drop("run")


def shared_shares(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_chars, n_shared, n_spans, share) of every id: how much of its longest row stands elsewhere (0 without text)."""
    sizes = docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.coalesce(F.length(text_col), F.lit(0))).cast("bigint").alias("n_chars"))
    found = spans.groupBy(id_col).agg(F.sum(F.col("end_at") - F.col("start_at")).alias("n_shared"), F.count("*").alias("n_spans"))
    return sizes.join(found, id_col, "left").fillna(0, ["n_shared", "n_spans"]).withColumn("share", F.coalesce(F.try_divide("n_shared", "n_chars"), F.lit(0.0)))
