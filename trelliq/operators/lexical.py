"""BM25 search: passages in lots with their postings in memory, queries block by block from the shared folder.

Of a passage only its length and the numbers of its asked words are kept, before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trelliq.functions.text import LETTER
from trelliq.session import ship, store, written

#: A lot of passages has about so many asked words, a block so many queries. Words in more than this part of a lot have a row of all its passages.
LOT_WORDS, BLOCK, WIDE = 4 << 20, 1024, 0.25
#: Scores are ranked by six digits, so one that is lower by this can still tie.
SLACK = 1e-6


#: Characters beyond ASCII that Arrow lowers and cuts as ``tokens`` does (tested one by one): up to Latin Extended-B without the dotted
#: capital I, and general punctuation. What depends on a context, a locale or the version of Unicode is not among them.
PLAIN = "".join(map(chr, (*range(0x80, 0x130), *range(0x131, 0x250), *range(0x2000, 0x2070))))


def tokens(text: str):
    return F.regexp_extract_all(F.lower(text), F.lit(f"{LETTER}+"), F.lit(0))


def plain(text: str):
    """Whether a text has just ASCII and characters of ``PLAIN``; a pattern of these takes as long as the words themselves."""
    other = F.translate(text, PLAIN, "")
    return (F.octet_length(text) == F.length(text)) | (F.octet_length(other) == F.length(other))


def numbered(batch: pa.RecordBatch, vocabulary: pa.Array) -> Iterator[pa.RecordBatch]:
    """(id, length, words): the number of words of each row of (id, plain, words) and the places of its asked words in the vocabulary.

    A text of plain characters (``plain``) is cut here, in much less time than by ``tokens``; others come as ``words``. Rows without words
    are left out.
    """
    ids, plain, cut = batch.columns
    texts = pc.replace_substring_regex(pc.utf8_lower(plain.drop_null()), rf"[^{LETTER[1:]}+", " ")
    texts = pc.ascii_trim(texts, " ")
    held = pc.not_equal(texts, "")
    for own, lists in ((ids.filter(plain.is_valid()).filter(held), pc.split_pattern(texts.filter(held), " ")), (ids.filter(cut.is_valid()), cut.drop_null())):
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        found = pc.index_in(lists.flatten(), value_set=vocabulary)
        ends = np.cumsum(found.is_valid().to_numpy(zero_copy_only=False))
        ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found.drop_null())
        out = pa.RecordBatch.from_arrays([own, pa.array(sizes, pa.int32()), words], ["id", "length", "words"])
        yield out.filter(pa.array(sizes > 0))


class Postings:
    """Postings of a lot by word, of one setting at a time. Passages are numbered in the order of their ids, so ties go by number."""

    def __init__(self, lot: pa.Table, vocabulary: pa.Array, wide: float = WIDE):
        ids, lengths, words = (lot.column(c).combine_chunks() for c in ("id", "lengths", "words"))
        order = pc.sort_indices(ids).to_numpy()
        self.n, self.ids, self.wide_from = len(ids), ids.take(pa.array(order)), wide * len(ids)
        place = np.empty(self.n, np.int64)
        place[order] = np.arange(self.n)
        # Words, or already their numbers in the vocabulary.
        found = words.flatten() if pa.types.is_integer(words.type.value_type) else pc.index_in(words.flatten(), value_set=vocabulary)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        doc, word = np.repeat(place, words.value_lengths().to_numpy())[known], found.drop_null().to_numpy().astype(np.int64)
        key, self.tf = np.unique(word * self.n + doc, return_counts=True)
        self.word, self.doc = np.divmod(key, max(1, self.n))
        self.start = np.searchsorted(key, np.arange(len(vocabulary) + 1) * self.n)
        # The lengths of an id's first rows, of its second ones, and so on: ids that stand in several rows score the sum.
        rows, flat = lengths.value_lengths().to_numpy(), lengths.flatten().to_numpy()
        first, self.lengths = np.cumsum(rows) - rows, []
        for j in range(rows.max(initial=0)):
            some = np.flatnonzero(rows > j)
            self.lengths.append(np.zeros(self.n))
            self.lengths[-1][place[some]] = flat[first[some] + j]

    def weigh(self, idf: np.ndarray, mean: float, k1: float, b: float) -> None:
        self.weight = np.zeros(len(self.doc))
        for lengths in self.lengths:
            dl = lengths[self.doc]
            self.weight += np.where(dl > 0, idf[self.word] * self.tf * (k1 + 1) / (self.tf + k1 * (1 - b + b * dl / mean)), 0)
        size = np.diff(self.start)
        self.most = np.zeros(len(size))
        if len(self.doc):
            self.most[size > 0] = np.maximum.reduceat(self.weight, self.start[:-1][size > 0])
        self.wide, self.total = {}, np.zeros(self.n)
        for w in np.flatnonzero(size > self.wide_from).tolist():
            self.wide[w] = np.zeros(self.n)
            self.wide[w][self.list(w)[0]] = self.list(w)[1]

    def list(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.start[w], self.start[w + 1]
        return self.doc[a:b], self.weight[a:b]

    def best(self, words: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, scores) of the ``k`` best passages for the words, those that cannot reach ``floor`` left out.

        Words come in the order of what they can add at most (MaxScore). Once the words left cannot lift a passage to the floor by
        themselves, only passages with an earlier word are looked up in their lists. Partial scores of k passages are a floor too.
        """
        words = words[self.most[words] > 0]
        words = words[np.argsort(-self.most[words], kind="stable")]
        left = [*np.cumsum(self.most[words][::-1])[::-1].tolist(), 0.0]
        words, total, seen, held, spread = words.tolist(), self.total, [], 0, False
        few, at = self.n // 16, len(words)
        for i, w in enumerate(words):
            docs, weights = self.list(w)
            if not spread and k <= held <= few < len(docs) and len(have := np.unique(np.concatenate(seen))) >= k:
                floor = max(floor, np.partition(total[have], -k)[-k])
            if left[i] < floor - SLACK:
                at = i
                break
            if w in self.wide:
                total += self.wide[w]
                spread = True
            else:
                total[docs] += weights
                seen.append(docs)
            held += len(docs)
        bound = max(floor - SLACK - left[at], np.finfo(float).tiny)
        if spread or held > few:
            docs = np.flatnonzero(total >= bound)
        else:
            docs = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
            docs = docs[total[docs] >= bound]
        scores = total[docs]
        if spread or held > few:
            total.fill(0)
        else:
            for x in seen:
                total[x] = 0
        for w in words[at:]:
            if w in self.wide:
                scores += self.wide[w][docs]
            else:
                own, weights = self.list(w)
                spot = np.minimum(np.searchsorted(own, docs), len(own) - 1)
                scores += np.where(own[spot] == docs, weights[spot], 0)
        scores = np.round(scores, 6)
        if len(docs) > k:
            keep = scores >= np.partition(scores, -k)[-k]
            docs, scores = docs[keep], scores[keep]
        order = np.argsort(-scores, kind="stable")[:k]
        return docs[order], scores[order]


def lots(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows in lots of about ``most`` words, whatever the number of rows that the session puts into a batch."""
    held, size = [], 0
    for batch in batches:
        ends, a = np.cumsum(batch.column("words").value_lengths().to_numpy().astype(np.int64)), 0
        while a < len(ends):
            before = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + most - size, "right")))
            held.append(batch.slice(a, b - a))
            size += ends[b - 1] - before
            a = b
            if a < len(ends) or size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def bm25_runs(queries: DataFrame, passages: DataFrame, k: int, settings: list[tuple[float, float]], lot: int = LOT_WORDS, block: int = BLOCK) -> DataFrame:
    """(setting, query_id, id, score, rank): the ``k`` best passages of each query by each of the settings (k1, b), a table.

    Query words count once. Passages are read once, for all settings, and shuffled as their ids, lengths and the numbers of their asked
    words, so that the rows of an id meet. They are cut into lots, and each query keeps ``k`` of a lot exactly (see ``Postings.best``);
    pairs of query and passage are never shuffled but for these.
    """
    spark = passages.sparkSession
    ship(spark)
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = queries.select("query_id", F.array_distinct(tokens("query")).alias("words")).filter("query_id IS NOT NULL AND size(words) > 0")
    asked = written(asked.groupBy("query_id").agg(F.flatten(F.collect_list("words")).alias("words")), "asked_words")
    known = written(asked.select(F.explode("words").alias("w")).distinct(), "asked_vocabulary")
    asked_in, known_in = asked._trelliq_table, known._trelliq_table

    def parts(folder: str, size: int) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, path = store(folder)
        for name in sorted(x.path for x in files.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet")):
            with files.open_input_file(name) as f:
                yield from pq.ParquetFile(f).iter_batches(size)

    def words_in() -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.string()), *(x.column("w") for x in parts(known_in, 1 << 16))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = words_in()
        for batch in batches:
            yield from numbered(batch, vocabulary)

    texts = passages.filter("text IS NOT NULL").withColumn("is_plain", plain("text"))
    texts = texts.select("id", F.when(F.col("is_plain"), F.col("text")).alias("plain"), F.when(~F.col("is_plain"), tokens(F.col("text"))).alias("words"))
    rows = texts.mapInArrow(count, "id string, length int, words array<int>").repartition(spark.sparkContext.defaultParallelism, "id")
    docs = written(rows.groupBy("id").agg(F.collect_list("length").alias("lengths"), F.flatten(F.collect_list("words")).alias("words")), "passage_words")
    df = written(docs.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("df")), "document_counts")
    n_docs, mean = docs.select(F.explode("lengths").alias("dl")).agg(F.count("*"), F.avg("dl")).first()
    df_in = df._trelliq_table

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = words_in()
        n = np.zeros(len(vocabulary))
        for some in parts(df_in, 1 << 16):
            n[some.column("w").to_numpy()] = some.column("df").to_numpy()
        idf = np.log(1 + (n_docs - n + 0.5) / (n + 0.5))
        floors = {}
        for some in lots(batches, lot):
            postings = Postings(some, vocabulary)
            for s, (k1, b) in enumerate(settings):
                postings.weigh(idf, mean, k1, b)
                for nth, part in enumerate(parts(asked_in, block)):
                    lists = part.column("words")
                    word = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy()
                    ends = np.cumsum(lists.value_lengths().to_numpy()).tolist()
                    floor, out = floors.setdefault((s, nth), np.full(len(ends), -np.inf)), []
                    for q, (a, z) in enumerate(zip([0, *ends], ends)):
                        own = word[a:z]
                        docs_of, scores = postings.best(own[own >= 0], floor[q], k)
                        if len(docs_of) == k:
                            floor[q] = max(floor[q], scores[-1])
                        if len(docs_of):
                            out.append((np.full(len(docs_of), q), docs_of, scores))
                    if out:
                        q, found, scores = map(np.concatenate, zip(*out))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), s, np.int32)), part.column("query_id").take(pa.array(q)), postings.ids.take(pa.array(found)), pa.array(scores)], ["setting", "query_id", "id", "score"])

    found = docs.filter("id IS NOT NULL AND size(words) > 0").mapInArrow(scan, f"setting int, query_id {kind}, id string, score double")
    rank = F.row_number().over(Window.partitionBy("setting", "query_id").orderBy(F.desc("score"), "id"))
    return written(found.withColumn("rank", rank).filter(F.col("rank") <= k), "run")
