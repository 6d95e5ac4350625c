"""Problem 1: records that differ only in white space, letter case, punctuation or the order of their fields.

Method: the canonical form of each record is hashed inside the JVM; partition-merged Bloom filters of hashes seen once
and again (bloom.py) tell the possible repeats, which alone are shuffled for exact grouping; all others are classes of
one record at once. One scan of the text, a table of its digests, 8 bytes a record to the merging of the filters, and a
shuffle of little more than the true copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trelliq.llm.bloom import RANGE_BITS, Layout, maybe_repeated, seen_twice
from trelliq.llm.words import bare
from trelliq.session import written

#: Where a text is cut into pieces.
CUTS = r"[,;|\r\n]"


def canonical(text: Column) -> Column:
    """Equal for two texts just when they are the same up to formatting; null for null texts and empty bare forms.

    A record of three or more ``label: value`` pieces is its sorted pairs, marked 'r'; any other text is its bare form,
    marked 't', so that the two kinds never meet.
    """
    pieces = F.filter(F.split(text, CUTS), lambda p: bare(p) != "")
    pairs = F.transform(pieces, lambda p: F.transform(F.split(p, ":"), bare))
    is_record = (F.size(pairs) >= 3) & F.forall(pairs, lambda p: (F.size(p) == 2) & (F.get(p, 0) != "") & (F.get(p, 1) != ""))
    record = F.array_join(F.array_sort(F.transform(pairs, lambda p: F.array_join(p, "\u0001"))), "\u0002")
    flat = bare(text)
    return F.when(F.contains(text, F.lit(":")) & is_record, F.concat(F.lit("r"), record)).when(flat != "", F.concat(F.lit("t"), flat))


def format_classes(df: DataFrame, id_col: str, text_col: str, by: str | None = None, range_bits: int = RANGE_BITS) -> tuple[DataFrame, DataFrame]:
    """(classes, copies) of the records of ``df``.

    classes(tab, keep_id, n_records): one row for each distinct record; copies(tab, keep_id, copy_id): one row for each
    id but the smallest of a class. ``by`` names a column within whose values records are compared ('' without one).
    A null or contentless text is a class of its own; an id with several texts stands in the class of each. Repeated rows
    of one id count once; a null id is left out. Other columns are ignored, whatever their names. An empty table gives two
    empty frames.
    """
    tab = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    rows = df.filter(F.col(id_col).isNotNull()).select(tab.alias("tab"), F.col(id_col).alias("id"), canonical(F.col(text_col)).alias("canon"))
    # The digest stands for the text from here on: 32 bytes, however long the text is.
    hashed = written(rows.select("tab", "id", F.xxhash64("tab", "canon").alias("x"), F.unhex(F.sha2("canon", 256)).alias("digest")), "digests")
    hashed = hashed.withColumn("h", F.when(F.col("digest").isNotNull(), F.col("x"))).drop("x")
    layout = Layout.of(hashed.count(), range_bits)
    folder = seen_twice(hashed, "h", layout)
    possible = written(hashed.withColumn("again", maybe_repeated(folder, layout, F.col("h"))).select("tab", "id", "again", F.when(F.col("again"), F.col("digest")).alias("digest"), F.col("h").isNull().alias("bare")), "format")
    # A hash that stands once has one row, so it needs no shuffle; only rows without content may repeat an id.
    single = possible.filter("NOT again AND NOT bare").select("tab", F.col("id").alias("keep_id"))
    contentless = possible.filter("bare").select("tab", F.col("id").alias("keep_id")).distinct()
    again = possible.filter("again").select("tab", "id", "digest")
    sizes = again.distinct().groupBy("tab", "digest").agg(F.min("id").alias("keep_id"), F.count("*").alias("n_records"))
    copies = again.join(sizes.filter("n_records > 1"), ["tab", "digest"]).filter("id <> keep_id").select("tab", "keep_id", F.col("id").alias("copy_id")).distinct()
    one = single.unionByName(contentless).select("tab", "keep_id", F.lit(1).cast("bigint").alias("n_records"))
    return one.unionByName(sizes.select("tab", "keep_id", "n_records")), copies
