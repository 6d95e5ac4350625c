"""Column expressions on text shared by the operators here: bare forms, words, word shingles.

Letters and digits are the Unicode categories L and N; everything runs inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_BARE = r"[^\p{L}\p{N}]+"
WORD = r"[\p{L}\p{N}]+"


def bare(text: Column) -> Column:
    """Lower-cased letters and digits of ``text`` in order."""
    return F.regexp_replace(F.lower(text), NOT_BARE, "")


def words(text: Column) -> Column:
    """All words of ``text`` in order: longest runs of letters and digits, lower-cased; null stays null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def shingle_hashes(word_list: str, n: int) -> Column:
    """Sorted distinct 64-bit hashes of the runs of ``n`` words; empty for fewer words, null for null.

    ``word_list`` names a column: an expression would be evaluated again for each run.
    """
    at = F.sequence(F.lit(1), F.size(word_list) - F.lit(n - 1))
    runs = F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(word_list, i, n), " ")))
    return F.when(F.size(word_list) >= n, F.array_sort(F.array_distinct(runs))).when(
        F.col(word_list).isNotNull(), F.array().cast("array<bigint>")
    )


def shingles(word_list: str, n: int) -> Column:
    """Sorted distinct runs of ``n`` words, as strings; ``word_list`` names a column."""
    if n == 1:
        return F.array_sort(F.array_distinct(word_list))
    at = F.sequence(F.lit(1), F.size(word_list) - F.lit(n - 1))
    runs = F.transform(at, lambda i: F.array_join(F.slice(word_list, i, n), " "))
    return F.array_sort(F.array_distinct(F.when(F.size(word_list) >= n, runs).otherwise(F.array().cast("array<string>"))))
