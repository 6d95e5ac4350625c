"""Problem 6: token ids of whole texts by a public byte-level BPE vocabulary.

Method: the distinct words that a worker has not met yet are put in order of their bytes, which is a depth-first walk of
their trie. Each trie node keeps one value, the last token of the encoding of its prefix; a child's value follows from
its ancestors' alone, so a prefix shared by many words is encoded once. The encoding of a word is read backwards along
its last tokens. No shuffle: one map over the documents, linear in the text.

A last token ``t`` of a prefix is the one vocabulary entry that ends the prefix and is stable behind the last token of
what stands before it. Two tokens are stable side by side when no merge across their border comes before the merges
that formed them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from trelliq.llm.batches import by_text
from trelliq.session import ship

TOKENIZERS = "/opt/tokenizers"

#: Fixed value: the public pattern that splits text before merging.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

#: A worker keeps the ids of the last so many words, and of those met again among as many before them; likewise the
#: stability of so many pairs of tokens.
MAX_WORDS = 100_000


class BytePairTrie:
    """Encoder of words by the ranks of a byte-level BPE vocabulary."""

    def __init__(self, ranks: dict[bytes, int], max_words: int = MAX_WORDS):
        self.ranks, self.max_words = ranks, max_words
        self.endings = {token[i:] for token in ranks for i in range(len(token))}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.stable_pairs: dict[tuple[bytes, bytes], bool] = {}
        self.spines: dict[bytes, tuple[list, list]] = {}

    def halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two tokens whose merge makes ``token``."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def spine(self, token: bytes) -> tuple[list, list]:
        """(pieces at the left edge, at the right edge) of ``token``, each with the rank of the merge that uses it up."""
        if token not in self.spines:
            if len(token) == 1:
                edges = [(token, 1 << 40)], [(token, 1 << 40)]
            else:
                a, b = self.halves(token)
                used = self.ranks[token]
                edges = tuple([(token, 1 << 40), *((t, min(r, used)) for t, r in self.spine(half)[side])] for side, half in enumerate((a, b)))
            self.spines[token] = edges
        return self.spines[token]

    def stable(self, a: bytes, b: bytes) -> bool:
        """Whether the tokens ``a`` and ``b`` side by side stay as they are."""
        key = (a, b)
        if (found := self.stable_pairs.get(key)) is None:
            found = True
            for x, x_used in self.spine(a)[1]:
                for y, y_used in self.spine(b)[0]:
                    merged = self.ranks.get(x + y)
                    # The merge further left goes first when both have the same rank.
                    if merged is not None and merged < x_used and merged <= y_used:
                        found = False
            if len(self.stable_pairs) > self.max_words:
                self.stable_pairs.clear()
            self.stable_pairs[key] = found
        return found

    def learn(self, words: Iterable[str]) -> None:
        """Encode words and keep their ids."""
        ranks, stable, endings = self.ranks, self.stable, self.endings
        path, last = b"", []  # last[i]: the last token of path[: i + 1]
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared = 0
            for x, y in zip(raw, path):
                if x != y:
                    break
                shared += 1
            del last[shared:]
            for end in range(shared + 1, len(raw) + 1):
                start, token = end - 1, raw[end - 1 : end]
                while token not in ranks or (start and not stable(last[start - 1], token)):
                    start -= 1
                    token = raw[start:end]
                    if start < 0 or token not in endings:
                        raise ValueError("no encoding: the vocabulary lacks a byte")
                last.append(token)
            path, ids, end = raw, [], len(raw)
            while end:
                ids.append(ranks[last[end - 1]])
                end -= len(last[end - 1])
            self.known[word] = np.array(ids[::-1], np.int32).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as the bytes of 32-bit integers; empty for null and empty texts."""
        out = []
        for some in chunks(texts):
            split = [SPLIT.findall(t) if t else [] for t in some]
            new = {w for s in split for w in s} - self.known.keys()
            if len(self.known) + len(new) > self.max_words:
                self.before, self.known = self.known, {}
                new = {w for s in split for w in s}
            if self.before:
                again = new & self.before.keys()
                self.known.update((w, self.before[w]) for w in again)
                new -= again
            self.learn(new)
            out += [b"".join(map(self.known.__getitem__, s)) for s in split]
        return out


def chunks(texts: list[str | None], chars: int = 1 << 20) -> Iterator[list[str | None]]:
    """The texts in order, in lists of about so many characters."""
    now, size = [], 0
    for t in texts:
        now.append(t)
        size += len(t or "")
        if size >= chars:
            yield now
            now, size = [], 0
    if now:
        yield now


@cache
def encoder(path: str) -> BytePairTrie:
    """One encoder for each worker and vocabulary file; its words outlast a task."""
    with open(path, "rb") as f:
        return BytePairTrie({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def token_ids(df: DataFrame, id_col: str, text_col: str, tokenizers: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(``id_col``, ids array<int>) of every row: the ids of its whole text, without special tokens.

    A null or an empty text has an empty list; repeated rows are kept; text that looks like a special token is ordinary
    text. Other columns are ignored, whatever their names. An empty table gives an empty frame.
    """
    ship(df.sparkSession)
    path = f"{tokenizers}/{vocabulary}.tiktoken"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_text(whole, 1)):
            found = encoder(path).encode(batch.column(1).to_pylist())
            at = pa.array([0, *accumulate(len(x) // 4 for x in found)], pa.int32())
            flat = pa.array(np.frombuffer(b"".join(found), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, flat)], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(encode, f"`{id_col}` {kind}, ids array<int>")


def token_counts(df: DataFrame, text_col: str, keep: list[str], tokenizers: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """The columns ``keep`` of every row, and n_tokens, the number of tokens of its text (0 for null and empty)."""
    ship(df.sparkSession)
    path = f"{tokenizers}/{vocabulary}.tiktoken"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_text(whole, len(keep))):
            found = encoder(path).encode(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array([len(x) // 4 for x in found], pa.int64())], names=[*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text_col).mapInArrow(count, f"{kinds}, n_tokens bigint")
