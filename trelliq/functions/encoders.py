"""Encoders of texts to vectors of length one: a hook for a model, and a deterministic stand-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from trelliq.session import ship


def hashed_vectors(texts: list[str], width: int) -> np.ndarray:
    """Signed word hashes of each text, scaled to length one; a text without words is all zeros."""
    out = np.zeros((len(texts), width), np.float32)
    for row, text in enumerate(texts):
        for word in text.lower().split():
            h = xxhash.xxh3_64_intdigest(word)
            out[row, h % width] += 1.0 if h >> 63 else -1.0
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1, norms)


def encoded(rows: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 512) -> DataFrame:
    """(key, embedding) of (key, text). ``load`` runs once a task and returns the function that encodes a batch."""

    ship(rows.sparkSession)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                model = model or load()
                yield pd.DataFrame({"key": part["key"], "embedding": list(model(part["text"].tolist()))})

    return rows.select("key", "text").mapInPandas(encode, "key string, embedding array<float>")


def hashed(rows: DataFrame, width: int = 64) -> DataFrame:
    return encoded(rows, lambda: lambda texts: hashed_vectors(texts, width))
