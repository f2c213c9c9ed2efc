"""Texts to vectors through a model that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that go to the model at a time, and after it has run out of memory.
BATCH, SMALL_BATCH = 8, 4


def embedded(text: Column, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = BATCH, small: int = SMALL_BATCH, retries: int = 1) -> Column:
    """The vector of each text, of unit length; null of a null or empty text and of one the model gives zeros or nothing finite for.

    ``load`` runs once a worker and returns the model, which takes a list of texts.
    A batch that fails is tried again; one that runs out of memory goes in parts.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()

        def vectors(texts: list[str], most: int, left: int) -> np.ndarray:
            try:
                return np.concatenate([np.asarray(model(texts[i : i + most]), float) for i in range(0, len(texts), most)])
            except MemoryError:
                if len(texts) == 1 and most == 1:
                    raise
                return np.concatenate([vectors(texts[i : i + small], max(1, min(small, most // 2)), left) for i in range(0, len(texts), small)])
            except Exception:
                if not left:
                    raise
                return vectors(texts, most, left - 1)

        for texts in batches:
            out = pd.Series([None] * len(texts), dtype=object)
            there = np.flatnonzero([isinstance(t, str) and len(t) > 0 for t in texts])
            for i in range(0, len(there), batch):
                at = there[i : i + batch]
                got = vectors([texts.iloc[k] for k in at], batch, retries)
                size = np.sqrt((got * got).sum(1))
                for k, v, n in zip(at, got, size):
                    if n > 0 and np.isfinite(n):
                        out.iloc[k] = (v / n).astype(np.float32).tolist()
            yield out

    return run(text)
