"""Embeddings of texts by a pluggable function over batches, through a cache keyed by content."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorestone.operators.incremental import cache_lookup, cache_put, cache_touch, upsert
from lorestone.sources.scratch import written

Embedder = Callable[[Sequence[str]], np.ndarray]


def hashed_words(dimensions: int = 768) -> Embedder:
    """A model for tests and offline use: words hashed to signed places, scaled to length 1."""

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for i, text in enumerate(texts):
            for word in text.split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[i, h % dimensions] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return embed


def embed(texts: DataFrame, embedder: Embedder) -> DataFrame:
    """``texts(content_hash, text)`` with ``vector``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(vector=list(embedder(batch["text"].fillna("").tolist())))

    return texts.select("content_hash", "text").mapInPandas(run, "content_hash string, text string, vector array<float>")


def looked_up(texts: DataFrame, cache: DataFrame, model: str, dimensions: int, embedder: Embedder, now: Column) -> tuple[DataFrame, DataFrame]:
    """``texts(key, text)`` with vectors, and the rows of the cache that change: those that were used, and new ones. Each
    missing text is embedded once; what was embedded is written first."""
    looked = cache_lookup(texts, cache, model, dimensions)
    missing = looked.filter("not hit").select("content_hash", "text").dropDuplicates(["content_hash"])
    fresh = written(embed(missing, embedder).select("content_hash", F.lit(model).alias("model"), F.lit(dimensions).alias("dimensions"), "vector"))
    new = fresh.select("content_hash", F.col("vector").alias("new_vector"))
    done = looked.join(new, "content_hash", "left").withColumn("vector", F.coalesce("vector", "new_vector")).drop("new_vector")
    used = cache.join(looked.filter("hit").select("content_hash").distinct(), "content_hash", "left_semi")
    return done, cache_put(cache_touch(used, looked, now), fresh, now)


def through_cache(texts: DataFrame, cache: DataFrame, model: str, dimensions: int, embedder: Embedder, now: Column) -> tuple[DataFrame, DataFrame]:
    """``texts(key, text)`` with vectors, and the cache as it is then."""
    done, changes = looked_up(texts, cache, model, dimensions, embedder, now)
    return done, upsert(cache, changes, ["content_hash", "model"])
