"""Vector expressions on arrays, and the text embedder's interface."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

SCALE = 127
SEGMENT = 256
WEIGHTS = (8.0, 1.0, 4.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""

    def scaled(pair: Column) -> Column:
        return F.transform(pair["v"], lambda x: F.when(pair["n"] > 0, x.cast("double") / pair["n"]).otherwise(x.cast("double")))

    return bound(v, lambda x: bound(F.struct(x.alias("v"), norm(x).alias("n")), scaled))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)


def quantized(v: Column) -> Column:
    """int8 form: 127 times the value, rounded half to even, within -127 and 127."""
    return F.transform(v, lambda x: F.least(F.greatest(F.rint(x.cast("double") * SCALE), F.lit(-SCALE)), F.lit(SCALE)).cast("tinyint"))


def int_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda s, x: s + x)


def quantized_cosine(a: Column, b: Column) -> Column:
    lengths = int_dot(a, a).cast("double") * int_dot(b, b).cast("double")
    return F.when(lengths > 0, int_dot(a, b) / F.sqrt(lengths)).otherwise(0.0)


def identity_vector(v: Column, dims: int = SEGMENT) -> Column:
    """The first dimensions at unit length."""
    return normalized(F.slice(v, 1, dims))


def composite_vector(name: Column, role: Column, org: Column, dims: int = SEGMENT, weights: tuple[float, float, float] = WEIGHTS) -> Column:
    """Three segments, each the first dimensions of a vector at unit length times its weight, at unit length together; a missing part is zeros."""
    zeros = F.array_repeat(F.lit(0.0), dims)

    def part(v: Column, weight: float) -> Column:
        return F.coalesce(F.transform(identity_vector(v, dims), lambda x: x * weight), zeros)

    return normalized(F.concat(*[part(v, weight) for v, weight in zip((name, role, org), weights)]))


def org_popularity(canon_size: Column) -> Column:
    return F.least(F.ln(canon_size + 1.0) / F.ln(F.lit(20.0)), F.lit(1.0))


def person_popularity(canon_size: Column) -> Column:
    return F.least(F.log1p(canon_size.cast("double")) / F.log1p(F.lit(50.0)), F.lit(1.0))


def org_blend(similarity: Column, canon_name: Column, query: Column, canon_size: Column) -> Column:
    """0.7 similarity and 0.3 popularity; a near-identical name no longer than the query plus three says nothing."""
    itself = (similarity > 0.95) & (F.length(canon_name) <= F.length(query) + 3)
    return 0.7 * F.when(itself, 0.0).otherwise(similarity) + 0.3 * org_popularity(canon_size)


def person_blend(description: Column, name_similarity: Column, canon_size: Column) -> Column:
    return 0.40 * description + 0.45 * name_similarity + 0.15 * person_popularity(canon_size)


class Embedder(Protocol):
    """Texts to unit vectors.  A model is loaded once for each worker, on first use."""

    dims: int

    def embed_batch(self, texts: list[str]) -> np.ndarray: ...


class HashedEmbedder:
    """Deterministic stand-in for a model: hashed character trigrams and words with signs."""

    def __init__(self, dims: int = 768):
        self.dims = dims

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for row, text in zip(out, texts):
            padded = f"  {text.lower()} "
            for gram in [padded[i : i + 3] for i in range(len(padded) - 2)] + text.lower().split():
                code = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "big")
                row[code % self.dims] += 1.0 if code >> 63 else -1.0
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(lengths > 0, lengths, 1.0)


def embedded(df: DataFrame, text: str, out: str, embedder: Embedder) -> DataFrame:
    """``df`` with the embedding of ``text``, in Arrow batches; null gives a null vector."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            vectors = embedder.embed_batch(batch.fillna("").tolist())
            yield pd.Series([None if missing else list(v) for v, missing in zip(vectors, batch.isna())])

    return df.withColumn(out, embed(F.col(text)))


def embedded_distinct(df: DataFrame, texts: list[str], embedder: Embedder) -> DataFrame:
    """``df`` with ``<text>_vector`` for each column in ``texts``; every distinct text is embedded once."""
    all_texts = df.select(F.explode(F.array(*texts)).alias("__text")).where("__text IS NOT NULL").distinct()
    vectors = embedded(all_texts, "__text", "__vector", embedder)
    for column in texts:
        own = vectors.select(F.col("__text").alias(f"__{column}"), F.col("__vector").alias(f"{column}_vector"))
        df = df.join(own, F.col(column) == F.col(f"__{column}"), "left").drop(f"__{column}")
    return df
