"""Vectors: brute-force cosine search, chunk-to-document maxima, quantisation, and the default embedder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, FloatType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a norm is 0."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def search(chunks: DataFrame, query: Column, k: int = 10, offset: int = 0, where: Column | None = None) -> DataFrame:
    """(rank, chunk_id, doc_id, distance, score) of the nearest chunks. `chunks` has chunk_id, doc_id, vector; the query
    is a column expression without columns. One pass, and k rows of each task go on."""
    kept = chunks if where is None else chunks.filter(where)
    score = F.coalesce(cosine(F.col("vector"), query), F.lit(0.0))
    hits = kept.select("chunk_id", "doc_id", score.alias("score")).orderBy(F.desc("score"), "chunk_id").offset(offset).limit(k)
    rank = F.row_number().over(W.orderBy(F.desc("score"), "chunk_id")) + offset
    return hits.select(rank.alias("rank"), "chunk_id", "doc_id", (1 - F.col("score")).alias("distance"), "score")


def with_documents(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with their documents' columns; chunks without document stay."""
    return hits.join(docs, "doc_id", "left")


def best_chunks(hits: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, score): each document's best chunk; ties go to the smaller chunk_id."""
    best = F.min(F.struct((-F.col("score")).alias("cost"), F.col("chunk_id"), F.col("score")))
    return hits.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.chunk_id", "b.score")


def rollup(hits: DataFrame) -> DataFrame:
    return hits.groupBy("doc_id").agg(F.max("score").alias("score"))


def quantize_int8(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """Adds `q`: bytes on an affine scale over the whole table's range."""
    bounds = vectors.agg(F.min(F.array_min(column)).alias("lo"), F.max(F.array_max(column)).alias("hi"))
    scale = (F.col("hi").cast("double") - F.col("lo").cast("double")) / 255
    level = lambda x: (F.round((x.cast("double") - F.col("lo").cast("double")) / scale) - 128).cast("int")
    return vectors.crossJoin(F.broadcast(bounds)).withColumn("q", F.transform(column, level)).drop("lo", "hi")  # bounds is one row


def sign_bits(vector: Column) -> Column:
    """The signs as words of 32 bits, the first component lowest."""
    words = F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / 32).cast("int"))
    bit = lambda x, i: F.when(x >= 0, F.pow(F.lit(2.0), i.cast("double")).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.transform(words, lambda w: F.aggregate(F.transform(F.slice(vector, w * 32 + 1, F.lit(32)), bit), F.lit(0).cast("long"), lambda s, x: s + x))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def recall_at_k(truth: DataFrame, found: DataFrame, keys: Sequence[str] = ("query_id",), item: str = "chunk_id") -> DataFrame:
    """(keys, recall): the part of each query's true items that was found."""
    hit = truth.join(found.select(*keys, item, F.lit(1).alias("hit")), [*keys, item], "left")
    return hit.groupBy(*keys).agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


Embed = Callable[[list[str]], np.ndarray]


def hashing_embedder(dim: int = 384) -> Embed:
    """Signed feature hashing of words and letter trigrams, normalised: a deterministic stand-in for a model."""
    import xxhash

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for r, text in enumerate(texts):
            for w in text.lower().split():
                padded = f" {w} "
                for f in (w, *(padded[i : i + 3] for i in range(len(padded) - 2))):
                    h = xxhash.xxh64_intdigest(f)
                    out[r, h % dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embed_column(text: Column, embed: Embed | None = None, prefix: str = "passage: ", batch: int = 64) -> Column:
    """Vectors of texts by an embedder that is made once for each batch of rows; `prefix` tells passages from queries."""
    make = embed or hashing_embedder()

    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        out: list = []
        values = texts.fillna("").tolist()
        for i in range(0, len(values), batch):
            out.extend(make([prefix + t for t in values[i : i + batch]]).astype(np.float32))
        return pd.Series(out)

    return run(text)
