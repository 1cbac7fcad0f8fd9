"""Language of a text: the nearest of several centroids per language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.llm.sampling import bounded_keys
from hearthline.session import materialize

NO_LETTERS = re.compile(r"[\W\d_]+")
BINS = 1 << 13
UNDETERMINED = "und"
GUESS = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Bins and counts of the hashed runs of one to three letters of a whole text.

    What is no letter counts as one space; None if there is no letter.
    """
    plain = NO_LETTERS.sub(" ", text.lower())
    if not plain.strip():
        return None
    codes = np.frombuffer(f" {plain.strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    hashed = [codes + np.uint64(1)]
    for _ in range(2):
        longer = hashed[-1]
        hashed.append(longer[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[-len(longer) + 1 :])
    mixed = np.concatenate(hashed) * np.uint64(0xD6E8FEB86659FD93)
    counts = np.bincount((mixed >> np.uint64(64 - 13)).astype(np.int64), minlength=BINS)
    bins = np.flatnonzero(counts)
    return bins, counts[bins]


def weighted(bins: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of length one."""
    weights = np.log1p(counts) * idf[bins]
    return weights / max(np.linalg.norm(weights), 1e-12)


@dataclass
class Centroids:
    """Centroids with their languages, and how far from one its own texts lie."""

    languages: list[str]
    idf: np.ndarray
    vectors: np.ndarray
    farthest: np.ndarray

    def nearest(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, and whether the text is too far from the centroid."""
        found = ngrams(text) if text and self.languages else None
        if found is None:
            return UNDETERMINED, 0.0, True
        cosines = self.vectors[:, found[0]] @ weighted(*found, self.idf)
        best = int(np.argmax(cosines))
        score = float(np.clip(cosines[best], 0.0, 1.0))
        return self.languages[best], score, bool(1 - score > self.farthest[best])


def clustered(vectors: np.ndarray, count: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids of length one and the cluster of each row.

    It begins with the row nearest to the mean, then takes the row farthest from all
    chosen ones, so equal input gives equal centroids.
    """
    first = int(np.argmax(vectors @ vectors.mean(axis=0)))
    chosen = [first]
    near = vectors @ vectors[first]
    while len(chosen) < min(count, len(vectors)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    centroids = vectors[chosen]
    for _ in range(rounds):
        cluster = np.argmax(vectors @ centroids.T, axis=1)
        member = (cluster[None, :] == np.arange(len(centroids))[:, None]).astype(vectors.dtype)
        sums = np.where(member.any(axis=1)[:, None], member @ vectors, centroids)
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids, np.argmax(vectors @ centroids.T, axis=1)


def fit_languages(docs: DataFrame, per_language: int = 1024, clusters: int = 4, quantile: float = 0.999) -> Centroids:
    """Centroids from at most ``per_language`` texts of each value of ``lang``.

    ``docs`` has ``doc_id``, ``text`` and ``lang``; rows where one is NULL, and texts
    without a letter, are left out. The sample is spread evenly and the same each time.
    Vectors stay in Spark; document frequencies (one number per bin) and centroids
    (``clusters`` per language) come to the driver. A centroid's ``farthest`` is the
    ``quantile`` of its own texts' distances.
    """
    picked = bounded_keys(docs.where(F.col("text").isNotNull()), "doc_id", "lang", per_language)
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"])

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256]
                found = [ngrams(t) or ([], []) for t in part["text"]]
                yield pd.DataFrame(
                    {"doc_id": part["doc_id"], "lang": part["lang"], "bins": [f[0] for f in found], "counts": [f[1] for f in found]}
                )

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "lang"))
    sample = texts.mapInPandas(grams, f"{kinds}, bins array<int>, counts array<int>").where(F.size("bins") > 0)
    sample = materialize(sample).dropDuplicates(["doc_id", "lang"])
    seen = sample.select(F.explode("bins").alias("bin")).groupBy("bin").count().toPandas()
    total = sample.count()
    frequency = np.zeros(BINS)
    frequency[seen["bin"].to_numpy(int)] = seen["count"]
    idf = np.log((1 + total) / (1 + frequency)) + 1

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        vectors = np.zeros((len(group), BINS), np.float32)
        for row, (bins, counts) in enumerate(zip(group["bins"], group["counts"], strict=True)):
            vectors[row, bins] = weighted(np.asarray(bins), np.asarray(counts), idf)
        lang = group["lang"].iloc[0]
        del group
        found, cluster = clustered(vectors, clusters)
        apart = 1 - np.einsum("ij,ij->i", vectors, found[cluster])
        far = [float(np.quantile(apart[cluster == c], quantile)) if (cluster == c).any() else 0.0 for c in range(len(found))]
        return pd.DataFrame({"lang": lang, "vector": list(found), "farthest": far})

    made = sample.groupBy("lang").applyInPandas(centroids, "lang string, vector array<float>, farthest double").toPandas()
    made = made.sort_values("lang", kind="stable")
    vectors = np.array(made["vector"].tolist(), np.float64).reshape(len(made), BINS)
    return Centroids(made["lang"].tolist(), idf, vectors, made["farthest"].to_numpy(float))


def identified(docs: DataFrame, model: Centroids, text: str = "text", into: str = "language") -> DataFrame:
    """Adds the struct ``into``: ``lang_pred``, ``score`` (cosine), ``rejected``.

    ``rejected`` marks texts farther from the nearest centroid than its own texts are;
    they keep the nearest language. NULL texts, texts without a letter, and all texts
    if nothing was learned have ``und``, score 0. Rows and repeated rows stay; a column
    that has the name ``into`` already is replaced. No rows are exchanged.
    """
    return docs.withColumn(into, _guess(F.col(text), model))


def _guess(text: Column, model: Centroids) -> Column:
    @F.pandas_udf(GUESS)
    def guess(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.nearest(t) for t in texts], columns=GUESS.names)

    return guess(text)
