"""Language identification: nearest of several centroids per language, by cosine over TF-IDF character n-grams.

Bigrams and trigrams of the whole text are hashed into a fixed number of dimensions. Documents of a bounded sample for each
language teach the inverse document frequencies and, by spherical k-means, a few centroids for each language. Every language
is learned, in a task of its own; the model takes 48 KB for each. A text farther from its nearest centroid than any document
that taught it (and SLACK more) is rejected: `rejected` says so, and with reject=True its language is `und`.

Nulls and edges: a null text, or one without a letter, is `und` with score 0, and rejected. A text whose n-grams were never
seen gets the most frequent language, and is rejected. Rows with a null lang or id teach nothing; an id with several languages
teaches the first by name, one with several texts that of the smallest hash. Without any teaching row all texts are `und`.
Ties go to the first language by name. Repeated rows are predicted each. Very long texts are counted whole, one at a time. An
empty table gives an empty result. Extra columns of the documents pass through; lang_pred, score and rejected are added or
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.common import HASH_SPAN, by_hash, checkpointed, fresh

DIMENSIONS = 4096
#: At most so many documents of each language, in hash order, are used to fit.
FIT_ROWS_PER_LANG = 400
CENTROIDS = 3
#: Cosine distance beyond the farthest teaching document of a centroid that is still accepted.
SLACK = 0.05
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """Hashed counts of character bigrams and trigrams around letters; anything else counts as a space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    letter = ((points >= 97) & (points <= 122)) | ((points >= 0xC0) & (points != 0xD7) & (points != 0xF7) & ((points < 0x2000) | (points > 0x206F)))
    points = np.where(letter, points, 32)
    points = np.concatenate([[np.uint64(32)], points, [np.uint64(32)]]).astype(np.uint64)
    a, b, c = points[:-2], points[1:-1], points[2:]
    two = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(52)
    three = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0x165667B19E3779F9) + c * np.uint64(0x27D4EB2F165667C5)) >> np.uint64(52)
    keep = b != 32
    return np.bincount(np.concatenate([two[keep], three[keep]]).astype(np.int64), minlength=DIMENSIONS)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(-1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


@dataclass
class Centroids:
    langs: list[str]
    lang_of: np.ndarray
    vectors: np.ndarray
    idf: np.ndarray
    usual: int
    farthest: np.ndarray
    reject: bool

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine to the nearest centroid, and whether the text is too far from it."""
        names, best, far = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if not self.langs:
            return names, best, far
        rows = [k for k, t in enumerate(texts) if t and has_letter(t)]
        for begin in range(0, len(rows), 256):
            part = rows[begin : begin + 256]
            x = np.stack([counts(texts[k]) for k in part]).astype(np.float32)
            close = _unit(np.log1p(x) * self.idf) @ self.vectors.T
            nearest = close.argmax(1)
            for k, row, c in zip(part, close, nearest.tolist(), strict=True):
                best[k] = min(1.0, max(0.0, float(row[c])))
                far[k] = best[k] <= 0 or 1 - best[k] > self.farthest[c] + SLACK
                if not (self.reject and far[k]):
                    names[k] = self.langs[self.lang_of[c] if best[k] > 0 else self.usual]
        return names, best, far


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from the rows farthest from those chosen so far."""
    chosen = [0]
    for _ in range(min(k, len(x)) - 1):
        chosen.append(int((x @ x[chosen].T).max(1).argmin()))
    centres = x[chosen]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        centres = np.stack([_unit(x[own == c].sum(0)) if (own == c).any() else centres[c] for c in range(len(centres))])
    return centres


def fit(docs: DataFrame, teaches: Column | None = None, rows: int = FIT_ROWS_PER_LANG, centroids: int = CENTROIDS, reject: bool = False) -> Centroids:
    """teaches: which documents may be learned from. reject: whether texts too far from every centroid are `und`."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    ids = ids.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    ids = ids.where(teaches) if teaches is not None else ids
    ids = ids.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    # a row for each language; of each about twice the rows pass to the ranking
    share = F.when(F.col("n") <= 2 * rows + 1000, HASH_SPAN).otherwise(F.lit(float(HASH_SPAN)) * (2 * rows + 1000) / F.col("n")).cast("long")
    many = checkpointed(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("below", share))
    order = by_hash(["doc_id"])
    ranked = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))
    first = ids.join(F.broadcast(many), "lang").where(order < F.col("below")).withColumn("rank", ranked).where(F.col("rank") <= rows)
    few = first.select("doc_id", F.col("lang").alias("taught"))
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")).where("text IS NOT NULL")

    def measure(batches):
        for batch in batches:
            out = []
            for t in batch["text"]:
                c = counts(t)
                at = np.flatnonzero(c)
                out.append((at.tolist(), c[at].tolist()))
            yield batch[["doc_id", "taught", "h"]].assign(at=[o[0] for o in out], n=[o[1] for o in out])

    found = texts.join(F.broadcast(few), "doc_id").mapInPandas(measure, "doc_id long, taught string, h long, at array<int>, n array<int>")
    found = found.groupBy("doc_id", "taught").agg(F.min(F.struct("h", "at", "n")).alias("m")).select("doc_id", "taught", "m.at", "m.n")
    found = checkpointed(found)
    total, held = found.count(), np.zeros(DIMENSIONS)
    for r in found.select(F.explode("at").alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect():  # one row for each dimension
        held[r["d"]] = r["n"]
    idf = (np.log((1 + total) / (1 + held)) + 1).astype(np.float32)

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        x = np.zeros((len(rows), DIMENSIONS), np.float32)
        for row, at, n in zip(x, rows["at"], rows["n"], strict=True):
            row[at] = n
        x = _unit(np.log1p(x) * idf)
        centres = _cluster(x, centroids)
        close = x @ centres.T
        own = close.argmax(1)
        far = [float(1 - close[own == c, c].min()) if (own == c).any() else 0.0 for c in range(len(centres))]
        return pd.DataFrame({"lang": rows["taught"].iloc[0], "k": range(len(centres)), "far": far, "v": [c.astype("<f4").tobytes() for c in centres]})

    made = found.groupBy("taught").applyInPandas(cluster, "lang string, k int, far double, v binary").collect()
    made.sort(key=lambda r: (r["lang"], r["k"]))
    langs = sorted({r["lang"] for r in made})
    usual = many.orderBy(F.desc("n"), F.desc("lang")).select("lang").collect() if langs else []
    usual = next((langs.index(r["lang"]) for r in usual if r["lang"] in set(langs)), 0)
    vectors = np.array([np.frombuffer(r["v"], "<f4") for r in made], np.float32).reshape(len(made), DIMENSIONS)
    return Centroids(langs, np.array([langs.index(r["lang"]) for r in made], int), vectors, idf, usual, np.array([r["far"] for r in made]), reject)


def predict(docs: DataFrame, model: Centroids) -> DataFrame:
    """The documents with lang_pred, score (the cosine to the nearest centroid) and rejected."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predicted(text: pd.Series) -> pd.DataFrame:
        names, best, far = model.predict(text.tolist())
        return pd.DataFrame({"lang_pred": names, "score": best, "rejected": far})

    own = fresh(docs, "predicted")
    done = docs.withColumn(own, predicted(F.col("text").cast("string")))
    return done.withColumns({c: F.col(f"{own}.{c}") for c in ("lang_pred", "score", "rejected")}).drop(own)
