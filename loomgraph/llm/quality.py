"""Quality classifier: nearest neighbours vote in a latent-semantic space.

A text becomes counts of hashed words, of pairs of byte classes and of bins of its form (repetition, word length, capitals).
Damped, weighted by inverse document frequency and scaled group by group, they are projected on the leading singular
directions of a labelled sample. The labelled vectors, at most SAMPLE, go to all tasks; each document takes the K nearest
by exact cosine, computed in blocks, and their labels vote by a power of their similarity. Neighbours identical to the
document are left out, so that a labelled document never votes for itself.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, text_of

#: Labelled documents that are looked at, chosen by a hash of their id: the bound of what is gathered and broadcast.
SAMPLE = 4000
DIMENSIONS = 48
NEIGHBOURS = 15
POWER = 4
THRESHOLD = 0.3
HASHED = 512
CLASSES = 16
SAME = 1 - 1e-6
BLOCK = 512

CLASS_OF = np.full(256, 15, np.uint8)
for _k, _chars in enumerate((b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"|", b"#*$%&", b"!?", b"'\"()-", b"<>=/{}[]\\", b"@:;_")):
    CLASS_OF[list(_chars)] = _k
CLASS_OF[128:] = 14
BINS = {"distinct": np.array([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6]), "lines": np.array([0.1, 0.3, 0.5, 0.7]), "length": np.array([4, 5, 5.5, 6.5, 7.5, 9]), "capitals": np.array([0.05, 0.15, 0.3]), "echoes": np.array([0.02, 0.1, 0.3])}
GROUPS = [(0, HASHED, 0.5), (HASHED, HASHED + CLASSES**2, 1.0), (HASHED + CLASSES**2, HASHED + CLASSES**2 + sum(len(e) + 1 for e in BINS.values()), 1.0)]
WIDTH = GROUPS[-1][1]


def counts(text: str) -> np.ndarray:
    """The term counts of the whole text."""
    raw = text.encode()
    out = np.zeros(WIDTH, np.float32)
    if not raw:
        return out
    row = raw.lower().split()
    words, total = Counter(row), len(row)
    if total:
        at = np.fromiter((zlib.crc32(w) % HASHED for w in words), np.int64, len(words))
        out[:HASHED] = np.bincount(at, np.fromiter(words.values(), np.float64, len(words)), HASHED)
    c = CLASS_OF[np.frombuffer(raw, np.uint8)]
    pair = c[:-1] * np.uint8(CLASSES) + c[1:]
    out[HASHED : HASHED + CLASSES**2] = np.bincount(pair, minlength=CLASSES**2)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    if total:
        letters = np.bincount(c, minlength=CLASSES)
        form = {
            # a long text repeats more words than a short one: distinct words are held against the root of all beyond 400
            "distinct": len(words) / total * max(1.0, (total / 400) ** 0.5),
            "lines": 1 - len(set(lines)) / max(1, len(lines)),
            "length": len(text) / total,
            "capitals": letters[2] / max(1, letters[:3].sum()),
            "echoes": sum(map(eq, row, row[1:])) / total,
        }
        k = HASHED + CLASSES**2
        for name, edges in BINS.items():
            out[k + int(np.searchsorted(edges, form[name], "right"))] = 1
            k += len(edges) + 1
    return out


def damp(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Group by group: log counts, weighted and of length 1."""
    y = np.log1p(x) * idf
    for a, b, w in GROUPS:
        norm = np.linalg.norm(y[:, a:b], axis=1, keepdims=True)
        y[:, a:b] *= w / np.maximum(norm, 1e-9)
    return y


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Voters:
    """The fitted space and the labelled vectors in it."""

    def __init__(self, x: np.ndarray, label: np.ndarray, dimensions: int = DIMENSIONS):
        self.prior = float(label.mean()) if len(label) else 0.5
        self.label = label.astype(np.float32)
        if len(x):
            self.idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.2).astype(np.float32)
            y = damp(x, self.idf)
            values, vectors = np.linalg.eigh(y.T @ y)
            self.basis = np.ascontiguousarray(vectors[:, ::-1][:, :dimensions].astype(np.float32))
            self.vectors = unit(y @ self.basis)

    def scores(self, texts: list[str], k: int = NEIGHBOURS) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.label):
            return out
        for a in range(0, len(texts), BLOCK):
            x = np.stack([counts(t or "") for t in texts[a : a + BLOCK]])
            v = unit(damp(x, self.idf) @ self.basis)
            sim = v @ self.vectors.T
            sim[sim > SAME] = -1
            n = min(k, sim.shape[1])
            near = np.argpartition(-sim, n - 1, axis=1)[:, :n]
            w = np.maximum(np.take_along_axis(sim, near, axis=1), 0).astype(np.float64) ** POWER
            total = w.sum(axis=1)
            vote = (w * self.label[near]).sum(axis=1) / np.maximum(total, 1e-12)
            out[a : a + BLOCK] = np.where((total > 1e-9) & (x.sum(axis=1) > 0), vote, self.prior)
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Voters:
    """Learn from at most `sample` labelled documents that aren't held out. Rows without a label or id are passed over; of
    several labels of one document the least counts, of several texts of one id that of the least MD5. Without labels all
    scores are 0.5."""
    chosen = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).limit(sample)
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<float>")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series([counts(t) for t in texts])

    texts = text_of(docs, "doc_id").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text"))
    rows = texts.select("doc_id", "quality", vector("text").alias("x")).collect()  # at most `sample`
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows], np.float32).reshape(len(rows), WIDTH)
    return Voters(x, np.array([r["quality"] for r in rows], np.float32))


def score_column(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """A function text column -> score column, fitted on the labels."""
    spark = docs.sparkSession
    small_batches(spark)
    voters = spark.sparkContext.broadcast(fit(docs, labels, sample))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return lean(lambda each: (pd.Series(voters.value.scores(texts.tolist())) for texts in each))(batches)

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text).

    Null and empty texts get the share of label 1. Null ids aren't held out; repeated ids and rows are each scored, by their
    own texts. Long texts count whole, neighbours at a tie in either order, other columns not at all. An empty table gives an
    empty result."""
    score = score_column(docs, labels, sample)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier doesn't reject; odd rows are scored as in `classify`."""
    return docs.filter(score_column(docs, labels, sample)("text") >= threshold)
