"""Quality scores by nearest-neighbour voting in a latent semantic space.

Terms of a text are hashed byte trigrams and indicator terms of its shape (shares of capitals, digits, symbols, words
that repeat the word before, words seen earlier). A bounded sample of labelled texts gives their idf weights and, by
a truncated singular value decomposition, the latent space. The labelled vectors are broadcast; every text is compared
with all of them by exact cosine, block by block, and its nearest vote with their similarity as weight.
"""

from __future__ import annotations

import operator
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, texts_of

TRIGRAMS = 4096
LEVELS = np.array([0, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])
SHAPES = 5
#: Labelled rows that the space is fitted on and that vote: the bound of what is collected and broadcast.
SAMPLE = 4_000
DIMENSIONS, NEIGHBOURS, SHARPNESS = 64, 15, 8
THRESHOLD = 0.3
BLOCK_BYTES, BLOCK_TEXTS = 4_000_000, 512

_SPACE = np.isin(np.arange(256), [9, 10, 13, 32])
_UPPER, _DIGIT = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"))
_OTHER = ~(_UPPER | _DIGIT | _SPACE | np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)) | (np.arange(256) >= 128))
_CLASSES = np.stack([_UPPER, _DIGIT, _OTHER], axis=1).astype(np.float64)


def terms(text: bytes) -> np.ndarray:
    """Counts of hashed trigrams, then indicators of each shape's level; all 0 for an empty text."""
    out = np.zeros(TRIGRAMS + SHAPES * len(LEVELS), np.uint32)
    b = np.frombuffer(text, np.uint8)
    if len(b) >= 3:
        wide = b.astype(np.uint32)
        gram = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
        gram = (gram * np.uint32(2654435761)) >> np.uint32(20)
        out[:TRIGRAMS] = np.bincount(gram, minlength=TRIGRAMS)
    held = np.bincount(b, minlength=256)
    words = text.split()
    n = max(1, len(words))
    shares = [*((held @ _CLASSES) / max(1, len(b) - int(held[_SPACE].sum()))), sum(map(operator.eq, words, words[1:])) / n, (len(words) - len(set(words))) / n]
    for i, level in enumerate(np.searchsorted(LEVELS, shares)):
        at = TRIGRAMS + i * len(LEVELS)
        out[at : at + level] = 1
    return out

#: Rows of the table of counts that are weighed at once.
BLOCK_ROWS = 256


@dataclass
class Space:
    """Idf weights, the projection, the labelled vectors and their labels."""

    idf: np.ndarray
    projection: np.ndarray
    voters: np.ndarray
    labels: np.ndarray

    @staticmethod
    def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
        x = counts.astype(np.float32)
        np.log1p(x, out=x)
        x *= idf
        grams = x[:, :TRIGRAMS]
        grams /= np.linalg.norm(grams, axis=1, keepdims=True) + 1e-9
        x[:, TRIGRAMS:] /= 8  # a text has 80 shape terms at most, so that they don't outweigh its trigrams
        x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
        return x

    @staticmethod
    def fit(counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 0) -> Space:
        """The space of labelled texts; a float table of counts is overwritten."""
        n = len(counts)
        idf = (np.log((1 + n) / (1 + (counts > 0).sum(axis=0))) + 0.2).astype(np.float32)
        # weighed in place and by blocks: the driver holds one table of this size, and no copies of it
        a = counts.astype(np.float32, copy=False)
        for lo in range(0, n, BLOCK_ROWS):
            a[lo : lo + BLOCK_ROWS] = Space.weigh(a[lo : lo + BLOCK_ROWS], idf)
        dimensions = min(dimensions, *a.shape)
        y = a.T @ np.random.RandomState(seed).randn(n, dimensions + 16).astype(np.float32)
        for _ in range(4):  # power iterations of a randomised decomposition
            y = a.T @ (a @ np.linalg.qr(y)[0])
        y = np.linalg.qr(y)[0]
        projection = np.ascontiguousarray((y @ np.linalg.svd(a @ y, full_matrices=False)[2].T)[:, :dimensions])
        space = Space(idf, projection, np.zeros((0, dimensions), np.float32), labels.astype(np.float32))
        space.voters = a @ projection
        space.voters /= np.linalg.norm(space.voters, axis=1, keepdims=True) + 1e-9
        return space

    def place(self, counts: np.ndarray) -> np.ndarray:
        x = self.weigh(counts, self.idf) @ self.projection
        return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)

    def score(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        if not len(self.voters):
            return np.full(len(counts), 0.5)
        cosine = self.place(counts) @ self.voters.T
        k = min(neighbours, cosine.shape[1])
        top = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(cosine, top, axis=1), 0, 1).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        voted = (weight * self.labels[top]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.round(np.clip(np.where(total > 0, voted, self.labels.mean()), 0, 1), 6)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> Space:
    """Fit on the ``sample`` labelled documents whose ids come first in hash order (all, if there are fewer).

    Labels other than 0 and 1 are left out; a document labelled both ways counts as 0; of rows that repeat a doc_id one
    is taken. Without any labelled document every score is 0.5.
    """
    chosen = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).cast("long").alias("label_id")).agg(F.min(label).cast("int").alias("label"))
    chosen = chosen.where("label_id is not null").orderBy(F.xxhash64("label_id"), "label_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [zlib.compress(terms(t).tobytes(), 1) for t in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["label_id", "label", "terms"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        counts = np.zeros((rows.num_rows, TRIGRAMS + SHAPES * len(LEVELS)), np.float32)  # the one large table: 17 kB a row of the sample
        order = np.argsort(rows["label_id"].to_numpy())
        for i, at in enumerate(order.tolist()):
            counts[i] = np.frombuffer(zlib.decompress(rows["terms"][at].as_py()), np.uint32)
        space = Space.fit(counts, rows["label"].to_numpy()[order])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(space)], pa.binary())], ["space"])

    slim = docs.select(F.col(doc_id).cast("long").alias("label_id"), F.col(text).cast("string").alias("text"))
    found = slim.join(F.broadcast(chosen), "label_id").select("label_id", "label", "text").mapInArrow(run, "label_id long, label int, terms binary")
    rows = found.groupBy("label_id").agg(F.min(F.struct("terms", "label")).alias("x")).select("x.terms", "x.label", "label_id")  # `sample` rows at most
    space = rows.coalesce(1).mapInArrow(fit, "space binary").collect()  # one row, some 2 MB: one task fits, and the driver holds no table
    return pickle.loads(space[0].space) if space else Space(np.zeros(0), np.zeros(0), np.zeros((0, 0), np.float32), np.zeros(0))


def scored(docs: DataFrame, space: Space, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold), from whole texts alone.

    Texts without terms in common with any voter, such as empty and null ones, get the voters' share of label 1.
    Columns of ``docs`` are kept; columns of its own called score or predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(space)
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for batch in batches:
            texts, score = texts_of(batch.column(at)), []
            for lo, hi in by_size(texts, BLOCK_BYTES):
                for i in range(lo, hi, BLOCK_TEXTS):
                    score.append(space.score(np.stack([terms(t) for t in texts[i : min(hi, i + BLOCK_TEXTS)]])))
            score = np.concatenate(score) if score else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def op6_knn_quality(spark, sf_dir: str) -> DataFrame:
    """Contract digest: learned from labels that aren't held out, scored for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return scored(docs, learn(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
