"""Quality classifier: labelled documents vote by similarity in a latent space of their texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from motorlot.llm.store import held_out

SAMPLE = 4000
DIMENSIONS = 48
NEIGHBOURS = 15
POWER = 4
THRESHOLD = 0.3
PAIR_TERMS = 1024
STYLE_WEIGHT = 30.0
TERMS = PAIR_TERMS + 2
BLOCK = 512
DIGITS = 9


def terms(text: str | None) -> np.ndarray:
    """Term weights of a whole text: hashed byte pairs, and the shares of repeated neighbours and repeated words.

    A null or empty text has no terms: all weights are 0.
    """
    out = np.zeros(TERMS, dtype=np.float32)
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return out
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    place = ((b[:-1] << np.uint32(8) | b[1:]) * np.uint32(2654435761)) >> np.uint32(22)
    out[:PAIR_TERMS] = np.sqrt(np.bincount(place, minlength=PAIR_TERMS) / max(len(place), 1))
    words = data.lower().split()
    if words:
        out[PAIR_TERMS] = sum(map(bytes.__eq__, words[1:], words)) / len(words) * STYLE_WEIGHT
        out[PAIR_TERMS + 1] = (1 - len(set(words)) / len(words)) * STYLE_WEIGHT
    return out


@dataclass
class Model:
    """Latent space and labelled vectors: vector = unit((terms - mean) * weight @ axes); votes are labels from 0 to 1."""

    mean: np.ndarray
    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray
    neighbours: int
    power: float

    def latent(self, rows: np.ndarray) -> np.ndarray:
        z = (rows.astype(np.float64) - self.mean) * self.weight @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Votes of the nearest labelled vectors, weighted by a power of the cosine; 0.5 where nothing is labelled.

        Cosines are compared to DIGITS places; vectors that tie for the last seats share them, so a score hangs neither on
        the order of the labelled vectors nor on the rows beside it.
        """
        if not len(self.votes):
            return np.full(len(rows), 0.5)
        cosine = np.round(self.latent(rows) @ self.vectors.T, DIGITS)
        k = min(self.neighbours, len(self.votes))
        least = np.partition(cosine, len(self.votes) - k, axis=1)[:, -k]
        row, near = np.nonzero(cosine >= least[:, None])
        value = cosine[row, near]
        last = value == least[row]
        tied, above = np.bincount(row[last], minlength=len(rows)), np.bincount(row[~last], minlength=len(rows))
        weight = (np.maximum(value, 0) ** self.power + 1e-12) * np.where(last, ((k - above) / np.maximum(tied, 1))[row], 1.0)
        return np.clip(np.bincount(row, weight * self.votes[near], len(rows)) / np.bincount(row, weight, len(rows)), 0, 1)


def fitted(rows: np.ndarray, votes: np.ndarray, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS, power: float = POWER) -> Model:
    """Latent semantic axes of the labelled rows: singular vectors of their centred terms, each pair term by its spread.

    The driver works block by block, so beside the rows themselves it holds one square matrix of the terms.
    """
    if not len(rows):
        return Model(np.zeros(TERMS), np.ones(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1)), votes, neighbours, power)
    mean = rows.mean(0, dtype=np.float64)
    blocks = [rows[start:start + BLOCK] for start in range(0, len(rows), BLOCK)]
    weight = 1 / (np.sqrt(sum(((x - mean) ** 2).sum(0) for x in blocks) / len(rows)) + 0.002)
    weight[PAIR_TERMS:] = 1
    gram = np.zeros((TERMS, TERMS))
    for x in blocks:
        centred = (x - mean) * weight
        gram += centred.T @ centred
    _, vectors = np.linalg.eigh(gram)
    model = Model(mean, weight, np.ascontiguousarray(vectors[:, ::-1][:, :dimensions]), np.zeros((0, dimensions)), votes, neighbours, power)
    model.vectors = np.concatenate([model.latent(x) for x in blocks])
    return model


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Model:
    """Model of at most `sample` labelled documents, those with the smallest hashes of their ids.

    Only ids that are not held out are learnt from, and of documents only the text. Several labels of a document count
    by their mean, null labels and null ids not at all; of several texts under one id the smallest counts.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("vote"))
    chosen = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "vote").agg(F.min("text").alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [terms(x).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "vote", "terms"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sorted(texts.mapInArrow(made, f"doc_id {kind}, vote double, terms binary").collect(), key=lambda r: r["doc_id"])
    matrix = np.frombuffer(b"".join(bytes(r["terms"]) for r in rows), dtype=np.float32).reshape(-1, TERMS)
    return fitted(matrix, np.array([min(max(r["vote"], 0.0), 1.0) for r in rows]), **options)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs plus `score`, from 0 to 1: higher where quality label 1 is likelier.

    Every whole text is scored, null and empty ones too, by its text alone; a column of docs named `score` gives way. The
    model, at most `sample` labelled vectors and the axes, is broadcast; each task takes the exact cosines of a block of
    BLOCK documents with all of them at once.
    """
    docs = docs.drop("score")
    at, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                score = shared.value.scores(np.stack([terms(x) for x in part.column(at).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], [*part.schema.names, "score"])

    return docs.mapInArrow(made, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """docs plus score and `predicted` (1 from the threshold on, else 0)."""
    return scored(docs.drop("predicted"), learned(docs, labels, **options)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The result columns of the quality query."""
    return judged(docs.select("doc_id", "text"), labels).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier takes, with their columns."""
    return judged(docs, labels, **options).where("predicted = 1").select(*[f"`{c}`" for c in docs.columns])
