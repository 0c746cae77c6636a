"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text is three groups of counts: its byte trigrams; the trigrams of its shape, in which letters count only by case,
digits as one sign, and a run of the same sign once; and how many of its words repeat the one before or the one before that or are
new. The counts are hashed into columns, damped by logarithm, weighted by inverse document frequency, and each group
is scaled to its length in GROUPS. A truncated singular value decomposition of at most SAMPLE labelled texts gives RANK latent axes;
texts are compared by the cosine of their places on them. The labelled vectors are broadcast (SAMPLE * RANK numbers at
most), and every document's cosines with all of them come as a matrix product, block by block. The NEIGHBOURS nearest
labels vote, weighted by similarity.

The sample is the labelled rows with the smallest hashes of their ids. Scoring needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import VISIBLE, Block, blocks, words
from .common import arrow_batches, unused

#: Columns and length of each group: byte trigrams, shape trigrams, repetition.
GROUPS = ((2048, 0.5), (1024, 1.0), (4, 1.0))
WIDTH = sum(n for n, _ in GROUPS)
RANK = 48
SAMPLE = 4000
NEIGHBOURS = 15
#: Power of the similarity that weighs a vote.
SHARPNESS = 8
#: Steps of a unit vector's numbers; their products fit whole into the 24 bits of a float.
STEPS = 1 << 11
ROWS = 128


_SHAPE = np.array([97 if chr(b).islower() or b > 127 else 65 if chr(b).isupper() else 48 if chr(b).isdigit() else 32 if b in (9, 10, 11, 12, 13, 32) else b for b in range(256)], dtype=np.uint32)


def _trigrams(x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """Add the hashed trigrams of each row of ``x`` to the columns of ``out``, whose number is a power of two."""
    if len(x) < 3:
        return
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    code = ((code * np.uint32(0x9E3779B1)) >> np.uint32(33 - out.shape[1].bit_length())).astype(np.int64)
    for i in range(len(rows) - 1):
        a, b = rows[i], rows[i + 1] - 2
        if b > a:
            out[i] = np.bincount(code[a:b], minlength=out.shape[1])


def counts(block: Block) -> np.ndarray:
    """float32 (rows, WIDTH): the counts of each row."""
    n = block.last - block.first
    out = np.zeros((n, WIDTH), np.float32)
    if not len(block.data):
        return out
    first, second = GROUPS[0][0], GROUPS[0][0] + GROUPS[1][0]
    x = block.data.astype(np.uint32)
    x[_SHAPE[block.data] == 32] = 32
    _trigrams(x, block.rows, out[:, :first])
    shape = _SHAPE[block.data]
    new = np.ones(len(shape), bool)
    new[1:] = shape[1:] != shape[:-1]
    new[block.rows[:-1][block.rows[:-1] < len(shape)]] = True
    _trigrams(shape[new], np.concatenate([[0], np.cumsum(new)])[block.rows], out[:, first:second])
    w = words(block, VISIBLE)
    row = np.repeat(np.arange(n), np.diff(w.rows))
    again, skipped = np.zeros(len(row), bool), np.zeros(len(row), bool)
    again[1:] = (w.codes[1:] == w.codes[:-1]) & (row[1:] == row[:-1])
    skipped[2:] = (w.codes[2:] == w.codes[:-2]) & (row[2:] == row[:-2])
    for j, flag in enumerate((again, skipped, ~again & ~skipped)):
        out[:, second + j] = np.bincount(row[flag], minlength=n)
    return out


def few_rows(column: pa.Array) -> Iterator[Block]:
    """Blocks of at most ROWS rows, so that their counts stay small."""
    for first in range(0, len(column), ROWS):
        yield from blocks(column.slice(first, ROWS))


def scaled(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted counts, each group scaled to its length."""
    out = np.log1p(c) * idf
    at = 0
    for n, length in GROUPS:
        part = out[:, at : at + n]
        part *= length / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
        at += n
    return out


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def place(self, c: np.ndarray) -> np.ndarray:
        """Unit vectors on the latent axes, in whole steps of 1 / STEPS; zero for a text without trigrams.

        Sums of products of such steps are exact in any order, so equal texts have equal cosines in any block.
        """
        v = scaled(c, self.idf).astype(np.float64) @ self.axes.astype(np.float64)
        return np.rint(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) * STEPS).astype(np.float32)

    def score(self, c: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest neighbours, weighted by similarity; the mean label if none is similar."""
        prior = float(self.labels.mean()) if len(self.labels) else 0.0
        if not len(self.labels):
            return np.full(len(c), prior)
        cosine = self.place(c) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        # of equal cosines the first labelled vectors count
        step = np.maximum(cosine, 0).astype(np.int64)
        key = step * cosine.shape[1] + np.arange(cosine.shape[1] - 1, -1, -1)
        near = np.sort(np.argpartition(key, -k, axis=1)[:, -k:], axis=1)
        weight = (np.take_along_axis(step, near, 1) / STEPS**2) ** SHARPNESS
        total = weight.sum(axis=1)
        voted = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.clip(np.where(total > 0, voted, prior), 0, 1)


def decompose(matrix: np.ndarray, rank: int, rounds: int = 4) -> np.ndarray:
    """The first right singular vectors of ``matrix`` as columns, by subspace iteration from a fixed start."""
    rank = max(1, min(rank, *matrix.shape))
    q = np.random.default_rng(1).standard_normal((matrix.shape[1], min(rank + 16, matrix.shape[1]))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(matrix.T @ (matrix @ q))
    _, _, vt = np.linalg.svd(matrix @ q, full_matrices=False)
    return (q @ vt.T)[:, :rank].astype(np.float32)


def fit(labelled: DataFrame, text: str, label: str, by: str, sample: int = SAMPLE, rank: int = RANK) -> Model:
    """Fit on the at most ``sample`` rows of ``labelled`` with the smallest hashes of ``by``. Null labels are left out."""
    schema = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("at", T.BinaryType()), T.StructField("n", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = [], []
            for b in few_rows(batch.column(1)):
                for c in counts(b):
                    some = np.flatnonzero(c)
                    at.append(some.astype("<i2").tobytes())
                    n.append(c[some].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=schema.names)

    arrow_batches(labelled.sparkSession)
    chosen = labelled.select(F.col(label).cast("double"), F.col(text).cast("string"), F.xxhash64(by).alias("h"), F.col(by)).filter(F.col(label).isNotNull())
    # packed, as the driver would hold lists of numbers as objects
    rows = chosen.orderBy("h", by).limit(sample).drop("h", by).mapInArrow(run, schema).collect()
    matrix, labels = np.zeros((len(rows), WIDTH), np.float32), np.array([r.label for r in rows])
    for i, r in enumerate(rows):
        matrix[i, np.frombuffer(r["at"], "<i2")] = np.frombuffer(r.n, "<f4")
    del rows
    idf = np.log((1 + len(labels)) / (1 + (matrix > 0).sum(axis=0))).astype(np.float32) + 1
    model = Model(idf, np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    if len(labels):
        model.axes = decompose(scaled(matrix, idf), rank)
        model.vectors = model.place(matrix).astype(np.float32)
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with score (0 to 1), one row per input row.

    Null or empty texts get the mean label. Of labelled vectors with equal cosines those with
    the smaller hash of their id vote. A kept column named score gives way to the result.
    """
    keep = [c for c in keep if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            parts = [m.score(counts(b)) for b in few_rows(batch.column(len(keep)))]
            made = pa.array(np.concatenate(parts) if parts else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [made], names=[*keep, "score"])

    arrow_batches(docs.sparkSession)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("score", T.DoubleType())])
    return docs.select(*keep, F.col(text).cast("string").alias(unused(keep))).mapInArrow(run, schema)
