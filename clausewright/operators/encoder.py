"""A text encoder learned from the corpus: term vectors from a randomised singular value decomposition of its TF-IDF
matrix, mean-pooled and normalised.

The matrix stays distributed, a sparse row a text. Block power iteration multiplies it with a block of as many rows as
the vocabulary has terms, max_features at most: each task adds up its own rows' part of the product, and the parts are
added up in a tree. The block is what the driver and each executor hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features as X
from . import inference
from . import retrieval as S
from .repeated import numbered
from .tables import added, dealt, kept, packed, summed

#: Between the grams of a text that is given to the encoder.
SEP = "\x1f"


@dataclass(frozen=True)
class Encoder:
    terms: dict[str, int]
    vectors: np.ndarray  # a term's singular vector times its inverse document frequency
    singular: np.ndarray

    def load(self) -> Callable[[list[str]], list[list[float]]]:
        """What inference.encode() asks for: from texts, as gram_text() gives them, to the means of their terms' vectors."""
        terms, vectors = self.terms, self.vectors

        def run(texts: list[str]) -> list[list[float]]:
            out = np.zeros((len(texts), vectors.shape[1]))
            for i, text in enumerate(texts):
                known = [k for g in text.split(SEP) if (k := terms.get(g)) is not None]
                if known:
                    out[i] = vectors[known].mean(axis=0)
            return out.tolist()

        return run


def gram_text(x: Column) -> Column:
    return F.array_join(X.grams(x, accents=False), SEP)


def sparse_rows(rows: DataFrame, max_features: int = 20_000, min_df: int = 1, most: int | None = 0) -> tuple[DataFrame, list[str], np.ndarray]:
    """(id, cells: array of k, weight) of rows (id, text), L2-normalised TF-IDF; the terms by number k; their idf.

    Where most allows it (operators.repeated), a row for each distinct text, times the root of how often it comes."""
    texts = numbered(rows, most)
    if texts is None:
        texts = rows.select("id", "text", F.lit(1).cast("long").alias("n"))
    else:  # a text that comes n times is one row, sqrt(n) times as long: A'A is the same
        texts = texts.select(F.col("tid").alias("id"), "text", "n")
    tf = kept(S.term_counts(texts, ["id", "n"]))
    found = S.counted_vocabulary(tf, texts, max_features, min_df).collect()  # max_features at most
    found.sort(key=lambda r: r["term"])
    terms = rows.sparkSession.createDataFrame([(r["term"], r["idf"], k) for k, r in enumerate(found)], "term string, idf double, k int")
    raw = tf.join(F.broadcast(terms), "term").select("id", "n", F.struct("k", ((F.log(F.col("tf").cast("double")) + 1) * F.col("idf")).alias("w")).alias("cell"))
    made = raw.groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("cell")).alias("cells"))
    norm = F.sqrt(F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["w"] * c["w"])) / F.sqrt(F.col("n").cast("double"))
    made = made.select("id", F.transform("cells", lambda c: F.struct(c["k"].alias("k"), (c["w"] / norm).alias("w"))).alias("cells"))
    return kept(dealt(made, "id")), [r["term"] for r in found], np.array([r["idf"] for r in found])


def gram_product(matrix: DataFrame, block: np.ndarray) -> np.ndarray:
    """A'A block of the sparse rows A of matrix (cells), without A'A."""
    sent = matrix.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        total = np.zeros_like(q)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                cells = batch.column(0)[at : at + 2000]
                flat = cells.flatten()
                k, w = np.asarray(flat.field("k")), np.asarray(flat.field("w"))[:, None]
                row = np.repeat(np.arange(len(cells)), np.asarray(cells.value_lengths()))
                y = added(row, q[k] * w, len(cells))
                total += added(k, y[row] * w, len(q))
        yield pa.record_batch([pa.array([packed(total.reshape(-1))], pa.binary())], names=["x"])

    out = summed(matrix.select("cells").mapInArrow(run, "x binary"), block.size).reshape(block.shape)
    sent.unpersist()
    return out


def decomposed(matrix: DataFrame, width: int, dims: int, over: int = 8, rounds: int = 4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The dims largest singular values of the sparse rows, of that width, and the right singular vectors (width x dims)."""
    size = min(width, dims + over)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0] if width else np.zeros((0, 0))
    if not width:
        return np.zeros(0), block
    for _ in range(rounds):
        block = np.linalg.qr(gram_product(matrix, block))[0]
    small = block.T @ gram_product(matrix, block)
    squares, turn = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-squares)[:dims]
    vectors = block @ turn[:, best]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])  # a vector and its negative are one
    return np.sqrt(np.maximum(squares[best], 0)), vectors * np.where(sign == 0, 1, sign)


def fit(rows: DataFrame, dims: int = 32, max_features: int = 20_000, most: int | None = None, **options) -> Encoder:
    """An encoder of rows (id, text): as many dims as the vocabulary allows."""
    matrix, terms, idf = sparse_rows(rows, max_features, most=most)
    singular, vectors = decomposed(matrix, len(terms), dims, **options)
    return Encoder({t: k for k, t in enumerate(terms)}, vectors * idf[:, None] if len(terms) else np.zeros((0, dims)), singular)


def encoded(rows: DataFrame, model: Encoder, column: str = "text") -> DataFrame:
    """rows with embedding; all zeros for a text without a known term."""
    names = [c for c in rows.columns if c != "embedding"]
    return inference.encode(rows.select(*names, gram_text(F.col(column)).alias("_grams")), model.load, "_grams").select(*names, "embedding")


def likeness(texts: DataFrame, model: Encoder) -> Callable:
    """For retrieval.fused_numbered(): the dot products of the encoded texts (text, tid from 1), few as they are numbered."""
    got = encoded(texts.select("tid", "text"), model).orderBy("tid").select("embedding").toArrow()
    vectors = np.asarray(got.column(0).combine_chunks().flatten(), dtype=np.float64).reshape(got.num_rows, -1)
    sent = texts.sparkSession.sparkContext.broadcast(vectors)
    return lambda a, b: np.einsum("ij,ij->i", sent.value[a], sent.value[b])
