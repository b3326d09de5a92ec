"""Language identification by mixture inference.

A document is taken as words drawn from several languages. Each language gives a word a likelihood by its byte
4-grams; expectation-maximisation estimates the document's language proportions; the set of languages grows
by one as long as that improves the penalised likelihood (half a log of the word count for each language beyond the
first); it may hold all of them.

Defined results: null text or a text without letters gives `und` with score 0, as does every text when nothing was
learned; equal texts get equal results; ties go to the language first in code-point order; columns of the input other
than those named are left alone. Whole texts are used; a block of texts of BLOCK_BYTES is in memory at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")

#: Bytes as the n-grams see them: letters in lower case, bytes of other scripts as they are, all else a space.
_SEEN = np.full(256, 0x20, dtype=np.uint8)
_SEEN[97:123] = np.arange(97, 123)
_SEEN[65:91] = np.arange(97, 123)
_SEEN[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Params:
    bits: int = 16  # log2 of the number of n-gram buckets of a language
    smoothing: float = 0.5
    rounds: int = 6  # of expectation-maximisation
    penalty: float = 0.5  # times log(words), for each language beyond the first


def _grams(parts: list[memoryview], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, where each word's begin, and the number of words in each part."""
    raw, starts = C.joined(parts)
    b = _SEEN[raw]
    upper = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)) + 1  # capitals of Latin-1
    b[upper] += 0x20
    wide = b.astype(np.uint32)
    gram = wide.copy()
    for k in (1, 2, 3):
        gram[k:] |= wide[:-k] << np.uint32(8 * k)
        gram[:k] |= np.uint32(0x20) << np.uint32(8 * k)
    ink = b != 0x20
    use = ink.copy()
    use[1:] |= ink[:-1]  # with the space after a word
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    at = np.cumsum(use) - 1
    words = np.flatnonzero(first)
    # what stands before the word is not part of it
    for k in (1, 2, 3):
        i = words + (k - 1)
        i = i[i < len(gram)]
        keep = np.uint32((1 << (8 * k)) - 1)
        gram[i] = (gram[i] & keep) | (np.uint32(0x20202020) & ~keep)
    bucket = (gram[use] * np.uint32(2654435761)) >> np.uint32(32 - bits)
    return bucket, at[words], np.diff(np.searchsorted(words, starts))


def learn(docs: DataFrame, params: Params = Params()) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log-probabilities by bucket, counted over all of docs (text, lang), nulls left out.

    The driver gets at most 2**bits counts for each language."""
    bits = params.bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, last, parts in C.text_blocks(batch.column(0)):
                by: dict[str, list] = {}
                for lang, part in zip(langs[first:last], parts, strict=True):
                    by.setdefault(lang, []).append(part)
                for lang, own in by.items():
                    have = seen.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
                    have += np.bincount(_grams(own, bits)[0], minlength=1 << bits)
        for lang, have in seen.items():
            k = np.flatnonzero(have)
            yield pa.record_batch([pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(have[k])], schema=C.fields("lang:s,bucket:i,n:l"))

    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(count, "lang string, bucket int, n long")
    got = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    table = np.zeros((1 << bits, len(langs)))
    if langs:
        place = {x: i for i, x in enumerate(langs)}
        table[got["bucket"], got["lang"].map(place)] = got["n"]
    table = np.log((table + params.smoothing) / (table.sum(0) + params.smoothing * (1 << bits)))
    return langs, table.astype(np.float32)


def _fit(p: np.ndarray, doc: np.ndarray, first: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by document and the log-likelihood of each, from word likelihoods p and the proportions to begin with."""
    words = np.diff(np.append(first, len(doc)))[:, None]
    for _ in range(rounds):
        r = p * share[doc]
        r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
        share = np.add.reduceat(r, first, axis=0) / words
    like = np.add.reduceat(np.log(np.maximum((p * share[doc]).sum(1), 1e-300)), first)
    return share, like


def mixtures(parts: list[memoryview], table: np.ndarray, params: Params = Params()) -> np.ndarray:
    """Language proportions of each text (rows) under table; a row of zeros where a text has no words."""
    langs = table.shape[1]
    out = np.zeros((len(parts), langs))
    bucket, at, words = _grams(parts, params.bits)
    if not len(at) or not langs:
        return out
    score = np.add.reduceat(table[bucket], at, axis=0).astype(np.float64)
    p = np.exp(score - score.max(1, keepdims=True))
    has = np.flatnonzero(words)
    n = words[has]
    doc = np.repeat(np.arange(len(has)), n)
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    top = np.zeros_like(p)
    top[np.arange(len(p)), p.argmax(1)] = 1
    share = (np.add.reduceat(top, first, axis=0) + 0.1) / (n[:, None] + 0.1 * langs)
    share, _ = _fit(p, doc, first, share, params.rounds)
    order = np.argsort(-share, axis=1, kind="stable")
    best, best_at = np.zeros_like(share), np.full(len(has), -np.inf)
    # the set grows by the language with the next largest share, as long as that improves the penalised likelihood
    going = np.arange(len(has))
    for size in range(1, langs + 1):
        mask = np.zeros_like(share)
        np.put_along_axis(mask, order[:, :size], 1, axis=1)
        start = share * mask + 1e-6 * mask
        start /= start.sum(1, keepdims=True)
        fitted, like = _fit(p, doc, first, start, params.rounds if size > 1 else 0)
        value = like - params.penalty * (size - 1) * np.log(n + 1.0)
        better = value > best_at
        best[going[better]], best_at = fitted[better], value[better]
        if not better.any():
            break
        if not better.all():  # the others are done
            p, n, going, share, order = p[better[doc]], n[better], going[better], share[better], order[better]
            doc = np.repeat(np.arange(len(going)), n)
            first = np.concatenate(([0], np.cumsum(n)[:-1]))
    out[has] = best
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], params: Params = Params(), keep: list[str] | None = None) -> DataFrame:
    """Columns keep of docs (all by default) with lang_pred, score (its proportion) and mixture ('en:0.91,fr:0.09').

    Columns of docs by these three names are replaced."""
    langs, table = model
    names = [n for n in (docs.columns if keep is None else keep) if n not in ("lang_pred", "score", "mixture")]
    sent = docs.sparkSession.sparkContext.broadcast(table)
    kinds = [docs.schema[n].dataType for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        for batch in batches:
            preds, scores, mixes = [], [], []
            text = C.as_string(batch.column(batch.num_columns - 1))
            for first, last, parts in C.text_blocks(text):
                share = mixtures(parts, weights, params)
                for k, i in enumerate(range(first, last)):
                    row = share[k]
                    if not langs or not row.any() or not _has_letter(parts[k]):
                        preds.append(UNDETERMINED), scores.append(0.0), mixes.append("")
                        continue
                    j = int(row.argmax())
                    preds.append(langs[j]), scores.append(min(1.0, float(row[j])))
                    mixes.append(",".join(f"{langs[x]}:{row[x]:.3f}" for x in np.argsort(-row, kind="stable") if row[x] >= 0.0005))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(mixes, pa.string())], names=[*names, "lang_pred", "score", "mixture"])

    ddl = ", ".join(f"`{n}` {k.simpleString()}" for n, k in zip(names, kinds, strict=True))
    own = "_text"
    while own in names:
        own += "_"
    return docs.select(*[F.col(f"`{n}`") for n in names], F.col("text").alias(own)).mapInArrow(run, f"{ddl}, lang_pred string, score double, mixture string")


_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def _has_letter(part: memoryview) -> bool:
    return bool(_ASCII_LETTER.search(part) or _LETTER.search(str(part, "utf-8", "replace")))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = C.crc_mod(F.col("doc_id"), 3) == 1
    model = learn(docs.where(~held))
    return identify(docs.withColumn("held_out", held), model, keep=["doc_id", "held_out"])
