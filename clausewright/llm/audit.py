"""How filters of a corpus overlap, in every order in which they can be applied: a product of incidence matrices.

A document's failures are the bits of a mask, one bit a filter. Of each part of the corpus three histograms of masks are
counted: of all documents, of good and of toxic ones. They are the rows of a matrix, as wide as there are masks
(32 for five filters). Integer matrices, masks by steps of orders (32 by 600), say what a step does with a document of a
mask: keep it, remove it, find it removed already, or be the only filter that it fails. The products are the report.

Histograms are summed before they are shuffled, so that a part may hold any share of the corpus; the products are made
in tasks, some parts at a time, and nothing of them goes to the driver.

A copy is a document whose text another one with a smaller id has. Texts are named by 128 bits of SHA-256. The first of
each text is found by a grouping on that name, and looked up by name and id together, so that no group of copies is
brought to one task.

Defined results: null text is empty, and empty texts are copies of each other; a null part is the empty string; a row
without id is no copy and has no labels, and nothing is a copy of it; rows with one id are documents of their own, none
a copy of the other unless a smaller id has the text; of several labels of an id one that says 1 is enough; labels of no
document count nothing; texts of any length count whole; an empty table has no part, so no row; further columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Filters by bit: too few words, too few distinct ones, too many capitals, marks, copies.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
MARKS = b"#$%&*|"
#: Parts whose products a task makes at a time.
PARTS = 256

_CAPITALS = bytes(range(65, 91))
_INSIDE = bytes(range(0x80, 0xC0))  # bytes that go on with a character


def text_failures(text: bytes) -> int:
    """The filters A to D that a text (UTF-8) fails, as bits 0 to 3."""
    words = text.split()  # bytes are split at [\x20\x09-\x0D]+
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    chars = len(text.translate(None, _INSIDE))
    few = len(words) < LEAST_WORDS
    alike = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    loud = 100 * capitals > CAPITAL_PERCENT * chars
    marked = len(text.translate(None, MARKS)) < len(text)
    return few | alike << 1 | loud << 2 | marked << 3


def judged(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, digest, mask) of docs (doc_id, text, part): the filters that look at a text alone."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, parts in C.text_blocks(batch.column(2)):
                texts = [bytes(p) for p in parts]
                digest = pa.array([hashlib.sha256(t).digest()[:16] for t in texts], pa.binary())
                mask = pa.array([text_failures(t) for t in texts], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], batch.column(1)[first:last], digest, mask], names=["doc_id", "part", "digest", "mask"])

    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, part string, digest binary, mask int")


def masked(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, mask) of docs: judged(), and bit 4 for copies."""
    rows = C.cut(judged(docs, part))
    firsts = rows.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("first"))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(firsts, ["doc_id", "digest"], "left").select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).cast("int").alias("mask"))


def histograms(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cells: array of mask, documents, good, toxic) of rows (doc_id, part, mask): by part the masks that occur."""
    by_id = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    cells = rows.join(by_id, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("documents"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "documents", "good", "toxic")).alias("cells"))


def step_matrices(filters: int) -> tuple[list[tuple[int, ...]], dict[str, np.ndarray]]:
    """All orders, and the matrices, masks by (order, step): kept, removed, redundant, unique_fails; own: steps by filter."""
    orders = list(permutations(range(filters)))
    bit = np.array([[1 << f for f in order] for order in orders]).reshape(-1)
    before = np.array([[sum(1 << f for f in order[:k]) for k in range(filters)] for order in orders]).reshape(-1)
    mask = np.arange(1 << filters)[:, None]
    fails, gone = (mask & bit) > 0, (mask & before) > 0
    found = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask == bit}
    found["own"] = bit[:, None] == 1 << np.arange(filters)
    return orders, {k: v.astype(np.int64) for k, v in found.items()}


def interactions(parts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """For each part of histograms(), order of the filters and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost (all long) and shapley, the removals of the step's filter summed over all orders."""
    n = len(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, m = step_matrices(n)
        names = np.repeat(["".join(filters[f] for f in order) for order in orders], n)
        steps = np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                part, cells = (batch.column(i)[at : at + PARTS] for i in (0, 1))
                row = np.repeat(np.arange(len(part)), np.asarray(cells.value_lengths()))
                flat = cells.flatten()
                h = np.zeros((3, len(part), 1 << n), dtype=np.int64)
                for k, kind in enumerate(("documents", "good", "toxic")):
                    h[k, row, np.asarray(flat.field("mask"))] = np.asarray(flat.field(kind))
                stacked = h.reshape(3 * len(part), -1)
                removed = (stacked @ m["removed"]).reshape(3, len(part), -1)
                columns = {k: h[0] @ m[k] for k in ("kept", "redundant", "unique_fails")}
                columns |= {"removed": removed[0], "good_lost": removed[1], "toxic_lost": removed[2], "shapley": removed[0] @ m["own"] @ m["own"].T}
                out = {"part": np.repeat(np.array(part.to_pylist(), dtype=object), len(names)), "filter_order": np.tile(names, len(part)), "step": np.tile(steps, len(part))}
                out |= {k: columns[k].reshape(-1) for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) if k in ("part", "filter_order") else pa.array(v) for k, v in out.items()], names=list(out))

    return parts.select("part", "cells").mapInArrow(run, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return interactions(histograms(masked(docs), labels))


OP13_SQL = r"""
WITH worded AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), firsts AS (
  SELECT coalesce(text, '') AS t, min(doc_id) AS first_id FROM documents GROUP BY 1
), masked AS (
  SELECT doc_id, part,
    (len(words) < 100)::INT
    + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > first_id, false)::INT AS mask
  FROM worded JOIN firsts USING (t)
), marked AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM masked LEFT JOIN marked USING (doc_id) GROUP BY 1, 2
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(f, b)
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE (a.b | b.b | c.b | d.b | e.b) = 31
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) AS s
), report AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER ((mask & (before | bit)) = 0), 0) AS kept,
    coalesce(sum(n) FILTER ((mask & bit) > 0 AND (mask & before) = 0), 0) AS removed,
    coalesce(sum(n) FILTER ((mask & bit) > 0 AND (mask & before) > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER ((mask & bit) > 0 AND (mask & before) = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER ((mask & bit) > 0 AND (mask & before) = 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM report
"""
