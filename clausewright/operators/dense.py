"""Dense vectors ranked by inner product: a set of queries against all vectors, in blocks.

Queries and vectors are dealt to a grid by hashes of their ids. A cell has a bounded number of each, multiplies the two
blocks as matrices and gives what is left of them: for a query the k best of the cell, or a count. So what is shuffled
after the products grows with the cells, not with the pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and vectors of a cell, about; a product is of at most LINES queries at a time.
QUERIES, VECTORS, LINES = 4096, 16_384, 256
#: Decimal places that scores are compared by.
PLACES = 9


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def _dealt(rows: DataFrame, key: str, own: str, parts: int, other: str, copies: int) -> DataFrame:
    return rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def over_cells(queries: DataFrame, vectors: DataFrame, made: Callable[[pa.Table, pa.Table], pa.Table], schema: str, sizes: tuple[int, int] = (QUERIES, VECTORS)) -> DataFrame:
    """made() of the queries (query_id, q, ...) and vectors (candidate_id, v, ...) of each cell. Null vectors take no part."""
    queries, vectors = queries.where(F.col("q").isNotNull()), vectors.where(F.col("v").isNotNull())
    i, j = max(1, -(-queries.count() // sizes[0])), max(1, -(-vectors.count() // sizes[1]))
    one = _dealt(queries, "query_id", "cell_i", i, "cell_j", j).groupBy("cell_i", "cell_j")
    two = _dealt(vectors, "candidate_id", "cell_j", j, "cell_i", i).groupBy("cell_i", "cell_j")
    return one.cogroup(two).applyInArrow(made, schema)


def _blocks(left: pa.Table, right: pa.Table):
    """(first query, last, scores by vector in order of id) of a cell; a query isn't scored with the vector of its id."""
    if not left.num_rows or not right.num_rows:
        return
    right = right.sort_by("candidate_id")
    q, v = _matrix(left["q"]), _matrix(right["v"])
    qid, vid = np.asarray(left["query_id"]), np.asarray(right["candidate_id"])
    for at in range(0, len(q), LINES):
        scores = q[at : at + LINES] @ v.T
        scores[qid[at : at + LINES, None] == vid[None, :]] = -np.inf
        yield qid[at : at + LINES], slice(at, at + LINES), scores, vid, right


def top_k(queries: DataFrame, vectors: DataFrame, k: int, **options) -> DataFrame:
    """(query_id, candidate_id, score, hit, rank) of queries (query_id, q, label) and vectors (candidate_id, v, label):
    the k with the largest inner products, ties by id; hit where the labels are equal. Ids are long."""
    schema = "query_id long, candidate_id long, score double, hit boolean"
    names = ["query_id", "candidate_id", "score", "hit"]

    def made(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[] for _ in names]
        for qid, rows, scores, vid, held in _blocks(left, right):
            near = np.round(scores, PLACES)
            n = min(k, near.shape[1])
            least = -np.partition(-near, n - 1, axis=1)[:, n - 1]
            row, col = np.nonzero((near >= least[:, None]) & np.isfinite(near))
            order = np.lexsort((col, -near[row, col], row))
            row, col = row[order], col[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k  # of ties at the end the smallest ids
            row, col = row[keep], col[keep]
            one, two = left["label"].combine_chunks()[rows.start : rows.stop], held["label"].combine_chunks()
            hit = np.array([x is not None and x == y for x, y in zip(one.take(pa.array(row)).to_pylist(), two.take(pa.array(col)).to_pylist(), strict=True)], dtype=bool)
            for x, y in zip(out, (qid[row], vid[col], scores[row, col], hit), strict=True):
                x.append(y)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
        return pa.table({c: pa.array(np.concatenate(x) if x else [], t) for c, x, t in zip(names, out, kinds, strict=True)})

    found = over_cells(queries, vectors, made, schema, **options)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", PLACES)), "candidate_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def first_hits(queries: DataFrame, vectors: DataFrame, **options) -> DataFrame:
    """(query_id, first_rank): the rank of the best vector with a query's label, null if none has it.

    The best is found first; its rank is one more than the number of vectors that come before it."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, score, cand = [], [], []
        for qid, rows, scores, vid, held in _blocks(left, right):
            one, two = (np.array(x.to_pylist(), dtype=object) for x in (left["label"].combine_chunks()[rows.start : rows.stop], held["label"].combine_chunks()))
            same = np.array([x is not None for x in one])[:, None] & (one[:, None] == two[None, :])
            near = np.where(same, np.round(scores, PLACES), -np.inf)
            at = near.argmax(axis=1)  # the first of equals, so the smallest id
            top = near[np.arange(len(at)), at]
            some = np.isfinite(top)
            ids.append(qid[some]), score.append(top[some]), cand.append(vid[at[some]])
        join = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        return pa.table({"query_id": join(ids, pa.int64()), "top": join(score, pa.float64()), "best_id": join(cand, pa.int64())})

    found = over_cells(queries, vectors, best, "query_id long, top double, best_id long", **options)
    marks = found.groupBy("query_id").agg(F.max(F.struct("top", (-F.col("best_id")).alias("b"))).alias("x")).select("query_id", "x.top", (-F.col("x.b")).alias("best_id"))
    asked = queries.select("query_id", "q").join(marks, "query_id")

    def before(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, n = [], []
        for qid, rows, scores, vid, _ in _blocks(left, right):
            top, own = (np.asarray(left[c].combine_chunks()[rows.start : rows.stop])[:, None] for c in ("top", "best_id"))
            near = np.round(scores, PLACES)
            ids.append(qid), n.append(((near > top) | ((near == top) & (vid[None, :] < own))).sum(axis=1))
        return pa.table({"query_id": pa.array(np.concatenate(ids) if ids else [], pa.int64()), "n": pa.array(np.concatenate(n) if n else [], pa.int64())})

    ranks = over_cells(asked, vectors.select("candidate_id", "v"), before, "query_id long, n long", **options).groupBy("query_id").agg((F.sum("n") + 1).cast("int").alias("first_rank"))
    return queries.select("query_id").join(ranks, "query_id", "left")


def as_vectors(rows: DataFrame, key: Column, vector: Column, label: Column, names: tuple[str, str]) -> DataFrame:
    return rows.select(key.cast("long").alias(names[0]), vector.cast("array<double>").alias(names[1]), label.alias("label"))
