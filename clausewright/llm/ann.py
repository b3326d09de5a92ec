"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector by `bits` Gaussian projections, each shifted by a random offset and cut into cells of `width`
times the vectors' spread. A query visits, besides its own bucket, the buckets that differ in a few cells, in ascending
order of the estimated chance to hold neighbours: the sum of the squared distances to the cell walls that are crossed.
The candidates of all tables and probes are ranked by exact Euclidean distance in double precision.

Equal vectors are one class with its smallest ids, as many as are asked for and one, since more of them can never be
among the nearest; equal queries are searched once. Buckets are counted first, by their keys alone. Those that hold many
classes are dealt into chunks, and the queries that probe them too, so that a block is a bounded number of each; then
vectors go to their blocks in one shuffle, in the type they have. The tables' parameters are fixed; each row is indexed.

Defined results: vectors null, empty, all zero or with null or non-finite components take no part; vectors of unlike
dimension are never compared; a null id takes no part; ties go to the smaller id; with fewer candidates than asked
for, all that were found are returned. A vec_id that is on several rows is one candidate, at its smallest distance, and
one query, which has the nearest of any of its vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class Params:
    tables: int = 2
    bits: int = 8
    width: float = 3.5
    probes: int = 128
    chunk: int = 2048  # classes or queries of a bucket in one block
    seed: int = 11


def usable(v: Column) -> Column:
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & sound & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix in double precision."""
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def _projections(dim: int, table: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([p.seed, dim, table])
    return rng.normal(size=(dim, p.bits)), rng.random(p.bits)


def probe_order(into: np.ndarray, probes: int) -> np.ndarray:
    """Cell offsets (probes x bits) for a query that stands at `into` (0 to 1) in its cells, the likeliest first.

    Sets of crossed walls come from a heap: a set is followed by the one with its last wall moved on, and the one with
    the next wall added. A set that crosses both walls of a cell is passed over."""
    k = len(into)
    cost = np.concatenate([into**2, (1 - into) ** 2])
    order = np.argsort(cost, kind="stable")
    cost, cell, step = cost[order], order % k, np.where(order < k, -1, 1)
    out = [np.zeros(k, dtype=np.int64)]
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        c, walls = heapq.heappop(heap)
        cells = [cell[w] for w in walls]
        if len(set(cells)) == len(cells):
            move = np.zeros(k, dtype=np.int64)
            for w in walls:
                move[cell[w]] = step[w]
            out.append(move)
        last = walls[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (c - cost[last] + cost[last + 1], (*walls[:-1], last + 1)))
            heapq.heappush(heap, (c + cost[last + 1], (*walls, last + 1)))
    return np.array(out)


def _keys(cells: np.ndarray, dim: int, table: int) -> np.ndarray:
    """One 64-bit key for each row of cells."""
    h = np.full(len(cells), np.uint64((dim * 1_000_003 + table) & 0xFFFFFFFFFFFFFFFF), dtype=np.uint64)
    for j in range(cells.shape[1]):
        h = C.mix64(h ^ (cells[:, j].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return h.view(np.int64)


def _by_dimension(vectors: pa.Array, rows: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """(dimension, places) of some vectors of one dimension each."""
    lengths = np.asarray(vectors.value_lengths())
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        for some in np.array_split(at, -(-len(at) // rows)):
            yield int(dim), some


def _spread(classes: DataFrame) -> dict[int, float]:
    """By dimension the root of the mean squared distance from the mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, some in _by_dimension(batch.column(0), 4096):
                m = _matrix(batch.column(0).take(pa.array(some)))
                sums[dim] = sums.get(dim, 0) + np.stack([np.full(dim, len(m)), m.sum(0), (m * m).sum(0)])
        for dim, (n, s, q) in sums.items():
            yield pa.record_batch([pa.array(np.full(dim, dim)), pa.array(np.arange(dim)), pa.array(n), pa.array(s), pa.array(q)], names=["dim", "i", "n", "s", "q"])

    parts = classes.select("v").mapInArrow(run, "dim long, i long, n double, s double, q double").groupBy("dim", "i").agg(*[F.sum(c).alias(c) for c in "nsq"])
    var = F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)
    return {r["dim"]: max(float(r["s"]), 0.0) ** 0.5 or 1.0 for r in parts.groupBy("dim").agg(F.sum(var).alias("s")).collect()}


def _keyed(column: pa.Array, spread: dict[int, float], p: Params, probing: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in column, keys) of the buckets that vectors are in, or that they probe."""
    for dim, some in _by_dimension(column):
        m = _matrix(column.take(pa.array(some)))
        for t in range(p.tables):
            a, b = _projections(dim, t, p)
            x = m @ a / (p.width * spread[dim]) + b
            cells = np.floor(x).astype(np.int64)
            if not probing:
                yield some, _keys(cells, dim, t)
                continue
            moved = [cells[k] + probe_order(x[k] - cells[k], p.probes) for k in range(len(some))]
            yield np.repeat(some, [len(k) for k in moved]), _keys(np.concatenate(moved), dim, t)


def _bucket_sizes(rows: DataFrame, spread: dict[int, float], p: Params, probing: bool) -> DataFrame:
    """(key, n) of the buckets of rows (id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, keys in _keyed(batch.column(0), spread, p, probing):
                keys, n = np.unique(keys, return_counts=True)
                yield pa.record_batch([pa.array(keys), pa.array(n)], names=["key", "n"])

    return rows.select("v").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _large(sizes: DataFrame, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of more than chunk rows, ascending, and into how many chunks each is dealt. The driver gets 100,000 at most."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    limit = max(chunk, total // 100_000)
    got = sorted((r["key"], -(-r["n"] // limit)) for r in sizes.where(F.col("n") > limit).collect())
    return np.array([k for k, _ in got], dtype=np.int64), np.array([n for _, n in got], dtype=np.int64)


def _parts(keys: np.ndarray, large: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.ones(len(keys), dtype=np.int64)
    if len(large[0]):
        at = np.minimum(np.searchsorted(large[0], keys), len(large[0]) - 1)
        hit = large[0][at] == keys
        out[hit] = large[1][at[hit]]
    return out


def _dealt(rows: DataFrame, spread: dict[int, float], p: Params, probing: bool, own, other, groups: int) -> DataFrame:
    """(g, block, id, head, v): each row of rows (id, head, v) in the blocks of its buckets.

    own and other: the large buckets among rows of this side, and among those of the other; a block is a pair of chunks."""
    kind = rows.schema["v"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast((own, other))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other = sent.value
        for batch in batches:
            ids = np.asarray(batch.column(0)).view(np.uint64)
            for place, keys in _keyed(batch.column(2), spread, p, probing):
                chunk = C.mix64(ids[place].copy()) % _parts(keys, own).astype(np.uint64)
                times = _parts(keys, other)
                place, keys, chunk = (np.repeat(x, times) for x in (place, keys, chunk))
                across = (np.arange(len(keys)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
                i, j = (across, chunk) if probing else (chunk, across)
                block = C.mix64(C.mix64(keys.view(np.uint64) ^ (i * np.uint64(0x9E3779B97F4A7C15))) ^ (j * np.uint64(0xC2B2AE3D27D4EB4F)))
                for at in range(0, len(place), 4096):
                    some = pa.array(place[at : at + 4096])
                    g = (block[at : at + 4096] % np.uint64(groups)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(block[at : at + 4096].view(np.int64)), *(c.take(some) for c in batch.columns)], names=["g", "block", "id", "head", "v"])

    return rows.select("id", "head", "v").mapInArrow(run, f"g long, block long, id long, head long, v {kind}")


def _nearest(m: np.ndarray, head: np.ndarray, q: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of q the least nearest rows of m, ties by head: exact distances and places. A matrix product picks
    those that can be."""
    rough = (q * q).sum(1)[:, None] + (m * m).sum(1)[None] - 2 * (q @ m.T)
    slack = 1e-9 * ((q * q).sum(1) + (m * m).sum(1).max())
    if len(head) > least:
        mask = rough <= (np.partition(rough, least - 1, axis=1)[:, least - 1] + slack)[:, None]
    else:
        mask = np.ones(rough.shape, dtype=bool)
    out = []
    for k, x in enumerate(q):
        at = np.flatnonzero(mask[k])
        d = np.sqrt(((m[at] - x) ** 2).sum(1))
        pick = np.lexsort((head[at], d))[:least]
        out.append((d[pick], at[pick]))
    return out


def _compare(least: int):
    """Cogrouped kernel: the nearest classes of each query among those that share one of its blocks."""
    schema = C.fields("query:l,cid:l,head:l,score:d")

    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        if not data.num_rows or not queries.num_rows:
            return schema.empty_table()
        data, queries = data.combine_chunks(), queries.combine_chunks()
        block_d, block_q = (np.asarray(x.column("block")) for x in (data, queries))
        ids_d, ids_q, heads = np.asarray(data.column("id")), np.asarray(queries.column("id")), np.asarray(data.column("head"))
        v_d, v_q = data.column("v").chunk(0), queries.column("v").chunk(0)
        order, order_q = np.argsort(block_d, kind="stable"), np.argsort(block_q, kind="stable")
        sorted_d, sorted_q = block_d[order], block_q[order_q]
        out: dict[int, list] = {}
        for block in np.intersect1d(sorted_d, sorted_q):
            own = order[np.searchsorted(sorted_d, block) : np.searchsorted(sorted_d, block, side="right")]
            asks = order_q[np.searchsorted(sorted_q, block) : np.searchsorted(sorted_q, block, side="right")]
            m = _matrix(v_d.take(pa.array(own)))
            for at in range(0, len(asks), 128):
                some = asks[at : at + 128]
                for query, (d, at_) in zip(ids_q[some], _nearest(m, heads[own], _matrix(v_q.take(pa.array(some))), least), strict=True):
                    out.setdefault(int(query), []).append((d, own[at_]))
        q, c, s = [], [], []
        for query, found in out.items():
            d, i = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
            _, first = np.unique(ids_d[i], return_index=True)
            d, i = d[first], i[first]
            pick = np.lexsort((heads[i], d))[:least]
            q.append(np.full(len(pick), query)), c.append(i[pick]), s.append(d[pick])
        if not q:
            return schema.empty_table()
        at = np.concatenate(c)
        return pa.table([pa.array(np.concatenate(q)), pa.array(ids_d[at]), pa.array(heads[at]), pa.array(np.concatenate(s))], schema=schema)

    return run


def search(vectors: DataFrame, queries: Column, nearest: int = 10, params: Params = Params()) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of vectors (vec_id, embedding) where queries holds."""
    p, least = params, nearest + 1
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"), queries.alias("asks"))
    if "float" not in rows.schema["v"].dataType.simpleString():
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("mark", F.xxhash64("v"))
    first = Window.partitionBy("mark", "v").orderBy("id")
    few = rows.select("id", "v", "mark").withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= least)
    ids = F.array_sort(F.collect_set("id"))
    classes = C.cut(few.groupBy("mark", "v").agg(ids.alias("ids")).select("mark", "v", "ids", F.col("ids")[0].alias("id"), F.xxhash64("mark", F.col("ids")[0]).alias("cid")))
    # a query's class is found by its vector
    asks = rows.where("asks").select(F.col("id").alias("query_id"), F.col("v").alias("own"), "mark")
    asked = C.cut(C.salted_join(asks, classes.select("mark", "v", "cid"), "mark", "query_id").where("own = v").select("query_id", F.col("cid").alias("query")).distinct())
    spread = _spread(classes)
    index = classes.select(F.col("cid").alias("id"), F.col("id").alias("head"), "v")
    wanted = C.cut(index.join(asked.select(F.col("query").alias("id")).distinct(), "id", "left_semi"))
    held, tried = _bucket_sizes(index, spread, p, False), C.cut(_bucket_sizes(wanted, spread, p, True))
    held = C.cut(held)
    large_d, large_q = _large(held, p.chunk), _large(tried, p.chunk)
    n = held.withColumnRenamed("n", "d").join(tried.withColumnRenamed("n", "q"), "key").agg(F.sum(F.ceil(F.col("d") / p.chunk) * F.ceil(F.col("q") / p.chunk))).first()[0] or 0
    groups = max(32, int(n) // 16)
    data, ask = _dealt(index, spread, p, False, large_d, large_q, groups), _dealt(wanted, spread, p, True, large_q, large_d, groups)
    near = data.groupBy("g").cogroup(ask.groupBy("g")).applyInArrow(_compare(least), "query long, cid long, head long, score double")
    best = near.groupBy("query", "cid", "head").agg(F.min("score").alias("score"))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("score", "head", "cid"))).where(F.col("n") <= least)
    best = C.cut(best.join(classes.select("cid", "ids"), "cid").select("query", "score", F.explode("ids").alias("vec_id")))
    mine = C.salted_join(asked, best, "query", "query_id").where("vec_id <> query_id")
    mine = mine.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= nearest)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_nearest(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
