"""Pairs of the rows of a document, made where the rows lie: one shuffle by document brings them together, in order, and pairs
are measured by the numbers of their texts (operators.repeated). No pair goes through a shuffle to be made or ranked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import dealt

#: Pairs that a task makes at once, and values of their terms.
BLOCK = 1 << 17
VALUES = 1 << 22
#: Cells of a matrix of texts by terms up to which it is held dense by each task.
DENSE = 12_000_000
#: idf of a term that one of two texts has: 1 + ln(3/2).
ALONE = 1.4054651081081644


class Cells:
    """Weights of terms by text (numbers from 0): what two texts have in common, for many pairs of texts at once."""

    def __init__(self, tid: np.ndarray, term: np.ndarray, weight: np.ndarray, texts: int):
        order = np.lexsort((term, tid))
        self.tid, self.term, self.weight = tid[order], term[order], weight[order]
        self.width = int(term.max()) + 1 if len(term) else 0  # one more: no term
        self.start = np.searchsorted(self.tid, np.arange(texts + 1))
        size = np.diff(self.start)
        most = int(size.max()) if texts else 0
        self.idx = np.full((texts, most), self.width, dtype=np.int64)
        self.val = np.zeros((texts, most))
        at = np.arange(len(self.tid)) - self.start[self.tid]
        self.idx[self.tid, at], self.val[self.tid, at] = self.term, self.weight
        self.squares = np.bincount(self.tid, weights=self.weight**2, minlength=texts)
        self.dense = self.keys = None
        if texts * (self.width + 1) <= DENSE:
            self.dense = np.zeros((texts, self.width + 1))
            self.dense[self.tid, self.term] = self.weight
        else:
            self.keys = self.tid * (self.width + 1) + self.term

    def _common(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the terms of each b the weights in a and in b."""
        at = self.idx[b]
        if self.dense is not None:
            return self.dense[a[:, None], at], self.val[b]
        want = a[:, None] * (self.width + 1) + at
        place = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[place] == want, self.weight[place], 0.0), self.val[b]

    def _blocks(self, a: np.ndarray, b: np.ndarray, f: Callable) -> np.ndarray:
        if not len(self.tid):
            return np.zeros(len(a))
        low, high = np.minimum(a, b), np.maximum(a, b)  # summed alike both ways
        step = max(1, VALUES // max(1, self.idx.shape[1]))
        parts = [f(low[k : k + step], high[k : k + step]) for k in range(0, len(a), step)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def dots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._blocks(a, b, lambda x, y: np.einsum("ij,ij->i", *self._common(x, y)))

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many terms both have."""
        return self._blocks(a, b, lambda x, y: np.count_nonzero(self._common(x, y)[0], axis=1).astype(np.float64))

    def cosines(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """features.pair_cosine(): the TF-IDF cosine of two texts that are the corpus."""

        def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            wx, wy = self._common(x, y)
            has = wx > 0
            sx, sy = np.einsum("ij,ij->i", wx, wx), np.einsum("ij,ij->i", wy * wy, has)
            norm = (sx + ALONE**2 * (self.squares[x] - sx)) * (sy + ALONE**2 * (self.squares[y] - sy))
            return np.divide(np.einsum("ij,ij->i", wx, wy), np.sqrt(norm), out=np.zeros(len(x)), where=norm > 0)

        return self._blocks(a, b, cosine)


def cells(weights: DataFrame, texts: int, most: int) -> Cells | None:
    """The Cells of weights (tid from 1, term, weight) of so many texts; None where there are more than most, or one text has
    so many terms that a table as wide as it is too large."""
    sizes = weights.groupBy("tid").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("widest")).first()
    if (sizes["n"] or 0) > most or (sizes["widest"] or 0) * texts > DENSE:
        return None
    got = weights.select("tid", "term", "weight").toPandas()
    term = pd.factorize(got["term"], sort=True)[0].astype(np.int64)  # sums don't depend on the order of rows
    return Cells(got["tid"].to_numpy(np.int64) - 1, term, got["weight"].to_numpy(np.float64), texts)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole documents, many at once; the first column says which."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0)
        new = np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1
        if held and held[-1].column(0)[-1] != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(new):
            yield pa.Table.from_batches([*held, batch.slice(0, int(new[-1]))])
            batch, held = batch.slice(int(new[-1])), []
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _places(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] numbers, then those of the next."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def paired(rows: DataFrame, keep: tuple[str, ...], measures: Callable | None, names: tuple[str, ...] = (), way: str = "once", best: int | None = None, last: bool = False, by: str = "score", after: Callable | None = None, more: str = "", long: bool = False) -> DataFrame:
    """Pairs of the rows (document_id, ord, tid, keep...) of a document: document_id, a_* and b_* of keep, ta, tb, and names,
    the arrays that measures(ta, tb) gives (texts from 0).

    way: once, a before b in ord; both, both ways but for rows with one value of the first of keep; across, a with
    side 1, b with side 0 (a column of rows). best: of each a the best b by its measure by, to nine places, ties in ord (last:
    the last first), with rank and back, the rank of the pair the other way, null if it isn't there. after(a, ta, tb, values), values
    with candidate, the place of b's first of keep in their order:
    further rows (index of the pair) and columns of more (a schema), of pairs with the same a, in ord. long: what is made of
    the pairs in the same tasks takes long for few bytes."""
    rows = rows.where("document_id IS NOT NULL").select("document_id", *(["side"] if way == "across" else []), "ord", "tid", *keep)
    order = ["side", "ord"] if way == "across" else ["ord"]
    rows = (dealt(rows, "document_id") if long else rows.repartition("document_id")).sortWithinPartitions("document_id", *order)
    kind = lambda c: rows.schema[c].dataType.simpleString()
    fields = [f"document_id {kind('document_id')}", *[f"{s}_{c} {kind(c)}" for s in "ab" for c in keep], "ta int", "tb int", *[f"{n} double" for n in names]]
    if best is not None:
        fields += ["rank int", "back int"]
    if more:
        fields.append(more)
    labels = [f.split()[0] for f in ", ".join(fields).split(", ")]

    def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        col = lambda c: table.column(c).combine_chunks() if isinstance(table.column(c), pa.ChunkedArray) else table.column(c)
        doc = col("document_id")
        first = np.concatenate(([0], np.flatnonzero(pc.not_equal(doc[1:], doc[:-1]).to_numpy(zero_copy_only=False)) + 1))
        size = np.diff(np.append(first, len(doc)))
        begin, end = np.repeat(first, size), np.repeat(first + size, size)
        at = np.arange(len(doc))
        tid = col("tid").to_numpy(zero_copy_only=False).astype(np.int64) - 1
        if way == "across":
            asked = col("side").to_numpy(zero_copy_only=False) == 1
            end = np.repeat(first + np.add.reduceat((~asked).astype(np.int64), first), size)
            start, count = begin, np.where(asked, end - begin, 0)
        elif way == "both":
            start, count = begin, end - begin
            name = pc.dictionary_encode(col(keep[0]), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        else:
            start, count = at + 1, end - at - 1
        cuts = np.searchsorted(np.cumsum(count), np.arange(BLOCK, count.sum() + BLOCK, BLOCK))
        cuts = np.unique(np.concatenate(([0], np.minimum(cuts + 1, len(doc)), [len(doc)])))
        found = []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            a, b = np.repeat(at[x:y], count[x:y]), _places(start[x:y], count[x:y])
            if way == "both":
                other = name[a] != name[b]
                a, b = a[other], b[other]
            values = list(measures(tid[a], tid[b])) if measures else []
            if best is None:
                yield from told(col, tid, a, b, values, [])
                continue
            score = np.round(values[names.index(by)], 9)
            o = np.lexsort((-b if last else b, -score, a))
            n = np.arange(len(o)) - np.searchsorted(a, a)[o] + 1  # a ascends
            o, n = o[n <= best], n[n <= best]
            found.append((a[o], b[o], n, *[v[o] for v in values]))
        if best is None or not found:
            return
        a, b, rank, *values = (np.concatenate(x) for x in zip(*found, strict=True))
        if after is not None:
            o = np.lexsort((b, a))
            a, b, rank, values = a[o], b[o], rank[o], [v[o] for v in values]
        keys = a * len(doc) + b
        o = np.argsort(keys)
        place = np.minimum(np.searchsorted(keys[o], b * len(doc) + a), max(len(keys) - 1, 0))
        is_back = keys[o][place] == b * len(doc) + a
        back = pa.array(rank[o][place].astype(np.int32), mask=~is_back)
        yield from told(col, tid, a, b, values, [pa.array(rank.astype(np.int32)), back])

    def told(col, tid, a, b, values, ranks) -> Iterator[pa.RecordBatch]:
        which, extra = None, []
        if after is not None:
            place = np.empty(len(tid), dtype=np.int64)
            place[pc.sort_indices(col(keep[0])).to_numpy()] = np.arange(len(tid))
            which, extra = after(a, tid[a], tid[b], dict(zip(names, values, strict=True)) | {"candidate": place[b]})
        if which is not None:
            a, b, values, ranks = a[which], b[which], [v[which] for v in values], [r.take(pa.array(which)) for r in ranks]
        for k in range(0, len(a), BLOCK):
            s = slice(k, k + BLOCK)
            ia, ib = pa.array(a[s]), pa.array(b[s])
            out = [col("document_id").take(ia), *[col(c).take(ia) for c in keep], *[col(c).take(ib) for c in keep]]
            out += [pa.array((tid[x[s]] + 1).astype(np.int32)) for x in (a, b)] + [pa.array(v[s]) for v in values]
            out += [r.slice(k, BLOCK) for r in ranks] + [pa.array(v[s]) for v in extra]
            yield pa.RecordBatch.from_arrays(out, names=labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            yield from made(table)

    return rows.mapInArrow(run, ", ".join(fields))


def measured(pairs: DataFrame, measures: Callable, names: tuple[str, ...]) -> DataFrame:
    """pairs() of paired() with names, the arrays that measures(ta, tb) gives (texts from 0): what is asked of the best alone."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema] + [f"`{n}` double" for n in names]
    labels = [*pairs.columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ta, tb = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) - 1 for c in ("ta", "tb"))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, measures(ta, tb))], names=labels)

    return pairs.mapInArrow(run, ", ".join(fields))


def ranked(rows: DataFrame, by: str) -> DataFrame:
    """rows with rank, from 1 in the order of score (to nine places, the largest first, none is null) and candidate_id, of those of one value of by.
    These must follow each other in one partition, as paired() leaves the pairs of its first row."""
    rows = rows.select(by, "candidate_id", "score", *[c for c in rows.columns if c not in (by, "candidate_id", "score")])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    labels = [*rows.columns, "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            table = table.combine_chunks()
            key, name = (table.column(i).combine_chunks() for i in (0, 1))
            first = np.concatenate(([0], np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1))
            size = np.diff(np.append(first, len(key)))
            place = np.empty(len(key), dtype=np.int64)
            place[pc.sort_indices(name).to_numpy()] = np.arange(len(key))
            o = np.lexsort((place, -np.round(table.column(2).to_numpy(), 9), np.repeat(np.arange(len(first)), size)))
            rank = np.arange(len(key)) - np.repeat(first, size) + 1
            yield from table.take(pa.array(o)).append_column("rank", pa.array(rank.astype(np.int64))).rename_columns(labels).to_batches(BLOCK)

    return rows.mapInArrow(run, ", ".join([*fields, "rank long"]))
