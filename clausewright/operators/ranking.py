"""A document's clauses ranked for each of a few items, such as hypotheses that every document is asked: one shuffle by
document brings its clauses together, the items' terms are sent to all executors, and only the ranks asked for leave the
task. Documents times items times clauses never go through a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features as X
from .pairing import _grouped

#: Items, and characters of all of them, up to which their terms are sent to all executors; cells of their table.
ITEMS = 10_000
CHARS = 2_000_000
CELLS = 5_000_000


def _terms(x: Column) -> Column:
    """The hashes of the grams of a text, letters without their accents."""
    return F.transform(X.grams(x, accents=False), lambda g: F.xxhash64(g))


@dataclass(frozen=True)
class Items:
    ids: pa.Array
    groups: np.ndarray  # of each item the number of the span that is asked for
    terms: np.ndarray  # ascending
    table: np.ndarray  # terms by items: 1 + ln(tf), 0 where an item has no such term

    def scores(self, terms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Clauses by items: TF-IDF cosines; sizes[i] of the terms are the i-th clause's, which are the corpus."""
        n = len(sizes)
        vocabulary, term = np.unique(terms, return_inverse=True)
        if not len(vocabulary) or not len(self.terms):
            return np.zeros((n, len(self.ids)))
        cell, tf = np.unique(np.repeat(np.arange(n), sizes) * len(vocabulary) + term, return_counts=True)
        row, term = np.divmod(cell, len(vocabulary))
        idf = np.log((n + 1) / (np.bincount(term, minlength=len(vocabulary)) + 1)) + 1
        weight = (1 + np.log(tf)) * idf[term]
        norm = np.sqrt(np.bincount(row, weights=weight**2, minlength=n))
        place = np.minimum(np.searchsorted(self.terms, vocabulary), len(self.terms) - 1)
        known = self.terms[place] == vocabulary
        asked = self.table[place[known]] * idf[known, None]
        asked /= np.maximum(np.sqrt((asked**2).sum(axis=0)), 1e-300)
        have, column = known[term], np.cumsum(known) - 1
        made = np.zeros((n, int(known.sum())))
        made[row[have], column[term[have]]] = weight[have] / norm[row[have]]
        return made @ asked


def sent_items(items: DataFrame):
    """The Items of items (query_id, text[, span: int]), broadcast; None where they, or their terms, are many."""
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    if size["n"] > ITEMS or (size["chars"] or 0) > CHARS:
        return None
    span = F.col("span").cast("int") if "span" in items.columns else F.lit(0)
    got = items.select("query_id", span.alias("span"), _terms(F.col("text")).alias("terms")).orderBy("query_id").toArrow()
    listed = got.column("terms").combine_chunks()
    terms, place = np.unique(np.asarray(listed.flatten(), dtype=np.int64), return_inverse=True)
    if len(terms) * len(listed) > CELLS:
        return None
    table = np.zeros((len(terms), len(listed)))
    np.add.at(table, (place, np.repeat(np.arange(len(listed)), np.asarray(listed.value_lengths()))), 1.0)
    table = np.where(table > 0, 1 + np.log(np.maximum(table, 1)), 0.0)
    found = Items(got.column("query_id").combine_chunks(), np.asarray(got.column("span").fill_null(-1)), terms, table)
    return items.sparkSession.sparkContext.broadcast(found)


def _by_document(clauses: DataFrame, sent, more: list[str], schema: str, told: Callable) -> DataFrame:
    """told(items, columns, first, last, scores) of each document's clauses, in ord, as record batches of that schema."""
    rows = clauses.where("document_id IS NOT NULL").select("document_id", "id", "ord", "text", *more)
    rows = rows.repartition("document_id").sortWithinPartitions("document_id", "ord")  # terms are made after the shuffle
    rows = rows.select("document_id", "id", _terms(F.col("text")).alias("terms"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for table in _grouped(batches):
            col = {c: table.column(c).combine_chunks() for c in table.column_names}
            doc, sizes = col["document_id"], np.asarray(col["terms"].value_lengths())
            terms, at = np.asarray(col["terms"].flatten(), dtype=np.int64), np.concatenate(([0], np.cumsum(sizes)))
            first = np.concatenate(([0], np.flatnonzero(pc.not_equal(doc[1:], doc[:-1]).to_numpy(zero_copy_only=False)) + 1, [len(doc)]))
            for x, y in zip(first[:-1], first[1:], strict=True):
                yield told(items, col, x, y, items.scores(terms[at[x] : at[y]], sizes[x:y]))

    return rows.mapInArrow(run, schema)


def best_for_items(clauses: DataFrame, sent, k: int) -> DataFrame:
    """(document_id, query_id, candidate_id, score, rank): of each document's clauses (document_id, id, ord, text) the k best for
    each of sent_items(); of equal ones the first in ord."""
    kind = lambda c: clauses.schema[c].dataType.simpleString()
    names = ["document_id", "query_id", "candidate_id", "score", "rank"]

    def told(items: Items, col: dict, x: int, y: int, scores: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(-np.round(scores, 9), axis=0, kind="stable")[:k].T  # items by ranks
        many, n = order.shape
        item = np.repeat(np.arange(many), n)
        ids = [col["document_id"].take(pa.array(np.full(many * n, x))), items.ids.take(pa.array(item)), col["id"].take(pa.array(order.reshape(-1) + x))]
        return pa.RecordBatch.from_arrays([*ids, pa.array(scores[order.reshape(-1), item]), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), many))], names=names)

    asked = sent.value.ids.type
    return _by_document(clauses, sent, [], f"document_id {kind('document_id')}, query_id {'string' if pa.types.is_string(asked) else 'long'}, candidate_id {kind('id')}, score double, rank int", told)


def first_ranks(clauses: DataFrame, sent) -> DataFrame:
    """(document_id, query_id, first_rank): for each of sent_items() the best rank of a document's clauses (document_id, id, ord,
    text, meets: array<int>) that meet the item's span; no row where none does."""
    kind = clauses.schema["document_id"].dataType.simpleString()
    asked = sent.value.ids.type

    def told(items: Items, col: dict, x: int, y: int, scores: np.ndarray) -> pa.RecordBatch:
        meets = col["meets"].slice(x, y - x)
        row, span = np.repeat(np.arange(y - x), np.asarray(meets.value_lengths().fill_null(0))), np.asarray(meets.flatten())
        scores, item, rank = np.round(scores, 9), [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for s in np.unique(span):
            own, good = np.flatnonzero(items.groups == s), np.sort(row[span == s])
            mine = scores[:, own]
            best = good[mine[good].argmax(axis=0)]  # the first of the best
            score = mine[best, np.arange(len(own))]
            before = (mine == score) & (np.arange(y - x)[:, None] < best)
            item.append(own), rank.append(1 + (mine > score).sum(axis=0) + before.sum(axis=0))
        item, rank = np.concatenate(item), np.concatenate(rank)
        return pa.RecordBatch.from_arrays([col["document_id"].take(pa.array(np.full(len(item), x))), items.ids.take(pa.array(item)), pa.array(rank.astype(np.int64))], names=["document_id", "query_id", "first_rank"])

    return _by_document(clauses, sent, ["meets"], f"document_id {kind}, query_id {'string' if pa.types.is_string(asked) else 'long'}, first_rank long", told)
