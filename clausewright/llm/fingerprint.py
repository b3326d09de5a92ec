"""Document fingerprints by locally consistent parsing.

A text in UTF-8 is a string of symbols. At each level runs of one symbol become one symbol; then deterministic coin
tossing gives each symbol a small label from the lowest bit in which its name differs from the name before it, and so
on for the labels, until few are left. Where labels have a local minimum a phrase begins. A phrase's name is a hash of
the names in it, and the names are the next level's symbols. Where a phrase begins depends on a few symbols around it
alone, so equal substrings get equal names but for a short margin, wherever they stand.

Levels go on until a text is one phrase. The fingerprint has the names of the phrases of all levels from DEPTH up, as a
set (a name's second occurrence in a level is an element of its own): the PICKED smallest of their hashes, in
hexadecimal. A text with fewer than LEAST phrases at that level begins at the highest one at which it has as many. The
likeness of two fingerprints estimates the Jaccard similarity of their sets (bottom-k sketches of one hash function).

A text is in memory whole, with about eighty bytes for each of its own while it is parsed. Defined results: null and empty text have the empty fingerprint ''; it is like another empty one with 1 and like others
with 0; equal texts have equal fingerprints. Documents follow one another by doc_id, nulls first, equal ids by text;
after the last comes the first; a single document is its own next one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

DEPTH = 2
LEAST = 4
PICKED = 64
#: Documents (rows) of a block of neighbours, about; there are at most BLOCKS, of more rows then.
NEIGHBOURS = 4096
BLOCKS = 50_000

_DEBRUIJN = np.uint64(0x03F79D71B4CB0A89)
_PLACE = np.zeros(64, dtype=np.uint8)
for _i in range(64):
    _PLACE[((0x03F79D71B4CB0A89 << _i) & 0xFFFFFFFFFFFFFFFF) >> 58] = _i
#: For labels below 256: the lowest set bit of each value.
_LOWEST = np.array([0] + [(x & -x).bit_length() - 1 for x in range(1, 256)], dtype=np.uint8)
_BYTE_NAMES = C.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SALT = np.uint64(0xA24BAED4963EE407)


def _toss(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6 of neighbouring distinct names. first: where a text begins; the label there counts from nothing."""
    differ = np.empty_like(names)
    differ[0] = names[0]
    np.bitwise_xor(names[1:], names[:-1], out=differ[1:])
    differ[first] = names[first]
    low = differ & (np.uint64(0) - differ)
    k = _PLACE[(low * _DEBRUIJN) >> np.uint64(58)]
    bit = ((names >> k.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    label = k * 2 + bit  # below 128
    for _ in range(3):  # below 14, 8, 6
        differ8 = np.empty_like(label)
        differ8[0] = label[0]
        np.bitwise_xor(label[1:], label[:-1], out=differ8[1:])
        differ8[first] = label[first]
        k8 = _LOWEST[differ8]
        label = k8 * 2 + ((label >> k8) & 1)
    return label


def _runs(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one name as one symbol each; where the texts begin then."""
    new = np.empty(len(names), dtype=bool)
    new[0] = True
    np.not_equal(names[1:], names[:-1], out=new[1:])
    new[first] = True
    if new.all():
        return names, first
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(names))).astype(np.uint64)
    out = names[at]
    long = np.flatnonzero(length > 1)
    out[long] = C.mix64(out[long] ^ (length[long] * _SALT))
    return out, np.searchsorted(at, first)


def _phrases(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases, and where the texts begin among them."""
    names, first = _runs(names, first)
    label = _toss(names, first)
    begin = np.zeros(len(names), dtype=bool)
    if len(names) > 2:
        begin[1:-1] = (label[1:-1] < label[:-2]) & (label[1:-1] <= label[2:])
    # a text's first symbol has a label from no neighbour, its last one none to compare with: nothing begins by them
    begin[np.minimum(first + 1, len(names) - 1)] = False
    begin[np.append(first[1:], len(names)) - 1] = False
    begin[first] = True
    at = np.flatnonzero(begin)
    place = np.arange(len(names), dtype=np.uint64) - np.repeat(at.astype(np.uint64), np.diff(np.append(at, len(names))))
    spread = (names ^ (place * _SALT)) * (place * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
    return C.mix64(np.add.reduceat(spread, at)), np.searchsorted(at, first)


def sets(parts: list[bytes | memoryview], depth: int = DEPTH, least: int = LEAST, picked: int = PICKED) -> list[np.ndarray]:
    """For each text the ascending fingerprint values."""
    out = [np.zeros(0, dtype=np.uint64)] * len(parts)
    whole = [i for i, p in enumerate(parts) if len(p)]
    if not whole:
        return out
    lengths = np.array([len(parts[i]) for i in whole])
    raw = np.frombuffer(b"".join(parts[i] for i in whole), dtype=np.uint8)
    names, first = _BYTE_NAMES[raw], np.concatenate(([0], np.cumsum(lengths)[:-1]))
    count = len(whole)
    base = np.full(count, -1)  # the level from which on a text's phrases are taken
    levels = [(names, first)]
    while len(levels) <= depth or len(names) > count:
        names, first = _phrases(names, first)
        levels.append((names, first))
    sizes = np.array([np.diff(np.append(first, len(names))) for names, first in levels])
    for x in range(depth + 1):
        base[sizes[x] >= least] = x
    base[base < 0] = 0
    texts, values = [], []
    for x, (names, _) in enumerate(levels):
        text = np.repeat(np.arange(count), sizes[x])
        # a level repeats the one below where a text has become one phrase: that is its top
        use = (base <= x) & ((sizes[x - 1] > 1) | (base == x) if x else base == 0)
        text, own = text[use[text]], names[use[text]]
        order = np.lexsort((own, text))
        text, own = text[order], own[order]
        new = np.ones(len(own), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        again = np.arange(len(own)) - np.repeat(at, np.diff(np.append(at, len(own))))  # a second occurrence is another element
        texts.append(text)
        values.append(C.mix64(own ^ _SALT ^ (again.astype(np.uint64) << np.uint64(32)) ^ np.uint64(x)))
    text, value = np.concatenate(texts), np.concatenate(values)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    at = np.searchsorted(text, np.arange(count + 1))
    for k, i in enumerate(whole):
        out[i] = value[at[k] : min(at[k + 1], at[k] + picked)]
    return out


def text_form(values: np.ndarray) -> str:
    return values.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, picked: int = PICKED) -> float:
    """Estimated Jaccard similarity: the share of the smallest values of both that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)
    if len(a) >= picked or len(b) >= picked:  # a full sketch says nothing of what is above its largest value
        both = both[: min(picked, len(both))]
    return float(np.isin(both, a, assume_unique=True).astype(int) @ np.isin(both, b, assume_unique=True)) / len(both)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [text_form(x) for _, _, parts in C.text_blocks(batch.column(1)) for x in sets(parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def with_neighbours(docs: DataFrame, rows: int = NEIGHBOURS) -> DataFrame:
    """docs (doc_id, text) in blocks of about that many neighbours by doc_id: block, guard, doc_id, text.

    A block ends with a guard row, the first document of the next block (the last block's is the first of all). Bounds
    come from quantiles of the ids; only they, one for each block, go to the driver."""
    n = docs.count()
    blocks = max(1, min(-(-n // rows), BLOCKS))
    bounds = sorted(set(docs.select(F.percentile_approx("doc_id", [k / blocks for k in range(1, blocks)], 1_000_000)).first()[0] or [])) if blocks > 1 else []
    # a block has the ids above the bound before it and not above its own
    block = F.when(F.col("doc_id").isNull(), 0).otherwise(_below(bounds, F.col("doc_id")))
    marked = docs.select(block.cast("int").alias("block"), "doc_id", "text")
    firsts = marked.groupBy("block").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id")).alias("m")).orderBy("block").collect()
    if not firsts:
        return marked.select("block", F.lit(False).alias("guard"), "doc_id", "text")
    names = [(r["m"]["doc_id"], firsts[k - 1]["block"]) for k, r in enumerate(firsts)]
    small = docs.sparkSession.createDataFrame(names, "first_id long, to_block int")
    guards = docs.alias("d").join(F.broadcast(small), F.col("doc_id").eqNullSafe(F.col("first_id"))).select(F.col("to_block").alias("block"), F.lit(True).alias("guard"), "doc_id", "text")
    return marked.select("block", F.lit(False).alias("guard"), "doc_id", "text").unionByName(guards)


def _below(bounds: list[int], value: Column) -> Column:
    """How many of the ascending bounds are below value, found by bisection."""
    if not bounds:
        return F.lit(0)
    cuts = F.from_json(F.lit(json.dumps([int(b) for b in bounds])), "array<bigint>")  # one literal once it is folded
    ends = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        halved = F.when(F.get(cuts, mid) < value, ends(mid + 1, s["hi"])).otherwise(ends(s["lo"], mid))
        return F.when(s["lo"] < s["hi"], halved).otherwise(s)

    rounds = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.aggregate(rounds, ends(F.lit(0), F.lit(len(bounds))), step)["lo"]


def _prefix(text: bytes | memoryview, chars: int) -> bytes:
    """The first so many code points."""
    raw = bytes(text[: 4 * chars])
    starts = np.flatnonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)
    return raw if len(starts) <= chars else raw[: starts[chars]]


def _chars(text: bytes | memoryview) -> int:
    return int(((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80).sum()) if len(text) else 0


def compared(docs: DataFrame, rows: int = NEIGHBOURS) -> DataFrame:
    """For each document its fingerprint, that of its edited text, and how near they and the next document's are.

    The edited text has its last quarter of code points replaced by the first as many of the next document."""
    ordered = with_neighbours(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows)
    dealt = ordered.repartition("block").sortWithinPartitions("block", "guard", F.col("doc_id").asc_nulls_first(), "text")
    out_schema = C.fields("doc_id:l,n_chars:l,edited_sha256:s,fingerprint:s,edited_fingerprint:s,near_edited:d,near_next:d")

    def finish(rows_: list[tuple], nxt: tuple) -> pa.RecordBatch:
        """rows_: (id, text, values) in order; nxt follows the last of them."""
        edited, chars = [], []
        for k, (_, text, _v) in enumerate(rows_):
            n = _chars(text)
            other = (rows_[k + 1] if k + 1 < len(rows_) else nxt)[1]
            edited.append(_prefix(text, n - n // 4) + _prefix(other, n // 4) if n // 4 else bytes(text))
            chars.append(n)
        values: list[np.ndarray] = []
        at = 0
        while at < len(edited):
            to, total = at, 0
            while to < len(edited) and (to == at or total + len(edited[to]) <= C.BLOCK_BYTES):
                total += len(edited[to])
                to += 1
            values += sets(edited[at:to])
            at = to
        cols = list(zip(*[
            (i, n, hashlib.sha256(e).hexdigest(), text_form(own), text_form(v), likeness(own, v), likeness(own, (rows_[k + 1] if k + 1 < len(rows_) else nxt)[2]))
            for k, ((i, _t, own), n, e, v) in enumerate(zip(rows_, chars, edited, values, strict=True))
        ], strict=True))
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, out_schema, strict=True)], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        block, closed = None, True
        for batch in batches:
            blocks, guard, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for first, last, parts in C.text_blocks(batch.column(3)):
                values = sets(parts)
                for k, i in enumerate(range(first, last)):
                    row = (ids[i], bytes(parts[k]), values[k])
                    if blocks[i] != block:
                        block, closed = blocks[i], False
                        waiting = []
                    if guard[i]:
                        if not closed and waiting:
                            yield finish(waiting, row)
                        waiting, closed = [], True
                    elif not closed:
                        waiting.append(row)
                if len(waiting) > 1:  # the last one waits for its next
                    yield finish(waiting[:-1], waiting[-1])
                    waiting = waiting[-1:]

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compared(spark.read.parquet(f"{sf_dir}/documents.parquet"))
