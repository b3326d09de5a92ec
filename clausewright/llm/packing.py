"""Packing documents into sequences: a configuration linear program over the length histogram.

Documents become token ids (a public vocabulary; the file's name is a parameter), then an end id. One longer than a
sequence is cut: full pieces last, a shorter one first. Only the histogram of piece lengths goes to the driver: at
most as many counts as a sequence has tokens. There the program

    minimise the number of sequences, so that the configurations used cover the pieces of each length

is solved by multiplicative weights: a dynamic program prices configurations (a knapsack over lengths under the
weights), the best ones are used, and the weights of the lengths they cover fall. The weights that come out, a solution
of the dual program, give the configurations, which are taken in whole numbers; best fit places what that leaves. Then
each piece finds its place from its rank among the pieces of its length, made in many tasks (common.salted_rank).

Defined results: null text is an empty document, which is the end id alone; repeated rows are documents of their own;
an empty table gives no row. Texts are tokenised whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SEQUENCE = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k"
_SPECIAL = b"<|endoftext|>"


@lru_cache(maxsize=2)
def _encoder(vocabulary: str):
    """The ranks of the vocabulary: the same ids as the tokenizer's file, several times faster."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


def token_ids(text: memoryview, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> np.ndarray:
    """Ids of a text in UTF-8, then end_id. A text that spells a special token goes to the tokenizer's own file."""
    if not len(text):
        return np.array([end_id], dtype="<u4")
    raw = bytes(text)
    if _SPECIAL in raw:
        ids = np.array(_tokenizer(vocabulary).encode(raw.decode(), add_special_tokens=False).ids, dtype="<u4")
    else:
        ids = _encoder(vocabulary).encode_to_numpy(raw.decode(), disallowed_special=())
    return np.append(ids, np.uint32(end_id)).astype("<u4", copy=False)


def pieces(docs: DataFrame, length: int = SEQUENCE, vocabulary: str = VOCABULARY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, last, parts in C.text_blocks(batch.column(1)):
                row, piece, start, size, crc, kept = [], [], [], [], [], []
                for i, part in zip(range(first, last), parts, strict=True):
                    all_ids = token_ids(part, vocabulary, end_id)
                    n = len(all_ids)
                    cuts = list(range(n % length if n % length else min(n, length), n + 1, length))
                    at = 0
                    for k, to in enumerate(cuts):
                        own = all_ids[at:to]
                        row.append(i), piece.append(k), start.append(at), size.append(to - at), crc.append(zlib.crc32(own))
                        if with_ids:
                            kept.append(own.astype(np.int32))
                        at = to
                cols = [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


# --- the configuration program ------------------------------------------------------------------------------------


def _price(lens: np.ndarray, worth: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Most worth that fits into each room from 0, and the index of an item of such a choice (-1: none). lens ascending."""
    best, item = np.zeros(room + 1), np.full(room + 1, -1, dtype=np.int64)
    upto = np.searchsorted(lens, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c], item[c] = best[c - 1], -2  # leave one place empty
        if k := upto[c]:
            value = best[c - lens[:k]] + worth[:k]
            j = int(value.argmax())
            if value[j] > best[c] + 1e-12:
                best[c], item[c] = value[j], j
    return best, item


def _trace(lens: np.ndarray, item: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0 and item[room] != -1:
        if item[room] == -2:
            room -= 1
        else:
            out.append(int(item[room]))
            room -= int(lens[item[room]])
    return out


def _configurations(lens: np.ndarray, worth: np.ndarray, room: int, slack: float) -> tuple[float, list[tuple[np.ndarray, np.ndarray]]]:
    """The most worth of a sequence, and for each length the best configuration with it (indexes of lens, how often),
    if it is worth nearly as much."""
    best, item = _price(lens, worth, room)
    value = worth + best[room - lens]
    good = np.flatnonzero(value >= (1 - slack) * value.max())
    found = {tuple(sorted([int(j), *_trace(lens, item, room - int(lens[j]))])) for j in good}
    return float(value.max()), [np.unique(c, return_counts=True) for c in sorted(found)]


def weights(lens: np.ndarray, need: np.ndarray, room: int, rounds: int = 200, slack: float = 0.02, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights of the lengths, at most 1 for any configuration, and the number of sequences that is needed at least.

    Multiplicative weights for the covering program: each round the configurations that are worth most are used, each
    as far as the pieces go round, and the weight of a length falls by what it was covered beyond its share (or rises).
    The mean of the weights, scaled to a feasible solution of the dual program, is what comes out."""
    worth = lens / room
    mean, least = np.zeros(len(lens)), 0.0
    for turn in range(rounds):
        top, configs = _configurations(lens, worth, room, slack)
        feasible = worth / top
        bound = float(need @ feasible)
        least, mean = max(least, bound), mean + feasible
        asked, use, used = np.zeros(len(lens)), np.zeros(len(lens)), 0.0
        for which, times in configs:
            asked[which] += times
        for which, times in configs:
            step = float((need[which] / asked[which]).min())
            use[which] += times * step
            used += step
        beyond = np.clip(use / need * (bound / used) - 1, -1, 3)
        worth = worth * np.exp(-rate / np.sqrt(turn + 1) * beyond)
        worth /= worth.max()
    mean /= rounds
    mean /= _price(lens, mean, room)[0][room]
    return np.maximum(mean, 1e-6 * lens / room), max(least, float(need @ mean))


def program(counts: np.ndarray, room: int, rounds: int = 600, slack: float = 0.0003, rate: float = 0.1, pace: float = 0.2) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Whole numbers of configurations (lengths, how often each is in it, number), in the order in which they were taken.

    The solution is rounded as it is made: configurations that are worth most under weights() are taken a whole number
    of times, and the weights go on falling for lengths that go faster than the others."""
    left = counts.copy()
    total, worth = np.maximum(counts, 1).astype(float), np.zeros(room + 1)
    lens = np.flatnonzero(left)
    if not len(lens):
        return []
    worth[lens], bound = weights(lens, left[lens].astype(float), room)
    out = []
    for _ in range(rounds):
        lens = np.flatnonzero(left)
        if not len(lens):
            break
        configs = _configurations(lens, worth[lens], room, slack)[1]
        configs.sort(key=lambda c: -int(lens[c[0][-1]]))
        asked, before, taken = np.zeros(len(lens)), left[lens], 0
        for which, times in configs:
            asked[which] += times
        for which, times in configs:
            sizes = lens[which]
            n = min(int((left[sizes] // times).min()), max(1, int(pace * (before[which] / asked[which]).min())))
            if n:
                out.append((sizes, times, n))
                left[sizes] -= n * times
                taken += n
        worth[lens] *= np.exp(-rate * ((before - left[lens]) / total[lens] - taken / max(bound, 1.0)))
    return out


#: Shares of the program's sequences that are tried; best fit places what is left.
SHARES = (1.0, 0.98, 0.95, 0.9, 0.8, 0.65, 0.5, 0.35, 0.2, 0.1, 0.05, 0.0)


def plan(counts: dict[int, int], room: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, longest first; number of such sequences), placing all of counts (length to number).

    The last configurations of the program use up what is left over, where best fit may need fewer sequences: of SHARES
    that which needs fewest in all is taken, the largest of equal ones. 0 is best fit alone, which is thus never better."""
    return planned(counts, room)[0]


def planned(counts: dict[int, int], room: int = SEQUENCE) -> tuple[list[tuple[tuple[int, ...], int]], float]:
    """plan(), and the share of its sequences, beside those of one full piece, that the program placed."""
    left = np.zeros(room + 1, dtype=np.int64)
    for size, n in counts.items():
        left[size] = n
    full = [((room,), int(left[room]))] if left[room] else []
    left[room] = 0
    solved = program(left, room)
    every = sum(n for *_, n in solved)
    best: tuple[int, float, list] | None = None
    for share in SHARES:
        rest, room_for, out = left.copy(), round(share * every), []
        for sizes, times, n in solved:
            n = min(n, room_for)
            if not n:
                break
            out.append((tuple(int(x) for x in np.repeat(sizes, times)[::-1]), n))
            rest[sizes] -= n * times
            room_for -= n
        placed = sum(n for _, n in out)
        while len(lens := np.flatnonzero(rest)):
            config = _best_fit(rest, int(lens[-1]), room)
            which, each = np.unique(config, return_counts=True)
            n = int((rest[which] // each).min())
            out.append((tuple(config), n))
            rest[which] -= each * n
        total = sum(n for _, n in out)
        if best is None or total < best[0]:
            best = total, placed / max(total, 1), out
    return full + best[2], best[1]


def _best_fit(left: np.ndarray, first: int, room: int) -> list[int]:
    """first and, of what is left, the items that fill its sequence best: one, two, or the largest and then again."""
    left = left.copy()
    config, space = [first], room - first
    left[first] -= 1
    while space > 0:
        sizes = np.flatnonzero(left[: space + 1])
        if not len(sizes):
            break
        one = int(sizes[-1])
        if one == space:
            config.append(one)
            break
        have = np.zeros(space + 1, dtype=bool)
        have[sizes] = True
        other = space - sizes  # what would fill it with each
        two = sizes[(other > 0) & have[other] & ((other != sizes) | (left[sizes] > 1))]
        if len(two):
            config += [int(two[-1]), space - int(two[-1])]
            break
        config.append(one)
        left[one] -= 1
        space -= one
    return sorted(config, reverse=True)


def place(cut_pieces: DataFrame, room: int = SEQUENCE) -> DataFrame:
    """cut_pieces (doc_id, piece, length, ...) with sequence_id and offset. It is read several times: give a table.

    Pieces of one length are dealt by a hash of id, number, start and ids, and ordered by these, so that only equal pieces
    are tied. Columns by
    the names of the two results are replaced."""
    counts = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots: dict[int, list[tuple[int, int, int, int]]] = {}  # by length: first rank, first sequence, pieces a sequence, offset
    taken: dict[int, int] = {}
    base = 0
    for config, n in plan(counts, room):
        at = 0
        for size in dict.fromkeys(config):
            each = config.count(size)
            slots.setdefault(size, []).append((taken.get(size, 0), base, each, at))
            taken[size] = taken.get(size, 0) + each * n
            at += each * size
        base += n
    tables = {size: np.array(x, dtype=np.int64) for size, x in slots.items()}
    sent = cut_pieces.sparkSession.sparkContext.broadcast(tables)
    names = [c for c in cut_pieces.columns if c not in ("sequence_id", "offset")]
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    known = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in names]
    rows = cut_pieces.select(whole, "length")
    ranked = C.salted_rank(rows, ["length"], [F.col(f"row.{c}") for c in known], F.xxhash64(*[F.col(f"row.{c}") for c in known]), "_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = sent.value
        for batch in batches:
            size, rank = (np.asarray(batch.column(i)) for i in (1, 2))
            seq, off = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
            for own in np.unique(size):
                i = np.flatnonzero(size == own)
                table = find[int(own)]
                row = table[np.searchsorted(table[:, 0], rank[i], side="right") - 1]
                k = rank[i] - row[:, 0]
                seq[i], off[i] = row[:, 1] + k // row[:, 2], row[:, 3] + k % row[:, 2] * own
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seq), pa.array(off)], names=["row", "sequence_id", "offset"])

    placed = ranked.select("row", "length", "_rank").mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, sequence_id long, offset long")
    return placed.select("row.*", "sequence_id", "offset")


def sequences(docs: DataFrame, placed: DataFrame, **options) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves. doc_id must be unique here."""
    full = pieces(docs, with_ids=True, **options).select("doc_id", "piece", "ids")
    both = full.join(placed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    return both.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def pack(docs: DataFrame) -> DataFrame:
    return place(C.cut(pieces(docs)))


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
