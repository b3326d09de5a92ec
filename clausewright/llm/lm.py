"""Language-model scoring with a log-bilinear neural model, trained in numpy by noise-contrastive estimation.

Tokens are the lower-cased words of a text and an end. Their counts cover all training documents. The model's units
are the most frequent words (GROWTH times the fourth root of the number of distinct words, so that they grow with the
corpus), the end, and one unit for each shape of the other words (how they end, length, letters beyond ASCII). A unit is
predicted from the two before it: context matrices map their embeddings to a vector whose product with a unit's
embedding, and a bias, is its score. Noise-contrastive estimation fits the embeddings (noise is the units' counts over
the whole corpus) in two passes: over one training document in FIRST, by hash of the id, and over all of them. In a pass
each task goes on from the same parameters over all of its documents, and the parameters are averaged by tokens. A
word behind a shape then has its share of the shape's counts, with half a count for each word and for all that is
unseen, so the model's probabilities of all texts sum to one.

Scores are normalised: with E1 and E2 the exponentials of the two contexts' scores, the normalisers of all pairs of
contexts are one matrix product. Counts of the HEAD most frequent words are sent to all executors; those of other
words are joined by a shuffle, with a row for each word of a document.

Defined results: null text is empty and has just the end; a null doc_id counts as empty text for the split; repeated
rows are scored each; without training documents every count is 0 and only the shapes' priors are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

HEAD = 262_144  # words whose counts every executor has
GROWTH = 48  # times the fourth root of the number of distinct words: the words that are units of the model
FIRST = 8  # the first pass is over one training document in so many
PASS_TOKENS = 1 << 20  # of a task in a pass, about and at least, where there are so many
SHAPES = 48
DIM = 32
HELD_TOKENS = 1 << 18  # tokens that are shuffled and trained on at a time in a partition


def _shapes(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The shape of each word, below SHAPES."""
    if not len(begin):
        return np.zeros(0, dtype=np.int64)
    last = buf[end - 1]
    letter = ((last >= 97) & (last <= 122)) | (last >= 128)
    tail = np.where(letter, 0, np.where(last == 46, 1, np.where(last == 44, 2, 3)))
    wide = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum(buf >= 128, out=wide[1:])
    n = end - begin
    size = np.searchsorted([4, 6, 8, 10, 13], n, side="right")
    return tail * 12 + (wide[end] > wide[begin]) * 6 + size


def _tokens(parts: list[memoryview]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and shapes of all words, and how many each text has."""
    buf, starts = C.joined(parts)
    buf = C.LOWER[buf]
    begin, end, count = C.word_bounds(buf, starts)
    return C.word_hashes(buf).view(np.int64), _shapes(buf, begin, end), count


def word_counts(docs: DataFrame, held_rows: int = 1 << 20) -> DataFrame:
    """(h, n, shape) of all words of docs (text)."""
    schema = C.fields("h:l,n:l,shape:i")

    def merged(some: list[tuple]) -> tuple:
        h, n, s = (np.concatenate(x) for x in zip(*some, strict=True))
        values, at, back = np.unique(h, return_index=True, return_inverse=True)
        return values, np.bincount(back, weights=n).astype(np.int64), s[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, rows = [], 0
        for batch in batches:
            for _, _, parts in C.text_blocks(batch.column(0)):
                h, shape, _ = _tokens(parts)
                values, at, n = np.unique(h, return_index=True, return_counts=True)
                some.append((values, n, shape[at]))
                rows += len(values)
                if rows >= held_rows:
                    some = [merged(some)]
                    rows = len(some[0][0])
                    if rows >= held_rows // 2:
                        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(some[0], schema, strict=True)], schema=schema)
                        some, rows = [], 0
        if some:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(merged(some), schema, strict=True)], schema=schema)

    return docs.select("text").mapInArrow(run, "h long, n long, shape int").groupBy("h").agg(F.sum("n").alias("n"), F.min("shape").alias("shape"))


@dataclass
class Head:
    """What every executor has of the counts."""

    h: np.ndarray  # ascending hashes of the frequent words
    n: np.ndarray
    unit: np.ndarray  # of each: below WORDS its own, else a shape's
    total: int  # N, with the ends
    distinct: int  # V, with the end
    ends: int
    shape_total: np.ndarray  # tokens and words of each shape behind its unit
    shape_distinct: np.ndarray
    words: int  # units that are words

    @property
    def end(self) -> int:
        return self.words + SHAPES

    @property
    def start(self) -> int:
        return self.words + SHAPES + 1

    @property
    def units(self) -> int:
        return self.words + SHAPES + 1

    def unit_counts(self) -> np.ndarray:
        own = np.zeros(self.units)
        mine = self.unit < self.words
        own[self.unit[mine]] = self.n[mine]
        own[self.words : self.words + SHAPES] = self.shape_total + 0.5
        own[self.end] = self.ends
        return own + 0.5


def head_of(counts: DataFrame, ends: int, head: int = HEAD, words: int | None = None) -> Head:
    """The most frequent words, head of them (of equally frequent ones those with smaller hashes), and the totals of all."""
    step = F.floor(F.log("n") * 16).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("step")).collect()
    floor, room = None, head
    for r in steps:
        floor = r["step"]
        if r["k"] >= room:
            break
        room -= r["k"]
    if floor is None:
        h, n, shape = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    else:
        rows = counts.where(step > F.lit(floor)).toPandas()
        rest = counts.where(step == F.lit(floor)).orderBy(F.desc("n"), "h").limit(room).toPandas()
        h, n, shape = (np.concatenate([rows[c].to_numpy(np.int64), rest[c].to_numpy(np.int64)]) for c in ("h", "n", "shape"))
        order = np.argsort(h)
        h, n, shape = h[order], n[order], shape[order]
    by = counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    total, distinct = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in by:
        total[r["shape"]], distinct[r["shape"]] = r["n"], r["v"]
    all_n, all_v = int(total.sum()), int(distinct.sum())
    order = np.lexsort((h, -n))[: words or int(GROWTH * all_v**0.25)]
    words = len(order)
    unit = words + shape
    unit[order] = np.arange(words)
    total -= np.bincount(shape[order], weights=n[order], minlength=SHAPES)
    distinct -= np.bincount(shape[order], minlength=SHAPES)
    return Head(h, n, unit, all_n + ends, all_v + (ends > 0), ends, total, distinct, words)


def _units(head: Head, h: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token its unit, its count, and whether the head has it."""
    if not len(head.h):
        return head.words + shape, np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(head.h, h), len(head.h) - 1)
    known = head.h[at] == h
    return np.where(known, head.unit[at], head.words + shape), np.where(known, head.n[at], 0), known


def _sequences(units: np.ndarray, count: np.ndarray, head: Head) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets (with the ends) and the two units before each; where the ends stand is where a text's run ends."""
    ends = np.cumsum(count + 1) - 1
    target = np.full(int(count.sum()) + len(count), head.end, dtype=np.int64)
    inside = np.ones(len(target), dtype=bool)
    inside[ends] = False
    target[inside] = units
    one, two = np.empty_like(target), np.empty_like(target)
    one[1:], two[2:] = target[:-1], target[:-2]
    firsts = ends - count
    one[firsts] = two[firsts] = head.start
    seconds = firsts + 1
    seconds = seconds[seconds <= ends]
    two[seconds] = head.start
    two[:1] = head.start
    return target, one, two


def _gather(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of index, and the sum of rows for each."""
    order = np.argsort(index, kind="stable")
    ordered = index[order]
    at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[at], np.add.reduceat(rows[order], at, axis=0)


def _start(unit_counts: np.ndarray, dim: int, rng: np.random.Generator) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Parameters before training, and AdaGrad's sums of squares."""
    n = len(unit_counts)
    m = {
        "inp": rng.normal(0, 0.1, (n + 1, dim)), "out": rng.normal(0, 0.1, (n, dim)), "bias": np.log(unit_counts / unit_counts.sum())[:, None].copy(),
        "one": np.eye(dim) + rng.normal(0, 0.02, (dim, dim)), "two": np.eye(dim) * 0.5 + rng.normal(0, 0.02, (dim, dim)),
    }
    m = {k: v.astype(np.float32) for k, v in m.items()}
    return m, {k: np.full_like(v, 1e-6) for k, v in m.items()}


def _epoch(m: dict[str, np.ndarray], square: dict[str, np.ndarray], tokens: np.ndarray, unit_counts: np.ndarray, rng: np.random.Generator, batch: int, noise: int, rate: float) -> None:
    """One pass over tokens (rows target, before, before that), which changes m and square."""
    n = len(unit_counts)
    p_noise = unit_counts / unit_counts.sum()
    log_kp = np.log(noise * p_noise).astype(np.float32)
    edges = np.cumsum(p_noise)
    # a unit's bias is one more number of its embedding, which a context multiplies by one
    out, out_square = np.hstack([m["out"], m["bias"]]), np.hstack([square["out"], square["bias"]])
    inp, one, two, rate = m["inp"], m["one"], m["two"], np.float32(rate)
    order = rng.permutation(tokens.shape[1])

    def climb(what: np.ndarray, squares: np.ndarray, g: np.ndarray, rows=slice(None)) -> None:
        squares[rows] += g * g
        what[rows] += rate * g / np.sqrt(squares[rows])

    for at in range(0, tokens.shape[1], batch):
        w, a, b = tokens[:, order[at : at + batch]]
        k = np.minimum(np.searchsorted(edges, rng.random(noise)), n - 1)
        qa, qb = inp[a], inp[b]
        r = np.ones((len(w), inp.shape[1] + 1), dtype=np.float32)
        np.add(qa @ one, qb @ two, out=r[:, :-1])
        pw, pk = out[w], out[k]
        scale = np.float32(1 / len(w))
        up = scale / (1 + np.exp(np.einsum("ij,ij->i", r, pw) - log_kp[w]))  # 1 - probability that it is data
        down = -scale / (1 + np.exp(log_kp[k] - r @ pk.T))
        dr = (up[:, None] * pw + down @ pk)[:, :-1]
        rows, g = _gather(np.concatenate([w, k]), np.concatenate([up[:, None] * r, down.T @ r]))
        climb(out, out_square, g, rows)
        rows, g = _gather(np.concatenate([a, b]), np.concatenate([dr @ one.T, dr @ two.T]))
        climb(one, square["one"], qa.T @ dr)
        climb(two, square["two"], qb.T @ dr)
        climb(inp, square["inp"], g, rows)
    m["out"], m["bias"], square["out"], square["bias"] = out[:, :-1].copy(), out[:, -1:].copy(), out_square[:, :-1].copy(), out_square[:, -1:].copy()


def train(docs: DataFrame, head: Head, dim: int = DIM, batch: int = 2048, noise: int = 128, rate: float = 0.08, seed: int = 7, first: int = FIRST) -> dict[str, np.ndarray]:
    """Noise-contrastive estimation with AdaGrad on docs (doc_id, text); a batch shares its noise."""
    unit_counts = head.unit_counts()
    m, square = _start(unit_counts, dim, np.random.default_rng(seed))
    some = docs.where(F.pmod(F.xxhash64(C.id_text(F.col("doc_id"))), F.lit(first)) == 0)
    for turn, (rows, tokens) in enumerate(((some, head.total // first), (docs, head.total))):
        m, square = _averaged(rows, max(1, tokens // PASS_TOKENS), head, m, square, batch, noise, rate, [seed, turn])
    return m


def _averaged(docs: DataFrame, parts: int, head: Head, m: dict[str, np.ndarray], square: dict[str, np.ndarray], batch: int, noise: int, rate: float, seed: list[int]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """m and square after each of at most that many parts of docs was trained on from them: the mean of theirs by tokens."""
    unit_counts = head.unit_counts()
    sent = docs.sparkSession.sparkContext.broadcast((head, m, square))
    row = lambda part, n, x: pa.record_batch([pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], names=["part", "n", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        head, m, square = sent.value
        m, square = ({k: v.copy() for k, v in x.items()} for x in (m, square))
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([*seed, part])
        some, held, n = [], 0, 0
        for got in batches:
            for _, _, parts in C.text_blocks(got.column(0)):
                h, shape, count = _tokens(parts)
                some.append(np.stack(_sequences(_units(head, h, shape)[0], count, head)).astype(np.int32))
                held += some[-1].shape[1]
                if held >= HELD_TOKENS:
                    _epoch(m, square, np.concatenate(some, axis=1), unit_counts, rng, batch, noise, rate)
                    some, held, n = [], 0, n + held
        if held:
            _epoch(m, square, np.concatenate(some, axis=1), unit_counts, rng, batch, noise, rate)
        if n + held:
            yield row(part, n + held, np.concatenate([v.ravel() for x in (m, square) for v in x.values()]))

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, total = 0, 0, 0.0
        for got in batches:
            for p, k, x in zip(*(c.to_pylist() for c in got.columns), strict=True):
                part, n, total = p, n + k, total + k * np.frombuffer(x, dtype=np.float32).astype(np.float64)
        if n:
            yield row(part, n, total / n)

    ddl = "part long, n long, x binary"
    some = docs.select("text").coalesce(parts).mapInArrow(run, ddl).repartition(C.ADDING, "part").mapInArrow(mean, ddl)
    got = some.repartition(1).mapInArrow(mean, ddl).collect()
    if not got:
        return m, square
    flat = np.frombuffer(got[0]["x"], dtype=np.float32)
    every = [(x, k, v) for x in (0, 1) for k, v in (m, square)[x].items()]
    out: tuple[dict, dict] = {}, {}
    for (x, k, v), own in zip(every, np.split(flat, np.cumsum([v.size for *_, v in every])[:-1]), strict=True):
        out[x][k] = own.reshape(v.shape).copy()
    return out


@dataclass
class Model:
    """Log scores of a unit after two others: (one[before] + two[before that]) . out + bias - z[before, before that]."""

    one: np.ndarray
    two: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @cached_property
    def z(self) -> np.ndarray:
        """The normalisers of all pairs of contexts. They are not sent: a worker makes them once for all of its tasks."""
        one, two = self.one @ self.out.T + self.bias, self.two @ self.out.T
        top1, top2 = one.max(1, keepdims=True), two.max(1, keepdims=True)
        return np.log(np.exp(one - top1) @ np.exp(two - top2).T) + top1 + top2.T

    def logs(self, target: np.ndarray, before: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Log10 probabilities of units after two others."""
        raw = np.einsum("ij,ij->i", self.one[before] + self.two[second], self.out[target]).astype(np.float64)
        return (raw + self.bias[target] - self.z[before, second]) / np.log(10)


def model_of(m: dict[str, np.ndarray]) -> Model:
    return Model(m["inp"] @ m["one"], m["inp"] @ m["two"], m["out"], m["bias"][:, 0])


def score(docs: DataFrame, counts: DataFrame, head: Head, model: Model) -> DataFrame:
    """docs (doc_id, held_out, text) with n_tokens, n_known, train_tokens, base_score and score."""
    sent = docs.sparkSession.sparkContext.broadcast((head, model))
    schema = C.fields("n_tokens:l,known:l,base:d,score:d,tail_h:L,tail_n:I")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        head, model = sent.value
        row = TaskContext.get().partitionId() << 40
        base_z = np.log10(head.total + 0.5 * (head.distinct + 1))
        shape_z = np.log10(head.shape_total + 0.5 * (head.shape_distinct + 1))
        for batch in batches:
            for first, last, parts in C.text_blocks(batch.column(2)):
                h, shape, count = _tokens(parts)
                unit, n, known = _units(head, h, shape)
                target, one, two = _sequences(unit, count, head)
                logs = model.logs(target, one, two)
                ends = np.cumsum(count + 1) - 1
                sums = np.concatenate(([0.0], np.cumsum(logs)))
                total = sums[ends + 1] - sums[ends - count]
                seen = np.log10(n + 0.5)
                # the log of the count of a word outside the head is added later
                behind = unit >= head.words
                inner = np.where(behind, np.where(known, seen, 0.0) - shape_z[np.where(behind, unit - head.words, 0)], 0.0)
                plain = np.where(known, seen, 0.0) - base_z
                to = np.cumsum(count)
                at = to - count
                add = lambda x: (c := np.concatenate(([0.0], np.cumsum(x))))[to] - c[at]
                total += add(inner)
                base = add(plain) + np.log10(head.ends + 0.5) - base_z
                k = add(known).astype(np.int64) + (head.ends > 0)
                tail_h, tail_n = [], []
                for a, b in zip(at, to, strict=True):
                    x, y = np.unique(h[a:b][~known[a:b]], return_counts=True)
                    tail_h.append(x), tail_n.append(y.astype(np.int32))
                cols = [pa.array(np.arange(row, row + last - first)), *(c.slice(first, last - first) for c in batch.columns[:2])]
                cols += [pa.array(x, f.type) for x, f in zip((count + 1, k, base, total, tail_h, tail_n), schema, strict=True)]
                row += last - first
                yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "held_out", *schema.names])

    ddl = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, tail_h array<long>, tail_n array<int>"
    scored = C.cut(docs.select("doc_id", "held_out", "text").mapInArrow(run, ddl))
    tail = scored.select("row", F.explode(F.arrays_zip("tail_h", "tail_n")).alias("t")).select("row", F.col("t.tail_h").alias("h"), F.col("t.tail_n").alias("tf"))
    half = F.lit(float(np.log10(0.5)))
    more = tail.join(counts.select("h", "n"), "h").groupBy("row").agg(F.sum(F.col("tf") * (F.log10(F.col("n") + 0.5) - half)).alias("more"), F.sum("tf").alias("known_more"))
    unseen = F.aggregate("tail_n", F.lit(0).cast("long"), lambda s, x: s + x) * half
    extra = unseen + F.coalesce("more", F.lit(0.0))
    return scored.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known_more", F.lit(0))).alias("n_known"), F.lit(head.total).cast("long").alias("train_tokens"),
        (F.col("base") + extra).alias("base_score"), (F.col("score") + extra).alias("score"),
    )


def scored(docs: DataFrame, training: DataFrame, head: int = HEAD, words: int | None = None, **options) -> DataFrame:
    """Scores docs (doc_id, held_out, text) with a model of training (doc_id, text)."""
    counts = C.cut(word_counts(training))
    top = head_of(counts, training.count(), head, words)
    return score(docs, counts, top, model_of(train(training, top, **options)))


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = C.crc_mod(F.col("doc_id"), 5) == 1
    return scored(docs.withColumn("held_out", held), docs.where(~held))
