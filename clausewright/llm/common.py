"""Shared pieces of the training-corpus operators: shared tables, Arrow text blocks, hashes, ranks."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a vectorised kernel takes at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 19

#: Tasks that add arrays up before one does; the driver gets that one's sum.
ADDING = 32
#: A key with more rows than this is dealt to several tasks in a join; so are MANY keys at most.
HOT = 500
MANY = 100_000
#: The marks of one_of() are 2 to the power of these bits.
MARKS = 24

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where that is unset, as in tests on a local master, a folder of this application in the warehouse, removed at exit."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        path = os.path.join(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"), f"shared-{app}")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own_dirs[app] = path
    return _own_dirs[app]


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, its lineage cut. Meant for narrow tables.

    The files go when nothing refers to the result any more (spark.cleaner.referenceTracking.cleanCheckpoints)."""
    spark = df.sparkSession
    path = shared_dir(spark)
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own below the shared one."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def id_text(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as empty text."""
    return F.crc32(id_text(doc_id)) % F.lit(m)


def row_key(rows: DataFrame) -> Column:
    """A key of a row by its content: 128 bits of a digest of all of its columns, nulls told apart from texts."""
    told = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(told.cast("binary"), 256), 1, 32)


# --- text blocks -----------------------------------------------------------------------------------------------


def as_string(column: pa.Array) -> pa.Array:
    return column if pa.types.is_string(column.type) else column.cast(pa.string())


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[memoryview]]]:
    """(first row, row after the last, UTF-8 of each) for blocks of about limit bytes; null is empty. Nothing is copied."""
    column = as_string(column)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    view = memoryview(data) if data is not None else memoryview(b"")
    nulls = np.asarray(column.is_null()) if column.null_count else None
    first = 0
    while first < n:
        last = int(np.searchsorted(offs, offs[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, [view[0:0] if nulls is not None and nulls[i] else view[offs[i] : offs[i + 1]] for i in range(first, last)]
        first = last


def joined(parts: list[memoryview], sep: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all parts, each followed by sep; where each part starts, and the end."""
    buf = np.frombuffer(sep.join([*parts, b""]), dtype=np.uint8)
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + len(sep) for p in parts], out=starts[1:])
    return buf, starts


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words [^\\x20\\x09-\\x0D]+ in joined() text: where each starts and ends, and how many each part has."""
    ink = ~SPACE[buf]
    edge = np.flatnonzero(ink[1:] != ink[:-1]) + 1
    if len(ink) and ink[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[0::2], edge[1::2]  # the last byte is white space, so that each word ends
    return begin, end, np.diff(np.searchsorted(begin, starts))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def word_hashes(buf: np.ndarray, both: bool = False) -> np.ndarray:
    """A 64-bit hash of each word of buf, in order; with both, two independent ones (n x 2). Equal for equal words.

    The words of a very long text are made a piece at a time."""
    at, out, digest = 0, [], xxhash.xxh3_128_digest if both else xxhash.xxh3_64_digest
    while at < len(buf):
        to = min(at + 2 * BLOCK_BYTES, len(buf))
        if to < len(buf):  # up to the last white space before, or the next one after
            space = np.flatnonzero(SPACE[buf[at:to]])
            if len(space):
                to = at + int(space[-1]) + 1
            else:
                space = np.flatnonzero(SPACE[buf[to:]])
                to = to + int(space[0]) + 1 if len(space) else len(buf)
        out.append(b"".join(map(digest, buf[at:to].tobytes().split())))
        at = to
    values = np.frombuffer(b"".join(out), dtype=">u8").astype(np.uint64)
    return values.reshape(-1, 2) if both else values


# --- sums of arrays ----------------------------------------------------------------------------------------------


def packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<i8").tobytes(), 1)


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """Element by element the sum of the packed() arrays in parts (x: binary), of that size; the driver gets one array."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(zlib.decompress(x.as_py()), dtype="<i8")
        yield pa.record_batch([pa.array([packed(total)], pa.binary())], names=["x"])

    got = parts.select("x").repartition(ADDING).mapInArrow(add, "x binary").repartition(1).mapInArrow(add, "x binary").collect()
    return np.frombuffer(zlib.decompress(got[0]["x"]), dtype="<i8") if got else np.zeros(size, dtype=np.int64)


# --- filters by many keys ----------------------------------------------------------------------------------------


def one_of(keys: DataFrame) -> Callable[[Column], Column]:
    """A test whether a column has one of keys (one column), true for all that are there and few others, to be told apart
    by a join afterwards. The keys are marked by hash in 2**MARKS bits, which are all that the driver gets and sends."""
    at = lambda key: F.pmod(F.xxhash64(key), F.lit(1 << MARKS))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << MARKS, dtype=bool)
        for batch in batches:
            seen[np.asarray(batch.column(0))] = True
        yield pa.record_batch([pa.array([zlib.compress(np.packbits(seen).tobytes(), 1)], pa.binary())], names=["x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << MARKS >> 3, dtype=np.uint8)
        for batch in batches:
            for x in batch.column(0):
                seen |= np.frombuffer(zlib.decompress(x.as_py()), dtype=np.uint8)
        yield pa.record_batch([pa.array([zlib.compress(seen.tobytes(), 1)], pa.binary())], names=["x"])

    got = keys.select(at(F.col(keys.columns[0])).alias("k")).coalesce(ADDING).mapInArrow(mark, "x binary").repartition(1).mapInArrow(add, "x binary").collect()
    seen = np.frombuffer(zlib.decompress(got[0]["x"]), dtype=np.uint8) if got else np.zeros(1 << MARKS >> 3, dtype=np.uint8)
    sent = keys.sparkSession.sparkContext.broadcast(seen)

    @F.pandas_udf("boolean")
    def held(k: pd.Series) -> pd.Series:
        k = k.to_numpy()
        return pd.Series((sent.value[k >> 3] >> (7 - (k & 7)).astype(np.uint8)) & 1 == 1)

    return lambda column: held(at(column))


# --- joins on skewed keys ----------------------------------------------------------------------------------------


def _hot_limit(hot: DataFrame, most: int | None = None) -> int | None:
    """The least bound, HOT or a step above, that most keys at most of hot (n above HOT) have more rows than; None without
    any key. A step is a quarter of a power of two; the driver gets a count for each."""
    most = MANY if most is None else most
    step = F.ceil(F.log2(F.col("n") / HOT) * 4).cast("int")  # n <= HOT * 2 ** (step / 4)
    steps = {r["step"]: r["keys"] for r in hot.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("keys")).collect()}
    if not steps:
        return None
    above, at = 0, max(steps)
    while at > 0 and above + steps.get(at, 0) <= most:
        above += steps.get(at, 0)
        at -= 1
    return int(HOT * 2 ** (at / 4) + 1e-6) if at > 0 else HOT


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """left joined with right on key, where few keys may hold most rows of left; it is read twice: give a table.

    Keys of more than HOT rows of left are dealt to parts of that size by a hash of the column spread; right's rows of
    such a key go to each part. Of more than MANY such keys, those with most rows are dealt, and into parts of as many
    rows as the others have at most. These keys, MANY at most, are broadcast; the driver gets only how many keys have
    how many rows, by steps. counts (key, n), if known, are the rows by key."""
    if counts is None and left.limit(HOT + 1).count() <= HOT:
        return left.join(right, key, how)
    if counts is None:
        counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = counts.where((F.col("n") > HOT) & F.col(key).isNotNull())
    limit = _hot_limit(hot)
    if limit is None:
        return left.join(right, key, how)
    table = cut(hot.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).alias("_parts")))
    none = F.lit(0).cast("long")
    one = left.join(F.broadcast(table), key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")), none)).drop("_parts")
    two = right.join(F.broadcast(table), key, "left").withColumn("_salt", F.explode(F.sequence(none, F.coalesce(F.col("_parts") - 1, none)))).drop("_parts")
    return one.join(two, [key, "_salt"], how).drop("_salt")


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of tables that nothing refers to any more, which it does when the driver's
    JVM collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# --- ranks of skewed groups ------------------------------------------------------------------------------------


def salted_rank(df: DataFrame, keys: list[str], order: list[Column], salt_from: Column, name: str, kept_counts: str | None = None) -> DataFrame:
    """df with the column name: a number from 0 for each row within keys, without a gap, in one task for no group.

    A group of n rows is dealt into about sqrt(n) parts by a hash of salt_from; rows are numbered within their part (by
    order), after the rows of the parts before. So the numbering follows (part, order). df is read twice: give a table."""
    counted = df.groupBy(*keys).agg(F.ceil(F.sqrt(F.count(F.lit(1)))).cast("long").alias("_parts"), F.count(F.lit(1)).alias("_group"))
    # null keys are groups too
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]

    def attach(left: DataFrame, right: DataFrame, more: list[Column], *cols: str) -> DataFrame:
        cond = on[0]
        for c in [*on[1:], *more]:
            cond = cond & c
        return left.alias("l").join(right.alias("r"), cond).select("l.*", *[f"r.{c}" for c in cols])

    dealt = attach(df, counted, [], "_parts", "_group").withColumn("_part", F.pmod(salt_from, F.col("_parts")))
    sizes = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1)
    out = attach(ranked, before, [F.col("l._part") == F.col("r._part")], "_before")
    out = out.withColumn(name, F.coalesce(F.col("_before"), F.lit(0)) + F.col("_nth"))
    if kept_counts:
        out = out.withColumn(kept_counts, F.col("_group"))
    return out.drop("_parts", "_part", "_nth", "_before", "_group")


def fields(names: str) -> pa.Schema:
    """An Arrow schema from 'name:type,...' with l(ong) i(nt) d(ouble) s(tring) b(oolean) y (bytes)."""
    kinds = {"l": pa.int64(), "i": pa.int32(), "d": pa.float64(), "s": pa.string(), "b": pa.bool_(), "y": pa.binary(), "L": pa.list_(pa.int64()), "I": pa.list_(pa.int32())}
    return pa.schema([pa.field(n, kinds[k]) for n, k in (x.split(":") for x in names.split(","))])
