"""Tables that several steps of a plan read."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame

#: Tasks that add arrays up before one does; the driver gets that one's sum.
ADDING = 32


def kept(rows: DataFrame) -> DataFrame:
    """rows computed once: written below spark.checkpoint.dir where that is set, which also cuts their lineage and lets
    Spark remove the files when nothing refers to them; else kept by the executors and computed again where one is lost."""
    spark = rows.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None):
        return rows.checkpoint()
    return rows.persist(StorageLevel.MEMORY_AND_DISK)


def spread(rows: DataFrame) -> DataFrame:
    """rows of a small table, such as one of a single file, dealt to all cores; a table of many files stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() * 2 <= cores else rows


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows by hash in as many partitions as a shuffle has, however small: for work that is long for few bytes."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def added(keys: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """The sums of rows of values with the same key, 0 to size - 1."""
    out = np.zeros((size, values.shape[1]))
    if len(keys):
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        out[ordered[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def parted(rows: DataFrame, by: str) -> DataFrame:
    """kept() rows of which one value of the column by is read at a time: such a read touches only what has that value."""
    spark = rows.sparkSession
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        path = os.path.join(folder, f"parted-{uuid.uuid4().hex}")
        rows.write.partitionBy(by).parquet(path)
        return spark.read.schema(rows.select(*[c for c in rows.columns if c != by], by).schema).parquet(path)
    return rows.sortWithinPartitions(by).persist(StorageLevel.MEMORY_AND_DISK)


def packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<f8").tobytes(), 1)


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """Element by element the sum of the packed() arrays of that size in parts (x: binary); the driver gets one array."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(zlib.decompress(x.as_py()), dtype="<f8")
        yield pa.record_batch([pa.array([packed(total)], pa.binary())], names=["x"])

    some = parts.select("x")
    if some.rdd.getNumPartitions() > 2 * ADDING:
        some = some.repartition(ADDING).mapInArrow(add, "x binary")
    got = some.coalesce(1).mapInArrow(add, "x binary").collect()
    return np.frombuffer(zlib.decompress(got[0]["x"]), dtype="<f8") if got else np.zeros(size)
