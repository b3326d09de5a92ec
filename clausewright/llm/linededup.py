"""Lines that many documents repeat, by levelled sorted runs of line hashes.

The store is a set of runs: tables of (key, documents, keeper), one row a key, cut into buckets by key and sorted within
them. Key is a 128-bit hash of a line, documents how many of the run's documents have it, keeper the largest of their
ids. Documents come in batches. A batch's keys are merge-anti-joined with the runs: a key that a run has settled, held
by enough documents and kept by an id that the batch can't exceed, adds nothing. The others are added as a run of their
own on level 0. Whenever a level has `fanout` runs they are merged into one on the next, and their tables are dropped.
Runs share their buckets, so that neither the anti-join nor a merge shuffles them. At the end all runs are merged once more.

When batches come in descending order of ids, as in `repeated`, a settled key stays settled, and a line that a third
of the corpus has adds a row to few runs. Counts are combined before they are shuffled. The keys found are joined with
the documents' lines, where Spark splits keys with many lines, and gathered by document, which bounds a group by the
lines of one text.

Defined results: a null or empty text is one empty line; rows with one id and rows without one are one document each,
the latter below all others in order; a line that one document repeats counts once for it; no short line is ever a key;
equal largest ids can't be, as a keeper is a document; texts of any length are read whole, a line of any length is a
key of its own; an empty table gives no row; further columns are not read. A document's rows must be in one batch.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Code points that a line's key has at least, and documents that have it.
CHARS = 40
DOCUMENTS = 5
BATCHES = 4
FANOUT = 2

_BLANK = b" \t\n\x0b\x0c\r"
_INSIDE = bytes(range(0x80, 0xC0))  # bytes that go on with a character


def line_key(line: bytes, chars: int = CHARS) -> bytes | None:
    """The hash of a line, stripped and with A-Z lower-cased; None for one of fewer code points."""
    if len(line) < chars:
        return None
    text = line.strip(_BLANK).lower()  # of bytes, so of A-Z alone
    if len(text) < chars or len(text) < 4 * chars and len(text.translate(None, _INSIDE)) < chars:
        return None
    return xxhash.xxh3_128_digest(text)


def line_keys(docs: DataFrame, chars: int = CHARS) -> DataFrame:
    """(doc_id, digest, keys) of docs (doc_id, text): a 64-bit hash of the text and its distinct keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, parts in C.text_blocks(batch.column(2)):
                keys = [list({k for line in bytes(p).split(b"\n") if (k := line_key(line, chars)) is not None}) for p in parts]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], batch.column(1)[first:last], pa.array(keys, pa.list_(pa.binary()))], names=["doc_id", "digest", "keys"])

    return docs.select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(run, f"doc_id {kind}, digest long, keys array<binary>")


class LineRuns:
    """A store of runs; each is a table of the session's catalog, bucketed and sorted by key."""

    def __init__(self, spark: SparkSession, documents: int = DOCUMENTS, fanout: int = FANOUT):
        self.spark, self.documents, self.fanout = spark, documents, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.written = 0

    def _write(self, rows: DataFrame) -> str:
        name = f"{self.name}_{self.written}"
        self.written += 1
        rows.select("key", "documents", "keeper").repartition("key").write.bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name} PURGE")

    def _merged(self, names: list[str]) -> DataFrame:
        """One row a key of the runs, full-joined in order of key."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            a, b = out.alias("a"), self.spark.table(name).alias("b")
            total = (F.coalesce("a.documents", F.lit(0)) + F.coalesce("b.documents", F.lit(0))).alias("documents")
            out = a.join(b.hint("merge"), F.col("a.key") == F.col("b.key"), "full").select(F.coalesce("a.key", "b.key").alias("key"), total, F.greatest("a.keeper", "b.keeper").alias("keeper"))
        return out

    def add(self, lines: DataFrame) -> None:
        """Adds the batch lines (doc_id, key): what no run has settled becomes a run, and full levels are merged."""
        new = lines.groupBy("key").agg(F.count_distinct("doc_id").alias("documents"), F.max("doc_id").alias("keeper"))
        for name in [n for level in self.levels for n in level]:
            settled = self.spark.table(name).where(F.col("documents") >= self.documents).alias("r")
            new = new.alias("n").join(settled.hint("merge"), (F.col("n.key") == F.col("r.key")) & (F.col("n.keeper") <= F.col("r.keeper")), "left_anti")
        self._put(0, self._write(new))

    def _put(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        runs = self.levels[level] = [*self.levels[level], name]
        if len(runs) >= self.fanout:
            merged = self._write(self._merged(runs))
            self.levels[level] = []
            for n in runs:
                self._drop(n)
            self._put(level + 1, merged)

    def frequent(self) -> DataFrame:
        """(key, keeper) of the keys that enough of all documents have."""
        names = [n for level in self.levels for n in level]
        if not names:
            raise ValueError("no batch was added")
        return self._merged(names).where(F.col("documents") >= self.documents).select("key", "keeper")

    def close(self) -> None:
        for level in self.levels:
            for name in level:
                self._drop(name)
        self.levels = []


def batch_of(doc_id: Column, edges: list) -> Column:
    """The number of a document's batch: how many of the ascending edges are not below its id, from above."""
    return sum((F.coalesce(doc_id < F.lit(e), F.lit(True)).cast("int") for e in edges), F.lit(0))


def repeated(docs: DataFrame, documents: int = DOCUMENTS, chars: int = CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, digest, gone) of the documents (doc_id: long, text) that lose lines: the keys whose lines they lose.

    Ids are cut into batches by quantiles; that with the largest ids comes first."""
    spark = docs.sparkSession
    at = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 100)).first()[0] if batches > 1 else None
    edges = sorted(set(at or []))
    path = C.new_folder(spark, "line-keys")
    keyed = line_keys(docs, chars).where(F.size("keys") > 0)
    keyed.withColumn("batch", batch_of(F.col("doc_id"), edges)).write.partitionBy("batch").parquet(path)
    keyed = spark.read.schema(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest long, keys array<binary>, batch int").parquet(path)
    number = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))  # rows without id are a document below all others
    lines = keyed.select(number.alias("doc_id"), "digest", "batch", F.explode("keys").alias("key"))
    runs = LineRuns(spark, documents, fanout)
    try:
        for k in range(len(edges) + 1):
            runs.add(lines.where(F.col("batch") == k).select("doc_id", "key"))
        common = C.cut(runs.frequent())
    finally:
        runs.close()
    lost = lines.join(common, "key").where("doc_id <> keeper")
    return lost.groupBy("doc_id", "digest").agg(F.collect_set("key").alias("gone"))


def without_repeated(docs: DataFrame, keep: list[str] | None = None, chars: int = CHARS, **options) -> DataFrame:
    """The columns keep of docs (all without it), with n_lines, n_dropped and kept, the text without repeated lines.

    Columns of docs by the last three names are replaced."""
    added = ["n_lines", "n_dropped", "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    gone = repeated(docs.select("doc_id", "text"), chars=chars, **options)
    number = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    # names of our own, which no column of docs can clash with
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), number.alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    rows = rows.join(gone, ["doc_id", "digest"], "left").select("row", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, parts in C.text_blocks(batch.column(1)):
                n, dropped, kept = [], [], []
                for p, keys in zip(parts, batch.column(2)[first:last], strict=True):
                    lines, keys = bytes(p).split(b"\n"), set(keys.as_py() or ())
                    stay = [x for x in lines if line_key(x, chars) not in keys] if keys else lines
                    n.append(len(lines)), dropped.append(len(lines) - len(stay)), kept.append(b"\n".join(stay))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).view(pa.string())], names=["row", *added])

    made = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_lines long, n_dropped long, kept string")
    return made.select("row.*", *added)


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeated(docs, keep=["doc_id"]).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH lines AS (
  SELECT row, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS nth
  FROM (SELECT row_number() OVER () AS row, coalesce(doc_id, -9223372036854775808) AS doc_id, coalesce(text, '') AS t FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT nullif(any_value(doc_id), -9223372036854775808) AS doc_id, count(*) AS n_lines,
  count(*) FILTER (keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent USING (key) GROUP BY row
"""
