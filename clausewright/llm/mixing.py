"""Mixing sources to target weights by systematic sampling. DataFrame and SQL functions only.

Within a source each document is expected target / size copies. Documents are laid end to end by that expectation
(a prefix sum), one random offset of the source is added, and a document is emitted once for every integer boundary it
crosses. Documents of like size stand together, so that the words taken come near the target, and a document gets the
expectation rounded down or up. The offset is one of OFFSETS equally spaced ones behind a random start: that whose words
come nearest to the target, since in a small source one large document can make much of the difference.

The prefix sum of a source runs in many tasks: its documents are dealt by class of size and a hash of the id, the
parts are counted, and each part starts after the counts before it (common.salted_rank).

Defined results: null text has size 0; a null source is a source, last in order; a source without words has target 0 and
nothing is taken; repeated rows are documents of their own; null ids are allowed. The same rows and seed give the same
copies, whatever their order and partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
OFFSETS = 32
#: Sources whose offsets are sent to all executors; more than these are joined by a shuffle.
SENT = 100_000


def word_count(text: Column) -> Column:
    """Number of words; a word with the white space after it is replaced by one character, then counted."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]++", "")
    return F.length(F.regexp_replace(trimmed, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", ".")).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) of rows (source, size).

    Sources in order get the weights in turn and share that multiple of all sizes; none goes above cap times its size,
    and what it can't take is shared by the others by weight. Sources in order of cap / weight fill up first, so the
    level at which the rest stands is that of the first source that doesn't."""
    by = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights)).cast("int") + 1)
    by = by.withColumn("weight", pick).withColumn("cap", F.col("source_size") * F.lit(cap))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    by = (
        by.withColumn("place", F.row_number().over(fill))
        .withColumn("before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(Window.partitionBy()) * F.lit(share) - F.col("before")) / F.col("rest"))
    )
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(Window.partitionBy())
    return by.withColumn("at", first.getField("level")).select("source", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("at") * F.col("weight"))).alias("target"))


def size_class(size: Column) -> Column:
    """Number of digits and the first two of them: sizes within a tenth of each other."""
    s = size.cast("string")
    return F.length(s) * 100 + F.rpad(s, 2, "0").substr(1, 2).cast("int")


def copies(sized: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """sized (doc_id, source, size, ...) with source_size, target and copies. It is read several times: give a table.

    Other columns go along, but for any by these three names, which are replaced."""
    own, made = ["doc_id", "source", "size"], ["source_size", "target", "copies"]
    others = [c for c in sized.columns if c not in own + made]
    # others in one column, so that no name of theirs meets one of ours
    sized = sized.select(*own, *([F.struct(*[F.col(f"`{c}`") for c in others]).alias("_others")] if others else []))
    sized = sized.withColumn("_class", size_class(F.col("size")))
    per = targets(sized, **options)
    classes = sized.groupBy("source", "_class").agg(F.count(F.lit(1)).alias("_n"))
    classes = classes.withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    facts = classes.alias("l").join(per.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source"))).select("l.source", "_class", "_ahead", "source_size", "target")
    salt = F.conv(F.substring(F.md5(C.id_text(F.col("doc_id"))), 1, 8), 16, 10).cast("long")
    ranked = C.salted_rank(sized, ["source", "_class"], [F.col("size"), F.col("doc_id").asc_nulls_first()], salt, "_rank")
    out = ranked.alias("l").join(facts.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source")) & (F.col("l._class") == F.col("r._class"))).select("l.*", "_ahead", "source_size", "target")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("")))), 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))
    offset = lambda k: (start + F.lit(float(k))) / F.lit(float(OFFSETS))
    crossed = lambda o: (F.floor((F.col("_at") + 1) * F.col("_each") + o) - F.floor(F.col("_at") * F.col("_each") + o)).cast("long")
    out = C.cut(out.withColumn("_at", F.col("_ahead") + F.col("_rank")).withColumn("_each", each).drop("_class", "_rank", "_ahead"))
    words = out.groupBy("source").agg(F.first("target").alias("t"), *[F.sum(crossed(offset(k)) * F.col("size")).alias(f"w{k}") for k in range(OFFSETS)])
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{k}") - F.col("t")).alias("off"), F.lit(k).alias("k"), offset(k).alias("o")) for k in range(OFFSETS)]))
    picked = C.cut(words.select("source", nearest["o"].alias("_offset")))
    if picked.count() <= SENT:
        picked = F.broadcast(picked)
    out = out.alias("l").join(picked.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source"))).select("l.*", "_offset")
    return out.select(*own, *[F.col(f"_others.`{c}`") for c in others], "source_size", "target", crossed(F.col("_offset")).alias("copies"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = C.cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return copies(sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it.

    A row's key is its content (C.row_key), so that it is the same when a lost task is run again. Rows that are equal in
    all columns share a key: their copies are added up and dealt to one of them."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), C.row_key(docs).alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"))
    sized = C.cut(keyed.select("_row", F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size")))
    keyed = keyed.select("row", "_row")
    drawn = C.cut(copies(sized, **options).groupBy("_row").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).where("_copies > 0"))
    out = keyed.join(drawn.where("_rows = 1"), "_row")
    several = C.cut(drawn.where("_rows > 1"))
    if not several.isEmpty():
        more = C.salted_join(keyed.withColumn("_nth", F.spark_partition_id()), several, "_row", "_nth", counts=several.select("_row", F.col("_rows").alias("n")))
        out = out.unionByName(more.dropDuplicates(["_row"]).select(*out.columns))
    return out.withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("row.*")


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), classed AS (
  SELECT *, length(size::VARCHAR) * 100 + substr(rpad(size::VARCHAR, 2, '0'), 1, 2)::INT AS cls,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS salt FROM sized
), per0 AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS weight
  FROM sized GROUP BY source
), per1 AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
    row_number() OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST) AS place FROM per0
), per2 AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM per1
), lev AS (
  SELECT arg_min(level, place) AS fill FROM per2 WHERE level * weight <= cap
), per AS (
  SELECT source, source_size, least(cap, coalesce(fill * weight, cap)) AS target FROM per2 LEFT JOIN lev ON true
), parted AS (
  SELECT *, salt % ceil(sqrt(count(*) OVER (PARTITION BY source, cls)))::BIGINT AS part FROM classed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY cls, part, size, doc_id NULLS FIRST) - 1 AS spot FROM parted
), joined AS (
  SELECT p.doc_id, p.source, p.size, p.spot, r.source_size, r.target,
    CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END AS each,
    ('0x' || substr(md5('mix-1:' || coalesce(p.source, '')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS start
  FROM placed p JOIN per r ON p.source IS NOT DISTINCT FROM r.source
), tried AS (
  SELECT source, (start + k::DOUBLE) / 32.0::DOUBLE AS shift, k, abs(sum((floor((spot + 1) * each + (start + k::DOUBLE) / 32.0::DOUBLE)
    - floor(spot * each + (start + k::DOUBLE) / 32.0::DOUBLE)) * size) - any_value(target)) AS off
  FROM joined, range(32) AS o(k) GROUP BY source, start, k
), picked AS (
  SELECT source, shift FROM tried QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, k) = 1
)
SELECT doc_id, size, source_size, target,
  ((floor((spot + 1) * each + shift) - floor(spot * each + shift)) * size)::BIGINT AS taken
FROM joined j JOIN picked p ON j.source IS NOT DISTINCT FROM p.source
"""
