"""Documents to clauses: segmentation, parent context, extraction, and the parser for uploaded contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def segment(docs: DataFrame, min_length: int = 10) -> DataFrame:
    """(document_id, rn, text, start_char, end_char) of docs (document_id, text).

    Offsets are those of the unstripped pieces in the cleaned text; pieces shorter than min_length once stripped go, and
    the others are numbered from 1. A text of any length is one row's array; offsets are sums within the document."""
    tiled = docs.select("document_id", F.posexplode(T.pieces(T.clean_text(F.col("text")))).alias("pos", "piece"))
    upto = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    tiled = tiled.withColumn("end_char", F.sum(F.length("piece")).over(upto)).withColumn("text", T.strip(F.col("piece")))
    kept = tiled.withColumn("start_char", F.col("end_char") - F.length("piece")).where(F.length("text") >= min_length)
    return kept.select("document_id", F.row_number().over(Window.partitionBy("document_id").orderBy("pos")).alias("rn"), "text", "start_char", "end_char")


def add_context(clauses: DataFrame) -> DataFrame:
    """clauses (document_id, rn, text) with clause_id, parent_clause_id and context_text.

    A list fragment belongs to the last clause before it that is none; a fragment without such a clause is one itself."""
    doc = Window.partitionBy("document_id").orderBy("rn")
    ids = clauses.withColumn("clause_id", F.format_string("%s_clause_%04d", F.col("document_id").cast("string"), F.col("rn")))
    parent = F.when(~T.is_fragment(F.col("text")) | (F.row_number().over(doc) == 1), F.struct(F.col("clause_id").alias("id"), F.col("text").alias("text")))
    ids = ids.withColumn("_own", parent)
    ids = ids.withColumn("_p", F.when(F.col("_own").isNull(), F.last("_own", ignorenulls=True).over(doc.rowsBetween(Window.unboundedPreceding, -1))))
    context = F.when(F.col("_p").isNull(), F.col("text")).otherwise(F.concat(F.regexp_replace(F.col("_p.text"), r"\s+$", ""), F.lit(" "), F.regexp_replace("text", r"^\s+", "")))
    return ids.withColumn("parent_clause_id", F.col("_p.id")).withColumn("context_text", context).drop("_own", "_p")


def extract(clauses: DataFrame) -> DataFrame:
    """clauses (text) with party, modality, condition and proposition."""
    x = F.col("text")
    return clauses.withColumns({"party": T.party(x), "modality": T.modality(x), "condition": T.condition(x), "proposition": T.proposition(x)})


def preprocess(docs: DataFrame, dataset: str | None = None) -> DataFrame:
    """Documents (id or document_id or title; text or context) to full clause rows. Null and empty count as missing."""
    have = lambda *names: F.coalesce(*[T.absent(F.col(n).cast("string")) for n in names if n in docs.columns], F.lit(None).cast("string"))
    rows = docs.select(F.coalesce(have("id", "document_id", "title"), F.lit("unknown_document")).alias("document_id"), have("text", "context").alias("text")).where("text IS NOT NULL")
    return extract(add_context(segment(rows))).withColumn("dataset", F.lit(dataset)).withColumn("source_label", F.lit(None).cast("string"))


def report(clauses: DataFrame, kind: str, by: list[str] | None = None) -> DataFrame:
    """Counts by a column, and by others such as a file's name; a null is a group."""
    return clauses.groupBy(*(by or []), F.col(kind).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.count("condition").alias("with_condition"))


def parse_uploaded(docs: DataFrame, min_length: int = 15) -> DataFrame:
    """(document_id, rn, text): blocks of lines of docs (document_id, text).

    A block ends at a blank line, a heading (dropped), a line that ends a sentence, and before an explicit clause start."""
    lines = docs.select("document_id", F.posexplode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n"), "\n")).alias("pos", "raw"))
    lines = lines.withColumn("line", T.normalize_line(F.col("raw")))
    out = (F.col("line") == "") | T.is_heading(F.col("line"))
    doc = Window.partitionBy("document_id").orderBy("pos")
    lines = lines.withColumn("out", out).withColumn("stops", F.col("out") | T.ends_sentence(F.col("line")))
    breaks = F.coalesce(F.lag("stops").over(doc), F.lit(True)) | T.starts_explicit_clause(F.col("line"))
    lines = lines.withColumn("block", F.sum(breaks.cast("int")).over(doc)).where(~F.col("out"))
    blocks = lines.groupBy("document_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("text"))
    blocks = blocks.withColumn("text", T.clean_text(F.col("text"))).where(F.length("text") >= min_length)
    return blocks.select("document_id", F.row_number().over(Window.partitionBy("document_id").orderBy("block")).alias("rn"), "text")


def first_documents(clauses: DataFrame, n: int) -> DataFrame:
    """The clauses of the first n documents in the order of their ids."""
    some = clauses.select("document_id").distinct().orderBy("document_id").limit(n)
    return clauses.join(some, "document_id", "left_semi")
