"""Contracts as a stream: each file is cut into clauses as it comes; stateless, so append mode without a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def stream_pieces(docs: DataFrame, min_length: int = 10) -> DataFrame:
    """Pieces with their detectors of a stream (document_id, text); pos is the piece's place in its document."""
    rows = docs.select("document_id", F.posexplode(T.pieces(T.clean_text(F.col("text")))).alias("pos", "piece"))
    text = T.strip(F.col("piece"))
    rows = rows.select("document_id", "pos", text.alias("text")).where(F.length("text") >= min_length)
    x = F.col("text")
    return rows.withColumns({"modality": T.modality(x), "party": T.party(x), "condition": T.condition(x)})


def start(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, once: bool = True):
    docs = spark.readStream.schema(schema).parquet(source)
    writer = stream_pieces(docs).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
