"""Texts that come again and again, such as standard clauses: what is made of a text alone is made once for each of them.

Where a table has few distinct texts for its rows, these are numbered and what is made of them is sent to all executors;
rows carry the number through shuffles in place of the text. Else everything is made row by row, with the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import dealt, kept

#: Distinct texts, and characters of all of them, up to which they are sent to all executors.
TEXTS = 50_000
CHARS = 20_000_000


def numbered(rows: DataFrame, most: int | None = None) -> DataFrame | None:
    """(text, tid, n) of the distinct texts of rows and how many rows have each, null among them; None if they are many."""
    most = TEXTS if most is None else most
    r = rows.agg(F.approx_count_distinct("text").alias("n"), F.max(F.length("text")).alias("longest")).first()
    if r["n"] * 1.1 > most or r["n"] * (r["longest"] or 0) > CHARS:
        return None
    texts = rows.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return kept(dealt(texts.withColumn("tid", F.row_number().over(Window.orderBy("text"))), "tid"))  # few, as counted


def coded(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows with the number of the text in its place."""
    table = texts.select(F.col("text").alias("_text"), "tid")
    return rows.join(F.broadcast(table), F.col("text").eqNullSafe(F.col("_text"))).drop("text", "_text")


def once(rows: DataFrame, make: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """make(rows), where make adds columns that depend on text alone."""
    texts = numbered(rows, most)
    if texts is None:
        return make(rows)
    made = make(texts.select("text"))
    made = made.select(F.col("text").alias("_text"), *[F.col(c) for c in made.columns if c != "text"])
    return rows.join(F.broadcast(made), F.col("text").eqNullSafe(F.col("_text"))).drop("_text")
