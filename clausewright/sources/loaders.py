"""Sources and sinks: contract corpora in JSON, uploaded files, clause tables; reports as JSON and CSV."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

NLI_SCHEMA = (
    "documents ARRAY<STRUCT<id: BIGINT, file_name: STRING, text: STRING, document_type: STRING, url: STRING, spans: ARRAY<ARRAY<INT>>, "
    "annotation_sets: ARRAY<STRUCT<annotations: MAP<STRING, STRUCT<choice: STRING, spans: ARRAY<INT>>>>>>>, "
    "labels MAP<STRING, STRUCT<short_description: STRING, hypothesis: STRING>>"
)
QA_SCHEMA = "data ARRAY<STRUCT<title: STRING, paragraphs: ARRAY<STRUCT<context: STRING>>>>"
CLAUSE_SCHEMA = (
    "document_id STRING, clause_id STRING, text STRING, party STRING, modality STRING, condition STRING, proposition STRING, dataset STRING, "
    "source_label STRING, start_char INT, end_char INT, parent_clause_id STRING, context_text STRING"
)
TARGETS = {"NotMentioned": 0, "Entailment": 1, "Contradiction": 2}


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON document of many lines; its schema is given, not inferred, wherever it is known."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def found_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, bytes) below path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return rows.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def nli_documents(raw: DataFrame) -> DataFrame:
    return raw.select(F.explode("documents").alias("d")).select("d.*")


def qa_documents(raw: DataFrame) -> DataFrame:
    """Paragraphs as documents '{title}_paragraph_{i}', numbered from 1 before empty ones go."""
    rows = raw.select(F.explode("data").alias("a")).select("a.title", F.posexplode("a.paragraphs").alias("i", "p"))
    rows = rows.select(F.concat("title", F.lit("_paragraph_"), (F.col("i") + 1).cast("string")).alias("document_id"), F.col("p.context").alias("text"))
    return rows.where(T.absent(F.col("text")).isNotNull())


def label_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """document_id, label_id, choice, target, hypothesis, span_ids: a row for each document and annotated label.

    labels: label_id, hypothesis. Of several annotation sets the last one that has the label counts."""
    rows = documents.select(F.col("id").alias("document_id"), F.posexplode("annotation_sets").alias("set", "s"))
    rows = rows.select("document_id", "set", F.explode("s.annotations").alias("label_id", "v")).groupBy("document_id", "label_id").agg(F.max_by("v", "set").alias("v"))
    target = F.create_map(*[F.lit(x) for kv in TARGETS.items() for x in kv])
    rows = rows.select("document_id", "label_id", "v.choice", F.element_at(target, F.col("v.choice")).alias("target"), F.col("v.spans").alias("span_ids"))
    return rows.join(labels, "label_id", "left")


def hypotheses(raw: DataFrame) -> DataFrame:
    return raw.select(F.explode("labels").alias("label_id", "v")).select("label_id", "v.hypothesis")


def span_clauses(documents: DataFrame) -> DataFrame:
    """document_id, span_id, text: the annotated spans, stripped; numbered before empty ones go."""
    rows = documents.select(F.col("id").alias("document_id"), "text", F.posexplode("spans").alias("span_id", "s"))
    piece = T.strip(F.expr("substring(text, s[0] + 1, s[1] - s[0])"))
    return rows.select("document_id", "span_id", piece.alias("text"), F.col("s")[0].alias("start"), F.col("s")[1].alias("finish")).where("text <> ''")


def gold_spans(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, query_id, start, finish of label_rows() with spans; indexes out of bounds are dropped."""
    wanted = rows.where(F.size("span_ids") > 0).select("document_id", F.col("label_id").alias("query_id"), F.explode("span_ids").alias("i"))
    joined = wanted.join(documents.select(F.col("id").alias("document_id"), "spans"), "document_id")
    joined = joined.where("i >= 0 AND i < size(spans)").withColumn("s", F.expr("spans[i]"))
    return joined.select("document_id", "query_id", F.col("s")[0].alias("start"), F.col("s")[1].alias("finish"))


def pdf_texts(rows: DataFrame) -> DataFrame:
    """rows with text in place of content: the pages of PDF files, joined by newlines. Needs the optional pypdf.

    Pages that fail or are empty are left out; a file that does not open has null."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "content")
    names = [c for c in rows.columns if c != "content"]

    def read(data: bytes) -> str | None:
        import io

        from pypdf import PdfReader

        try:
            pages = list(PdfReader(io.BytesIO(data)).pages)
        except Exception:  # noqa: BLE001  a broken file costs only itself
            return None
        found = []
        for page in pages:
            try:
                found.append((page.extract_text() or "").strip())
            except Exception:  # noqa: BLE001  a broken page costs only itself
                continue
        return "\n".join(x for x in found if x).strip()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = pa.array([None if x is None else read(x) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*names, "text"])

    return rows.select(*names, "content").mapInArrow(run, f"{kinds}, text string")


def uploaded(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, text) of .txt and .pdf files below path; another extension is an error, a broken PDF has null."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = rows.select(T.document_id_of(F.regexp_replace(name, r"\.[^.]+$", "")).alias("document_id"), name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"), "content")
    text = F.when(F.col("ext") == "txt", T.strip(F.make_valid_utf8(F.col("content").cast("string")))).otherwise(F.raise_error(F.concat(F.lit("unsupported file type: "), F.col("name"))))
    plain = rows.where("ext <> 'pdf'").select("document_id", text.alias("text"))
    return plain.unionByName(pdf_texts(rows.where("ext = 'pdf'").select("document_id", "content")))


def validated(raw: DataFrame) -> DataFrame:
    """One row on a corpus file: the top-level keys, numbers of documents and labels (null where there are none), whether
    the first document is whole, and its length. A file that is not there is an error when it is read."""
    have = raw.columns
    documents = F.col("documents") if "documents" in have else F.lit(None).cast("array<struct<id:bigint,text:string,spans:array<array<int>>>>")
    labels = F.col("labels") if "labels" in have else F.lit(None).cast("map<string,string>")
    first = F.get(documents, F.lit(0))
    return raw.select(
        F.array(*[F.lit(c) for c in sorted(have)]).alias("keys"), F.when(documents.isNotNull(), F.size(documents)).alias("documents"), F.when(labels.isNotNull(), F.size(F.map_keys(labels))).alias("labels"),
        F.coalesce(first["id"].isNotNull() & first["text"].isNotNull() & first["spans"].isNotNull(), F.lit(False)).alias("first_is_whole"), F.length(first["text"]).alias("first_length"),
    )


def listed_hypotheses(raw: DataFrame) -> DataFrame:
    """(label_id, hypothesis) where labels are a list of (id, hypothesis)."""
    return raw.select(F.explode("labels").alias("v")).select(F.col("v.id").cast("string").alias("label_id"), "v.hypothesis")


def read_clauses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLAUSE_SCHEMA).parquet(path) if path.endswith(".parquet") else spark.read.schema(CLAUSE_SCHEMA).json(path)


def union_splits(*splits: DataFrame) -> DataFrame:
    out = splits[0]
    for s in splits[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_audit(rows: DataFrame, path: str) -> None:
    """CSV with the two columns that reviewers fill in."""
    rows.withColumn("human_relevance", F.lit("")).withColumn("review_notes", F.lit("")).write.mode("overwrite").option("header", True).csv(path)


def _json_lines(rows: DataFrame) -> DataFrame:
    """(value): each row as an element of an array, indented by two and with a comma behind, made in the tasks."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                told = json.dumps(dict(zip(names, row, strict=True)), indent=2, ensure_ascii=False, default=str)
                out.append("\n".join("  " + x for x in told.split("\n")) + ",")
            yield pa.record_batch([pa.array(out, pa.string())], names=["value"])

    return rows.mapInArrow(run, "value string")


def write_json_array(rows: DataFrame, path: str, most: int | None = None) -> None:
    """rows as one JSON file: an array, indented by two, fields that are null included; of at most so many rows, if given.

    The tasks write the elements as Spark commits them; then the files are joined, byte by byte, and only the whole file
    gets its name. Where a task fails, no file is left. Works on any file system that Spark writes to."""
    if most is not None and (n := rows.count()) > most:
        raise ValueError(f"{n} rows are too many for one file: use write_json")
    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    of = jvm.org.apache.hadoop.fs.Path
    mark = uuid.uuid4().hex
    parent = path.rstrip("/").rpartition("/")[0] or "."
    parts, whole, last = of(f"{parent}/.parts-{mark}"), of(f"{parent}/.whole-{mark}"), of(path)
    fs = last.getFileSystem(conf)
    try:
        _json_lines(rows).write.text(parts.toString())
        files = sorted((x for x in fs.listStatus(parts) if x.getPath().getName().startswith("part-") and x.getLen() > 0), key=lambda x: x.getPath().getName())
        out = fs.create(whole, True)
        try:
            out.write(bytearray(b"[\n" if files else b"["))
            for k, x in enumerate(files):
                source = fs.open(x.getPath())
                try:  # the last element has no comma
                    some = jvm.org.apache.commons.io.input.BoundedInputStream(source, x.getLen() - (2 if k == len(files) - 1 else 0))
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(some, out, 1 << 16, False)
                finally:
                    source.close()
            out.write(bytearray(b"\n]" if files else b"]"))
        finally:
            out.close()
        fs.delete(last, True)
        fs.rename(whole, last)
    finally:
        for x in (parts, whole):
            fs.delete(x, True)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_pickle(rows: DataFrame, path: str, most: int = 1_000_000) -> None:
    """A table of at most so many rows as one pickled pandas frame, for notebooks."""
    if (n := rows.count()) > most:
        raise ValueError(f"{n} rows are too many for one frame")
    rows.toPandas().to_pickle(path)


def read_pickle(spark: SparkSession, path: str) -> DataFrame:
    """A pickled frame of one's own; pickles of others can run code when they are read."""
    import pandas as pd

    return spark.createDataFrame(pd.read_pickle(path))


def qa_clauses(raw: DataFrame) -> DataFrame:
    """Full clause rows of a question-answering corpus."""
    from ..operators.clauses import preprocess

    return preprocess(qa_documents(raw), "cuad")
