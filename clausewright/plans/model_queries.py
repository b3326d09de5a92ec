"""Queries of the models that are learned from the tables: a text encoder and a pair classifier. They are not for SQL to say;
the tests hold their parts against numpy, finite differences and each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import encoder as N
from ..operators import inference as J
from ..operators import reasoning as R
from ..operators import retrieval as S
from ..operators import training as L
from ..operators.repeated import coded, numbered
from ..operators.tables import kept
from ..sources.synth import synth_clauses
from . import contracts as P

QUERIES: dict = {}
#: Pairs that are alike from here on, and not in conflict, are entailments to the rule that labels them.
ALIKE = 0.35


def query(name: str):
    def keep(f):
        QUERIES[name] = f
        return f

    return keep


@query("c12_encoder")
def c12(spark, d):
    """The encoded clauses: length of the vector, its largest part, and how near it is to its document's first clause."""
    rows = synth_clauses(spark, d).select(F.col("clause_id").alias("id"), "document_id", "rn", "text")
    model = N.fit(rows.select("id", "text"))
    texts = numbered(rows)
    if texts is None:
        made = kept(N.encoded(rows, model)).select("id", "document_id", "rn", "embedding")
        both = made.join(made.where("rn = 1").select("document_id", F.col("embedding").alias("first")), "document_id")
    else:  # vectors are looked up once the clauses are beside their document's first
        vectors = kept(N.encoded(texts.select("tid", "text"), model)).select("tid", "embedding")
        named = coded(rows, texts)
        both = named.join(named.where("rn = 1").select("document_id", F.col("tid").alias("_first")), "document_id").join(F.broadcast(vectors), "tid")
        both = both.join(F.broadcast(vectors.select(F.col("tid").alias("_first"), F.col("embedding").alias("first"))), "_first")
    return both.select(F.col("id").alias("clause_id"), S.dot(F.col("embedding"), F.col("embedding")).alias("norm"), F.array_max("embedding").alias("most"), S.dot(F.col("embedding"), F.col("first")).alias("nearness"))


@query("c15_encoder_fusion")
def c15(spark, d):
    """TF-IDF candidates ranked again by both scores: theirs and the encoder's."""
    rows = synth_clauses(spark, d)
    named = rows.select(F.col("clause_id").alias("id"), "document_id", F.col("clause_id").alias("ord"), "text")
    fused = S.fused_numbered(named, 10, lambda t: N.likeness(t, N.fit(named.select("id", "text"))))
    if fused is not None:
        return fused.select("query_id", "candidate_id", "alpha", F.round("fused", 6).alias("fused"), F.col("rank").cast("long").alias("rank"))
    found = P.candidate_pairs(rows, 10).select(F.col("clause_a").alias("query_id"), F.col("clause_b").alias("candidate_id"), F.col("retrieval_score").alias("sparse"))
    texts = rows.select(F.col("clause_id").alias("id"), "text")
    made = kept(N.encoded(texts, N.fit(texts)).select("id", "embedding"))
    both = found.join(made.select(F.col("id").alias("query_id"), F.col("embedding").alias("a")), "query_id").join(made.select(F.col("id").alias("candidate_id"), F.col("embedding").alias("b")), "candidate_id")
    scored = both.select("query_id", "candidate_id", "sparse", S.dot(F.col("a"), F.col("b")).alias("dense"))
    return S.fuse(scored).select("query_id", "candidate_id", "alpha", F.round("fused", 6).alias("fused"), F.col("rank").cast("long").alias("rank"))


def _labelled_pairs(clauses: DataFrame) -> DataFrame:
    """Retrieved pairs with hypothesis, evidence and the label that the rule gives them."""
    rows = R.rule_inference(P.analyzed_candidates(clauses, P.BATCH.top_k, alike=True))
    label = F.when(F.col("nli_label") == "Contradiction", 2).when(F.col("semantic_similarity") >= ALIKE, 0).otherwise(1)
    return rows.select("document_id", "clause_a", "clause_b", "hypothesis", "evidence", F.col("text_b").alias("clause_text"), label.alias("label"), F.concat_ws("|", "clause_a", "clause_b").alias("pair"))


def _trained(clauses: DataFrame) -> tuple[L.Classifier, DataFrame]:
    """A classifier of four fifths of the documents, and the pairs of the others."""
    rows = kept(_labelled_pairs(clauses))
    held = F.crc32(F.col("document_id").cast("binary")) % 5 == 1
    return L.fit(rows.where(~held), "pair", held_out=rows.where(held)), rows.where(held)


@query("j04_pair_training")
def j04(spark, d):
    """The losses of each epoch."""
    model, _ = _trained(synth_clauses(spark, d))
    return spark.createDataFrame([tuple(h.values()) for h in model.history], "epoch int, loss double, held_out_loss double, held_out_accuracy double, held_out_rows long")


@query("j01_pair_classifier")
def j01(spark, d):
    """The trained classifier's predictions for pairs of documents that it wasn't trained on."""
    model, rows = _trained(synth_clauses(spark, d))
    made = J.classify_pairs(rows, model.load, L.LABELS)
    return made.select("clause_a", "clause_b", "label", F.col("prediction.label_id").alias("predicted"), F.col("prediction.confidence").alias("confidence"), F.get("prediction.probabilities", F.lit(2)).alias("p_contradiction"))


@query("p03_trained_conflicts")
def p03(spark, d):
    """The batch dataflow with the trained classifier in place of the rule, over all clauses."""
    clauses = synth_clauses(spark, d)
    model, _ = _trained(clauses)

    def infer(rows: DataFrame) -> DataFrame:
        made = J.classify_pairs(rows.withColumn("clause_text", F.col("text_b")), model.load, L.LABELS)
        return made.withColumn("probabilities", F.col("prediction.probabilities")).withColumn("nli_label", F.col("prediction.label")).drop("prediction", "clause_text")

    out = P.conflicts(clauses, infer=infer)
    return out.select("clause_a", "clause_b", "p_contradiction", "hybrid_score", "conflict_type", "is_conflict")
