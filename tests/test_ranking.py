"""Clauses ranked for items where their document lies against joins of documents, items and clauses (c08, i08)."""

from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.functions import features as X
from clausewright.operators import evaluation as E
from clausewright.operators import ranking as K
from clausewright.operators import retrieval as S

TEXTS = ("The Buyer shall pay, pay within days.", "The Buyer shall pay, pay within days.", "Nothing else.", "", "The Séller may disclose any notices.", "Notices are sent to the seller by the buyer.", "x")


def test_items_ranked_by_document(spark):
    rows = spark.createDataFrame([(i // 7, i % 7 + 1, TEXTS[(i * i + i // 7) % 7]) for i in range(60)], "document_id long, id int, text string").withColumn("ord", F.col("id"))
    items = spark.createDataFrame([(1, "the buyer shall pay"), (2, "seller and notices"), (3, "zebra"), (4, None), (6, "Nothing else")], "query_id long, text string")
    asked = rows.select("document_id").distinct().crossJoin(items)
    every = S.rank_for_queries(asked, rows)
    told = lambda r: sorted((x.document_id, x.query_id, x.candidate_id, round(x.score, 9), x["rank"]) for x in r.collect())
    assert told(K.best_for_items(rows, K.sent_items(items), 3)) == told(every.where("rank <= 3"))

    met = rows.where((F.col("id") * 3 + F.col("document_id")) % 4 < 2).select("document_id", F.explode(F.array(*[F.lit(s) for s in range(4)])).alias("span"), F.col("id").alias("clause_id")).where((F.col("clause_id") + F.col("span")) % 3 == 0)
    gold = items.withColumn("span", F.col("query_id").cast("int") % 4)
    wanted = met.join(gold.select("query_id", "span"), "span").select("document_id", "query_id", "clause_id")
    clauses = rows.join(met.groupBy("document_id", F.col("clause_id").alias("id")).agg(F.collect_list("span").alias("meets")), ["document_id", "id"], "left")
    got = E.first_rank_report(K.first_ranks(clauses, K.sent_items(gold)), asked.count()).first()
    assert got == E.retrieval_report(every, wanted, asked.select("document_id", "query_id")).first() and 0 < got.evaluated < asked.count()


def test_many_items_are_left_to_joins(spark, monkeypatch):
    monkeypatch.setattr(K, "ITEMS", 1)
    assert K.sent_items(spark.createDataFrame([(1, "a b"), (2, "c")], "query_id long, text string")) is None


def test_fusion_where_pairs_are_made(spark):
    """Min-max scaling, fused scores and ranks as by windows over pairs that were joined with the clauses (c15)."""
    rows = spark.createDataFrame([(f"d{i // 7}", f"d{i // 7}_{6 - i % 7}", TEXTS[(i * i + i // 7) % 7]) for i in range(60)], "document_id string, id string, text string").withColumn("ord", F.col("id"))
    got = S.fused_numbered(rows, 4, lambda t: S.set_likeness(t, T.stem_tokens(F.col("text"))))
    found = S.top_k_numbered(rows, 4).select("query_id", "candidate_id", F.col("score").alias("sparse"))
    side = lambda q, c: rows.select(F.col("id").alias(q), T.stem_tokens(F.col("text")).alias(c))
    both = found.join(side("query_id", "a"), "query_id").join(side("candidate_id", "b"), "candidate_id").select("query_id", "candidate_id", "sparse", X.jaccard(F.col("a"), F.col("b")).alias("dense"))
    told = lambda r: sorted((x.query_id, x.candidate_id, x.alpha, round(x.fused, 9), x["rank"]) for x in r.collect())
    assert told(got) == told(S.fuse(both)) and len(got.columns) == 5
    assert S.fused_numbered(rows, 4, lambda t: None) is None
