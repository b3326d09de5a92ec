"""What is made once for each distinct text against the same made row by row; bounds of scores that sums may miss by a hair."""

import numpy as np
from pyspark.sql import functions as F

from clausewright.functions import features as X
from clausewright.functions import text as T
from clausewright.operators import encoder as E
from clausewright.operators import reasoning as R
from clausewright.operators import repeated as N
from clausewright.operators import retrieval as S
from clausewright.plans import contracts as P

ROWS = "document_id string, rn int, clause_id string, text string"
TEXTS = ("The Buyer shall pay within 10 days if asked.", "The Buyer shall not pay.", None, "", "The Seller may disclose any notices, provided that it pays.")


def clauses(spark):
    return spark.createDataFrame([(f"d{i // 4}", i % 4 + 1, f"d{i // 4}_{i % 4}", TEXTS[i % 5]) for i in range(40)], ROWS)


def test_once_is_the_same_as_row_by_row(spark):
    rows, seen = clauses(spark), []

    def make(texts):
        seen.append(texts.count())
        return texts.withColumn("s", T.subject_action_object(F.col("text")))

    assert N.numbered(rows, most=2) is None
    one, each = (sorted(map(str, N.once(rows, make, most).select("clause_id", "text", "s").collect())) for most in (None, 2))
    assert one == each and seen == [5, 40]


def test_pairs_of_numbered_texts(spark):
    rows = clauses(spark)
    one, each = (sorted(map(str, R.draft_pairs(rows, most=most).drop("explanation_basis").collect())) for most in (None, 2))
    assert one == each and len(one) == 60


def test_bounds_of_sums(spark):
    """A score that is 0.3 but for the last bit reaches 0.3."""
    got = spark.range(1).select(F.lit(0.1 + 0.2 - 1e-16).alias("x"), F.lit(0.29999999999999993).alias("y")).select(X.draft_class(F.col("y"), F.lit(0.9), F.lit(1), F.lit(1)).alias("c")).first()
    assert got.c == "likely_conflict"
    n = lambda v: F.lit(float(v))
    later = X.later_scores(n(1), n(0), n(0), n(0), n(0.2999999999999999), n(0.2), n(0.2), n(0), n(0), n(0), n(0), n(0))
    assert spark.range(1).select(later["final_conflict_score_2"].alias("v"), later["candidate_conflict"].alias("c")).first().c is True


def test_retrieval_by_numbers(spark):
    rows = clauses(spark).select("document_id", F.col("clause_id").alias("id"), F.col("rn").alias("ord"), "text")
    asked = rows.where("ord <= 2").select("document_id", F.col("id").alias("query_id"), "text").unionByName(spark.createDataFrame([("d1", "new", "shall pay what nobody else says")], "document_id string, query_id string, text string"))
    told = lambda found: sorted((*r[:-2], round(r.score, 9), r["rank"]) for r in found.collect())
    one, each = (told(S.retrieve(asked, rows, 3, most=most)) for most in (None, 0))
    assert one == each and len(one) == 63
    pairs = [told(P.candidate_pairs(clauses(spark), 2, most).select("clause_a", "clause_b", F.col("retrieval_score").alias("score"), F.col("retrieval_rank").alias("rank"))) for most in (None, 0)]
    assert pairs[0] == pairs[1] and len(pairs[0]) == 80
    weights = [sorted((r.id, r.term, round(r.weight, 9)) for r in S.tfidf(rows.select("id", "text"), most=most).collect()) for most in (None, 0)]
    assert weights[0] == weights[1]


def test_encoder_of_repeated_texts(spark):
    rows = clauses(spark).select(F.col("clause_id").alias("id"), "text")
    one, each = (E.fit(rows, dims=2, most=most) for most in (None, 0))
    assert one.terms == each.terms and np.allclose(one.singular, each.singular)
    assert np.allclose(one.vectors, each.vectors, atol=1e-6)


def test_analyzed_pairs_by_numbers(spark):
    """The same pairs, features and temporal results as of clauses joined with all they are compared by (d26, f07, f14)."""
    more = [("d0", 9, "x", "The Buyer shall pay pay the fee within 2 months if asked, and may pay within 90 days."), ("d0", 10, "y", "The Buyer may not pay the fees within 1 month or 30 hours if asked, if asked.")]
    rows = clauses(spark).unionByName(spark.createDataFrame(more, ROWS))

    def told(most):
        out = R.hybrid(R.rule_inference(R.analyzed_within(rows, most=most)))
        names = sorted(set(out.columns) - {"semantic_similarity", "condition_similarity", "structured_score", "hybrid_score"})
        return sorted(map(str, out.select(*names, *[F.round(c, 9) for c in ("semantic_similarity", "condition_similarity", "structured_score", "hybrid_score")]).collect()))

    one, each = told(None), told(2)
    assert one == each and len(one) == 69 and any("temporal_deadline_conflict" in r for r in one)


def test_one_direction_of_a_pair(spark):
    """By the rank the other way the same rows stay as by bringing the pairs together (d19, d20)."""
    found = P.candidate_pairs(clauses(spark), 1)
    rows = found.select(F.col("clause_a").alias("query_id"), F.col("clause_b").alias("candidate_id"), F.col("retrieval_rank").alias("rank"), F.col("retrieval_back").alias("back"))
    ids = ["query_id", "candidate_id"]
    told = lambda r: sorted((x.query_id, x.candidate_id) for x in r.collect())
    assert rows.where("back IS NULL").count() and rows.where("back IS NOT NULL").count()
    assert told(R.first_of_pair(rows, ids, *ids)) == told(R.first_of_pair(rows.drop("back"), ids, *ids))
    assert told(R.better_ranked_of_pair(rows, *ids)) == told(R.better_ranked_of_pair(rows.drop("back"), *ids))
