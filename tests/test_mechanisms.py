"""Similarity across documents, interval joins, quantiles, strata and group features, against brute force; parts without a query."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.functions import features as X
from clausewright.operators import clauses as C
from clausewright.operators import evaluation as E
from clausewright.operators import inference as J
from clausewright.operators import reasoning as R
from clausewright.operators import retrieval as S
from clausewright.plans import contracts as P


def clause_texts(n, seed=2):
    rng = np.random.default_rng(seed)
    rare = [f"term{i}" for i in range(60)]
    return [(i, " ".join(["the", "party", *rng.choice(rare, 4), *(["shall"] * int(rng.integers(0, 2)))])) for i in range(n)] + [(n, ""), (n + 1, None), (n + 2, "term1 term2")]


@pytest.mark.parametrize("options", [{}, {"champions": 2}, {"hot": 5, "parts": 3}])
def test_top_k_across_documents_against_brute_force(spark, options):
    rows = spark.createDataFrame(clause_texts(150), "id int, text string")
    weights = S.tfidf(rows, max_features=None).persist()
    at = defaultdict(dict)
    for r in weights.collect():
        at[r.id][r.term] = r.weight
    want = []
    for q in at:
        scored = sorted((-round(s, 9), c) for c in at if c != q and (s := sum(w * at[c].get(t, 0) for t, w in at[q].items())) > 0)
        want += [(q, c, round(-s, 6), n + 1) for n, (s, c) in enumerate(scored[:4])]
    keys = rows.select("id", F.col("id").alias("ord"))
    got = [(r.query_id, r.candidate_id, round(r.score, 6), r.rank) for r in S.top_k_across(keys, weights, 4, **options).collect()]
    assert sorted(got) == sorted(want)
    # a pair for each common word would be all of them: both words that all rows have go unasked
    plain = weights.alias("a").join(weights.alias("b"), "term").where("a.id <> b.id").count()
    pairs = S.across_candidates(weights, 4, **options).count()
    assert pairs < (0.5 if options != {"champions": 2} else 0.9) * plain
    assert sorted((r.query_id, r.candidate_id, r.rank) for r in S.top_k_similar(keys, weights, 4, None).collect()) == sorted((q, c, n) for q, c, _, n in want)


def test_interval_join_against_brute_force(spark):
    rng = np.random.default_rng(4)
    clauses = [(int(d), f"c{i}", int(a), int(a + n)) for i, (d, a, n) in enumerate(zip(rng.integers(0, 3, 80), rng.integers(0, 3000, 80), rng.choice([0, 1, 40, 700], 80), strict=True))]
    gold = [(int(d), f"q{i % 7}", int(a), int(a + n)) for i, (d, a, n) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 3000, 60), rng.choice([0, 1, 30, 2900], 60), strict=True))]
    gold += [(0, "edge", 512, 1024), (1, "all", 0, 100_000), (2, None, 5, 6), (0, "none", None, 9)]
    want = {(d, q, c) for d, c, a, b in clauses for e, q, x, y in gold if d == e and x is not None and max(a, x) < min(b, y)}
    one = spark.createDataFrame(clauses, "document_id int, clause_id string, start_char int, end_char int")
    two = spark.createDataFrame(gold, "document_id int, query_id string, start int, finish int")
    for width in (64, 512, 10**6):
        got = [(r.document_id, r.query_id, r.clause_id) for r in E.relevant(one, two, width=width).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(5)
    groups = {"normal": rng.standard_normal(500), "ints": rng.integers(0, 5, 300).astype(float), "one": np.array([3.5]), "same": np.full(50, -2.0), None: np.exp(rng.standard_normal(400) * 8), "wide": np.array([-1.7e308, 0.0, 1.7e308, 1.0])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("normal", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r.g: [r[f"q{i}"] for i in range(5)] for r in E.quantiles(df, "x", ["g"], shares, bins=16).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        for q, x in zip(shares, got[k], strict=True):
            v = np.sort(v)
            at = (len(v) - 1) * q
            low, high = v[int(np.floor(at))], v[int(np.ceil(at))]
            assert x == pytest.approx(low + (high - low) * (at - np.floor(at)), rel=1e-12), (k, q)
    told = {r.g: r for r in E.described(df, "x", ["g"]).collect()}
    assert told["empty"]["count"] == 0 and told["empty"].q50 is None and told["same"].q25 == -2.0
    assert E.quantiles(df.where("false"), "x", ["g"], (0.5,)).count() == 0


def test_strata_against_a_sort(spark):
    rows = [(i, "a" if i % 3 else "b" if i % 2 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "key int, label string").withColumn("is_train", F.lit("clash"))
    mark = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    want = set()
    for label in ("a", "b", None):
        own = sorted((i for i, x in rows if x == label), key=mark)
        want |= set(own[: round(len(own) * 0.8)])
    got = J.stratified(df, "label", "key")
    assert got.columns == ["key", "label", "is_train"] and {r.key for r in got.where("is_train").collect()} == want and got.count() == 400


def test_group_features_on_null_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, None), ("b", None)], "g string, x double").withColumn("l", F.lit(1))
    got = {(r.g, r.x): (r.x_mean, r.x_max, r.x_min, r.x_count) for r in J.grouped_features(df, ["x"], ["g"]).collect()}
    assert got == {("a", 1.0): (2.0, 3.0, 1.0, 2), ("a", 3.0): (2.0, 3.0, 1.0, 2), (None, 5.0): (5.0, 5.0, 5.0, 1), (None, None): (5.0, 5.0, 5.0, 1), ("b", None): (None, None, None, 0)}


def test_evidence_scores(spark):
    row = spark.createDataFrame([(0.5, None, "x", 1.0)], "a double, b double, c string, d double")
    got = row.select(X.mean_evidence([F.col("a"), F.col("b"), F.col("d")]).alias("m"), X.mean_evidence([]).alias("none"), X.normed_evidence(*[F.lit(v) for v in (1.0, 0.5, 0.2, 0.1, 0.0)]).alias("n"), X.rerank_of(F.col("a"), F.col("d")).alias("r")).first()
    assert got.m == pytest.approx(0.5) and got.none == 0.0 and got.n == pytest.approx(0.4 + 0.125 + 0.03 + 0.01) and got.r == pytest.approx(0.7)


def test_first_documents(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("a", 3), ("c", 4)], "document_id string, x int")
    assert sorted(r.x for r in C.first_documents(rows, 2).collect()) == [1, 2, 3]


def test_report_by_file(spark):
    rows = spark.createDataFrame([("one.json", "obligation", "if x"), ("one.json", None, None), ("two.json", "obligation", None)], "file string, modality string, condition string")
    got = {(r.file, r.value): (r.n, r.with_condition) for r in C.report(rows, "modality", ["file"]).collect()}
    assert got == {("one.json", "obligation"): (1, 1), ("one.json", None): (1, 0), ("two.json", "obligation"): (1, 0)}


def test_uploads_keep_clauses_without_risk(spark):
    text = "The Supplier shall deliver the report within 5 days.\nThe Supplier shall not deliver the report within 9 days."
    docs = spark.createDataFrame([("two", text), ("one", "The Customer may terminate the agreement at any time.")], "document_id string, text string")
    got = {r.node_id: r for r in P.from_uploads(docs).collect()}
    assert len(got) == 3
    alone = next(r for k, r in got.items() if k.startswith("one"))
    assert (alone.risk, alone.level, alone.degree) == (0.0, "minimal", 0) and alone.text.startswith("The Customer")
    assert max(r.risk for k, r in got.items() if k.startswith("two")) > 0


def test_retrieval_score_as_similarity(spark):
    rows = spark.createDataFrame([("d", i, f"c{i}", t) for i, t in enumerate(["The Supplier shall pay the invoice.", "The Supplier shall not pay the invoice."])], "document_id string, rn int, clause_id string, text string")
    made = R.prepared(C.extract(rows))
    pairs = R.pairs_within(made).withColumn("retrieval_score", F.lit(0.125))
    got = R.analyzed(pairs, similarity=F.col("retrieval_score")).first()
    assert got.semantic_similarity == 0.125 and got.modality_conflict == 1
