"""Operators of the contract engine on small tables with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.operators import clauses as C
from clausewright.operators import evaluation as E
from clausewright.operators import graph as G
from clausewright.operators import inference as J
from clausewright.operators import reasoning as R
from clausewright.operators import retrieval as S


def test_structured_pairs(spark):
    rows = spark.createDataFrame(
        [("d", 1, "A", "The Supplier shall provide the report within 30 days."), ("d", 2, "B", "The Supplier shall not provide the report within 30 days.")], "document_id string, rn int, clause_id string, text string"
    )
    r = R.analyzed(R.pairs_within(R.prepared(C.extract(rows)))).first()
    assert r.semantic_similarity == pytest.approx(0.8138954461248494, abs=1e-9)
    assert r.structured_score == pytest.approx(0.8848634061436972, abs=1e-9)
    assert (r.structured_type, r.is_structured_conflict) == ("obligation_vs_prohibition", True)


def test_temporal_and_hybrid(spark):
    rows = spark.createDataFrame(
        [("d", 1, "A", "The Customer shall pay the invoice within 30 days."), ("d", 2, "B", "The Customer shall pay the invoice within 45 days.")], "document_id string, rn int, clause_id string, text string"
    )
    r = R.hybrid(R.rule_inference(R.analyzed(R.pairs_within(R.prepared(C.extract(rows)))))).first()
    assert r.temporal_score == pytest.approx(0.90)
    assert r.conflict_type == "temporal_deadline_conflict"
    assert r.temporal.shared_terms == ["days", "invoice", "pay"]
    assert r.hybrid_score == pytest.approx(0.95 * r.p_contradiction + 0.05 * r.structured_score, abs=1e-12)


def test_propagation(spark):
    nodes = spark.createDataFrame([(x,) for x in "ABCD"], "node_id string")
    edges = spark.createDataFrame([("A", "B", "conflict", 0.9, "x"), ("B", "C", "conflict", 0.8, "x"), ("C", "D", "related", 0.2, "x")], "src string, dst string, relationship string, weight double, conflict_type string")
    got = {r.node_id: r for r in G.propagate(nodes, edges).collect()}
    want = {"A": 0.897035294117647, "B": 0.8888470588235293, "C": 0.827035294117647, "D": 0.0}
    assert {k: got[k].propagated for k in want} == pytest.approx(want, abs=1e-9)
    assert [got[k].degree for k in "ABCD"] == [1, 2, 1, 0]
    assert [got[k].hotspot for k in "ABCD"] == ["high", "high", "high", "none"]
    with pytest.raises(ValueError):
        G.propagate(nodes, edges, alpha=2)


def test_risk(spark):
    p = spark.createDataFrame([("A", 0.90, 0.89, 2, ""), ("B", 0.75, 0.80, 1, ""), ("C", 0.10, 0.12, 0, "")], "node_id string, direct double, propagated double, degree int, hotspot string")
    edges = spark.createDataFrame([("A", "B", "conflict", 0.9, "obligation_vs_prohibition"), ("A", "C", "conflict", 0.9, "positive_vs_negative")], "src string, dst string, relationship string, weight double, conflict_type string")
    got = {r.node_id: (r.risk, r.level) for r in G.node_risk(p, edges).collect()}
    assert got["A"] == (pytest.approx(0.915), "critical")
    assert got["B"] == (pytest.approx(0.725), "high")
    assert got["C"] == (pytest.approx(0.045), "minimal")


def test_resolution(spark):
    e = spark.createDataFrame([("a", "b", 0.88, "obligation_vs_prohibition"), ("a", "c", 0.1, "temporal_deadline_conflict"), ("a", "d", 0.1, "new")], "src string, dst string, weight double, conflict_type string")
    got = {r.dst: r for r in G.resolved(e).collect()}
    assert (got["b"].severity, got["c"].severity, got["d"].advice) == ("High", "high", G.REVIEW)


def test_segments_and_context(spark):
    docs = spark.createDataFrame([(1, "First clause here.  (a) a fragment of it;\n\n\nSecond one , now. no"), (2, None), (3, "")], "document_id int, text string")
    rows = C.add_context(C.segment(docs)).orderBy("rn").collect()
    assert [r.text for r in rows] == ["First clause here.", "(a) a fragment of it;", "Second one, now."]
    assert rows[1].parent_clause_id == "1_clause_0001" and rows[1].context_text == "First clause here. (a) a fragment of it;"
    assert rows[2].parent_clause_id is None


def test_detectors(spark):
    cases = {"Vendor may not sell if paid; ok": ("prohibition", "supplier", "if paid"), "Each party can act": ("permission", "party", None), "It means a thing": ("definition", None, None), "plain": (None, None, None), "": (None, None, None)}
    rows = spark.createDataFrame([(k,) for k in cases], "text string")
    got = {r.text: (r.modality, r.party, r.condition) for r in C.extract(rows).collect()}
    assert got == cases


def test_upload_parser(spark):
    docs = spark.createDataFrame([(1, "GENERAL TERMS\r\nThe first line of it\r\ngoes on here.\r\n1. An explicit clause start\r\n\r\nshort")], "document_id int, text string")
    assert [r.text for r in C.parse_uploaded(docs).orderBy("rn").collect()] == ["The first line of it goes on here.", "1. An explicit clause start"]


def test_retrieval_pads_with_zero(spark):
    rows = spark.createDataFrame([("a", "d", 1, "pay the bill now"), ("b", "d", 2, "pay the bill later"), ("c", "d", 3, "something else entirely"), ("e", "x", 4, "pay the bill now")], "id string, document_id string, ord int, text string")
    got = S.top_k_similar(rows, S.tfidf(rows), 4).where("query_id = 'a'").orderBy("rank").collect()
    assert [r.candidate_id for r in got] == ["b", "c"] and got[1].score == 0
    every = S.top_k_similar(rows, S.tfidf(rows), 4, None).where("query_id = 'a'").orderBy("rank").first()
    assert every.candidate_id == "e" and every.score == pytest.approx(1.0)


def test_evaluation(spark):
    hits = spark.createDataFrame([("a", 1), ("b", 4), ("c", None)], "query_id string, first_rank int")
    m = E.ranking_metrics(hits).first()
    assert (m.recall_1, m.recall_5, m.mrr) == (pytest.approx(1 / 3), pytest.approx(2 / 3), pytest.approx(1.25 / 3))
    rows = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)], "score double, label int")
    a = E.areas(rows).first()
    assert (a.auc, a.average_precision) == (0.75, pytest.approx(5 / 6))
    empty = spark.range(1).select(E.overlaps(F.lit(3), F.lit(3), F.lit(0), F.lit(9)).alias("x")).first()
    assert empty.x is False


def test_classifier_hook(spark):
    pairs = spark.createDataFrame([("h", "", "clause"), ("h", "no", "clause")], "hypothesis string, evidence string, clause_text string")
    load = lambda: lambda a, b: [[0.1, 0.2, 0.7] if y == "no" else [0.8, 0.1, 0.1] for y in b]
    got = J.classify_pairs(pairs, load, {0: "Entailment", 1: "NotMentioned", 2: "Contradiction"}).select("evidence", "prediction.label").collect()
    assert {r.evidence: r.label for r in got} == {"": "Entailment", "no": "Contradiction"}
    with pytest.raises(ValueError):
        J.guard_labels({2: "Neutral"})


def test_stream(spark, tmp_path):
    from clausewright.streaming import ingest

    spark.createDataFrame([("d", "The Supplier shall deliver. Short.")], "document_id string, text string").write.parquet(str(tmp_path / "in"))
    q = ingest.start(spark, str(tmp_path / "in"), "document_id string, text string", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [(r.text, r.modality) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("The Supplier shall deliver.", "obligation")]


def test_json_corpus(spark, tmp_path):
    import json

    from clausewright.sources import loaders as L

    doc = {"documents": [{"id": 7, "file_name": "f", "text": "Alpha beta. Gamma.", "spans": [[0, 11], [12, 18], [3, 3]], "annotation_sets": [{"annotations": {"n1": {"choice": "Contradiction", "spans": [1, 9]}}}]}], "labels": {"n1": {"short_description": "s", "hypothesis": "H"}}}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    raw = L.read_json(spark, str(tmp_path / "c.json"), L.NLI_SCHEMA)
    docs = L.nli_documents(raw)
    assert [r.text for r in L.span_clauses(docs).orderBy("span_id").collect()] == ["Alpha beta.", "Gamma."]
    rows = L.label_rows(docs, L.hypotheses(raw))
    assert rows.select("target", "hypothesis").first() == (2, "H")
    assert [(r.start, r.finish) for r in L.gold_spans(rows, docs).collect()] == [(12, 18)]


def test_text_helpers(spark):
    r = spark.createDataFrame([("INDEMNITY AND NOTICE", "a b/c.v2", "[3, 1, 3]", "nan")], "h string, s string, p string, n string").select(
        T.is_heading(F.col("h")).alias("h"), T.document_id_of(F.col("s")).alias("s"), T.parse_int_set(F.col("p")).alias("p"), T.safe_number(F.col("n")).alias("n")
    ).first()
    assert (r.h, r.s, r.p, r.n) == (True, "a_b_c_v2", [1, 3], 0.0)


def test_dense_ranking_sees_all_vectors(spark, tmp_path):
    from clausewright.plans.queries import QUERIES

    v = [[(i * 37 % 101) / 101, (i * 53 % 97) / 97] for i in range(120)]
    spark.createDataFrame([(i, x, i % 3) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    score = lambda a, b: round(v[a][0] * v[b][0] + v[a][1] * v[b][1], 9)
    want = {(q, c, k + 1) for q in (0, 50, 100) for k, c in enumerate(sorted((c for c in range(120) if c != q), key=lambda c: (-score(q, c), c))[:10])}
    assert {(r.query_id, r.candidate_id, r["rank"]) for r in QUERIES["c13_dense_ranking"](spark, str(tmp_path)).collect()} == want


def test_all_documents_and_hypotheses(spark, tmp_path):
    from clausewright.plans.queries import QUERIES

    text = "The Supplier shall deliver the goods. The Customer shall pay the invoice. Each party can end this agreement."
    spark.createDataFrame([(1, text, "en"), (2, text, "de"), (3, text, None)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "The Supplier shall deliver the goods."), (2, "The Customer shall pay the invoice."), (50, "Each party can end this agreement.")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = QUERIES["c08_rank_for_hypotheses"](spark, str(tmp_path)).collect()
    assert len(got) == 27  # three clauses for each of nine pairs
    assert {(r.doc_id, r.item_id): (r.rn, r.score) for r in got if r["rank"] == 1} == {(d, i): (rn, 1.0) for d in (1, 2, 3) for i, rn in ((1, 1), (2, 2), (50, 3))}
    assert {r.doc_id for r in QUERIES["c18_word_sets"](spark, str(tmp_path)).collect()} == {1, 2, 3}
