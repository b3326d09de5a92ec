"""Extractors, explanations, reports, candidate hygiene, evaluation and files of the contract engine, on cases worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from clausewright.functions import features as X
from clausewright.functions import text as T
from clausewright.operators import clauses as C
from clausewright.operators import evaluation as E
from clausewright.operators import graph as G
from clausewright.operators import inference as J
from clausewright.operators import reasoning as R
from clausewright.operators import retrieval as S
from clausewright.plans import contracts as P
from clausewright.sources import loaders as L


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first().x


def test_draft_texts(spark):
    x = F.col("text")
    said = "In addition, the Receiving Party shall not DISCLOSE any such information, provided that it will notify us"
    assert one(spark, T.normalize_proposition(x), said) == "receiving disclose information notify"
    assert one(spark, T.clean_proposition(x), "The Buyer shall not sell a thing") == "buyer not sell thing"  # "shall" goes first
    assert one(spark, T.action_core(x), "It will not, cannot and should pay") == "it , and should pay"
    got = one(spark, T.subject_action_object(x), said)
    assert (got.subject, got.action, got.object) == ("receiving party", "receiving", "party disclose")  # the first listed verb
    got = one(spark, T.subject_action_object(x), "the contractor will modifies nothing " + " ".join(f"w{'abcdefghijklmno'[i]}x" for i in range(15)))
    assert (got.subject, got.action) == ("contractor", "modifies") and len(got.object.split()) == 12
    got = one(spark, T.subject_action_object(x), "the agreement binds us and them")
    assert (got.subject, got.action, got.object) == ("", "", "binds them")
    assert one(spark, T.subject_action_object(x), "A b!").asDict() == {"subject": "", "action": "", "object": ""}
    assert one(spark, T.numbers(x), "7.5% in 2.5 days, EUR 1,200.50 or INR 3") == ["7.5%", "2.5 days", "EUR 1,200.50", "INR 3", "7.5", "2.5", "1,200.50", "3"]
    assert one(spark, T.draft_conditions(x), "fee for all card transactions IF late") == ["if late", "for all card transactions"]
    assert one(spark, T.draft_conditions(x, True), "fee IF late") == ["IF late"]
    pair = spark.createDataFrame([("a shall pay", "b will not pay"), ("a shall not pay", "b must not"), ("x", "y cannot")], "a string, b string")
    assert [r.c for r in pair.select(T.explicit_negation_conflict(F.col("a"), F.col("b")).alias("c")).collect()] == [1, 0, 0]


def test_accents(spark):
    assert one(spark, T.strip_accents(F.col("text")), "café Ünï ǎ ß é") == "cafe Uni a ß e"
    rows = spark.createDataFrame([("1", "the café"), ("2", "the cafe"), ("3", "other words")], "id string, text string")
    weights = {(r.id, r.term): r.weight for r in S.tfidf(rows).collect()}
    assert weights["1", "cafe"] == weights["2", "cafe"] and ("1", "café") not in weights
    assert ("1", "café") in {(r.id, r.term) for r in S.tfidf(rows, accents=True).collect()}


def test_explanations(spark):
    row = spark.createDataFrame([("Contradiction", 0.9, 0.625, "positive_vs_negative", 0.85, "temporal_deadline_conflict"), ("Entailment", 0.25, 0.125, "no_clear_conflict", 0.0, None), (None, 0.05, 0.1, "x", 0.0, None)], "l string, p double, s double, k string, t double, tt string")
    got = [r.e for r in row.select(X.hybrid_reasons(*[F.col(c) for c in ("l", "p", "s", "k", "t", "tt")]).alias("e")).collect()]
    assert got == [
        "Hybrid reasoning: Legal-BERT detected contradiction with probability 0.90; structured reasoning detected conflict indicators (score=0.62); conflict pattern: positive_vs_negative; temporal analysis detected temporal_deadline_conflict (score=0.85).",
        "Hybrid reasoning: Legal-BERT detected entailment with probability 0.75; structured reasoning found limited conflict indicators (score=0.12).",
        "Hybrid reasoning: Legal-BERT did not detect a strong contradiction; structured reasoning found limited conflict indicators (score=0.10); conflict pattern: x.",
    ]
    rec = spark.createDataFrame([("a", 0.9, None, None), ("b", 0.2, ["t1", "t2"], ["a"]), (None, 0.1, None, None)], "node_id string, risk double, types array<string>, neighbours array<string>")
    got = {r.node_id: r for r in G.explained(rec).collect()}
    assert set(got) == {"a", "b"} and got["a"].level == "minimal" and got["a"].hotspot == "none"
    assert got["b"].explanation.endswith("Detected conflict types include: t1, t2. The clause is connected to the following conflicting clauses: a.")
    assert "No direct conflict signal was detected. The clause is not connected to any detected conflict edges." in got["a"].explanation
    assert G.records(spark.createDataFrame([("a", "single")], "node_id string, types string")).first().types == ["single"]
    with pytest.raises(ValueError):
        G.record(rec, "zz")


def test_graph_api(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    edges = spark.createDataFrame([("a", "b", "conflict", 0.9, None), ("b", "c", "related", 0.2, "x"), ("c", "b", "conflict", 0.8, "y")], "src string, dst string, relationship string, weight double, conflict_type string")
    assert G.graph_summary(nodes, edges).first().asDict() == {"nodes": 3, "edges": 3, "conflicts": 2}
    assert sorted(r.src for r in G.conflicts_of(edges, "b").collect()) == ["a", "c"] and G.conflicts_of(edges, "a").count() == 1
    assert {r.conflict_type: r.n for r in G.type_counts(edges).collect()} == {"unknown": 1, "y": 1}
    assert [(r.node_id, r.degree) for r in G.degree_hotspots(edges, 2).collect()] == [("b", 2), ("a", 1)]
    assert G.checked(nodes, edges) is edges and G.node(nodes, "a").count() == 1
    with pytest.raises(ValueError, match="zz"):
        G.checked(nodes, edges.union(spark.createDataFrame([("a", "zz", "related", 0.0, "x")], edges.schema)))
    with pytest.raises(ValueError):
        G.risk_inputs(nodes.where("node_id = 'none'"), edges)
    kept, ends = G.risk_inputs(spark.createDataFrame([(1, 0.5, 2)], "id int, direct_conflict_score double, conflict_degree int"), spark.createDataFrame([("1", "2", "conflict")], "source string, target string, relation string"))
    assert kept.first().asDict() == {"node_id": "1", "direct": 0.5, "propagated": 0.5, "degree": 2} and ends.first().conflict_type == "unknown"
    empty = G.risk_report(spark.createDataFrame([], "node_id string, risk double, level string"))
    assert {r.key: (r.value, r.level) for r in empty.collect()} == {"nodes": (0.0, None), "average_risk": (0.0, None), "maximum_risk": (0.0, None)}


def test_candidates(spark):
    queries = spark.createDataFrame([("d", "q1", True), ("d", "q2", True), ("d", "q3", False), ("d", "q4", True), ("d", "q5", True)], "document_id string, query_id string, has_scores boolean")
    cands = spark.createDataFrame([("d", "q1", "a"), ("d", "q1", "zz"), ("d", "q1", "other"), ("d", "q3", "a"), ("d", "q4", "other"), ("d", "q5", "a")], "document_id string, query_id string, clause_id string")
    gold = spark.createDataFrame([("d", "q1", "a"), ("d", "q2", "a"), ("d", "q3", "a"), ("d", "q4", "a")], "document_id string, query_id string, clause_id string")
    clauses = spark.createDataFrame([("a", "d"), ("other", "e")], "clause_id string, document_id string")
    kept, counts = S.clean_candidates(queries, cands, gold, clauses)
    assert [(r.query_id, r.clause_id) for r in kept.collect()] == [("q1", "a")]
    assert counts.first().asDict() == {"missing_gold": 1, "missing_candidates": 2, "missing_scores": 1, "missing_clause_ids": 1, "queries": 1}
    assert S.coverage(kept, gold).first().coverage == 1.0 and S.coverage(kept.limit(0), gold).first().coverage == 0.0
    with pytest.raises(ValueError):
        S.validated(clauses.limit(0))
    with pytest.raises(ValueError):
        S.validated(spark.createDataFrame([(None,)], "clause_id string"))
    ids = spark.createDataFrame([(["a", "b", "a"], {"x": 1.0}), ([], {"x": 1.0}), (None, None)], "l array<string>, s map<string,double>")
    assert [r.c for r in ids.select(S.candidate_ids(F.col("l"), F.col("s")).alias("c")).collect()] == [["a", "b"], ["x"], []]
    v = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r.c for r in v.select(S.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0]


def test_evaluation_of_sets(spark):
    rows = spark.createDataFrame([("d", "x", 1), ("d", "x", 2), ("d", "y", 1), ("d", "z", 5)], "document_id string, label_id string, span_id int")
    gold = spark.createDataFrame([("d", "x", [2, 3]), ("d", "y", [])], "document_id string, label_id string, evidence_span_ids array<int>")
    flagged = E.with_evidence(rows, gold)
    assert sorted((r.label_id, r.span_id, r.is_evidence) for r in flagged.collect()) == [("x", 1, 0), ("x", 2, 1), ("y", 1, 0), ("z", 5, 0)]
    assert [(r.label_id, r.gold, r.found, r.recall) for r in E.evidence_recall(flagged).collect()] == [("x", 2, 1, 0.5)]
    pairs = spark.createDataFrame([("d", 1, 2, [2, 9], 0.4), ("d", 3, 4, [2, 9], 0.8), ("e", 1, 2, [], 0.1)], "k string, span_a int, span_b int, gold_spans array<int>, s double")
    assert [(r.k, r.gold, r.candidates, r.found, r.recall, r.retrievable) for r in E.set_coverage(pairs, ["k"]).collect()] == [("d", 2, 4, 1, 0.5, True)]
    assert [(r.a_is_gold, r.b_is_gold, r.pair_touches_gold, r.pair_both_gold) for r in E.gold_touch(pairs).collect()] == [(False, True, True, False), (False, False, False, False), (False, False, False, False)]
    rolled = {r.k: r for r in E.rolled_up(pairs, ["s"], ["k"]).collect()}
    assert (rolled["d"].s_max, rolled["d"].pair_count) == (0.8, 2) and rolled["d"].s_mean == pytest.approx(0.6)
    report = {r.label: r for r in E.class_report(spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 0)], "label int, predicted int")).collect()}
    assert (report[0].precision, report[0].recall, report[1].precision, report[2].f1, report[0].support) == (0.5, 0.5, 0.5, 0.0, 2)
    best = E.best_threshold(spark.createDataFrame([(0.2, 0.5), (0.4, 0.7), (0.6, 0.7)], "threshold double, f1 double")).first()
    assert best.threshold == 0.4


def test_model_helpers(spark):
    assert J.classify_pair("a", "b", lambda x, y: [[0.1, 0.2, 0.7]]) == {"label_id": 2, "label": "Contradiction", "confidence": 0.7, "probabilities": [0.1, 0.2, 0.7]}
    rows = spark.createDataFrame([(i, i % 2, float(i), "g") for i in range(20)], "id int, label int, x double, k string")
    split = J.stratified(rows, "label", "id")
    assert {(r.label, r["count"]) for r in split.where("is_train").groupBy("label").count().collect()} == {(0, 8), (1, 8)}
    made = J.reconstructed(rows, ["x", "x_mean", "x_max", "x_min", "x_count"], ["k"]).first()
    assert (made.x_mean, made.x_max, made.x_min, made.x_count) == (9.5, 19.0, 0.0, 20)
    with pytest.raises(ValueError, match="y_mean"):
        J.reconstructed(rows, ["y_mean"], ["k"])


def test_context_reaches_the_model(spark):
    docs = spark.createDataFrame([("d", "The Supplier shall pay the fee. (a) it may not delay the fee at all.")], "document_id string, text string")
    clauses = C.add_context(C.segment(docs))
    seen = []

    def infer(rows):
        seen.append(R.inference_pairs(rows))
        return R.rule_inference(rows)

    P.conflicts(clauses, P.Config(top_k=1, most_pairs=1), infer).count()
    r = seen[0].first()
    assert seen[0].count() == 1 and r.query_clause_id == "d_clause_0001" and not r.query_context_used
    assert r.candidate_context_used and r.evidence == "The Supplier shall pay the fee. (a) it may not delay the fee at all." and r.retrieval_rank == 1


def test_files(spark, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up/My contract.txt").write_bytes(b"  The text \xff of it \n")
    (tmp_path / "up/broken.pdf").write_bytes(b"no pdf at all")
    try:
        import pypdf  # noqa: F401
    except ImportError:
        (tmp_path / "up/broken.pdf").unlink()
    got = {r.document_id: r.text for r in L.uploaded(spark, str(tmp_path / "up")).collect()}
    assert got["My_contract"] == "The text � of it" and got.get("broken") is None
    (tmp_path / "up/x.docx").write_bytes(b"x")
    with pytest.raises(Exception, match="unsupported file type"):
        L.uploaded(spark, str(tmp_path / "up")).collect()
    rows = spark.createDataFrame([(1, "é", None), (2, "b", [1, 2])], "id int, t string, l array<int>")
    L.write_json_array(rows, str(tmp_path / "r.json"))
    text = (tmp_path / "r.json").read_text(encoding="utf-8")
    assert json.loads(text) == [{"id": 1, "t": "é", "l": None}, {"id": 2, "t": "b", "l": [1, 2]}] and text.startswith('[\n  {\n    "id": 1,')
    with pytest.raises(ValueError):
        L.write_json_array(rows, str(tmp_path / "r.json"), most=1)
    L.write_csv(rows.select("id", "t"), str(tmp_path / "c"))
    assert L.read_csv(spark, str(tmp_path / "c"), "id int, t string").count() == 2
    L.write_pickle(rows.select("id", "t"), str(tmp_path / "p.pkl"))
    assert sorted(r.t for r in L.read_pickle(spark, str(tmp_path / "p.pkl")).collect()) == ["b", "é"]
    L.write_json(rows, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    L.write_audit(rows.select("id", "t"), str(tmp_path / "audit"))
    assert spark.read.option("header", True).csv(str(tmp_path / "audit")).columns == ["id", "t", "human_relevance", "review_notes"]
    (tmp_path / "nli.json").write_text(json.dumps({"documents": [{"id": 1, "text": "ab", "spans": [[0, 1]]}], "labels": {"l": {"hypothesis": "h"}}}))
    checked = L.validated(L.read_json(spark, str(tmp_path / "nli.json"), L.NLI_SCHEMA)).first()
    assert (checked["keys"], checked.documents, checked.labels, checked.first_is_whole, checked.first_length) == (["documents", "labels"], 1, 1, True, 2)
    (tmp_path / "odd.json").write_text(json.dumps({"other": 1}))
    checked = L.validated(L.read_json(spark, str(tmp_path / "odd.json"))).first()
    assert (checked["keys"], checked.documents, checked.first_is_whole) == (["other"], None, False)
    (tmp_path / "qa.json").write_text(json.dumps({"data": [{"title": "T", "paragraphs": [{"context": ""}, {"context": "The Buyer shall pay the fee."}]}]}))
    qa = L.read_json(spark, str(tmp_path / "qa.json"), L.QA_SCHEMA)
    assert [(r.document_id, r.dataset, r.modality) for r in L.qa_clauses(qa).collect()] == [("T_paragraph_2", "cuad", "obligation")]
    assert {r.file.rsplit("/", 1)[1] for r in L.found_files(spark, str(tmp_path), "*.json").collect()} >= {"nli.json", "odd.json"}
    (tmp_path / "l.json").write_text(json.dumps({"labels": [{"id": 3, "hypothesis": "h3"}]}))
    assert L.listed_hypotheses(L.read_json(spark, str(tmp_path / "l.json"))).first().asDict() == {"label_id": "3", "hypothesis": "h3"}
    L.union_splits(rows, rows.drop("l")).count()
    rows.select(F.lit("d").alias("document_id"), F.lit("c").alias("clause_id"), "t").withColumnRenamed("t", "text").write.parquet(str(tmp_path / "clauses.parquet"))
    assert L.read_clauses(spark, str(tmp_path / "clauses.parquet")).columns[:3] == ["document_id", "clause_id", "text"]
