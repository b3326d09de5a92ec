"""Queries on the ends of edges alone measure no pair."""

from clausewright.operators import reasoning as R
from clausewright.plans.queries import QUERIES
from clausewright.sources.synth import synth_clauses

DATA = "/root/testdata/sf0.001"


def test_ends_without_measures(spark, monkeypatch):
    near: dict[str, set[str]] = {}
    docs: dict[str, list[str]] = {}
    for r in synth_clauses(spark, DATA).select("document_id", "clause_id").collect():
        docs.setdefault(r.document_id, []).append(r.clause_id)
    for ids in docs.values():
        for a in ids:
            if others := {b for b in ids if b != a}:
                near.setdefault(a, set()).update(others)

    def measured(*_, **__):
        raise AssertionError("pairs were measured")

    monkeypatch.setattr(R, "analyzed_within", measured)
    got = {r.node_id: r.neighbours for r in QUERIES["f07_neighbours"](spark, DATA).collect()}
    assert got == {k: "|".join(sorted(v)) for k, v in near.items()}
    assert [r.n for r in QUERIES["f03_unknown_endpoints"](spark, DATA).collect()] == [0]
