"""The pair classifier, the encoder and blocked rankings, against numpy and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.operators import dense as D
from clausewright.operators import encoder as N
from clausewright.operators import inference as J
from clausewright.operators import training as L

SMALL = L.Params(buckets=64, dim=4, hidden=5, epochs=2, steps=3, max_length=9)
PAIRS = "hypothesis string, evidence string, label int, pair string"


def pair_rows(n, seed=3):
    rng = np.random.default_rng(seed)
    words = "supplier buyer shall not may pay deliver within days".split()
    text = lambda: " ".join(rng.choice(words, rng.integers(1, 8)))
    rows = [(text(), text()) for _ in range(n)]
    return [(a, b, 2 if ("not" in a) != ("not" in b) else int("pay" in a and "pay" in b), f"p{i}") for i, (a, b) in enumerate(rows)]


def test_gradient_against_finite_differences():
    rows = pair_rows(50)
    cut = [L.cut_pair(L.word_ids(a, SMALL), L.word_ids(b, SMALL), SMALL.max_length) for a, b, _, _ in rows]
    a, b = L.Words.of([x for x, _ in cut]), L.Words.of([y for _, y in cut])
    label, weight = np.array([r[2] for r in rows]), np.linspace(0.5, 2, 50)
    flat = L.initial(SMALL)
    loss, grad = L.gradient(a, b, label, weight, flat, SMALL)
    q = L.forward(a, b, L.unpacked(flat, SMALL))[-1]
    assert np.isclose(loss, -(weight * np.log(q[np.arange(50), label])).sum())
    rng = np.random.default_rng(1)
    for i in [*rng.integers(0, SMALL.size, 60), SMALL.size - 1, 4 * int(a.flat[0])]:
        e = np.zeros(SMALL.size)
        e[i] = 1e-6
        slope = (L.gradient(a, b, label, weight, flat + e, SMALL)[0] - L.gradient(a, b, label, weight, flat - e, SMALL)[0]) / 2e-6
        assert abs(slope - grad[i]) < 1e-5 * max(1, abs(slope))


def test_pairs_are_cut_longest_first():
    for n, m, most in [(3, 4, 9), (20, 4, 9), (4, 20, 9), (20, 20, 9), (20, 20, 10), (0, 20, 9), (20, 5, 9)]:
        a, b = list(range(n)), list(range(m))
        x, y = a[:], b[:]
        while len(x) + len(y) > most:
            (y if len(y) > len(x) else x).pop()
        got = L.cut_pair(a, b, most)
        assert sorted(map(len, got)) == sorted((len(x), len(y))) and got[0] == a[: len(got[0])] and got[1] == b[: len(got[1])]


def test_one_step_against_the_same_in_numpy():
    moves, flat = L.AdamW(SMALL), L.initial(SMALL)
    grad = np.full(SMALL.size, 3.0)
    got = moves.step(flat, grad)
    g = grad / np.sqrt((grad**2).sum())  # cut to a norm of 1
    want = flat * (1 - SMALL.rate * SMALL.weight_decay) - SMALL.rate * g / (np.sqrt(g * g) + 1e-8)
    assert np.allclose(got, want)


def test_training_in_one_task_and_in_many(spark):
    rows = spark.createDataFrame(pair_rows(300), PAIRS)
    held = spark.createDataFrame(pair_rows(80, seed=9), PAIRS)
    params = L.Params(buckets=256, dim=8, hidden=16, epochs=12, steps=2, rate=0.05)
    read = L.read_pairs(rows.withColumn("weight", F.lit(1.5)), params, ["label", "weight"])
    sums = [L.batch_sums(x, L.initial(params), params) for x in (read.coalesce(1), read.repartition(7))]
    assert np.allclose(*sums, atol=1e-10) and sums[0][3] == 300 and sums[0][1] == 450
    many = L.fit(rows.repartition(7), "pair", params, held)
    losses = [h["held_out_loss"] for h in many.history]
    assert losses[-1] < 0.7 * losses[0] and many.history[-1]["held_out_rows"] == 80 and many.history[-1]["held_out_accuracy"] > 0.7
    # the same by hand, a batch at a time
    batch = {r.pair: r.k for r in rows.select("pair", F.pmod(F.xxhash64("pair"), F.lit(2)).alias("k")).collect()}
    data = pair_rows(300)
    counts = np.bincount([r[2] for r in data], minlength=3)
    flat, moves = L.initial(params), L.AdamW(params)
    for _ in range(params.epochs):
        for k in range(2):
            own = [r for r in data if batch[r[3]] == k]
            a, b = (L.Words.of([L.word_ids(r[i], params) for r in own]) for i in (0, 1))
            label = np.array([r[2] for r in own])
            weight = len(data) / (3 * counts[label])
            flat = moves.step(flat, L.gradient(a, b, label, weight, flat, params)[1] / weight.sum())
    assert np.allclose(flat, many.flat, atol=1e-8)


def test_classified_pairs_in_order(spark):
    model = L.Classifier(SMALL, L.initial(SMALL), [])
    rows = [(i, "pay " * (i * 7 % 40), "not " * (i * 3 % 11), "clause text") for i in range(70)] + [(70, None, None, "x")]
    pairs = spark.createDataFrame(rows, "i int, hypothesis string, evidence string, clause_text string").coalesce(1)
    got = J.classify_pairs(pairs, model.load, L.LABELS, batch=8).orderBy("i").collect()
    run = model.load()
    for r in got:
        want = run([r.hypothesis or ""], [r.evidence or r.clause_text])[0]
        assert np.allclose(r.prediction.probabilities, want) and r.prediction.label_id == int(np.argmax(want)) and r.prediction.label == L.LABELS[r.prediction.label_id]


def test_training_on_nothing(spark):
    none = spark.createDataFrame([], PAIRS)
    model = L.fit(none, "pair", SMALL, none)
    assert np.array_equal(model.flat, L.initial(SMALL)) and [h["loss"] for h in model.history] == [None] * 3


def test_singular_values_against_numpy(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(f"d{i}", " ".join(rng.choice(words, 12, p=np.arange(1, 41) / 820))) for i in range(120)] + [("empty", ""), ("null", None)]
    df = spark.createDataFrame(rows, "id string, text string")
    matrix, terms, idf = N.sparse_rows(df)
    a = np.zeros((120, len(terms)))
    cells = {r.id: r.cells for r in matrix.collect()}
    assert "empty" not in cells and len(idf) == len(terms)
    for i in range(120):
        for c in cells[f"d{i}"]:
            a[i, c.k] = c.w
    assert np.allclose((a * a).sum(axis=1), 1)
    block = rng.standard_normal((len(terms), 3))
    assert np.allclose(N.gram_product(matrix, block), a.T @ (a @ block))
    got, vectors = N.decomposed(matrix, len(terms), 6, over=20, rounds=10)
    want, right = np.linalg.svd(a, full_matrices=False)[1:]
    assert np.allclose(got, want[:6], rtol=1e-4) and abs(float(vectors[:, 0] @ right[0])) > 1 - 1e-6
    # an encoded text is the mean of its known terms' vectors, of length 1
    model = N.Encoder({t: k for k, t in enumerate(terms)}, vectors * idf[:, None], got)
    made = {r.id: np.array(r.embedding) for r in N.encoded(df.withColumn("embedding", F.lit("clash")), model).collect()}
    own = "w39 w38".split()
    one = N.encoded(spark.createDataFrame([("x", "w39 w38 unheard")], "id string, text string"), model).first().embedding
    mean = np.mean([model.vectors[model.terms[g]] for g in [*own, "w39 w38", "w38 unheard"] if g in model.terms], axis=0)
    assert np.allclose(one, mean / np.linalg.norm(mean)) and not made["empty"].any() and not made["null"].any() and np.isclose(made["d0"] @ made["d0"], 1)


def test_encoder_of_no_terms(spark):
    rows = spark.createDataFrame([("a", ""), ("b", None)], "id string, text string")
    model = N.fit(rows)
    assert model.terms == {} and {tuple(r.embedding) for r in N.encoded(rows, model).collect()} == {(0.0,) * 32}


@pytest.mark.parametrize("sizes", [(3, 7), (100, 1000)])
def test_blocked_ranking_against_brute_force(spark, sizes):
    rng = np.random.default_rng(6)
    x = np.round(rng.standard_normal((60, 5)), 1)
    x[10:20] = x[3]  # ties
    label = ["a", "b", "c", None]
    rows = [(i, x[i].tolist(), label[i % 4]) for i in range(60)] + [(60, None, "a")]
    both = spark.createDataFrame(rows, "id long, x array<double>, label string")
    queries, vectors = (D.as_vectors(r, F.col("id"), F.col("x"), F.col("label"), n) for r, n in ((both.where("id % 5 = 0 OR id = 60 OR id = 3"), ("query_id", "q")), (both, ("candidate_id", "v"))))
    found = {}
    for q in [*range(0, 60, 5), 3]:
        found[q] = sorted(((-round(float(x[q] @ x[c]), 9), c, label[q % 4] is not None and label[c % 4] == label[q % 4]) for c in range(60) if c != q))
    got = {}
    for r in D.top_k(queries, vectors, 6, sizes=sizes).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((round(-r.score, 9) + 0.0, r.candidate_id, r.hit))
    assert got == {q: [(s + 0.0, c, h) for s, c, h in f[:6]] for q, f in found.items()}
    first = {r.query_id: r.first_rank for r in D.first_hits(queries, vectors, sizes=sizes).collect()}
    assert first == {**{q: next((n + 1 for n, f in enumerate(f) if f[2]), None) for q, f in found.items()}, 60: None}
    assert D.top_k(queries, vectors.where("false"), 6).count() == 0
