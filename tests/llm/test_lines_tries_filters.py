"""Repeated lines, tries of conversations and overlaps of filters, against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from clausewright.llm import audit, linededup, prefixtrie

BLANK = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# --- repeated lines ---------------------------------------------------------------------------------------------------


def lines_brute(rows):
    """rows (doc_id, text), in order: (doc_id, n_lines, n_dropped, kept)."""
    number = lambda i: -(1 << 63) if i is None else i
    key = lambda x: lower(x.strip(BLANK))
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(number(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(holders[key(x)]) < 5 or max(holders[key(x)]) == number(i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def line_rows():
    rng = random.Random(7)
    common = [f"this line number {k} is said by many of the documents here" for k in range(12)]
    edge = ["é" * 40, "é" * 39, "  " + "x" * 40 + "\t", "y" * 39 + " ", "Ä" + "q" * 39]
    rows = [(i, "\n".join(rng.choice([*common, *edge, f"own line {i} {rng.random()} and more of it to be long enough", "short", ""]) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    rows += [(7, common[0].upper() + "\n" + common[1]), (7, common[0] + "\r\n" + common[0]), (None, common[0] + "\n\nz"), (None, common[2] + "\x0b"), (None, None), (70, ""), (71, None), (-5, "\n\n"), (80, ("long " * 40_000) + "\n" + common[3])]
    rows += [(100 + k, "only the empty rest\n" * 2 + "É" * 41) for k in range(4)]  # four documents: not enough
    return rows


LINES = "doc_id long, text string"


@pytest.mark.parametrize(("batches", "fanout"), [(5, 2), (1, 2)])
def test_lines_against_brute_force(spark, batches, fanout):
    rows = line_rows()
    docs = spark.createDataFrame(rows, LINES).repartition(5)
    for c in ("n_lines", "n_dropped", "kept", "key", "digest", "gone", "keeper", "batch", "row", "keys", "documents"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = linededup.without_repeated(docs, batches=batches, fanout=fanout)
    assert set(docs.columns) == set(got.columns) and {r.batch for r in got.select("batch").collect()} == {"clash"}
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()]
    want = lines_brute(rows)
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(r[2] for r in want) > 100
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_runs")]


def test_lines_of_odd_tables(spark):
    none = linededup.without_repeated(spark.createDataFrame([], LINES))
    assert none.count() == 0 and none.columns == ["doc_id", "text", "n_lines", "n_dropped", "kept"]
    empty = linededup.without_repeated(spark.createDataFrame([(None, None), (1, ""), (1, "")], LINES)).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept) for r in empty) == [("1", 1, 0, ""), ("1", 1, 0, ""), ("None", 1, 0, "")]


def test_runs_are_disjoint_in_what_is_settled_and_levelled(spark):
    runs = linededup.LineRuns(spark, documents=2, fanout=2)
    batch = lambda *rows: spark.createDataFrame([(i, k.encode()) for i, k in rows], "doc_id long, key binary")
    try:
        runs.add(batch((9, "a"), (8, "a"), (9, "b")))
        runs.add(batch((7, "a"), (6, "b"), (6, "b"), (5, "c")))
        assert [len(x) for x in runs.levels] == [0, 1]  # two runs were merged into one of the next level
        runs.add(batch((4, "a"), (4, "b"), (3, "c")))
        assert [len(x) for x in runs.levels] == [1, 1]
        assert {bytes(r.key) for r in spark.table(runs.levels[0][0]).collect()} == {b"c"}  # a and b are settled
        runs.add(batch((10, "a")))  # a larger id than any: it is what stays
        assert {(bytes(r.key), r.keeper) for r in runs.frequent().collect()} == {(b"a", 10), (b"b", 9), (b"c", 5)}
        assert [len(x) for x in runs.levels] == [0, 0, 1]
    finally:
        runs.close()
    with pytest.raises(ValueError, match="no batch"):
        runs.frequent()


def test_line_keys_of_edges():
    assert linededup.line_key(b"x" * 39) is None and linededup.line_key("é".encode() * 39) is None
    assert linededup.line_key(b" \t" + b"X" * 40 + b"\r") == linededup.line_key(b"x" * 40) is not None
    assert linededup.line_key("É".encode() * 40) != linededup.line_key("é".encode() * 40)  # only A-Z are lower-cased
    assert linededup.line_key(" ".encode() + b"x" * 39) is not None  # a no-break space isn't stripped


# --- tries of conversations -------------------------------------------------------------------------------------------


def trie_brute(paths):
    """{conv_id: tuple of (role, text)}: the rows of the trie."""
    nodes = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    kids = defaultdict(int)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not kids[p]
    own = lambda p: ",".join(map(str, sorted(c for c in nodes[p] if paths[c] == p)))
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(own(p))) for p, m in nodes.items())


def rebuilt_brute(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append(((turn is not None, turn or 0), role or "", sha(text or ""), text or ""))
    own = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in by.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    base = lambda c: c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
    return {c: tuple(own.get(base(c), [])[: h[c]] + own[c][h[c] :]) for c in own}


TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def as_rows(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def written(spark, rows, path):
    df = spark.createDataFrame(rows, TURNS)
    for c in ("path", "path_id", "gid", "t", "key", "n", "depth", "least"):
        df = df.withColumn(c, F.lit("clash"))
    df.repartition(3).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def turn_rows():
    rng = random.Random(9)
    rows = []
    for c in [*range(0, 40), *range(100, 130), -1, -150, 999, 1_000_000_007]:
        for k in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((c, k, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "ccc é", None, ""])))
    rows += [(200 + c, k, "user", "same") for c in range(30) for k in range(4)]  # copies; 200 is there
    rows += [(5, None, "system", "first of all"), (6, 1, "z", "tie"), (6, 1, "a", "tie"), (6, 1, "a", "tie"), (None, 1, "user", "in none"), (7, 100, "user", "x" * 200_000)]
    return rows


def test_trie_query_against_brute_force(spark, tmp_path):
    rows = turn_rows()
    got = as_rows(prefixtrie.op12_prefix_trie(spark, written(spark, rows, tmp_path)))
    paths = rebuilt_brute(rows)
    assert got == trie_brute(paths) and () in paths.values()


@pytest.mark.parametrize("turns", [4, 60, 20_000])
def test_tries_that_are_split(spark, turns):
    """A first turn that half of all share, long shared beginnings, paths that end within others, in subtries of any size."""
    rng = random.Random(10)
    paths = {}
    for c in range(120):
        start = [("system", "hot")] * (c % 2) + [("user", "deep")] * rng.choice([0, 0, 12])
        paths[c * 3000] = tuple(start + [(rng.choice("ab"), rng.choice("xyz") * 3) for _ in range(rng.choice([0, 1, 2, 5]))])
    for c in range(5):
        paths[c * 7 + 1_000_001] = (("system", "nested"),) * c
    data = [(c, [(hashlib.md5(repr(t).encode()).hexdigest(), len(t[1])) for t in p]) for c, p in paths.items()]
    members = spark.createDataFrame(data, "conv_id long, path array<struct<name:string,chars:int>>").persist()
    nodes = prefixtrie.trie(members, turns=turns)
    ends = prefixtrie.ends(members.select(prefixtrie.path_id(F.col("path")).alias("path_id"), "conv_id"), ids=5000)
    full = nodes.join(ends, "path_id", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(prefixtrie.NO_ENDS)))
    assert as_rows(full) == trie_brute(paths)


def test_tries_of_odd_tables(spark, tmp_path):
    assert prefixtrie.op12_prefix_trie(spark, written(spark, [], tmp_path / "none")).count() == 0
    assert prefixtrie.op12_prefix_trie(spark, written(spark, [(None, 1, "user", "x")], tmp_path / "null")).count() == 0
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 0)
    got = as_rows(prefixtrie.op12_prefix_trie(spark, written(spark, [(c, 0, "user", "gone")], tmp_path / "one")))
    assert got == [(c, 0, None, 1, 0, 1, 0, sha(str(c)))]  # nothing is left of it: the root alone


def test_trie_of_one_chain_is_not_recursive():
    import pandas as pd

    n = 50_000
    rows = pd.DataFrame({"gid": [""], "depth": [0], "least_above": [4], "path_id": ["p"], "names": [[str(i) for i in range(n)]], "chars": [[1] * n], "convs": [3], "least": [4]})
    got = prefixtrie.build(rows)
    assert len(got) == n and got.saved_tokens.iloc[0] == 2 * n and got.n_leaves.eq(1).all() and got.path_id.iloc[-1] == "p" and got.top.sum() == 1


# --- overlaps of filters ----------------------------------------------------------------------------------------------


def audit_brute(rows, labels):
    """rows (doc_id, text, lang), labels (doc_id, quality, toxic)."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = []
    for i, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": i is not None and first[t] < i}
        good, toxic = (any(i is not None and x[0] == i and x[k] == 1 for x in labels) for k in (1, 2))
        fails.append((lang or "", {k for k, v in f.items() if v}, good, toxic))
    out, shapley = {}, defaultdict(int)
    for part in {x[0] for x in fails}:
        own = [x[1:] for x in fails if x[0] == part]
        for order in permutations("ABCDE"):
            for s, name in enumerate(order):
                before = set(order[:s])
                removed = [x for x in own if name in x[0] and not before & x[0]]
                shapley[part, name] += len(removed)
                kept = sum(not (before | {name}) & x[0] for x in own)
                redundant = sum(name in x[0] and bool(before & x[0]) for x in own)
                out[part, "".join(order), s + 1] = [kept, len(removed), redundant, sum(x[0] == {name} for x in own), sum(x[1] for x in removed), sum(x[2] for x in removed)]
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def filter_rows():
    rng = random.Random(11)
    make = lambda: " ".join(rng.choice(["alpha", "Beta", "GAMMA", "delta$", "x", "é", "y\x0bz"]) + (str(rng.random()) if rng.random() < 0.7 else "") for _ in range(rng.choice([3, 99, 100, 140])))
    rows = [(i, make(), rng.choice(["en", "fr", None, ""])) for i in range(60)]
    rows += [(rng.randint(60, 90), rng.choice(rows)[1], rng.choice(["en", "de"])) for _ in range(40)]  # copies, ids repeated
    rows += [(100, None, "en"), (101, "", None), (None, "", "fr"), (None, rows[0][1], "en"), (102, "word " * 50_000, "en"), (0, rows[0][1], "en"), (103, "A" + "b" * 9, "xx"), (104, "AB" + "b" * 9, "xx")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 110, 2)] + [(2, 0, 0), (2, 1, 1), (None, 1, 1), (5000, 1, 1)]
    return rows, labels


def test_filter_audit_against_brute_force(spark, tmp_path):
    rows, labels = filter_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in ("part", "digest", "mask", "first", "good", "toxic", "cells"):
        docs = docs.withColumn(c, F.lit("clash"))
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("clash")).write.parquet(f"{tmp_path}/labels.parquet")
    got = audit.op13_filter_audit(spark, str(tmp_path))
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == audit_brute(rows, labels)


def test_filter_audit_of_odd_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(audit.histograms(audit.masked(docs), labels)).count() == 0
    one = spark.createDataFrame([(None, None, None)], "doc_id long, text string, lang string")
    got = audit.interactions(audit.histograms(audit.masked(one), labels)).collect()
    assert len(got) == 600 and {r.part for r in got} == {""} and sum(r.removed for r in got) == 120  # by A, in each order
    many = spark.createDataFrame([(k, "x", f"part {k}") for k in range(700)], "doc_id long, text string, lang string")
    got = audit.interactions(audit.histograms(audit.masked(many), labels)).groupBy("part").agg(F.sum("removed").alias("n")).collect()
    assert len(got) == 700 and {r.n for r in got} == {120}  # more parts than a task takes at a time


def test_step_matrices_add_up():
    orders, m = audit.step_matrices(5)
    assert len(orders) == 120 and all(m[k].shape == (32, 600) for k in ("kept", "removed", "redundant", "unique_fails"))
    by_order = lambda k: m[k].reshape(32, 120, 5)
    assert (by_order("removed").sum(2) + by_order("kept")[:, :, -1] == 1).all()  # each document is removed once or kept
    shapley = m["removed"] @ m["own"]
    assert all(shapley[mask, f] == (120 // bin(mask).count("1") if mask >> f & 1 else 0) for mask in range(32) for f in range(5))
