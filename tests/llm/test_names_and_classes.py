"""Columns whose names the operators use inside, and classes of near duplicates that share a name of 64 bits."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.llm import audit, langid, linededup, mixing, neardup, packing, pii, prefixtrie
from clausewright.llm import common as C

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = [
    "row", "_row", "_id", "_source", "_size", "_rows", "_copies", "_each", "_nth", "_salt", "_parts", "_part", "_n", "_before", "_group", "_others", "_class", "_ahead", "_rank", "_at", "_offset", "n", "rank",
    "_spans", "_pii_key", "_pii_nth", "spans", "kind", "start", "finish", "base", "takes", "score", "lang_pred", "mixture", "_text", "target", "source_size", "copies", "size", "length", "sequence_id", "offset", "cid", "twin", "x", "key", "part", "mask", "digest",
]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"write to a{i}@b.org about word{i} and some more", "en", "s" if i % 2 else None, 1) for i in range(12)] + [(3, None, None, "s", 0), (3, None, None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    return docs.select("*", *[F.lit("clash").alias(n) for n in NAMES])


def test_language(clashing):
    got = langid.identify(clashing, langid.learn(clashing))
    assert len(got.columns) == len(set(got.columns)) == len(clashing.columns) and {r._text for r in got.collect()} == {"clash"}


def test_personal_data(clashing):
    got = pii.redacted(clashing)
    assert got.columns == clashing.columns
    rows = got.collect()
    assert sorted(r.text for r in rows if r.text) == sorted(f"write to [EMAIL] about word{i} and some more" for i in range(12)) and {r._spans for r in rows} == {"clash"} and len(rows) == 14


def test_mixing(clashing):
    got = mixing.mixed(clashing)
    assert got.columns == clashing.columns and {r._copies for r in got.collect()} == {"clash"}
    plain = mixing.mixed(clashing.select("doc_id", "text", "lang", "source", "n_chars"))
    assert abs(got.count() - plain.count()) <= 4
    sized = C.cut(clashing.withColumn("size", mixing.word_count(F.col("text"))))
    made = mixing.copies(sized)
    assert len(made.columns) == len(set(made.columns)) and {r._at for r in made.collect()} == {"clash"} and made.schema["target"].dataType.simpleString() == "double"


def test_packing(clashing):
    pieces = C.cut(packing.pieces(clashing.select("doc_id", "text")))
    more = pieces.select("*", *[F.lit("clash").alias(n) for n in NAMES if n not in pieces.columns])
    got = packing.place(C.cut(more)).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) == 14 and {r._rank for r in got} == {"clash"}


def test_others(clashing):
    assert neardup.near_duplicates(clashing).count() == 14
    assert linededup.without_repeated(clashing).count() == 14
    assert audit.masked(clashing.drop("part").withColumn("part", F.lit("p")), "lang").count() == 14
    turns = clashing.select(F.col("doc_id").alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text", *[n for n in NAMES])
    assert prefixtrie.turn_paths(turns).count() == 12


def test_classes_that_share_a_name(spark, monkeypatch):
    """All sets get one of two names; texts that are unlike stay apart, copies together."""
    real = neardup._class_id

    def poor(one, two, renamed=frozenset()):
        name, twin = real(one, two)
        return (real(two, one)[0] if name % 2 in renamed else name % 2), twin

    monkeypatch.setattr(neardup, "_class_id", poor)
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(6)]
    docs = spark.createDataFrame([(k, texts[k % 6]) for k in range(12)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert got == {k: k % 6 for k in range(12)}


def test_class_ids_are_slices_of_one_digest():
    one, two = np.array([1, 2], dtype=np.uint64), np.array([3, 4], dtype=np.uint64)
    digest = hashlib.blake2b(one.tobytes() + two.tobytes(), digest_size=24).digest()
    name, twin = neardup._class_id(one, two)
    assert name.to_bytes(8, "little", signed=True) + twin.to_bytes(8, "little", signed=True) == digest[:16]
    assert neardup._class_id(one, two, frozenset([name])) == (int.from_bytes(digest[16:], "little", signed=True), twin)
