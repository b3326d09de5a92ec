"""Pairs of clauses to conflicts: structured, temporal and inferred signals, and what is made of pairs afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions import text as T
from . import clauses as C
from .pairing import cells, measured, paired
from .repeated import coded, numbered, once
from .tables import kept

BATCH = {"weights": (0.95, 0.05, 0.0), "threshold": 0.71}
INTERACTIVE = {"weights": (0.25, 0.25, 0.50), "threshold": 0.50}


def prepared(clauses: DataFrame) -> DataFrame:
    """clauses with what pairs are compared by, made once for each clause: gram weights, durations, stems."""
    x = F.col("text")
    return clauses.withColumns({"grams": X.gram_weights(x), "cgrams": X.gram_weights(F.col("condition"), False, False), "times": T.durations(x), "stems": T.stem_tokens(x), "negated": T.contains_negation(x)})


def pairs_within(clauses: DataFrame, ordered: bool = False) -> DataFrame:
    """Pairs a.*, b.* of the clauses of a document: each once (a before b), or both ways."""
    a, b = clauses.alias("a"), clauses.alias("b")
    test = F.col("a.clause_id") != F.col("b.clause_id") if ordered else F.col("a.rn") < F.col("b.rn")
    return a.join(b, (F.col("a.document_id") == F.col("b.document_id")) & test)


def analyzed(pairs: DataFrame, similarity: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """pairs of prepared and extracted clauses (a.*, b.*) with the structured features, score, type and reasons."""
    a, b = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    sem = similarity if similarity is not None else X.pair_cosine(a("grams"), b("grams"))
    have = pairs.columns
    context = lambda side: F.coalesce(T.absent(F.col(f"{side}.context_text")), F.col(f"{side}.text")) if have.count("context_text") == 2 else F.col(f"{side}.text")
    found = [c for c in ("retrieval_score", "retrieval_rank") if have.count(c) == 1]
    rows = pairs.select(
        context("a").alias("hypothesis"), context("b").alias("evidence"), *found, a("document_id").alias("document_id"), a("clause_id").alias("clause_a"), b("clause_id").alias("clause_b"), a("text").alias("text_a"), b("text").alias("text_b"),
        a("party").alias("party_a"), b("party").alias("party_b"), a("modality").alias("modality_a"), b("modality").alias("modality_b"),
        sem.alias("semantic_similarity"), X.modality_conflict(a("modality"), b("modality")).alias("modality_conflict"), (a("negated") != b("negated")).cast("double").alias("negation_conflict"),
        X.same_party(a("party"), b("party")).alias("same_party"), X.pair_cosine(a("cgrams"), b("cgrams")).alias("condition_similarity"),
        a("times").alias("times_a"), b("times").alias("times_b"), a("stems").alias("stems_a"), b("stems").alias("stems_b"),
    )
    return _scored(rows, threshold)


def _scored(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """rows of pairs with their features, and what these come to."""
    c = F.col
    rows = rows.withColumn("structured_score", X.structured_score(c("semantic_similarity"), c("modality_conflict"), c("negation_conflict"), c("same_party"), c("condition_similarity")))
    rows = rows.withColumn("structured_type", X.conflict_type(c("modality_a"), c("modality_b"), c("negation_conflict"), c("semantic_similarity")))
    rows = rows.withColumn("is_structured_conflict", (c("structured_score") >= threshold) & (c("structured_type") != "no_clear_conflict"))
    return rows.withColumn("reasons", X.reasons(c("structured_type"), c("modality_conflict"), c("negation_conflict"), c("same_party"), c("condition_similarity"), c("semantic_similarity")))


#: Items of all numbered texts up to which they are sent to all executors as arrays; lists of durations up to which all pairs are.
CELLS = 1_000_000
SPANS = 1_000


def _listed(made: DataFrame, column: str) -> DataFrame:
    """(tid, term, weight) of the items of a column's arrays, each once."""
    return made.select("tid", F.explode(F.array_distinct(column)).alias("term")).withColumn("weight", F.lit(1.0))


def _gram_cells(made: DataFrame, column: str) -> DataFrame:
    """(tid, term, weight) of features.gram_weights()."""
    g = F.col(column)
    return made.select("tid", F.explode(g["keys"]).alias("term"), g["heavy"].alias("_h")).select("tid", "term", F.coalesce(F.try_element_at("_h", F.col("term")), F.lit(1.0)).alias("weight"))


def _sent_cells(made: DataFrame, tables: dict[str, DataFrame]):
    """The Cells of the tables, broadcast; None where one of them is too large."""
    n, out = made.count(), {}
    for name, weights in tables.items():
        out[name] = cells(weights, n, CELLS)
        if out[name] is None:
            return None
    return made.sparkSession.sparkContext.broadcast(out)


def _looked_up(pairs: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (ta, tb) with columns of facts (tid) of both texts, as c_a and c_b."""
    for s in "ab":
        pairs = pairs.join(F.broadcast(facts.select(F.col("tid").alias(f"t{s}"), *[F.col(c).alias(f"{c}_{s}") for c in columns])), f"t{s}")
    return pairs


def _by_number(texts: DataFrame):
    """Of numbered texts what belongs to each, whether the durations of two differ, and what all have in common, broadcast;
    None where these are many."""
    made = kept(prepared(C.extract(texts.drop("n"))))
    spans = made.groupBy("times").agg(F.count(F.lit(1)).alias("n")).drop("n")
    sent = _sent_cells(made, {"grams": _gram_cells(made, "grams"), "cgrams": _gram_cells(made, "cgrams"), "stems": _listed(made, "stems")}) if spans.count() <= SPANS else None
    if sent is None:
        return None
    spans = kept(spans.withColumn("span", F.row_number().over(Window.orderBy("times"))))  # few, as counted
    one, two = (spans.select(F.col("span").alias(f"span_{s}"), F.col("times").alias(f"_{s}")) for s in "ab")
    differ = one.crossJoin(F.broadcast(two)).select("span_a", "span_b", X.differing(F.col("_a"), F.col("_b")).alias("differ"))
    facts = made.join(F.broadcast(spans.withColumnRenamed("times", "_times")), F.col("times").eqNullSafe(F.col("_times"))).drop("_times")
    return facts, differ, sent


def _analyzed_numbers(pairs: DataFrame, facts: DataFrame, differ: DataFrame, own: list[str], threshold: float, more: tuple[str, ...] = ()) -> DataFrame:
    """pairs by the numbers of their texts (a_clause_id, b_clause_id, ta, tb, semantic_similarity, condition_similarity, shared, more...)
    as analyzed() gives them, with the temporal result."""
    pairs = _looked_up(pairs, facts, ["text", "party", "modality", "negated", "times", "stems", "span"]).join(F.broadcast(differ), ["span_a", "span_b"])
    c = F.col
    context = lambda s: F.coalesce(T.absent(c(f"{s}_context_text")), c(f"text_{s}")) if own else c(f"text_{s}")
    party = X.same_party(c("party_a"), c("party_b"))
    shared = F.array_sort(F.array_intersect("stems_a", "stems_b"))
    temporal = X.temporal_result(c("differ"), shared, c("shared") > 0, party, c("modality_a"), c("modality_b"))
    rows = pairs.select(
        context("a").alias("hypothesis"), context("b").alias("evidence"), *more, "document_id", c("a_clause_id").alias("clause_a"), c("b_clause_id").alias("clause_b"), "text_a", "text_b", "party_a", "party_b", "modality_a", "modality_b",
        "semantic_similarity", X.modality_conflict(c("modality_a"), c("modality_b")).alias("modality_conflict"), (c("negated_a") != c("negated_b")).cast("double").alias("negation_conflict"), party.alias("same_party"), "condition_similarity",
        "times_a", "times_b", "stems_a", "stems_b", temporal.alias("temporal"), temporal["score"].alias("temporal_score"), temporal["type"].alias("temporal_type"),  # the list of terms only where it is asked for
    )
    return _scored(rows, threshold)


def analyzed_within(clauses: DataFrame, threshold: float = 0.5, most: int | None = None) -> DataFrame:
    """analyzed() of the pairs of a document's clauses (document_id, rn, clause_id, text[, context_text]), each once.

    Where texts come again and again, a pair is measured by the numbers of its texts: what both have in common over arrays,
    all else is looked up. The temporal result is there too."""
    texts = numbered(clauses, most)
    by = None if texts is None else _by_number(texts)
    if by is None:
        return analyzed(pairs_within(prepared(C.extract(clauses))), threshold=threshold)
    facts, differ, sent = by

    def measures(a, b):
        x = sent.value
        return x["grams"].cosines(a, b), x["cgrams"].cosines(a, b), x["stems"].shared(a, b)

    own = [c for c in ("context_text",) if c in clauses.columns]
    rows = coded(clauses.select("document_id", F.col("rn").alias("ord"), "clause_id", "text", *own), texts)
    pairs = paired(rows, ("clause_id", *own), measures, ("semantic_similarity", "condition_similarity", "shared"))
    return _analyzed_numbers(pairs, facts, differ, own, threshold)


def analyzed_retrieved(clauses: DataFrame, scores, k: int, alike: bool = False, threshold: float = 0.5, most: int | None = None) -> DataFrame | None:
    """analyzed() of each clause with the k best others of its document, with retrieval_score and retrieval_rank, and with the
    temporal result; None where texts are many. scores(texts) gives a function of arrays of numbers of texts, from 0, or
    None. alike: the semantic similarity is the retrieval's score. Nothing but clauses goes through a shuffle; rows that
    share a clause_id are clauses of their own."""
    texts = numbered(clauses, most)
    score = None if texts is None else scores(texts)
    by = None if score is None else _by_number(texts)
    if by is None:
        return None
    facts, differ, sent = by

    def measures(a, b):
        x = sent.value
        return *(() if alike else (x["grams"].cosines(a, b),)), x["cgrams"].cosines(a, b), x["stems"].shared(a, b)

    own = [c for c in ("context_text",) if c in clauses.columns]
    rows = coded(clauses.select("document_id", F.col("clause_id").alias("ord"), "clause_id", "text", *own), texts)
    pairs = paired(rows, ("clause_id", *own), score, ("retrieval_score",), "both", best=k, by="retrieval_score", long=True).withColumnRenamed("rank", "retrieval_rank").drop("back")
    pairs = measured(pairs, measures, (*(() if alike else ("semantic_similarity",)), "condition_similarity", "shared"))
    pairs = pairs.withColumn("semantic_similarity", F.col("retrieval_score")) if alike else pairs
    return _analyzed_numbers(pairs, facts, differ, own, threshold, ("retrieval_score", "retrieval_rank"))


def named_within(clauses: DataFrame) -> DataFrame:
    """(clause_a, clause_b) of the pairs that analyzed_within() measures, for what asks for no measure."""
    rows = clauses.select("document_id", F.col("rn").alias("ord"), "clause_id", F.lit(1).alias("tid"))
    return paired(rows, ("clause_id",), None).select(F.col("a_clause_id").alias("clause_a"), F.col("b_clause_id").alias("clause_b"))


def inference_pairs(rows: DataFrame) -> DataFrame:
    """Of analyzed() rows what a language-inference model is given, and whether context was used.

    hypothesis and evidence are the texts with the context of their parents where there is one, else the texts."""
    own = [F.col("text_b").alias("clause_text"), F.col("clause_b").alias("clause_id"), "document_id", F.col("clause_a").alias("query_clause_id")]
    found = [c for c in ("retrieval_rank", "retrieval_score") if c in rows.columns]
    used = [(F.col("hypothesis") != F.col("text_a")).alias("query_context_used"), (F.col("evidence") != F.col("text_b")).alias("candidate_context_used")]
    return rows.select("hypothesis", "evidence", *own, *found, F.col("text_a").alias("query_text"), F.col("text_b").alias("candidate_text"), *used)


def rule_inference(rows: DataFrame) -> DataFrame:
    """Stand-in for a language-inference model, by rule: never to be reported as a model's quality."""
    p = F.when(((F.col("modality_conflict") == 1) | (F.col("negation_conflict") == 1)) & F.col("same_party"), 0.90).otherwise(0.05)
    return rows.withColumn("probabilities", F.array((1 - p) / 2, (1 - p) / 2, p)).withColumn("nli_label", F.when(p > 0.5, "Contradiction").otherwise("NotMentioned"))


def hybrid(rows: DataFrame, weights=BATCH["weights"], threshold: float = BATCH["threshold"]) -> DataFrame:
    """analyzed() rows with probabilities and nli_label, and the temporal and hybrid results."""
    c = F.col
    if "temporal" not in rows.columns:
        rows = rows.withColumn("temporal", X.temporal_conflict(c("times_a"), c("times_b"), c("stems_a"), c("stems_b"), c("party_a"), c("party_b"), c("modality_a"), c("modality_b")))
        rows = rows.withColumn("temporal_score", c("temporal.score")).withColumn("temporal_type", c("temporal.type"))
    rows = rows.withColumn("p_contradiction", X.contradiction_probability(c("probabilities"), c("nli_label")))
    rows = rows.withColumn("hybrid_score", X.hybrid_score(c("p_contradiction"), c("structured_score"), c("temporal_score"), weights))
    rows = rows.withColumn("conflict_type", X.final_type(c("structured_type"), c("temporal_score"), c("temporal_type")))
    rows = rows.withColumn("explanation", X.hybrid_reasons(c("nli_label"), c("p_contradiction"), c("structured_score"), c("structured_type"), c("temporal_score"), c("temporal_type")))
    return rows.withColumn("is_conflict", c("hybrid_score") >= threshold).withColumn("confidence_level", X.confidence_level(c("hybrid_score")))


def first_of_pair(rows: DataFrame, order: list[str], a: str = "clause_a", b: str = "clause_b") -> DataFrame:
    """Of a pair in both directions the first in that order."""
    if "back" in rows.columns and order == [a, b]:  # the rank the other way is known: nothing has to be brought together
        return rows.where(F.col("back").isNull() | (F.col(a) < F.col(b)))
    w = Window.partitionBy(F.least(a, b), F.greatest(a, b)).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def best_of_pair(rows: DataFrame, score: str, order: list[str], a: str = "clause_a", b: str = "clause_b") -> DataFrame:
    """Of a pair in both directions the one with the better score; the first in that order among equals."""
    w = Window.partitionBy(F.least(a, b), F.greatest(a, b)).orderBy(F.desc(score), *order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def better_ranked_of_pair(rows: DataFrame, a: str = "clause_a", b: str = "clause_b") -> DataFrame:
    """Of a pair in both directions the one with the better rank; the one from the smaller id among equals."""
    if "back" not in rows.columns:
        return best_of_pair(rows.withColumn("_better", -F.col("rank")), "_better", [a, b], a, b).drop("_better")
    c = F.col
    return rows.where(c("back").isNull() | (c("rank") < c("back")) | ((c("rank") == c("back")) & (c(a) < c(b))))


def graph_conflicts(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("is_conflict") & (F.col("conflict_type") != "no_clear_conflict"))


def with_texts(rows: DataFrame, clauses: DataFrame, a: str = "clause_a", b: str = "clause_b", missing: str = "[CLAUSE TEXT NOT FOUND]") -> DataFrame:
    """rows with both texts looked up; what isn't there gets the default."""
    for key, name in ((a, "found_a"), (b, "found_b")):
        side = clauses.select(F.col("clause_id").alias(key), F.col("text").alias(name))
        rows = rows.join(side, key, "left").withColumn(name, F.coalesce(name, F.lit(missing)))
    return rows


def _draft_facts(texts: DataFrame) -> DataFrame:
    """texts (text) with what pairs of drafts are compared by."""
    x = F.col("text")
    return texts.withColumns({
        "mod": T.draft_modality(x), "parties": T.draft_parties(x), "conds": T.draft_conditions(x), "prop": T.proposition_tokens(x), "core": T.core_tokens(T.normalize_proposition(x)), "clean": T.clean_proposition(x),
        "said": T.core_tokens(T.clean_proposition(x)), "exc": T.exception_flag(x), "grams": X.gram_weights(x), "no": T.negated_modal(x), "yes": T.affirmed_modal(x),
    })


def pairs_with(clauses: DataFrame, make, test: Column | None = None, most: int | None = None) -> DataFrame:
    """Pairs a.*, b.* of the clauses of a document, each once, with the columns that make(texts) adds to text, test holding.

    Where texts come again and again, pairs are made of their numbers and what belongs to these is looked up afterwards."""
    texts = numbered(clauses, most)
    pairs = pairs_within(make(clauses) if texts is None else coded(clauses, texts))
    pairs = pairs if test is None else pairs.where(test)
    if texts is None:
        return pairs
    made = make(texts.drop("n"))
    more = [c for c in made.columns if c != "tid"]
    keep = [c for c in clauses.columns if c != "text"]
    pairs = pairs.select(*[F.col(f"{s}.{c}").alias(f"_{s}_{c}") for s in "ab" for c in [*keep, "tid"]])
    for s in "ab":
        facts = F.broadcast(made.select(F.col("tid").alias(f"_{s}_tid"), *[F.col(c).alias(f"_{s}_{c}") for c in more]))
        pairs = pairs.join(facts, f"_{s}_tid")
    return pairs.select(*[F.struct(*[F.col(f"_{s}_{c}").alias(c) for c in [*keep, *more]]).alias(s) for s in "ab"])


def _draft_features(pairs: DataFrame) -> DataFrame:
    """What pairs a.*, b.* with _draft_facts() are like."""
    a, b = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    return pairs.select(
        a("clause_id").alias("clause_a"), b("clause_id").alias("clause_b"), a("mod").alias("mod_a"), b("mod").alias("mod_b"),
        X.pair_cosine(a("grams"), b("grams")).alias("sem"), X.jaccard(a("prop"), b("prop")).alias("prop"), X.modality_conflict(a("mod"), b("mod")).alias("mod"), T.opposed(a("no"), a("yes"), b("no"), b("yes")).cast("double").alias("neg"),
        X.jaccard(a("conds"), b("conds"), 1.0).alias("cond"), X.jaccard(a("parties"), b("parties"), 1.0).alias("party"), X.overlap_coefficient(a("prop"), b("prop")).alias("overlap"),
        X.jaccard(a("core"), b("core")).alias("core"), a("text").alias("text_a"), b("text").alias("text_b"), F.greatest(a("exc"), b("exc")).alias("exception"), X.scope_compatibility(a("conds"), b("conds")).alias("scope"), X.draft_similarity(a("clean"), a("said"), b("clean"), b("said")).alias("prop_similarity"),
    )


def _numbered_drafts(clauses: DataFrame, most: int | None = None) -> DataFrame | None:
    """_draft_features() of the pairs of a document's clauses, by the numbers of their texts; None where these are many."""
    texts = numbered(clauses, most)
    if texts is None:
        return None
    sets = ("prop", "conds", "parties", "core", "said")
    made = kept(_draft_facts(texts.drop("n")))
    sent = _sent_cells(made, {"grams": _gram_cells(made, "grams")} | {n: _listed(made, n) for n in sets})
    if sent is None:
        return None

    def measures(a, b):
        return sent.value["grams"].cosines(a, b), *[sent.value[n].shared(a, b) for n in sets]

    rows = coded(clauses.select("document_id", F.col("rn").alias("ord"), "clause_id", "text"), texts)
    pairs = paired(rows, ("clause_id",), measures, ("sem", *[f"both_{n}" for n in sets]))
    facts = made.select("tid", "text", "mod", "no", "yes", "exc", "clean", *[F.size(F.array_distinct(n)).alias(f"n_{n}") for n in sets], F.size("prop").alias("len_prop"))
    pairs = _looked_up(pairs, facts, ["text", "mod", "no", "yes", "exc", "clean", "len_prop", *[f"n_{n}" for n in sets]])
    c = F.col

    def jaccard(n: str, both_empty: float = 0.0) -> Column:
        union = c(f"n_{n}_a") + c(f"n_{n}_b") - c(f"both_{n}")
        return F.when(union == 0, both_empty).otherwise(F.try_divide(f"both_{n}", union))

    least, none = F.least("len_prop_a", "len_prop_b"), lambda s: c(f"n_conds_{s}") == 0
    return pairs.select(
        c("a_clause_id").alias("clause_a"), c("b_clause_id").alias("clause_b"), "mod_a", "mod_b", "sem", jaccard("prop").alias("prop"), X.modality_conflict(c("mod_a"), c("mod_b")).alias("mod"),
        T.opposed(c("no_a"), c("yes_a"), c("no_b"), c("yes_b")).cast("double").alias("neg"), jaccard("conds", 1.0).alias("cond"), jaccard("parties", 1.0).alias("party"),
        F.when(least > 0, F.try_divide(F.when(c("len_prop_a").isNotNull() & c("len_prop_b").isNotNull(), c("both_prop")), least)).otherwise(0.0).alias("overlap"), jaccard("core").alias("core"), "text_a", "text_b", F.greatest("exc_a", "exc_b").alias("exception"),
        F.when(none("a") & none("b"), 1.0).when(none("a") | none("b"), 0.5).when(c("both_conds") > 0, 1.0).otherwise(0.0).alias("scope"),
        F.when((c("clean_a") == c("clean_b")) & (c("clean_a") != ""), 1.0).otherwise(jaccard("said")).alias("prop_similarity"),
    )


def draft_pairs(clauses: DataFrame, group: str | None = None, most: int | None = None) -> DataFrame:
    """Pairs of a document's clauses (of its groups in a column, such as label_id) with the drafts' features and scores."""
    narrow = clauses.select("document_id", "rn", "clause_id", "text", *([F.col(group).alias("_group")] if group else []))
    rows = _numbered_drafts(narrow, most) if group is None else None
    if rows is None:
        rows = _draft_features(pairs_with(narrow, _draft_facts, F.col("a._group") == F.col("b._group") if group else None, most))
    c = F.col
    similar = c("prop_similarity")
    rows = rows.withColumns(X.draft_scores(c("sem"), similar, c("mod"), c("neg"), c("cond"), c("party"), c("overlap"), c("prop"), c("core"), c("exception")))
    later = X.later_scores(
        c("mod"), c("neg"), c("cond"), c("party"), c("prop"), c("core"), c("scope"), c("strict_conflict_score"), c("aligned_conflict_score"), c("scope_aware_score"),
        c("clause_reasoning_score"), c("clause_reasoning_score"),
    )
    classes = {
        "structured_class": X.draft_class(c("sem"), similar, c("mod"), c("neg")), "final_class": X.draft_class(c("sem"), similar, c("mod"), c("neg"), c("cond")),
        "conflict_category": X.conflict_category(c("mod"), c("core"), c("exception")), "explanation_basis": X.draft_reasons(c("mod_a"), c("mod_b"), c("mod"), c("neg"), c("scope"), c("core"), c("prop"), c("cond")),
    }
    return rows.withColumns(later | classes)


def evidence_records(rows: DataFrame, score: str = "final_conflict_score_3") -> DataFrame:
    """Pairs as records of evidence: both clauses, their modalities, a conflict score and its explanation."""
    return rows.select("clause_a", "clause_b", "text_a", "text_b", F.col("mod_a").alias("modality_a"), F.col("mod_b").alias("modality_b"), F.col(score).alias("conflict_score"), F.col("explanation_basis").alias("explanation"))


def clause_combinations(clauses: DataFrame, sample: int | None = None) -> DataFrame:
    """Pairs of a document's clauses that have a modality, each once with the facts of both; of sample documents in the
    order of a hash of their ids, if given."""
    x = F.col("text")
    if sample is not None:
        some = clauses.select("document_id").distinct().orderBy(F.md5(F.col("document_id").cast("string")), "document_id").limit(sample)
        clauses = clauses.join(F.broadcast(some) if sample <= 100_000 else some, "document_id", "left_semi")
    facts = {"modality": T.draft_modality(x), "negation": T.draft_negation(x), "temporal": T.times(x), "numbers": T.numbers(x), "parties": T.draft_parties(x), "conditions": T.draft_conditions(x, True)}
    made = clauses.select("document_id", "rn", "clause_id", "text", *[v.alias(k) for k, v in facts.items()]).where("modality <> 'none'")
    pairs = pairs_within(made)
    return pairs.select(F.col("a.document_id"), *[F.col(f"{side}.{c}").alias(f"{c}_{side}") for side in "ab" for c in ("clause_id", "text", *facts)])


def candidate_conflicts(rows: DataFrame, least: float = 0.15, strong: float = 0.30) -> DataFrame:
    """Pairs (sem, mod, neg) from a similarity of least, with strong_candidate: similar still more, and in conflict."""
    sem = F.round("sem", 9)
    return rows.where(sem >= least).withColumn("strong_candidate", (sem >= strong) & ((F.col("mod") == 1) | (F.col("neg") == 1)))


def clause_facts(keys: DataFrame, clauses: DataFrame) -> DataFrame:
    """keys (document_id, span_id) with conditions, temporal, numbers and parties of that clause; empty where it is not there.

    Of several clauses of one key the first by text counts."""
    names = ("conditions", "temporal", "numbers", "parties")
    one = clauses.groupBy("document_id", "span_id").agg(F.min_by(F.struct(*names), "text").alias("f"))
    held = keys.join(one, ["document_id", "span_id"], "left")
    return held.select("document_id", "span_id", *[F.coalesce(F.col(f"f.{n}"), F.array().cast("array<string>")).alias(n) for n in names])


def structured_facts(texts: DataFrame) -> DataFrame:
    x = F.col("text")
    return texts.withColumns({
        "modality": T.draft_modality(x), "negation": T.draft_negation(x), "conditions": T.draft_conditions(x), "temporal": T.times(x), "numbers": T.numbers(x), "parties": T.draft_parties(x),
        "proposition": T.clean_proposition(x),
    })


def structured_clauses(clauses: DataFrame) -> DataFrame:
    """clauses (text) with the drafts' structured features."""
    return once(clauses, structured_facts)
