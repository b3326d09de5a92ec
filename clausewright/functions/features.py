"""Pair features and conflict scores: closed-form expressions over two clauses, inside the JVM. Constants are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: idf of a term that one of two texts has: 1 + ln(3/2).
ALONE = 1.4054651081081644


def grams(x: Column, bigrams: bool = True, accents: bool = True) -> Column:
    """Tokens of two word characters or more, and pairs of neighbours; without accents, letters lose theirs first."""
    x = x if accents else T.strip_accents(x)
    tokens = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    if not bigrams:
        return tokens

    def both(t: Column) -> Column:
        pairs = F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.when(F.size(t) > 1, F.concat(t, pairs)).otherwise(t)

    return bound(tokens, both)


def bound(x: Column, f) -> Column:
    """f of x, with x computed once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def gram_weights(x: Column, bigrams: bool = True, sublinear: bool = True) -> Column:
    """The grams of a text as struct(keys: their 64-bit hashes, heavy: map of the weights of those that occur more than
    once, squares: sum of all squared weights). A gram that occurs once weighs 1."""
    none = F.array().cast("array<bigint>")

    def weigh(g: Column) -> Column:
        n = lambda k: F.size(F.filter(g["all"], lambda y: y == k)).cast("double")
        often = F.when(F.size(g["all"]) == F.size(g["keys"]), none).otherwise(F.filter(g["keys"], lambda k: n(k) > 1))
        weight = lambda k: 1 + F.log(n(k)) if sublinear else n(k)
        heavy = bound(often, lambda o: F.map_from_arrays(o, F.transform(o, weight)))
        squares = lambda h: F.size(g["keys"]) + F.aggregate(F.map_values(h), F.lit(0.0), lambda s, v: s + v * v - 1)
        return bound(heavy, lambda h: F.struct(g["keys"].alias("keys"), h.alias("heavy"), squares(h).alias("squares")))

    return bound(bound(F.transform(grams(x, bigrams), lambda w: F.xxhash64(w)), lambda h: F.struct(h.alias("all"), F.array_distinct(h).alias("keys"))), weigh)


def pair_cosine(a: Column, b: Column) -> Column:
    """TF-IDF cosine of the gram_weights() of two texts that are the corpus; 0 if either has no gram.

    Shared grams count 1 each, but for those that one of the texts has more than once."""
    none = F.array().cast("array<bigint>")
    weight = lambda m, k: F.coalesce(F.try_element_at(m["heavy"], k), F.lit(1.0))

    def cosine(e: Column) -> Column:
        more = lambda f: F.size(e["shared"]) + F.aggregate(e["often"], F.lit(0.0), lambda s, k: s + f(k) - 1)
        norm = lambda m: bound(more(lambda k: weight(m, k) * weight(m, k)), lambda both: both + F.lit(ALONE**2) * (m["squares"] - both))
        return more(lambda k: weight(a, k) * weight(b, k)) / F.sqrt(norm(a) * norm(b))

    def with_often(shared: Column) -> Column:
        plain = (F.size(a["heavy"]) == 0) & (F.size(b["heavy"]) == 0)
        often = F.when(plain, none).otherwise(F.array_intersect(shared, F.array_union(F.map_keys(a["heavy"]), F.map_keys(b["heavy"]))))
        return bound(F.struct(shared.alias("shared"), often.alias("often")), cosine)

    return F.when((F.size(a["keys"]) > 0) & (F.size(b["keys"]) > 0), bound(F.array_intersect(a["keys"], b["keys"]), with_often)).otherwise(F.lit(0.0))


def modality_conflict(a: Column, b: Column) -> Column:
    a, b = F.lower(a), F.lower(b)
    hit = ((a == "prohibition") & b.isin("obligation", "permission")) | ((b == "prohibition") & a.isin("obligation", "permission"))
    return F.coalesce(hit, F.lit(False)).cast("double")


def negation_conflict(text_a: Column, text_b: Column) -> Column:
    return (T.contains_negation(text_a) != T.contains_negation(text_b)).cast("double")


def same_party(a: Column, b: Column) -> Column:
    return F.coalesce((T.absent(F.lower(a)) == T.absent(F.lower(b))), F.lit(False))


def condition_similarity(a: Column, b: Column) -> Column:
    both = T.absent(a).isNotNull() & T.absent(b).isNotNull()
    return F.when(both, pair_cosine(gram_weights(a, False, False), gram_weights(b, False, False))).otherwise(0.0)


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def structured_score(sem: Column, mod: Column, neg: Column, party: Column, cond: Column) -> Column:
    return clamp01(sem * 0.35 + mod * 0.30 + neg * 0.20 + party.cast("double") * 0.10 + cond * 0.05)


def conflict_type(mod_a: Column, mod_b: Column, neg: Column, sem: Column) -> Column:
    pair = lambda x, y: (mod_a == x) & (mod_b == y)
    out = F.when(pair("obligation", "prohibition"), "obligation_vs_prohibition").when(pair("prohibition", "obligation"), "prohibition_vs_obligation")
    out = out.when(pair("permission", "prohibition"), "permission_vs_prohibition").when(pair("prohibition", "permission"), "prohibition_vs_permission")
    return out.when(neg == 1, "positive_vs_negative").when(sem >= 0.40, "potential_semantic_conflict").otherwise("no_clear_conflict")


# --- fixed values: the sentences of explanations ------------------------------------------------------------------
PAIR_REASONS = (
    "the clauses discuss semantically related content", "their modalities indicate opposing obligations, permissions, or prohibitions", "one clause contains negation while the other does not",
    "the clauses refer to the same detected party", "their conditions are similar",
)
NO_REASON = "No strong structured conflict indicators were detected."
DRAFT_REASONS = ("opposing negation", "compatible legal scope", "similar core proposition", "substantial proposition overlap", "similar conditions")
NO_DRAFT_REASON = "semantic and structural conflict signals"
# --- end of fixed values ------------------------------------------------------------------------------------------


def fixed(x: Column, places: int) -> Column:
    """A number with so many places, halves of its decimal form to the even digit."""
    return F.bround(x.cast("decimal(38,17)"), places).cast(f"decimal(38,{places})").cast("string")


def reasons(kind: Column, mod: Column, neg: Column, party: Column, cond: Column, sem: Column) -> Column:
    """The explanation of a pair's structured result."""
    test = (sem >= 0.40, mod > 0, neg > 0, party, cond > 0.50)
    text = F.concat_ws("; ", *[F.when(t, F.lit(r)) for t, r in zip(test, PAIR_REASONS, strict=True)])
    return F.when(text == "", NO_REASON).otherwise(F.concat(F.lit("Potential conflict type: "), kind, F.lit(". "), text, F.lit(".")))


def hybrid_reasons(label: Column, p: Column, score: Column, kind: Column, temporal_score: Column, temporal_type: Column) -> Column:
    """The explanation of a pair's hybrid result, probabilities and scores to two places."""
    by_model = (
        F.when(label == "Contradiction", F.concat(F.lit("Legal-BERT detected contradiction with probability "), fixed(p, 2)))
        .when(label == "Entailment", F.concat(F.lit("Legal-BERT detected entailment with probability "), fixed(1 - p, 2)))
        .otherwise("Legal-BERT did not detect a strong contradiction")
    )
    found = F.when(score >= 0.50, "structured reasoning detected conflict indicators (score=").otherwise("structured reasoning found limited conflict indicators (score=")
    pattern = F.when(kind != "no_clear_conflict", F.concat(F.lit("conflict pattern: "), kind))
    temporal = F.when(temporal_score > 0, F.concat(F.lit("temporal analysis detected "), temporal_type, F.lit(" (score="), fixed(temporal_score, 2), F.lit(")")))
    return F.concat(F.lit("Hybrid reasoning: "), F.concat_ws("; ", by_model, F.concat(found, fixed(score, 2), F.lit(")")), pattern, temporal), F.lit("."))


def draft_reasons(mod_a: Column, mod_b: Column, mod: Column, neg: Column, scope: Column, core: Column, jac: Column, cond: Column) -> Column:
    first = F.when(mod == 1, F.concat(F.lit("modality conflict: "), mod_a, F.lit(" vs "), mod_b))
    test = (neg == 1, scope >= 0.8, core >= 0.4, jac >= 0.3, cond >= 0.7)
    text = F.concat_ws("; ", first, *[F.when(t, F.lit(r)) for t, r in zip(test, DRAFT_REASONS, strict=True)])
    return F.when(text == "", NO_DRAFT_REASON).otherwise(text)


def hybrid_score(p: Column, structured: Column, temporal: Column, weights=(0.95, 0.05, 0.0)) -> Column:
    if abs(sum(weights) - 1) > 1e-6:
        raise ValueError("the weights must sum to 1")
    return clamp01(p * weights[0] + structured * weights[1] + temporal * weights[2])


def ladder(score: Column, *steps: tuple[float, str], otherwise: str) -> Column:
    """The first name whose bound the score reaches."""
    out = F.lit(otherwise)
    for bound, name in sorted(steps):
        out = F.when(score >= bound, name).otherwise(out)
    return out


def confidence_level(score: Column) -> Column:
    return ladder(score, (0.75, "High"), (0.50, "Medium"), otherwise="Low")


def final_type(structured: Column, temporal_score: Column, temporal_type: Column) -> Column:
    known = F.when(T.absent(structured).isNotNull() & (structured != "unknown"), structured).otherwise("no_clear_conflict")
    return F.when(temporal_score > 0, temporal_type).otherwise(known)


def contradiction_probability(probabilities: Column, label: Column) -> Column:
    return F.when(F.size(probabilities) >= 3, F.get(probabilities, F.lit(2))).when(F.lower(label).contains("contrad"), 1.0).otherwise(0.0)


# --- sets ---------------------------------------------------------------------------------------------------------
def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, both_empty).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap_coefficient(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def share_of(found: Column, wanted: Column) -> Column:
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, found)) / F.size(wanted)).otherwise(0.0)


def legal_overlap(query: Column, candidate: Column) -> Column:
    """Of the query's legal terms, the share that the candidate has; both are word sets."""
    return share_of(candidate, F.array_intersect(query, F.array(*map(F.lit, T.LEGAL_TERMS))))


def modality_match(text: Column, query: Column, modality: Column, null_as_none: bool = True) -> Column:
    m = F.coalesce(T.absent(modality), F.lit("none")) if null_as_none else modality
    return F.coalesce(F.lower(text).contains(m) | F.array_contains(query, m), F.lit(False)).cast("double")


def scope_compatibility(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.5).when(F.arrays_overlap(a, b), 1.0).otherwise(0.0)


def draft_similarity(clean_a: Column, tokens_a: Column, clean_b: Column, tokens_b: Column) -> Column:
    """Of two propositions 1 if they are equal and not empty, else the Jaccard similarity of their words."""
    return F.when((clean_a == clean_b) & (clean_a != ""), 1.0).otherwise(jaccard(tokens_a, tokens_b))


# --- score families of the drafts: weights, penalties and bounds are fixed values -------------------------------------
def draft_scores(sem, prop, mod, neg, cond, party, overlap, jac, core, exception) -> dict[str, Column]:
    """The first families, from similarities (prop: of propositions) and conflicts of a pair."""
    aligned = (jac >= 0.30) & (mod == 1)
    penal = lambda x, test, by: F.when(test, x * by).otherwise(x)
    strict = penal(overlap * 0.55 + prop * 0.20 + mod * 0.15 + cond * 0.10, overlap < 0.35, 0.25)
    aligned_score = penal(penal(jac * 0.45 + prop * 0.25 + cond * 0.20 + party * 0.10, mod == 0, 0.10), jac < 0.30, 0.10)
    scope = penal(penal(penal(core * 0.45 + jac * 0.20 + mod * 0.20 + party * 0.15, mod == 0, 0.10), core < 0.30, 0.10), exception == 1, 0.60)
    return {
        "structured_score": sem * 0.40 + prop * 0.35 + mod * 0.25,
        "final_structured_score": sem * 0.25 + prop * 0.30 + mod * 0.20 + cond * 0.15 + party * 0.10,
        "structured_conflict_score": prop * 0.35 + mod * 0.25 + neg * 0.20 + cond * 0.10 + party * 0.10,
        "strict_conflict_score": strict, "aligned_conflict": aligned.cast("int"), "aligned_conflict_score": aligned_score, "scope_aware_score": scope,
        "clause_reasoning_score": core * 0.40 + jac * 0.20 + party * 0.15 + cond * 0.15 + mod * 0.10,
    }


def later_scores(mod, neg, cond, party, jac, core, scope, strict, aligned, scope_aware, reasoning, confidence) -> dict[str, Column]:
    """The later families over those of draft_scores(): five versions of the conflict score, evidence, novelty, flags."""
    first = core * 0.30 + jac * 0.20 + scope_aware * 0.20 + aligned * 0.15 + mod * 0.10 + neg * 0.05
    v1 = F.when(core < 0.25, first * 0.25).otherwise(first)
    v2 = core * 0.30 + jac * 0.20 + scope * 0.15 + mod * 0.20 + confidence * 0.15
    v3 = strict * 0.35 + aligned * 0.30 + scope_aware * 0.20 + mod * 0.10 + neg * 0.05
    v4 = core * 0.20 + jac * 0.10 + scope * 0.10 + strict * 0.25 + aligned * 0.10 + reasoning * 0.05 + mod * 0.10 + neg * 0.05 + cond * 0.025 + party * 0.025
    v5 = strict * 0.35 + aligned * 0.25 + mod * 0.20 + neg * 0.15 + scope * 0.05
    at = lambda x, least: F.round(x, 9) >= least  # noqa: E731  (whichever way x was summed)
    strong_modality = (mod == 1) & at(core, 0.30) & at(scope_aware, 0.50)
    evidence = core * 0.25 + jac * 0.15 + scope * 0.10 + strict * 0.15 + aligned * 0.15 + mod * 0.10 + neg * 0.05 + reasoning * 0.05
    similar = core * 0.35 + jac * 0.20 + scope * 0.15 + cond * 0.15 + party * 0.15
    signal = strict * 0.35 + aligned * 0.25 + mod * 0.20 + neg * 0.10 + reasoning * 0.10
    return {
        "final_conflict_score_1": v1, "final_conflict_score_2": v2, "final_conflict_score_3": v3, "final_conflict_score_4": v4, "final_conflict_score_5": v5,
        "strong_conflict": at(v1, 0.50) & (strong_modality | at(aligned, 0.50)), "candidate_conflict": at(v2, 0.30) & (at(core, 0.35) | at(jac, 0.30)) & (mod == 1),
        "hybrid_evidence_score": evidence, "novelty_conflict_score": evidence * 0.50 + v4 * 0.50, "novelty_evidence_score_1": similar * 0.60 + signal * 0.40,
        "novelty_evidence_score_2": (core * 0.50 + jac * 0.50) * 0.60 + (strict * 0.70 + aligned * 0.30) * 0.40, "novelty_evidence_score_3": (core * 0.5 + jac * 0.5) * 0.6 + (strict * 0.5 + aligned * 0.5) * 0.4,
    }


def mean_evidence(parts: list[Column]) -> Column:
    """The mean of the components that there are; 0 without any."""
    total = F.lit(0.0)
    for p in parts:
        total = total + T.safe_number(p)
    return total / len(parts) if parts else total


def normed_evidence(ml, strict, aligned, core, jac) -> Column:
    """Of components scaled to 0 to 1 over all pairs."""
    return ml * 0.40 + strict * 0.25 + aligned * 0.15 + core * 0.10 + jac * 0.10


def rerank_of(retrieval: Column, reasoning: Column) -> Column:
    return retrieval * 0.60 + reasoning * 0.40


def draft_class(sem: Column, prop: Column, mod: Column, neg: Column, cond: Column | None = None) -> Column:
    """likely_conflict, needs_review or likely_non_conflict; with cond, a conflict needs like conditions too."""
    sem = F.round(sem, 9)
    likely = (mod == 1) & (prop >= 0.45) & (sem >= 0.30)
    if cond is not None:
        likely = likely & (cond >= 0.50)
    return F.when(likely, "likely_conflict").when(((mod == 1) | (neg == 1)) & (prop >= 0.20) & (sem >= 0.25), "needs_review").otherwise("likely_non_conflict")


def conflict_category(mod: Column, core: Column, exception: Column) -> Column:
    return (
        F.when(mod == 0, "not_conflicting").when(core < 0.30, "different_proposition").when(exception == 1, "scope_dependent_review")
        .when(core >= 0.70, "strong_conflict").otherwise("potential_conflict")
    )


# --- durations ----------------------------------------------------------------------------------------------------
def temporal_conflict(times_a, times_b, stems_a, stems_b, party_a, party_b, mod_a, mod_b) -> Column:
    """struct(score, type, same_party, shared_terms, first: the first pair of like units with unlike values).

    times are text.durations() and stems text.stem_tokens() of the two clauses, made once for each clause."""
    shared = F.array_sort(F.array_intersect(stems_a, stems_b))
    result = lambda e: temporal_result(e["differ"], e["shared"], F.size(e["shared"]) > 0, same_party(party_a, party_b), mod_a, mod_b)
    return bound(F.struct(differing(times_a, times_b).alias("differ"), shared.alias("shared")), result)


def differing(times_a: Column, times_b: Column) -> Column:
    """struct(a, b) of the first two durations of like units and unlike values, null if there are none."""
    pairs = F.flatten(F.transform(times_a, lambda x: F.transform(times_b, lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return F.get(F.filter(pairs, lambda p: (T.unit_family(p["a"]["unit"]) == T.unit_family(p["b"]["unit"])) & (p["a"]["value"] != p["b"]["value"])), F.lit(0))


def temporal_result(differ: Column, shared: Column, has_shared: Column, party: Column, mod_a: Column, mod_b: Column) -> Column:
    """The struct of temporal_conflict(), of what differing() gives and the stems that both have."""
    mods = F.when(((mod_a == "obligation") & (mod_b == "permission")) | ((mod_a == "permission") & (mod_b == "obligation")), 0.10).when((mod_a == "obligation") & (mod_b == "obligation"), 0.05).otherwise(0.0)
    hit = differ.isNotNull() & has_shared
    score = F.when(hit, F.least(F.lit(1.0), F.lit(0.75) + F.when(party, 0.10).otherwise(0.0) + mods)).otherwise(0.0)
    return F.struct(score.alias("score"), F.when(hit, "temporal_deadline_conflict").alias("type"), party.alias("same_party"), shared.alias("shared_terms"), F.when(hit, differ).alias("first"))
