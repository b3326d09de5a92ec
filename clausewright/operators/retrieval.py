"""TF-IDF weights in long form, similarity joins with top-k, dense ranking, fusion and reranking."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features as X
from .pairing import cells, paired
from .repeated import coded, numbered
from .tables import kept


def validated(clauses: DataFrame) -> DataFrame:
    """clauses, if there are any and each has a clause_id; else a ValueError."""
    r = clauses.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("clause_id").isNull() | (F.col("clause_id") == "")).alias("without")).first()
    if not r["n"]:
        raise ValueError("there are no clauses to index")
    if r["without"]:
        raise ValueError(f"{r['without']} clauses have no clause_id")
    return clauses


def term_counts(rows: DataFrame, keys: list[str], bigrams: bool = True, accents: bool = False) -> DataFrame:
    """(keys..., term, tf) of rows (keys..., text)."""
    return rows.select(*keys, F.explode(X.grams(F.col("text"), bigrams, accents)).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(tf: DataFrame, rows: DataFrame, scope: list[str], max_features: int | None = 20_000, min_df: int = 1) -> DataFrame:
    """(scope..., term, idf) of term counts of rows: idf = ln((1 + n) / (1 + df)) + 1 over the rows of a scope (all without one).

    The max_features terms with the largest counts stay, ties by term."""
    n = rows.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"))
    terms = tf.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    if max_features:
        w = Window.partitionBy(*scope).orderBy(F.desc("total"), "term") if scope else None
        terms = terms.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_features).drop("r") if scope else terms.orderBy(F.desc("total"), "term").limit(max_features)
    terms = terms.join(n, scope) if scope else terms.crossJoin(F.broadcast(n))  # n is one row
    return terms.select(*scope, "term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def weighted(tf: DataFrame, terms: DataFrame, keys: list[str], scope: list[str], sublinear: bool = True) -> DataFrame:
    """(keys..., term, weight): L2-normalised TF-IDF; terms that are not in the vocabulary are left out before."""
    raw = tf.join(terms, [*scope, "term"]).withColumn("w", (F.log(F.col("tf").cast("double")) + 1 if sublinear else F.col("tf").cast("double")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    return raw.select(*keys, "term", (F.col("w") / norm).alias("weight"))


def tfidf(rows: DataFrame, scope: list[str] | None = None, bigrams: bool = True, sublinear: bool = True, max_features: int | None = 20_000, min_df: int = 1, accents: bool = False, carry: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """(scope..., id, carry..., term, weight) of rows (scope..., id, carry..., text): L2-normalised TF-IDF, letters without
    their accents. carry: columns that go with the id.

    Term counts are combined before each shuffle; a vocabulary of max_features terms is sent to all executors. Texts that
    come again and again (operators.repeated) are weighed once, without a scope."""
    scope = scope or []
    keys = [*scope, "id", *carry]
    if not scope and (texts := numbered(rows, most)) is not None:
        weights = text_weights(texts, bigrams, sublinear, max_features, min_df, accents)
        each = weights.groupBy("tid").agg(F.collect_list(F.struct("term", "weight")).alias("x"))
        return coded(rows, texts).join(F.broadcast(each), "tid").select(*keys, F.inline("x"))
    tf = kept(term_counts(rows, keys, bigrams, accents))
    terms = vocabulary(tf, rows, scope, max_features, min_df)
    if max_features and max_features <= 200_000 and not scope:
        terms = F.broadcast(terms)
    return weighted(tf, terms, keys, scope, sublinear)


def text_weights(texts: DataFrame, bigrams: bool = True, sublinear: bool = True, max_features: int | None = 20_000, min_df: int = 1, accents: bool = False) -> DataFrame:
    """(tid, term, weight) of numbered texts (text, tid, n), as tfidf() gives them to rows of which n have a text."""
    tf = kept(term_counts(texts, ["tid", "n"], bigrams, accents))
    terms = counted_vocabulary(tf, texts, max_features, min_df)
    return kept(weighted(tf.drop("n"), terms, ["tid"], [], sublinear))


def counted_vocabulary(tf: DataFrame, texts: DataFrame, max_features: int | None, min_df: int = 1) -> DataFrame:
    """(term, idf) as vocabulary() gives them, of term counts (term, tf, n) of texts of which each stands for n rows."""
    total = texts.agg(F.sum("n").alias("n"))
    terms = tf.groupBy("term").agg(F.sum("n").alias("df"), F.sum(F.col("tf") * F.col("n")).alias("total")).where(F.col("df") >= min_df)
    if max_features:
        terms = terms.orderBy(F.desc("total"), "term").limit(max_features)
    return terms.crossJoin(F.broadcast(total)).select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # total is one row


#: Terms of all numbered texts up to which their weights are sent to all executors as arrays.
CELLS = 1_000_000


def text_scores(texts: DataFrame, weights: DataFrame):
    """A function of arrays of numbers of texts, from 0: the dot products of text_weights(); None where these are many."""
    table = cells(weights, texts.count(), CELLS)
    if table is None:
        return None
    sent = weights.sparkSession.sparkContext.broadcast(table)
    return lambda a, b: (sent.value.dots(a, b),)


def numbered_scores(texts: DataFrame):
    """text_scores() by the weights that tfidf() gives to the rows of numbered texts."""
    return text_scores(texts, text_weights(texts))


def top_k_numbered(rows: DataFrame, k: int, max_features: int | None = 20_000, most: int | None = None, **options) -> DataFrame | None:
    """What top_k_similar() gives by the weights of tfidf() for rows (id, document_id, ord, text) of which few texts are
    distinct, with back (pairing.paired): the pairs of a document by the numbers of their texts. None where texts or weights
    are many."""
    texts = numbered(rows, most)
    scores = None if texts is None else text_scores(texts, text_weights(texts, max_features=max_features))
    if scores is None:
        return None
    made = coded(rows.select("id", "document_id", "ord", "text"), texts)
    found = paired(made, ("id",), scores, ("score",), "both", best=k, **options)
    return found.withColumnsRenamed({"a_id": "query_id", "b_id": "candidate_id"}).drop("document_id", "ta", "tb")


def fused_numbered(rows: DataFrame, k: int, dense: Callable, alphas=(0.25, 0.50, 0.75), most: int | None = None) -> DataFrame | None:
    """What fuse() gives of the k most similar clauses of each of rows (id, document_id, ord, text), made and ranked where the
    document lies: query_id, candidate_id, alpha, fused, rank. dense(texts) gives a function of arrays of numbers of texts
    (text, tid from 1), from 0, or None. None where texts, weights or what dense needs are many."""
    texts = numbered(rows, most)
    sparse = None if texts is None else text_scores(texts, text_weights(texts))
    score = None if sparse is None else dense(texts)
    if score is None:
        return None

    def scaled(x: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        low, high = (np.repeat(f.reduceat(x, first), size) for f in (np.minimum, np.maximum))
        return np.divide(x - low, high - low, out=np.zeros(len(x)), where=high > low)

    def after(a: np.ndarray, ta: np.ndarray, tb: np.ndarray, values: dict) -> tuple[np.ndarray, list[np.ndarray]]:
        which, made = [np.zeros(0, dtype=np.int64)], [(np.zeros(0), np.zeros(0), np.zeros(0, dtype=np.int32))]
        if len(a):
            first = np.concatenate(([0], np.flatnonzero(a[1:] != a[:-1]) + 1))
            size = np.diff(np.append(first, len(a)))
            s, d = scaled(values["sparse"], first, size), scaled(values["dense"], first, size)
            for alpha in alphas:
                fused = alpha * s + (1 - alpha) * d
                order = np.lexsort((values["candidate"], -np.round(fused, 9), a))
                which.append(order)
                made.append((np.full(len(a), alpha), fused[order], (np.arange(len(a)) - np.repeat(first, size) + 1).astype(np.int32)))
        return np.concatenate(which), [np.concatenate(x) for x in zip(*made, strict=True)]

    made = coded(rows.select("id", "document_id", "ord", "text"), texts)
    found = paired(made, ("id",), lambda a, b: (*sparse(a, b), score(a, b)), ("sparse", "dense"), "both", best=k, by="sparse", after=after, more="alpha double, fused double, place int")
    return found.select(F.col("a_id").alias("query_id"), F.col("b_id").alias("candidate_id"), "alpha", "fused", F.col("place").alias("rank"))


def set_likeness(texts: DataFrame, items: Column) -> Callable | None:
    """For fused_numbered(): the Jaccard similarity of the sets items of texts; None where these are large."""
    made = texts.select("tid", F.explode(F.array_distinct(items)).alias("term"), F.lit(1.0).alias("weight"))
    table = cells(made, texts.count(), CELLS)
    if table is None:
        return None
    sent = texts.sparkSession.sparkContext.broadcast(table)

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = sent.value.shared(a, b)
        union = sent.value.squares[a] + sent.value.squares[b] - both
        return np.divide(both, union, out=np.zeros(len(a)), where=union > 0)

    return score


def set_shared(texts: DataFrame, items: Column) -> Callable | None:
    """A function of arrays of numbers of texts (tid from 1), from 0: how many of the set items both have; None where these are large."""
    table = cells(texts.select("tid", F.explode(F.array_distinct(items)).alias("term"), F.lit(1.0).alias("weight")), texts.count(), CELLS)
    if table is None:
        return None
    sent = texts.sparkSession.sparkContext.broadcast(table)
    return lambda a, b: sent.value.shared(a, b)


def score_candidates(queries: DataFrame, candidates: DataFrame, clauses: DataFrame, max_features: int | None = 20_000, accents: bool = True) -> DataFrame:
    """(query_id, id, score) of the candidates (query_id, id): cosines of queries (query_id, text) and clauses (id, text),
    the vocabulary that of all clauses."""
    tf = kept(term_counts(clauses, ["id"], accents=accents))
    terms = kept(vocabulary(tf, clauses, [], max_features))
    one = weighted(term_counts(queries, ["query_id"], accents=accents), terms, ["query_id"], []).withColumnRenamed("weight", "wq")
    two = weighted(tf, terms, ["id"], [])
    dots = candidates.join(one, "query_id").join(two, ["id", "term"]).groupBy("query_id", "id").agg(F.sum(F.col("wq") * F.col("weight")).alias("dot"))
    return candidates.join(dots, ["query_id", "id"], "left").select("query_id", "id", F.coalesce("dot", F.lit(0.0)).alias("score"))


def retrieve(queries: DataFrame, clauses: DataFrame, k: int = 5, max_features: int | None = 30_000, most: int | None = None) -> DataFrame:
    """(document_id, query_id, id, score, rank): for queries (document_id, query_id, text) the k best clauses (document_id,
    id, ord, text) of the document; the vocabulary is that of all clauses. Of equal ones the later clause comes first."""
    pairs = queries.select("document_id", "query_id").join(clauses.select("document_id", "id", "ord"), "document_id")
    order = Window.partitionBy("document_id", "query_id").orderBy(F.desc(F.round("score", 9)), F.desc("ord"))
    ranked = retrieve_numbered(queries, clauses, k, max_features, most)
    if ranked is None:
        keyed = pairs.select(F.struct("document_id", "query_id").alias("query_id"), "id", "ord")
        scored = score_candidates(queries.select(F.struct("document_id", "query_id").alias("query_id"), "text"), keyed.select("query_id", "id"), clauses.select("id", "text"), max_features)
        scored = scored.join(keyed, ["query_id", "id"]).select(F.col("query_id.document_id").alias("document_id"), F.col("query_id.query_id").alias("query_id"), "id", "ord", "score")
        ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("document_id", "query_id", "id", "score", "rank")


def retrieve_numbered(queries: DataFrame, clauses: DataFrame, k: int, max_features: int | None, most: int | None = None) -> DataFrame | None:
    """(document_id, query_id, id, score, rank) of the k best clauses of each query's document; None where the texts of
    both, or their weights, are many. The vocabulary is that of the clauses."""
    both = clauses.select("text", F.lit(1).alias("is")).unionByName(queries.select("text", F.lit(0).alias("is")))
    texts = numbered(both, most)
    if texts is None:
        return None
    counted = coded(clauses, texts).groupBy("tid").agg(F.count(F.lit(1)).alias("m"))
    texts = texts.drop("n").join(F.broadcast(counted), "tid", "left").select("text", "tid", F.coalesce("m", F.lit(0)).alias("n"))
    scores = text_scores(texts, text_weights(texts, max_features=max_features, min_df=1, accents=True))
    if scores is None:
        return None
    asked = queries.select("document_id", "query_id", F.lit(None).cast(clauses.schema["id"].dataType).alias("id"), F.lit(None).cast(clauses.schema["ord"].dataType).alias("ord"), F.lit(1).alias("side"), "text")
    have = clauses.select("document_id", F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "id", "ord", F.lit(0).alias("side"), "text")
    found = paired(coded(have.unionByName(asked), texts), ("query_id", "id"), scores, ("score",), "across", best=k, last=True)
    return found.select("document_id", F.col("a_query_id").alias("query_id"), F.col("b_id").alias("id"), "score", "rank")


def clause_pairs(examples: DataFrame, clauses: DataFrame, k: int = 5) -> DataFrame:
    """Examples (document_id, label_id, hypothesis, ...) each with its k retrieved clauses: span_id, clause, retrieval_score."""
    asked = examples.select("document_id", F.col("label_id").alias("query_id"), F.col("hypothesis").alias("text"))
    found = retrieve(asked, clauses, k).join(clauses.select("document_id", "id", F.col("text").alias("clause")), ["document_id", "id"])
    return examples.join(found.select("document_id", F.col("query_id").alias("label_id"), F.col("id").alias("span_id"), "clause", F.col("score").alias("retrieval_score")), ["document_id", "label_id"])


def candidate_ids(listed: Column, scores: Column) -> Column:
    """Distinct ids of a list of candidates in its order; where it is null or empty the keys of the score map."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.when(F.size(F.coalesce(listed, none)) > 0, listed).otherwise(F.coalesce(F.map_keys(scores), none)))


def clean_candidates(queries: DataFrame, candidates: DataFrame, gold: DataFrame, clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates that can be evaluated, and one row of counts of what was left out.

    queries (document_id, query_id, has_scores), candidates (document_id, query_id, clause_id), gold (the same), clauses
    (clause_id, document_id). In this order a query goes that has no gold, no candidate, no scores, or no candidate left
    once those go that are unknown or of another document; unknown ones are counted."""
    key = ["document_id", "query_id"]
    with_gold = queries.join(gold.select(*key).distinct().withColumn("_g", F.lit(True)), key, "left")
    listed = candidates.join(clauses.select("clause_id", F.col("document_id").alias("_own")), "clause_id", "left").withColumn("_good", F.col("_own") == F.col("document_id"))
    per = listed.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_own").isNull()).alias("_unknown"), F.count_if("_good").alias("_kept"))
    q = with_gold.join(per, key, "left")
    no_gold, no_list = F.col("_g").isNull(), F.col("_n").isNull()
    no_scores = ~F.coalesce("has_scores", F.lit(False))
    reached = ~no_gold & ~no_list & ~no_scores
    none_left = reached & (F.col("_kept") == 0)
    counts = q.agg(
        F.count_if(no_gold).alias("missing_gold"), F.count_if((~no_gold & no_list) | none_left).alias("missing_candidates"), F.count_if(~no_gold & ~no_list & no_scores).alias("missing_scores"),
        F.coalesce(F.sum(F.when(reached, F.col("_unknown"))), F.lit(0)).alias("missing_clause_ids"), F.count_if(reached & (F.col("_kept") > 0)).alias("queries"),
    )
    kept_queries = q.where(reached & (F.col("_kept") > 0)).select(*key)
    return listed.where("_good").select(*key, "clause_id").join(kept_queries, key, "left_semi"), counts


def coverage(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: queries, those with gold among their candidates, and their share (0 without queries)."""
    key = ["document_id", "query_id"]
    hit = candidates.join(gold.select(*key, "clause_id").distinct().withColumn("_g", F.lit(1)), [*key, "clause_id"], "left").groupBy(*key).agg(F.max("_g").alias("hit"))
    return hit.agg(F.count(F.lit(1)).alias("queries"), F.count("hit").alias("covered")).withColumn("coverage", F.coalesce(F.try_divide("covered", "queries"), F.lit(0.0)))


def top_k_similar(clauses: DataFrame, weights: DataFrame, k: int = 10, group: str | None = "document_id") -> DataFrame:
    """(query_id, candidate_id, score, rank): for each clause the k most similar others.

    clauses: id, ord (the order of ties) and, unless None, group. With a group only its clauses are compared: those with
    a common term by the inverted lists of its terms; where fewer than k are found, others with score 0 fill up the
    ranks. Without one, only clauses with a common term are found. weights may bring the group along."""
    if group and group not in weights.columns:
        weights = weights.join(clauses.select("id", group), "id")
    on = [group, "term"] if group else ["term"]
    one, two = weights.select(F.col("id").alias("query_id"), *on, F.col("weight").alias("a")), weights.select(F.col("id").alias("candidate_id"), *on, F.col("weight").alias("b"))
    dots = one.join(two, on).where("query_id <> candidate_id").groupBy("query_id", "candidate_id").agg(F.sum(F.col("a") * F.col("b")).alias("score"))
    dots = dots.where(F.round("score", 9) > 0) if group else dots
    scored = dots.join(clauses.select(F.col("id").alias("candidate_id"), "ord"), "candidate_id")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "ord")
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "candidate_id", "score", "rank")
    if not group:
        return top
    top = kept(top)
    found = top.groupBy("query_id").agg(F.max("rank").alias("found"))
    sized = clauses.select(F.col("id").alias("query_id"), group, F.count(F.lit(1)).over(Window.partitionBy(group)).alias("n")).join(found, "query_id", "left")
    short = sized.withColumn("found", F.coalesce("found", F.lit(0))).where(F.col("found") < F.least(F.lit(k), F.col("n") - 1)).select("query_id", group, "found")
    # of these all that have a common term are in top
    others = short.join(clauses.select(F.col("id").alias("candidate_id"), group, "ord"), group).where("query_id <> candidate_id").join(top.select("query_id", "candidate_id"), ["query_id", "candidate_id"], "left_anti")
    filled = others.withColumn("rank", F.col("found") + F.row_number().over(Window.partitionBy("query_id").orderBy("ord"))).where(F.col("rank") <= k)
    return top.unionByName(filled.select("query_id", "candidate_id", F.lit(0.0).alias("score"), F.col("rank").cast("int").alias("rank")))


#: Decimals below which a bound on a score is not trusted.
SLACK = 1e-7


def across_bounds(weights: DataFrame, k: int, champions: int) -> DataFrame:
    """(query_id, least): a score that the k-th best candidate of each query has at least, 0 if none is known.

    It is the k-th largest sum over those terms of which the candidate is among the champions, the rows with the largest
    weights of a term. Weights aren't negative, so a sum over some terms is no more than the score."""
    best = Window.partitionBy("term").orderBy(F.desc("weight"), "id")
    top = weights.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= champions).select("term", F.col("id").alias("candidate_id"), F.col("weight").alias("b"))
    some = weights.select(F.col("id").alias("query_id"), "term", F.col("weight").alias("a")).join(top, "term").where("query_id <> candidate_id")
    sums = some.groupBy("query_id", "candidate_id").agg(F.sum(F.col("a") * F.col("b")).alias("sum"))
    order = Window.partitionBy("query_id").orderBy(F.desc("sum"))
    nth = sums.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    return nth.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("sum")).otherwise(0.0).alias("least"))


def across_candidates(weights: DataFrame, k: int, champions: int | None = None, parts: int = 16, hot: int = 1000) -> DataFrame:
    """(query_id, candidate_id): distinct pairs among which each row's k most similar ones are.

    Of a row's terms, those that bring the least go without being looked up, as long as all of them together, each by the
    term's largest weight in any row, stay below the bound of across_bounds(). Lists of more than hot rows are dealt to parts."""
    weights = kept(weights)
    bounds = across_bounds(weights, k, champions or 8 * k)
    terms = weights.groupBy("term").agg(F.max("weight").alias("most"), F.count(F.lit(1)).alias("n"))
    held = weights.join(terms, "term").join(bounds.withColumnRenamed("query_id", "id"), "id", "left")
    up = Window.partitionBy("id").orderBy(F.col("weight") * F.col("most"), "term").rowsBetween(Window.unboundedPreceding, 0)
    asked = held.withColumn("_sum", F.sum(F.col("weight") * F.col("most")).over(up)).where(F.col("_sum") >= F.coalesce("least", F.lit(0.0)) - SLACK)
    spread = F.when(F.col("n") > hot, parts).otherwise(1)
    asked = asked.select(F.col("id").alias("query_id"), "term", F.explode(F.sequence(F.lit(0), spread - 1)).alias("_part"))
    lists = weights.join(terms.select("term", "n"), "term").select("term", F.col("id").alias("candidate_id"), F.pmod(F.xxhash64("id"), spread).cast("int").alias("_part"))
    return asked.join(lists, ["term", "_part"]).where("query_id <> candidate_id").select("query_id", "candidate_id").distinct()


def top_k_across(rows: DataFrame, weights: DataFrame, k: int = 10, **options) -> DataFrame:
    """(query_id, candidate_id, score, rank): for each of rows (id, ord) the k most similar others of all, of those with a
    common term; weights (id, term, weight) as tfidf() gives them. Nothing is left out that top_k_similar() finds."""
    pairs = across_candidates(weights, k, **options)
    cells = F.sort_array(F.collect_list(F.struct(F.xxhash64("term").alias("t"), "weight")))
    vectors = weights.groupBy("id").agg(cells.alias("x")).select("id", F.col("x")["t"].alias("t"), F.col("x")["weight"].alias("w"))
    side = lambda key, n: vectors.select(F.col("id").alias(key), F.col("t").alias(f"t{n}"), F.col("w").alias(f"w{n}"))
    both = pairs.join(side("query_id", 1), "query_id").join(side("candidate_id", 2), "candidate_id")

    @F.pandas_udf("double")
    def score(t1: pd.Series, w1: pd.Series, t2: pd.Series, w2: pd.Series) -> pd.Series:
        out = []
        for a, x, b, y in zip(t1, w1, t2, w2, strict=True):
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            same = b[at] == a
            out.append(float(x[same] @ y[at[same]]))
        return pd.Series(out, dtype="float64")

    both = both.select("query_id", "candidate_id", score("t1", "w1", "t2", "w2").alias("score"))
    scored = both.join(rows.select(F.col("id").alias("candidate_id"), "ord"), "candidate_id")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "ord")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "candidate_id", "score", "rank")


def rank_for_queries(queries: DataFrame, clauses: DataFrame) -> DataFrame:
    """(document_id, query_id, candidate_id, score, rank): the clauses of a document by similarity to its queries.

    queries: document_id, query_id, text; clauses: document_id, id, ord, text. The corpus is the document's clauses."""
    n = clauses.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    tf = clauses.select("document_id", "id", F.explode(X.grams(F.col("text"), accents=False)).alias("term")).groupBy("document_id", "id", "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = tf.groupBy("document_id", "term").agg(F.count(F.lit(1)).alias("df")).join(n, "document_id").select("document_id", "term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))

    def weighted(t: DataFrame, key: str) -> DataFrame:
        w = t.join(idf, ["document_id", "term"]).withColumn("w", (F.log(F.col("tf").cast("double")) + 1) * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("document_id", key)))
        return w.select("document_id", key, "term", (F.col("w") / norm).alias(f"w_{key}"))

    asked = queries.select("document_id", "query_id", F.explode(X.grams(F.col("text"), accents=False)).alias("term")).groupBy("document_id", "query_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    dots = weighted(asked, "query_id").join(weighted(tf, "id"), ["document_id", "term"]).groupBy("document_id", "query_id", "id").agg(F.sum(F.col("w_query_id") * F.col("w_id")).alias("dot"))
    every = queries.select("document_id", "query_id").join(clauses.select("document_id", "id", "ord"), "document_id")
    scored = every.join(dots, ["document_id", "query_id", "id"], "left").withColumn("score", F.coalesce("dot", F.lit(0.0)))
    order = Window.partitionBy("document_id", "query_id").orderBy(F.desc(F.round("score", 9)), "ord")
    return scored.select("document_id", "query_id", F.col("id").alias("candidate_id"), "score", F.row_number().over(order).alias("rank"))


def min_max(x: str, over: list[str]) -> Column:
    """Scaled to 0 to 1 within the partition; a constant one is all zeros."""
    w = Window.partitionBy(*over)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high > low, (F.col(x) - low) / (high - low)).otherwise(0.0)


def fuse(scored: DataFrame, alphas=(0.25, 0.50, 0.75), by: list[str] | None = None) -> DataFrame:
    """scored (by..., candidate_id, sparse, dense) for each alpha with fused and rank."""
    by = by or ["query_id"]
    rows = scored.withColumn("s", min_max("sparse", by)).withColumn("d", min_max("dense", by)).withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    rows = rows.withColumn("fused", F.col("alpha") * F.col("s") + (1 - F.col("alpha")) * F.col("d"))
    order = Window.partitionBy(*by, "alpha").orderBy(F.desc(F.round("fused", 9)), "candidate_id")
    return rows.withColumn("rank", F.row_number().over(order)).drop("s", "d")


def rerank_score() -> Column:
    """Of sparse, legal, modality_hit and context; weights are fixed values."""
    return F.col("sparse") * 0.70 + F.col("legal") * 0.15 + F.col("modality_hit") * 0.10 + F.col("context") * 0.05


def rerank(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rows (by..., candidate_id, sparse, legal, modality_hit, context) with rerank_score and rank."""
    order = Window.partitionBy(*(by or ["query_id"])).orderBy(F.desc(F.round("rerank_score", 9)), "candidate_id")
    return rows.withColumn("rerank_score", rerank_score()).withColumn("rank", F.row_number().over(order))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Of two dense vectors; 0 where one of them is zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def contexts(ranked: DataFrame, k: int) -> DataFrame:
    """(query_id, context): the texts of the first k candidates, joined in the order of their ranks."""
    held = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("x"))
    return held.select("query_id", F.array_join(F.transform("x", lambda e: e["text"]), " ").alias("context"))
