"""Interval joins, ranking metrics, threshold sweeps and the other measures of retrieval and detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import kept


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Do half-open intervals share a point? An empty one shares none."""
    return F.greatest(a0, b0) < F.least(a1, b1)


def relevant(clauses: DataFrame, gold: DataFrame, key: str = "document_id", width: int = 512) -> DataFrame:
    """(key, query_id, clause_id): the clauses (key, clause_id, start_char, end_char) that a gold span (key, query_id, start, finish) meets.

    Both are cut at multiples of width, and only pieces of one stretch of a text are held against each other: those that
    meet, do so where the later one of the two begins."""
    piece = lambda a, b: F.explode(F.when(F.col(b) > F.col(a), F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))).alias("_at")
    one = clauses.select(key, "clause_id", "start_char", "end_char", piece("start_char", "end_char"))
    two = gold.select(key, "query_id", "start", "finish", piece("start", "finish"))
    test = overlaps(F.col("start_char"), F.col("end_char"), F.col("start"), F.col("finish")) & (F.floor(F.greatest("start_char", "start") / width) == F.col("_at"))
    return one.join(two, [key, "_at"]).where(test).select(key, "query_id", "clause_id").distinct()


def first_hits(ranked: DataFrame, by: list[str]) -> DataFrame:
    """(by..., first_rank): of ranked (by..., rank, hit) the first rank that hits, null if none."""
    return ranked.groupBy(*by).agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_rank"))


def ranking_metrics(hits: DataFrame, ks=(1, 2, 5, 10), by: list[str] | None = None) -> DataFrame:
    """queries, recall at each k and the mean reciprocal rank of first_hits()."""
    at = [F.avg(F.coalesce(F.col("first_rank") <= k, F.lit(False)).cast("double")).alias(f"recall_{k}") for k in ks]
    return hits.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("queries"), *at, F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("mrr"))


def threshold_grid(ranked: DataFrame, thresholds, ks, by: str = "query_id") -> DataFrame:
    """For each threshold and k: recall, mean number of candidates that pass, share of queries without any."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(k).alias("k")) for t in thresholds for k in ks])).alias("g")
    rows = ranked.select(by, "rank", "score", "hit", grid).select(by, "rank", "score", "hit", "g.*")
    own = rows.groupBy("threshold", "k", by).agg(F.count_if((F.col("rank") <= F.col("k")) & (F.col("score") >= F.col("threshold"))).alias("n"), F.max(((F.col("rank") <= F.col("k")) & (F.col("score") >= F.col("threshold")) & F.col("hit")).cast("int")).alias("found"))
    return own.groupBy("threshold", "k").agg(F.avg("found").alias("recall"), F.avg("n").alias("mean_candidates"), F.avg((F.col("n") == 0).cast("double")).alias("none_rate"))


def sweep(rows: DataFrame, thresholds) -> DataFrame:
    """Precision, recall and F1 of rows (score, label) at each threshold; 0 where a ratio has nothing below it."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    s, y = F.col("score") >= F.col("threshold"), F.col("label") == 1
    c = rows.select("score", "label", t).groupBy("threshold").agg(F.count_if(s & y).alias("tp"), F.count_if(s & ~y).alias("fp"), F.count_if(~s & y).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def by_score(rows: DataFrame) -> DataFrame:
    """(score, pos, neg): counts at each distinct score; the window functions below run over these, not over rows."""
    return rows.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))


def running_totals(rows: DataFrame, by: str, sums: dict[str, str], buckets: int = 256) -> DataFrame:
    """rows with the sums (name: column) of each row and those with a larger value of by, which is distinct.

    Rows are dealt to buckets by quantiles and summed within each; the buckets' totals, a few rows, are sent to all."""
    cuts = rows.agg(F.percentile_approx(by, [k / buckets for k in range(1, buckets)], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(x) for x in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    dealt = kept(rows.withColumn("_b", F.size(F.filter(bounds, lambda x: x < F.col(by)))))
    totals = dealt.groupBy("_b").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    above = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)  # over buckets rows at most
    before = totals.select("_b", *[F.coalesce(F.sum(n).over(above), F.lit(0)).alias(f"_{n}") for n in sums])
    within = Window.partitionBy("_b").orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(before), "_b")
    return out.withColumns({n: F.col(f"_{n}") + F.sum(c).over(within) for n, c in sums.items()}).drop("_b", *[f"_{n}" for n in sums])


def areas(rows: DataFrame) -> DataFrame:
    """auc (ties count half) and average_precision of rows (score, label)."""
    c = running_totals(by_score(rows), "score", {"tp": "pos", "fp": "neg"})
    sums = c.agg(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))
    return sums.select(F.try_divide("won", F.col("p") * F.col("n")).alias("auc"), F.try_divide("ap", "p").alias("average_precision"))


def confusion(rows: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, accuracy and balanced accuracy of rows (label, predicted)."""
    y, p = F.col("label") == 1, F.col("predicted") == 1
    c = rows.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    acc = (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    half = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    return c.withColumn("accuracy", acc).withColumn("balanced_accuracy", (half("tp", "fn") + half("tn", "fp")) / 2)


def quantiles(rows: DataFrame, column: str, by: list[str], shares: tuple[float, ...], bins: int = 1024) -> DataFrame:
    """(by..., q0, q1, ...) exact quantiles of a column, as doubles, with linear interpolation; nulls don't count.

    Histograms are refined: of each group and wanted rank the bin that holds it is cut into bins again, between the
    smallest and the largest value there, until it holds one value. So no task sorts or holds the values of a group.
    Groups without a value have no row."""
    keys = [f"_k{i}" for i in range(len(by))]
    x = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(column).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    x = kept(x)
    same = lambda a, b: reduce(lambda s, k: s & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")), keys, F.lit(True))
    whole = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    at = lambda q: (F.col("_n") - 1) * F.lit(q)
    ranks = F.explode(F.array_distinct(F.flatten(F.array(*[F.array(F.floor(at(q)), F.ceil(at(q))) for q in shares])))).alias("_rank")
    state = kept(whole.select(*keys, "_lo", "_hi", ranks, F.lit(0).cast("long").alias("_below")))
    found = None
    while True:
        done = state.where("_lo = _hi").select(*keys, "_rank", F.col("_lo").alias("_value"))
        found = done if found is None else found.unionByName(done)
        state = state.where("_lo < _hi")
        if state.isEmpty():
            break
        ranges = state.groupBy(*keys, "_lo", "_hi", "_below").agg(F.collect_list("_rank").alias("_ranks"))
        inside = x.alias("x").join(ranges.alias("r"), same("x", "r") & (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))).select("r.*", "_x")
        share = (F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)  # halves: a range may be wider than a double
        bin_ = F.least(F.floor(share * bins), F.lit(bins - 1))
        of = [*keys, "_lo", "_hi", "_below"]
        cells = inside.withColumn("_bin", bin_).groupBy(*of, "_bin").agg(F.first("_ranks").alias("_ranks"), F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
        before = Window.partitionBy(*of).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # over bins rows at most
        cells = cells.withColumn("_from", F.col("_below") + F.coalesce(F.sum("_c").over(before), F.lit(0)))
        hit = F.filter("_ranks", lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("_c")))
        state = kept(cells.select(*keys, F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), F.explode(hit).alias("_rank"), F.col("_from").alias("_below")))
    values = whole.alias("w").join(found.alias("f"), same("w", "f")).groupBy(*[F.col(f"w.{k}") for k in keys], "_n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_v"))
    low, high = (lambda q: F.element_at("_v", F.floor(at(q)))), (lambda q: F.element_at("_v", F.ceil(at(q))))
    made = [(low(q) + (high(q) - low(q)) * (at(q) - F.floor(at(q)))).alias(f"q{i}") for i, q in enumerate(shares)]
    return values.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], *made)


def described(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    x = F.col(column)
    whole = rows.groupBy(*by).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    cuts = quantiles(rows, column, by, (0.25, 0.5, 0.75))
    both = whole.alias("a").join(cuts.alias("b"), reduce(lambda s, c: s & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), by, F.lit(True)), "left")
    return both.select("a.*", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"))


def value_counts(rows: DataFrame, column: str, keep_null: bool = False) -> DataFrame:
    some = rows if keep_null else rows.where(F.col(column).isNotNull())
    total = some.agg(F.count(F.lit(1)).alias("_all"))
    return some.groupBy(column).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_all")).drop("_all")  # total is one row


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """n / (k * n_c) of each class."""
    c = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    return c.withColumn("weight", F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")))


def hashed_sample(rows: DataFrame, key: str, n: int, by: list[str] | None = None) -> DataFrame:
    """n rows in the order of a hash of key, in all or in each stratum: the same rows each time."""
    mark = F.md5(F.col(key).cast("string"))
    if not by:
        return rows.orderBy(mark, key).limit(n)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(mark, key))).where(F.col("_n") <= n).drop("_n")


def failures(hits: DataFrame, worse_than: int = 2, n: int = 50) -> DataFrame:
    """The n queries with the worst first rank; none at all is worst."""
    rows = hits.where(F.col("first_rank").isNull() | (F.col("first_rank") > worse_than))
    return rows.withColumn("key", F.coalesce("first_rank", F.lit(999_999))).orderBy(F.desc("key"), "query_id").limit(n)


def best_threshold(swept: DataFrame, by: str = "f1") -> DataFrame:
    """Of sweep() rows the first with the best value."""
    return swept.orderBy(F.desc(F.round(by, 12)), "threshold").limit(1)


def class_report(rows: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of rows (label, predicted) for each class that either has; 0 without a divisor."""
    counts = rows.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.select(F.col("label").alias("c"), F.lit(0).alias("said"), F.col("n").alias("support"), F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"))
    ends = ends.unionByName(counts.select(F.col("predicted").alias("c"), F.col("n").alias("said"), F.lit(0).alias("support"), F.lit(0).alias("hit")))
    c = ends.groupBy(F.col("c").alias("label")).agg(*[F.sum(x).cast("long").alias(x) for x in ("said", "support", "hit")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = c.withColumn("precision", ratio(F.col("hit"), F.col("said"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return c.select("label", "precision", "recall", f1.alias("f1"), "support")


def with_evidence(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """rows (document_id, label_id, span_id, ...) with evidence_span_ids of gold (document_id, label_id, evidence_span_ids)
    and is_evidence; 0 where there is no list."""
    held = rows.join(gold, ["document_id", "label_id"], "left")
    return held.withColumn("is_evidence", F.coalesce(F.array_contains("evidence_span_ids", F.col("span_id")), F.lit(False)).cast("int"))


def evidence_recall(rows: DataFrame) -> DataFrame:
    """(document_id, label_id, gold, found, recall) of with_evidence() rows; examples without gold are left out."""
    per = rows.groupBy("document_id", "label_id").agg(
        F.array_distinct(F.flatten(F.collect_set("evidence_span_ids"))).alias("g"), F.collect_set(F.when(F.col("is_evidence") == 1, F.col("span_id"))).alias("r")
    ).where(F.size("g") > 0)
    found = F.size(F.array_intersect("g", F.col("r").cast(per.schema["g"].dataType)))
    return per.select("document_id", "label_id", F.size("g").cast("long").alias("gold"), found.cast("long").alias("found"), (found / F.size("g")).alias("recall"))


def gold_touch(pairs: DataFrame) -> DataFrame:
    """pairs (span_a, span_b, gold_spans) with a_is_gold, b_is_gold, pair_touches_gold, pair_both_gold and evidence_hit."""
    has = lambda c: F.coalesce(F.array_contains("gold_spans", F.col(c)), F.lit(False))
    rows = pairs.withColumn("a_is_gold", has("span_a")).withColumn("b_is_gold", has("span_b"))
    rows = rows.withColumn("pair_touches_gold", F.col("a_is_gold") | F.col("b_is_gold")).withColumn("pair_both_gold", F.col("a_is_gold") & F.col("b_is_gold"))
    return rows.withColumn("evidence_hit", F.col("pair_touches_gold").cast("int"))


def rolled_up(pairs: DataFrame, columns: list[str], by: list[str], sums: list[str] = ()) -> DataFrame:
    """A row for each group: max and mean of each column, sums as <column>_count, and pair_count."""
    parts = [f(c).alias(f"{c}_{n}") for n, f in (("max", F.max), ("mean", F.avg)) for c in columns]
    return pairs.groupBy(*by).agg(*parts, *[F.sum(c).cast("long").alias(f"{c}_count") for c in sums], F.count(F.lit(1)).alias("pair_count"))


def set_coverage(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., gold, candidates, found, recall, retrievable) of pairs (by..., span_a, span_b, gold_spans) for groups with gold:
    what share of the gold the pairs' spans have, and whether any of it."""
    spans = pairs.groupBy(*by).agg(F.array_distinct(F.flatten(F.collect_set("gold_spans"))).alias("g"), F.array_union(F.collect_set("span_a"), F.collect_set("span_b")).alias("s")).where(F.size("g") > 0)
    found = F.size(F.array_intersect("g", F.col("s").cast(spans.schema["g"].dataType)))
    return spans.select(*by, F.size("g").cast("long").alias("gold"), F.size("s").cast("long").alias("candidates"), found.cast("long").alias("found"), (found / F.size("g")).alias("recall"), (found > 0).alias("retrievable"))


def retrieval_ceiling(covered: DataFrame) -> DataFrame:
    """One row of set_coverage(): examples with gold, those whose gold is among the candidates, their share, mean recall."""
    return covered.agg(F.count(F.lit(1)).alias("examples"), F.count_if("retrievable").alias("retrievable"), F.avg(F.col("retrievable").cast("int")).alias("ceiling"), F.avg("recall").alias("mean_recall"))


def method_matrix(rows: DataFrame, methods: dict[str, str], by: list[str], tie: list[str], ks=(1, 3, 5, 10)) -> DataFrame:
    """(method, recall_k...) of rows (by..., hit and a score column for each method): the share of groups with a hit among
    the k best by that score, ties in the order of tie."""
    scores = F.explode(F.array(*[F.struct(F.lit(name).alias("method"), F.col(c).cast("double").alias("score")) for name, c in methods.items()])).alias("m")
    long = rows.select(*by, *tie, "hit", scores).select(*by, *tie, "hit", "m.*")
    order = Window.partitionBy("method", *by).orderBy(F.desc(F.round("score", 9)), *tie)
    per = long.withColumn("rank", F.row_number().over(order)).groupBy("method", *by).agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    return per.groupBy("method").agg(*[F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("double")).alias(f"recall_{k}") for k in ks])


def best_methods(matrix: DataFrame, ks=(1, 3, 5, 10)) -> DataFrame:
    """(k, method, recall): the best method for each k, ties by name."""
    long = matrix.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), "method", F.round(f"recall_{k}", 12).alias("recall")) for k in ks])).alias("r")).select("r.*")
    return long.groupBy("k").agg(F.min(F.struct((-F.col("recall")).alias("a"), "method")).alias("b")).select("k", "b.method", (-F.col("b.a")).alias("recall"))


def first_rank_report(hits: DataFrame, asked: int, ks=(1, 2, 5, 10)) -> DataFrame:
    """The row of retrieval_report(), of hits (first_rank), a row for each evaluated query, and how many were asked."""
    found = ranking_metrics(hits, ks)
    rounded = [F.round(c, 4).alias(c) for c in (*[f"recall_{k}" for k in ks], "mrr")]
    return found.select(F.col("queries").alias("evaluated"), (F.lit(asked) - F.col("queries")).alias("skipped"), *rounded)


def retrieval_report(ranked: DataFrame, relevant_clauses: DataFrame, asked: DataFrame, ks=(1, 2, 5, 10)) -> DataFrame:
    """One row: evaluated queries, those skipped as no clause meets their gold, recall at each k and the mean reciprocal
    rank, to four places.

    asked (document_id, query_id): queries that have gold; relevant_clauses (document_id, query_id, clause_id); ranked
    (document_id, query_id, candidate_id, rank): all clauses of the document."""
    key = ["document_id", "query_id"]
    wanted = relevant_clauses.select(*key, F.col("clause_id").alias("candidate_id")).distinct().withColumn("hit", F.lit(True))
    evaluated = asked.join(wanted.select(*key).distinct(), key, "left_semi")
    hits = ranked.join(evaluated, key, "left_semi").join(wanted, [*key, "candidate_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    metrics = ranking_metrics(first_hits(hits, key), ks)
    skipped = asked.join(wanted.select(*key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("skipped"))
    return metrics.crossJoin(skipped).select(F.col("queries").alias("evaluated"), "skipped", *[F.round(f"recall_{k}", 4).alias(f"recall_{k}") for k in ks], F.round("mrr", 4).alias("mrr"))  # one row each
