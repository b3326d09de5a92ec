"""The conflict graph: node and edge tables, damped propagation, risk, resolutions and explanations. Weights are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import clamp01, fixed, ladder
from ..functions.text import absent
from .tables import kept

SEVERITY = {
    "obligation_vs_prohibition": 1.00, "prohibition_vs_obligation": 1.00, "positive_vs_negative": 0.90, "temporal_deadline_conflict": 0.90,
    "permission_vs_prohibition": 0.85, "prohibition_vs_permission": 0.85, "potential_semantic_conflict": 0.70, "no_clear_conflict": 0.30,
}
OTHER_SEVERITY = 0.50


def nodes_of(clauses: DataFrame) -> DataFrame:
    """One node a clause; of repeated ids the first by rn."""
    w = Window.partitionBy("clause_id").orderBy("rn")
    return clauses.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.col("clause_id").alias("node_id"), "document_id", "text")


def edges_of(rows: DataFrame) -> DataFrame:
    """hybrid() rows as edges; a pair that is no conflict is only related. No edge leads from a node to itself."""
    facts = [F.col(c).alias(n) for c, n in (("nli_label", "nli_label"), ("p_contradiction", "p_contradiction"), ("structured_score", "structured_score"), ("explanation", "explanation")) if c in rows.columns]
    return rows.where("clause_a <> clause_b").select(
        F.col("clause_a").alias("src"), F.col("clause_b").alias("dst"), F.when(F.col("is_conflict"), "conflict").otherwise("related").alias("relationship"),
        F.col("hybrid_score").alias("weight"), "conflict_type", *facts,
    )


def ends_of(pairs: DataFrame) -> DataFrame:
    """The ends (src, dst) of edges_of() rows, from the names of the pairs alone."""
    return pairs.where("clause_a <> clause_b").select(F.col("clause_a").alias("src"), F.col("clause_b").alias("dst"))


def bare(edges: DataFrame) -> DataFrame:
    """edges without what only explains them: what propagation and risk read."""
    return edges.select("src", "dst", "relationship", "weight", "conflict_type")


def checked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges, if both ends of each are nodes; a ValueError that names some that are not."""
    lost = [r.node_id for r in unknown_endpoints(nodes, edges).orderBy("node_id").limit(5).collect()]
    if lost:
        raise ValueError(f"edges lead to unknown nodes, such as {', '.join(map(str, lost))}")
    return edges


def conflicts_of(edges: DataFrame, node_id: str | None = None) -> DataFrame:
    """The conflict edges: all, or those of one node."""
    found = edges.where("relationship = 'conflict'")
    return found if node_id is None else found.where((F.col("src") == node_id) | (F.col("dst") == node_id))


def node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("node_id") == node_id)


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how many nodes, edges and conflicts."""
    counts = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("relationship") == "conflict").alias("conflicts"))
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(counts)  # one row each


def type_counts(edges: DataFrame) -> DataFrame:
    """(conflict_type, n) of the conflicts; a missing type is unknown."""
    return conflicts_of(edges).groupBy(F.coalesce("conflict_type", F.lit("unknown")).alias("conflict_type")).agg(F.count(F.lit(1)).alias("n"))


def degree_hotspots(edges: DataFrame, n: int = 10) -> DataFrame:
    """(node_id, degree) of the n nodes with most conflicts, ties by id."""
    ends = conflicts_of(edges).select(F.explode(F.array("src", "dst")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "node_id").limit(n)


def strongest(edges: DataFrame, n: int = 10) -> DataFrame:
    return conflicts_of(edges).orderBy(F.desc(F.round("weight", 9)), "src", "dst").limit(n)


def hotspot_report(propagated: DataFrame, n: int = 10) -> DataFrame:
    """(kind, key, value): how many nodes are in each of the four levels, then the n with the best positive scores."""
    levels = propagated.sparkSession.sql("SELECT explode(array('high', 'medium', 'low', 'none')) AS hotspot")
    counts = levels.join(propagated.groupBy("hotspot").agg(F.count(F.lit(1)).alias("n")), "hotspot", "left")
    top = propagated.where("propagated > 0").orderBy(F.desc(F.round("propagated", 9)), "node_id").limit(n)
    return counts.select(F.lit("level").alias("kind"), F.col("hotspot").alias("key"), F.coalesce("n", F.lit(0)).cast("double").alias("value")).unionByName(
        top.select(F.lit("top").alias("kind"), F.col("node_id").alias("key"), F.round("propagated", 4).alias("value"))
    )


def unknown_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Endpoints of edges that are no nodes: none in a sound graph."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return ends.join(nodes.select("node_id"), "node_id", "left_anti")


def adjacency(edges: DataFrame, conflicts_only: bool = True) -> DataFrame:
    """(node_id, other, w) in both directions; repeated edges are kept."""
    e = edges.where("relationship = 'conflict'") if conflicts_only else edges
    w = F.coalesce("weight", F.lit(0.0)).alias("w")
    return e.select(F.col("src").alias("node_id"), F.col("dst").alias("other"), w).unionByName(e.select(F.col("dst").alias("node_id"), F.col("src").alias("other"), w))


def neighbours(edges: DataFrame) -> DataFrame:
    """(node_id, neighbours): all that any edge joins, sorted."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("node_id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node_id"), F.col("src").alias("other")))))
    return ends.groupBy("node_id").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))


def propagate(nodes: DataFrame, edges: DataFrame, alpha: float = 0.70, iterations: int = 3) -> DataFrame:
    """(node_id, direct, propagated, degree, hotspot): new = alpha * direct + (1 - alpha) * weighted mean of the neighbours.

    All scores of a round come from the round before. The adjacency is made once; each round joins it with the scores,
    sums by node before the shuffle, and joins the nodes."""
    if not 0 <= alpha <= 1 or iterations < 1:
        raise ValueError("alpha must be from 0 to 1, and iterations 1 at least")
    adj = kept(adjacency(edges))
    facts = adj.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"), F.least(F.max("w"), F.lit(1.0)).alias("direct"))
    base = nodes.select("node_id").join(facts, "node_id", "left").select("node_id", F.coalesce("direct", F.lit(0.0)).alias("direct"), F.coalesce("degree", F.lit(0)).alias("degree"))
    base = kept(base)
    now = base.select("node_id", F.col("direct").alias("score"))
    for _ in range(iterations):
        seen = adj.join(now.withColumnRenamed("node_id", "other"), "other").groupBy("node_id").agg(F.sum(F.col("w") * F.col("score")).alias("ws"), F.sum("w").alias("sw"))
        now = base.join(seen, "node_id", "left").select("node_id", clamp01(F.col("direct") * alpha + (1 - alpha) * F.coalesce(F.when(F.col("sw") > 0, F.col("ws") / F.col("sw")), F.lit(0.0))).alias("score"))
    out = base.join(now, "node_id").select("node_id", "direct", F.col("score").alias("propagated"), "degree")
    return out.withColumn("hotspot", ladder(F.col("propagated"), (0.80, "high"), (0.60, "medium"), (0.30, "low"), otherwise="none"))


def severity(kind: Column) -> Column:
    out = F.lit(OTHER_SEVERITY)
    for name, v in SEVERITY.items():
        out = F.when(kind == name, v).otherwise(out)
    return out


def risk_level(score: Column) -> Column:
    return ladder(score, (0.80, "critical"), (0.60, "high"), (0.35, "medium"), (0.15, "low"), otherwise="minimal")


def node_risk(propagated: DataFrame, edges: DataFrame) -> DataFrame:
    """propagate() rows with density, severity, risk, level and the types of conflict at the node.

    Density is the degree's share of the largest degree of all documents."""
    ends = edges.where("relationship = 'conflict'").select(F.explode(F.array("src", "dst")).alias("node_id"), "conflict_type")
    types = ends.groupBy("node_id").agg(F.max(severity(F.col("conflict_type"))).alias("severity"), F.array_sort(F.collect_set("conflict_type")).alias("types"))
    most = propagated.agg(F.max("degree").alias("most"))
    rows = propagated.join(types, "node_id", "left").crossJoin(F.broadcast(most))  # one row
    density = F.when(F.col("most") > 0, F.col("degree") / F.col("most")).otherwise(0.0)
    rows = rows.withColumn("density", density).withColumn("severity", F.coalesce("severity", F.lit(0.0)))
    base = clamp01(F.col("propagated")) * 0.50 + clamp01(F.col("direct")) * 0.30 + F.col("density") * 0.20
    rows = rows.withColumn("risk", clamp01(F.when(F.col("degree") > 0, base * (F.col("severity") * 0.30 + 0.70)).otherwise(base * 0.50)))
    return rows.withColumn("level", risk_level(F.col("risk"))).drop("most")


def summarized(risk: DataFrame) -> DataFrame:
    """One row: nodes, mean and largest risk to four places, the level of the largest."""
    return risk.agg(F.count(F.lit(1)).alias("nodes"), F.round(F.avg("risk"), 4).alias("mean_risk"), F.round(F.max("risk"), 4).alias("max_risk")).withColumn("overall", risk_level(F.col("max_risk")))


def document_id(node_id: Column) -> Column:
    parts = F.split(node_id, "_clause_")
    return F.when(F.size(parts) == 2, parts[0]).otherwise(F.split(node_id, "_")[0])


def document_risk(risk: DataFrame) -> DataFrame:
    out = risk.groupBy(document_id(F.col("node_id")).alias("document_id")).agg(
        F.count(F.lit(1)).alias("clauses"), F.max("risk").alias("max_risk"), F.avg("risk").alias("mean_risk"),
        F.count_if(F.col("level").isin("high", "critical")).alias("high_risk"), F.count_if(F.col("degree") > 0).alias("connected"),
    )
    return out.withColumn("level", risk_level(F.col("max_risk")))


def risk_inputs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node scores and edges under the names that reports use for them, as node_risk() takes them.

    Nodes: node_id or id, direct_score or direct_conflict_score (0), propagated_score or propagated_conflict_score (as
    direct), conflict_degree (0). Edges: source_id or source, target_id or target, relationship or relation,
    conflict_type (unknown). Without any node it is a ValueError."""
    if nodes.isEmpty():
        raise ValueError("no node propagation data")
    any_of = lambda df, *names: [F.col(n) for n in names if n in df.columns]
    first = lambda df, names, other: F.coalesce(*any_of(df, *names), F.lit(other)) if any_of(df, *names) or other is not None else F.lit(None)
    direct = first(nodes, ("direct_score", "direct_conflict_score"), 0.0).cast("double")
    kept = nodes.select(
        first(nodes, ("node_id", "id"), "").cast("string").alias("node_id"), direct.alias("direct"),
        F.coalesce(*any_of(nodes, "propagated_score", "propagated_conflict_score"), direct).cast("double").alias("propagated"), first(nodes, ("conflict_degree",), 0).cast("long").alias("degree"),
    )
    ends = edges.select(
        first(edges, ("source_id", "source"), "").cast("string").alias("src"), first(edges, ("target_id", "target"), "").cast("string").alias("dst"),
        first(edges, ("relationship", "relation"), "").alias("relationship"), first(edges, ("conflict_type",), "unknown").alias("conflict_type"),
    )
    return kept, ends


def risk_report(risk: DataFrame, n: int = 10) -> DataFrame:
    """(kind, key, value, level): the summary, how many nodes are in each level that there is, and the n with most risk.

    Without nodes the summary has zeros and no level."""
    one = summarized(risk)
    facts = F.array(
        F.struct(F.lit("nodes").alias("key"), F.col("nodes").cast("double").alias("value"), F.lit(None).cast("string").alias("level")),
        F.struct(F.lit("average_risk").alias("key"), F.coalesce("mean_risk", F.lit(0.0)).alias("value"), F.lit(None).cast("string").alias("level")),
        F.struct(F.lit("maximum_risk").alias("key"), F.coalesce("max_risk", F.lit(0.0)).alias("value"), F.when(F.col("nodes") > 0, F.col("overall")).alias("level")),
    )
    top = risk.orderBy(F.desc(F.round("risk", 9)), "node_id").limit(n)
    out = one.select(F.lit("summary").alias("kind"), F.explode(facts).alias("f")).select("kind", "f.*")
    out = out.unionByName(risk.groupBy("level").agg(F.count(F.lit(1)).alias("n")).select(F.lit("level").alias("kind"), F.col("level").alias("key"), F.col("n").cast("double").alias("value"), "level"))
    return out.unionByName(top.select(F.lit("top").alias("kind"), F.col("node_id").alias("key"), F.round("risk", 4).alias("value"), "level"))


# --- fixed values: the sentences of resolutions and explanations -----------------------------------------------------
ADVICE = {
    "obligation_vs_prohibition": "Review the clauses and determine whether the action is mandatory or prohibited.",
    "prohibition_vs_obligation": "Clarify whether the action is permitted or forbidden.",
    "permission_vs_prohibition": "Clarify the circumstances under which the action is permitted or prohibited.",
    "prohibition_vs_permission": "Clarify the circumstances under which the action is permitted or prohibited.",
    "positive_vs_negative": "Remove contradictory affirmative and negative statements.",
    "temporal_deadline_conflict": "Standardize the conflicting time periods so that the contract contains one clearly defined deadline.",
    "potential_semantic_conflict": "Review the related clauses manually and clarify any inconsistent wording.",
    "no_clear_conflict": "Manual legal review recommended.",
}
REVIEW = "Manual legal review required."
DIRECT = (
    (0.80, "The clause has a very strong direct conflict signal."), (0.60, "The clause has a strong direct conflict signal."), (0.40, "The clause has a moderate direct conflict signal."),
)
DIRECT_WEAK, DIRECT_NONE = "The clause has a relatively weak direct conflict signal.", "No direct conflict signal was detected."
SPREAD_ALONE = "The clause is not connected to any detected conflict edges."
SPREAD_STRONG = "Conflict propagation is strong, indicating that connected conflicting clauses increase the clause's risk."
SPREAD_MODERATE = "The clause receives a moderate conflict signal from connected clauses."
SPREAD_LIMITED = "The clause has some conflict connectivity, but propagated conflict remains limited."
LINKS_NONE = "There are no conflict connections."
GRAVE = ((0.80, "The detected conflict has high severity."), (0.50, "The detected conflict has moderate severity."))
GRAVE_LOW, GRAVE_NONE = "The detected conflict has relatively low severity.", "No significant severity contribution was detected."
ACT_CRITICAL = "Immediate review recommended. Examine this clause together with all connected conflicting clauses and determine which requirement should prevail."
ACT_HIGH = "Review this clause and its connected conflicting clauses. Verify whether the conflicting obligations, permissions, or prohibitions can coexist."
ACT_HIGH_ALONE = "Review this clause for potential contractual conflict before finalizing the agreement."
ACT_MEDIUM = "Consider reviewing this clause and checking its related contractual provisions."
ACT_NONE = "No immediate action is required based on the current conflict analysis."
# --- end of fixed values ------------------------------------------------------------------------------------------


def recommendation(kind: Column) -> Column:
    out = F.lit(REVIEW)
    for name, text in ADVICE.items():
        out = F.when(kind == name, text).otherwise(out)
    return out


def resolved(edges: DataFrame) -> DataFrame:
    """Edges with severity, advice and suggested_revision; a deadline conflict's severity is always written 'high'."""
    level = ladder(F.col("weight"), (0.90, "Critical"), (0.70, "High"), (0.50, "Medium"), otherwise="Low")
    advice = recommendation(F.col("conflict_type"))
    return edges.withColumn("severity", F.when(F.col("conflict_type") == "temporal_deadline_conflict", "high").otherwise(level)).withColumn("advice", advice).withColumn("suggested_revision", advice)


def risk_text(risk: DataFrame) -> DataFrame:
    """risk rows (node_risk()) with text, the explanation of the risk score."""
    c, n = F.col, lambda x: fixed(F.col(x), 3)
    alone = F.concat(F.lit("Clause "), c("node_id"), F.lit(" has no detected conflict connections in the current graph. Its risk is therefore "), c("level"), F.lit(" with a score of "), n("risk"), F.lit("."))
    types = F.coalesce(absent(F.array_join("types", ", ")), F.lit("unspecified conflict"))
    linked = F.concat(
        F.lit("Clause "), c("node_id"), F.lit(" has a direct conflict score of "), n("direct"), F.lit(" and a propagated conflict score of "), n("propagated"), F.lit(". It is connected to "),
        c("degree").cast("string"), F.lit(" conflict edge(s), giving a connectivity value of "), n("density"), F.lit(". The strongest detected conflict type is "), types,
        F.lit(". These factors produce a final risk score of "), n("risk"), F.lit(", classified as "), c("level"), F.lit("."),
    )
    return risk.withColumn("text", F.when(c("degree") == 0, alone).otherwise(linked))


def records(risk: DataFrame) -> DataFrame:
    """Risk records with every field that an explanation uses; what is not there gets its default, rows without id go."""
    have = lambda name, other: F.coalesce(F.col(name), other) if name in risk.columns else other
    none = F.array().cast("array<string>")
    zero, kinds = F.lit(0.0), have("types", none)
    if "types" in risk.columns and risk.schema["types"].dataType.simpleString() == "string":
        kinds = F.when(F.col("types").isNull(), none).otherwise(F.array("types"))
    return risk.where("node_id IS NOT NULL").select(
        "node_id", have("text", have("clause_text", F.lit(""))).alias("text"), have("risk", zero).alias("risk"), have("level", F.lit("minimal")).alias("level"), have("direct", zero).alias("direct"),
        have("propagated", zero).alias("propagated"), have("degree", F.lit(0)).cast("long").alias("degree"), have("density", zero).alias("density"), have("severity", zero).alias("severity"),
        have("hotspot", F.lit("none")).alias("hotspot"), kinds.alias("types"), have("neighbours", none).alias("neighbours"),
    )


def record(risk: DataFrame, node_id: str) -> DataFrame:
    """The record of one node; a ValueError if there is none."""
    found = risk.where(F.col("node_id") == node_id)
    if found.isEmpty():
        raise ValueError(f"no risk record of node {node_id}")
    return found.limit(1)


def explained(risk: DataFrame) -> DataFrame:
    """records() with explanation and action (what to do by level and degree)."""
    c = F.col
    direct = ladder(c("direct"), *DIRECT, otherwise=DIRECT_WEAK)
    spread = F.when(c("degree") == 0, SPREAD_ALONE).when(c("propagated") >= 0.80, SPREAD_STRONG).when(c("propagated") >= 0.50, SPREAD_MODERATE).otherwise(SPREAD_LIMITED)
    links = F.concat(F.lit("The clause is connected to "), c("degree").cast("string"), F.lit(" conflict edge(s), with a conflict density of "), fixed(c("density"), 3), F.lit("."))
    kinds = F.concat(F.lit("Detected conflict types include: "), F.array_join("types", ", "), F.lit("."))
    near = F.concat(F.lit("The clause is connected to the following conflicting clauses: "), F.array_join("neighbours", ", "), F.lit("."))
    text = F.concat_ws(
        " ", F.concat(F.lit("Clause "), c("node_id"), F.lit(" has a risk score of "), fixed(c("risk"), 3), F.lit(", classified as "), c("level"), F.lit(".")),
        F.when(c("direct") > 0, direct).otherwise(DIRECT_NONE), spread, F.when(c("degree") == 0, LINKS_NONE).otherwise(links),
        F.when(c("severity") > 0, ladder(c("severity"), *GRAVE, otherwise=GRAVE_LOW)).otherwise(GRAVE_NONE),
        F.when(F.size("types") > 0, kinds).otherwise("No specific conflict type was recorded."), F.when(F.size("neighbours") > 0, near).otherwise("No conflicting neighboring clauses were identified."),
    )
    act = F.when(c("level") == "critical", ACT_CRITICAL).when(c("level") == "high", F.when(c("degree") > 0, ACT_HIGH).otherwise(ACT_HIGH_ALONE)).when(c("level") == "medium", ACT_MEDIUM).otherwise(ACT_NONE)
    return records(risk).withColumn("explanation", text).withColumn("action", act)


def explanation_report(rows: DataFrame, n: int = 10) -> DataFrame:
    """(kind, key, value): how many of explained() rows are in each level, then the n with most risk."""
    top = rows.orderBy(F.desc(F.round("risk", 9)), "node_id").limit(n)
    counts = rows.groupBy("level").agg(F.count(F.lit(1)).alias("n")).select(F.lit("level").alias("kind"), F.col("level").alias("key"), F.col("n").cast("double").alias("value"))
    return counts.unionByName(top.select(F.lit("top").alias("kind"), F.col("node_id").alias("key"), F.round("risk", 4).alias("value")))
