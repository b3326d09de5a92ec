r"""Queries over draft clauses, each with SQL whose lists and patterns are written out here, not taken from the functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import reasoning as R
from ..operators import retrieval as S
from ..operators.repeated import once
from ..sources.synth import DRAFT_SQL, synth_drafts
from . import oracles as O

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def _even(c: str):
    """To six places; a value halfway between two is taken up on both sides, whichever way it was summed."""
    return F.round(F.col(c) + 1e-9, 6)


_DRAFTS = f"drafts AS MATERIALIZED ({DRAFT_SQL})"


def _rep(x: str, pattern: str, by: str = " ") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def _norm(x: str) -> str:
    return _rep(_rep(f"lower({x})", r"\s+"), r"^\s+|\s+$", "")


# --- fixed values, as the SQL needs them ------------------------------------------------------------------------------
_CORE = _norm("text")
for _p in ("shall not", "must not", "may not", "will not", "cannot", "shall", "must", "may", "will"):
    _CORE = _rep(_CORE, rf"\b{_p}\b")
_MODAL_FIRST_SHORT = "shall|shall not|must|must not|may|may not|will|will not|cannot|is required to|are required to|is permitted to|are permitted to"
_CLEAN = _norm(_rep(_rep(_norm("text"), rf"\b(?:{_MODAL_FIRST_SHORT})\b"), r"\b(?:the|a|an|any|such|herein|thereof|thereto|provided that|notwithstanding the foregoing)\b"))
_NORMAL = _norm("text")
for _p in (
    "the foregoing", "notwithstanding the foregoing", "without limiting the foregoing", "for the avoidance of doubt", "in addition", "provided that", "subject to", "in the event that",
    "except as set forth in", "except as provided in", "with respect to", "on behalf of",
):
    _NORMAL = _rep(_NORMAL, rf"\b{_p}\b")
_NORMAL = _rep(_NORMAL, r"\b(?:shall not|must not|may not|will not|shall|must|may|will|cannot|is required to|are required to|is permitted to|are permitted to)\b")
_ASCII = "regexp_replace({0}, '[^\\x00-\\x7F]', '_', 'g')"  # a letter beyond ASCII is part of its word


def _words(x: str) -> str:
    return f"regexp_extract_all({_ASCII.format(x)}, '\\b[a-z]{{3,}}\\b')"


_NORMAL = (
    f"array_to_string(list_filter({_words(_NORMAL)}, lambda w: w NOT IN ('the', 'a', 'an', 'any', 'such', 'this', 'that', 'herein', 'thereof', 'thereto', 'therein', 'foregoing', "
    "'agreement', 'section', 'article', 'party', 'parties')), ' ')"
)
_TOKENS = (
    f"list_distinct(list_filter({_words(_norm('text'))}, lambda w: w NOT IN ('the', 'and', 'or', 'of', 'to', 'a', 'an', 'any', 'such', 'this', 'that', 'shall', 'must', 'may', 'will', 'not', 'be', 'is', "
    "'are', 'for', 'in', 'on', 'with', 'by', 'from', 'under', 'as', 'its', 'their', 'party', 'parties')))"
)
_CUT = _norm(_rep(_rep(_norm("text"), r"\b(?:provided that|notwithstanding|subject to|in the event that)\b.*", ""), r"\b(?:shall not|shall|must not|must|may not|may|will not|will|cannot|is required to|are required to|is permitted to|are permitted to)\b"))
_VERBS = (
    "'disclose', 'discloses', 'disclosing', 'use', 'uses', 'using', 'receive', 'receives', 'receiving', 'provide', 'provides', 'providing', 'return', 'returns', 'returning', 'destroy', 'destroys', "
    "'destroying', 'retain', 'retains', 'retaining', 'assign', 'assigns', 'assigning', 'transfer', 'transfers', 'transferring', 'notify', 'notifies', 'notifying', 'pay', 'pays', 'paying', 'deliver', "
    "'delivers', 'delivering', 'terminate', 'terminates', 'terminating', 'modify', 'modifies', 'modifying', 'reverse', 'reverse-engineer'"
)
_SUBJECT = "CASE " + " ".join(f"WHEN contains(rest, '{p}') THEN '{p}'" for p in ("receiving party", "disclosing party", "company", "contractor", "buyer", "seller", "vendor", "customer", "employer", "employee", "party", "parties")) + " ELSE '' END"
_MODALITY = (
    "CASE WHEN regexp_matches(lower(text), '\\b(?:shall not|must not|may not|cannot|will not|prohibited)\\b') THEN 'prohibition' WHEN regexp_matches(lower(text), '\\b(?:shall|must|is required to|are required to|will)\\b') "
    "THEN 'obligation' WHEN regexp_matches(lower(text), '\\b(?:may|permitted to|allowed to|entitled to)\\b') THEN 'permission' ELSE 'none' END"
)
_NEGATION = "regexp_matches(lower(text), '\\b(?:not|no|never|without|prohibited|forbidden)\\b')"
_EXCEPTION = "regexp_matches(lower(text), '\\b(?:unless|except|except as|except that|provided that|subject to|notwithstanding|in the event that|to the extent that|if|only if)\\b')::INT"
_NEG_MODAL = "regexp_matches({0}, '\\b(?:shall not|must not|may not|will not|cannot)\\b')"
_POS_MODAL = "(regexp_matches({0}, '\\b(?:shall|must|may|will)\\b') AND NOT regexp_matches({0}, '\\b(?:shall not|must not|may not|will not|cannot)\\b'))"


def _found(patterns: tuple[str, ...], x: str = "text") -> str:
    """Distinct matches in the order of the patterns, then of the text."""
    lists = ", ".join(f"regexp_extract_all({x}, '(?i){p}')" for p in patterns)
    all_of = f"list_concat({lists})"
    return f"list_filter({all_of}, lambda v, i: list_position({all_of}, v) = i)"


_TIMES = _found((
    r"\bwithin\s+\d+\s+(?:day|days|hour|hours|month|months|year|years)\b", r"\bafter\s+\d+\s+(?:day|days|month|months|year|years)\b", r"\bbefore\s+\d+\s+(?:day|days|month|months|year|years)\b",
    r"\bfor\s+\d+\s+(?:day|days|month|months|year|years)\b", r"\buntil\b[^,.;]*", r"\bfrom\b[^,.;]*\buntil\b[^,.;]*",
))
_NUMBERS = _found((r"\b\d+(?:\.\d+)?\s*%", r"\b\d+(?:\.\d+)?\s+(?:day|days|hour|hours|month|months|year|years)\b", r"\b(?:USD|EUR|GBP|INR|\$|€|£)\s*\d+(?:,\d{3})*(?:\.\d+)?\b", r"\b\d+(?:,\d{3})*(?:\.\d+)?\b"))
_PARTIES = _found(tuple(rf"\b{p}\b" for p in ("receiving party", "disclosing party", "buyer", "seller", "vendor", "customer", "company", "employer", "employee", "party", "parties")), "lower(text)")
_CONDITIONS = _found((
    r"\bif\b[^,.;]*", r"\bunless\b[^,.;]*", r"\bprovided that\b[^,.;]*", r"\bsubject to\b[^,.;]*", r"\bin the event that\b[^,.;]*", r"\bwhere\b[^,.;]*", r"\bonly if\b[^,.;]*", r"\bexcept\b[^,.;]*",
    r"\bexcept that\b[^,.;]*", r"\bfor\b[^,.;]*transactions", r"\bwith respect to\b[^,.;]*",
))
# --- end of fixed values ----------------------------------------------------------------------------------------------
_bar = lambda x: f"array_to_string({x}, '|')"


@query("b23_draft_extractors", f"WITH {_DRAFTS} SELECT clause_id, {_bar(_TIMES)} AS times, {_bar(_NUMBERS)} AS numbers, {_bar(_PARTIES)} AS parties, {_bar(_CONDITIONS)} AS conditions_kept FROM drafts")
def b23(spark, d):
    """Lists in their order, the conditions as they are written."""
    x = F.col("text")
    cols = {"times": T.times(x), "numbers": T.numbers(x), "parties": T.draft_parties(x), "conditions_kept": T.draft_conditions(x, True)}
    rows = once(synth_drafts(spark, d).select("clause_id", "text"), lambda texts: texts.withColumns({k: F.array_join(v, "|") for k, v in cols.items()}))
    return rows.drop("text")


@query("b24_proposition_struct", f"WITH {_DRAFTS} SELECT clause_id, {_MODALITY} AS modality, {_NEGATION} AS negation, len({_TIMES})::BIGINT AS temporal, len({_NUMBERS})::BIGINT AS numbers FROM drafts")
def b24(spark, d):
    rows = synth_drafts(spark, d).withColumn("p", T.draft_proposition(F.col("text"))).select("clause_id", "p.*")
    return rows.select("clause_id", "modality", "negation", F.size("temporal").cast("long").alias("temporal"), F.size("numbers").cast("long").alias("numbers"))


@query("b27_normal_forms", f"WITH {_DRAFTS} SELECT clause_id, {_norm('text')} AS clause, {_norm(_CORE)} AS core, {_CLEAN} AS clean, {_NORMAL} AS normal, {_bar(f'list_sort({_TOKENS})')} AS tokens FROM drafts")
def b27(spark, d):
    x = F.col("text")
    forms = {"clause": T.normalize_clause(x), "core": T.action_core(x), "clean": T.clean_proposition(x), "normal": T.normalize_proposition(x), "tokens": F.array_join(T.proposition_tokens(x), "|")}
    return once(synth_drafts(spark, d).select("clause_id", "text"), lambda texts: texts.withColumns(forms)).drop("text")


@query("b29_structured_clauses", f"""WITH {_DRAFTS} SELECT clause_id, {_MODALITY} AS modality, {_NEGATION} AS negation, {_bar(f"list_sort(list_distinct(list_transform({_CONDITIONS}, lambda c: {_rep('lower(c)', r'^\s+|\s+$', '')})))")} AS conditions,
 {_bar(_PARTIES)} AS parties, {_CLEAN} AS proposition, {_EXCEPTION} AS exception FROM drafts""")
def b29(spark, d):
    rows = once(synth_drafts(spark, d).select("clause_id", "text"), lambda texts: R.structured_facts(texts).withColumn("exception", T.exception_flag(F.col("text"))))
    return rows.select("clause_id", "modality", "negation", F.array_join(F.array_sort("conditions"), "|").alias("conditions"), F.array_join("parties", "|").alias("parties"), "proposition", "exception")


@query("b31_proposition_parts", f"""WITH {_DRAFTS}, cut AS (SELECT clause_id, {_CUT} AS rest FROM drafts), toks AS (SELECT *, {_words("rest")} AS t FROM cut),
 acts AS (SELECT *, list_filter(t, lambda w: w IN ({_VERBS}))[1] AS act FROM toks)
 SELECT clause_id, CASE WHEN len(t) > 0 THEN {_SUBJECT} ELSE '' END AS subject, coalesce(act, '') AS action,
  array_to_string(list_slice(list_filter(CASE WHEN act IS NULL THEN t ELSE t[list_position(t, act) + 1:] END, lambda w: w NOT IN ('the', 'and', 'or', 'any', 'such', 'information', 'agreement', 'foregoing')), 1, 12), ' ') AS object FROM acts""")
def b31(spark, d):
    rows = once(synth_drafts(spark, d).select("clause_id", "text"), lambda texts: texts.withColumn("s", T.subject_action_object(F.col("text"))))
    return rows.select("clause_id", "s.*")


@query("b37_pair_texts", f"WITH {_DRAFTS} SELECT clause_id, 'Hypothesis: ' || document_id || ' [SEP] Clause: ' || text AS pair, 'Hypothesis: ' || document_id || ' [SEP] Contract Context: ' || text AS context, document_id || ' [SEP] ' || text AS plain FROM drafts")
def b37(spark, d):
    h, x = F.col("document_id"), F.col("text")
    return synth_drafts(spark, d).select("clause_id", T.pair_text(h, x).alias("pair"), T.context_text(h, x).alias("context"), T.plain_pair_text(h, x).alias("plain"))


_TF = f"""{_DRAFTS}, tfs AS MATERIALIZED (SELECT clause_id, g, count(*) AS tf FROM ({O.grams("drafts", "clause_id", "strip_accents(text)")}) GROUP BY ALL),
 dfs AS (SELECT g, count(*) AS df, sum(tf) AS total FROM tfs GROUP BY g HAVING count(*) >= 2), vocab AS (SELECT g, ln((1 + (SELECT count(*) FROM drafts)) / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT * FROM dfs ORDER BY total DESC, g LIMIT 100)),
 raw AS (SELECT clause_id, g, (1 + ln(tf)) * idf AS w FROM tfs JOIN vocab USING (g)), weights AS (SELECT clause_id, g, w / sqrt(sum(w * w) OVER (PARTITION BY clause_id)) AS weight FROM raw)"""


@query("c02_capped_vocabulary", f"WITH {_TF} SELECT clause_id, g AS term, round(weight, 6) AS weight FROM weights")
def c02(spark, d):
    """Of terms in two clauses or more the hundred most frequent; accents are stripped."""
    rows = synth_drafts(spark, d).select(F.col("clause_id").alias("id"), "text")
    return S.tfidf(rows, max_features=100, min_df=2).select(F.col("id").alias("clause_id"), "term", F.round("weight", 6).alias("weight"))


_ASK = f"""{_DRAFTS}, asked AS (SELECT document_id, rn, clause_id AS query_id, text FROM drafts WHERE rn <= 2),
 tc AS MATERIALIZED (SELECT clause_id, g, count(*) AS tf FROM ({O.grams("drafts", "clause_id", "text")}) GROUP BY ALL),
 voc AS MATERIALIZED (SELECT g, ln((1 + (SELECT count(*) FROM drafts)) / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT g, count(*) AS df, sum(tf) AS total FROM tc GROUP BY g ORDER BY total DESC, g LIMIT 30000)),
 wc AS MATERIALIZED (SELECT clause_id, g, w / sqrt(sum(w * w) OVER (PARTITION BY clause_id)) AS v FROM (SELECT clause_id, g, (1 + ln(tf)) * idf AS w FROM tc JOIN voc USING (g))),
 pr AS (SELECT a.document_id, a.query_id, b.clause_id, b.rn FROM asked a JOIN drafts b ON a.document_id = b.document_id),
 px AS MATERIALIZED (SELECT p.query_id, p.clause_id, x.g, x.v FROM pr p JOIN wc x ON x.clause_id = p.query_id), dd AS (SELECT px.query_id, px.clause_id, sum(px.v * y.v) AS dot FROM px JOIN wc y ON y.clause_id = px.clause_id AND y.g = px.g GROUP BY ALL),
 rk AS (SELECT pr.*, coalesce(dot, 0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(dot, 0), 9) DESC, rn DESC) AS rank FROM pr LEFT JOIN dd USING (query_id, clause_id))"""


def _retrieved(spark, d, k):
    rows = synth_drafts(spark, d)
    clauses = rows.select("document_id", F.col("clause_id").alias("id"), F.col("rn").alias("ord"), "text")
    return rows, clauses, S.retrieve(rows.where("rn <= 2").select("document_id", F.col("clause_id").alias("query_id"), "text"), clauses, k)


@query("c09_retrieve_ties_reversed", f"WITH {_ASK} SELECT query_id, clause_id, round(score, 6) AS score, rank FROM rk WHERE rank <= 3")
def c09(spark, d):
    return _retrieved(spark, d, 3)[2].select("query_id", F.col("id").alias("clause_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("c10_contexts", f"WITH {_ASK} SELECT query_id, md5(string_agg(t.text, ' ' ORDER BY rank)) AS digest FROM rk JOIN drafts t USING (clause_id) WHERE rank <= 3 GROUP BY query_id")
def c10(spark, d):
    rows, _, found = _retrieved(spark, d, 3)
    texts = found.join(rows.select(F.col("clause_id").alias("id"), "text"), "id")
    return S.contexts(texts, 3).select("query_id", F.md5("context").alias("digest"))


@query("c11_clause_pairs", f"WITH {_ASK} SELECT query_id AS label_id, clause_id AS span_id, md5(a.text || '|' || t.text) AS digest, round(score, 6) AS retrieval_score FROM rk JOIN drafts t USING (clause_id) JOIN asked a USING (query_id) WHERE rank <= 2")
def c11(spark, d):
    rows, clauses, _ = _retrieved(spark, d, 2)
    examples = rows.where("rn <= 2").select("document_id", F.col("clause_id").alias("label_id"), F.col("text").alias("hypothesis"))
    return S.clause_pairs(examples, clauses, 2).select("label_id", "span_id", F.md5(F.concat("hypothesis", F.lit("|"), "clause")).alias("digest"), F.round("retrieval_score", 6).alias("retrieval_score"))


# queries are the first clauses of the documents; candidates the next two, one of another document, one unknown
_HYGIENE = f"""{_DRAFTS}, q AS (SELECT document_id, clause_id AS query_id, l_orderkey % 7 <> 0 AS has_scores FROM (SELECT *, substr(document_id, 5)::BIGINT AS l_orderkey FROM drafts WHERE rn = 1)),
 cands AS (SELECT q.document_id, q.query_id, d.clause_id FROM q JOIN drafts d ON d.document_id = q.document_id AND d.rn BETWEEN 2 AND 3
   UNION ALL SELECT document_id, query_id, 'lost_' || query_id FROM q WHERE substr(document_id, 5)::BIGINT % 3 = 0 UNION ALL SELECT document_id, query_id, 'ord_1_draft_0001' FROM q WHERE substr(document_id, 5)::BIGINT % 5 = 0),
 gold AS (SELECT document_id, query_id, clause_id FROM q JOIN drafts USING (document_id) WHERE rn IN (2, 5) AND substr(document_id, 5)::BIGINT % 4 <> 0),
 st AS (SELECT q.*, EXISTS (SELECT 1 FROM gold g WHERE g.query_id = q.query_id) AS g, count(c.clause_id) AS n, count(*) FILTER (WHERE c.clause_id IS NOT NULL AND d.clause_id IS NULL) AS unknown, count(*) FILTER (WHERE d.document_id = q.document_id) AS kept
   FROM q LEFT JOIN cands c USING (query_id) LEFT JOIN drafts d ON d.clause_id = c.clause_id GROUP BY ALL),
 reached AS (SELECT *, g AND n > 0 AND has_scores AS r FROM st)"""


def _candidates(spark, d):
    rows = synth_drafts(spark, d)
    n = F.substring("document_id", 5, 20).cast("long")
    q = rows.where("rn = 1").select("document_id", F.col("clause_id").alias("query_id"), (n % 7 != 0).alias("has_scores"))
    key = q.select("document_id", "query_id")
    own = key.join(rows.where("rn BETWEEN 2 AND 3").select("document_id", "clause_id"), "document_id").select("document_id", "query_id", "clause_id")
    cands = own.unionByName(key.where(n % 3 == 0).withColumn("clause_id", F.concat(F.lit("lost_"), "query_id"))).unionByName(key.where(n % 5 == 0).withColumn("clause_id", F.lit("ord_1_draft_0001")))
    gold = key.where(n % 4 != 0).join(rows.where("rn IN (2, 5)").select("document_id", "clause_id"), "document_id").select("document_id", "query_id", "clause_id")
    kept, counts = S.clean_candidates(q, cands, gold, rows)
    return kept, counts, gold


@query("c16_candidate_hygiene", f"""WITH {_HYGIENE} SELECT count(*) FILTER (WHERE NOT g) AS missing_gold, count(*) FILTER (WHERE (g AND n = 0) OR (r AND kept = 0)) AS missing_candidates, count(*) FILTER (WHERE g AND n > 0 AND NOT has_scores) AS missing_scores,
 coalesce(sum(unknown) FILTER (WHERE r), 0)::BIGINT AS missing_clause_ids, count(*) FILTER (WHERE r AND kept > 0) AS queries FROM reached""")
def c16(spark, d):
    return _candidates(spark, d)[1]


@query("c17_candidate_coverage", f"""WITH {_HYGIENE}, hit AS (SELECT r.query_id, max((gold.clause_id IS NOT NULL)::INT) AS hit FROM reached r JOIN cands c USING (query_id) JOIN drafts d ON d.clause_id = c.clause_id AND d.document_id = r.document_id
   LEFT JOIN gold ON gold.query_id = r.query_id AND gold.clause_id = c.clause_id WHERE r.r AND r.kept > 0 GROUP BY 1)
 SELECT count(*) AS queries, sum(hit)::BIGINT AS covered, round(avg(hit), 6) AS coverage FROM hit""")
def c17(spark, d):
    kept, _, gold = _candidates(spark, d)
    return S.coverage(kept, gold).withColumn("coverage", F.round("coverage", 6))


@query("c23_candidate_ids", f"WITH {_DRAFTS}, g AS (SELECT document_id, list(clause_id ORDER BY rn) AS ids, count(*) AS n FROM drafts GROUP BY 1) SELECT document_id, array_to_string(CASE WHEN n % 2 = 1 THEN list_slice(ids, 1, 2) ELSE ids END, '|') AS ids FROM g")
def c23(spark, d):
    """Lists of two with a repetition where there are an odd number of clauses; elsewhere none, and the scores' keys count."""
    per = synth_drafts(spark, d).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("rn", "clause_id"))).alias("x"))
    ids = F.transform("x", lambda e: e["clause_id"])
    listed = F.when(F.size(ids) % 2 == 1, F.concat(F.slice(ids, 1, 2), F.slice(ids, 1, 1)))
    return per.select("document_id", F.array_join(S.candidate_ids(listed, F.map_from_arrays(ids, F.transform(ids, lambda e: F.lit(0.5)))), "|").alias("ids"))


@query("c24_row_cosines", """WITH p AS (SELECT a.vec_id, a.embedding AS x, CASE WHEN a.vec_id % 3 = 0 THEN list_transform(b.embedding, lambda v: 0.0) ELSE b.embedding END AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
 SELECT vec_id, round(coalesce(list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i]::DOUBLE * y[i]::DOUBLE)) / nullif(sqrt(list_sum(list_transform(x, lambda v: v::DOUBLE * v::DOUBLE))) * sqrt(list_sum(list_transform(y, lambda v: v::DOUBLE * v::DOUBLE))), 0), 0), 6) AS cosine FROM p""")
def c24(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    both = v.select("vec_id", F.col("embedding").alias("x")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    y = F.when(F.col("vec_id") % 3 == 0, F.transform("y", lambda e: e * 0)).otherwise(F.col("y"))
    return both.select("vec_id", F.round(S.cosine(F.col("x"), y), 6).alias("cosine"))


_PAIR = f"""{_DRAFTS}, made AS MATERIALIZED (SELECT document_id, rn, clause_id, text, {_norm("text")} AS low, {_MODALITY} AS m, {_PARTIES} AS parties, list_distinct(list_transform({_CONDITIONS}, lambda c: {_rep('lower(c)', r'^\s+|\s+$', '')})) AS conds,
   {_TOKENS} AS prop, list_distinct({_words(_NORMAL)}) AS core, {_CLEAN} AS clean, list_distinct({_words(_CLEAN)}) AS said, {_EXCEPTION} AS exc FROM drafts),
 ptf AS MATERIALIZED (SELECT document_id, rn, clause_id, g, 1 + ln(count(*)) AS t FROM ({O.grams("drafts", "document_id, rn, clause_id")}) GROUP BY ALL), psz AS (SELECT clause_id, sum(t * t) AS s2 FROM ptf GROUP BY clause_id),
 pdot AS MATERIALIZED (SELECT x.clause_id AS clause_a, y.clause_id AS clause_b, sum(x.t * y.t) AS dot, sum(x.t * x.t) AS sa, sum(y.t * y.t) AS sb FROM ptf x JOIN ptf y ON x.document_id = y.document_id AND x.g = y.g AND x.rn < y.rn GROUP BY ALL),
 two AS MATERIALIZED (SELECT a.clause_id AS clause_a, b.clause_id AS clause_b, a.text AS text_a, b.text AS text_b, a.m AS ma, b.m AS mb, a.clean AS cla, b.clean AS clb,
   coalesce(pd.dot / sqrt((pd.sa + {O.LN3_2}::DOUBLE ** 2 * (u.s2 - pd.sa)) * (pd.sb + {O.LN3_2}::DOUBLE ** 2 * (v.s2 - pd.sb))), 0) AS sem,
   CASE WHEN (a.m = 'prohibition' AND b.m IN ('obligation', 'permission')) OR (b.m = 'prohibition' AND a.m IN ('obligation', 'permission')) THEN 1.0 ELSE 0.0 END::DOUBLE AS mod,
   (({_POS_MODAL.format("a.low")} AND {_NEG_MODAL.format("b.low")}) OR ({_POS_MODAL.format("b.low")} AND {_NEG_MODAL.format("a.low")}))::INT::DOUBLE AS neg,
   len(list_intersect(a.prop, b.prop)) AS pi, len(list_distinct(list_concat(a.prop, b.prop))) AS pu, least(len(a.prop), len(b.prop)) AS ps,
   len(list_intersect(a.said, b.said)) AS si, len(list_distinct(list_concat(a.said, b.said))) AS su, len(list_intersect(a.core, b.core)) AS ci, len(list_distinct(list_concat(a.core, b.core))) AS cu,
   len(list_intersect(a.conds, b.conds)) AS ni, len(list_distinct(list_concat(a.conds, b.conds))) AS nu, len(a.conds) AS na, len(b.conds) AS nb,
   len(list_intersect(a.parties, b.parties)) AS yi, len(list_distinct(list_concat(a.parties, b.parties))) AS yu, greatest(a.exc, b.exc) AS exc
   FROM made a JOIN made b ON a.document_id = b.document_id AND a.rn < b.rn LEFT JOIN pdot pd ON pd.clause_a = a.clause_id AND pd.clause_b = b.clause_id LEFT JOIN psz u ON u.clause_id = a.clause_id LEFT JOIN psz v ON v.clause_id = b.clause_id),
 feat AS MATERIALIZED (SELECT *, CASE WHEN cla = clb AND cla <> '' THEN 1.0 WHEN su > 0 THEN si / su::DOUBLE ELSE 0 END AS prop, CASE WHEN pu > 0 THEN pi / pu::DOUBLE ELSE 0 END AS jac, CASE WHEN ps > 0 THEN pi / ps::DOUBLE ELSE 0 END AS overlap,
   CASE WHEN cu > 0 THEN ci / cu::DOUBLE ELSE 0 END AS core, CASE WHEN nu > 0 THEN ni / nu::DOUBLE ELSE 1 END AS cond, CASE WHEN yu > 0 THEN yi / yu::DOUBLE ELSE 1 END AS party,
   CASE WHEN na = 0 AND nb = 0 THEN 1.0 WHEN na = 0 OR nb = 0 THEN 0.5 WHEN ni > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS scope FROM two),
 fam AS MATERIALIZED (SELECT *, 0.40::DOUBLE * sem + 0.35::DOUBLE * prop + 0.25::DOUBLE * mod AS structured_score, 0.25::DOUBLE * sem + 0.30::DOUBLE * prop + 0.20::DOUBLE * mod + 0.15::DOUBLE * cond + 0.10::DOUBLE * party AS final_structured_score,
   0.35::DOUBLE * prop + 0.25::DOUBLE * mod + 0.20::DOUBLE * neg + 0.10::DOUBLE * cond + 0.10::DOUBLE * party AS structured_conflict_score,
   (0.55::DOUBLE * overlap + 0.20::DOUBLE * prop + 0.15::DOUBLE * mod + 0.10::DOUBLE * cond) * CASE WHEN overlap < 0.35 THEN 0.25 ELSE 1 END::DOUBLE AS strict,
   (0.45::DOUBLE * jac + 0.25::DOUBLE * prop + 0.20::DOUBLE * cond + 0.10::DOUBLE * party) * CASE WHEN mod = 0 THEN 0.10 ELSE 1 END::DOUBLE * CASE WHEN jac < 0.30 THEN 0.10 ELSE 1 END::DOUBLE AS aligned,
   (0.45::DOUBLE * core + 0.20::DOUBLE * jac + 0.20::DOUBLE * mod + 0.15::DOUBLE * party) * CASE WHEN mod = 0 THEN 0.10 ELSE 1 END::DOUBLE * CASE WHEN core < 0.30 THEN 0.10 ELSE 1 END::DOUBLE * CASE WHEN exc = 1 THEN 0.60 ELSE 1 END::DOUBLE AS scoped,
   0.40::DOUBLE * core + 0.20::DOUBLE * jac + 0.15::DOUBLE * party + 0.15::DOUBLE * cond + 0.10::DOUBLE * mod AS reason FROM feat),
 late AS MATERIALIZED (SELECT *, (0.30::DOUBLE * core + 0.20::DOUBLE * jac + 0.20::DOUBLE * scoped + 0.15::DOUBLE * aligned + 0.10::DOUBLE * mod + 0.05::DOUBLE * neg) * CASE WHEN core < 0.25 THEN 0.25 ELSE 1 END::DOUBLE AS v1,
   0.30::DOUBLE * core + 0.20::DOUBLE * jac + 0.15::DOUBLE * scope + 0.20::DOUBLE * mod + 0.15::DOUBLE * reason AS v2, 0.35::DOUBLE * strict + 0.30::DOUBLE * aligned + 0.20::DOUBLE * scoped + 0.10::DOUBLE * mod + 0.05::DOUBLE * neg AS v3,
   0.20::DOUBLE * core + 0.10::DOUBLE * jac + 0.10::DOUBLE * scope + 0.25::DOUBLE * strict + 0.10::DOUBLE * aligned + 0.05::DOUBLE * reason + 0.10::DOUBLE * mod + 0.05::DOUBLE * neg + 0.025::DOUBLE * cond + 0.025::DOUBLE * party AS v4,
   0.35::DOUBLE * strict + 0.25::DOUBLE * aligned + 0.20::DOUBLE * mod + 0.15::DOUBLE * neg + 0.05::DOUBLE * scope AS v5,
   0.25::DOUBLE * core + 0.15::DOUBLE * jac + 0.10::DOUBLE * scope + 0.15::DOUBLE * strict + 0.15::DOUBLE * aligned + 0.10::DOUBLE * mod + 0.05::DOUBLE * neg + 0.05::DOUBLE * reason AS evid,
   0.60::DOUBLE * (0.35::DOUBLE * core + 0.20::DOUBLE * jac + 0.15::DOUBLE * scope + 0.15::DOUBLE * cond + 0.15::DOUBLE * party) + 0.40::DOUBLE * (0.35::DOUBLE * strict + 0.25::DOUBLE * aligned + 0.20::DOUBLE * mod + 0.10::DOUBLE * neg + 0.10::DOUBLE * reason) AS n1,
   0.60::DOUBLE * (0.50::DOUBLE * core + 0.50::DOUBLE * jac) + 0.40::DOUBLE * (0.70::DOUBLE * strict + 0.30::DOUBLE * aligned) AS n2, 0.60::DOUBLE * (0.50::DOUBLE * core + 0.50::DOUBLE * jac) + 0.40::DOUBLE * (0.50::DOUBLE * strict + 0.50::DOUBLE * aligned) AS n3 FROM fam)"""
_FIRST = ("structured_score", "final_structured_score", "structured_conflict_score", "strict_conflict_score", "aligned_conflict_score", "scope_aware_score", "clause_reasoning_score")


def _drafted(spark, d):
    return R.draft_pairs(synth_drafts(spark, d))


@query("d27_draft_features", f"WITH {_PAIR} SELECT clause_a, clause_b, mod, neg, round(sem, 6) AS sem, round(prop, 6) AS proposition, round(cond, 6) AS condition, round(party, 6) AS party, round(overlap, 6) AS overlap, round(jac, 6) AS jaccard, round(core, 6) AS core, scope, exc::BIGINT AS exception FROM feat")
def d27(spark, d):
    names = {"sem": "sem", "prop_similarity": "proposition", "cond": "condition", "party": "party", "overlap": "overlap", "prop": "jaccard", "core": "core"}
    return _drafted(spark, d).select("clause_a", "clause_b", "mod", "neg", *[F.round(a, 6).alias(b) for a, b in names.items()], "scope", F.col("exception").cast("long").alias("exception"))


@query("d30_score_families", f"WITH {_PAIR} SELECT clause_a, clause_b, " + ", ".join(f"round({x} + 1e-9, 6) AS {n}" for x, n in zip(("structured_score", "final_structured_score", "structured_conflict_score", "strict", "aligned", "scoped", "reason"), _FIRST, strict=True)) + " FROM fam")
def d30(spark, d):
    return _drafted(spark, d).select("clause_a", "clause_b", *[_even(n).alias(n) for n in _FIRST])


_LATER = {
    "v1": "final_conflict_score_1", "v2": "final_conflict_score_2", "v3": "final_conflict_score_3", "v4": "final_conflict_score_4", "v5": "final_conflict_score_5", "evid": "hybrid_evidence_score",
    "0.5::DOUBLE * evid + 0.5::DOUBLE * v4": "novelty_conflict_score", "n1": "novelty_evidence_score_1", "n2": "novelty_evidence_score_2", "n3": "novelty_evidence_score_3",
}


@query("d30_later_families", f"""WITH {_PAIR} SELECT clause_a, clause_b, {", ".join(f"round({x} + 1e-9, 6) AS {n}" for x, n in _LATER.items())},
 round(v1, 9) >= 0.50 AND ((mod = 1 AND round(core, 9) >= 0.30 AND round(scoped, 9) >= 0.50) OR round(aligned, 9) >= 0.50) AS strong_conflict, round(v2, 9) >= 0.30 AND (round(core, 9) >= 0.35 OR round(jac, 9) >= 0.30) AND mod = 1 AS candidate_conflict FROM late""")
def d30_later(spark, d):
    return _drafted(spark, d).select("clause_a", "clause_b", *[_even(n).alias(n) for n in _LATER.values()], "strong_conflict", "candidate_conflict")


@query("d31_classes", f"""WITH {_PAIR} SELECT clause_a, clause_b, CASE WHEN mod = 1 AND round(prop, 9) >= 0.45 AND round(sem, 9) >= 0.30 THEN 'likely_conflict' WHEN (mod = 1 OR neg = 1) AND round(prop, 9) >= 0.20 AND round(sem, 9) >= 0.25 THEN 'needs_review' ELSE 'likely_non_conflict' END AS structured_class,
 CASE WHEN mod = 1 AND round(prop, 9) >= 0.45 AND round(sem, 9) >= 0.30 AND round(cond, 9) >= 0.50 THEN 'likely_conflict' WHEN (mod = 1 OR neg = 1) AND round(prop, 9) >= 0.20 AND round(sem, 9) >= 0.25 THEN 'needs_review' ELSE 'likely_non_conflict' END AS final_class,
 CASE WHEN mod = 0 THEN 'not_conflicting' WHEN round(core, 9) < 0.30 THEN 'different_proposition' WHEN exc = 1 THEN 'scope_dependent_review' WHEN round(core, 9) >= 0.70 THEN 'strong_conflict' ELSE 'potential_conflict' END AS conflict_category FROM feat""")
def d31(spark, d):
    return _drafted(spark, d).select("clause_a", "clause_b", "structured_class", "final_class", "conflict_category")


@query("d35_evidence_records", f"""WITH {_PAIR}, said AS (SELECT *, concat_ws('; ', CASE WHEN mod = 1 THEN 'modality conflict: ' || ma || ' vs ' || mb END, CASE WHEN neg = 1 THEN 'opposing negation' END, CASE WHEN scope >= 0.8 THEN 'compatible legal scope' END,
   CASE WHEN round(core, 9) >= 0.4 THEN 'similar core proposition' END, CASE WHEN round(jac, 9) >= 0.3 THEN 'substantial proposition overlap' END, CASE WHEN round(cond, 9) >= 0.7 THEN 'similar conditions' END) AS e FROM late)
 SELECT clause_a, clause_b, md5(text_a || '|' || text_b) AS digest, ma AS modality_a, mb AS modality_b, round(v3 + 1e-9, 6) AS conflict_score, CASE WHEN e = '' THEN 'semantic and structural conflict signals' ELSE e END AS explanation FROM said""")
def d35(spark, d):
    rows = R.evidence_records(_drafted(spark, d))
    return rows.select("clause_a", "clause_b", F.md5(F.concat("text_a", F.lit("|"), "text_b")).alias("digest"), "modality_a", "modality_b", _even("conflict_score").alias("conflict_score"), "explanation")


@query("c26_candidate_conflicts", f"WITH {_PAIR} SELECT clause_a, clause_b, round(sem, 6) AS sem, round(sem, 9) >= 0.30 AND (mod = 1 OR neg = 1) AS strong_candidate FROM feat WHERE round(sem, 9) >= 0.15")
def c26(spark, d):
    return R.candidate_conflicts(_drafted(spark, d)).select("clause_a", "clause_b", F.round("sem", 6).alias("sem"), "strong_candidate")


@query("d28_combinations", f"""WITH {_DRAFTS}, picked AS (SELECT document_id FROM (SELECT DISTINCT document_id FROM drafts) ORDER BY md5(document_id), document_id LIMIT 100), m AS (SELECT * FROM (SELECT *, {_MODALITY} AS modality, {_NEGATION} AS negation FROM drafts JOIN picked USING (document_id)) WHERE modality <> 'none')
 SELECT a.clause_id AS clause_id_a, b.clause_id AS clause_id_b, a.modality AS modality_a, b.modality AS modality_b, a.negation AS negation_a, b.negation AS negation_b FROM m a JOIN m b ON a.document_id = b.document_id AND a.rn < b.rn""")
def d28(spark, d):
    """A sample of a hundred documents is what the operator is for."""
    return R.clause_combinations(synth_drafts(spark, d), 100).select("clause_id_a", "clause_id_b", "modality_a", "modality_b", "negation_a", "negation_b")


@query("d29_explicit_negation", f"WITH {_DRAFTS}, p AS (SELECT a.clause_id AS clause_a, b.clause_id AS clause_b, {_norm('a.text')} AS x, {_norm('b.text')} AS y FROM drafts a JOIN drafts b ON a.document_id = b.document_id AND a.rn < b.rn) SELECT clause_a, clause_b, (({_POS_MODAL.format('x')} AND {_NEG_MODAL.format('y')}) OR ({_POS_MODAL.format('y')} AND {_NEG_MODAL.format('x')}))::INT AS conflict FROM p")
def d29(spark, d):
    rows = R.pairs_within(synth_drafts(spark, d))
    return rows.select(F.col("a.clause_id").alias("clause_a"), F.col("b.clause_id").alias("clause_b"), T.explicit_negation_conflict(F.col("a.text"), F.col("b.text")).alias("conflict"))


@query("d34_clause_facts", f"""WITH {_DRAFTS}, k AS (SELECT document_id, unnest([1, 9]) AS span_id FROM (SELECT DISTINCT document_id FROM drafts))
 SELECT k.document_id, k.span_id::BIGINT AS span_id, coalesce({_bar(_PARTIES)}, '') AS parties, coalesce({_bar(_TIMES)}, '') AS temporal FROM k LEFT JOIN drafts d ON d.document_id = k.document_id AND d.rn = k.span_id""")
def d34(spark, d):
    rows = R.structured_clauses(synth_drafts(spark, d)).withColumn("span_id", F.col("rn").cast("long"))
    keys = rows.select("document_id").distinct().select("document_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(9).cast("long"))).alias("span_id"))
    return R.clause_facts(keys, rows).select("document_id", "span_id", F.array_join("parties", "|").alias("parties"), F.array_join("temporal", "|").alias("temporal"))


# --- evaluation over pairs: an example is a document, its gold spans are clauses 1, 4 and 9 -------------------------------
_EVAL = f"{_PAIR}, ev AS (SELECT split_part(clause_a, '_draft_', 1) AS document_id, right(clause_a, 4)::INT AS span_a, right(clause_b, 4)::INT AS span_b, *, [1, 4, 9] AS gold FROM late)"


def _examples(spark, d):
    rows = _drafted(spark, d)
    span = lambda c: F.substring(c, -4, 4).cast("int")
    return rows.select("*", F.split("clause_a", "_draft_")[0].alias("document_id"), span(F.col("clause_a")).alias("span_a"), span(F.col("clause_b")).alias("span_b"), F.array(F.lit(1), F.lit(4), F.lit(9)).alias("gold_spans"))


@query("i11_evidence_recall", f"""WITH {_ASK}, found AS (SELECT document_id, query_id, list(DISTINCT right(clause_id, 4)::INT) AS s FROM rk WHERE rank <= 3 GROUP BY ALL)
 SELECT document_id, query_id AS label_id, 3::BIGINT AS gold, len(list_intersect(s, [1, 4, 9]))::BIGINT AS found, round(len(list_intersect(s, [1, 4, 9])) / 3.0::DOUBLE, 6) AS recall FROM found""")
def i11(spark, d):
    found = _retrieved(spark, d, 3)[2].select("document_id", F.col("query_id").alias("label_id"), F.substring("id", -4, 4).cast("int").alias("span_id"))
    gold = found.select("document_id", "label_id").distinct().withColumn("evidence_span_ids", F.array(F.lit(1), F.lit(4), F.lit(9)))
    return E.evidence_recall(E.with_evidence(found, gold)).withColumn("recall", F.round("recall", 6))


@query("i12_evidence_flags", f"WITH {_ASK} SELECT query_id AS label_id, clause_id, (right(clause_id, 4)::INT IN (1, 4, 9) AND right(document_id, 1) <> '1')::INT AS is_evidence FROM rk WHERE rank <= 3")
def i12(spark, d):
    found = _retrieved(spark, d, 3)[2].select("document_id", F.col("query_id").alias("label_id"), F.col("id").alias("clause_id"), F.substring("id", -4, 4).cast("int").alias("span_id"))
    gold = found.select("document_id", "label_id").distinct().where(F.substring("document_id", -1, 1) != "1").withColumn("evidence_span_ids", F.array(F.lit(1), F.lit(4), F.lit(9)))
    return E.with_evidence(found, gold).select("label_id", "clause_id", "is_evidence")


@query("i13_gold_touch", f"WITH {_EVAL} SELECT clause_a, clause_b, span_a IN (1, 4, 9) AS a_is_gold, span_b IN (1, 4, 9) AS b_is_gold, (span_a IN (1, 4, 9) OR span_b IN (1, 4, 9)) AS pair_touches_gold, (span_a IN (1, 4, 9) AND span_b IN (1, 4, 9)) AS pair_both_gold FROM ev")
def i13(spark, d):
    return E.gold_touch(_examples(spark, d)).select("clause_a", "clause_b", "a_is_gold", "b_is_gold", "pair_touches_gold", "pair_both_gold")


@query("i17_rollups", f"WITH {_EVAL} SELECT document_id, round(max(strict) + 1e-9, 6) AS strict_max, round(avg(strict) + 1e-9, 6) AS strict_mean, round(max(core) + 1e-9, 6) AS core_max, round(avg(core) + 1e-9, 6) AS core_mean, sum(mod)::BIGINT AS mod_count, count(*) AS pair_count FROM ev GROUP BY document_id")
def i17(spark, d):
    rows = _examples(spark, d).withColumnRenamed("strict_conflict_score", "strict")
    got = E.rolled_up(rows, ["strict", "core"], ["document_id"], ["mod"])
    return got.select("document_id", *[_even(c).alias(c) for c in ("strict_max", "strict_mean", "core_max", "core_mean")], "mod_count", "pair_count")


_SETS = f"{_EVAL}, sets AS (SELECT document_id, list_distinct(list_concat(list(span_a), list(span_b))) AS s FROM ev GROUP BY document_id)"


@query("i21_set_coverage", f"WITH {_SETS} SELECT document_id, len(s)::BIGINT AS candidates, len(list_intersect(s, [1, 4, 9]))::BIGINT AS found, round(len(list_intersect(s, [1, 4, 9])) / 3.0::DOUBLE, 6) AS recall FROM sets")
def i21(spark, d):
    return E.set_coverage(_examples(spark, d), ["document_id"]).select("document_id", "candidates", "found", F.round("recall", 6).alias("recall"))


@query("i22_retrieval_ceiling", f"WITH {_SETS} SELECT count(*) AS examples, count(*) FILTER (WHERE len(list_intersect(s, [1, 4, 9])) > 0) AS retrievable, round(avg((len(list_intersect(s, [1, 4, 9])) > 0)::INT), 6) AS ceiling, round(avg(len(list_intersect(s, [1, 4, 9])) / 3.0::DOUBLE), 6) AS mean_recall FROM sets")
def i22(spark, d):
    m = E.retrieval_ceiling(E.set_coverage(_examples(spark, d), ["document_id"]))
    return m.select("examples", "retrievable", F.round("ceiling", 6).alias("ceiling"), F.round("mean_recall", 6).alias("mean_recall"))


_METHODS = {"Novelty Evidence": "novelty_evidence_score_3", "Strict Conflict": "strict_conflict_score", "Aligned Conflict": "aligned_conflict_score"}
_MATRIX = f"""{_EVAL}, long AS (SELECT document_id, clause_a, clause_b, span_a IN (4, 9) AND span_b IN (4, 9, 6) AS hit, unnest(['Novelty Evidence', 'Strict Conflict', 'Aligned Conflict']) AS method, unnest([n3, strict, aligned]) AS score FROM ev),
 rkd AS (SELECT *, row_number() OVER (PARTITION BY method, document_id ORDER BY round(score, 9) DESC, clause_a, clause_b) AS rank FROM long), fst AS (SELECT method, document_id, min(CASE WHEN hit THEN rank END) AS f FROM rkd GROUP BY ALL),
 mx AS (SELECT method, avg(coalesce(f <= 1, false)::INT) AS r1, avg(coalesce(f <= 3, false)::INT) AS r3, avg(coalesce(f <= 5, false)::INT) AS r5, avg(coalesce(f <= 10, false)::INT) AS r10 FROM fst GROUP BY method)"""


def _matrix(spark, d):
    rows = _examples(spark, d).withColumn("hit", F.col("span_a").isin(4, 9) & F.col("span_b").isin(4, 9, 6))
    return E.method_matrix(rows, _METHODS, ["document_id"], ["clause_a", "clause_b"])


@query("i23_method_matrix", f"WITH {_MATRIX} SELECT method, round(r1, 6) AS recall_1, round(r3, 6) AS recall_3, round(r5, 6) AS recall_5, round(r10, 6) AS recall_10 FROM mx")
def i23(spark, d):
    return _matrix(spark, d).select("method", *[F.round(f"recall_{k}", 6).alias(f"recall_{k}") for k in (1, 3, 5, 10)])


@query("i23_best_methods", f"WITH {_MATRIX}, l AS (SELECT unnest([1, 3, 5, 10]) AS k, method, unnest([r1, r3, r5, r10]) AS recall FROM mx) SELECT k::BIGINT AS k, method, round(recall, 6) AS recall FROM l QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(recall, 12) DESC, method) = 1")
def i23_best(spark, d):
    return E.best_methods(_matrix(spark, d)).select(F.col("k").cast("long").alias("k"), "method", F.round("recall", 6).alias("recall"))

