r"""SQL that the queries of plans.queries are held against, built from the same lists of words. Look-ahead free."""

from __future__ import annotations

from ..functions import text as T
from ..operators.graph import SEVERITY
from ..sources.synth import SYNTH_SQL

LN3_2 = "1.4054651081081644"


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def rep(x: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {by}, 'g')"


def strip(x: str) -> str:
    return rep(x, r"^\s+|\s+$")


def clean(x: str) -> str:
    x = rep(f"coalesce({x}, '')", r"[ \t]+", "' '")
    x = rep(x, r"\n{2,}", "chr(10)")
    return strip(rep(x, r"\s+([,.;:!?])", r"'\1'"))


def has(x: str, phrases) -> str:
    return f"regexp_matches(lower({x}), {q(T.words_pattern(phrases))})"


def first_class(x: str, classes) -> str:
    return "CASE " + " ".join(f"WHEN {has(x, p)} THEN {q(n)}" for n, p in classes) + " END"


def condition(x: str) -> str:
    found = ", ".join(f"nullif(regexp_extract({x}, {q(rf'(?i)\b{k}\b[^.;]+')}, 0), '')" for k in T.CONDITIONS)
    return strip(f"coalesce({found})")


def without(x: str, phrases) -> str:
    for p in phrases:
        x = rep(x, rf"(?i)\b{p}\b")
    return x


def proposition(x: str) -> str:
    return strip(rep(without(x, T.PROPOSITION_DROPS), r"\s+", "' '"))


def fragment(x: str) -> str:
    return f"regexp_matches({strip(x)}, {q(T.FRAGMENT)})"


def all_of(x: str, patterns) -> str:
    return "list_concat(" + ", ".join(f"regexp_extract_all({x}, {q(p)})" for p in patterns) + ")" if len(patterns) > 1 else f"regexp_extract_all({x}, {q(patterns[0])})"


def joined(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct({x})), '|')"


def within(w: str, words) -> str:
    return f"{w} IN (" + ", ".join(map(q, words)) + ")"


SEGMENTS = f"""
tiled AS (
  SELECT doc_id, unnest(regexp_extract_all({clean("text")}, '(?s).+?(?:[.!?]\\s|\\n|$)')) AS piece, generate_subscripts(regexp_extract_all({clean("text")}, '(?s).+?(?:[.!?]\\s|\\n|$)'), 1) AS pos FROM documents
), segments AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn, {strip("piece")} AS text FROM tiled WHERE length({strip("piece")}) >= 10
)"""

SYNTH = f"synth AS MATERIALIZED ({SYNTH_SQL})"
FACTS = f"""{SYNTH}, facts AS MATERIALIZED (
  SELECT *, {first_class("text", T.MODALITIES)} AS modality, {first_class("text", T.PARTIES)} AS party, {condition("text")} AS condition, {has("text", T.NEGATIONS)} AS negated FROM synth
)"""


def grams(source: str, key: str, text: str = "text", bigrams: bool = True) -> str:
    toks = f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
    both = f"list_concat({toks}, list_transform(range(1, len({toks})), lambda i: {toks}[i] || ' ' || {toks}[i + 1]))" if bigrams else toks
    return f"SELECT {key}, unnest({both}) AS g FROM {source}"


#: Pairs of a document's clauses with the structured features.
PAIRS = f"""{FACTS}, tf AS (
  SELECT document_id, rn, clause_id, g, 1 + ln(count(*)) AS t FROM ({grams("synth", "document_id, rn, clause_id")}) GROUP BY ALL
), size2 AS (
  SELECT clause_id, sum(t * t) AS s2 FROM tf GROUP BY clause_id
), pairs AS MATERIALIZED (
  SELECT a.document_id, a.clause_id AS clause_a, b.clause_id AS clause_b, a.text AS text_a, b.text AS text_b, a.modality AS ma, b.modality AS mb, a.party AS pa, b.party AS pb, a.condition AS ca, b.condition AS cb, a.negated AS na, b.negated AS nb
  FROM facts a JOIN facts b ON a.document_id = b.document_id AND a.rn < b.rn
), dots AS (
  SELECT x.clause_id AS clause_a, y.clause_id AS clause_b, sum(x.t * y.t) AS dot, sum(x.t * x.t) AS sa, sum(y.t * y.t) AS sb
  FROM tf x JOIN tf y ON x.document_id = y.document_id AND x.g = y.g AND x.rn < y.rn GROUP BY ALL
), ctf AS (
  SELECT document_id, rn, clause_id, g, count(*)::DOUBLE AS t FROM ({grams("facts", "document_id, rn, clause_id", "condition", False)}) GROUP BY ALL
), cs2 AS (
  SELECT clause_id, sum(t * t) AS s2 FROM ctf GROUP BY clause_id
), cdots AS (
  SELECT x.clause_id AS clause_a, y.clause_id AS clause_b, sum(x.t * y.t) AS dot, sum(x.t * x.t) AS sa, sum(y.t * y.t) AS sb
  FROM ctf x JOIN ctf y ON x.document_id = y.document_id AND x.g = y.g AND x.rn < y.rn GROUP BY ALL
), featured AS MATERIALIZED (
  SELECT p.*,
    coalesce(d.dot / sqrt((d.sa + {LN3_2}::DOUBLE ** 2 * (u.s2 - d.sa)) * (d.sb + {LN3_2}::DOUBLE ** 2 * (v.s2 - d.sb))), 0) AS sem,
    coalesce(c.dot / sqrt((c.sa + {LN3_2}::DOUBLE ** 2 * (cu.s2 - c.sa)) * (c.sb + {LN3_2}::DOUBLE ** 2 * (cv.s2 - c.sb))), 0) AS cond,
    CASE WHEN (ma = 'prohibition' AND mb IN ('obligation', 'permission')) OR (mb = 'prohibition' AND ma IN ('obligation', 'permission')) THEN 1.0 ELSE 0.0 END::DOUBLE AS mod,
    CASE WHEN na <> nb THEN 1.0 ELSE 0.0 END::DOUBLE AS neg, coalesce(pa = pb, false) AS party
  FROM pairs p LEFT JOIN dots d USING (clause_a, clause_b) LEFT JOIN size2 u ON u.clause_id = p.clause_a LEFT JOIN size2 v ON v.clause_id = p.clause_b
    LEFT JOIN cdots c USING (clause_a, clause_b) LEFT JOIN cs2 cu ON cu.clause_id = p.clause_a LEFT JOIN cs2 cv ON cv.clause_id = p.clause_b
), scored AS (
  SELECT *, least(greatest(sem * 0.35::DOUBLE + mod * 0.30::DOUBLE + neg * 0.20::DOUBLE + party::INT * 0.10::DOUBLE + cond * 0.05::DOUBLE, 0), 1) AS score,
    CASE WHEN ma = 'obligation' AND mb = 'prohibition' THEN 'obligation_vs_prohibition' WHEN ma = 'prohibition' AND mb = 'obligation' THEN 'prohibition_vs_obligation'
      WHEN ma = 'permission' AND mb = 'prohibition' THEN 'permission_vs_prohibition' WHEN ma = 'prohibition' AND mb = 'permission' THEN 'prohibition_vs_permission'
      WHEN neg = 1 THEN 'positive_vs_negative' WHEN sem >= 0.40 THEN 'potential_semantic_conflict' ELSE 'no_clear_conflict' END AS kind
  FROM featured
)"""


def _stem(w: str) -> str:
    n = f"length({w})"
    cut = lambda k: f"substr({w}, 1, {n} - {k})"
    return f"CASE WHEN {w} LIKE '%ies' AND {n} > 4 THEN {cut(3)} || 'y' WHEN {w} LIKE '%ing' AND {n} > 5 THEN {cut(3)} WHEN {w} LIKE '%ed' AND {n} > 4 THEN {cut(2)} WHEN {w} LIKE '%s' AND {n} > 4 THEN {cut(1)} ELSE {w} END"


def stems(x: str, more: tuple[str, ...] = ()) -> str:
    return f"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower({x}), '[a-z]{{3,}}'), lambda w: NOT ({within('w', (*T.STEM_STOP, *more))})), lambda w: {_stem('w')})))"


_UNIT = "CASE WHEN regexp_matches(u, 'hour|minute') THEN 'short' WHEN contains(u, 'day') THEN 'day' WHEN contains(u, 'week') THEN 'week' WHEN contains(u, 'month') THEN 'month' WHEN contains(u, 'year') THEN 'year' END"


def _durations(pattern: str, first: int) -> str:
    found = lambda g: f"regexp_extract_all(lower(text), {q(chr(92) + 'b' + pattern)}, {g})"
    return f"SELECT clause_id, unnest({found(1)}) AS v, unnest({found(2)}) AS u, {first} + generate_subscripts({found(1)}, 1) AS k FROM synth"


TEMPORAL = f"""{PAIRS}, told AS MATERIALIZED (
  SELECT clause_id, v::DOUBLE AS v, {_UNIT} AS f, k FROM ({_durations(T._DAY_UNITS, 0)} UNION ALL {_durations(T._CLOCK_UNITS, 1000)})
), stemmed AS MATERIALIZED (
  SELECT clause_id, {stems("text")} AS st FROM synth
), told_a AS MATERIALIZED (
  SELECT p.clause_a, p.clause_b, t.v, t.f, t.k FROM pairs p JOIN told t ON t.clause_id = p.clause_a
), differing AS MATERIALIZED (
  SELECT x.clause_a, x.clause_b, count(*) AS n, arg_min(x.v, x.k * 10000 + y.k) AS va, arg_min(y.v, x.k * 10000 + y.k) AS vb
  FROM told_a x JOIN told y ON y.clause_id = x.clause_b AND x.f = y.f WHERE x.v <> y.v GROUP BY ALL
), met AS MATERIALIZED (
  SELECT d.*, len(list_intersect(x.st, y.st)) AS shared FROM differing d JOIN stemmed x ON x.clause_id = d.clause_a JOIN stemmed y ON y.clause_id = d.clause_b
), timed AS (
  SELECT s.*, d.va, d.vb, d.shared, CASE WHEN d.n > 0 AND d.shared > 0 THEN least(1.0, 0.75::DOUBLE + CASE WHEN party THEN 0.10 ELSE 0 END::DOUBLE
      + CASE WHEN (ma = 'obligation' AND mb = 'permission') OR (ma = 'permission' AND mb = 'obligation') THEN 0.10 WHEN ma = 'obligation' AND mb = 'obligation' THEN 0.05 ELSE 0 END::DOUBLE) ELSE 0 END AS temporal
  FROM scored s LEFT JOIN met d USING (clause_a, clause_b)
), hybrid AS MATERIALIZED (
  SELECT *, CASE WHEN (mod = 1 OR neg = 1) AND party THEN 0.90 ELSE 0.05 END::DOUBLE AS p,
    least(greatest(CASE WHEN (mod = 1 OR neg = 1) AND party THEN 0.90 ELSE 0.05 END::DOUBLE * 0.95::DOUBLE + score * 0.05::DOUBLE, 0), 1) AS hybrid,
    CASE WHEN temporal > 0 THEN 'temporal_deadline_conflict' ELSE kind END AS final
  FROM timed
)"""

GRAPH = f"""{TEMPORAL}, edges AS MATERIALIZED (
  SELECT clause_a AS src, clause_b AS dst, CASE WHEN hybrid >= 0.71 THEN 'conflict' ELSE 'related' END AS relationship, hybrid AS weight, final AS conflict_type FROM hybrid
), adj AS MATERIALIZED (
  SELECT src AS node_id, dst AS other, weight AS w FROM edges WHERE relationship = 'conflict' UNION ALL SELECT dst, src, weight FROM edges WHERE relationship = 'conflict'
), base AS MATERIALIZED (
  SELECT s.clause_id AS node_id, CASE WHEN count(w) > 0 THEN least(max(w), 1) ELSE 0 END AS direct, count(w) AS degree FROM synth s LEFT JOIN adj ON adj.node_id = s.clause_id GROUP BY s.clause_id
)""" + "".join(
    f""", r{i} AS MATERIALIZED (
  SELECT b.node_id, least(greatest(any_value(b.direct) * 0.70::DOUBLE + 0.30::DOUBLE * coalesce(sum(a.w * p.score) / nullif(sum(a.w), 0), 0), 0), 1) AS score
  FROM base b LEFT JOIN adj a ON a.node_id = b.node_id LEFT JOIN {"(SELECT node_id, direct AS score FROM base)" if i == 1 else f"r{i - 1}"} p ON p.node_id = a.other GROUP BY b.node_id
)"""
    for i in (1, 2, 3)
) + """, propagated AS MATERIALIZED (
  SELECT b.*, r3.score AS propagated, CASE WHEN r3.score >= 0.80 THEN 'high' WHEN r3.score >= 0.60 THEN 'medium' WHEN r3.score >= 0.30 THEN 'low' ELSE 'none' END AS hotspot FROM base b JOIN r3 USING (node_id)
)"""

_SEV = "CASE conflict_type " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in SEVERITY.items()) + " ELSE 0.50 END::DOUBLE"
LEVEL = "CASE WHEN {0} >= 0.80 THEN 'critical' WHEN {0} >= 0.60 THEN 'high' WHEN {0} >= 0.35 THEN 'medium' WHEN {0} >= 0.15 THEN 'low' ELSE 'minimal' END"
RISK = f"""{GRAPH}, kinds AS (
  SELECT node_id, max(s) AS severity, array_to_string(list_sort(list_distinct(list(conflict_type))), ' ') AS types FROM (
    SELECT src AS node_id, conflict_type, {_SEV} AS s FROM edges WHERE relationship = 'conflict' UNION ALL SELECT dst, conflict_type, {_SEV} FROM edges WHERE relationship = 'conflict') GROUP BY node_id
), dense AS (
  SELECT p.*, coalesce(k.severity, 0) AS severity, k.types, degree / nullif(max(degree) OVER (), 0)::DOUBLE AS density FROM propagated p LEFT JOIN kinds k USING (node_id)
), risk0 AS (
  SELECT *, (propagated * 0.50::DOUBLE + direct * 0.30::DOUBLE + coalesce(density, 0) * 0.20::DOUBLE) AS b FROM dense
), risk AS (
  SELECT *, least(greatest(CASE WHEN degree > 0 THEN b * (severity * 0.30::DOUBLE + 0.70::DOUBLE) ELSE b * 0.50::DOUBLE END, 0), 1) AS risk FROM risk0
)"""
