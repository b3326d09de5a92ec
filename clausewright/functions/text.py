r"""Text functions over clauses: cleaning, detectors, extractors. Column to Column, inside the JVM.

Keyword lists and patterns below are fixed values: results must follow them.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------------------------
DEFINITION = ("shall mean", "shall have the meaning", "will mean", "will have the meaning", "will have the respective meanings", "means", "is defined as", "are defined as", "refers to", "shall be defined as")
PROHIBITION = ("shall not", "must not", "may not", "prohibit", "prohibited", "prohibits", "forbidden", "not permitted")
PERMISSION = ("may", "permitted to", "has the right to", "is entitled to", "can")
OBLIGATION = ("shall", "must", "required to", "obligated to")
MODALITIES = (("definition", DEFINITION), ("prohibition", PROHIBITION), ("permission", PERMISSION), ("obligation", OBLIGATION))
PARTIES = (
    ("supplier", ("supplier", "vendor", "service provider")), ("customer", ("customer", "client", "buyer")), ("company", ("company", "corporation")),
    ("employee", ("employee", "personnel")), ("contractor", ("contractor",)), ("licensor", ("licensor",)), ("licensee", ("licensee",)), ("party", ("party", "parties")),
)
CONDITIONS = ("if", "unless", "provided that", "subject to", "in the event that", "when", "where")
PROPOSITION_DROPS = ("shall not", "must not", "may not", "shall", "must", "may", "should", "will", "can")
NEGATIONS = ("not", "no", "never", "neither", "nor", "without", "prohibited", "prohibit", "forbidden", "shall not", "may not")
DRAFT_PROHIBITION = ("shall not", "must not", "may not", "cannot", "will not", "prohibited")
DRAFT_OBLIGATION = ("shall", "must", "is required to", "are required to", "will")
DRAFT_PERMISSION = ("may", "permitted to", "allowed to", "entitled to")
DRAFT_NEGATIONS = ("not", "no", "never", "without", "prohibited", "forbidden")
DRAFT_PARTIES = ("receiving party", "disclosing party", "buyer", "seller", "vendor", "customer", "company", "employer", "employee", "party", "parties")
TIMES = (
    r"\bwithin\s+\d+\s+(?:day|days|hour|hours|month|months|year|years)\b", r"\bafter\s+\d+\s+(?:day|days|month|months|year|years)\b",
    r"\bbefore\s+\d+\s+(?:day|days|month|months|year|years)\b", r"\bfor\s+\d+\s+(?:day|days|month|months|year|years)\b", r"\buntil\b[^,.;]*", r"\bfrom\b[^,.;]*\buntil\b[^,.;]*",
)
NUMBERS = (
    r"\b\d+(?:\.\d+)?\s*%", r"\b\d+(?:\.\d+)?\s+(?:day|days|hour|hours|month|months|year|years)\b", r"\b(?:USD|EUR|GBP|INR|\$|€|£)\s*\d+(?:,\d{3})*(?:\.\d+)?\b", r"\b\d+(?:,\d{3})*(?:\.\d+)?\b",
)
DRAFT_CONDITIONS = (
    r"\bif\b[^,.;]*", r"\bunless\b[^,.;]*", r"\bprovided that\b[^,.;]*", r"\bsubject to\b[^,.;]*", r"\bin the event that\b[^,.;]*", r"\bwhere\b[^,.;]*", r"\bonly if\b[^,.;]*",
    r"\bexcept\b[^,.;]*", r"\bexcept that\b[^,.;]*", r"\bfor\b[^,.;]*transactions", r"\bwith respect to\b[^,.;]*",
)
EXCEPTIONS = ("unless", "except", "except as", "except that", "provided that", "subject to", "notwithstanding", "in the event that", "to the extent that", "if", "only if")
ACTION_DROPS = ("shall not", "must not", "may not", "will not", "cannot", "shall", "must", "may", "will")
DRAFT_DROPS = ("shall", "shall not", "must", "must not", "may", "may not", "will", "will not", "cannot", "is required to", "are required to", "is permitted to", "are permitted to")
DRAFT_FILLERS = ("the", "a", "an", "any", "such", "herein", "thereof", "thereto", "provided that", "notwithstanding the foregoing")
NORMAL_DROPS = ("shall not", "must not", "may not", "will not", "shall", "must", "may", "will", "cannot", "is required to", "are required to", "is permitted to", "are permitted to")
PARTS_DROPS = ("shall not", "shall", "must not", "must", "may not", "may", "will not", "will", "cannot", "is required to", "are required to", "is permitted to", "are permitted to")
PARTS_TAILS = ("provided that", "notwithstanding", "subject to", "in the event that")
PARTS_PARTIES = ("receiving party", "disclosing party", "company", "contractor", "buyer", "seller", "vendor", "customer", "employer", "employee", "party", "parties")
PARTS_VERBS = (
    "disclose", "discloses", "disclosing", "use", "uses", "using", "receive", "receives", "receiving", "provide", "provides", "providing", "return", "returns", "returning",
    "destroy", "destroys", "destroying", "retain", "retains", "retaining", "assign", "assigns", "assigning", "transfer", "transfers", "transferring", "notify", "notifies", "notifying",
    "pay", "pays", "paying", "deliver", "delivers", "delivering", "terminate", "terminates", "terminating", "modify", "modifies", "modifying", "reverse", "reverse-engineer",
)
PARTS_FILLERS = ("the", "and", "or", "any", "such", "information", "agreement", "foregoing")
POSITIVE = ("shall", "must", "may", "will")
NEGATIVE = ("shall not", "must not", "may not", "will not", "cannot")
PROPOSITION_STOP = (
    "the", "and", "or", "of", "to", "a", "an", "any", "such", "this", "that", "shall", "must", "may", "will", "not", "be", "is", "are", "for", "in", "on", "with", "by", "from", "under", "as",
    "its", "their", "party", "parties",
)
FILLERS = ("the", "a", "an", "any", "such", "this", "that", "herein", "thereof", "thereto", "therein", "foregoing", "agreement", "section", "article", "party", "parties")
BOILERPLATE = (
    "the foregoing", "notwithstanding the foregoing", "without limiting the foregoing", "for the avoidance of doubt", "in addition", "provided that", "subject to", "in the event that",
    "except as set forth in", "except as provided in", "with respect to", "on behalf of",
)
LEGAL_TERMS = (
    "shall", "must", "may", "will", "prohibited", "prohibit", "required", "require", "permitted", "permission", "terminate", "termination", "confidential", "disclose", "disclosure",
    "liable", "liability", "indemnify", "indemnification", "consent", "notice", "agreement", "obligation", "duty", "rights", "right", "breach", "default", "payment", "license", "licence",
    "assignment", "restriction",
)
STEM_STOP = (
    "the", "a", "an", "and", "or", "of", "to", "within", "from", "on", "in", "for", "by", "after", "before", "upon", "all", "any", "such", "that", "this", "shall", "must", "may", "will", "can",
    "should", "be", "is", "are", "was", "were", "has", "have", "had", "customer", "supplier", "company", "party", "parties", "not", "no", "their", "its",
)
FRAGMENT = r"(?i)^(?:[a-z]\)|\([a-z]\)|[ivxlcdm]+\)|\([ivxlcdm]+\)|\d+\.|\(\d+\))"
SEGMENT = r"(?s).+?(?:[.!?](?=\s|$)|\n|$)"
EXPLICIT_START = r"^(?:\d+(?:\.\d+)*[.)]|\(\d+\)|\([a-zA-Z]\)|[a-zA-Z]\))\s+"
SENTENCE_END = r"""[.!?]["')\]]*$"""
# --- end of fixed values ------------------------------------------------------------------------------------------


def words_pattern(phrases: tuple[str, ...] | list[str]) -> str:
    """Any of the phrases as whole words; the longest first where one begins another."""
    return r"\b(?:" + "|".join(sorted(phrases, key=lambda p: (-len(p), p))) + r")\b"


def _bound(x: Column, f) -> Column:
    """f of x, with x computed once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def absent(x: Column) -> Column:
    """Null for an empty string."""
    return F.when(x != "", x)


def clean_text(x: Column) -> Column:
    """Spaces and tabs to one space, newlines to one, no white space before punctuation, stripped; null is empty."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), r"[ \t]+", " ")
    x = F.regexp_replace(x, r"\n{2,}", "\n")
    return strip(F.regexp_replace(x, r"\s+([,.;:!?])", "$1"))


def pieces(cleaned: Column) -> Column:
    """The pieces that tile a cleaned text, each up to a sentence end or newline."""
    return F.regexp_extract_all(cleaned, F.lit(SEGMENT), F.lit(0))


def is_fragment(x: Column) -> Column:
    return strip(x).rlike(FRAGMENT)


def _first_class(x: Column, classes) -> Column:
    out = F.lit(None).cast("string")
    for name, phrases in reversed(classes):
        out = F.when(F.lower(x).rlike(words_pattern(phrases)), name).otherwise(out)
    return out


def modality(x: Column) -> Column:
    return _first_class(x, MODALITIES)


def party(x: Column) -> Column:
    return _first_class(x, PARTIES)


def condition(x: Column) -> Column:
    """The keyword first in the list that occurs, with its tail up to a stop or semicolon."""
    found = [absent(F.regexp_extract(x, rf"(?i)\b{k}\b[^.;]+", 0)) for k in CONDITIONS]
    return strip(F.coalesce(*found))


def _without(x: Column, phrases) -> Column:
    for p in phrases:
        x = F.regexp_replace(x, rf"(?i)\b{p}\b", "")
    return x


def proposition(x: Column) -> Column:
    return strip(F.regexp_replace(_without(x, PROPOSITION_DROPS), r"\s+", " "))


def contains_negation(x: Column) -> Column:
    return F.lower(x).rlike(words_pattern(NEGATIONS))


def draft_modality(x: Column) -> Column:
    return F.coalesce(_first_class(x, (("prohibition", DRAFT_PROHIBITION), ("obligation", DRAFT_OBLIGATION), ("permission", DRAFT_PERMISSION))), F.lit("none"))


def draft_negation(x: Column) -> Column:
    return F.lower(x).rlike(words_pattern(DRAFT_NEGATIONS))


def _all_of(x: Column, patterns) -> Column:
    return F.array_distinct(F.concat(*[F.regexp_extract_all(x, F.lit(p), F.lit(0)) for p in patterns]))


def times(x: Column) -> Column:
    return _all_of(x, [f"(?i){p}" for p in TIMES])


def numbers(x: Column) -> Column:
    return _all_of(x, [f"(?i){p}" for p in NUMBERS])


def draft_parties(x: Column) -> Column:
    return F.array_distinct(_all_of(F.lower(x), [rf"\b{p}\b" for p in DRAFT_PARTIES]))


def draft_conditions(x: Column, keep_case: bool = False) -> Column:
    """Conditions in the order of the patterns; lower-cased and stripped, or as they are written."""
    found = _all_of(x, [f"(?i){p}" for p in DRAFT_CONDITIONS])
    return found if keep_case else F.array_distinct(F.transform(found, lambda c: strip(F.lower(c))))


def exception_flag(x: Column) -> Column:
    return F.lower(x).rlike(words_pattern(EXCEPTIONS)).cast("int")


def normalize_clause(x: Column) -> Column:
    return strip(F.regexp_replace(F.lower(x), r"\s+", " "))


def _spaced(x: Column, phrases, ordered: bool = True) -> Column:
    """x with a space in place of each phrase: one after the other, or (not ordered) of any the first that is listed."""
    if not ordered:
        return F.regexp_replace(x, r"\b(?:" + "|".join(phrases) + r")\b", " ")
    for p in phrases:
        x = F.regexp_replace(x, rf"\b{p}\b", " ")
    return x


def action_core(x: Column) -> Column:
    return normalize_clause(_spaced(normalize_clause(x), ACTION_DROPS))


def clean_proposition(x: Column) -> Column:
    """The draft's proposition: "shall" goes before "shall not" is tried, so that "not" stays."""
    return normalize_clause(_spaced(_spaced(normalize_clause(x), DRAFT_DROPS, False), DRAFT_FILLERS, False))


def draft_proposition(x: Column) -> Column:
    """struct(text, modality, negation, temporal, numbers)."""
    return F.struct(x.alias("text"), draft_modality(x).alias("modality"), draft_negation(x).alias("negation"), times(x).alias("temporal"), numbers(x).alias("numbers"))


def explicit_negation_conflict(a: Column, b: Column) -> Column:
    """1 if one text has a modal and the other one a negated modal, the first without such."""
    return opposed(negated_modal(a), affirmed_modal(a), negated_modal(b), affirmed_modal(b))


def negated_modal(x: Column) -> Column:
    return normalize_clause(x).rlike(words_pattern(NEGATIVE))


def affirmed_modal(x: Column) -> Column:
    return normalize_clause(x).rlike(words_pattern(POSITIVE)) & ~negated_modal(x)


def opposed(negated_a: Column, affirmed_a: Column, negated_b: Column, affirmed_b: Column) -> Column:
    """1 if one text has a negated modal and the other one only others."""
    return ((affirmed_a & negated_b) | (affirmed_b & negated_a)).cast("int")


def normalize_proposition(x: Column) -> Column:
    x = _spaced(_spaced(normalize_clause(x), BOILERPLATE), NORMAL_DROPS, False)
    kept = F.filter(F.regexp_extract_all(x, F.lit(r"\b[a-z]{3,}\b"), F.lit(0)), lambda w: ~w.isin(*FILLERS))
    return F.array_join(kept, " ")


def core_tokens(normal: Column) -> Column:
    """The distinct words of three letters or more of a normalised proposition."""
    return F.array_distinct(F.regexp_extract_all(normal, F.lit(r"\b[a-z]{3,}\b"), F.lit(0)))


def proposition_tokens(x: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"\b[a-z]{3,}\b"), F.lit(0)))
    return F.array_sort(F.filter(found, lambda w: ~w.isin(*PROPOSITION_STOP)))


def words(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"\b[a-z]{3,}\b"), F.lit(0))))


def _stem(w: Column) -> Column:
    n = F.length(w)
    cut = lambda k: F.substring(w, F.lit(1), n - k)
    return F.when(w.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y"))).when(w.endswith("ing") & (n > 5), cut(3)).when(w.endswith("ed") & (n > 4), cut(2)).when(w.endswith("s") & (n > 4), cut(1)).otherwise(w)


def stem_tokens(x: Column, more_stop: tuple[str, ...] = ()) -> Column:
    """Distinct stemmed words of three letters or more without the stop words, sorted."""
    found = F.filter(F.regexp_extract_all(F.lower(x), F.lit(r"[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin([*STEM_STOP, *more_stop]))
    return F.array_sort(F.array_distinct(F.transform(found, _stem)))


def subject_action_object(x: Column) -> Column:
    """struct(subject, action, object), empty strings where there is none.

    What follows a condition is cut off and modals are removed. The subject is the first listed party that the rest
    contains, the action its first listed verb, the object the first twelve words after it (all, without a verb) that are
    no fillers."""
    cut = F.regexp_replace(normalize_clause(x), r"\b(?:" + "|".join(PARTS_TAILS) + r")\b.*", "")
    rest = normalize_clause(_spaced(cut, PARTS_DROPS, False))

    def parts(e: Column) -> Column:
        subject = F.lit("")
        for p in reversed(PARTS_PARTIES):
            subject = F.when(e["rest"].contains(p), p).otherwise(subject)
        at = F.when(e["action"].isNull(), F.lit(0)).otherwise(F.array_position(e["tokens"], e["action"])).cast("int")
        after = F.slice(e["tokens"], at + 1, F.greatest(F.size(e["tokens"]) - at, F.lit(0)))
        kept = F.slice(F.filter(after, lambda w: ~w.isin(*PARTS_FILLERS)), 1, 12)
        return F.struct(F.when(F.size(e["tokens"]) > 0, subject).otherwise("").alias("subject"), F.coalesce(e["action"], F.lit("")).alias("action"), F.array_join(kept, " ").alias("object"))

    def with_action(e: Column) -> Column:
        action = F.get(F.filter(e["tokens"], lambda w: w.isin(*PARTS_VERBS)), F.lit(0))
        return _bound(F.struct(e["rest"].alias("rest"), e["tokens"].alias("tokens"), action.alias("action")), parts)

    def with_tokens(r: Column) -> Column:
        return _bound(F.struct(r.alias("rest"), F.regexp_extract_all(r, F.lit(r"\b[a-z]{3,}\b"), F.lit(0)).alias("tokens")), with_action)

    return _bound(rest, with_tokens)


def normalize_line(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"\s+", " "))


def starts_explicit_clause(x: Column) -> Column:
    return x.rlike(EXPLICIT_START)


def ends_sentence(x: Column) -> Column:
    return x.rlike(SENTENCE_END)


def is_heading(x: Column) -> Column:
    letters = F.length(F.regexp_replace(x, r"[^A-Za-z]", ""))
    upper = F.length(F.regexp_replace(x, r"[^A-Z]", ""))
    return (F.length(x) > 0) & (F.length(x) <= 100) & ~x.rlike(r"[.!?;:]$") & ~starts_explicit_clause(x) & (letters > 0) & (upper >= letters * 0.8) & (F.size(F.split(x, " ")) <= 12)


def document_id_of(stem: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9_-]+", "_"), r"^_+|_+$", "")
    return F.coalesce(absent(x), F.lit("uploaded_contract"))


def _unaccented() -> tuple[str, str]:
    """Latin and Greek letters with marks, then the marks themselves; the letters without. By Unicode decomposition."""
    letters = [chr(c) for first, last in ((0xC0, 0x24F), (0x370, 0x3FF), (0x1E00, 0x1EFF)) for c in range(first, last + 1)]
    plain = ["".join(y for y in unicodedata.normalize("NFKD", x) if not unicodedata.combining(y)) for x in letters]
    some = [(x, y) for x, y in zip(letters, plain, strict=True) if len(y) == 1 and x != y]
    return "".join(x for x, _ in some) + "".join(chr(c) for c in range(0x300, 0x370)), "".join(y for _, y in some)


_MARKED, _PLAIN = _unaccented()


def strip_accents(x: Column) -> Column:
    return F.when(x.rlike(r"[^\x00-\x7F]"), F.translate(x, _MARKED, _PLAIN)).otherwise(x)


def safe_number(x: Column) -> Column:
    """A finite number, else 0."""
    v = F.expr("1").cast("double") * x.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)


def parse_int_set(x: Column) -> Column:
    """'[3, 1, 3]' as the sorted distinct numbers; what isn't a list is empty."""
    return F.array_sort(F.array_distinct(F.coalesce(F.from_json(x, "array<int>"), F.array().cast("array<int>"))))


def pair_text(hypothesis: Column, clause: Column) -> Column:
    return F.concat(F.lit("Hypothesis: "), hypothesis, F.lit(" [SEP] Clause: "), clause)


def context_text(hypothesis: Column, context: Column) -> Column:
    return F.concat(F.lit("Hypothesis: "), hypothesis, F.lit(" [SEP] Contract Context: "), context)


def plain_pair_text(hypothesis: Column, context: Column) -> Column:
    return F.concat(hypothesis, F.lit(" [SEP] "), context)


# --- durations ----------------------------------------------------------------------------------------------------
_DAY_UNITS = r"(\d+(?:\.\d+)?)\s*(business days?|calendar days?|days?|weeks?|months?|years?)\b"
_CLOCK_UNITS = r"(\d+(?:\.\d+)?)\s*(hours?|minutes?)\b"


def durations(x: Column) -> Column:
    """array<struct<value,unit,text>>: days and longer first, then hours and minutes; each in text order."""
    low = F.lower(x)

    def of(p: str) -> Column:
        parts = [F.regexp_extract_all(low, F.lit(rf"\b{p}"), F.lit(g)) for g in (1, 2, 0)]
        return F.transform(F.arrays_zip(*[c.alias(n) for c, n in zip(parts, ("v", "u", "t"), strict=True)]), lambda e: F.struct(e["v"].cast("double").alias("value"), e["u"].alias("unit"), e["t"].alias("text")))

    return F.concat(of(_DAY_UNITS), of(_CLOCK_UNITS))


def unit_family(u: Column) -> Column:
    return F.when(u.rlike("hour|minute"), "short").when(u.contains("day"), "day").when(u.contains("week"), "week").when(u.contains("month"), "month").when(u.contains("year"), "year")
