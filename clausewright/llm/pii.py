r"""Personal data by candidate gradient boosting. DataFrame and SQL functions only.

Generators with high recall propose spans of four kinds: e-mail and IP addresses, card and telephone numbers. The first
four are the base: what they find and their check confirms is always taken. The others also propose what is written in
less strict ways ("name (at) host (dot) org", numbers without a country code, dots between digits). Boosted trees rate
these by format and context (digits, groups, check sums, the characters beside, words before), and a threshold of each
kind, calibrated on labelled snippets that the trees were not fitted on, selects. A proposal that overlaps a base span is
left out; of selected ones that overlap each other those with the better scores are taken.

The trees are fitted on SNIPPETS labelled snippets made from templates by SQL; the driver gets a row for each
combination of features in them. Expressions of the trees run inside the JVM.

Positions come from the lengths of matches and of what lies between them, summed by a window in each document. Patterns
are written so that none takes quadratic time or deep recursion on long runs.

Defined results: null text is empty and has no span; the hash of no span is that of empty text; repeated rows are
documents of their own; positions are code points, the end excluded.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from . import common as C

KINDS = ("email", "ip", "card", "phone")
SNIPPETS = 6000
ROUNDS = 32
DEPTH = 3
PRECISION = 0.98


@dataclass(frozen=True)
class Generator:
    kind: str
    pattern: str
    needs: str  # a text without a match of this cheap condition is passed over
    base: bool = False


_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
GENERATORS = (
    # a run is entered at its start or where the last match ended, never in between: the leftmost match is the same
    Generator("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "@", True),
    Generator("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", "digit", True),
    Generator("card", r"[0-9](?:[\x20-]?[0-9])++", "digit", True),
    Generator("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", True),
    Generator("email", rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+\x20?(?:\(at\)|\[at\])\x20?{_LABEL}{{1,63}}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?{_LABEL}{{1,63}}+){{1,8}}+", "at"),
    Generator("email", rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+\x20at\x20{_LABEL}{{1,63}}+(?:\x20dot\x20{_LABEL}{{1,63}}+){{1,8}}+", "dot"),
    Generator("ip", r"(?<![0-9])[0-9]{1,3}(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){2}(?![0-9])", "[digit"),
    Generator("card", r"(?<![0-9])[0-9]{4}(?:[./]|\x20[\x20-]\x20?)[0-9]{4}(?:[./]|\x20[\x20-]\x20?)[0-9]{4}(?:[./]|\x20[\x20-]\x20?)[0-9]{1,7}(?![0-9])", "digit"),
    Generator("phone", r"(?<![0-9+.-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])", "digit"),
)

#: Words that speak for a kind, and words that speak for other numbers.
_FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|kontakt|correo|courriel|adresse)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login|from|addr|adresse|servidor|serveur)\b",
    "card": r"(?i)\b(?:card|visa|master ?card|amex|credit|debit|payment|karte|tarjeta|carte)\b",
    "phone": r"(?i)\b(?:tel|ph|phone|call|mobile|cell|fax|telephone|telefon|anruf|llamar|t[ée]l[ée]phone|whatsapp)\b",
}
_AGAINST = r"(?i)\b(?:version|v|isbn|issn|order|invoice|build|ref|serial|page|section|chapter|fig|figure|table|art|doi|part|model|sku|id|item|lines?|total|score|date)\b"

#: How host names often end.
_ENDING = r"(?i)[^a-z](?:com|org|net|edu|gov|info|io|eu|de|fr|es|it|uk|us)$"


def _needs(text: Column, what: str) -> Column:
    digit = text.rlike("[0-9]")
    return {
        "@": text.contains("@"), "digit": digit, "+": text.contains("+") & digit,
        "at": text.contains("(at)") | text.contains("[at]"), "dot": text.contains(" at ") & text.contains(" dot "),
        "[digit": (text.contains("[") | text.contains("(")) & digit,
    }[what]


def proposals(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Rows _row, keep, gen, start, finish, found, left, right: the matches of all generators.

    A document without any has one row with gen null, so that none is lost."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *keep, F.coalesce("text", F.lit("")).alias("_text"))
    text, per = F.col("_text"), []
    for g, it in enumerate(GENERATORS):
        matches, between = F.regexp_extract_all(text, F.lit(it.pattern), F.lit(0)), F.split(text, it.pattern)
        per.append(F.when(_needs(text, it.needs), F.struct(F.lit(g).alias("gen"), matches.alias("m"), between.alias("p"))))
    listed = F.filter(F.array(*per), lambda x: x.isNotNull() & (F.size(x["m"]) > 0))

    def left(x: Column, k: Column) -> Column:
        """What stands before a match, with the match before it."""
        before = F.when(k > 0, F.concat(F.substring(F.get(x["p"], k - 1), -40, 40), F.get(x["m"], k - 1))).otherwise("")
        return F.substring(F.concat(F.substring(before, -40, 40), F.substring(F.get(x["p"], k), -40, 40)), -40, 40)

    def each(x: Column) -> Column:
        return F.transform(x["m"], lambda m, k: F.struct(k.alias("k"), m.alias("found"), F.length(F.get(x["p"], k)).alias("gap"), left(x, k).alias("left"), F.substring(F.get(x["p"], k + 1), 1, 12).alias("right")))

    small = F.transform(listed, lambda x: F.struct(x["gen"].alias("gen"), each(x).alias("e")))
    out = rows.select("_row", *keep, F.explode_outer(small).alias("g")).select("_row", *keep, "g.gen", F.explode_outer("g.e").alias("e"))
    out = out.select("_row", *keep, "gen", "e.*")
    before = Window.partitionBy("_row", "gen").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    finish = F.sum(F.col("gap") + F.length("found")).over(before)
    return out.withColumn("finish", finish).withColumn("start", F.col("finish") - F.length("found")).drop("k", "gap")


def _pick(values: dict[int, object] | list, gen: Column, other=None) -> Column:
    out = F.lit(other)
    for g, v in enumerate(values):
        out = F.when(gen == g, v).otherwise(out)
    return out


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    at = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    value = lambda i: F.when((n - i) % 2 == 1, F.when(at(i) > 4, at(i) * 2 - 9).otherwise(at(i) * 2)).otherwise(at(i))
    return F.when(n == 0, False).otherwise(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + value(i)) % 10 == 0)


def _valid_ip(found: Column) -> Column:
    parts = F.transform(F.filter(F.split(found, "[^0-9]+"), lambda x: x != ""), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda x: (F.length(x) <= 3) & (F.substring(x, 1, 3).cast("int") <= 255))


def described(rows: DataFrame) -> DataFrame:
    """proposals() with kind, base, ok (the kind's check) and the features f_*."""
    gen, found = F.col("gen"), F.col("found")
    kind = _pick([F.lit(g.kind) for g in GENERATORS], gen)
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    rows = rows.withColumn("kind", kind).withColumn("base", _pick([F.lit(g.base) for g in GENERATORS], gen)).withColumn("digits", F.when(kind != "email", digits))
    n = F.length("digits")
    card = n.between(13, 19) & F.when(n.between(13, 19), luhn(F.col("digits"))).otherwise(False)
    ok = F.when(F.col("kind") == "email", True).when(F.col("kind") == "ip", _valid_ip(found)).when(F.col("kind") == "card", card).otherwise(n.between(9, 15))
    rows = rows.withColumn("ok", ok).withColumn("kindno", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int"))
    beside = lambda c: F.when(c == "", 0).when(c.rlike(r"^[\s]$"), 1).when(c.rlike("^[0-9]$"), 2).when(c.rlike(r"^[.,;:!?)\]\"']$"), 3).when(c.rlike(r"^\p{L}$"), 4).otherwise(5)
    favour = F.lit(False)
    for k, pattern in _FOR.items():
        favour = F.when(F.col("kind") == k, F.col("left").rlike(pattern)).otherwise(favour)
    groups = F.size(F.split(found, r"[^0-9A-Za-z]+"))
    return rows.select(
        "*", F.col("kindno").alias("f_kind"), F.col("ok").cast("int").alias("f_ok"), F.coalesce(F.least(n, F.lit(20)), F.lit(0)).alias("f_digits"),
        F.least(groups, F.lit(8)).alias("f_groups"), favour.cast("int").alias("f_for"), F.col("left").rlike(_AGAINST).cast("int").alias("f_against"),
        beside(F.substring("left", -1, 1)).alias("f_left"), beside(F.substring("right", 1, 1)).alias("f_right"),
        found.rlike(_ENDING).cast("int").alias("f_ending"), found.contains("(").cast("int").alias("f_bracket"), found.rlike("[./]").cast("int").alias("f_dotted"),
    )


# --- the trees --------------------------------------------------------------------------------------------------


#: Words before what is made up, for fitting and for calibrating; by kind those of personal data, then those of other numbers.
_BEFORE = {
    "email": (("write to ", "e-mail: ", "contact ", "und ", "ask ", "", "sent by ", "reach me: "), ("mail ", "reply to ", "from ", "see ", "")),
    "ip": (("host ", "login from ", "server ", "at ", "the ", "", "blocked "), ("address ", "peer ", "ping ", "on ")),
    "card": (("card ", "visa: ", "credit card no ", "paid with card ", "payment ", "", "number "), ("amex ", "charged to ", "debit ", "account ")),
    "phone": (("call ", "tel. ", "phone: ", "mobile ", "fax ", "ph: ", "or call me, ", "telephone "), ("cell ", "whatsapp ", "call us: ", "phone no ")),
    "": (
        ("order ", "invoice no ", "version ", "isbn ", "ref ", "build ", "serial ", "page ", "the ", "total ", "part ", "fig. ", "", "and ", "score ", "between ", "from ", "mobile ", "card ", "mail "),
        ("sku ", "docket ", "section ", "from ", "id ", "chapter ", "", "model "),
    ),
}


def snippets(spark: SparkSession, n: int = SNIPPETS) -> DataFrame:
    """(doc_id, text, label, held): labelled snippets, about half of them personal data written in less strict ways."""
    pick = lambda words, salt: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))) + 1).cast("int"))
    num = lambda lo, hi, salt: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(hi - lo + 1)) + lo).cast("string")
    four = lambda salt: F.lpad(num(0, 9999, salt), 4, "0")
    held = F.pmod(F.col("id"), F.lit(3)) == 0
    before = lambda kind: F.when(held, pick(_BEFORE[kind][1], 28)).otherwise(pick(_BEFORE[kind][0], 28))
    names, hosts = ["jane.doe", "k.meyer", "info", "sales7", "rob_t", "j"], ["example", "mail-host", "firm2", "uni"]
    at, dot = ["(at)", "[at]", " (at) ", " [at] "], [".", "(dot)", "[dot]", " (dot) "]
    email = F.concat(pick(names, 1), pick(at, 2), pick(hosts, 3), pick(dot, 4), pick(["com", "org", "net", "de"], 5))
    spelled = F.concat(pick(names, 1), F.lit(" at "), pick(hosts, 3), F.lit(" dot "), pick(["com", "org", "net", "de"], 5))
    ip = F.concat(num(1, 255, 6), F.lit("[.]"), num(0, 255, 7), F.lit("[.]"), num(0, 255, 8), F.lit("[.]"), num(1, 254, 9))
    far = F.concat(num(256, 999, 6), F.lit("[.]"), num(0, 999, 7), F.lit("[.]"), num(0, 255, 8), F.lit("[.]"), num(1, 254, 9))
    sep = pick([".", "/", " - "], 10)
    stem = F.concat(F.lit("4"), F.lpad(num(0, 999, 11), 3, "0"), four(12), four(13), F.lpad(num(0, 999, 14), 3, "0"))
    check = F.expr("transform(sequence(0, 9), c -> concat(stem, c))")
    good = F.filter(check, lambda x: luhn(x))[0]
    grouped = lambda x: F.concat(F.substring(x, 1, 4), sep, F.substring(x, 5, 4), sep, F.substring(x, 9, 4), sep, F.substring(x, 13, 4))
    bad = F.concat("stem", F.pmod(F.substring(good, 16, 1).cast("int") + 1 + F.pmod(F.col("id"), F.lit(8)), F.lit(10)).cast("string"))

    def telephone(salt: int) -> Column:
        area = F.concat(pick(["(", ""], salt), num(200, 989, salt + 1))
        return F.concat(area, F.when(area.startswith("("), ") ").otherwise(pick(["-", ".", " "], salt + 2)), num(200, 999, salt + 3), pick(["-", ".", " "], salt + 4), four(salt + 5))

    phone = telephone(15)
    two = F.concat(phone, pick([" or ", " and ", ", "], 40), telephone(41))
    date = F.concat(num(10, 28, 21), pick([".", "/", "-"], 22), num(100, 999, 23), pick([" ", ".", "-"], 24), num(1900, 2030, 25))
    range_ = F.concat(num(100, 999, 50), F.lit("-"), num(100, 999, 51), F.lit(" "), num(100, 999, 52))
    end = pick([".", ",", " and so on", "", ";", ")"], 26)
    case = F.pmod(F.xxhash64("id", F.lit(0)), F.lit(13))
    glued = pick(["x", "ab", "9", "_"], 27)
    prose = F.concat(pick(["we met", "look", "he was", "arrive", "aim"], 53), F.lit(" at "), pick(["noon", "the", "home", "a", "this"], 54), F.lit(" dot "), pick(["the", "and", "by", "matrix", "him"], 55))
    text = (
        F.when(case == 0, F.concat(before("email"), email, end)).when(case == 1, F.concat(before("ip"), ip, end))
        .when(case == 2, F.concat(before("card"), grouped(good), end)).when(case == 3, F.concat(before("phone"), phone, end))
        .when(case == 4, F.concat(before("email"), spelled, end)).when(case == 5, F.concat(before("phone"), two, end))
        .when(case == 6, F.concat(before(""), grouped(bad), end)).when(case == 7, F.concat(before(""), phone, end))
        .when(case == 8, F.concat(before(""), date, end)).when(case == 9, F.concat(before(""), glued, phone, glued))
        .when(case == 10, F.concat(before(""), far, end)).when(case == 11, F.concat(prose, end)).otherwise(F.concat(before(""), range_, end))
    )
    return spark.range(n).withColumn("stem", stem).select(F.col("id").alias("doc_id"), text.alias("text"), (case < 6).cast("int").alias("label"), held.alias("held"))


_FEATURES = ("f_kind", "f_ok", "f_digits", "f_groups", "f_for", "f_against", "f_left", "f_right", "f_bracket", "f_dotted", "f_ending")


def _best_split(cells: list[dict], rows: list[int], grad: list[float], hess: list[float]) -> tuple[float, str, int] | None:
    best = None
    g_all, h_all = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
    for f in _FEATURES:
        for cut in sorted({cells[i][f] for i in rows})[:-1]:
            left = [i for i in rows if cells[i][f] <= cut]
            g, h = sum(grad[i] for i in left), sum(hess[i] for i in left)
            gain = g * g / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, f, cut)
    return best


def boost(cells: list[dict], rounds: int = ROUNDS, rate: float = 0.4) -> list:
    """Trees of DEPTH levels, as (feature, cut, left, right) with a number at a leaf, by second-order boosting of cells."""
    raw = [0.0] * len(cells)

    def grow(rows: list[int], depth: int, grad, hess):
        split = _best_split(cells, rows, grad, hess) if depth and len(rows) > 1 else None
        if split is None or split[0] <= 1e-6:
            return rate * sum(grad[i] for i in rows) / (sum(hess[i] for i in rows) + 1)
        _, f, cut = split
        return f, cut, grow([i for i in rows if cells[i][f] <= cut], depth - 1, grad, hess), grow([i for i in rows if cells[i][f] > cut], depth - 1, grad, hess)

    trees = []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-x)) for x in raw]
        grad = [c["pos"] - (c["pos"] + c["neg"]) * q for c, q in zip(cells, p, strict=True)]
        hess = [(c["pos"] + c["neg"]) * q * (1 - q) for c, q in zip(cells, p, strict=True)]
        trees.append(grow(list(range(len(cells))), DEPTH, grad, hess))
        raw = [x + value(trees[-1], c) for x, c in zip(raw, cells, strict=True)]
    return trees


def value(tree, cell: dict) -> float:
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        tree = low if cell[f] <= cut else high
    return tree


def _expression(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, cut, low, high = tree
    return F.when(F.col(f) <= cut, _expression(low)).otherwise(_expression(high))


def fitted(spark: SparkSession, n: int = SNIPPETS, precision: float = PRECISION) -> tuple[list, dict[str, float]]:
    """Trees and each kind's threshold: the least score from which on the held-out snippets have that precision."""
    rows = described(proposals(snippets(spark, n), ["label", "held"]).where("gen IS NOT NULL")).where("NOT base")
    got = rows.groupBy("held", "kind", *_FEATURES).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).orderBy("held", "kind", *_FEATURES).collect()
    cells = [r.asDict() for r in got]
    trees = boost([c for c in cells if not c["held"]])
    limits = {}
    for kind in KINDS:
        held = sorted(((sum(value(t, c) for t in trees), c["pos"], c["neg"]) for c in cells if c["held"] and c["kind"] == kind), reverse=True)
        limits[kind], pos, neg = math.inf, 0, 0
        for s, p, q in held:
            pos, neg = pos + p, neg + q
            if s > 0 and pos >= precision * (pos + neg):
                limits[kind] = s - 1e-9
    return trees, limits


def spans(docs: DataFrame, keep: list[str], model: tuple[list, dict[str, float]] | None = None) -> DataFrame:
    """Rows _row, keep, kindno, kind, start, finish, base, score of the spans taken; documents without any have kind null."""
    trees, limits = model or fitted(docs.sparkSession)
    rows = described(C.cut(proposals(docs, keep)))
    score = F.lit(0.0)
    for t in trees:
        score = score + _expression(t)
    limit = F.lit(math.inf)
    for kind, x in limits.items():
        limit = F.when(F.col("kind") == kind, F.lit(x)).otherwise(limit)
    rows = rows.withColumn("score", F.when(~F.col("base"), score))
    rows = rows.withColumn("takes", F.when(F.col("gen").isNull(), False).when(F.col("base"), F.col("ok")).otherwise(F.col("score") >= limit))
    # one row stands for a document whose proposals all fail
    cols = ("kindno", "kind", "start", "finish", "base", "score")
    rows = rows.select("_row", *keep, "takes", *[F.when(F.col("takes"), F.col(c)).alias(c) for c in cols])
    order = Window.partitionBy("_row").orderBy("start", F.desc("base"), "finish")
    is_base, own = F.col("takes") & F.col("base"), F.col("takes") & ~F.col("base")
    past = F.max(F.when(is_base, F.col("finish"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    coming = F.min(F.when(is_base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    clash = own & ((F.coalesce(past, F.lit(0)) > F.col("start")) | (F.coalesce(coming, F.col("finish")) < F.col("finish")))
    rows = rows.withColumn("clash", clash)
    rows = rows.select("_row", *keep, *[F.when(~F.col("clash"), F.col(c)).alias(c) for c in cols])
    # runs of added spans each of which overlaps one before it; a span alone is taken
    added = F.col("kind").isNotNull() & ~F.col("base")
    reach = F.max(F.when(added, F.col("finish"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("run", F.sum((added & (F.coalesce(reach, F.lit(0)) <= F.col("start"))).cast("int")).over(order))
    rows = rows.withColumn("crowd", F.when(added, F.count_if(added).over(Window.partitionBy("_row", "run"))).otherwise(0))
    rows = C.cut(rows)
    crowded = rows.where("crowd > 1").select("_row", *keep, "run", F.struct((-F.col("score")).alias("a"), (F.col("start") - F.col("finish")).alias("b"), *cols).alias("x"))
    crowded = crowded.groupBy("_row", "run").agg(*[F.first(c).alias(c) for c in keep], F.array_sort(F.collect_list("x")).alias("x"))
    apart = lambda acc, e: ~F.exists(acc, lambda t: (t["start"] < e["finish"]) & (e["start"] < t["finish"]))
    taken = F.aggregate("x", F.filter("x", lambda e: F.lit(False)), lambda acc, e: F.when(apart(acc, e), F.concat(acc, F.array(e))).otherwise(acc))
    crowded = crowded.select("_row", *keep, F.explode(taken).alias("x")).select("_row", *keep, *[F.col(f"x.{c}").alias(c) for c in cols])
    return rows.where("crowd <= 1").select("_row", *keep, *cols).unionByName(crowded)


def found(docs: DataFrame, keep: list[str], model=None) -> DataFrame:
    """A row for each document: keep, and spans, an array of (kindno, start, finish, base) in that order."""
    rows = spans(docs, keep, model)
    firsts = [F.first(c).alias(c) for c in keep]
    one = F.when(F.col("kind").isNotNull(), F.struct("kindno", "start", "finish", "base"))
    return rows.groupBy("_row").agg(*firsts, F.array_sort(F.collect_list(one)).alias("spans"))


def _written(items: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", F.element_at(kinds, x["kindno"]), x["start"].cast("string"), x["finish"].cast("string"))), ",")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    docs = found(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"])
    base = F.filter("spans", lambda x: x["base"])
    # a second argument of the lambda, even one with a default, would be the element's place
    of = lambda k: F.size(F.filter(base, lambda x: x["kindno"] == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS, 1)]
    return docs.select("doc_id", *counts, F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, model=None) -> DataFrame:
    """docs with each span in text replaced by its kind in brackets; of base spans that overlap, the one that begins first."""
    keep = docs.columns
    # the columns of docs in one, so that no name of theirs meets one of ours
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep if c != "text"], F.lit(1).alias("text")).alias("row"), "text", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32).alias("_pii_key"))
    taken = found(rows.select("_pii_key", "text"), ["_pii_key"], model).where(F.size("spans") > 0)
    # equal texts have equal spans
    taken = C.cut(taken.groupBy("_pii_key").agg(F.first("spans").alias("_spans"), F.count(F.lit(1)).alias("n")))
    others = [F.col(f"row.`{c}`").cast("string") for c in keep if c != "text" and not isinstance(docs.schema[c].dataType, MapType)]
    spread = rows.withColumn("_pii_nth", F.xxhash64(F.spark_partition_id(), *others))
    rows = C.salted_join(spread, taken.drop("n"), "_pii_key", "_pii_nth", "left", counts=taken.select("_pii_key", "n"))
    ordered = F.array_sort(F.transform("_spans", lambda x: F.struct(x["start"].alias("start"), x["finish"].alias("finish"), x["kindno"].alias("kindno"))))
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        mine = x["start"] >= acc["at"]
        piece = F.concat(F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.element_at(kinds, x["kindno"]))
        return F.when(mine, F.struct(x["finish"].cast("long").alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))).otherwise(F.struct(F.greatest(acc["at"], x["finish"].cast("long")).alias("at"), acc["out"].alias("out")))

    text = F.aggregate(ordered, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    changed = F.when(F.size("_spans") > 0, text).otherwise(F.col("text")).alias("text")
    return rows.select(*[changed if c == "text" else F.col(f"row.`{c}`") for c in keep])
