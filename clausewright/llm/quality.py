"""Quality by hierarchical empirical Bayes.

A logistic classifier over the whole text (hashed letter trigrams and measures of its surface) gives each document its
own evidence. It is fitted on a bounded sample of labelled documents (LABELLED on average, by hash of the id), once on
each half of them; a labelled document is judged by the half that it is not in, any other by both. Evidence is then
summed by host and by path within host: a host's posterior mean is shrunk toward the global mean, a path's toward its
host's, each by as many pseudo-documents as the variance between groups speaks for (method of moments), so sparse sites
stay near their prior. A document's log-odds are combined with those of the site, by what the other documents of its
path say about it; how much the two weigh is fitted on the labelled documents' evidence from the other half, so that
sites that tell nothing weigh nothing.

Sums and joins are on narrow rows; hot hosts and paths are summed before each shuffle. Defined results: null or empty
text has the features of an empty text; a null host or path is a group of its own; repeated rows count each; of several
labels of a document the mean counts, good from one half on; without usable labels the classifier says one half for
all. kept holds where the score reaches the level that GOOD of the labelled good documents reach, one half at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

LABELLED = 20_000
GOOD = 0.98
BITS = 8  # log2 of the number of trigram buckets
SURFACE = 8
#: Paths whose posteriors are sent to all executors; more than these are joined by a shuffle.
SENT = 200_000

#: Bytes as trigrams see them: letters in lower case, digits as one, white space as one, bytes of other scripts as one.
_SEEN = np.arange(256, dtype=np.uint8)
_SEEN[65:91] += 32
_SEEN[48:58] = 48
_SEEN[C.SPACE] = 32
_SEEN[128:] = 128
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"*$#&%|@~^_=<>{}[]\\/+", dtype=np.uint8))
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) < 58)
_UPPER = (np.arange(256) >= 65) & (np.arange(256) < 91)


def features(parts: list[memoryview], bits: int = BITS) -> np.ndarray:
    """A row for each text: roots of the shares of its trigrams by bucket, then the measures of its surface."""
    raw, starts = C.joined(parts, b"\n")
    size = np.diff(starts)
    doc = np.repeat(np.arange(len(parts)), size)
    seen = _SEEN[raw].astype(np.uint32)
    gram = seen.copy()
    gram[1:] |= seen[:-1] << np.uint32(8)
    gram[2:] |= seen[:-2] << np.uint32(16)
    gram[starts[:-1]] = seen[starts[:-1]]  # nothing of the text before
    second = starts[:-1][size > 1] + 1
    gram[second] = seen[second] | (seen[second - 1] << np.uint32(8))
    bucket = (gram * np.uint32(2654435761)) >> np.uint32(32 - bits)
    grams = np.bincount(doc << bits | bucket, minlength=len(parts) << bits).reshape(len(parts), 1 << bits)
    n = np.maximum(size - 1, 0) + 1.0
    at = starts[:-1]
    share = lambda what: np.add.reduceat(what[raw].astype(np.int64), at) / n
    words = C.word_bounds(raw, starts)[2]
    lines = [bytes(p).split(b"\n") for p in parts]
    count = np.array([len(x) for x in lines])
    again = np.array([1 - len(set(x)) / len(x) for x in lines])
    surface = [np.log1p(words), share(_SYMBOL), share(_DIGIT), share(_UPPER), again, np.log(n / count), np.log(n / (words + 1)), words / n]
    return np.column_stack([np.sqrt(grams / size[:, None]), *surface]).astype(np.float32)


def fit(rows: np.ndarray, label: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method on standardised columns: weights, means, scales."""
    mean, scale = rows.mean(0), rows.std(0) + 1e-6
    x = np.column_stack([np.ones(len(rows)), np.clip((rows - mean) / scale, -5, 5)])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (label - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w, mean, scale


def _odds(rows: np.ndarray, model) -> np.ndarray:
    w, mean, scale = model
    return np.clip(w[0] + np.clip((rows - mean) / scale, -5, 5) @ w[1:], -12, 12)


def _featured(rows: DataFrame) -> DataFrame:
    """(doc_id, good, x) of rows (doc_id, good, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, parts in C.text_blocks(batch.column(2)):
                yield pa.RecordBatch.from_arrays([*(c.slice(first, last - first) for c in batch.columns[:2]), pa.array(list(features(parts)), pa.list_(pa.float32()))], names=["doc_id", "good", "x"])

    return rows.select("doc_id", "good", "text").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, good double, x array<float>")


def _judged(docs: DataFrame, models: list) -> DataFrame:
    """docs (doc_id, host, path, text) with odds_0 and odds_1, those of both models, in place of text."""
    sent = docs.sparkSession.sparkContext.broadcast(models)
    names = ["doc_id", "host", "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        for batch in batches:
            for first, last, parts in C.text_blocks(batch.column(3)):
                x = features(parts)
                odds = [pa.array(_odds(x, m) if m is not None else np.zeros(len(x))) for m in models]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, last - first) for c in batch.columns[:3]), *odds], names=[*names, "odds_0", "odds_1"])

    ddl = ", ".join(f"{n} {docs.schema[n].dataType.simpleString()}" for n in names)
    return docs.select(*names, "text").mapInArrow(run, f"{ddl}, odds_0 double, odds_1 double")


def _strength(groups: DataFrame, mean: Column) -> float:
    """Pseudo-documents of the prior of groups (n, s, q: count, sum, sum of squares) around mean."""
    r = groups.where("n > 1").agg(
        F.count(F.lit(1)).alias("k"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"), F.sum(F.col("n") - 1).alias("free"),
        F.sum(F.col("n") * (F.col("s") / F.col("n") - mean) ** 2).alias("between"), F.sum("n").alias("all"),
    ).first()
    if not r["k"] or r["k"] < 2 or not r["free"]:
        return 20.0
    within = max(r["within"] / r["free"], 1e-6)
    var = max((r["between"] - (r["k"] - 1) * within) / r["all"], within / 1000)
    return float(min(max(within / var, 1.0), 1000.0))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def _weights(own: np.ndarray, site: np.ndarray, good: np.ndarray) -> tuple[float, float, float]:
    """What is added, and how own and site odds weigh; a site's never less than nothing."""
    if not 0 < good.sum() < len(good):
        return 0.0, 1.0, 0.0

    def solved(x: np.ndarray) -> np.ndarray:
        start = np.r_[0.0, 1.0, np.zeros(x.shape[1] - 2)]  # own odds as they are, until the labels say otherwise
        w = start.copy()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (good - p) - (w - start))
            w += np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-9:
                break
        return w

    w = solved(np.column_stack([np.ones(len(own)), own, site]))
    if w[2] < 0:
        w = np.r_[solved(np.column_stack([np.ones(len(own)), own])), 0.0]
    return float(w[0]), max(float(w[1]), 1e-3), float(w[2])


def scored(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, good: float = GOOD) -> DataFrame:
    """(doc_id, own, host_posterior, path_posterior, score, kept) of docs (doc_id, text, host, path); labels (doc_id, quality)."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.avg((F.col("quality") > 0).cast("double")) >= 0.5).cast("double").alias("good"))
    known = C.cut(known)
    every = max(1, -(-known.count() // labelled))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int"))
    got = _featured(docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", "good")), "doc_id")).join(F.broadcast(sample.select("doc_id", "half")), "doc_id").drop("doc_id").toPandas()
    models = []
    for half in (0, 1):  # each is fitted on the half of that number
        own = got[got["half"] == half]
        models.append(fit(np.stack(own["x"].to_numpy()).astype(np.float64), own["good"].to_numpy(float)) if own["good"].nunique() > 1 else None)
    models = [m or models[1 - k] for k, m in enumerate(models)]
    judged = _judged(docs, models).join(F.broadcast(sample), "doc_id", "left")
    odds = F.when(F.col("half") == 0, F.col("odds_1")).when(F.col("half") == 1, F.col("odds_0")).otherwise((F.col("odds_0") + F.col("odds_1")) / 2)
    own = C.cut(judged.select("doc_id", "host", "path", "good", odds.alias("odds"), (1 / (1 + F.exp(-odds))).alias("own")))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("own").alias("s"), F.sum(F.col("own") * F.col("own")).alias("q")]
    paths = C.cut(own.groupBy("host", "path").agg(*sums))
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    prior = float(total["s"] / total["n"]) if total["n"] else 0.5
    k_host = _strength(hosts, F.lit(prior))
    hosts = hosts.select("host", ((F.col("s") + prior * k_host) / (F.col("n") + k_host)).alias("host_posterior"))
    paths = paths.alias("l").join(hosts.alias("r"), F.col("l.host").eqNullSafe(F.col("r.host"))).select("l.*", "host_posterior")
    k_path = _strength(paths, F.col("host_posterior"))
    key = F.to_json(F.struct("host", "path"))
    paths = C.cut(paths.select(key.alias("_site"), "n", "s", "host_posterior", ((F.col("s") + F.col("host_posterior") * k_path) / (F.col("n") + k_path)).alias("path_posterior")))
    rows = own.withColumn("_site", key).withColumn("_nth", F.xxhash64("doc_id", "odds"))
    site = rows.join(F.broadcast(paths), "_site") if paths.count() <= SENT else C.salted_join(rows, paths, "_site", "_nth", counts=paths.select("_site", "n"))
    # what the others of the path say
    others = (F.col("s") - F.col("own") + F.col("host_posterior") * k_path) / (F.col("n") - 1 + k_path)
    site = C.cut(site.select("doc_id", "good", "odds", "own", "host_posterior", "path_posterior", (_logit(others) - _logit(F.lit(prior))).alias("site")))
    got = site.where("good IS NOT NULL").select("odds", "site", "good").toPandas()
    add, one, two = _weights(*(got[c].to_numpy(float) for c in ("odds", "site", "good")))
    score = 1 / (1 + F.exp(-(F.lit(add) + F.lit(one) * F.col("odds") + F.lit(two) * F.col("site"))))
    out = C.cut(site.select("doc_id", "own", "host_posterior", "path_posterior", score.alias("score")))
    level = out.join(known.where("good > 0"), "doc_id").agg(F.percentile_approx("score", 1 - good, 10_000)).first()[0]
    return out.withColumn("kept", F.col("score") >= F.lit(min(0.5, level if level is not None else 0.5)))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """A document's source is its host, its language the path: as sites have sections by language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    return scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
