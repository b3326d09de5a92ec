"""Posteriors of hosts and paths against the same worked out document by document."""

import random
from collections import defaultdict

import numpy as np

from clausewright.llm import quality


def strength(groups, centres):
    """Pseudo-documents by moments: variance within groups over that between them."""
    several = [(np.array(g), c) for g, c in zip(groups, centres, strict=True) if len(g) > 1]
    within = max(sum(((g - g.mean()) ** 2).sum() for g, _ in several) / sum(len(g) - 1 for g, _ in several), 1e-6)
    between = sum(len(g) * (g.mean() - c) ** 2 for g, c in several)
    var = max((between - (len(several) - 1) * within) / sum(len(g) for g, _ in several), within / 1000)
    return min(max(within / var, 1.0), 1000.0)


def test_posteriors_of_ten_sites(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(160):
        site = rng.randrange(10)
        good = rng.random() < (0.9 if site % 3 else 0.2)
        words = [rng.choice("river stone letter window garden market".split()) if good else rng.choice("$$ !! BUY 0000 click ####".split()) for _ in range(rng.randint(5, 30))]
        rows.append((i, " ".join(words), None if site == 9 else f"host{site % 3}", f"/{site}"))
        labels.append((i, int(good)))
    rows.append((500, "a lonely page of its own", "host7", "/x"))  # a site of one document
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    out = {r.doc_id: r for r in quality.scored(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    hosts, paths = defaultdict(list), defaultdict(list)
    for i, _, host, path in rows:
        hosts[host].append(out[i].own)
        paths[host, path].append(out[i].own)
    every = [x for g in hosts.values() for x in g]
    prior = float(np.mean(every))
    k = strength(hosts.values(), [prior] * len(hosts))
    host = {h: (sum(g) + prior * k) / (len(g) + k) for h, g in hosts.items()}
    kp = strength(paths.values(), [host[h] for h, _ in paths])
    path = {p: (sum(g) + host[p[0]] * kp) / (len(g) + kp) for p, g in paths.items()}
    for i, _, h, p in rows:
        assert np.isclose(out[i].host_posterior, host[h]) and np.isclose(out[i].path_posterior, path[h, p])
    assert abs(out[500].path_posterior - host["host7"]) < abs(out[500].own - host["host7"])  # a sparse site is drawn to its host
    order = {i: out[i].score for i, good in labels}
    assert np.mean([order[i] for i, g in labels if g]) > 0.8 > 0.2 > np.mean([order[i] for i, g in labels if not g])
