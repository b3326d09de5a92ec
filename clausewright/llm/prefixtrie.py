"""The trie of conversations: each distinct sequence of first turns is a node, with what its subtree holds.

A turn is named by SHA-256 of its role and text, so texts stay where they are read. A conversation is a path of such
names; equal paths are one, counted. Paths are hash-partitioned by their first turn, and each partition builds its tries
inside applyInPandas: dictionaries of children by name, one node a distinct prefix, figures summed in postorder without
recursion. The paths that begin with one turn may be more than a task should hold: such a subtrie is split. The turns
that all of its paths begin with become nodes of the upper trie, and the rest of each path goes back to be partitioned by
its next turn, and so on until no subtrie is too large or it is one path. What the partitions found at the top of their
subtries is then summed up the levels of the upper trie, by groupings.

Names of the ends of a node (one digest over all conversations that end there) are made from pieces: a piece joins the
ids of one range of numbers, and pieces are hashed one after the other in order, so that no list of ids is held at once.

Defined results: rows without conv_id are in no conversation and are left out; a null turn comes first; turns of one
number are ordered by role, then by SHA-256 of the text, so repeated rows are turns of their own; null role or text is
empty; a conversation is in memory as the names of its turns, of any number, its texts never; conversations of which
nothing is left after rebuilding end at the root; an empty table has no node; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Turns of a subtrie above which it is split; a partition gets a quarter of them, about, and whole subtries.
TURNS = 20_000
#: Conversation ids in one piece of a node's ends.
IDS = 4096
#: Conversations that may share their first turns, and the turns that they share at most.
FAMILY, SHARED = 100, 6

NO_ENDS = NO_TURNS = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, path_id string"
_COLUMNS = [c.split()[0] for c in _NODE.split(", ")]


def turn_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path: array of struct(name, chars)) of conversations (conv_id, turn, role, text), turns in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(text.cast("binary"), 256)
    name = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, digest).cast("binary"), 256).substr(1, 32)
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", role.alias("role"), digest.alias("digest"), name.alias("name"), F.length(text).alias("chars")).alias("t"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda t: F.struct(t["name"].alias("name"), t["chars"].alias("chars"))).alias("path"))


def rebuilt(paths: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """Paths whose first h turns are those of the family's first conversation; h is crc32 of the id modulo shared.

    A head is shared - 1 turns at most, and family conversations take it at most."""
    base = F.col("conv_id") - F.col("conv_id") % F.lit(family)
    heads = paths.where(F.col("conv_id") % F.lit(family) == 0).select(F.col("conv_id").alias("base"), F.slice("path", 1, max(shared - 1, 1)).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % F.lit(shared)).cast("int")
    rows = paths.select("conv_id", "path", base.alias("base"), h.alias("h")).join(heads, "base", "left")
    own = F.slice("path", F.col("h") + 1, F.size("path"))
    head = F.when(F.col("head").isNull() | (F.col("h") == 0), F.slice("path", 1, 0)).otherwise(F.slice("head", 1, F.col("h")))
    return rows.select("conv_id", F.concat(head, own).alias("path"))


def path_id(path: Column) -> Column:
    return F.sha2(F.array_join(path["name"], ",").cast("binary"), 256)


def ends(members: DataFrame, ids: int = IDS) -> DataFrame:
    """(path_id, ends_sha256) of members (path_id, conv_id): SHA-256 of the ids in order, comma-joined."""
    piece = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = members.groupBy("path_id", F.floor(F.col("conv_id") / F.lit(ids)).cast("long").alias("nth")).agg(piece.alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            path_id, out = [], []
            for p, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if p == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        path_id.append(now), out.append(digest.hexdigest())
                    now, digest = p, hashlib.sha256()
                digest.update(text.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(path_id, pa.string()), pa.array(out, pa.string())], names=["path_id", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["path_id", "ends_sha256"])

    return pieces.repartition("path_id").sortWithinPartitions("path_id", "nth").select("path_id", "piece").mapInArrow(run, "path_id string, ends_sha256 string")


def build(paths: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the tries of paths (gid, depth, least_above, path_id, names, chars, convs, least), one trie a gid.

    Those of the first turns are marked top: their figures go on to the node gid of the upper trie."""
    children: list[dict] = []  # of a node, by name
    above, depth, least_over, gid_of, chars, n_convs, least, path_of = [], [], [], [], [], [], [], []
    roots: dict = {}
    for gid, start, least_above, path_id, names, sizes, convs, first in zip(*(paths[c] for c in ("gid", "depth", "least_above", "path_id", "names", "chars", "convs", "least")), strict=True):
        at, siblings = -1, roots.setdefault(gid, {})
        for d, (name, size) in enumerate(zip(names, sizes, strict=True)):
            found = siblings.get(name)
            if found is None:
                found = siblings[name] = len(children)
                children.append({}), above.append(at), depth.append(start + d + 1), gid_of.append(gid), chars.append(int(size))
                least_over.append(least_above), n_convs.append(0), least.append(first), path_of.append(None)
            n_convs[found] += convs
            least[found] = min(least[found], first)
            at, siblings = found, children[found]
        path_of[at] = path_id
    count = len(children)
    saved = [(c - 1) * size for c, size in zip(n_convs, chars, strict=True)]
    leaves = [0] * count
    # postorder: a node comes when all of its children have been; a stack of nodes and of children yet to visit
    for top in [x for r in roots.values() for x in r.values()]:
        stack = [(top, iter(children[top].values()))]
        while stack:
            node, rest = stack[-1]
            child = next(rest, None)
            if child is not None:
                stack.append((child, iter(children[child].values())))
                continue
            stack.pop()
            leaves[node] = leaves[node] or 1
            up = above[node]
            if up >= 0:
                leaves[up] += leaves[node]
                saved[up] += saved[node]
    over = [least_over[i] if above[i] < 0 else least[above[i]] for i in range(count)]
    out = {"conv_id": least, "depth": depth, "parent_conv_id": over, "n_convs": n_convs, "n_children": [len(c) for c in children], "n_leaves": leaves, "saved_tokens": saved, "path_id": path_of, "gid": gid_of, "top": [x < 0 for x in above]}
    return pd.DataFrame({k: pd.Series(v, dtype="object" if k in ("path_id", "gid") else "bool" if k == "top" else "int64") for k, v in out.items()})


def _common(least: Column, most: Column) -> Column:
    """How many first turns all arrays between two have in common."""
    same = F.zip_with(least, most, lambda a, b: a.eqNullSafe(b))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")


def trie(members: DataFrame, turns: int = TURNS) -> DataFrame:
    """The nodes of members (conv_id, path): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and path_id, which names the path that ends there (null if none). members is read several times: give a table."""
    spark = members.sparkSession
    named = members.select("conv_id", "path", path_id(F.col("path")).alias("path_id"))
    rest = named.groupBy("path_id").agg(F.first("path").alias("rest"), F.count(F.lit(1)).alias("convs"), F.min("conv_id").alias("least"))
    whole = members.agg(F.count(F.lit(1)).alias("convs"), F.min("conv_id").alias("least"), F.sum(F.size("path")).alias("turns")).first()
    if not whole["convs"]:
        return spark.createDataFrame([], _NODE)
    # the upper trie, by round: a node for each split subtrie (with the turns that lead to it), the root first
    node = "gid string, up string, depth int, least_above long, lead array<struct<name:string,chars:int>>, convs long, least long, path_id string"
    upper = [spark.createDataFrame([("", None, 0, None, [], whole["convs"], whole["least"], NO_TURNS)], node)]
    rows = C.cut(rest.where(F.size("rest") > 0).select(F.lit("").alias("gid"), F.lit(0).alias("depth"), F.lit(whole["least"]).cast("long").alias("least_above"), "path_id", "rest", "convs", "least"))
    ready = []
    while True:
        rows = rows.withColumn("key", F.sha2(F.concat("gid", F.col("rest")[0]["name"]).cast("binary"), 256).substr(1, 32))
        groups = rows.groupBy("key").agg(F.sum(F.size("rest")).alias("size"), F.count(F.lit(1)).alias("n"))
        large = C.cut(groups.where((F.col("size") > turns) & (F.col("n") > 1)))
        if large.isEmpty():
            ready.append(rows)
            break
        # keys of many rows are dealt to many tasks; what isn't in large stays as it is
        marked = C.cut(C.salted_join(rows, large.select("key", F.lit(True).alias("split")), "key", "path_id", how="left", counts=large))
        ready.append(marked.where(F.col("split").isNull()).drop("split"))
        over = marked.where("split")
        facts = over.groupBy("key").agg(F.first("gid").alias("up"), F.first("depth").alias("depth"), F.first("least_above").alias("least_above"), F.sum("convs").alias("convs"), F.min("least").alias("least"), F.min("rest").alias("a"), F.max("rest").alias("b"))
        facts = C.cut(facts.withColumn("lead", F.slice("a", F.lit(1), _common(F.col("a"), F.col("b")))).drop("a", "b"))
        with_lead = facts.select("key", F.size("lead").alias("taken"), F.col("least").alias("least_of_key"))
        over = C.salted_join(over, with_lead, "key", "path_id", counts=large)
        at = F.slice("rest", F.col("taken") + 1, F.size("rest"))
        over = C.cut(over.select(F.col("key").alias("gid"), (F.col("depth") + F.col("taken")).alias("depth"), F.col("least_of_key").alias("least_above"), "path_id", at.alias("rest"), "convs", "least"))
        stops = over.where(F.size("rest") == 0).select(F.col("gid").alias("key"), "path_id")  # paths are distinct: one a key
        upper.append(C.cut(facts.join(stops, "key", "left").select(F.col("key").alias("gid"), "up", "depth", "least_above", "lead", "convs", "least", "path_id")))
        rows = over.where(F.size("rest") > 0)
    paths = reduce(DataFrame.unionByName, ready)
    parts = max(1, -(-4 * whole["turns"] // turns))
    fed = paths.select(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"), "gid", "depth", "least_above", "path_id", F.col("rest")["name"].alias("names"), F.col("rest")["chars"].alias("chars"), "convs", "least")
    lower = C.cut(fed.groupBy("part").applyInPandas(lambda rows: build(rows), f"{_NODE}, gid string, top boolean"))
    # up the levels of the upper trie: what stands at the top of the tries below a node, and of the nodes below it
    figures = ["n", "leaves", "saved"]
    tops = lower.where("top").groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    out, below, zero = [lower], tops, F.lit(0).cast("long")
    for level in reversed(upper):
        found = level.join(below.groupBy("gid").agg(*[F.sum(c).alias(c) for c in figures]), "gid", "left")
        found = C.cut(found.select(*level.columns, F.coalesce("n", zero).alias("n"), F.greatest(F.coalesce("leaves", zero), F.lit(1).cast("long")).alias("leaves"), F.coalesce("saved", zero).alias("saved")))
        out.append(_upper_nodes(found))
        own = F.aggregate("lead", zero, lambda s, t: s + (F.col("convs") - 1) * t["chars"])
        up = found.where(F.col("up").isNotNull()).select(F.col("up").alias("gid"), F.lit(1).cast("long").alias("n"), "leaves", (F.col("saved") + own).alias("saved"))
        below = tops.unionByName(up)
    return reduce(DataFrame.unionByName, [x.select(*_COLUMNS) for x in out])


def _upper_nodes(found: DataFrame) -> DataFrame:
    """The nodes of the turns that lead to each split one, itself the last; for the root, which no turn leads to, itself."""
    k, one = F.col("k"), F.lit(1).cast("long")
    chain = found.select("*", F.posexplode_outer("lead").alias("k", "turn"))
    own = F.aggregate(F.slice("lead", F.coalesce(k, F.lit(0)) + 1, F.size("lead")), F.lit(0).cast("long"), lambda s, t: s + (F.col("convs") - 1) * t["chars"])
    last = k.isNull() | (k == F.size("lead") - 1)
    figures = {"n_convs": F.col("convs"), "n_children": F.when(last, F.col("n")).otherwise(one), "n_leaves": F.col("leaves"), "saved_tokens": F.col("saved") + own, "path_id": F.when(last, F.col("path_id"))}
    over = F.when(F.coalesce(k, F.lit(0)) == 0, F.col("least_above")).otherwise(F.col("least"))
    return chain.select(F.col("least").alias("conv_id"), (F.col("depth") + F.coalesce(k + 1, F.lit(0))).cast("int").alias("depth"), over.alias("parent_conv_id"), *[v.alias(name) for name, v in figures.items()])


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    members = C.cut(rebuilt(C.cut(turn_paths(rows))))
    nodes = trie(members)
    named = ends(members.select(path_id(F.col("path")).alias("path_id"), "conv_id"))
    out = nodes.join(named, "path_id", "left")
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


OP12_SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), moved AS (
  SELECT c.conv_id, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos < c.h
  UNION ALL
  SELECT c.conv_id, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h
), paths AS (
  SELECT conv_id, coalesce(list(length(role)::VARCHAR || ':' || role || sha256(text) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS path,
    coalesce(list(length(text) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS sizes
  FROM convs LEFT JOIN moved USING (conv_id) GROUP BY conv_id
), prefixes AS (
  SELECT conv_id, path, len(path) AS n, d, sha256(array_to_string(path[1:d], '|')) AS node,
    CASE WHEN d > 0 THEN sha256(array_to_string(path[1:d - 1], '|')) END AS over, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size
  FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM paths)
), nodes AS (
  SELECT d, node, any_value(over) AS over, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY d, node
), counted AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN (SELECT d - 1 AS d, over AS node, count(*) AS n FROM nodes GROUP BY ALL) c USING (d, node)
), above AS (
  SELECT u.d, u.node, x.saved, (x.n_children = 0)::INT AS leaf
  FROM counted x JOIN prefixes p ON p.conv_id = x.conv_id AND p.d = x.d JOIN prefixes u ON u.conv_id = x.conv_id AND u.d <= x.d
), summed AS (
  SELECT d, node, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM above GROUP BY d, node
)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM counted n JOIN summed s USING (d, node) LEFT JOIN nodes p ON p.d = n.d - 1 AND p.node = n.over
"""
