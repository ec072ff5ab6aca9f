"""Density clusters of vectors: mutual reachability by cosine distance, its spanning tree, a condensed
tree, and the clusters of greatest excess of mass. Points of no dense region are noise.

The tree of a scope with at most ``MOST`` points is made in one task. Larger scopes are cut into
blocks: first each point's nearest neighbour is found over all pairs of blocks, then each pair of
blocks makes its spanning tree, and these are merged. An edge that is longest on a cycle of a pair is
so in the whole too, so the merged tree is one of all points, whatever the blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.runtime import durable
from corvane.schema import CLUSTER_MAX, CLUSTER_MIN, LANGUAGE_SHARE, QUOTES

#: Points whose tree is made at once (the matrix of distances takes 8 bytes for each pair), and forests
#: that are merged at once.
MOST, MERGED = 8000, 8


def spanning_tree(x: np.ndarray, neighbours: int = 1) -> np.ndarray:
    """Edges (a, b, distance) of the least spanning tree of mutual reachability, in order of length."""
    n = len(x)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    away = 1.0 - np.clip(unit @ unit.T, -1.0, 1.0)
    np.fill_diagonal(away, 0.0)
    core = np.partition(away, min(neighbours, n - 1), axis=1)[:, min(neighbours, n - 1)]
    away = np.maximum(np.maximum(away, core[:, None]), core[None, :])
    inside = np.zeros(n, bool)
    best, via = np.full(n, np.inf), np.zeros(n, int)
    at, edges = 0, []
    for _ in range(n - 1):
        inside[at] = True
        nearer = ~inside & (away[at] < best)
        best[nearer], via[nearer] = away[at][nearer], at
        masked = np.where(inside, np.inf, best)
        at = int(masked.argmin())
        edges.append((via[at], at, masked[at]))
    return np.array(sorted(edges, key=lambda e: e[2])) if edges else np.empty((0, 3))


def _unit(rows: pd.DataFrame) -> np.ndarray:
    x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def nearest(x: np.ndarray, y: np.ndarray, same: bool, step: int = 256) -> np.ndarray:
    """Distance from each row of ``x`` to the nearest of ``y``; ``same`` if both are one block, where
    no row is its own neighbour."""
    out = np.full(len(x), np.inf)
    for k in range(0, len(x), step):
        away = 1.0 - np.clip(x[k : k + step] @ y.T, -1.0, 1.0)
        if same:
            away[np.arange(len(away)), np.arange(k, k + len(away))] = np.inf
        out[k : k + step] = away.min(axis=1, initial=np.inf)
    return out


def tree_of(x: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Edges (a, b, distance) of the spanning tree of unit vectors whose core distances are known; no
    matrix is held."""
    n = len(x)
    inside = np.zeros(n, bool)
    best, via = np.full(n, np.inf), np.zeros(n, int)
    at, edges = 0, []
    for _ in range(n - 1):
        inside[at] = True
        away = np.maximum(np.maximum(1.0 - np.clip(x @ x[at], -1.0, 1.0), core), core[at])
        nearer = ~inside & (away < best)
        best[nearer], via[nearer] = away[nearer], at
        masked = np.where(inside, np.inf, best)
        at = int(masked.argmin())
        edges.append((via[at], at, masked[at]))
    return np.array(edges) if edges else np.empty((0, 3))


def forest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the edges that a least spanning forest of these edges has, in order of length."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    ends = ends.reshape(2, -1).tolist()
    parent, kept = list(range(len(names))), []
    for k in np.lexsort((b, a, d)).tolist():
        p, q = ends[0][k], ends[1][k]
        while parent[p] != p:
            parent[p] = p = parent[parent[p]]
        while parent[q] != q:
            parent[q] = q = parent[parent[q]]
        if p != q:
            parent[q] = p
            kept.append(k)
    return np.array(kept, int)


def labels_of(x: np.ndarray, least: int = CLUSTER_MIN, neighbours: int = 1) -> np.ndarray:
    """The cluster of each row, from 0 in order of first members; -1 for noise. The whole is never
    one cluster."""
    return labels_from(len(x), spanning_tree(x, neighbours) if len(x) >= max(2, least) else np.empty((0, 3)), least)


def labels_from(n: int, edges: np.ndarray, least: int = CLUSTER_MIN) -> np.ndarray:
    """The clusters as ``labels_of`` gives them, of ``n`` points whose spanning tree has ``edges``, in
    order of length."""
    out = np.full(n, -1)
    if n < max(2, least):
        return out
    parent, size = list(range(2 * n - 1)), [1] * n + [0] * (n - 1)
    children: list[tuple[int, int, float]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b, d in edges:
        p, q = root(int(a)), root(int(b))
        new = n + len(children)
        parent[p] = parent[q] = new
        size[new] = size[p] + size[q]
        children.append((p, q, float(d)))

    # Condensed clusters: the one a node belongs to, when it was born, its excess and its children.
    born, excess, below, nodes = [0.0], [0.0], [[]], [[2 * n - 2]]
    members: list[list[int]] = [[]]
    stack = [(2 * n - 2, 0)]

    def leaves(node: int) -> list[int]:
        found, todo = [], [node]
        while todo:
            i = todo.pop()
            if i < n:
                found.append(i)
            else:
                todo += children[i - n][:2]
        return found

    while stack:
        node, cluster = stack.pop()
        if node < n:
            members[cluster].append(node)
            continue
        a, b, d = children[node - n]
        density = 1.0 / d if d > 0 else 1e12
        if size[a] >= least and size[b] >= least:
            for child in (a, b):
                excess[cluster] += size[child] * (density - born[cluster])
                born.append(density)
                excess.append(0.0)
                below.append([])
                nodes.append([child])
                members.append([])
                below[cluster].append(len(born) - 1)
                stack.append((child, len(born) - 1))
        else:
            for child in (a, b):
                if size[child] >= least:
                    stack.append((child, cluster))
                else:
                    gone = leaves(child)
                    excess[cluster] += len(gone) * (density - born[cluster])
                    members[cluster] += gone
    chosen = [False] * len(born)
    total = list(excess)
    for c in range(len(born) - 1, 0, -1):
        inner = sum(total[k] for k in below[c])
        chosen[c] = excess[c] >= inner
        total[c] = max(excess[c], inner)
    picked, todo = [], list(below[0])
    while todo:
        c = todo.pop()
        if chosen[c]:
            picked.append(c)
        else:
            todo += below[c]
    for c in picked:
        held, todo = [], [c]
        while todo:
            k = todo.pop()
            held += members[k]
            todo += below[k]
        out[held] = c
    order = {c: k for k, c in enumerate(sorted({c for c in out if c >= 0}, key=lambda c: int(np.flatnonzero(out == c)[0])))}
    return np.array([order.get(c, -1) for c in out])


def _trees(points: DataFrame, scope: str, kind: str, blocks: int) -> DataFrame:
    """scope, a, b and d, the edges of each scope's spanning tree among few more. ``points``: scope,
    _at (a number of its own), _block (of ``_blocks`` of its scope, at most ``blocks``), embedding."""
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    met = lambda df: df.select("*", other).withColumns({"_i": F.least("_block", "_other"), "_j": F.greatest("_block", "_other")}).drop("_blocks", "_other")

    def cores(rows: pd.DataFrame) -> pd.DataFrame:
        first = (rows["_block"] == rows["_i"]).to_numpy()
        x, own = _unit(rows), rows["_i"].iloc[0] == rows["_j"].iloc[0]
        core = np.full(len(x), np.inf)
        if own:
            core = nearest(x, x, True)
        else:
            core[first], core[~first] = nearest(x[first], x[~first], False), nearest(x[~first], x[first], False)
        return pd.DataFrame({"_at": rows["_at"], "_core": core})

    core = met(points).groupBy(scope, "_i", "_j").applyInPandas(cores, "_at long, _core double").groupBy("_at").agg(F.min("_core").alias("_core"))
    points = durable(points.join(core, "_at"), "cores")

    def trees(rows: pd.DataFrame) -> pd.DataFrame:
        edges, at = tree_of(_unit(rows), rows["_core"].to_numpy()), rows["_at"].to_numpy()
        ends = edges[:, :2].astype(int)
        return pd.DataFrame({scope: rows[scope].iloc[0], "_i": rows["_i"].iloc[0], "a": at[ends.min(axis=1)], "b": at[ends.max(axis=1)], "d": edges[:, 2]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.iloc[forest(rows["a"].to_numpy(), rows["b"].to_numpy(), rows["d"].to_numpy())]

    ddl = f"{scope} {kind}, _i int, a long, b long, d double"
    edges = met(points).filter("_i < _j").groupBy(scope, "_i", "_j").applyInPandas(trees, ddl).groupBy(scope, "_i").applyInPandas(merge, ddl)
    while blocks > MERGED:
        edges = edges.withColumn("_i", F.floor(F.col("_i") / MERGED).cast("int")).groupBy(scope, "_i").applyInPandas(merge, ddl)
        blocks = -(-blocks // MERGED)
    return edges.drop("_i")


def clusters(points: DataFrame, scope: str = "scope", least: int = CLUSTER_MIN, most: int = CLUSTER_MAX, at_once: int = MOST) -> DataFrame:
    """scope, cluster_id and chunk_id of the members of clusters; clusters with over ``most`` members
    and noise are left out. ``points``: scope, chunk_id, embedding. Cluster ids are numbers within a
    scope."""
    kind = points.schema[scope].dataType.simpleString()
    ddl = f"{scope} {kind}, cluster_id long, chunk_id long"
    sizes = points.groupBy(scope).agg(F.count("*").alias("_n"))
    points = points.select(scope, "chunk_id", "embedding").join(sizes, scope)

    def kept(rows: pd.DataFrame, found: np.ndarray) -> pd.DataFrame:
        counts = pd.Series(found).value_counts()
        keep = np.array([c >= 0 and counts[c] <= most for c in found], bool)
        return pd.DataFrame({scope: rows[scope][keep], "cluster_id": found[keep].astype(np.int64), "chunk_id": rows["chunk_id"][keep]})

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk_id")
        return kept(rows, labels_of(np.stack(rows["embedding"].to_numpy()).astype(np.float64), least))

    small = points.filter(F.col("_n") <= at_once).drop("_n").groupBy(scope).applyInPandas(run, ddl)
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    if largest <= at_once:
        return small
    # Two blocks together have about at_once points.
    blocks = F.ceil(2 * F.col("_n") / at_once).cast("int")
    large = points.filter(F.col("_n") > at_once).withColumns({"_blocks": blocks, "_at": F.monotonically_increasing_id()}).drop("_n")
    large = durable(large.withColumn("_block", F.pmod(F.xxhash64("_at"), F.col("_blocks")).cast("int")), "points")
    edges = _trees(large.drop("chunk_id"), scope, kind, -(-2 * largest // at_once))

    def label(rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk_id")
        place = pd.Series(np.arange(len(rows)), index=rows["_at"].to_numpy())
        a, b, d = place.loc[edges["a"]].to_numpy(), place.loc[edges["b"]].to_numpy(), edges["d"].to_numpy()
        tree = forest(a, b, d)
        return kept(rows, labels_from(len(rows), np.column_stack([a, b, d])[tree], least))

    found = large.select(scope, "_at", "chunk_id").groupBy(scope).cogroup(edges.groupBy(scope)).applyInPandas(label, ddl)
    return small.unionByName(found)


def cluster_facts(members: DataFrame, chunks: DataFrame, artifacts: DataFrame, scope: str = "scope", share: float = LANGUAGE_SHARE) -> DataFrame:
    """Of each cluster: its signature, size, language (of at least ``share`` of members that have one;
    ties by the first member), repositories and URLs, and the texts of its first members."""
    rows = members.join(chunks.select(F.col("id").alias("chunk_id"), "artifact_id", "text", "language"), "chunk_id").join(artifacts.select(F.col("id").alias("artifact_id"), "repo", "source_url"), "artifact_id", "left")
    keys = [scope, "cluster_id"]
    tagged = rows.filter("language is not null").groupBy(*keys, "language").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first"))
    top = tagged.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("first")).alias("o"), "language")).alias("t"), F.sum("n").alias("all"))
    language = top.select(*keys, F.when(F.col("t.n") >= share * F.col("all"), F.col("t.language")).alias("language"))
    ids = F.array_sort(F.collect_list("chunk_id"))
    facts = rows.groupBy(*keys).agg(
        F.concat(F.lit("rule-"), F.substring(F.sha1(F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")), 1, 16)).alias("external_id"),
        F.count("*").alias("cluster_size"),
        ids.alias("member_chunk_ids"),
        F.array_sort(F.collect_set("repo")).alias("member_repos"),
        F.array_sort(F.collect_set("source_url")).alias("member_urls"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), 1, QUOTES), lambda s: s["text"]).alias("quotes"),
    )
    return facts.join(language, keys, "left")


def extractive_rules(points: DataFrame, members: DataFrame, facts: DataFrame, chunks: DataFrame, scope: str = "scope") -> DataFrame:
    """A rule for each cluster: the text of the member nearest to the middle; ``facts`` with ``rule``."""
    keys = [scope, "cluster_id"]
    unit = lambda v: F.transform(v, lambda x: x.cast("double") / F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double"))), F.lit(1e-12)))
    rows = members.join(points.select("chunk_id", unit(F.col("embedding")).alias("v")), "chunk_id")
    middle = rows.select(*keys, F.posexplode("v").alias("k", "x")).groupBy(*keys, "k").agg(F.avg("x").alias("m"))
    middle = middle.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("mid"))
    near = rows.join(middle, keys).withColumn("s", F.aggregate(F.zip_with("v", "mid", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    best = near.groupBy(*keys).agg(F.max(F.struct(F.round("s", 9).alias("s"), (-F.col("chunk_id")).alias("o"))).alias("b")).select(*keys, (-F.col("b.o")).alias("chunk_id"))
    return facts.join(best, keys).join(chunks.select(F.col("id").alias("chunk_id"), F.col("text").alias("rule")), "chunk_id").drop("chunk_id")
