"""Spanning trees and their centrality from edge rows, for graphs whose matrices don't fit one task.

The tree grows by rounds over all graphs at once: every component takes its least edge in the order (distance, i, j), which
are shuffled sums of edge rows; components are merged by label, a row per component; of the edges between two components the
least is kept. Each round halves the components at least. Centrality is the tree's largest eigenvector, by messages from the
leaves to the root and back over a row per edge: no matrix is built.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborfolio.config import EPSILON, BacktestConfig, CalculationError, make_config
from arborfolio.operators.network import weights_of
from arborfolio.sources.lineage import dropped, written


def spanning_edges(pairs: DataFrame, key: str = "month", weighting: str = "correlation_distance") -> DataFrame:
    """pairs: key, i, j (i < j), distance of all pairs of each graph. Rows key, i, j, distance of each graph's minimum spanning
    tree. A graph that isn't connected is an error, as is an edge without length where lengths are weights."""
    spark = pairs.sparkSession
    edge = F.struct("distance", "i", "j")
    live, path = written(pairs.filter("distance is not null").select(key, F.col("i").alias("a"), F.col("j").alias("b"), edge.alias("e")), "tree-edges")
    paths, chosen, kind = [path], [], pairs.schema[key].dataType.simpleString()

    def merged(links: pd.DataFrame) -> pd.DataFrame:
        """The least label of each component's new component; a row per component."""
        above: dict[str, str] = {}

        def top(x: str) -> str:
            while above.get(x, x) != x:
                above[x] = above.get(above[x], above[x])
                x = above[x]
            return x

        for a, b in zip(links["a"], links["b"], strict=True):
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
        names = pd.unique(pd.concat([links["a"], links["b"]]))
        return pd.DataFrame({key: links[key].iloc[0], "old": names, "new": [top(x) for x in names]})

    while live.limit(1).count():
        ends = live.select(key, F.col("a").alias("c"), "e", "a", "b").unionByName(live.select(key, F.col("b").alias("c"), "e", "a", "b"))
        least = ends.groupBy(key, "c").agg(F.min(F.struct("e", "a", "b")).alias("x")).select(key, "x.*").distinct()
        least, path = written(least, "tree-round")
        labels, also = written(least.groupBy(key).applyInPandas(merged, f"{key} {kind}, old string, new string"), "tree-labels")
        chosen.append(least)
        a, b = labels.select(key, F.col("old").alias("a"), F.col("new").alias("na")), labels.select(key, F.col("old").alias("b"), F.col("new").alias("nb"))
        moved = live.join(a, [key, "a"]).join(b, [key, "b"]).filter("na <> nb")
        moved = moved.groupBy(key, F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).agg(F.min("e").alias("e"))
        live, third = written(moved, "tree-edges")
        paths += [path, also, third]
    if not chosen:
        dropped(spark, *paths)
        return pairs.select(key, "i", "j", "distance").limit(0)
    edges = chosen[0]
    for more in chosen[1:]:
        edges = edges.unionByName(more)
    edges, _ = written(edges.select(key, "e.i", "e.j", "e.distance"), "tree")
    nodes = pairs.select(key, F.explode(F.array("i", "j")).alias("n")).distinct().groupBy(key).agg(F.count("*").alias("n"))
    found = nodes.join(edges.groupBy(key).agg(F.count("*").alias("edges")), key, "left").filter(F.coalesce("edges", F.lit(0)) != F.col("n") - 1).limit(1).collect()
    if found:
        raise CalculationError("the tree isn't complete", edges=found[0].edges or 0)
    if weighting == "correlation_distance" and (flat := edges.filter(F.col("distance") <= EPSILON).limit(1).collect()):
        raise CalculationError("an edge of the tree has no length", left=flat[0].i, right=flat[0].j)
    dropped(spark, *paths)
    return edges


def tree_perron(i: np.ndarray, j: np.ndarray, weight: np.ndarray, n: int) -> tuple[float, np.ndarray]:
    """The largest eigenvalue of a tree with n nodes and the given edges, and its positive eigenvector of unit length.

    From the leaves to the root, a node's message is m(v) = x - sum of w(v, c)^2 / m(c) over its children c. All messages are
    positive exactly if x is above the largest eigenvalue, and the root's is zero at it: found by cutting the range of x into
    64 parts at a time. At the eigenvalue a child's entry is its parent's times w / m(child)."""
    degree = np.bincount(np.concatenate([i, j]), minlength=n)
    starts = np.concatenate([[0], np.cumsum(degree)])
    order = np.argsort(np.concatenate([i, j]), kind="stable")
    others, lengths = np.concatenate([j, i])[order], np.concatenate([weight, weight])[order]
    low, high = 0.0, float(np.bincount(np.concatenate([i, j]), np.concatenate([weight, weight]), n).max()) * (1 + 1e-12)
    levels, parent, up = _levels(int(degree.argmax()), starts, degree, others, lengths, n)
    while high - low > 4e-16 * high:
        x = np.linspace(low, high, 65)[1:]
        above = _messages(x, levels, parent, up, n)[1]
        k = int(np.argmax(above)) if above.any() else len(x) - 1
        bounds = (float(x[k - 1]) if k else low, float(x[k]))
        if bounds == (low, high):
            break
        low, high = bounds
    # x little above the eigenvalue: solutions of (x - A) y = b for b = y before turn to the eigenvector; nothing is subtracted
    m = _messages(np.array([high * (1 + 1e-10)]), levels, parent, up, n)[0][:, 0]
    vector = np.full(n, n**-0.5)
    for _ in range(60):
        y = vector.copy()
        for level in reversed(levels[1:]):
            np.add.at(y, parent[level], up[level] * y[level] / m[level])
        y[levels[0]] /= m[levels[0]]
        for level in levels[1:]:
            y[level] = (y[level] + up[level] * y[parent[level]]) / m[level]
        y /= np.linalg.norm(y)
        moved, vector = np.abs(y - vector).max(), y
        if moved < 1e-14:
            break
    if not (high > EPSILON and (vector > 0).all()):
        raise CalculationError("the graph has no positive eigenvector", radius=high)
    return high, vector


def _levels(root: int, starts: np.ndarray, degree: np.ndarray, others: np.ndarray, lengths: np.ndarray, n: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The nodes by their distance from the root, each node's parent and the length of the edge to it."""
    parent, up, levels, level, seen = np.full(n, -1), np.zeros(n), [], np.array([root]), np.zeros(n, bool)
    while len(level):
        levels.append(level)
        seen[level] = True
        counts = degree[level]
        spans = np.repeat(starts[level] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        child, above = others[spans], np.repeat(level, counts)
        new = ~seen[child]
        parent[child[new]], up[child[new]] = above[new], lengths[spans][new]
        level = child[new]
    if not seen.all():
        raise CalculationError("the graph has no positive eigenvector", reached=int(seen.sum()))
    return levels, parent, up


def _messages(x: np.ndarray, levels: list[np.ndarray], parent: np.ndarray, up: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each node's message for each x, and which x are above the largest eigenvalue."""
    m, fine = np.tile(x, (n, 1)), np.ones(len(x), bool)
    for level in reversed(levels[1:]):
        fine &= (m[level] > 0).all(0)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            np.subtract.at(m, parent[level], up[level][:, None] ** 2 / m[level])
    return m, fine & (m[levels[0][0]] > 0)


def tree_weights(edges: DataFrame, key: str = "month", config: BacktestConfig | dict | None = None) -> DataFrame:
    """edges: key, i, j, distance of trees. Rows key, asset, weight, centrality, degree, radius; a group has a row per edge."""
    config = make_config(config)
    kind = edges.schema[key].dataType.simpleString()

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(pd.concat([rows["i"], rows["j"]]), sort=True)
        i, j = codes[: len(rows)], codes[len(rows) :]
        length = rows["distance"].to_numpy(float) if config.adjacency_weighting == "correlation_distance" else np.ones(len(rows))
        radius, centrality = tree_perron(i, j, length, len(names))
        return pd.DataFrame({key: rows[key].iloc[0], "asset": names, "weight": weights_of(centrality, config.weight_normalization), "centrality": centrality, "degree": np.bincount(codes), "radius": radius})

    return edges.groupBy(key).applyInPandas(solve, f"{key} {kind}, asset string, weight double, centrality double, degree long, radius double")


__all__ = ["spanning_edges", "tree_perron", "tree_weights"]
