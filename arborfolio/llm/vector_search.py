"""Exact top-k search by inner product over KD-trees, one tree for each shard of the vectors.

Shards are the leaves of a few upper tree levels, median splits that are fitted on a bounded sample (SAMPLE vectors of a
length); every vector is then dealt to its leaf, and a leaf that has more than shard_rows of them, equal ones perhaps, to
several shards by a hash of the ids. A shard's tree splits at the median of the widest coordinate and keeps for every node
the tight bounding box of its rows and their smallest id. A query walks a tree best-first: the node whose box allows the
largest inner product is next; the walk ends when no node can beat the k-th result so far. A query's first shard is its
own; with its k-th result it goes, in blocks of queries, to those other shards whose boxes can beat that result.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows with
a null id; vectors are compared with those of their own length. A row never finds rows with its own id. Ties go to the
smaller id; repeated rows are separate candidates; of several query rows with one id the smallest vector asks. Fewer
than k candidates give fewer rows; an empty table gives none. Scores beyond 64 bits are held at their ends. Only the named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborfolio.llm.shared import discard, keep

LEAF = 256
#: Vectors of a length that the upper levels are fitted on, about; queries of a block; bytes of boxes that the driver and a
#: task hold at most (beyond that, boxes of groups of shards come before those of shards).
SAMPLE, BLOCK, BOX_BYTES = 20_000, 256, 64 << 20
#: Whole numbers up to here are exact as doubles.
EXACT = float(1 << 53)


class KdTree:
    """Rows (ids, vectors of whole numbers as doubles) of one shard."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.order = np.argsort(ids, kind="stable")
        nodes: list[tuple[int, int, int]] = []  # from, to, first child or -1
        lows, highs, least = [], [], []
        nodes.append((0, len(ids), -1))
        at = 0
        while at < len(nodes):
            a, b, _ = nodes[at]
            part = rows[self.order[a:b]]
            low, high = part.min(0), part.max(0)
            lows.append(low)
            highs.append(high)
            least.append(int(ids[self.order[a:b]].min()))
            if b - a > LEAF:
                d = int(np.argmax(high - low))
                self.order[a:b] = self.order[a:b][np.argsort(part[:, d], kind="stable")]
                mid = (a + b) // 2
                nodes[at] = (a, b, len(nodes))
                nodes += [(a, mid, -1), (mid, b, -1)]
            at += 1
        self.nodes, self.low, self.high, self.least = nodes, np.array(lows), np.array(highs), least
        self.ids, self.rows = ids[self.order], np.ascontiguousarray(rows[self.order])
        self.reach = np.maximum(np.abs(self.low[0]), np.abs(self.high[0]))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Of each query and node the largest inner product that the box allows."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, k: int, cut: tuple[float, int] | None) -> list[tuple[int, int]]:
        """Up to k (score, id) that beat cut, the (score, id) of a k-th result known from elsewhere."""
        exact = float(np.abs(query) @ self.reach) < EXACT
        best: list[tuple[float, int]] = []  # a heap of (score, -id); the worst is first
        limit = (cut[0], -cut[1]) if cut else (-np.inf, 0)
        heap = [(-bounds[0], self.least[0], 0)]
        while heap:
            bound, least, node = heapq.heappop(heap)
            if exact and (-bound, -least) < limit:
                break
            a, b, child = self.nodes[node]
            if child >= 0:
                for c in (child, child + 1):
                    if not exact or (bounds[c], -self.least[c]) >= limit:
                        heapq.heappush(heap, (-bounds[c], self.least[c], c))
                continue
            if exact:
                scores = self.rows[a:b] @ query
                close = np.flatnonzero(scores >= limit[0])
                found = zip(scores[close].tolist(), self.ids[a:b][close].tolist(), strict=True)
            else:  # beyond doubles: whole numbers of any size
                q = [int(x) for x in query]
                found = ((sum(x * int(y) for x, y in zip(q, r, strict=True)), int(i)) for r, i in zip(self.rows[a:b], self.ids[a:b], strict=True))
            for score, i in found:
                if i == own or (score, -i) < limit:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (score, -i))
                elif (score, -i) > best[0]:
                    heapq.heapreplace(best, (score, -i))
                if len(best) == k:
                    limit = max(limit, best[0])
        return [(min(max(int(s), -(1 << 63)), (1 << 63) - 1), -i) for s, i in best]


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as doubles; null if the vector takes no part."""
    bad = vector.isNull() | (F.size(vector) < 1) | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")))


@dataclass(frozen=True)
class Levels:
    """The upper levels of a tree: inner nodes with a coordinate, a border and two children; leaves have numbers."""

    axis: np.ndarray
    border: np.ndarray
    low: np.ndarray  # the child of rows up to the border; -1 less a leaf's number is that leaf
    high: np.ndarray

    @classmethod
    def fit(cls, rows: np.ndarray, leaves: int) -> Levels:
        nodes: list[list] = []
        made = 0

        def grow(part: np.ndarray, want: int) -> int:
            nonlocal made
            spread = part.max(0) - part.min(0) if len(part) else np.zeros(1)
            axis = int(np.argmax(spread))
            if want < 2 or len(part) < 2 or spread[axis] <= 0:
                made += 1
                return -made
            column = part[:, axis]
            border = float(np.median(column))
            border = border if (column > border).any() else float(column[column < column.max()].max())
            at = len(nodes)
            nodes.append([axis, border, 0, 0])
            nodes[at][2] = grow(part[column <= border], want // 2)
            nodes[at][3] = grow(part[column > border], want - want // 2)
            return at

        grow(rows, leaves)
        table = np.array(nodes, float).reshape(-1, 4)
        return cls(table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64))

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), np.int64) if len(self.axis) else np.full(len(rows), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            at[inner] = np.where(rows[inner, self.axis[node]] <= self.border[node], self.low[node], self.high[node])
        return -1 - at


def by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of a batch's rows with vectors of the same length, and these vectors."""
    lists = batch.column(column)
    sizes = pc.list_value_length(lists).to_numpy()
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, flat[(ends[at] - size)[:, None] + np.arange(size)]


def _search(part: DataFrame, k: int) -> DataFrame:
    """part: shard, kind, id, v, ids, cut_scores, cut_ids; the rows of a shard are together, in the order of kinds. Kind 0: a
    vector; 1: a block of queries, their vectors one behind the other in v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, ids, rows = None, None, [], []
        for batch in batches:
            shards, kinds = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            a = 0
            while a < len(shards):
                b = a
                while b < len(shards) and shards[b] == shards[a] and kinds[b] == kinds[a]:
                    b += 1
                if shards[a] != shard:
                    shard, tree, ids, rows = shards[a], None, [], []
                if kinds[a] == 0:
                    ids.append(batch.column(2)[a:b].to_numpy())
                    rows.append(batch.column(3).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1))
                elif rows:
                    if tree is None:
                        tree, rows = KdTree(np.concatenate(ids), np.concatenate(rows)), [None]
                    for r in range(a, b):
                        own, scores, cuts = (batch.column(c)[r].as_py() for c in (4, 5, 6))
                        v = batch.column(3)[r].values.to_numpy(zero_copy_only=False).reshape(len(own), -1)
                        bounds = tree.bounds(v)
                        out = [(own[i], *x) for i in range(len(own)) for x in tree.search(v[i], own[i], bounds[i], k, None if scores[i] is None else (scores[i], cuts[i]))]
                        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["query_id", "vec_id", "score"])
                a = b

    return part.mapInArrow(run, "query_id long, vec_id long, score long")


def _levels(rows: DataFrame, shard_rows: int) -> tuple[dict[int, Levels], int]:
    """rows: id, v. The upper levels for each length that has more than shard_rows vectors, and how many vectors the other
    lengths have. A length is on the driver only if it has so many."""
    counts = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"))
    few = counts.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("n") <= shard_rows, F.col("n"))).alias("few")).first()
    found = {}
    for r in counts.filter(F.col("n") > shard_rows).collect():
        share = int(min(1.0, SAMPLE / r.n) * (1 << 31))
        some = rows.filter((F.size("v") == r["size"]) & (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 31)) < share)).select("v").toArrow().column(0).combine_chunks()
        found[r["size"]] = Levels.fit(some.flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1), -(-r.n // shard_rows))
    return found, int(few.few or 0)


BOX = "shard long, low array<double>, high array<double>, least long"


def _boxes(base: DataFrame) -> DataFrame:
    """Rows shard, low, high, least: of each shard and length the bounds of its vectors and the smallest id."""

    def rows_of(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in held], pa.int64()), *(pa.array([x[c].tolist() for x in held.values()], pa.list_(pa.float64())) for c in (0, 1)), pa.array([x[2] for x in held.values()], pa.int64())], names=["shard", "low", "high", "least"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            shards, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, v in by_length(batch, 2):
                order = np.argsort(shards[at], kind="stable")
                begin = np.flatnonzero(np.append(True, np.diff(shards[at][order]) != 0))
                low, high, least = np.minimum.reduceat(v[order], begin), np.maximum.reduceat(v[order], begin), np.minimum.reduceat(ids[at][order], begin)
                for i, s in enumerate(shards[at][order][begin].tolist()):
                    key = (s, v.shape[1])
                    held[key] = [np.minimum(held[key][0], low[i]), np.maximum(held[key][1], high[i]), min(held[key][2], int(least[i]))] if key in held else [low[i], high[i], int(least[i])]
            if sum(16 * size for _, size in held) > BOX_BYTES:
                yield rows_of(held)
                held = {}
        yield rows_of(held)

    # a row per shard and task
    return _united(base.select("shard", "id", "v").mapInArrow(part, BOX))


def _united(boxes: DataFrame) -> DataFrame:
    """The boxes that hold all boxes of a shard, by length. Two boxes are united at a time."""

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = rows["low"].iloc[0], rows["high"].iloc[0]
        for a, b in zip(rows["low"], rows["high"], strict=True):
            low, high = np.minimum(low, a), np.maximum(high, b)
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "low": [low.tolist()], "high": [high.tolist()], "least": [rows["least"].min()]})

    return boxes.groupBy("shard", F.size("low")).applyInPandas(whole, BOX)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 20_000, scale: int = 256) -> DataFrame:
    """Rows query_id, rank, vec_id, score: the k best of all other rows for every row that is_query picks.

    shard_rows: about so many vectors make a shard, which one task holds. Queries are never gathered.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), whole_numbers(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    levels, rest = _levels(rows.select("id", "v"), shard_rows)
    shipped = spark.sparkContext.broadcast(levels)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = np.full(batch.num_rows, -1, np.int64)
            for at, v in by_length(batch, 1):
                if v.shape[1] in shipped.value:
                    leaf[at] = shipped.value[v.shape[1]].leaf_of(v)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["id", "v", "asks", "leaf"])

    dealt, path = keep(rows.mapInArrow(deal, "id long, v array<double>, asks boolean, leaf long"), "vectors")
    # shards are numbered: a leaf's from `first` on, behind them those that the lengths of few vectors share
    table, total = [], 0
    for r in sorted(dealt.filter("leaf >= 0").groupBy(F.size("v").alias("size"), "leaf").agg(F.count("*").alias("n")).collect(), key=lambda r: (r["size"], r.leaf)):
        table.append((r["size"], r.leaf, total, -(-r.n // shard_rows)))
        total += table[-1][3]
    shared = -(-rest // shard_rows)
    count = max(1, total + shared)
    leaves = F.broadcast(spark.createDataFrame(table, "size int, leaf long, first long, parts long"))
    base = dealt.join(leaves, (F.size("v") == leaves["size"]) & (dealt["leaf"] == leaves["leaf"]), "left")
    # a shard of several lengths has a tree for each: -1 less the length tells them apart from the numbered ones
    number = F.when(F.col("first").isNotNull(), F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(-1 - F.size("v"))
    base = base.select(number.alias("shard"), "id", "v", "asks")
    place = F.when(F.col("shard") >= 0, F.col("shard")).otherwise(total + F.pmod(-F.col("shard"), F.lit(max(1, shared)))).cast("int")
    asks = base.filter("asks").groupBy("id", F.size("v").alias("size")).agg(F.min(F.struct("v", "shard")).alias("x"))
    asks = asks.groupBy("id").agg(F.min("x").alias("x")).select("id", "x.v", "x.shard")
    asks, path1 = keep(asks, "queries")
    none = F.lit(None)
    members = base.select("shard", F.lit(0).alias("kind"), "id", "v", none.cast("array<long>").alias("ids"), none.cast("array<long>").alias("cut_scores"), none.cast("array<long>").alias("cut_ids"))

    def searched(blocks: DataFrame) -> DataFrame:
        both = members.unionByName(blocks.select("shard", F.lit(1).alias("kind"), none.cast("long").alias("id"), "v", "ids", "cut_scores", "cut_ids"))
        return _search(both.repartitionById(count, place).sortWithinPartitions("shard", "kind", "id"), k)

    unknown = F.array(none.cast("long"))
    first, path2 = keep(searched(asks.select("shard", "v", F.array("id").alias("ids"), unknown.alias("cut_scores"), unknown.alias("cut_ids"))), "home-results")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if total > 1:
        kth = first.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.col("score"), (-F.col("vec_id")).alias("minus"))), asc=False).alias("best")).filter(F.size("best") >= k).select(F.col("query_id").alias("id"), F.col("best")[k - 1]["score"].alias("cut_score"), (-F.col("best")[k - 1]["minus"]).alias("cut_id"))
        away = asks.filter("shard >= 0").join(kth, "id", "left").select("id", "v", "shard", "cut_score", "cut_id")
        first = first.unionByName(searched(_sent(away, base.filter("shard >= 0"))))
    out, _ = keep(first.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top-k")
    discard(spark, path, path1, path2)
    return out


def _may_beat(v: np.ndarray, scores: pa.Array, cuts: pa.Array, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which boxes may hold a vector that beats a query's k-th result: queries by boxes."""
    bounds = np.maximum(v, 0) @ high.T + np.minimum(v, 0) @ low.T
    cut = scores.fill_null(0).to_numpy().astype(float)[:, None]
    beats = (bounds > cut) | (bounds == cut) & (least[None, :] < cuts.fill_null(0).to_numpy()[:, None])
    # bounds of whole numbers are exact up to EXACT
    reach = np.abs(v) @ np.maximum(np.abs(low).max(0), np.abs(high).max(0))
    return beats | scores.is_null().to_numpy(zero_copy_only=False)[:, None] | (reach >= EXACT)[:, None]


ASKED = "v array<double>, ids array<long>, own array<long>, cut_scores array<long>, cut_ids array<long>"


def _blocks(wanted: np.ndarray, shards: np.ndarray, v: np.ndarray, columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    """A row per box that is wanted by a query, with the queries that want it; columns: ids, own, cut_scores, cut_ids."""
    for s in np.flatnonzero(wanted.any(0)).tolist():
        rows = np.flatnonzero(wanted[:, s])
        pick = pa.array(rows)
        yield pa.RecordBatch.from_arrays([pa.array([int(shards[s])]), pa.array([v[rows].ravel()], pa.list_(pa.float64())), *(pa.array([x.take(pick).to_pylist()], pa.list_(pa.int64())) for x in columns)], names=["shard", "v", "ids", "own", "cut_scores", "cut_ids"])


def _by_size(rows: list) -> dict[int, tuple]:
    """Boxes by length: shards, low, high, least."""
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r[0]):
        out.setdefault(len(r[1]), []).append(tuple(r))
    return {size: (np.array([x[0] for x in found]), *(np.array([x[c] for x in found]) for c in (1, 2)), np.array([x[3] for x in found])) for size, found in out.items()}


def _to_boxes(queries: DataFrame, boxes: list, skip_own: bool) -> DataFrame:
    """queries: id, v, shard, cut_score, cut_id. Blocks of queries for the boxes that may beat their k-th result."""
    shipped = queries.sparkSession.sparkContext.broadcast(_by_size(boxes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                for at, v in by_length(batch, 1):
                    if v.shape[1] not in shipped.value:
                        continue
                    shards, low, high, least = shipped.value[v.shape[1]]
                    columns = [batch.column(c).take(pa.array(at)) for c in (0, 2, 3, 4)]
                    wanted = _may_beat(v, columns[2], columns[3], low, high, least)
                    if skip_own:
                        wanted &= shards[None, :] != columns[1].to_numpy()[:, None]
                    yield from _blocks(wanted, shards, v, columns)

    return queries.mapInArrow(run, f"shard long, {ASKED}")


#: Tasks that a group of boxes has; its queries are dealt out to them, its boxes go to each.
SALTS = 8


def _sent(queries: DataFrame, base: DataFrame) -> DataFrame:
    """queries: id, v, shard, cut_score, cut_id. Blocks of queries for the shards, but for a query's own, that can beat its
    k-th result: shard, v, ids, cut_scores, cut_ids.

    The driver holds BOX_BYTES of boxes at most. Where the shards have more, neighbours in the tree's order share a box on
    the driver; a group of shards that a query may find better vectors in opens its own boxes in a task."""
    boxes, path = keep(_boxes(base), "boxes")
    size = boxes.agg(F.sum(16 * F.size("low")).alias("bytes"), F.max("shard").alias("last")).first()
    each = -(-(size.bytes or 0) // BOX_BYTES)
    out = ["shard", "v", "ids", "cut_scores", "cut_ids"]
    if each <= 1:
        found = boxes.collect()
        discard(queries.sparkSession, path)
        return _to_boxes(queries, found, True).select(out)
    upper = _united(boxes.withColumn("shard", F.floor(F.col("shard") / each)))
    asked = _to_boxes(queries, upper.collect(), False)
    none = lambda kind: F.lit(None).cast(kind)
    held = boxes.select(F.floor(F.col("shard") / each).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")).alias("salt"), F.lit(0).alias("kind"), "shard", "low", "high", "least", *(none(x.split()[1]).alias(x.split()[0]) for x in ASKED.split(", ")))
    blocks = asked.select(F.col("shard").alias("group"), F.pmod(F.xxhash64("ids"), F.lit(SALTS)).alias("salt"), F.lit(1).alias("kind"), none("long").alias("shard"), none("array<double>").alias("low"), none("array<double>").alias("high"), none("long").alias("least"), "v", "ids", "own", "cut_scores", "cut_ids")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine, by_size = None, [], {}
        for batch in batches:
            for i, (group, salt, kind) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2)), strict=True)):
                if (group, salt) != now:
                    now, mine, by_size = (group, salt), [], {}
                if kind == 0:
                    mine.append([batch.column(c)[i].as_py() for c in (3, 4, 5, 6)])
                    continue
                by_size = by_size or _by_size(mine)
                ids, own, scores, cuts = (batch.column(c)[i].values for c in (8, 9, 10, 11))
                v = batch.column(7)[i].values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                if v.shape[1] in by_size:
                    shards, low, high, least = by_size[v.shape[1]]
                    wanted = _may_beat(v, scores, cuts, low, high, least) & (shards[None, :] != own.to_numpy()[:, None])
                    yield from _blocks(wanted, shards, v, [ids, own, scores, cuts])

    both = held.unionByName(blocks).repartition("group", "salt").sortWithinPartitions("group", "salt", "kind")
    return both.mapInArrow(opened, f"shard long, {ASKED}").select(out)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 50 == 0)
