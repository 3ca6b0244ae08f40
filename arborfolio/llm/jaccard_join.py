"""N-gram Jaccard join by a token-group matrix.

Each document is the set of its distinct word shingles; documents with equal sets are one class, which its smallest id
stands for. Classes are linked when 100 * intersection >= percent * union, and the result names each document's
component of links.

Tokens (shingles) have one order: those that many documents hold come last, the rest by hash. The counts for this are lower
bounds: each task counts in chunks of CHUNK tokens and leaves out a token that a chunk has once. So the order, and with it
the cost, depends on how the documents are dealt out; the links do not, as they are whole in any order. Any two linked
sets share LEAST tokens at least among the first ones of each (the rows of the matrix). Classes are
partitioned into groups of similar ones: each starts alone, and groups grow where a member is verified to link to
the hub of a token, the class that shares most of its rows. The matrix holds each group's token union over these rows.
A query group opens another only if LEAST of its tokens are in the other's union, which bounds the overlap of any of
their members; in opened groups the members that share LEAST tokens and have fitting sizes are verified on their whole
texts. Members of one group need no further comparing, so that a large group of near copies costs a few comparisons each.
A token in the unions of more than CROWD groups (a passage that many documents share) opens nothing: the order puts it
last for the documents that have it, whose first tokens are taken again, until no such token is left or, after EXTENDED
rounds, its groups are opened after all.

Defined results: null and empty texts, and texts of white space, have no shingle and link with nothing; a text with
fewer words than a shingle has its whole sequence as one. Null ids get their shingle count and no component.
Repeated
rows are one class; different texts under one id belong to one component. An empty table gives no rows. Tokens are
64-bit hashes, classes 128-bit hashes of token sets. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborfolio.llm.shared import discard, gives_back, keep, keep_counted, row_slices, small

LEAST = 3
#: Tokens with a place of their own in the order at most (a rarer one's place is its hash).
ORDERED = 500_000
#: Rounds of comparing with hubs before groups are opened.
ROUNDS = 2
#: Groups that a token opens at most before it goes last in the order, and how often that is done.
CROWD, EXTENDED = 16, 3
#: From this level on (tokens of 1024 documents and more) a token's rows are cut into parts of about a thousand; tokens put
#: last, into CUT parts at least.
HOT_LEVEL, CUT = 11, 64
#: Pairs, ids and tokens, of three 64-bit numbers each at most, that are broadcast at most; more are joined by a shuffle.
BROADCAST_PAIRS, BROADCAST_IDS, BROADCAST_TOKENS = 200_000, 1_000_000, 100_000
PIECE, CHUNK = 1 << 20, 1 << 22

_P = 0xD6E8FEB86659FD93
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            steps = np.full(n, np.uint64(base))
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of data, A-Z taken as a-z."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    white = _WHITE[b]
    turns = np.flatnonzero(np.diff(white, prepend=True, append=True))
    starts, ends = turns[::2], turns[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    up, down = _power(len(b))
    sums = np.cumsum(_LOWER[b] * up)
    h = (sums[ends - 1] - np.where(starts > 0, sums[starts - 1], np.uint64(0))) * down[starts]
    return starts, _mix(h + (ends - starts).astype(np.uint64) * _M3)


def _pieces(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and not _WHITE[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def token_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Of each text its distinct shingles as sorted unsigned 64-bit hashes."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    words: list[np.ndarray] = []
    i = 0
    while i < len(raw):
        j, held = i, 0
        while j < len(raw) and (j == i or held + len(raw[j]) < PIECE):
            held += len(raw[j]) + 1
            j += 1
        if held > 2 * PIECE:
            words.append(np.concatenate([_hash_words(p)[1] for p in _pieces(raw[i])]))
        else:
            starts, hashes = _hash_words(b" ".join(raw[i:j]))
            cuts = np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in raw[i:j]]))
            words += [hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        i = j
    out = []
    for h in words:
        n = min(len(h), width)
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        s = h[: len(h) - n + 1] + np.uint64(n)
        for k in range(1, n):
            s = s * _M3 + h[k : len(h) - n + 1 + k]
        s = np.sort(_mix(s))
        out.append(s[np.append(True, s[1:] != s[:-1])])
    return out


def set_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def overlap_needed(n: int, percent: int) -> int:
    """Tokens that a set of n tokens shares with any set that it links to, at least."""
    return -(-percent * n // 100)


def rows_needed(n: int, percent: int, least: int) -> int:
    """The set's first tokens that hold `least` shared ones with any other set that it links to; 0 if it links to none."""
    return 0 if 100 * n < percent * (n + 1) else min(n, n - overlap_needed(n, percent) + least)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def _each(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for whole in batches:
        for batch in row_slices(whole, "text"):
            yield batch, token_sets(batch.column(1).to_pylist(), width)


def describe(docs: DataFrame, width: int) -> DataFrame:
    """docs: id, text. Rows id, n, key for the documents; and token, n for tokens that repeat among the documents of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def often(held: list[np.ndarray]) -> pa.RecordBatch:
            t, c = np.unique(np.concatenate(held), return_counts=True)
            t, c = t[c >= 2], c[c >= 2]
            return pa.RecordBatch.from_arrays([pa.nulls(len(t), pa.int64()), pa.array(c, pa.int64()), pa.nulls(len(t), pa.binary()), pa.array(t.view(np.int64))], names=["id", "n", "key", "token"])

        held, size = [], 0
        for batch, sets in _each(batches, width):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(len(sets), pa.int64())], names=["id", "n", "key", "token"])
            held += sets
            size += sum(map(len, sets))
            if size > CHUNK:
                yield often(held)
                held, size = [], 0
        if held:
            yield often(held)

    return docs.mapInArrow(gives_back(run), "id long, n long, key binary, token long")


Order = tuple[np.ndarray, np.ndarray]


def place(counts: DataFrame, from_level: int) -> Order:
    """counts: token, n. Tokens that many documents hold, sorted, and their levels. A token of level L has n of 2**(L-1) or
    more; from the lowest level that leaves ORDERED tokens at most, so that the table's size has a bound at any input size."""
    counts = counts.withColumn("level", F.floor(F.log2("n")).cast("int") + 1).filter(F.col("level") >= from_level)
    counts, path = keep(counts.select("token", "level"), "token-levels")
    least, total = 0, 0
    for r in sorted(counts.groupBy("level").count().collect(), key=lambda r: -r.level):
        total += r["count"]
        if total > ORDERED:
            least = r.level + 1
            break
    table = counts.filter(F.col("level") >= least).toArrow()
    discard(counts.sparkSession, path)
    tokens = table.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], table.column("level").to_numpy().astype(np.int8)[order]


def demote(order: Order, crowded: Order) -> Order:
    """The order with the crowded tokens behind all others."""
    old = ~np.isin(order[0], crowded[0])
    tokens, levels = np.concatenate([order[0][old], crowded[0]]), np.concatenate([order[1][old], crowded[1] + np.int8(64)])
    at = np.argsort(tokens)
    return tokens[at], levels[at]


def parts_of(level: np.ndarray, hot_level: int) -> np.ndarray:
    """Into how many parts the rows of tokens of these levels are cut."""
    parts = np.left_shift(1, np.clip(level.astype(np.int64) % 64 - hot_level + 1, 0, 40))
    return np.where(level >= 64, np.maximum(parts, CUT), parts)


def first_tokens(docs: DataFrame, width: int, percent: int, order: Order, least: int) -> DataFrame:
    """docs: id, text. Rows id, key, n, tokens: the first ones in the order; parts: into how many each one's rows are cut."""
    shipped, hot_level = docs.sparkSession.sparkContext.broadcast(order), HOT_LEVEL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, levels = shipped.value
        for batch, sets in _each(batches, width):
            need = [rows_needed(len(s), percent, least) for s in sets]
            picked, parts = [], []
            for s, q in zip(sets, need, strict=True):
                level = np.zeros(len(s), np.int8)
                if q and len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    level = np.where(common[at] == s, levels[at], 0)
                    if level.any():
                        by_level = np.argsort(level, kind="stable")
                        s, level = s[by_level], level[by_level]
                picked.append(s[:q])
                parts.append(parts_of(level[:q], hot_level))
            keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.binary())
            offsets = np.append(0, np.cumsum([len(x) for x in picked])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(picked).view(np.int64) if picked else [], pa.int64()))
            cuts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), keys, pa.array([len(s) for s in sets], pa.int64()), lists, cuts], names=["id", "key", "n", "tokens", "parts"]).filter(pa.array(np.array(need) > 0))

    return docs.mapInArrow(gives_back(run), "id long, key binary, n long, tokens array<long>, parts array<long>")


def shared_rows(rows: DataFrame) -> DataFrame:
    """rows: token, id, n, pos (the token's place among the id's tokens), part. Those whose token another id has too, each
    once. Of tokens that are cut (part is not 0), which many documents have, all rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int, int, bool] | None = None  # the row before, and whether it is out
        for batch in batches:
            t, i, n, pos, part = (batch.column(k).to_numpy() for k in range(5))
            if not len(t):
                continue
            out = []
            if last and t[0] == last[0] and i[0] != last[1] and not last[4]:
                out.append(tuple([x] for x in last[:4]))
            before_t, before_i = np.append(last[0] if last else ~t[0], t[:-1]), np.append(last[1] if last else ~i[0], i[:-1])
            fresh = (t != before_t) | (i != before_i)
            held_out = bool(last and last[4])
            follows = (t == before_t)
            t, i, n, pos, part, follows = t[fresh], i[fresh], n[fresh], pos[fresh], part[fresh], follows[fresh]
            if len(t):
                good = follows | (part > 0)
                good[:-1] |= follows[1:]
                out.append((t[good], i[good], n[good], pos[good]))
                last = (int(t[-1]), int(i[-1]), int(n[-1]), int(pos[-1]), bool(good[-1]))
            elif last:
                last = (*last[:4], held_out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.asarray(x[k], np.int64) for x in out])) for k in range(4)], names=["token", "id", "n", "pos"])

    return rows.repartition("token", "part").sortWithinPartitions("token", "id").mapInArrow(gives_back(run), "token long, id long, n long, pos long")


def token_rows(first: DataFrame) -> DataFrame:
    """Rows token, id, n, pos, part: 0, or of a token that is cut a part from 1 on, by a hash of the id."""
    rows = first.select(F.posexplode(F.arrays_zip("tokens", "parts")).alias("pos", "x"), "id", "n")
    part = F.when(F.col("x.parts") > 1, F.pmod(F.xxhash64("id"), F.col("x.parts")) + 1).otherwise(0)
    return rows.select(F.col("x.tokens").alias("token"), "id", "n", F.col("pos").cast("long").alias("pos"), part.alias("part"))


def verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, str, int]:
    """pairs: a, b. Those whose whole texts link, as a table, its path and how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, np.ndarray] | None = None
        for whole in batches:
            for batch in row_slices(whole, "text_b"):
                sets = token_sets(batch.column(3).to_pylist(), width)
                good = []
                for text, other in zip(batch.column(2).to_pylist(), sets, strict=True):
                    if last is None or last[0] != text:
                        last = (text, token_sets([text], width)[0])
                    good.append(linked(last[1], other, percent))
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs, path, n = keep_counted(pairs, "pairs")
    if not n:
        return pairs, path, 0
    few = n <= BROADCAST_PAIRS
    near, ids = (F.broadcast(pairs), F.broadcast(pairs.select("a").distinct())) if few else (pairs, None)
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    left = left.join(ids, "a", "left_semi") if few else left
    held = right.join(near, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    found, path2, good = keep_counted(held.mapInArrow(gives_back(run), "a long, b long"), "links")
    discard(pairs.sparkSession, path)
    return found, path2, good


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Rows id, comp (the smallest id reachable) for the ids in edges: labels move along edges and jump."""
    spark = edges.sparkSession
    # each id is its own neighbour too, so that the least label around it holds its own
    around = F.explode(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x in "ab" for y in "ab")))
    both, edge_path = keep(edges.select(around.alias("x")).select("x.a", "x.b").distinct(), "edges")
    labels, path = keep(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b")
        near = near.groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"), F.min(F.when(F.col("a") == F.col("b"), F.col("comp"))).alias("was"))
        jump = labels.select(F.col("id").alias("near"), F.col("comp").alias("far"))
        moved = near.join(jump, "near").select("id", F.least("near", "far").alias("comp"), "was")
        moved, next_path, changed = keep_counted(moved, "labels", F.col("comp") != F.col("was"))
        discard(spark, path)
        labels, path = moved.select("id", "comp"), next_path
        if not changed:
            discard(spark, edge_path)
            return labels


def of_ids(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, str]:
    """The rows of docs with these ids; the path of the ids' table."""
    ids, path, n = keep_counted(ids, "ids")
    return docs.join(small(ids, BROADCAST_IDS, n), "id", "left_semi"), path


def grouped(matrix: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The matrix's rows with each id's group."""
    if comps is None:
        return matrix.withColumn("comp", F.col("id"))
    return matrix.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def hub_pairs(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Each token's members against the member that shares most of its tokens, if that is in another group; the paths of
    tables that they read."""
    hubs = rows.groupBy("token").agg(F.max(F.struct("shares", (-F.col("id")).alias("minus"), "comp")).alias("hub"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high")
    hubs, path, n = keep_counted(hubs.select("token", (-F.col("hub.minus")).alias("a"), F.col("hub.comp").alias("a_comp")), "hubs")
    # broadcast, so that the rows of a token that many documents have stay where they are; beyond that, the join splits them
    found = rows.join(small(hubs, BROADCAST_TOKENS, n), "token").filter("comp != a_comp")
    return found.groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("k")).filter(F.col("k") >= LEAST).select("a", "b"), [path]


def opened_pairs(rows: DataFrame, percent: int, least: int) -> DataFrame:
    """rows: token, id, n, pos, comp. Members of different groups that may link: groups whose token unions share `least`
    tokens are opened.

    Two linked sets of n and m tokens share o = ceil(c * (n + m)) at least, c = percent / (100 + percent). The first
    min(least, o) of these are at a place below n - o + least in the one set and below m - o + least in the other. Of a
    group whose members differ in size only the least slack = pos - (1 - c) * n is held against the other's least size.
    """
    c = percent / (100 + percent)
    o = F.ceil(c * (F.col("n") + F.col("m")) - 1e-6)
    enough = F.col("k") >= F.least(F.lit(least), o)
    fits = (F.col("p") + o < least + F.col("n")) & (F.col("q") + o < least + F.col("m"))
    loose = (F.col("s") + c * F.col("m") < least) & (F.col("t") + c * F.col("n") < least)
    slack = F.col("pos") - (1 - c) * F.col("n") - 1e-6
    unions = rows.groupBy("token", "comp").agg(F.min(slack).alias("s"), F.min("n").alias("n"), F.max("n").alias("n2"), F.min("pos").alias("p"))
    x = unions.select("token", F.col("comp").alias("x"), "s", "n", "n2", "p")
    y = unions.select("token", F.col("comp").alias("y"), F.col("s").alias("t"), F.col("n").alias("m"), F.col("n2").alias("m2"), F.col("p").alias("q"))
    even = (F.col("n") == F.col("n2")) & (F.col("m") == F.col("m2"))
    met = x.join(y, (x["token"] == y["token"]) & (F.col("x") < F.col("y")) & loose & (~even | fits)).select(x["token"], "x", "y", "n", "t", "m", "m2", "q")
    opened = met.groupBy("x", "y").agg(F.count("*").alias("k"), F.collect_list(F.struct("token", "t", "m", "m2", "q")).alias("rows"), F.min("n").alias("n"), F.min("m").alias("m")).filter(enough)
    opened = opened.select("x", "y", F.inline("rows"))
    left = rows.select(F.col("token").alias("l_token"), F.col("comp").alias("l_x"), F.col("id").alias("a"), "n", F.col("pos").alias("p"), slack.alias("s"))
    right = rows.select(F.col("token").alias("r_token"), F.col("comp").alias("r_y"), F.col("id").alias("b"), F.col("n").alias("m"), F.col("pos").alias("q"))
    sizes = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    # a member of x is held against the group y before y's members are met
    pairs = opened.join(left, (F.col("token") == F.col("l_token")) & (F.col("x") == F.col("l_x")) & loose & ((F.col("m") != F.col("m2")) | fits))
    pairs = pairs.select("token", "y", "a", "n", "p")
    pairs = pairs.join(right, (F.col("token") == F.col("r_token")) & (F.col("y") == F.col("r_y")) & sizes & fits)
    return pairs.groupBy("a", "b", "n", "m").agg(F.count("*").alias("k")).filter(enough).select("a", "b")


def with_enough(matrix: DataFrame, percent: int, least: int) -> DataFrame:
    """Adds shares, the share of an id's tokens that other ids have too; ids with too few such rows to link go."""
    shares = matrix.groupBy("id").agg(F.count("*").alias("tokens"), F.first("n").alias("size"))
    shares = shares.filter(F.col("tokens") >= F.least(F.lit(least), F.ceil(percent * F.col("size") / 100 - 1e-6)))
    return matrix.join(shares.select("id", (F.col("tokens") / F.col("size")).alias("shares")), "id")


def all_opened_pairs(matrix: DataFrame, comps: DataFrame | None, texts: DataFrame, width: int, percent: int, order: Order) -> tuple[DataFrame, list[str]]:
    """opened_pairs, with crowded tokens put last. Two documents that share a crowded token both have it, so that only
    documents with one are taken again, and are compared with each other only."""
    paths: list[str] = []
    found: list[DataFrame] = []
    least = LEAST
    for step in range(EXTENDED + 1):
        rows = grouped(matrix, comps)
        tokens = rows.select("token", "comp").distinct().groupBy("token").agg(F.count("*").alias("groups")).filter("groups > 1")
        tokens, path, n = keep_counted(tokens, "mixed-tokens")
        rows, path2 = keep(rows.select("token", "id", "n", "pos", "comp").join(small(tokens, BROADCAST_TOKENS, n), "token"), "mixed-rows")
        paths += [path, path2]
        crowded = place(rows.filter(F.col("groups") > CROWD).groupBy("token").agg(F.first("groups").alias("n")), CROWD.bit_length()) if step < EXTENDED else (np.zeros(0, np.uint64), np.zeros(0, np.int8))
        if not len(crowded[0]):
            found.append(opened_pairs(rows, percent, least))
            break
        full = (F.col("groups") > CROWD) & (F.floor(F.log2("groups")) + 1 >= int(crowded[1].min()))
        found.append(opened_pairs(rows.filter(~full), percent, least))
        order = demote(order, crowded)
        again, path = of_ids(texts, rows.filter(full).select("id").distinct())
        paths.append(path)
        least = 1  # behind the crowded ones no token is shared by chance: one is enough, and fewer rows are met
        matrix, path = keep(shared_rows(first_tokens(again, width, percent, order, least).transform(token_rows)), "matrix")
        paths.append(path)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return (pairs.distinct() if len(found) > 1 else pairs), paths


def same_id_links(sets: DataFrame, classes: DataFrame) -> tuple[DataFrame, str, int]:
    """sets: id, key; classes: key, id. Links a, b of the classes that one id's texts are in, the path of their table and how
    many they are."""
    named = sets.filter("id is not null").select("id", "key").join(classes.withColumnRenamed("id", "class"), "key").select("id", "class")
    several = named.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("high")).filter("a < high").select("id", "a")
    return keep_counted(named.join(several, "id").filter("class != a").select("a", F.col("class").alias("b")).distinct(), "same-id-links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id reachable by links)."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    described, path = keep(describe(docs, width), "described")
    order = place(described.filter("token is not null").groupBy("token").agg(F.sum("n").alias("n")), 4)
    sets = described.filter("token is null").select("id", "n", "key")
    # a table, so that a join with it can split the rows of a key that many documents have
    classes, path2 = keep(sets.filter("id is not null and key is not null").groupBy("key").agg(F.min("id").alias("id")), "classes")
    paths = [path, path2]
    rows = first_tokens(docs.filter("id is not null"), width, percent, order, LEAST).join(classes, ["id", "key"], "left_semi")
    matrix, path = keep(shared_rows(token_rows(rows)), "matrix")
    paths.append(path)
    matrix, path = keep(with_enough(matrix, percent, LEAST), "matrix-shares")
    found, path2 = of_ids(docs, matrix.select("id").distinct())
    texts, path3 = keep(found, "texts")
    paths += [path, path2, path3]
    links, path, n = same_id_links(sets, classes)
    paths.append(path)
    comps: DataFrame | None = None
    if n:
        comps = components(links)
    else:
        links = None
    for step in range(ROUNDS + 1):
        if step < ROUNDS:
            pairs, used = hub_pairs(grouped(matrix, comps))
        else:
            pairs, used = all_opened_pairs(matrix, comps, texts, width, percent, order)
        found, path, new = verify(pairs, texts, width, percent)
        paths += [path, *used]
        if new:
            links = found if links is None else links.union(found)
            comps = components(links)
    result = sets.join(classes.withColumnRenamed("id", "class"), "key", "left")
    if comps is not None:
        result = result.join(comps.withColumnRenamed("id", "class"), "class", "left")
    else:
        result = result.withColumn("comp", F.lit(None).cast("long"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("comp", "class", "id"))
    out, _ = keep(result.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")), "near-duplicates")
    discard(spark, *paths)
    return out


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stand for their components: one row with the smallest id of each. Rows without an
    id are kept. Where an id repeats with different texts, each of them is compared as a row of its own, in the ids' order."""
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    texts = docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(text).alias("low"), F.max(text).alias("high"))
    if texts.filter("low < high").limit(1).count():
        own, digest = "_row", "_digest"
        rows = docs.filter(F.col(id_col).isNotNull()).select(id_col, text.alias(digest)).distinct().sort(id_col, digest)
        rows, path = keep(rows.withColumn(own, F.monotonically_increasing_id()), "rows")
        numbered, path2 = keep(docs.withColumn(digest, text).join(rows, [id_col, digest], "left"), "numbered")
        out, _ = keep(one_of_each(numbered, width, percent, own, text_col).select(*(F.col(f"`{c}`") for c in docs.columns)), "one-of-each")
        discard(docs.sparkSession, path, path2)
        return out
    found = near_duplicates(docs, width, percent, id_col, text_col)
    stands = found.filter(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    kept = docs.join(stands, id_col, "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=85)
