"""Benchmark decontamination: BM25 over an inverted index of the test items, queried with every training passage.

Words are runs of letters and digits, lower-cased. A document's passages are windows of two segments, each as long as the
longest item, one segment apart, so that any copy of an item lies whole in a passage. A passage's terms are the distinct
words of it that some item has. An item's impacts (BM25 weights of its words among the items) are divided by its score for
itself, so that one threshold fits long and short items.

The search is block-max WAND, of many passages at once: every term of a passage has a cursor on the term's postings. In
each round a passage's cursors are put in the order of their items; the pivot is the first item at which the largest
impacts of the terms up to it reach the threshold. If the largest impacts of the blocks that the cursors would be in there
reach it as well, the item is scored; if not, the cursors skip to the end of the nearest block or to the next cursor's
item. A passage is done when no pivot is left. All items at or above the threshold are retrieved.

A retrieved item counts as leaked if shares of its question's and of its answer's distinct word trigrams are found in the
passage within a stretch of twice the item's words.

Defined results: null and empty texts have no passage; items without a word, or null, never match; an item of one word
is question and answer at once. A part of fewer than three words is one gram of its own length. A document has a row for
each of its leaked items, that of its best passage (then the first); repeated rows and null ids give rows of their own;
very long texts are passages like others. Items with equal ids and texts are one, item ids may be of any type that can be
ordered. Empty tables give no rows. Only the named columns are read.

The index grows with the benchmark alone, which the caller bounds: max_items items of max_words words together at most, or
an error.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from arborfolio.llm.shared import kept_rows, row_slices

WORD = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75
#: Share of an item's own score; shares of its question's and answer's trigrams.
THRESHOLD, QUESTION_SHARE, ANSWER_SHARE = 0.5, 0.5, 0.5
#: Postings of a block; cursors that are moved together.
BLOCK, CURSORS = 32, 100_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def split_item(text: str | None) -> tuple[list[str], list[str]]:
    """Question and answer of an item that comes as one text: the last quarter of its words, 3 at least, is the answer."""
    words = words_of(text)
    cut = len(words) - max(min(3, len(words)), len(words) // 4)
    return (words[:cut] or words), words[cut:]


def found_together(passage: list[int], parts: tuple[list[int], list[int]], reach: int) -> tuple[float, float]:
    """The shares of the distinct trigrams of both parts in the passage, within a stretch of `reach` words: those of the
    stretch with the largest lesser share, then the largest sum. A part without a word counts as found."""
    sizes, met = [], []
    for kind, part in enumerate(parts):
        n = min(3, len(part))
        own = set(zip(*(part[k:] for k in range(n)), strict=False)) if n else set()
        sizes.append(len(own))
        met += [(i, kind, g) for i, g in enumerate(zip(*(passage[k:] for k in range(n)), strict=False)) if g in own] if n else []
    met.sort()
    held: Counter = Counter()
    counts, best, low = [0, 0], (0.0 if sizes[0] else 1.0, 0.0 if sizes[1] else 1.0), 0
    for at, kind, gram in met:
        while at - met[low][0] >= reach:
            held[met[low][1:]] -= 1
            counts[met[low][1]] -= not held[met[low][1:]]
            low += 1
        counts[kind] += not held[kind, gram]
        held[kind, gram] += 1
        now = tuple(c / n if n else 1.0 for c, n in zip(counts, sizes, strict=True))
        if (min(now), sum(now)) > (min(best), sum(best)):
            best = now
    return best


@dataclass
class ItemIndex:
    ids: list
    parts: list[tuple[list[int], list[int]]]  # of each item the terms of its question and of its answer, in order
    segment: int
    terms: dict[str, int]
    firsts: np.ndarray  # of each term: its first posting; one more at the end
    most: np.ndarray  # of each term: its largest impact
    # of each posting; behind each term's postings is one of the item len(ids), with no impact
    items: np.ndarray
    impacts: np.ndarray
    keys: np.ndarray  # term and item as one number, in order
    upper: np.ndarray  # its term's largest impact
    block_most: np.ndarray  # its block's largest impact
    block_last: np.ndarray  # its block's last item

    @classmethod
    def build(cls, items: list[tuple[object, list[str], list[str]]]) -> ItemIndex:
        items = [x for x in items if x[1] or x[2]]
        bags = [Counter(q if q == a else q + a) for _, q, a in items]
        sizes = np.array([sum(b.values()) for b in bags], float)
        mean = sizes.mean() if len(items) else 1.0
        df = Counter(w for b in bags for w in b)
        terms = {w: i for i, w in enumerate(sorted(df))}
        n, rows = len(items), []
        for i, bag in enumerate(bags):
            score = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[i] / mean)) for w, tf in bag.items()}
            own = sum(score.values())
            rows += [(terms[w], i, s / own) for w, s in score.items()]
        rows += [(t, n, 0.0) for t in range(len(terms))]
        rows.sort()
        term, at, impact = (np.array([r[k] for r in rows], kind) for k, kind in enumerate((np.int64, np.int32, np.float64)))
        firsts = np.searchsorted(term, np.arange(len(terms) + 1))
        most = np.maximum.reduceat(impact, firsts[:-1]) if len(terms) else np.zeros(0)
        # blocks are counted from each term's first posting
        blocks = -(-np.diff(firsts) // BLOCK)
        block = np.repeat(np.cumsum(blocks) - blocks, np.diff(firsts)) + (np.arange(len(term)) - firsts[term]) // BLOCK
        begin = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(term) else np.zeros(0, np.int64)
        block_most, block_last = (np.maximum.reduceat(x, begin)[block] if len(term) else x for x in (impact, at))
        parts = [tuple([terms[w] for w in part] for part in x[1:]) for x in items]
        return cls([x[0] for x in items], parts, max(32, int(sizes.max()) if n else 0), terms, firsts, most, at, impact, term * (n + 1) + at, most[term], block_most, block_last)

    def forward(self, at: np.ndarray, items: np.ndarray) -> np.ndarray:
        """The places of the first postings, from these on, that have the items or later ones."""
        late = np.flatnonzero(self.items[at] < items)
        if len(late):
            at = at.copy()
            at[late] += 1
            late = late[self.items[at[late]] < items[late]]
            if len(late):
                p = at[late]
                at[late] = np.searchsorted(self.keys, self.keys[p] - self.items[p] + items[late])
        return at

    def search(self, windows: np.ndarray, terms: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
        """windows, terms: the distinct terms of each passage, sorted by passage. Passage, item, score for all scores of at
        least the threshold."""
        if not len(terms):
            return
        first = np.append(np.flatnonzero(np.append(True, windows[1:] != windows[:-1])), len(terms))
        a = 0
        while a < len(first) - 1:
            b = max(a + 1, int(np.searchsorted(first, first[a] + CURSORS, "right")) - 1)
            yield from self._search(windows[first[a:b]], terms[first[a] : first[b]], np.diff(first[a : b + 1]), threshold - 1e-9)
            a = b

    def _search(self, names: np.ndarray, terms: np.ndarray, sizes: np.ndarray, goal: float) -> Iterator[tuple[int, int, float]]:
        """names: of the passages; sizes: how many of the terms each has."""
        none = len(self.ids)
        kind = np.int32 if len(sizes) * (none + 1) < 1 << 31 else np.int64
        at = self.firsts[terms]
        while len(at):
            # cursors in the order of their items; the pivot is where the terms' largest impacts reach the goal
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.repeat(np.arange(len(sizes), dtype=kind) * kind(none + 1), sizes)
            order += self.items[at]
            at = at[np.argsort(order)]
            upper, ends = self.upper[at], np.cumsum(sizes)
            sums = np.cumsum(upper)
            pivot = np.searchsorted(sums, sums[ends - sizes] - upper[ends - sizes] + goal)
            open_ = pivot < ends
            if not open_.all():
                at = at[np.repeat(open_, sizes)]
                pivot = (pivot - np.cumsum(np.where(open_, 0, sizes)))[open_]
                names, sizes = names[open_], sizes[open_]
                if not len(sizes):
                    return
                owner, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
            items = self.items[at]
            goals = items[pivot]
            up_to = items <= goals[owner]
            moving = np.flatnonzero(up_to)
            mine = owner[moving]
            there = self.forward(at[moving], goals[mine])
            enough = np.bincount(mine, self.block_most[there], len(sizes)) >= goal
            scored = np.flatnonzero(enough[mine])
            same = self.items[there[scored]] == goals[mine[scored]]
            scores = np.bincount(mine[scored], np.where(same, self.impacts[there[scored]], 0.0), len(sizes))
            for k in np.flatnonzero(enough & (scores >= goal)).tolist():
                yield int(names[k]), int(goals[k]), float(scores[k])
            # past the pivot; where the blocks forbid it, to the end of the nearest block or to the next cursor
            after = np.minimum.reduceat(np.where(up_to, none, items), ends - sizes)
            nearest = np.minimum.reduceat(self.block_last[there], np.flatnonzero(np.append(True, mine[1:] != mine[:-1])))
            after = np.where(enough, goals + 1, np.maximum(np.minimum(after, nearest + 1), goals + 1))
            at[moving] = self.forward(there, np.minimum(after, none)[mine])
            stay = self.items[at] < none
            if not stay.all():
                at, sizes = at[stay], np.bincount(owner[stay], minlength=len(sizes))
                names, sizes = names[sizes > 0], sizes[sizes > 0]

    def leaks(self, texts: list[str | None], threshold: float, question_share: float, answer_share: float) -> list[dict[int, tuple[float, int, float, float]]]:
        """Of each text its leaked items with the best passage: score, first word, overlaps."""
        found: list[dict[int, tuple[float, int, float, float]]] = [{} for _ in texts]
        if not self.ids:
            return found
        words = [words_of(t) for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        spelled = np.fromiter(map(self.terms.get, chain.from_iterable(words), repeat(-1)), np.int64, int(lengths.sum()))
        segments = -(-lengths // self.segment)
        base, begin = np.append(0, np.cumsum(segments)), np.append(0, np.cumsum(lengths))
        doc = np.repeat(np.arange(len(texts)), lengths)
        place = np.arange(len(spelled)) - begin[doc]
        known = spelled >= 0
        ids, doc, seg = spelled[known], doc[known], (base[doc] + place // self.segment)[known]
        again = seg > base[doc]
        keys = np.sort(np.concatenate([seg, seg[again] - 1]) * len(self.terms) + np.concatenate([ids, ids[again]]))
        keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
        owner = np.repeat(np.arange(len(texts)), segments)
        for window, item, score in self.search(keys // len(self.terms), keys % len(self.terms), threshold):
            i, score = int(owner[window]), round(score, 9)  # sums of one item's impacts differ in their last digits
            at = int(window - base[i]) * self.segment
            passage = spelled[begin[i] + at : min(begin[i] + at + 2 * self.segment, begin[i + 1])].tolist()
            question, answer = self.parts[item]
            q, a = found_together(passage, (question, answer), 2 * (len(question) + (len(answer) if question != answer else 0)))
            if q >= question_share and a >= answer_share and ((old := found[i].get(item)) is None or (score, -at) > (old[0], -old[1])):
                found[i][item] = (score, at, q, a)
        return found


def index_items(benchmark: DataFrame, item_id: str = "item_id", text_col: str | None = "text", question_col: str | None = None, answer_col: str | None = None, max_items: int = 200_000, max_words: int = 5_000_000) -> ItemIndex:
    """From question and answer columns, or from one text column (see split_item)."""
    columns = [question_col, answer_col] if question_col and answer_col else [text_col]
    rows = benchmark.filter(F.col(item_id).isNotNull()).select(item_id, *columns).distinct().take(max_items + 1)
    if len(rows) > max_items:
        raise ValueError(f"more than {max_items} items")
    items = [(r[0], *((words_of(r[1]), words_of(r[2])) if len(columns) == 2 else split_item(r[1]))) for r in rows]
    if sum(len(q) + len(a) for _, q, a in items) > max_words:
        raise ValueError(f"items of more than {max_words} words")
    return ItemIndex.build(sorted(items))


def find_leaks(docs: DataFrame, index: ItemIndex, threshold: float = THRESHOLD, question_share: float = QUESTION_SHARE, answer_share: float = ANSWER_SHARE, id_col: str = "doc_id", text_col: str = "text", item_type: str = "long") -> DataFrame:
    """Rows id, item_id (of item_type, the type that the benchmark's ids have), score, first_word (of the passage),
    passage_words, question_overlap, answer_overlap."""
    shipped = docs.sparkSession.sparkContext.broadcast(index)
    kind = dict(docs.dtypes)[id_col]
    item_kind = to_arrow_type(StructType.fromDDL(f"item_id {item_type}")[0].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for whole in batches:
            for batch in row_slices(whole, text_col, 2 << 20):
                hits = own.leaks(batch.column(1).to_pylist(), threshold, question_share, answer_share)
                rows = [(i, own.ids[item], *x) for i, h in enumerate(hits) for item, x in sorted(h.items())]
                out = [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))]
                out += [pa.array([r[k] for r in rows], t) for k, t in ((1, item_kind), (2, pa.float64()), (3, pa.int64()))]
                out += [pa.array([2 * own.segment] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], pa.float64()) for k in (4, 5))]
                yield pa.RecordBatch.from_arrays(out, names=[id_col, "item_id", "score", "first_word", "passage_words", "question_overlap", "answer_overlap"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, item_id {item_type}, score double, first_word long, passage_words long, question_overlap double, answer_overlap double")


def drop_leaks(docs: DataFrame, index: ItemIndex, threshold: float = THRESHOLD, question_share: float = QUESTION_SHARE, answer_share: float = ANSWER_SHARE, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without those that hold a leaked item."""
    shipped = docs.sparkSession.sparkContext.broadcast(index)

    def clean(texts: list[str | None]) -> list[bool]:
        return [not h for h in shipped.value.leaks(texts, threshold, question_share, answer_share)]

    return kept_rows(docs, text_col, clean)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return find_leaks(docs, index_items(benchmark), item_type=dict(benchmark.dtypes)["item_id"])
