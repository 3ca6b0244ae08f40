"""Language ID by word-first backoff.

Words are maximal runs of letters, lower-cased. A word in the table of learned words is scored by its log frequency in
each language; any other word by the character n-grams of its padded form, of the longest order from 5 down to 1 of
which one is known. A text's language has the largest sum of its words' scores; the score is that language's posterior.

Defined results: null texts and texts without a letter are "und" with score 0, as is every text when nothing was
learned. Ties go to the language that sorts first. Texts of any length are judged whole. Repeated rows are judged alike; an
empty table gives no rows; only the named columns are read, whatever else there is.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborfolio.llm.shared import discard, keep, kept_rows, label_sample, row_slices

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
CACHE = 60_000


def words_of(text: str | None) -> list[str]:
    """The words; none if the text has no letter."""
    words = WORD.findall(text.lower()) if text else []
    return words if any(w.isalpha() or any(map(str.isalpha, w)) for w in words) else []


@dataclass
class LanguageModel:
    langs: list[str]
    keys: list[pa.Array]  # the words, then the n-grams of each order, as their scores' rows are
    gram_scores: list[np.ndarray]
    scores: np.ndarray
    cache: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.more = np.zeros((0, len(self.langs)))

    # Made where texts are judged: the driver, which fits and ships a model, holds no object for each word and n-gram.
    @cached_property
    def words(self) -> dict[str, int]:
        """Each word's row of scores."""
        return {k: i for i, k in enumerate(self.keys[0].to_pylist())}

    @cached_property
    def grams(self) -> list[dict[str, int]]:
        """By order - 1: each n-gram's row of that order's scores."""
        return [{k: i for i, k in enumerate(keys.to_pylist())} for keys in self.keys[1:]]

    def backoff(self, word: str) -> np.ndarray:
        padded = f"_{word}_"
        for n in range(min(LONGEST, len(padded)), 0, -1):
            text = padded if n > 1 else word  # a border alone says nothing
            known = [g for i in range(len(text) - n + 1) if (g := self.grams[n - 1].get(text[i : i + n])) is not None]
            if known:
                return self.gram_scores[n - 1][known].mean(0)
        return np.zeros(len(self.langs))

    def scores_of(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word; those of unseen words are kept for the texts to come."""
        if len(self.cache) > CACHE:
            self.cache = {}
        find, kept, fixed = self.words.get, self.cache, len(self.scores)
        rows, added = [], []
        for w in words:
            if (i := find(w)) is None and (i := kept.get(w)) is None:
                kept[w] = i = fixed + len(kept)
                added.append((i - fixed, self.backoff(w)))
            rows.append(i)
        if added:
            if added[-1][0] >= len(self.more):
                self.more = np.concatenate([self.more, np.zeros((max(4096, added[-1][0] + 1 - len(self.more), len(self.more)), len(self.langs)))])
            for i, s in added:
                self.more[i] = s
        at = np.array(rows, np.int64)
        out = np.zeros((len(at), len(self.langs)))
        old = at < fixed
        out[old], out[~old] = self.scores[at[old]], self.more[at[~old] - fixed]
        return out

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text. The texts' distinct words are looked up once."""
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        out = [("und", 0.0)] * len(texts)
        there = np.flatnonzero(sizes)
        if not len(there) or not self.langs:
            return out
        coded = pa.array(list(chain.from_iterable(words)), pa.large_string()).dictionary_encode()
        ends = np.cumsum(sizes[there])
        total = np.add.reduceat(self.scores_of(coded.dictionary.to_pylist())[coded.indices.to_numpy()], ends - sizes[there])
        odds = np.exp(total - total.max(1, keepdims=True))
        share = odds.max(1) / odds.sum(1)
        for i, best, score in zip(there.tolist(), total.argmax(1).tolist(), share.tolist(), strict=True):
            out[i] = (self.langs[best], score)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def word_counts(docs: DataFrame) -> DataFrame:
    """docs: text, lang. Rows lang, word, n; counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

        for whole in batches:
            for batch in row_slices(whole, "text"):
                for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held[lang].update(words_of(text))
                if sum(map(len, held.values())) > CACHE:
                    yield out()
        if held:
            yield out()

    return docs.select("text", "lang").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(counts: DataFrame) -> DataFrame:
    """counts: lang, word, n. Rows lang, size, gram, n: the n-grams of all words, padded, each place counted n times."""
    padded = counts.select("lang", F.concat(F.lit("_"), "word", F.lit("_")).alias("padded"), "n")
    grams = lambda size: F.when(F.length("padded") >= size, F.transform(F.sequence(F.lit(1), F.length("padded") - size + 1), lambda i: F.struct(F.lit(size).alias("size"), F.substring("padded", i, F.lit(size)).alias("gram"))))
    none = F.array().cast("array<struct<size:int,gram:string>>")
    rows = padded.select("lang", "n", F.explode(F.concat(*(F.coalesce(grams(k), none) for k in range(1, LONGEST + 1)))).alias("x"))
    return rows.groupBy("lang", "x.size", "x.gram").agg(F.sum("n").alias("n"))


def train_languages(labelled: DataFrame, bound: int = 10_000) -> LanguageModel:
    """labelled: id, text, lang. About `bound` labelled texts are used, whole, chosen by a hash of the id (classifier fit
    on a bounded sample): an equal number of each language, all of a language that has fewer. All words of these texts are
    in the table of words, and the n-grams of all of them, weighted by frequency, in those of n-grams."""
    labelled = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts, path = keep(word_counts(label_sample(labelled, "id", "lang", bound)[0]), "word-counts")
    rows = counts.toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    pieces = gram_counts(counts).toArrow().sort_by([("size", "ascending"), ("gram", "ascending")])
    discard(labelled.sparkSession, path)
    langs = sorted(pc.unique(pieces.column("lang")).to_pylist())

    def table(keys: pa.ChunkedArray, rows: pa.Table) -> tuple[pa.Array, np.ndarray]:
        """The distinct keys, and each one's log frequency by language."""
        coded = keys.combine_chunks().dictionary_encode()
        counts = np.zeros((len(coded.dictionary), len(langs)))
        np.add.at(counts, (coded.indices.to_numpy(), pc.index_in(rows.column("lang"), pa.array(langs, pa.string())).to_numpy()), rows.column("n").to_numpy())
        counts += 0.2
        return coded.dictionary, np.log(counts) - np.log(counts.sum(0))

    words, scores = table(rows.column("word"), rows)
    grams = [table((part := pieces.filter(pc.equal(pieces.column("size"), size))).column("gram"), part) for size in range(1, LONGEST + 1)]
    return LanguageModel(langs, [words, *(g[0] for g in grams)], [g[1].astype(np.float32) for g in grams], scores)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred, score."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for whole in batches:
            for batch in row_slices(whole, text_col):
                found = own.predict_all(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", wanted: frozenset[str] | None = None) -> DataFrame:
    """The rows of docs, all columns, whose text has a language (one of wanted, if given)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def identified(texts: list[str | None]) -> list[bool]:
        return [x != "und" and (wanted is None or x in wanted) for x, _ in shipped.value.predict_all(texts)]

    return kept_rows(docs, text_col, identified)


def learned_fold(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that may be learned from: crc32 of the id as text, mod 5, is not 0."""
    return docs.filter(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_languages(learned_fold(docs).select(F.col("doc_id").alias("id"), "text", "lang"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
