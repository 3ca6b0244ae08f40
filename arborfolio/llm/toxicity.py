"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

A text is lower-cased, runs of what is neither letter nor digit become one space, and the n-grams present in the whole
text (counted once) are hashed. The ratio r of a bucket is log of its smoothed share among toxic labelled texts over its
share among the others; the logistic regression is fitted on r times presence.

Defined results: null and empty texts have no n-gram and get the intercept's score; without labelled rows of both
classes every score is the smoothed share of toxic labels (0.5 without any). Repeated rows score alike; a null doc_id is
never in the training part. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborfolio.llm.ngrams import Rows, char_ngrams, codepoints, fit_logistic
from arborfolio.llm.shared import label_sample, row_slices

BITS, ORDERS = 20, range(3, 7)
GAP = re.compile(r"[\W_]+")


def buckets(text: str | None) -> list[np.ndarray]:
    body = GAP.sub(" ", (text or "").lower()).strip()
    return list(char_ngrams(codepoints(f" {body} "), ORDERS, BITS)) if body else []


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray  # of each bucket
    intercept: float

    def score(self, text: str | None) -> float:
        found = [b[self.weights[b] != 0] for b in buckets(text)]
        z = self.intercept + (float(self.weights[np.unique(np.concatenate(found))].sum(dtype=np.float64)) if found else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def train_toxicity(labelled: DataFrame, texts: DataFrame | None = None, bound: int = 6_000, most_chars: int = 48_000_000, features: int = 2_048, least_rows: int = 4, l2: float = 8.0) -> ToxicityModel:
    """labelled: id, text, toxic (0 or 1). Where texts (id, text) is given, labelled needs no text: ids are chosen first, and
    only the chosen ones, which are broadcast, meet the texts.

    bound: about so many labelled rows are used, chosen by a hash of the id (classifier fit on a bounded sample), an equal
    number of both classes, all of a class that has fewer; the intercept is put back to the classes' shares of all rows.
    most_chars bounds their texts together, taken whole in the order of a hash: first those no longer than an even share,
    which always fit, then of the longer ones each that still does. features: the buckets with the largest
    |r| * sqrt(rows) make the model, of those in least_rows texts at least (all buckets together find fewer toxic texts).
    """
    labelled = labelled.filter(F.col("toxic").isNotNull() & F.col("id").isNotNull())
    sample, counts = label_sample(labelled.withColumn("is_toxic", F.col("toxic") == 1), "id", "is_toxic", bound)
    if texts is not None:
        sample = texts.join(F.broadcast(sample.select("id", "toxic").distinct()), "id")
    all1, all0 = float(counts.get(True, 0)), float(counts.get(False, 0))
    rows = sorted(((x.id, x.text or "", x.toxic) for x in sample.select("id", "text", "toxic").toLocalIterator()), key=lambda r: (hash_of(r[0]), r[1], r[2]))
    rows = [rows[i] for i in fitting([len(r[1]) for r in rows], most_chars)]
    return fit_toxicity([r[1] for r in rows], np.array([float(r[2] == 1) for r in rows]), all1, all0, features, least_rows, l2)


def fit_toxicity(texts: list[str], y: np.ndarray, all1: float, all0: float, features: int, least_rows: int, l2: float) -> ToxicityModel:
    """all1, all0: rows of both classes in the whole table."""
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    weights = np.zeros(1 << BITS, np.float32)
    if not n1 or not n0:
        return ToxicityModel(weights, float(np.log((all1 + 1) / (all0 + 1))))
    sets = [np.unique(np.concatenate(found)).astype(np.int32) if (found := buckets(t)) else np.zeros(0, np.int32) for t in texts]
    counts = np.zeros((2, 1 << BITS))
    for s, label in zip(sets, y, strict=True):
        counts[int(label), s] += 1
    r = np.log((counts[1] + 1) / (n1 + 2)) - np.log((counts[0] + 1) / (n0 + 2))
    worth = np.where(counts.sum(0) >= least_rows, np.abs(r) * np.sqrt(counts.sum(0)), 0)
    chosen = np.argsort(-worth, kind="stable")[:features]
    chosen = chosen[worth[chosen] > 0]
    slot = np.full(1 << BITS, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))
    w, b = fit_logistic(Rows([slot[s][slot[s] >= 0] for s in sets], r[chosen]), y, l2)
    weights[chosen] = w * r[chosen]
    return ToxicityModel(weights, b + float(np.log(all1 / all0 * n0 / n1)))


def fitting(sizes: list[int], most: int) -> list[int]:
    """The places, in order, of the sizes that are taken: those of an even share of `most` at most, then larger ones that fit."""
    small = [i for i, n in enumerate(sizes) if n * len(sizes) <= most]
    taken, held = set(small), sum(sizes[i] for i in small)
    for i, n in enumerate(sizes):
        if i not in taken and held + n <= most:
            taken.add(i)
            held += n
    return sorted(taken)


def hash_of(value: object) -> int:
    import zlib

    return zlib.crc32(str(value).encode())


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, score of its whole text."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, text_col):
                scores = [model.score(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    texts = docs.filter(part != 1).select(F.col("doc_id").alias("id"), "text")
    model = train_toxicity(texts.select("id").distinct().join(labels.filter(part != 1).withColumnRenamed("doc_id", "id"), "id"), texts)
    return score_toxicity(docs, model).select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
