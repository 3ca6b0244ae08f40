"""URL filter: rules by host and path, and for the rest a logistic regression on hashed character n-grams.

Defined results: a null url, or one without "://", has an empty host and an empty path, fits no rule and is judged
by the model; so does an empty one. Urls of any length are judged whole. Of rules as long as each other the first in
alphabetical order wins. Repeated rows are judged alike; an empty table gives an empty result; only the id and the url are
read, so other columns, whatever their names, play no part. A model of no labelled rows scores 0.5.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from arborfolio.llm.ngrams import Rows, char_ngrams, codepoints, fit_logistic

BITS, ORDERS = 15, range(3, 6)
LOWER = {i: i + 32 for i in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    action: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of query op1.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))

#: Parts of the default labelled table, put together by labelled_urls(): topics by label, and what both labels have.
TOPICS = (
    ("news", "wiki", "docs", "library", "journal", "museum", "school", "science", "recipes", "weather", "travel", "history", "research", "garden", "football", "theatre", "archive", "manual"),
    ("casino", "bets", "pills", "adult", "poker", "porn", "viagra", "jackpot", "warez", "escort", "replica", "lottery", "xxx", "payday-loan", "keygen", "sexcam", "roulette", "torrent"),
)
PLAIN = ("river", "north", "blue", "city", "cloud", "home", "media", "group", "web", "green", "first", "data", "point", "works", "lab", "house")
TOPS = ("com", "org", "net", "info", "io", "de", "fr", "co.uk", "eu", "biz")
SYLLABLES = ("ba", "le", "ri", "on", "tu", "es", "ga", "mi", "an", "lo", "pe", "st", "er", "na")


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or (i := url.find("://")) < 0:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url[i + 3 :]).groups()
    return host.translate(LOWER), path


def labelled_rows(rows: int = 6_000) -> list[tuple[str, int]]:
    """The default labelled table, made by rule from hashes of row numbers. A row in three is unwanted.
    Rows with a topic have it in the host, in the path or in both; half of the wanted ones have none. Domains, other words,
    numbers and the shapes of hosts and paths are the same for both labels."""
    made = []
    for i in range(rows):
        draws = iter(hashlib.sha256(str(i).encode()).digest())
        one_of = lambda values: values[next(draws) % len(values)]  # noqa: B023, E731
        label = int(i % 3 == 0)
        topic, n = one_of(TOPICS[label]), str(next(draws) * 7)
        a, b = (one_of(PLAIN) if next(draws) % 2 else one_of(SYLLABLES) + one_of(SYLLABLES) + one_of(SYLLABLES) for _ in range(2))
        where = 0 if label == 0 and i % 2 else 1 + next(draws) % 3  # nowhere, in the host, in the path, in both
        t, u = (topic if where & 1 else b), (topic if where & 2 else b)
        host = one_of((f"{t}{a}", f"{a}-{t}", f"{t}.{a}", f"www.{a}{t}", f"shop.{t}{a}", f"{t}-{a}{n}"))
        path = one_of((f"/{u}/{a}-{n}.html", f"/{a}/{u}/", f"/{n}/{u}", f"/index/{u}-{a}", f"/{a}_{u}/{n}/{b}", f"/{u}"))
        made.append((f"{one_of(('http', 'https'))}://{host}.{one_of(TOPS)}{path}{one_of(('', '', '?id=' + n, '#top'))}", label))
    return made


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default labelled table: url, label (1: block)."""
    return spark.createDataFrame(labelled_rows(), "url string, label int")


class RuleIndex:
    """Rules by host; a url is looked up under each suffix of its host that is no longer than a rule's, in labels."""

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.by_host: dict[str, list[Rule]] = {}
        for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
            self.by_host.setdefault(r.host, []).append(r)
        self.labels = max((h.count(".") + 1 for h in self.by_host), default=0)

    def find(self, host: str, path: str) -> Rule | None:
        fits, dot = [], len(host)
        for _ in range(self.labels):
            dot = host.rfind(".", 0, dot)
            fits += [r for r in self.by_host.get(host[dot + 1 :], ()) if path.startswith(r.path)][:1]
            if dot < 0:
                break
        return min(fits, key=lambda r: (-len(r.text), r.text), default=None)


def url_features(host: str, path: str) -> np.ndarray:
    """Distinct buckets: n-grams of the host in the lower half, of the path in the upper."""
    found = [b for b in char_ngrams(codepoints(f"^{host}$"), ORDERS, BITS - 1, 1)]
    found += [b + (1 << BITS - 1) for b in char_ngrams(codepoints(f"^{path.lower()}$"), ORDERS, BITS - 1, 2)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    intercept: float

    def score(self, host: str, path: str) -> float:
        z = self.intercept + float(self.weights[url_features(host, path)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def train_url_model(labelled: DataFrame, bound: int = 20_000, l2: float = 1.0) -> UrlModel:
    """labelled: url, label (1: block). bound: the most labelled rows used; a longer table is an error, not a cut."""
    rows = labelled.select("url", "label").dropna().take(bound + 1)
    if len(rows) > bound:
        raise ValueError(f"more than {bound} labelled urls")
    return fit_urls([(r.url, r.label) for r in rows], l2)


def fit_urls(rows: list[tuple[str, int]], l2: float) -> UrlModel:
    sets = [url_features(*split_url(url)) for url, _ in rows]
    w, b = fit_logistic(Rows(sets, np.ones(1 << BITS)), np.array([float(label) for _, label in rows]), l2)
    return UrlModel(w.astype(np.float32), b)


def judge_urls(pages: DataFrame, model: UrlModel, rules: Iterable[Rule] = (), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: id, host, path, rule (or null), verdict (allow or block), score (the model's, 1: block)."""
    rules = tuple(rules)
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules)
        for batch in batches:
            cut = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [index.find(*x) for x in cut]
            scores = [model.score(*x) for x in cut]
            verdicts = [r.action if r else "block" if s >= 0.5 else "allow" for r, s in zip(found, scores, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in cut], pa.string()), pa.array([x[1] for x in cut], pa.string()), pa.array([r.text if r else None for r in found], pa.string()), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())],
                names=[id_col, "host", "path", "rule", "verdict", "score"],
            )

    return pages.select(id_col, url_col).mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, score double")


def op1_url_filter(spark: SparkSession, sf_dir: str, labelled: DataFrame | None = None) -> DataFrame:
    """labelled: url, label (1: block), to learn from instead of the default table."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, train_url_model(labelled if labelled is not None else labelled_urls(spark)), RULES)
