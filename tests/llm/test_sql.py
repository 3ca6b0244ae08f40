"""Queries with SQL against DuckDB: on the small tables, and on a few rows with nulls, ties and repeats."""

import datetime as dt
import random

import duckdb
import pytest

from arborfolio.llm import valid_time
from arborfolio.llm.entries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = ("documents", "embeddings", "pages", "sales", "client_changes")


def same(spark, folder, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if folder != SF else ''}')")
    got = QUERIES[name](spark, folder)
    want = db.sql(ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda x: sorted(x, key=lambda r: [(v is not None, str(v)) for v in r])
    a, b = rows(tuple(r) for r in got.select(*columns).collect()), rows(want.select(*columns).fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y


def shop_rows(spark, folder, sales=400, changes=300, seed=3):
    """Sales and changes of few clients, with nulls, repeats, ties in time, late rows and one very common client."""
    draw = random.Random(seed)
    day = lambda n: dt.datetime(2023, 12, 30) + dt.timedelta(hours=draw.randint(0, 24 * n))
    who = lambda: draw.choice([None, 1, 1, 1, 1, 2, 3, 4])
    sold = [(i if i % 50 else None, who(), draw.choice([None, *[day(125)] * 9]), "x") for i in range(sales)]
    rows = [(*s[:3], draw.choice([None, day(20), *[(s[2] or day(120)) + dt.timedelta(hours=draw.randint(0, 60))] * 8]), s[3]) for s in sold]
    spark.createDataFrame(rows, "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, rec string").write.parquet(f"{folder}/sales.parquet")
    times = [day(125) for _ in range(60)]
    rows = [(i, who(), draw.randint(0, 3), draw.choice(["I", "U", "D", None]), draw.choice([None, *times]), draw.choice([None, draw.randint(-99999, 99999) / 100]), "clash") for i in range(changes)]
    spark.createDataFrame(rows + rows[:20], "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, balance double, batch string").write.parquet(f"{folder}/client_changes.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, SF, name)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql_on_odd_rows(spark, tmp_path, name):
    words = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " \t\n", "one", "ONE", "a b c", "a b c d", words, words.upper(), words + " more", words.replace("w30 ", ""), words + " x" * 40, "é É a b c", "É É a b c"]
    vectors = [[1.0, 2.0], [1.0, 2.0], None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [-0.001, 0.5], [3.0], [2.0], [0.0, 0.0]]
    pages = ["", None, "x", "x", "é" * 99, "é" * 99, " "]
    spark.createDataFrame([(50 - i, t, "source", i) for i, t in enumerate(texts)], "doc_id long, text string, source string, id int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i * 25, v, i) for i, v in enumerate(vectors)] + [(None, [1.0, 1.0], 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(9 - i, None, p, "a") for i, p in enumerate(pages)] + [(3, "u", "x", "b"), (None, "u", "x", "b"), (None, "u", "alone", "b")], "page_id long, url string, html string, id string").write.parquet(f"{tmp_path}/pages.parquet")
    shop_rows(spark, tmp_path)
    same(spark, str(tmp_path), name)


def test_sales_of_clients_that_are_cut_by_time(spark, tmp_path, monkeypatch):
    """Groups of a few rows, and clients of more than a few cut into slices of hours."""
    shop_rows(spark, tmp_path, seed=8)
    for t in ("documents", "embeddings", "pages"):
        spark.range(1).write.parquet(f"{tmp_path}/{t}.parquet")
    plain = valid_time.enrich_sales
    monkeypatch.setattr(valid_time, "enrich_sales", lambda sales, changes, batches: plain(sales, changes, batches, group_rows=2, split_above=20))
    same(spark, str(tmp_path), "op11_valid_time_sales")


def test_sales_of_empty_tables(spark, tmp_path):
    shop_rows(spark, tmp_path / "full", 5, 5)
    for t in ("sales", "client_changes"):
        spark.read.parquet(f"{tmp_path}/full/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES["op11_valid_time_sales"](spark, str(tmp_path)).collect() == []
