"""What the driver does and holds: jobs, counted rows, models."""

import os
import pickle
import random
import re
import sys
import time
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from arborfolio.llm import jaccard_join, language, shared

SF = "/root/testdata/sf0.01"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_jobs_of_the_jaccard_join(spark):
    """Each job leaves threads, plans and generated code on the driver for a while: rows are counted while they are written."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 4 = 0")
    context = spark.sparkContext
    context.setJobGroup("jaccard-jobs", "jaccard-jobs")
    try:
        jaccard_join.near_duplicates(docs)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(context.statusTracker().getJobIdsForGroup("jaccard-jobs")) <= 78


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    edges = [(i + 1, i) for i in range(100, 140)] + [(i, i + 1) for i in range(200, 230)] + [(230, 200), (7, 7), (9, 8), (8, 9), (9, 8), (300, -5)]
    edges += [(x, y) for x, y in ((rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)) if x != y]
    up = {i: i for e in edges for i in e}
    for _ in range(len(up)):
        for x, y in edges:
            up[x] = up[y] = min(up[x], up[y])
    got = jaccard_join.components(frame(spark, edges, "a long, b long")).collect()
    assert sorted((r.id, r.comp) for r in got) == sorted(up.items())


def test_rows_counted_while_written(spark):
    rows = frame(spark, [(1,), (2,), (None,)], "id long")
    for df, which, want in ((rows, None, 3), (rows, F.col("id") > 1, 1), (rows.limit(0), None, 0), (rows.join(rows.filter("id > 5"), "id"), None, 0), (frame(spark, [], "id long").distinct(), F.col("id") > 1, 0)):
        table, path, n = shared.keep_counted(df, "counted", which)
        assert n == want and table.filter(F.lit(True) if which is None else which).count() == want
        shared.discard(spark, path)


def test_language_model_is_shipped_without_an_object_for_each_ngram(spark):
    learn = frame(spark, [(1, "the cat xylophone", "en"), (2, "le chat wagon", "fr")], "id long, text string, lang string")
    model = language.train_languages(learn)
    assert not any(isinstance(x, dict) and x for value in vars(model).values() for x in (value if isinstance(value, list) else [value]))
    shipped = pickle.loads(pickle.dumps(model))
    assert shipped.predict_all(["xylophones", "le wagon", "1"]) == model.predict_all(["xylophones", "le wagon", "1"])
    assert shipped.words == {w: i for i, w in enumerate(model.keys[0].to_pylist())} and len(shipped.grams) == 5


def test_workers_give_memory_back_when_a_task_ends(spark, tmp_path):
    """A worker lives on between tasks: what a step has freed there is the system's again, even below a block that stays."""
    taken = tmp_path / "taken"

    def size() -> int:
        return int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) // 1024

    def wanted(texts):
        before, blocks = size(), [bytes(4000) for _ in range(50_000)]
        sys.modules["kept_by_a_test"] = blocks[-1]  # lies above the others
        taken.write_text(f"{os.getpid()} {before} {size()}")
        return [True] * len(texts)

    def report(batches):
        for _ in batches:
            time.sleep(0.3)
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "mb": [size()]})

    assert shared.kept_rows(frame(spark, [("a",)], "text string").coalesce(1), "text", wanted).count() == 1
    pid, before, most = map(int, taken.read_text().split())
    assert most - before > 150
    after = {r.pid: r.mb for r in spark.range(0, 48, 1, 48).mapInArrow(report, "pid long, mb long").collect()}
    assert after[pid] - before < 60
