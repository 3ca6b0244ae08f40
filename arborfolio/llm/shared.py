"""What the operators share: the shared folder, intermediate tables, files written by tasks, bounded samples."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and all tasks run in the driver's machine, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder in spark.checkpoint.dir, which all machines see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines see")
        base = FALLBACK_DIR
    return f"{base.rstrip('/')}/arborfolio/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def keep_counted(df: DataFrame, name: str, which: Column | None = None) -> tuple[DataFrame, str, int]:
    """keep(), and the number of rows (of those that `which` holds for), counted while they are written: no job of its own."""
    seen = Observation()
    table, path = keep(df.observe(seen, F.count("*" if which is None else F.when(which, 1)).alias("rows")), name)
    return table, path, seen.get["rows"]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder to a path whose parent may be missing."""
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"{source} can't be renamed to {target}")


def small(table: DataFrame, most: int, rows: int | None = None) -> DataFrame:
    """The table, to be broadcast if it has `most` rows at most; rows: how many it has, if that is known."""
    return F.broadcast(table) if (table.count() if rows is None else rows) <= most else table


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a path as Spark names it."""
    if uri.startswith("/"):
        uri = f"file://{uri}"
    uri = re.sub(r"^file:/+", "file:///", uri)
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Write a whole file under a temporary name, then rename it: a task that runs twice leaves one whole file."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.partial"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(data)
    fs.move(part, path)


def read_file(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as file:
        return file.read()


def spread(names: DataFrame, column: str, each: int = 4, most: int = 100_000) -> DataFrame:
    """A table of file names dealt out, so that each task has about `each` of them (more, beyond `most` tasks)."""
    return names.repartition(max(1, min(most, -(-names.count() // each))), column)


def quota(counts: list[int], bound: int) -> float | None:
    """The rows of each label that together make `bound`, when labels with fewer give all theirs; None if all rows fit."""
    left = float(bound)
    for i, n in enumerate(sorted(counts)):
        if n * (len(counts) - i) > left:
            return left / (len(counts) - i)
        left -= n
    return None


def label_sample(df: DataFrame, key: str, label: str, bound: int) -> tuple[DataFrame, dict]:
    """About `bound` of df's rows (all, if there are no more), an equal number of each label, all rows of a label that has
    fewer; the same ones in every run: chosen by a hash of the key. Also the number of df's rows by label. A label can go
    without a row only if there are so many that bound / labels is a few rows."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    most = quota(list(counts.values()), bound)
    if most is None:
        return df, counts
    shares = df.sparkSession.createDataFrame([(k, int(min(1.0, most / n) * (1 << 31))) for k, n in counts.items()], f"`{label}` {dict(df.dtypes)[label]}, share long")
    chosen = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(17)), F.lit(1 << 31)) < F.col("share")
    return df.join(F.broadcast(shares), label).filter(chosen).select(df.columns), counts


def gives_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; at the end of its task the worker gives the system what its allocators hold and don't use. A worker
    outlives its tasks, so that an executor would else keep the most that each step took while later steps run."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
                trim(0)

    return whole


def kept_rows(docs: DataFrame, column: str, wanted: Callable[[list], list[bool]]) -> DataFrame:
    """The rows of docs, all columns, of whose values in the column wanted() says so; columns may have any names."""
    at, plain = docs.columns.index(column), docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, f"c{at}", 2 << 20):
                yield batch.filter(pa.array(wanted(batch.column(at).to_pylist()), pa.bool_()))

    return plain.mapInArrow(gives_back(run), plain.schema).toDF(*docs.columns)


def row_slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds few bytes of the column, one row at least."""
    sizes = [len(x) if x is not None else 0 for x in batch.column(column).to_pylist()] if batch.num_rows else []
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
