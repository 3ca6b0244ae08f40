"""Result tables and run directories, on any file system that Spark writes to."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from arborfolio.sources import files

#: Tables of one variant; edges are written as parquet only.
VARIANT_TABLES = ("daily_returns", "monthly_returns", "rebalance_weights", "allocation_diagnostics", "network_edges", "rebalance_diagnostics", "membership_audit", "metrics")


MANIFEST = "manifest.json"


def write_table(df: DataFrame, directory: str | Path, stem: str, csv: bool = True) -> None:
    """zstd parquet, and from it CSV with a header; fails if the table is there."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{directory}/{stem}.parquet")
    if csv:
        written = df.sparkSession.read.schema(df.schema).parquet(f"{directory}/{stem}.parquet")
        written.write.mode("errorifexists").option("header", True).csv(f"{directory}/{stem}.csv")


def write_variant(result: Any, directory: str | Path, prefix: str, variant: str) -> None:
    for name in VARIANT_TABLES:
        if (table := getattr(result, name)) is not None:
            if "variant" in table.columns:
                table = table.filter(table["variant"] == variant).withColumnRenamed("variant", "Strategy")
            write_table(table, directory, f"{prefix}_{name}", csv=name != "network_edges")


def write_benchmark(result: Any, directory: str | Path) -> None:
    for name, table in (("daily", result.daily), ("monthly", result.monthly), ("metrics", result.metrics)):
        write_table(table, directory, f"SP100_Benchmark_{name}")


@contextmanager
def new_run(output_root: str | Path, months: int, now: datetime | None = None) -> Iterator[tuple[Path | str, Path | str]]:
    """A folder to write a run to, and the one that it becomes when the block ends: run_{UTC time}_months{n}, which must not
    be there. Until then the run is under a name that no reader takes for a run's, and it is deleted if the block fails: a
    run is there as a whole or not at all. Its manifest lists what it has, in bytes."""
    stamp = (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%SZ")
    name, root = f"run_{stamp}_months{months}", files.located(output_root)
    place, staging = files.join(root, name), files.join(root, f"partial_{name}_{uuid.uuid4().hex}")
    if files.exists(place):
        raise FileExistsError(str(place))
    files.make_folder(staging)
    try:
        yield staging, place
        files.write_bytes(files.join(staging, MANIFEST), json.dumps(files.sizes_in(staging), indent=2).encode())
        files.rename(staging, place)
    except BaseException:
        files.delete(staging)
        raise


def is_whole(directory: str | Path) -> bool:
    """Whether a run's folder has what its manifest lists."""
    place = files.located(directory)
    if not files.exists(files.join(place, MANIFEST)):
        return False
    listed, there = json.loads(files.read_bytes(files.join(place, MANIFEST))), files.sizes_in(place)
    return all(there.get(name) == size for name, size in listed.items())


def write_metadata(directory: str | Path, metadata: dict[str, Any]) -> None:
    files.write_bytes(files.join(files.located(directory), "run_metadata.json"), json.dumps(metadata, indent=2, default=str).encode())
