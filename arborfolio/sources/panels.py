"""Panels are long (date, asset, price); wide files are unpivoted when read and pivoted when written."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborfolio.config import DataValidationError, NotFoundError
from arborfolio.functions.columns import lenient_date, lossy_double
from arborfolio.sources import files


def require_file(path: str | Path, description: str) -> Path | str:
    found = files.located(path)
    if not files.exists(found):
        raise NotFoundError(f"{description} not found", path=str(found))
    return found


def require_frame(frame: Any, name: str) -> DataFrame:
    if not hasattr(frame, "sparkSession") or not hasattr(frame, "columns"):
        raise DataValidationError(f"{name} must be a DataFrame", type=type(frame).__name__)
    return frame


def long_panel(wide: DataFrame, minimum_assets: int = 1, date_col: str = "Date") -> DataFrame:
    """Columns date, asset, price; every column but the date's is an asset. Null prices stay, so that the calendar is whole."""
    wide = require_frame(wide, "price panel")
    assets = [c for c in wide.columns if c != date_col]
    if date_col not in wide.columns or len(assets) < minimum_assets:
        raise DataValidationError("a panel needs a date column and assets", columns=wide.columns, minimum=minimum_assets)
    flat = wide.select(lenient_date(F.col(date_col)).alias("date"), *(lossy_double(F.col(f"`{a}`")).alias(a) for a in assets))
    return flat.unpivot("date", assets, "asset", "price")


def wide_panel(panel: DataFrame, value: str = "price") -> DataFrame:
    """A row per date, a column per asset. The assets are listed on the driver, as columns need names."""
    assets = sorted(r.asset for r in panel.select("asset").distinct().collect())
    return panel.groupBy(F.col("date").alias("Date")).pivot("asset", assets).agg(F.first(value)).orderBy("Date")


def read_panel(spark: SparkSession, path: str, minimum_assets: int = 2) -> DataFrame:
    return long_panel(spark.read.parquet(path), minimum_assets)


MEMBERSHIP = ("Membership_Start", "Membership_End_Exclusive", "Price_Ticker")


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """Only the three columns are read; others are left. Records that can't be read are an error that names their lines."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    if missing := set(MEMBERSHIP) - set(raw.columns):
        raise DataValidationError("membership columns are missing", columns=sorted(missing))
    if bad := membership_problems(spark, path).orderBy("line").limit(10).collect():
        raise DataValidationError("membership records can't be read", records=[(r.line, r.reason) for r in bad])
    return membership(raw)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows file, line (from 1), value of text files. Lines are counted by the blocks in which files are read, so that no
    file has to be one task's."""
    where = ("file", "block")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    blocks = lines.groupBy(*where).agg(F.count("*").alias("n"))
    before = blocks.select(*where, (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("before"))  # a row per block
    inside = F.row_number().over(Window.partitionBy(*where).orderBy("place"))
    return lines.withColumn("inside", inside).join(before, [*where]).select("file", (F.col("before") + F.col("inside")).alias("line"), "value")


def membership_problems(spark: SparkSession, path: str) -> DataFrame:
    """Rows line, reason, record of a membership file's records that have other fields than its header, dates that aren't
    any, no start, no ticker, or an end that isn't after the start. Records are lines."""
    head = spark.read.csv(path, header=True, inferSchema=False).columns
    schema = ", ".join(f"`{c}` STRING" for c in head) + ", _bad STRING"
    lines = numbered_lines(spark, path).filter("line > 1 and trim(value) <> ''")
    read = lines.select("line", F.col("value").alias("record"), F.from_csv("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    start, end, ticker = (F.trim(F.col("x")[c]) for c in MEMBERSHIP)
    begun, ended = lenient_date(start), lenient_date(end)
    reason = (
        F.when(F.col("x._bad").isNotNull(), "fields")
        .when(F.coalesce(start, F.lit("")) == "", "no start")
        .when(begun.isNull() | (F.coalesce(end, F.lit("")) != "") & ended.isNull(), "not a date")
        .when(F.coalesce(ticker, F.lit("")) == "", "no ticker")
        .when(ended <= begun, "ends before it starts")
    )
    return read.select("line", reason.alias("reason"), "record").filter("reason is not null")


def membership(raw: DataFrame) -> DataFrame:
    """Columns start, end_excl, asset, cast strictly."""
    raw = require_frame(raw, "membership")
    if missing := {"Membership_Start", "Membership_End_Exclusive", "Price_Ticker"} - set(raw.columns):
        raise DataValidationError("membership columns are missing", columns=sorted(missing))
    return raw.select(F.col("Membership_Start").cast("date").alias("start"), F.col("Membership_End_Exclusive").cast("date").alias("end_excl"), F.col("Price_Ticker").cast("string").alias("asset"))


def read_table(spark: SparkSession, directory: str | Path, stem: str, form: str = "parquet") -> DataFrame:
    """A table of a run, from its parquet or its CSV form."""
    if form == "csv":
        return spark.read.csv(f"{directory}/{stem}.csv", header=True, inferSchema=True)
    return spark.read.parquet(f"{directory}/{stem}.parquet")


def read_metadata(directory: str | Path) -> dict[str, Any]:
    return json.loads(files.read_bytes(files.join(files.located(directory), "run_metadata.json")))


# Stand-ins for market data, from the driver's tables.


def whole_cents() -> Column:
    return F.round(F.col("l_extendedprice") * 100).cast("long")


def weekly_panel(spark: SparkSession, sf_dir: str, by: str = "p_brand") -> DataFrame:
    """date (Monday), asset, price: mean extended price of the parts with that brand or type, summed in whole cents, so that
    the order of the rows doesn't matter."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_extendedprice", "l_shipdate")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col(by).alias("asset"))
    week, cents = F.date_trunc("week", "l_shipdate").cast("date"), whole_cents()
    # price sums are made for each part before the join, which then carries a row per part and week
    sums = lines.groupBy("l_partkey", week.alias("date")).agg(F.sum(cents).alias("s"), F.count(cents).alias("n"))
    return sums.join(parts, sums["l_partkey"] == parts["p_partkey"]).groupBy("date", "asset").agg((F.sum("s") / (F.sum("n") * 100.0)).alias("price"))


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands by day of shipment."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_extendedprice", "l_shipdate")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_brand").alias("asset"))
    cents = whole_cents()
    sums = lines.groupBy("l_partkey", F.col("l_shipdate").cast("date").alias("date")).agg(F.sum(cents).alias("s"), F.count(cents).alias("n"))
    return sums.join(parts, sums["l_partkey"] == parts["p_partkey"]).groupBy("date", "asset").agg((F.sum("s") / (F.sum("n") * 100.0)).alias("price"))


def flag_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, cents = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), whole_cents()
    return lines.groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("date"), F.col("l_returnflag").alias("asset")).agg((F.sum(cents) / (F.count(cents) * 100.0)).alias("price"))


def weekly_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, cents = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), whole_cents()
    return lines.groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("date")).agg((F.sum(cents) / (F.count(cents) * 100.0)).alias("price"))


def staggered_membership(panel: DataFrame) -> DataFrame:
    """Assets enter in four waves half a year apart, every fifth leaves after 1500 days; one has no prices."""
    k = F.row_number().over(Window.orderBy("asset")) - 1  # a row per asset
    start = F.date_add(F.lit("1995-01-01").cast("date"), (k % 4) * 180)
    known = panel.select("asset").distinct().select(start.alias("start"), F.when(k % 5 == 4, F.date_add(start, 1500)).alias("end_excl"), "asset")
    return known.unionByName(known.limit(1).select(F.lit("1995-01-01").cast("date").alias("start"), F.lit(None).cast("date").alias("end_excl"), F.lit("Brand#None").alias("asset")))


def always_members(panel: DataFrame) -> DataFrame:
    return panel.select("asset").distinct().select(F.lit("1900-01-01").cast("date").alias("start"), F.lit(None).cast("date").alias("end_excl"), "asset")
