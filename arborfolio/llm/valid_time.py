"""Valid-time enrichment of sales: each sale gets the version of its client that was valid when it was sold, by a stateful
stream that is started anew for every batch on one checkpoint.

Time-paged state: a group of clients is one key of a transformWithState operator. Its versions and its waiting sales lie in
MapStates whose keys are days and whose values are pages (fixed-width NumPy rows); a ValueState is the directory: the days
that have a page, and how many versions each client holds. A batch opens only pages that get rows and pages up to the
horizon H: due sales drain from their pages, a lookup takes the version from the sale's own page or the nearest earlier one,
and pages below H are dropped but for each client's last version, which moves to a floor page.

Groups: clients are dealt to groups of about `group_rows` rows, so that a state's size doesn't depend on the table's. A
client with more than `split_above` rows is cut by time instead: each slice of a day or less is a key of its own, which
emits its part (best version of the slice) and its directory entry; parts and entries meet by (client, batch, slice) after
the stream. No key holds a client that may have a third of all rows. Every key gets a tick row per batch, also an empty one,
which carries the watermarks, so that waiting sales drain without new rows and nothing depends on a clock.

Defined results: null arrival means the last batch, one before the first batch the first. A sale without client or time is
emitted with its batch, and without a version; null ids stay null. Changes with a null valid_at are ignored, repeated rows
of changes are one, repeated sales are sales of their own. Versions are ordered by (valid_at, seq, change_id), nulls first,
then by op and balance. Empty tables give empty results. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from arborfolio.llm.shared import discard, keep, move, shared_dir, small

DAY = 86_400_000_000
#: The times of "always" and "never" in microseconds, and the slices of clients that are not cut and of sales without a time.
MIN, MAX = -(1 << 62), 1 << 62
WHOLE, TIMELESS = -(1 << 62), -(1 << 61)
TICK, VERSION, SALE = 0, 1, 2
#: Bits of what is null in a row.
NO_CLIENT, NO_AT, NO_ID, NO_SEQ, NO_BALANCE = 1, 2, 4, 8, 16

VERSIONS = np.dtype([("client", "i8"), ("at", "i8"), ("seq", "i8"), ("id", "i8"), ("balance", "f8"), ("op", "i4"), ("nulls", "i4")])
SALES = np.dtype([("client", "i8"), ("at", "i8"), ("id", "i8"), ("nulls", "i4")])
#: The page of each client's last version up to the horizon.
FLOOR = -(1 << 40)

FEED = "bucket long, slice long, kind int, client long, at long, id long, seq long, balance double, op string, nulls int, batch int"
_VERSION = "{0}_at long, {0}_seq long, {0}_id long, {0}_op string, {0}_balance double"
OUT = f"rec string, id long, batch long, client long, slice long, at long, n_held long, {_VERSION.format('v')}, {_VERSION.format('f')}"
DIRECTORY = "ops array<string>, who binary, held binary, versions binary, waiting binary"


def ordered(rows: np.ndarray, ops: list[str]) -> np.ndarray:
    """Versions by client and their order; what is null comes first."""
    ranks = np.zeros(len(ops) + 1, np.int64)
    ranks[np.array(sorted(range(len(ops)), key=ops.__getitem__), np.int64) + 1] = np.arange(1, len(ops) + 1)
    has = lambda bit: rows["nulls"] & bit == 0
    return rows[np.lexsort((rows["balance"], has(NO_BALANCE), ranks[rows["op"] + 1], rows["id"], has(NO_ID), rows["seq"], has(NO_SEQ), rows["at"], rows["client"]))]


def last_before(versions: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where in the ordered versions the last one of each asked row's client at or before its time is; -1 without one."""
    n, client = len(versions), np.concatenate([versions["client"], asked["client"]])
    at = np.concatenate([versions["at"], asked["at"]])
    order = np.lexsort((np.arange(len(at)) >= n, at, client))
    place = np.maximum.accumulate(np.where(order < n, np.arange(len(order)), -1))
    found = np.where(place >= 0, order[place], -1)
    found[(found >= 0) & (client[found] != client[order])] = -1
    out = np.full(len(asked), -1)
    out[order[order >= n] - n] = found[order >= n]
    out[asked["nulls"] & (NO_CLIENT | NO_AT) != 0] = -1
    return out


def last_of_each(versions: np.ndarray) -> np.ndarray:
    """The last version of each client; versions are ordered."""
    return versions[np.append(versions["client"][1:] != versions["client"][:-1], True)] if len(versions) else versions


class Directory:
    """What a key knows without opening a page: days with pages, versions held by client, the names of ops."""

    def __init__(self, row: tuple | None):
        ops, who, held, versions, waiting = row or ([], b"", b"", b"", b"")
        self.ops, self.who, self.held = list(ops), np.frombuffer(who, np.int64), np.frombuffer(held, np.int64)
        self.versions, self.waiting = ({int(d): int(n) for d, n in np.frombuffer(x, np.int64).reshape(-1, 2)} for x in (versions, waiting))

    def row(self) -> tuple:
        days = lambda x: np.array(sorted(x.items()), np.int64).tobytes()
        return self.ops, self.who.tobytes(), self.held.tobytes(), days(self.versions), days(self.waiting)

    def count(self, clients: np.ndarray, by: int) -> None:
        """Add `by` to the versions held by each of the clients, once for each time one is listed."""
        who, at = np.unique(np.concatenate([self.who, clients]), return_inverse=True)
        held = np.bincount(at, np.concatenate([self.held, np.full(len(clients), by)]), len(who)).astype(np.int64)
        self.who, self.held = who[held > 0], held[held > 0]

    def held_by(self, asked: np.ndarray) -> np.ndarray:
        if not len(self.who):
            return np.zeros(len(asked), np.int64)
        at = np.minimum(np.searchsorted(self.who, asked["client"]), len(self.who) - 1)
        return np.where((self.who[at] == asked["client"]) & (asked["nulls"] & NO_CLIENT == 0), self.held[at], 0)

    def codes(self, names: list) -> np.ndarray:
        known = {x: i for i, x in enumerate(self.ops)}
        for x in dict.fromkeys(names):
            if x is not None and x not in known:
                known[x] = len(self.ops)
                self.ops.append(x)
        return np.array([-1 if x is None else known[x] for x in names], np.int32)


class Pages:
    """Day pages of one MapState, opened when asked for; days tells which exist and how many rows each has."""

    def __init__(self, state, days: dict[int, int], kind: np.dtype):
        self.state, self.days, self.kind, self.open = state, days, kind, {}

    def get(self, day: int) -> np.ndarray:
        if day not in self.open:
            self.open[day] = np.frombuffer(self.state.getValue((day,))[0], self.kind) if day in self.days else np.empty(0, self.kind)
        return self.open[day]

    def put(self, day: int, rows: np.ndarray) -> None:
        if len(rows):
            self.state.updateValue((day,), (rows.tobytes(),))
            self.days[day] = len(rows)
        elif day in self.days:
            self.state.removeKey((day,))
            del self.days[day]
        self.open[day] = rows

    def up_to(self, day: int) -> list[int]:
        return sorted(d for d in self.days if d <= day)

    def add(self, rows: np.ndarray) -> None:
        days = rows["at"] // DAY
        for day in np.unique(days).tolist():
            self.put(day, np.concatenate([self.get(day), rows[days == day]]))


class Enrich(StatefulProcessor):
    """One key: a group of clients, or a slice of one client's time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.directory = handle.getValueState("directory", DIRECTORY)
        self.versions = handle.getMapState("versions", "day long", "page binary")
        self.waiting = handle.getMapState("waiting", "day long", "page binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = list(rows)
        ticks = pd.concat([f[f["kind"] == TICK] for f in frames]).sort_values("batch")
        for batch, horizon, late_below in zip(ticks["batch"].tolist(), ticks["at"].tolist(), ticks["seq"].tolist(), strict=True):
            yield from self._batch(key, frames, batch, horizon, late_below)
            frames = []  # the end follows the last batch at once, without rows of its own

    def _batch(self, key: tuple, frames: list[pd.DataFrame], batch: int, horizon: int, late_below: int) -> Iterator[pd.DataFrame]:
        kinds = [f["kind"].to_numpy() for f in frames]
        known = Directory(self.directory.get())
        versions, waiting = Pages(self.versions, known.versions, VERSIONS), Pages(self.waiting, known.waiting, SALES)
        whole = key[1] == WHOLE

        late = []
        for f, k in zip(frames, kinds, strict=True):
            new = _taken(f[k == VERSION], VERSIONS)
            new["op"] = known.codes(f["op"][k == VERSION].tolist())
            late.append(new[new["at"] < late_below])
            new = new[(new["at"] >= late_below) & (new["nulls"] & NO_CLIENT == 0)]
            versions.add(new)
            known.count(new["client"], 1)
        if any(len(x) for x in late):
            gone = np.concatenate(late)
            yield _frame(len(gone), rec="late", id=(gone["id"], gone["nulls"] & NO_ID == 0), batch=batch)

        due = []
        for f, k in zip(frames, kinds, strict=True):
            sales = _taken(f[k == SALE], SALES)
            now = (sales["at"] < horizon) | (sales["nulls"] & NO_AT != 0)
            due.append(sales[now])
            waiting.add(sales[~now])
        for day in waiting.up_to(horizon // DAY):
            page = waiting.get(day)
            due.append(page[page["at"] < horizon])
            waiting.put(day, page[page["at"] >= horizon])
        sold = np.concatenate(due) if due else np.empty(0, SALES)

        below = versions.up_to(horizon // DAY)
        floor = versions.get(FLOOR)
        if len(sold) and (whole or len(below)):
            pages = [versions.get(d) for d in below if whole or d != FLOOR]
            usable = ordered(np.concatenate([*pages, np.empty(0, VERSIONS)]), known.ops)
        else:
            usable = np.empty(0, VERSIONS)
        if len(sold):
            found = last_before(usable, sold)
            about = {} if whole else {"client": (sold["client"], sold["nulls"] & NO_CLIENT == 0), "slice": key[1], "at": (sold["at"], sold["nulls"] & NO_AT == 0)}
            yield _frame(len(sold), rec="sale" if whole else "part", id=(sold["id"], sold["nulls"] & NO_ID == 0), batch=batch, n_held=known.held_by(sold), **about, **_version("v", usable, found, known.ops))
        if not whole and (known.held.sum() or len(sold)):
            others = [versions.get(d) for d in known.versions if d != FLOOR and d == max(known.versions)]
            last = last_of_each(ordered(others[0], known.ops)) if others else np.empty(0, VERSIONS)
            first = lambda x: np.array([0 if len(x) else -1])
            yield _frame(1, rec="page", batch=batch, client=key[0], slice=key[1], n_held=known.held.sum() - len(floor), **_version("v", last, first(last), known.ops), **_version("f", floor, first(floor), known.ops))

        if any(d != FLOOR for d in below):
            rows_below = ordered(np.concatenate([versions.get(d) for d in below]), known.ops)
            passed = rows_below[rows_below["at"] <= horizon]
            stays = last_of_each(passed)
            known.count(passed["client"], -1)
            known.count(stays["client"], 1)
            for day in below:
                page = versions.get(day)
                versions.put(day, stays if day == FLOOR else page[page["at"] > horizon])
            if FLOOR not in below:
                versions.put(FLOOR, stays)
        self.directory.update(known.row())

    def close(self) -> None:
        pass


def _taken(f: pd.DataFrame, kind: np.dtype) -> np.ndarray:
    out = np.empty(len(f), kind)
    for name in kind.names:
        if name != "op":
            out[name] = f[name].to_numpy()
    return out


def _version(prefix: str, rows: np.ndarray, at: np.ndarray, ops: list[str]) -> dict:
    """The output columns of the rows at the given places, null where a place is -1."""
    there = at >= 0
    got = rows[np.maximum(at, 0)] if len(rows) else np.zeros(len(at), VERSIONS)
    has = lambda bit: there & (got["nulls"] & bit == 0)
    named = [ops[o] if y and o >= 0 else None for o, y in zip(got["op"].tolist(), there.tolist(), strict=True)]
    return {f"{prefix}_at": (got["at"], there), f"{prefix}_seq": (got["seq"], has(NO_SEQ)), f"{prefix}_id": (got["id"], has(NO_ID)), f"{prefix}_op": named, f"{prefix}_balance": (got["balance"], has(NO_BALANCE))}


def _frame(n: int, **columns) -> pd.DataFrame:
    """Rows of the output; a pair is values and which of them are there, what isn't given is null."""
    out = {}
    for field in OUT.split(", "):
        name, kind = field.split()
        value = columns.get(name)
        if isinstance(value, tuple):
            values, there = value
            out[name] = pd.arrays.FloatingArray(values.copy(), ~there) if kind == "double" else pd.arrays.IntegerArray(values.astype(np.int64), ~there)
        elif value is None:
            out[name] = pd.Series([None] * n, dtype=object if kind == "string" else "Float64" if kind == "double" else "Int64")
        else:
            out[name] = pd.Series(value, index=range(n)) if np.isscalar(value) else value
    return pd.DataFrame(out)


def micros(column: str | Column) -> Column:
    """Microseconds since 1970 of a time without a zone; of one with a zone, as the session's clock shows it."""
    t = F.col(column) if isinstance(column, str) else column
    days = F.datediff(F.to_date(t), F.to_date(F.lit("1970-01-01"))).cast("long")
    seconds = (F.hour(t) * 3600 + F.minute(t) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")
    return days * DAY + seconds


def day_batch(day: Column, first: int, days: int, batches: int) -> Column:
    """The number of a day's batch when `days` days from `first` on are cut into equal batches; null: the last."""
    return F.greatest(F.lit(0), F.least(F.lit(batches - 1), F.floor((day - first) * batches / days))).cast("int")


def enrich_sales(sales: DataFrame, changes: DataFrame, batches: int, delay_us: int = DAY // 2, group_rows: int = 16_000, split_above: int = 32_000) -> DataFrame:
    """Sales (sale_id, client_id, sold_at, batch) with the versions (change_id, client_id, seq, op, valid_at, balance, batch)
    that were valid when they were sold. Returns a row for each sale and each late change: rec (`sale` or `late`), id, batch
    (in which it was emitted; `batches` for what is left at the end), client_id, sold_at and n_held of sales (microseconds;
    versions the client held then), and version (struct of at, seq, id, op, balance; null without one).

    A table's watermark in a batch is its largest time of earlier batches less delay_us, H the smaller of both. Changes below
    their watermark are late. Sales below H are emitted, then of each client's versions up to H all but the last go. Files
    and state lie below spark.checkpoint.dir, in new folders at every call."""
    spark = sales.sparkSession
    seen = changes.select("change_id", "client_id", "seq", "op", "valid_at", "balance", "batch").filter("valid_at IS NOT NULL")
    flag = lambda c, bit: F.when(F.col(c).isNull(), bit).otherwise(0)
    versions = seen.select(F.lit(VERSION).alias("kind"), F.col("client_id").alias("client"), micros("valid_at").alias("at"), F.col("change_id").alias("id"), "seq", "balance", "op", (flag("client_id", NO_CLIENT) + flag("change_id", NO_ID) + flag("seq", NO_SEQ) + flag("balance", NO_BALANCE)).alias("nulls"), "batch")
    sold = sales.select(F.lit(SALE).alias("kind"), F.col("client_id").alias("client"), micros("sold_at").alias("at"), F.col("sale_id").alias("id"), F.lit(0).cast("long").alias("seq"), F.lit(0.0).alias("balance"), F.lit(None).cast("string").alias("op"), (flag("client_id", NO_CLIENT) + flag("sold_at", NO_AT) + flag("sale_id", NO_ID)).alias("nulls"), "batch")
    rows = versions.unionByName(sold)

    ends = {(r.kind, r.batch): (r.at, r.n) for r in rows.groupBy("kind", "batch").agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n for _, n in ends.values())
    groups = max(1, -(-total // group_rows))
    hot = rows.filter("client IS NOT NULL").groupBy("client").agg(F.count(F.lit(1)).alias("n"), ((F.max("at") - F.min("at")) / DAY + 1).alias("days")).filter(F.col("n") > split_above)
    hot, hot_path = keep(hot.select("client", F.floor(DAY / F.greatest(F.lit(1), F.least(F.lit(DAY), F.ceil(F.col("n") / F.col("days") / group_rows)))).cast("long").alias("width")), "sale-hot-clients")

    timeless = F.lit(TIMELESS) - F.pmod(F.xxhash64("id"), F.lit(1 << 10))
    cut = F.coalesce(F.floor(F.col("at") / F.col("width")).cast("long"), timeless)
    spread = F.when(F.col("client").isNull(), F.xxhash64("kind", "id")).otherwise(F.xxhash64("client"))
    keyed = rows.join(small(hot, 200_000), "client", "left").withColumn("slice", F.when(F.col("width").isNull(), F.lit(WHOLE)).otherwise(cut)).withColumn("bucket", F.when(F.col("width").isNull(), F.pmod(spread, F.lit(groups))).otherwise(F.col("client")))
    plain = [F.coalesce(c, F.lit(0)).alias(c) for c in ("client", "at", "id", "seq")]
    feed = keyed.select("bucket", "slice", "kind", *plain, F.coalesce("balance", F.lit(0.0)).alias("balance"), "op", "nulls", "batch")
    staged, fed, state, out = (shared_dir(spark, f"sales-{x}") for x in ("staged", "fed", "state", "out"))
    feed.write.partitionBy("batch").option("compression", "zstd").parquet(staged)

    horizons = spark.createDataFrame(_horizons(ends, batches, delay_us), "batch int, at long, seq long")
    keys = spark.read.schema(FEED).parquet(staged).groupBy("bucket", "slice").agg(F.min("batch").alias("first"))
    ticks = keys.join(F.broadcast(horizons), F.col("first") <= F.col("batch")).select("bucket", "slice", F.lit(TICK).alias("kind"), F.lit(0).cast("long").alias("client"), "at", F.lit(0).cast("long").alias("id"), "seq", F.lit(0.0).alias("balance"), F.lit(None).cast("string").alias("op"), F.lit(0).alias("nulls"), "batch")
    n_keys = keys.count() if total else 0
    if n_keys:
        ticks.write.partitionBy("batch").mode("append").option("compression", "zstd").parquet(staged)
        for batch in range(batches):
            move(spark, f"{staged}/batch={batch}", f"{fed}/batch={batch}")
            if batch == batches - 1:
                move(spark, f"{staged}/batch={batches}", f"{fed}/batch={batches}")
            _run_batch(spark, fed, state, out, n_keys)
    else:
        spark.createDataFrame([], OUT).write.parquet(out)
    discard(spark, staged, fed, state, hot_path)
    return _resolved(spark.read.schema(OUT).parquet(out))


def _horizons(ends: dict, batches: int, delay_us: int) -> list[tuple[int, int, int]]:
    """(batch, H, watermark of the changes) of each batch and of the last, which lets everything through."""
    out = []
    for batch in range(batches):
        marks = [max((at - delay_us for (kind, b), (at, _) in ends.items() if kind == k and b < batch and at is not None), default=MIN) for k in (SALE, VERSION)]
        out.append((batch, min(marks), marks[1]))
    return [*out, (batches, MAX, MIN)]


def _run_batch(spark: SparkSession, fed: str, state: str, out: str, n_keys: int) -> None:
    """Start the stream on its checkpoint, let it take what has been fed, and wait until it has ended."""
    store = {
        "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "rocksdb.changelogCheckpointing.enabled": "true",
        # a start has one batch: stores are closed behind it, and share one memory
        "unloadOnCommit": "true",
        "rocksdb.boundedMemoryUsage": "true",
        "rocksdb.maxMemoryUsageMB": "256",
        # a store asks for megabytes of disk ahead of need otherwise, each partition's for itself
        "rocksdb.allowFAllocate": "false",
    }
    settings = {f"spark.sql.streaming.stateStore.{k}": v for k, v in store.items()} | {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.shuffle.partitions": str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), n_keys))}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(FEED).parquet(fed)
        found = rows.groupBy("bucket", "slice").transformWithStateInPandas(Enrich(), OUT, "Append", "None")
        query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    query.awaitTermination()


def _resolved(out: DataFrame) -> DataFrame:
    """The stream's rows, with the parts of clients that are cut by time made whole: a part's version is the last of its own
    slice's, the last of earlier slices and the client's floor; what it holds is the sum of all slices, floors counted once."""
    version = lambda p: F.when(F.col(f"{p}_at").isNotNull(), F.struct(*(F.col(f"{p}_{c}").alias(c) for c in ("at", "seq", "id", "op", "balance"))))
    done = out.filter("rec IN ('sale', 'late')").select("rec", "id", "batch", "n_held", version("v").alias("version"))
    pages = out.filter("rec = 'page'").select("client", "batch", "slice", "n_held", version("v").alias("last"), version("f").alias("floor"))
    slices = pages.select("client", "batch", "slice", F.max("last").over(Window.partitionBy("client", "batch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    sums = pages.groupBy("client", "batch").agg(F.sum("n_held").alias("others"), F.max("floor").alias("floor"))
    parts = out.filter("rec = 'part'").select("id", "batch", "client", "slice", "at", version("v").alias("own"))
    floor = F.when(F.col("floor.at") <= F.col("at"), F.col("floor"))
    whole = parts.join(slices.hint("merge").join(sums.hint("merge"), ["client", "batch"]).hint("merge"), ["client", "batch", "slice"])
    return done.unionByName(whole.select(F.lit("sale").alias("rec"), "id", "batch", (F.col("others") + F.col("floor").isNotNull().cast("long")).alias("n_held"), F.greatest("own", "earlier", floor).alias("version")))


def op11_valid_time_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sales and late changes of the shop's tables, in eight batches over 152 days from 2024-01-01 on."""
    first, days, batches = 19_723, 152, 8
    epoch = F.to_date(F.lit("1970-01-01"))
    sales = spark.read.parquet(f"{sf_dir}/sales.parquet").select("sale_id", "client_id", "sold_at", day_batch(F.datediff(F.to_date("arrived_at"), epoch), first, days, batches).alias("batch"))
    changes = spark.read.parquet(f"{sf_dir}/client_changes.parquet").distinct()
    arrival = F.datediff(F.to_date("valid_at"), epoch) + F.coalesce(F.crc32(F.col("change_id").cast("string").cast("binary")) % 4, F.lit(0))
    got = enrich_sales(sales, changes.withColumn("batch", day_batch(arrival, first, days, batches)), batches)
    return got.select("rec", "id", F.col("batch").cast("long").alias("batch"), "n_held", F.col("version.id").alias("change_id"), F.floor(100 * F.col("version.balance") + 0.5).cast("long").alias("balance_cents"), F.col("version.op").alias("op"))
