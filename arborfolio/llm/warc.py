"""WARC archives with resolved revisits.

Only headers (payload digest, id, place of the row) are shuffled, by digest: of each group of equal payloads of at least
min_bytes the record with the smallest id is the response, the others are revisit records that refer to it. The places of
the revisits go to small files, one for each block of ROWS rows of an input file, and the archives are then written where
the pages are read, in their order: a task looks its blocks up and no payload is shuffled. Rows that aren't those of a
Parquet file (of a join, say) are written to a table first, which gives them a place. Each record is a gzip member with
fresh headers. A manifest table names the files of the archive; files of tasks that ran twice aren't in it.

Read back, a revisit gets what its record doesn't hold by a join with the response that it refers to.

Defined results: a null payload is an empty one. Null ids come after all others in a group. Of repeated rows with equal
id and payload one is the response and the others revisit it. A null url has no target header; bytes of a url that are not
printable ASCII are percent-encoded. An empty table gives no files and no rows. Only the named columns are read, whatever
else there is. A payload is held whole by the task that writes it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborfolio.llm.shared import discard, filesystem, keep, read_file, row_slices, shared_dir, small, spread, write_file

#: Fixed values of the WARC 1.1 format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROLL = 16 << 20
MANIFEST = "manifest.parquet"
#: Rows of an input file whose revisits are in one file; first records that are broadcast at most.
ROWS, BROADCAST_FIRSTS = 1_000_000, 200_000


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts))).urn}>"


def encode_uri(url: str) -> str:
    return "".join(chr(b) if 32 < b < 127 else f"%{b:02X}" for b in url.encode())


def make_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def members(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of every gzip member."""
    view, at = memoryview(raw), 0
    while at < len(view):
        unpacker, parts, end = zlib.decompressobj(31), [], at
        while not unpacker.eof:
            if end >= len(view):
                raise ValueError("the archive ends inside a record")
            parts.append(unpacker.decompress(view[end : end + 65536]))
            end = min(end + 65536, len(view))
        yield at, b"".join(parts)
        at = end - len(unpacker.unused_data)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if lines[0] != VERSION or rest[len(block) :] != b"\r\n\r\n" or len(block) != int(headers["Content-Length"]):
        raise ValueError("damaged record")
    return headers, block


def reads_files(df: DataFrame) -> bool:
    """Whether df's rows are those of Parquet files, each once at most, so that file and place name a row."""
    todo = [df._jdf.queryExecution().analyzed()]
    if not todo[0].deterministic():
        return False
    while todo:
        node = todo.pop()
        if node.nodeName() not in ("Project", "Filter", "SubqueryAlias", "LogicalRelation"):
            return False
        todo += [node.children().apply(i) for i in range(node.children().size())]
    try:
        return bool(df.select("_metadata.file_path", "_metadata.row_index").columns)
    except AnalysisException:  # a format without places
        return False


def revisits(heads: DataFrame) -> DataFrame:
    """heads: id, digest, bucket, row. Rows bucket, row, first_id, for the rows whose payload another one is the response of."""
    place = F.struct(F.col("id").isNull().alias("none"), "id", "bucket", "row")
    firsts = heads.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    firsts, _ = keep(firsts, "warc-firsts")  # a table, so that a join can split the rows of a digest that many pages have
    both = heads.join(small(firsts, BROADCAST_FIRSTS), "digest").filter((F.col("bucket") != F.col("first.bucket")) | (F.col("row") != F.col("first.row")))
    return both.select("bucket", "row", F.col("first.id").alias("first_id"))


def write_places(found: DataFrame, folder: str) -> None:
    """A file for each bucket: rows in order, whether the first record has an id, and the id."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def close() -> None:
            rows, there, ids = (np.concatenate([h[k] for h in held]) for k in range(3))
            write_file(f"{folder}/{name}", b"".join([np.int64(len(rows)).tobytes(), rows.tobytes(), ids.tobytes(), there.tobytes()]))

        for batch in batches:
            buckets = np.array(batch.column(0).to_pylist())
            cuts = np.append(np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])), len(buckets)) if len(buckets) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if name is not None and buckets[a] != name:
                    close()
                    held = []
                name, first = buckets[a], batch.column(2).slice(a, b - a)
                held.append((batch.column(1).slice(a, b - a).to_numpy(), first.is_valid().to_numpy(zero_copy_only=False), first.fill_null(0).to_numpy()))
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64())], names=["n"])

    found.repartition("bucket").sortWithinPartitions("bucket", "row").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def read_places(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first ids and whether they are there; nothing if the bucket has no revisit."""
    fs, path = filesystem(uri)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    raw = read_file(uri)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n), np.frombuffer(raw, bool, n, 8 + 16 * n)


def write_archives(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str | None = None, date_col: str | None = None) -> str:
    """Write a record per row of pages and return the folder. date_col: times of capture (of type timestamp); date: the
    WARC-Date of records without one, now if None."""
    spark = pages.sparkSession
    out, places = shared_dir(spark, "warc"), shared_dir(spark, "warc-places")
    stamp = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    # the time zone is the session's, in which the time is written in the same way in all runs
    when = F.date_format(F.to_utc_timestamp(F.col(date_col), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col else F.lit(None).cast("string")
    columns = [F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"), when.alias("date")]
    paths = []
    if not reads_files(pages):
        rows, path = keep(pages.select(*columns), "warc-pages")
        paths.append(path)
        columns = [F.col(c) for c in rows.columns]
    else:
        rows = pages
    row = F.col("_metadata.row_index")
    bucket = F.md5(F.concat_ws("/", F.col("_metadata.file_path"), F.floor(row / ROWS).cast("string")))
    rows = rows.select(*columns, bucket.alias("bucket"), row.alias("row"))
    heads = rows.filter(F.octet_length("payload") >= min_bytes).select("id", F.unhex(F.sha1("payload")).alias("digest"), "bucket", "row")
    heads, path = keep(heads, "warc-heads")
    paths.append(path)
    write_places(revisits(heads), places)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, files, known = TaskContext.get().partitionId(), [], 0, 0, ("", None)

        def close() -> pa.RecordBatch:
            name = f"part-{part:06d}-{files:04d}-{uuid.uuid4().hex}.warc.gz"
            write_file(f"{out}/{name}", b"".join(held))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64())], names=["name", "records"])

        for whole in batches:
            for batch in row_slices(whole, "payload"):
                for page_id, url, body, time, block, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if known[0] != block:
                        known = (block, read_places(f"{places}/{block}"))
                    again, first_ids, there = known[1]
                    k = int(np.searchsorted(again, at))
                    to = None if k == len(again) or again[k] != at else (int(first_ids[k]) if there[k] else None,)
                    digest = base32_sha1(body)
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                    own = record_id(page_id, digest, block, at) if to or len(body) < min_bytes else record_id(page_id, digest)
                    headers = [("WARC-Type", "revisit" if to else "response"), ("WARC-Record-ID", own), ("WARC-Date", time or stamp), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
                    headers += [("WARC-Target-URI", encode_uri(url))] if url is not None else []
                    headers += [("X-Page-ID", str(page_id))] if page_id is not None else []
                    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(to[0], digest))] if to else []
                    held.append(make_record(headers, http if to else http + body))
                    size += len(held[-1])
                    if size >= ROLL:
                        yield close()
                        held, size, files = [], 0, files + 1
        if held:
            yield close()

    rows.mapInArrow(write, "name string, records long").write.parquet(f"{out}/{MANIFEST}")
    discard(spark, places, *paths)
    return out


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record: file, offset, record_id, record_type, page_id, url, payload_digest, payload_bytes, refers_to_id
    (of a record), payload (null for revisits, or if payloads is False). Digests of payloads that are there are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["file", "offset", "record_id", "record_type", "page_id", "url", "payload_digest", "payload_bytes", "refers_to_id", "payload"]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for offset, data in members(read_file(f"{folder}/{path}")):
                    h, block = parse_record(data)
                    there = h["WARC-Type"] == "response"
                    body = block.partition(b"\r\n\r\n")[2] if there else None
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if there and base32_sha1(body) != digest:
                        raise ValueError(f"{path}: payload and digest differ at {offset}")
                    rows.append((path, offset, h["WARC-Record-ID"], h["WARC-Type"], int(h["X-Page-ID"]) if "X-Page-ID" in h else None, h.get("WARC-Target-URI"), digest, len(body) if there else None, h.get("WARC-Refers-To"), body if payloads else None))
                    size += len(data) if payloads else 400
                    if size > 4 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    names = spark.read.schema("name string, records long").parquet(f"{folder}/{MANIFEST}").select("name")
    return spread(names, "name").mapInArrow(run, "file string, offset long, record_id string, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to_id string, payload binary")


def resolve(records: DataFrame) -> DataFrame:
    """Give revisits the bytes and the page of the response that they refer to: adds refers_to, fills payload_bytes."""
    originals = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("original_bytes"))
    again = records.filter("record_type = 'revisit'").join(originals, "refers_to_id", "left").withColumn("payload_bytes", F.col("original_bytes")).drop("original_bytes")
    return records.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(again)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return resolve(read_archives(spark, folder, payloads=False).drop("payload")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
