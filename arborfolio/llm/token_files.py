"""Token ids in binary files: frequency-ranked ids, byte-aligned variable-length coding with separate control bytes.

An id is replaced by its rank (0: the most frequent over all documents, ties to the smaller id). Four ranks share a
control byte, two bits each: the rank's bytes less one. The ranks' bytes, lowest first, follow all control bytes. Decoding
looks the lengths of a control byte's four ranks up in a table of 256 rows.

Texts are encoded where they are; only their ids are shuffled, two bytes each. A folder holds ranks.bin (the ids by rank,
unsigned 32-bit), part-P-B-*.afids files, and a manifest table with a row per file: its name, its first id's place among
all ids, its number of ids. Files of tasks that ran twice aren't in the manifest and aren't read.

Defined results: null and empty texts have the end id alone. Rows are in ascending order of id, null ids first; rows with
the same id are ordered by a hash of their token ids, then by these. Repeated rows are all written. An empty table gives
an empty manifest and no rows. Only the named columns are read. White space between chunks ends a token in the
vocabularies this is made for, so that a chunk's ids don't depend on its neighbours; another tokenizer needs
whole_texts=True.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborfolio.llm.shared import discard, gives_back, keep, read_file, row_slices, shared_dir, spread, write_file

#: File mark, end id of query op7.
MAGIC, END_ID = b"AFIDS1\0\0", 2
HEAD = struct.Struct("<8sQQQQQ")
MANIFEST = "manifest.parquet"
CACHE = 300_000

LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    n = len(ranks)
    r = ranks.astype(np.uint32)
    extra = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    padded[:n] = extra
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    used = np.arange(4, dtype=np.uint8) <= extra[:, None]
    return control.tobytes(), r.astype("<u4").view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    at = ends - lengths
    body = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = body[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        out[more] |= body[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


#: The parts of a vocabulary file's rules under which a run of letters is a token group of its own.
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CASELESS = ["NFC", "Replace", "Lowercase"]
MARKS = ".,;:!?%$&*#|()[]{}\"/+=@~^_`-"


def byte_letters() -> dict[int, str]:
    """The characters that byte-level vocabularies write for bytes: printable ones for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}


class Ids(dict):
    """Ids (little-endian unsigned 32-bit integers) of the chunks met so far; others are encoded when they are asked for.

    Where the vocabulary's rules are LETTER_RUNS after CASELESS, a word of Latin letters goes to the library's model
    directly, and marks behind it are split off. Only chunks whose characters are all below U+0250, as they are in the
    text, and that hold no special token go that way: these characters have no marks to be joined with, and marks of
    ASCII begin a group of their own behind a letter. Anything else goes through the whole tokenizer, unchanged.
    lowered: chunks come from lower-case texts for which that is known.
    """

    def __init__(self, tokenizer: object, by_letters: bool, special: list[str], lowered: bool) -> None:
        super().__init__()
        self.tokenizer, self.by_letters, self.special, self.lowered, self.letters = tokenizer, by_letters, special, lowered, byte_letters()

    def whole(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = self.encoded(chunk)
        return ids

    def encoded(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if not self.by_letters:
            return self.whole(chunk)
        low = chunk
        if not self.lowered:
            if not plain(low, self.special):
                return self.whole(chunk)
            low = low.lower()
        word = low.rstrip(MARKS)
        if not word.isalpha():
            return self.whole(chunk)
        if len(word) != len(low):
            return self[word] + self[low[len(word) :]]
        spelled = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
        found = self.tokenizer.model.tokenize(spelled)
        return PACK[len(found)](*[t.id for t in found]) if len(found) < len(PACK) else np.array([t.id for t in found], "<u4").tobytes()


#: Characters that the library may join with a neighbour, or whose lower case is longer.
JOINING = re.compile("[\u0250-\U0010ffff\u0130]")
PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


def plain(text: str, special: list[str]) -> bool:
    """Whether the text's lower case gives the same ids, chunk by chunk."""
    if not text.isascii() and JOINING.search(text):
        return False
    low = text.lower()
    return not any(x in text or x.lower() in low for x in special)


class Encoder:
    """A tokenizer with the ids of the chunks seen so far."""

    def __init__(self, spec: str, whole_texts: bool) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.whole_texts = Tokenizer.from_str(spec), whole_texts
        rules = json.loads(spec)
        steps = [x["type"] for x in (rules.get("normalizer") or {}).get("normalizers", [])]
        split = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_letters = steps == CASELESS and [x.get("type") for x in split] == ["Split", "ByteLevel"] and split[0]["pattern"].get("Regex") == LETTER_RUNS and rules["model"]["type"] == "BPE"
        self.special = [x["content"] for x in rules.get("added_tokens", [])]
        self.spread = [x for x in self.special if x.split() != [x]]  # with white space: no chunk holds them
        self.forget()

    def forget(self) -> None:
        self.known = [Ids(self.tokenizer, self.by_letters, self.special, lowered) for lowered in (False, True)]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids, one text's behind the other's, and how many each has."""
        if self.whole_texts:
            found = [e.ids for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)
        if sum(map(len, self.known)) > CACHE:
            self.forget()
        way = np.zeros(len(texts), np.int8)  # 0: chunks as they are, 1: chunks in lower case, 2: no chunks
        for i, text in enumerate(texts):
            if text is None or self.by_letters and plain(text, self.special):
                way[i] = 1
            elif self.spread and any(x.lower() in text.lower() for x in self.spread):
                way[i] = 2
        sizes, parts = np.zeros(len(texts), np.int64), []
        for k in np.unique(way).tolist():
            at = np.flatnonzero(way == k)
            chosen = [texts[i] or "" for i in at.tolist()]
            if k == 2:
                found = [np.frombuffer(self.known[0].whole(t), "<u4") for t in chosen]
                ids, sizes[at] = np.concatenate(found), [len(x) for x in found]
            else:
                ids, sizes[at] = self.by_chunks([t.lower() for t in chosen] if k else chosen, self.known[k])
            parts.append((at, ids))
        if len(parts) == 1:
            return parts[0][1], sizes
        out, ends = np.zeros(int(sizes.sum()), np.uint32), np.cumsum(sizes)
        for at, ids in parts:
            out[runs(ends[at] - sizes[at], sizes[at])] = ids
        return out, sizes

    @staticmethod
    def by_chunks(texts: list[str], known: Ids) -> tuple[np.ndarray, np.ndarray]:
        """Each distinct chunk of the texts is looked up once, as a word and the marks behind it; the rest is numpy."""
        chunks = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        coded = chunks.flatten().dictionary_encode()
        units = coded.dictionary
        if known.by_letters and known.lowered:
            words = pc.utf8_rtrim(units, characters=MARKS)
            cut = pc.and_(pc.utf8_is_alpha(words), pc.not_equal(pc.binary_length(words), pc.binary_length(units)))
            behind = rests(units.filter(cut), pc.binary_length(words.filter(cut)).to_numpy()).dictionary_encode()
            units = pc.if_else(cut, words, units).dictionary_encode()
            n = len(units.dictionary)
            found = [known[x] for x in units.dictionary.to_pylist()] + [known[x] for x in behind.dictionary.to_pylist()] + [b""]
            tail = np.full(len(cut), len(found) - 1)
            tail[np.flatnonzero(cut)] = n + behind.indices.to_numpy()
            pieces = np.stack([units.indices.to_numpy(), tail], 1)[coded.indices.to_numpy()].ravel()
            offsets = 2 * chunks.offsets.to_numpy()
        else:
            found = [known[x] for x in units.to_pylist()]
            pieces, offsets = coded.indices.to_numpy(), chunks.offsets.to_numpy()
        length, body = np.array([len(x) for x in found], np.int64) // 4, np.frombuffer(b"".join(found), "<u4")
        sizes = length[pieces] if len(pieces) else np.zeros(0, np.int64)
        ends = np.append(0, np.cumsum(sizes))
        return body[runs((np.cumsum(length) - length)[pieces], sizes)] if len(pieces) else body[:0], np.diff(ends[offsets])


def rests(texts: pa.StringArray, lead: np.ndarray) -> pa.StringArray:
    """What of each text is behind its first `lead` bytes."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    sizes = np.diff(offsets) - lead
    body = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[runs(offsets[:-1] + lead, sizes)]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(body))


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of these sizes that begin at these starts."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


_ENCODERS: dict[tuple[int, bool], Encoder] = {}


def encoder_for(spec: str, whole_texts: bool) -> Encoder:
    """One encoder per worker process: what it has seen serves the tasks to come."""
    key = (zlib.crc32(spec.encode()), whole_texts)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec, whole_texts)
    return _ENCODERS[key]


def joined(ids: pa.Array, wide: np.ndarray) -> np.ndarray:
    """The numbers of a binary array's rows one behind the other; of 4 bytes in the rows that are wide, else of 2."""
    if not wide.any() or wide.all():
        offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
        body = np.frombuffer(ids.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        return body.view("<u4" if len(wide) and wide[0] else "<u2")
    return np.concatenate([np.frombuffer(x.as_buffer(), "<u4" if w else "<u2").astype(np.uint32) for x, w in zip(ids, wide, strict=True)])


def write_token_files(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block_tokens: int = 2_000_000, whole_texts: bool = False) -> str:
    """Write the folder and return its path. spec: the tokenizer's JSON. A file holds about block_tokens tokens."""
    spark = docs.sparkSession
    out = shared_dir(spark, "token-files")
    shipped = spark.sparkContext.broadcast(spec)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(shipped.value, whole_texts)
        for whole in batches:
            for batch in row_slices(whole, text_col):
                numbers, sizes = encoder.encode(batch.column(1).to_pylist())
                numbers = np.insert(numbers, np.cumsum(sizes), end_id)
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                wide = np.maximum.reduceat(numbers, ends - sizes) > 0xFFFF
                if wide.any():
                    ids = pa.array([numbers[e - n : e].astype("<u4" if w else "<u2").tobytes() for e, n, w in zip(ends.tolist(), sizes.tolist(), wide.tolist(), strict=True)], pa.binary())
                else:
                    ids = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((np.append(0, ends) * 2).astype(np.int32)), pa.py_buffer(numbers.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(wide), ids], names=["id", "n", "wide", "ids"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            c = np.bincount(joined(batch.column(1), np.array(batch.column(0))))
            if len(c) > len(total):
                c[: len(total)] += total
                total = c
            else:
                total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias(text_col))
    tokens, path = keep(rows.mapInArrow(gives_back(tokenize), "id long, n long, wide boolean, ids binary"), "tokens")
    # at most a row for each id of the vocabulary
    counts = tokens.select("wide", "ids").mapInArrow(gives_back(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    by_rank = np.array([r.id for r in sorted(counts, key=lambda r: (-r.n, r.id))], "<u4")
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    table = spark.sparkContext.broadcast(rank_of)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before, held = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids: list[int | None] = []
        sizes: list[int] = []
        body: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            control, data = encode_ranks(table.value[np.concatenate(body)])
            name = f"part-{part:06d}-{block:06d}-{uuid.uuid4().hex}.afids"
            write_file(f"{out}/{name}", pack(before, doc_ids, sizes, control, data))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64())], names=["name", "part", "before", "tokens"])

        for batch in batches:
            for doc_id, n, wide, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if held and held + n > block_tokens:
                    yield row()
                    before += held
                    block, held, doc_ids, sizes, body = block + 1, 0, [], [], []
                doc_ids.append(doc_id)
                sizes.append(n)
                body.append(np.frombuffer(ids.as_buffer(), "<u4" if wide else "<u2"))
                held += n
        if doc_ids:
            yield row()

    # rows of one id are dealt by the hash of their ids, equal rows by their place in the table
    keys = ["id", "mark", "place"]
    ordered = tokens.withColumn("mark", F.xxhash64("ids")).withColumn("place", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions("id", "mark", "wide", "ids").select("id", "n", "wide", "ids")
    written, path2 = keep(ordered.mapInArrow(gives_back(write), "name string, part int, before long, tokens long"), "token-parts")
    # a row for each partition
    bases, base = [], 0
    for r in sorted(written.groupBy("part").agg(F.sum("tokens").alias("n")).collect(), key=lambda r: r.part):
        bases.append((r.part, base))
        base += r.n
    starts = spark.createDataFrame(bases, "part int, base long")
    manifest = written.join(F.broadcast(starts), "part").select("name", (F.col("base") + F.col("before")).alias("start"), "tokens")
    manifest.write.parquet(f"{out}/{MANIFEST}")
    write_file(f"{out}/ranks.bin", by_rank.tobytes())
    discard(spark, path, path2)
    return out


def pack(before: int, doc_ids: list[int | None], sizes: list[int], control: bytes, data: bytes) -> bytes:
    there = np.array([x is not None for x in doc_ids], np.uint8).tobytes()
    body = b"".join([there, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array(sizes, "<u8").tobytes(), control, data])
    return HEAD.pack(MAGIC, before, len(doc_ids), sum(sizes), len(data), zlib.crc32(body)) + body


def unpack(raw: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the same partition before the file, whether doc ids are there, doc ids, sizes, ranks."""
    magic, before, docs, tokens, size, crc = HEAD.unpack_from(raw)
    body = memoryview(raw)[HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("damaged token file")
    controls = -(-tokens // 4)
    at = [0, docs, 9 * docs, 17 * docs, 17 * docs + controls, 17 * docs + controls + size]
    there, doc_ids, sizes, control, data = (body[a:b] for a, b in zip(at[:-1], at[1:], strict=True))
    return before, np.frombuffer(there, np.uint8) > 0, np.frombuffer(doc_ids, "<i8"), np.frombuffer(sizes, "<u8").astype(np.int64), decode_ranks(bytes(control), bytes(data), tokens)


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, start (ids before it), n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    ids_by_rank = spark.sparkContext.broadcast(np.frombuffer(read_file(f"{folder}/ranks.bin"), "<u4"))
    manifest = spark.read.schema("name string, start long, tokens long").parquet(f"{folder}/{MANIFEST}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, there, doc_ids, sizes, ranks = unpack(read_file(f"{folder}/{name}"))
                ids = ids_by_rank.value[ranks].astype("<u4")
                ends = np.cumsum(sizes)
                for a in range(0, len(sizes), 2048):
                    b = min(a + 2048, len(sizes))
                    first = ends[a] - sizes[a]
                    offsets = np.append(0, ends[a:b] - first) * 4
                    body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids[first : ends[b - 1]].tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a:b], pa.int64(), mask=~there[a:b]), pa.array(start + ends[a:b] - sizes[a:b], pa.int64()), pa.array(sizes[a:b], pa.int64()), body], names=[id_col, "start", "n_tokens", "ids"])

    return spread(manifest.select("name", "start"), "name").mapInArrow(gives_back(run), f"`{id_col}` long, start long, n_tokens long, ids binary")


def public_vocabulary(name: str = "word_bpe_49k.json", path_of: Callable[[str], str] | None = None) -> str:
    """The JSON of a public tokenizer, read where the driver runs and sent to the tasks."""
    if path_of is None:
        import public_tokenizers

        path_of = public_tokenizers.path
    return Path(path_of(name)).read_text()


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = write_token_files(docs, public_vocabulary())
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
