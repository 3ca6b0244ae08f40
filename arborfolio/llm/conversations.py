"""Repair of damaged conversations: the cheapest edits that give turns of the form `(system? (user assistant)+)?`.

A conversation's signature has a letter per row: its role's initial (capital where the text breaks off) or that it must go
(blank, or said before). Signatures are sorted and put into a prefix trie; a node holds the layer of the dynamic program for
its prefix, which is computed once for all conversations that begin so, and a signature's last node gives its answer. Layers
keep, for each of the form's four states, the cheapest cost, the edits' rank among the layer's states (ties go to the least
string of edits) and where it came from, so that a layer's size doesn't depend on its depth. Rows are dealt out by
conversation and sorted; a task reads them as a stream, builds one trie for all its conversations (a new one beyond
`NODES` nodes) and holds the texts of one conversation at a time, on disk beyond `HELD` characters. A conversation is one
task's, however long: its repaired text has one hash, in order.

Defined results: rows go by turn, nulls first, then role and text. A null role or text is one space (so a null text is
blank), a null conversation id is one of its own. Roles other than system, user and assistant go by their first character;
an empty role has none. Repeated rows are duplicates. Texts are taken whole. An empty table gives an empty table. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
#: States of the form: nothing yet, after system, after user, after assistant; the state after one more turn by an insert.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
GONE = "x"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NODES, HELD = 200_000, 1 << 26

SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, position long, role string, text string"


class Trie:
    """Prefixes of signatures with their layers. A layer has for each state None or (cost, rank, state before, edits since)."""

    def __init__(self) -> None:
        self.root, self.size = ({}, [(0, 0, START, ""), None, None, None]), 1

    def answers(self, signatures: Iterable[str]) -> dict[str, tuple[int, str]]:
        """Cost and edits of each signature; in sorted order the path to the common prefix is already there."""
        out, path, last = {}, [self.root], ""
        for signature in sorted(set(signatures)):
            shared = next((i for i, (a, b) in enumerate(zip(last, signature, strict=False)) if a != b), min(len(last), len(signature)))
            del path[shared + 1 :]
            for letter in signature[shared:]:
                children, layer = path[-1]
                if letter not in children:
                    children[letter] = ({}, step(layer, letter))
                    self.size += 1
                path.append(children[letter])
            out[signature], last = answer([layer for _, layer in path]), signature
        return out


def inserted(state: int) -> tuple[int, int, int]:
    """The states after no, one and two inserts; more never pay."""
    return state, NEXT[state], NEXT[NEXT[state]]


def step(layer: list, letter: str) -> list:
    best: list = [None] * 4
    role, extra = letter.lower(), TRUNCATED * letter.isupper()

    def offer(state: int, *found) -> None:
        if best[state] is None or found < best[state]:
            best[state] = found

    for before, entry in enumerate(layer):
        if entry is None:
            continue
        for k, state in enumerate(inserted(before)):
            cost, since = entry[0] + INSERT * k, "I" * k
            offer(state, cost + DELETE, entry[1], since + "D", before)
            if letter == GONE:
                continue
            offer(NEXT[state], cost + REROLE + extra, entry[1], since + "R", before)
            if role == "s" and state == START:
                offer(SYSTEM, cost + extra, entry[1], since + "K", before)
            elif role == ("a" if state == USER else "u"):
                offer(NEXT[state], cost + extra, entry[1], since + "K", before)
    # Edits of one state at one row never begin those of another, so that the rank before and the edits since order them.
    ranks = {key: i for i, key in enumerate(sorted(x[1:3] for x in best if x))}
    return [x and (x[0], ranks[x[1:3]], x[3], x[2]) for x in best]


def answer(layers: list[list]) -> tuple[int, str]:
    """The least cost of a whole signature, and of its cheapest edits the least string."""
    ends = [(entry[0] + INSERT * k, entry[1], "I" * k, state) for state, entry in enumerate(layers[-1]) if entry for k, end in enumerate(inserted(state)) if end == ASSISTANT or (end == START and k == 0)]
    cost, _, tail, state = min(ends)
    parts = [tail]
    for layer in layers[:0:-1]:
        _, _, state, since = layer[state]
        parts.append(since)
    return cost, "".join(reversed(parts))


def mended(audit: str, turns: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The turns after the edits."""
    state, turns = START, iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit == "K" and role[:1] == "s":
            state = SYSTEM
        else:
            state = NEXT[state]
            if edit != "K":
                role = "user" if state == USER else "assistant"
        yield role, text


class Held:
    """The turns of one conversation, in a file beyond HELD characters."""

    def __init__(self) -> None:
        self.turns, self.size, self.file = [], 0, None

    def add(self, role: str, text: str) -> None:
        self.turns.append((role, text))
        self.size += len(text)
        if self.size > HELD:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.turns, self.file)
            self.turns, self.size = [], 0

    def __iter__(self) -> Iterator[tuple[str, str]]:
        if self.file:
            self.file.seek(0)
            while True:
                try:
                    yield from pickle.load(self.file)
                except EOFError:
                    break
        yield from self.turns


class Conversation:
    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.held, self.letters, self.seen = conv_id, Held(), [], set()
        self.faults, self.illegal, self.turns, self.before = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None, None

    def add(self, turn: int | None, role: str, text: str) -> None:
        end = text.rstrip(SPACE)[-1:]
        said = (role, text if len(text) < 64 else hashlib.blake2b(text.encode(), digest_size=16).digest())
        fault = "blank" if not end else "duplicate" if said in self.seen else "truncated" if end not in ".!?" else None
        self.seen.add(said)
        if fault:
            self.faults[fault] += 1
        initial = role[:1]
        letter = initial if initial in ("s", "u", "a") else "o"
        self.letters.append(GONE if fault in ("blank", "duplicate") else letter.upper() if fault else letter)
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if turn is not None:
            first, last, distinct = self.turns or (turn, turn, 1)
            self.turns = (first, turn, distinct + (turn != last))
        self.held.add(role, text)

    def summary(self, cost: int, audit: str) -> tuple:
        digest = hashlib.sha256()
        for i, (role, text) in enumerate(mended(audit, self.held)):
            digest.update(f"{chr(10) if i else ''}{role}:{text}".encode())
        first, last, distinct = self.turns or (0, 0, 1)
        return self.conv_id, last - first + 1 - distinct, *self.faults.values(), self.illegal, cost, audit, digest.hexdigest()


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Conversation]]:
    """Whole conversations of rows that are sorted by them, those that end in a batch together."""
    now = None
    for batch in batches:
        done = []
        for conv_id, present, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now)
                now = Conversation(conv_id)
            if present:
                now.add(turn, role, text)
        yield done
    if now is not None:
        yield [now]


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [(x.split()[0], pa.string() if x.split()[1] == "string" else pa.int64()) for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def _repair(batches: Iterator[pa.RecordBatch], turns: bool) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    for done in conversations(batches):
        signatures = ["".join(c.letters) for c in done]
        answers = trie.answers(signatures)
        if trie.size > NODES:
            trie = Trie()
        if not turns:
            if done:
                yield _rows([c.summary(*answers[s]) for c, s in zip(done, signatures, strict=True)], SUMMARY)
            continue
        rows, size = [], 0
        for c, s in zip(done, signatures, strict=True):
            for i, (role, text) in enumerate(mended(answers[s][1], c.held)):
                rows.append((c.conv_id, i, role, text))
                size += len(text)
                if size > 1 << 22:
                    yield _rows(rows, TURNS)
                    rows, size = [], 0
        if rows:
            yield _rows(rows, TURNS)


def _dealt(rows: DataFrame, present: Column | None) -> DataFrame:
    filled = rows.select("conv_id", (F.lit(True) if present is None else present).alias("present"), "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    return filled.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def audit_conversations(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """A row per conversation of rows (conv_id, turn, role, text): gaps in its turns, rows by their first fault, pairs of
    neighbours that don't follow each other, cost and initials of the cheapest edits, and the SHA-256 of the repaired
    `role:text` lines. present: rows for which it is false only name their conversation."""
    return _dealt(rows, present).mapInArrow(lambda batches: _repair(batches, False), SUMMARY)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """The repaired conversations: a row (conv_id, position, role, text) per turn."""
    return _dealt(rows, None).mapInArrow(lambda batches: _repair(batches, True), TURNS)


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Rows damaged by a hash of conversation and turn, and which of them are there: of twenty, one goes, one loses its text,
    one its sentence ends, one is said twice and one becomes the user's. Nulls are one space in the hash, role and text."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), (F.crc32(F.concat_ws(":", word("conv_id"), word("turn")).cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "kind", times.alias("time")), F.col("kind") != 0


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return audit_conversations(*damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))
