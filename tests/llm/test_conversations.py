"""Conversation repair against a search over all edits with whole strings, and the query against a plain loop."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from arborfolio.llm import conversations
from arborfolio.llm.entries import QUERIES

SF = "/root/testdata/sf0.01"
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(signature):
    heap, best = [(0, "", 0, 0)], None
    while heap:
        cost, edits, i, state = heapq.heappop(heap)
        if best and cost > best[0]:
            return best
        if i == len(signature) and state in (0, 3):
            best = min(best or (cost, edits), (cost, edits))
        for role in "ua":
            if (state, role) in MOVES and cost + 3 <= 4 * len(signature):
                heapq.heappush(heap, (cost + 3, edits + "I", i, MOVES[state, role]))
        if i < len(signature):
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, state))
            extra = 3 * signature[i].isupper()
            for role, edit, price in ((signature[i].lower(), "K", 0), ("u", "R", 3), ("a", "R", 3)):
                if signature[i] != "x" and (state, role) in MOVES:
                    heapq.heappush(heap, (cost + price + extra, edits + edit, i + 1, MOVES[state, role]))
    return best


def plain(rows):
    """The query's result by one loop over each conversation."""
    groups = {}
    for conv, turn, role, text in rows:
        word = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20, word(role), word(text)
        mine = groups.setdefault(conv, [])
        text = {1: "", 2: re.sub(r"[.!?]", "", text)}.get(kind, text)
        mine += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, mine in groups.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, letters = [], []
        for i, (_, role, text) in enumerate(mine):
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in [m[1:] for m in mine[:i]] else "truncated" if shown[-1] not in ".!?" else "")
            letter = role[0] if role[:1] in ("s", "u", "a") else "o"
            letters.append("x" if faults[-1] in ("blank", "duplicate") else letter.upper() if faults[-1] else letter)
        turns = {t for t, _, _ in mine if t is not None}
        cost, audit = cheapest("".join(letters))
        left, rest, state = [], iter(mine), 0
        for edit in audit:
            _, role, text = (None, None, "") if edit == "I" else next(rest)
            if edit != "D":
                initial = role[0] if edit == "K" else "a" if state == 2 else "u"
                state = MOVES[state, initial]
                left.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[initial]}:{text}")
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(map(str, out))


def test_edits_are_the_cheapest():
    draw = random.Random(5)
    signatures = ["".join(p) for n in range(4) for p in itertools.product("suaoSUAOx", repeat=n)]
    signatures += ["".join(draw.choice("suaUAxos") for _ in range(draw.randint(4, 6))) for _ in range(200)]
    got = conversations.Trie().answers(signatures)
    assert all(got[s] == cheapest(s) for s in signatures)


def test_prefixes_are_shared():
    trie = conversations.Trie()
    trie.answers(["uaua", "uau", "uauA", "uaua", "s"])
    assert trie.size == 7
    long = "ua" * 20_000
    assert conversations.Trie().answers([long, long + "u"]) == {long: (0, "K" * 40_000), long + "u": (3, "K" * 40_001 + "I")}


def test_query_equals_a_plain_loop(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(str(tuple(r)) for r in QUERIES["op13_conversation_repair"](spark, SF).collect()) == plain(rows)


def test_query_on_odd_rows(spark, tmp_path, monkeypatch):
    draw = random.Random(3)
    texts = [None, "", " \t\n", "a.", "a.", "b", "b?\n ", "é!", "x" * 100, "x" * 100 + ".", " "]
    roles = ["user", "assistant", "system", "tool", "", None, "agent"]
    rows = [(c, draw.choice([None, *range(6)]) if c != 4 else None, draw.choice(roles), draw.choice(texts)) for c in (1, 2, 3, 4, None, *range(5, 40)) for _ in range(5)]
    rows += [(50 + i, 0, "user", "only.") for i in range(60)] + [(7000, i, "user" if i % 2 else "assistant", f"{i}." * 30) for i in range(3000)]
    spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, kind int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op13_conversation_repair"](spark, str(tmp_path))
    done = lambda c: len([r for r in rows if r[0] == c]) < 100
    assert sorted(str(tuple(r)) for r in got.collect() if done(r.conv_id)) == plain([r for r in rows if done(r[0])])
    empty = [r for r in got.collect() if r.audit == ""]
    assert empty and all(r.repaired_sha256 == hashlib.sha256(b"").hexdigest() for r in empty)
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert QUERIES["op13_conversation_repair"](spark, f"{tmp_path}/none").count() == 0


def test_long_conversations_are_held_on_disk(monkeypatch):
    monkeypatch.setattr(conversations, "HELD", 50)
    held = conversations.Held()
    turns = [("user", "x" * (i % 40)) for i in range(100)]
    for t in turns:
        held.add(*t)
    assert held.file and list(held) == turns and list(held) == turns


def test_repaired_turns_have_the_form(spark):
    rows, present = conversations.damaged(spark.read.parquet(f"{SF}/conversations.parquet"))
    turns = conversations.repair_conversations(rows.filter(present))
    lines = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("position", "role", "text"))).alias("t"))
    got = {r.conv_id: [(x.role, x.text) for x in r.t] for r in lines.collect()}
    want = {r.conv_id: r.repaired_sha256 for r in QUERIES["op13_conversation_repair"](spark, SF).collect()}
    for conv, hashed in want.items():
        mine = got.get(conv, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in mine))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in mine).encode()).hexdigest() == hashed
