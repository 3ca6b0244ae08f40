"""Personal data: the patterns as given against the linear versions, messages against enumeration, held-out texts, the query."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from arborfolio.llm import personal_data
from arborfolio.llm.entries import QUERIES
from arborfolio.llm.personal_data import KIND_OF, LABELS, Field, Graph

SF = "/root/testdata/sf0.01"
GIVEN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def given(text):
    def passes(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "card":
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            return 12 <= len(digits) <= 19 and sum(sum(map(int, str(x))) for x in doubled) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    found = [(k, *m.span()) for k, p in GIVEN.items() for m in re.finditer(p, text) if passes(k, m.group())]
    return sorted(found, key=lambda s: (s[1], list(GIVEN).index(s[0])))


@pytest.fixture(scope="module")
def model():
    return personal_data.default_model()


def test_patterns_are_those_given():
    draw = random.Random(1)
    pieces = ["a", "é", "@", ".", "-", "+", " ", "(", ")", "1", "22", "255", "256", "007", "4111111111111111", "4111-1111 1111-1111", "x@y.z", "%", "\n", "+1 (555) 555-0199", "1.2.3.4", "_"]
    for _ in range(20_000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(1, 14)))
        assert personal_data.base_spans(text) == given(text), text


def test_long_words_take_linear_time(model):
    began = time.perf_counter()
    for unit in ("a", "1", "a.", "1.", "+1", "@", "a@", "1-", "+1 ", "(1)", "0.0.0.0.", "a@b.c", "*1111 ", "5551234 "):
        model.spans([Field(unit * (200_000 // len(unit)))])
    assert time.perf_counter() - began < 60


def test_messages_are_exact_on_a_chain_and_near_on_a_loop(model):
    def enumerated(field):
        graph = Graph([field])
        own = model.weights[graph.features].sum(1)
        n, total = len(own), np.zeros((len(own), LABELS))
        for labels in itertools.product(range(LABELS), repeat=n):
            score = sum(own[i, y] + (model.chain[0, y] if graph.first[i] else 0) + (model.chain[y, 0] if graph.last[i] else 0) for i, y in enumerate(labels))
            for a, b, kind in zip(graph.source[: graph.n], graph.target[: graph.n], graph.kind[: graph.n], strict=True):
                same = KIND_OF[labels[a]] == KIND_OF[labels[b]]
                score += model.chain[labels[a], labels[b]] if kind == 2 else model.equal[kind][KIND_OF[labels[a]]] * same
            total[np.arange(n), labels] += np.exp(score)
        return total / total[0].sum(), graph.marginals(model, 60)[0]

    want, got = enumerated(Field("call (555) 555-0199 or 555-0199 x"))
    assert np.abs(want - got).max() < 0.01
    want, got = enumerated(Field("tel 555-0199 5550199 5550199"))
    assert np.abs(want - got).max() < 0.15


def test_labels_agree_over_a_document(model):
    full = "gub +1 (212) 555-0147 mo "
    for text, want in ((full + "nar 555-0147 ko", [True, False]), ("nar 555-0147 ko", []), (full + "nar 555-9999 ko", [True]), ("u kebolo@mista.org b kebolo@mista c", [True, False]), ("b kebolo@mista c", []), ("v1.2.3 of 2024-05-06 cost 12,345 #778899", [])):
        assert [s[3] for s in model.spans([Field(text)])[0]] == want, text


def test_held_out_texts(model):
    draw = random.Random(99)
    made = [personal_data.made_text(draw) for _ in range(500)]
    added = missed = wrong = 0
    for (_, want), got in zip(made, model.spans([Field(t) for t, _ in made]), strict=True):
        base, more = {s[:3] for s in got if s[3]}, {s[:3] for s in got if not s[3]}
        rest = {s for s in want if not any(b[1] < s[2] and b[2] > s[1] for b in base)}
        added, missed, wrong = added + len(rest & more), missed + len(rest - more), wrong + len(more - set(want))
    assert added >= 0.8 * (added + missed) > 100
    assert wrong <= 0.01 * added
    assert personal_data.train([]).spans([Field("a@b.c 555")]) == [[("email", 0, 5, True)]]


def test_query_equals_the_patterns(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op12_personal_data"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    extra = 0
    for r in got:
        want = given(texts[r.doc_id])
        line = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(line).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in GIVEN)
        spans = r.spans.split(",") if r.spans else []
        assert set(line) <= set(spans)
        extra += len(spans) - len(line)
    assert extra <= 0.02 * len(got)


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(1, None), (1, ""), (None, "a@b.c"), (2, " \n"), (3, "é\U0001f600 gub +1 (212) 555-0147 mo nar 555-0147 ko"), (3, "é\U0001f600 gub +1 (212) 555-0147 mo nar 555-0147 ko"), (4, "w" * 300_000 + " 1.2.3.4 " + "9" * 300_000)]
    spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, spans string, id int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id or 0, r.spans) for r in QUERIES["op12_personal_data"](spark, str(tmp_path)).collect())
    assert got == [(0, "email:0:5"), (1, ""), (1, ""), (2, ""), (3, "phone:7:24,phone:32:40"), (3, "phone:7:24,phone:32:40"), (4, "ip:300001:300008")]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op12_personal_data"](spark, f"{tmp_path}/none").count() == 0
