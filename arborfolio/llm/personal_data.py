"""Personal data: emails, IP addresses, card and phone numbers by pattern, and more spans by a skip-chain conditional random
field, whose labels agree over a document.

Tokens are runs of other characters than whitespace; those without a digit or an @ are never part of an entity, so that
the field's graph has the others alone: neighbours are linked in a chain (a plain word between two of them is a fixed
label), and a token is linked with the last one before it that repeats it (same digits, or seven last ones; same name before
an @) or whose last four digits it shows behind a mask. Linking each to the last one only keeps the links few however often
a token is repeated; labels still pass from one to all. Linked tokens share a potential for their kinds. Loopy sum-product
messages run over all links of a batch's documents at once until they settle (`ROUNDS` at most); the field is trained by the
gradient of its likelihood, with the messages' marginals as expectations.

Labelled texts are made by rule, as no table marks personal data: entities in the patterns' forms and repeats of them in
others (a phone number without its country, an email without its end, a card's last digits), numbers after a telling word,
and as many that are none of these (versions, dates, amounts, orders, keys, cards whose digits don't add up).

Defined results: a null text is empty; rows with equal or null ids are rows of their own. Spans are in code points, ends
exclusive. Patterns' spans are always returned; the field's are added where its probability is `SURE` and no pattern's span
is touched. Texts are read whole, in time linear in their length, however long their words. An empty table gives an empty
table. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborfolio.llm.shared import row_slices

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is outside; kind k begins with label 1 + 2k and goes on with 2 + 2k.
#: WIDTH: features of a token.
LABELS, BUCKETS, WIDTH, ROUNDS, SURE = 9, 1 << 12, 12, 12, 0.9
KIND_OF = np.array([0, 1, 1, 2, 2, 3, 3, 4, 4])
#: Kinds of links between tokens.
REPEAT, MASKED = 0, 1

# The given patterns, written so that no start is tried twice over the same run of characters.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
SPACE = frozenset(" \t\n\x0b\x0c\r")
GAP = re.compile(r"[\x20\x09-\x0D]")
NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start and kind; matches that fail their check are dropped and not tried again."""
    found: list[Span] = []
    if "@" in text:
        end = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                found.append(("email", start, m.end()))
                end = m.end()
    for m in IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m.group().split("."))):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def tokens(text: str) -> list[tuple[int, int]]:
    """Where the tokens with a digit or an @ are. Each is walked over once."""
    out, end = [], 0
    for m in MARK.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and text[start - 1] not in SPACE:
            start -= 1
        gap = GAP.search(text, m.end())
        end = gap.start() if gap else len(text)
        out.append((start, end))
    return out


def word_before(text: str, at: int, until: int) -> tuple[str, int]:
    """The word that ends before a place (lower-cased, letters only, 20 at most), and where it starts."""
    while at > until and text[at - 1] in SPACE:
        at -= 1
    end = at
    while at > until and end - at < 20 and text[at - 1] not in SPACE:
        at -= 1
    return "".join(filter(str.isalpha, text[at:end])).lower(), at


def word_after(text: str, at: int) -> str:
    while at < len(text) and text[at] in SPACE:
        at += 1
    end = at
    while end < len(text) and end - at < 20 and text[end] not in SPACE:
        end += 1
    return "".join(filter(str.isalpha, text[at:end])).lower()


SHAPES = ((re.compile(r"[0-9]{7,}"), "9+"), (re.compile(r"[0-9]"), "9"), (re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"[^a9+@.()\-:/*#]+"), "_"))
PLAIN = LOCAL - frozenset("._%+-")


class Field:
    """The graph of one document: tokens with their features, links, and the patterns' spans."""

    def __init__(self, text: str) -> None:
        self.base = base_spans(text)
        self.spans: list[tuple[int, int]] = []
        self.features: list[list[int]] = []
        self.follows: list[bool] = []
        self.links: list[tuple[int, int, int]] = []
        self.repeats: dict[str, int] = {}
        self.tails: dict[str, int] = {}
        found = tokens(text)
        runs: list[list[tuple[int, int]]] = []
        for span in found:
            if runs and not text[runs[-1][-1][1] : span[0]].strip(" \t\n\x0b\x0c\r"):
                runs[-1].append(span)
            else:
                runs.append([span])
        before = 0
        for run in runs:
            self._add(text, run, before)
            before = run[-1][1]

    def _add(self, text: str, run: list[tuple[int, int]], before: int) -> None:
        last, at = word_before(text, run[0][0], before)
        words = [f"p{last}", f"q{word_before(text, at, before)[0]}", f"n{word_after(text, run[-1][1])}"]
        cores = []
        for start, end in run:
            while start < end - 1 and not (text[start] in PLAIN or text[start] in "@+(*"):
                start += 1
            while start < end - 1 and not (text[end - 1] in PLAIN or text[end - 1] == ")"):
                end -= 1
            cores.append((start, end))
        shapes = [shape(text[a:b]) for a, b in cores]
        for i, ((a, b), shown) in enumerate(zip(cores, shapes, strict=True)):
            core, me = text[a:b], len(self.spans)
            digits = NOT_DIGIT.sub("", core)
            by_pattern = next(self._near(a, b), None)
            tag = f"{by_pattern[0]}{'B' if by_pattern[1] >= a else 'I'}" if by_pattern else "none"
            near = f"{shapes[i - 1] if i else ''}|{shown}|{shapes[i + 1] if i + 1 < len(shapes) else ''}"
            said = ["bias", f"s{shown}", f"r{near}", f"b{tag}", f"b{tag}s{shown}", f"i{min(i, 3)}", f"d{min(len(digits), 20)}", f"l{12 <= len(digits) <= 19 and luhn(digits)}", *words, f"{words[0]}d{min(len(digits), 20) // 3}"]
            self.features.append([zlib.crc32(x.encode()) % BUCKETS for x in said])
            self.spans.append((a, b))
            self.follows.append(i > 0)
            if "@" in core:
                self._link(me, f"@{core.partition('@')[0].lower()}", REPEAT)
            elif by_pattern and by_pattern[0] == "phone":
                if by_pattern[2] <= b:
                    self._link(me, NOT_DIGIT.sub("", text[by_pattern[1] : by_pattern[2]])[-7:], REPEAT)
            elif len(digits) >= 5:
                self._link(me, digits[-7:], REPEAT)
                self.tails[digits[-4:]] = me
            elif len(digits) == 4 and ("*" in text[a - 1 : b] or "x" in core.lower()):
                if digits in self.tails:
                    self.links.append((self.tails[digits], me, MASKED))

    def _near(self, a: int, b: int) -> Iterator[Span]:
        """The patterns' spans that touch a place; places are asked in order."""
        self.passed = getattr(self, "passed", 0)
        while self.passed < len(self.base) and self.base[self.passed][2] <= a:
            self.passed += 1
        for s in self.base[self.passed :]:
            if s[1] >= b:
                break
            if s[2] > a:
                yield s

    def _link(self, me: int, key: str, kind: int) -> None:
        if key in self.repeats:
            self.links.append((self.repeats[key], me, kind))
        self.repeats[key] = me

    def labels(self, spans: Iterable[Span]) -> list[int]:
        out, known = [], sorted(spans, key=lambda s: s[1])
        for a, b in self.spans:
            hit = next((s for s in known if s[1] < b and s[2] > a), None)
            out.append(0 if hit is None else 1 + 2 * KINDS.index(hit[0]) + (hit[1] < a))
        return out


def shape(core: str) -> str:
    for pattern, to in SHAPES:
        core = pattern.sub(to, core)
    return core if len(core) <= 40 else f"{core[:20]}~{len(core).bit_length()}"


class Graph:
    """The fields of many documents as one: features by token, and links both ways."""

    def __init__(self, fields: list[Field]) -> None:
        sizes = [len(f.spans) for f in fields]
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        self.features = np.array([x for f in fields for x in f.features], np.int32).reshape(sum(sizes), WIDTH)
        follows = np.array([x for f in fields for x in f.follows], bool)
        self.first, chain = ~follows, np.flatnonzero(follows)
        skip = np.array([(a + s, b + s, k) for f, s in zip(fields, self.starts, strict=False) for a, b, k in f.links], np.int64).reshape(-1, 3)
        forward = np.concatenate([np.stack([chain - 1, chain, np.full(len(chain), 2)], 1), skip])
        self.source, self.target = np.concatenate([forward[:, 0], forward[:, 1]]), np.concatenate([forward[:, 1], forward[:, 0]])
        self.kind, self.n = np.concatenate([forward[:, 2], forward[:, 2]]), len(forward)
        self.last = np.append(~follows[1:], True)[: len(follows)] if len(follows) else follows

    def marginals(self, model: Model, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of each token, and of each forward link's pair of labels."""
        own = model.weights[self.features].sum(1)
        own[self.first] += model.chain[0]
        own[self.last] += model.chain[:, 0]
        n, links = len(own), len(self.source)
        potential = np.empty((links, LABELS, LABELS))
        for k in (REPEAT, MASKED):
            potential[self.kind == k] = model.shared(k)
        ahead = np.arange(links) < self.n
        potential[(self.kind == 2) & ahead] = model.chain
        potential[(self.kind == 2) & ~ahead] = model.chain.T
        message, back = np.zeros((links, LABELS)), np.concatenate([np.arange(self.n, links), np.arange(self.n)]).astype(int)
        belief = own.copy()
        for _ in range(rounds if links else 0):
            new = _log_sum((belief[self.source] - message[back])[:, :, None] + potential, 1)
            new = 0.5 * message + 0.5 * (new - _log_sum(new, 1)[:, None])
            moved, message = np.abs(new - message).max(), new
            belief = own.copy()
            np.add.at(belief, self.target, message)
            if moved < 1e-3:
                break
        pairs = (belief[self.source] - message[back])[: self.n, :, None] + (belief[self.target] - message)[: self.n, None, :] + potential[: self.n]
        flat = pairs.reshape(self.n, LABELS * LABELS)
        return np.exp(belief - _log_sum(belief, 1)[:, None]).reshape(n, LABELS), np.exp(flat - _log_sum(flat, 1)[:, None]).reshape(pairs.shape)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Model:
    """Weights of features by label, of neighbouring labels, and of equal kinds by the kind of link."""

    def __init__(self) -> None:
        self.weights, self.chain, self.equal = np.zeros((BUCKETS, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((2, 5))
        label = np.arange(LABELS)
        goes_on = (label % 2 == 0) & (label > 0)
        #: What goes on without a beginning is ruled out.
        self.chain[:, goes_on] = -30
        for k in np.flatnonzero(goes_on):
            self.chain[[k - 1, k], k] = 0

    def shared(self, link: int) -> np.ndarray:
        same = KIND_OF[:, None] == KIND_OF[None, :]
        return np.where(same, self.equal[link][KIND_OF][:, None], 0.0)

    def spans(self, fields: list[Field]) -> list[list[tuple[str, int, int, bool]]]:
        """Each document's spans by start and kind, and whether a pattern gave them."""
        graph = Graph(fields)
        sure = graph.marginals(self)[0] if len(graph.features) else np.empty((0, LABELS))
        out = []
        for i, f in enumerate(fields):
            out.append(sorted([(*s, True) for s in f.base] + [(*s, False) for s in self._added(f, sure[graph.starts[i] : graph.starts[i + 1]])], key=lambda s: (s[1], KINDS.index(s[0]), s[2])))
        return out

    @staticmethod
    def _added(f: Field, sure: np.ndarray) -> Iterator[Span]:
        best, kind, start, end = sure.argmax(1).tolist(), 0, 0, 0
        f.passed = 0
        likely = [sure[i, 1 + 2 * (KIND_OF[b] - 1) : 3 + 2 * (KIND_OF[b] - 1)].sum() >= SURE if b else False for i, b in enumerate(best)]
        groups: list[list] = []
        for i, (b, fine) in enumerate(zip(best, likely, strict=True)):
            if b and b % 2 == 0 and groups and groups[-1][0] == KIND_OF[b] and groups[-1][2] == i - 1:
                groups[-1][2:] = [i, groups[-1][3] and fine]
            elif b:
                groups.append([KIND_OF[b], i, i, fine])
        for kind, i, j, fine in groups:
            start, end = f.spans[i][0], f.spans[j][1]
            if fine and next(f._near(start, end), None) is None:
                yield KINDS[kind - 1], start, end


def made_text(draw: random.Random) -> tuple[str, list[Span]]:
    """A labelled text by rule."""
    parts: list[tuple[str, str | None]] = []
    number = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    name = lambda: "".join(draw.choice(("ba", "ker", "lo", "mi", "sta", "ten", "ri", "vo", "en", "sh")) for _ in range(draw.randint(1, 4)))
    fill = lambda: [parts.append((name() + draw.choice(("", "", "", ",", ".")), None)) for _ in range(draw.randint(2, 7))]

    def card(good: bool) -> str:
        body = draw.choice("3456") + number(14)
        check = next(c for c in "0123456789" if luhn(body + c))
        return body + (check if good else str((int(check) + draw.randint(1, 9)) % 10))

    for _ in range(draw.randint(1, 4)):
        fill()
        about = draw.random()
        if about < 0.2:
            country, a, b, c = draw.choice(("1", "44", "49", "33")), number(3), number(3), number(4)
            parts.append((draw.choice((f"+{country} ({a}) {b}-{c}", f"+{country} {a} {b} {c}", f"+{country}-{a}-{b}-{c}", f"+{country}{a}{b}{c}")), "phone"))
            for _ in range(draw.choice((0, 1, 1, 2))):
                fill()
                parts.append((draw.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{b}-{c}", f"{a}{b}{c}", f"{b}{c}")), "phone"))
        elif about < 0.3:
            parts.append((draw.choice(("tel", "phone", "call", "fax", "mobile", "Tel.:")), None))
            parts.append((draw.choice((f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}")), "phone"))
        elif about < 0.45:
            user, host = f"{name()}.{number(2)}" if draw.random() < 0.5 else name() + name(), name()
            parts.append((f"{user}@{host}.{draw.choice(('com', 'org', 'example.net'))}", "email"))
            for _ in range(draw.choice((0, 1))):
                fill()
                parts.append((draw.choice((f"{user}@{host}", f"{user}@{name()}".upper())), "email"))
        elif about < 0.55:
            parts.append((".".join(str(draw.randint(0, 255)) for _ in range(4)), "ip"))
        elif about < 0.68:
            whole = card(True)
            parts.append((whole if draw.random() < 0.7 else "-".join(whole[i : i + 4] for i in range(0, 16, 4)), "card"))
            for _ in range(draw.choice((0, 1, 1))):
                fill()
                parts.append((draw.choice((f"****{whole[-4:]}", f"xxxx-{whole[-4:]}", f"****-****-****-{whole[-4:]}")), "card"))
        else:
            draw_date = f"20{number(2)}-0{draw.randint(1, 9)}-{draw.randint(10, 28)}"
            parts.append((draw.choice((number(draw.randint(1, 12)), card(False), f"{number(3)}-{number(4)}", f"v{number(1)}.{number(2)}.{number(1)}", draw_date, f"{number(2)}:{number(2)}", f"{number(3)}.{number(2)}", f"{number(2)},{number(3)}", f"#{number(6)}", f"@{name()}", f"{name()}@{name()}", f"{number(3)}.{draw.randint(256, 999)}.{number(3)}.{number(3)}", f'"{"".join(draw.choice("0123456789abcdef") for _ in range(32))}"', f"****{number(4)}", f"{name()}{number(2)}", f"978-{number(1)}-{number(5)}-{number(3)}-{number(1)}", f"{number(1)}.", f"({number(3)})", f"{number(3)}-{number(2)}-{number(4)}", number(16), f"{number(3)}-{number(3)}-{number(4)}")), None))
    fill()
    text, spans = "", []
    for part, kind in parts:
        text += " " if text else ""
        if kind:
            spans.append((kind, len(text), len(text) + len(part)))
        text += part + (draw.choice(("", "", "", "###", "!!", ",", ".", "%%%")) if kind else "")
    return text, spans


def train(texts: list[tuple[str, list[Span]]], steps: int = 150, rate: float = 0.5, prior: float = 1e-4) -> Model:
    """Fitted to labelled texts: adaptive gradient steps on their likelihood, all texts at once."""
    model, fields = Model(), [Field(t) for t, _ in texts]
    graph = Graph(fields)
    if not len(graph.features):
        return model
    truth = np.array([x for f, (_, spans) in zip(fields, texts, strict=True) for x in f.labels(spans)])
    observed = np.zeros((len(truth), LABELS))
    observed[np.arange(len(truth)), truth] = 1
    a, b, kind = truth[graph.source[: graph.n]], truth[graph.target[: graph.n]], graph.kind[: graph.n]
    sums = [np.zeros_like(x) for x in (model.weights, model.chain, model.equal)]
    same = KIND_OF[:, None] == KIND_OF[None, :]
    for _ in range(steps):
        nodes, pairs = graph.marginals(model, ROUNDS // 2)
        by_label, by_pair, by_kind = np.zeros_like(model.weights), np.zeros_like(model.chain), np.zeros_like(model.equal)
        off = observed - nodes
        for column in graph.features.T:
            np.add.at(by_label, column, off)
        np.add.at(by_pair, (a[kind == 2], b[kind == 2]), 1)
        by_pair -= pairs[kind == 2].sum(0)
        by_pair[0] += off[graph.first].sum(0)
        by_pair[:, 0] += off[graph.last].sum(0)
        for k in (REPEAT, MASKED):
            agree = (KIND_OF[a] == KIND_OF[b]) & (kind == k)
            np.add.at(by_kind[k], KIND_OF[a[agree]], 1)
            by_kind[k] -= [(pairs[kind == k] * (same & (KIND_OF == j)[:, None])).sum() for j in range(5)]
        for x, gradient, seen in zip((model.weights, model.chain, model.equal), (by_label, by_pair, by_kind), sums, strict=True):
            gradient = gradient - prior * len(truth) * np.where(x > -20, x, 0)
            seen += gradient**2
            x += np.where(x > -20, rate * gradient / np.sqrt(seen + 1e-8), 0)
    return model


def default_model(n: int = 800, seed: int = 12) -> Model:
    draw = random.Random(seed)
    return train([made_text(draw) for _ in range(n)])


def find_personal_data(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents' ids with all spans of personal data: kind, start, end (code points, exclusive), and base: whether a
    pattern gave it."""
    plain = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = plain.schema["id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, "text"):
                found = shared.value.spans([Field(t) for t in batch.column("text").to_pylist()])
                rows = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in spans] for spans in found]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(span))], names=["id", "spans"])

    return plain.mapInArrow(run, f"id {kind}, spans array<struct<kind string, start long, end long, base boolean>>").withColumnRenamed("id", id_column)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents. Counts and base_sha256 are of the patterns' spans."""
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
    base = F.filter("spans", lambda s: s["base"])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
