"""Personal data: patterns, then a skip-chain conditional random field over each document.

Patterns find the base spans (e-mail, IP address, payment card, phone). The field's nodes are the
words with a digit or an ``@`` (all others are fixed to "outside"); its labels are the kinds and
"outside". Node potentials come from hashed word shapes, chain potentials join neighbouring
nodes, and skip potentials join a word to the next word of the same document that is equal to it
or similar (same digits, or same letters and shape), however distant. Loopy sum-product messages
run over all edges at once until they settle, so evidence reaches every repeat. Words that base spans cover keep their kind as evidence; a word
outside them whose most likely label is a kind adds a span. Node weights and potentials are
estimated from a bounded sample of documents, labelled by their base spans.

Null texts count as empty: no spans. Repeated rows give repeated results, an empty table none.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flaskmill.llm import labelled
from flaskmill.llm.texts import buffer, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # the last label is "outside"
OUTSIDE = len(KINDS)

#: Documents the field is fitted on at most, and bytes of each.
FIT_DOCUMENTS = 3000
FIT_BYTES = 20_000
BITS = 12
#: Messages have settled when no log changes by more in a round.
TOLERANCE = 1e-8
#: Turns of a message after which its changes are halved once more, and how often that is done.
CALM = 8
HALVINGS = 8

_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits begins: what follows the run decides.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CUE = re.compile("[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Signs that may stand around a word without being part of it.
EDGE = ".,;:!?\"'()[]{}|<>*#%&$"
IS_CUE = np.zeros(256, bool)
IS_CUE[list(b"0123456789@")] = True


def emails(text: str):
    """Leftmost matches of the e-mail pattern: each ``@`` is looked at once."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            low = found.end()
        at = text.find("@", max(low, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in order of start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p) < 4 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


class Nodes:
    """The field's nodes of one document: words with a digit or an ``@``."""

    def __init__(self, text: str, spans: list[tuple[int, int, int]]):
        self.begin, self.end, self.place, self.word = [], [], [], []
        for place, m in enumerate(_WORD.finditer(text)):
            w = m[0]
            if _CUE.search(w):
                self.begin.append(m.start())
                self.end.append(m.end())
                self.place.append(place)
                self.word.append(w)
        self.label = [OUTSIDE] * len(self.word)
        at = 0
        for a, kind, b in spans:
            while at < len(self.word) and self.end[at] <= a:
                at += 1
            i = at
            while i < len(self.word) and self.begin[i] < b:
                if self.label[i] == OUTSIDE:
                    self.label[i] = kind
                i += 1

    def features(self, i: int) -> list[int]:
        core = self.word[i].strip(EDGE)
        digits = sum(c.isdigit() for c in core)
        shape = re.sub(r"(.)\1+", r"\1+", re.sub("[0-9]", "9", re.sub("[^\\W\\d_]", "a", core)))
        near = [
            k for k, j in (("l", i - 1), ("r", i + 1))
            if 0 <= j < len(self.word) and abs(self.place[j] - self.place[i]) == 1
        ]
        names = (
            f"s{shape[:24]}", f"d{min(digits, 24)}", f"@{core.count('@')}", f".{core.count('.')}",
            f"n{len(core) // 4}", f"p{self.word[i][:1]}", f"c{''.join(near)}",
        )
        return [int.from_bytes(hashlib.blake2b(n.encode(), digest_size=2).digest()) % (1 << BITS) for n in names]

    def edges(self) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Chain edges of neighbouring words; skip edges to the next equal or similar word."""
        chain = [(i, i + 1) for i in range(len(self.word) - 1) if self.place[i + 1] == self.place[i] + 1]
        last: dict[tuple, int] = {}
        skip = []
        for i, w in enumerate(self.word):
            low = w.lower()
            digits = re.sub("[^0-9]", "", low)
            keys = [("w", low.strip(EDGE))]
            if len(digits) >= 6:
                keys.append(("d", digits))
            if "@" in low:
                keys.append(("a", re.sub("[^a-z@]", "", low)))
            linked = set()
            for key in keys:
                j = last.get(key)
                if j is not None and j not in linked:
                    skip.append((j, i))
                    linked.add(j)
                last[key] = i
        return chain, skip


def messages(
    node: np.ndarray, edges: np.ndarray, factor: np.ndarray, rounds: int | None = None, reach: np.ndarray | None = None
) -> np.ndarray:
    """Loopy sum-product: log beliefs of nodes (n, L), given edges (e, 2) and their log factors.

    Messages go along all edges in both directions at once, damped by half, until none changes by
    ``TOLERANCE``, however many rounds that takes (``rounds`` ends it earlier). A message is sent
    again only after it or one into its source has changed, so a label that crosses a long document
    costs the edges it passes and not the whole document at each step. ``reach`` (e) has the rounds
    in which a label surely crosses an edge's document, by default twice the nodes. A message that
    still turns back after them swings around a loop: its changes are halved at every ``CALM`` turns
    and it stays in the middle of its swing after ``HALVINGS`` of them, so the rounds do end.
    On trees the beliefs are exact once messages have crossed the tree.
    """
    e = len(edges)
    if not e:
        return node - np.logaddexp.reduce(node, axis=1, keepdims=True)
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    both = np.concatenate([factor, factor.transpose(0, 2, 1)])
    opposite = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
    by_source = np.argsort(source, kind="stable")
    first = np.searchsorted(source[by_source], np.arange(len(node) + 1))
    sent = np.zeros((2 * e, node.shape[1]))
    crossed = np.tile(np.full(e, 2 * len(node)) if reach is None else reach, 2)
    way = np.zeros(sent.shape, np.int8)
    turns = np.zeros(2 * e, np.int64)
    belief = node.copy()
    active, done = np.arange(2 * e), 0
    while len(active) and done != rounds:
        done += 1
        out = (belief[source[active]] - sent[opposite[active]])[:, :, None] + both[active]
        new = np.logaddexp.reduce(out, axis=1)
        new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
        change = 0.5 ** (1.0 + turns[active] // CALM)[:, None] * (new - sent[active])
        sent[active] += change
        np.add.at(belief, target[active], change)
        large = np.abs(change) > TOLERANCE
        sign = np.where(large, np.sign(change), way[active]).astype(np.int8)
        turns[active] += (sign * way[active] < 0).any(1) & (crossed[active] < done)
        way[active] = sign
        moved = active[large.any(1)]
        # next: the messages that moved, and all that leave the nodes they went to
        at = np.unique(target[moved])
        count = first[at + 1] - first[at]
        leaving = np.arange(count.sum()) + np.repeat(first[at] - np.cumsum(count) + count, count)
        active = np.union1d(moved, by_source[leaving])
        active = active[turns[active] < CALM * HALVINGS]
    belief = node.copy()
    np.add.at(belief, target, sent)
    return belief - np.logaddexp.reduce(belief, axis=1, keepdims=True)


def fit(docs: DataFrame, documents: int = FIT_DOCUMENTS) -> dict:
    """Potentials from at most ``documents`` documents with a digit or ``@``, by their hash."""
    text = F.coalesce("text", F.lit(""))
    some = docs.select(text.alias("text")).where(
        F.col("text").rlike("[0-9@]") & (F.octet_length("text") <= FIT_BYTES)
    )
    place = F.xxhash64("text")
    different = some.agg(F.approx_count_distinct(place).alias("n")).first()["n"]
    rows = labelled.drawn(some, place, "text", different, documents).collect()
    feature, label = [], []
    pair, skips = np.ones((LABELS, LABELS)), np.ones((LABELS, LABELS))
    for row in dict.fromkeys(r["text"] for r in rows):
        nodes = Nodes(row, base_spans(row))
        chain, skip = nodes.edges()
        for table, links in ((pair, chain), (skips, skip)):
            for a, b in links:
                table[nodes.label[a], nodes.label[b]] += 1
        feature += [nodes.features(i) for i in range(len(nodes.word))]
        label += nodes.label
    weights = np.zeros((1 << BITS, LABELS))
    if not label:
        weights[:, OUTSIDE] = 1.0
        return {"weights": weights, "chain": np.zeros((LABELS, LABELS)), "skip": np.zeros((LABELS, LABELS))}
    x, y = np.asarray(feature), np.asarray(label)
    hot = np.eye(LABELS)[y]
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, 81):
        z = weights[x].sum(1)
        p = np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True))
        grad = 1e-4 * weights
        for k in range(x.shape[1]):
            np.add.at(grad, x[:, k], (p - hot) / len(y))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        weights -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    # an edge's factor: how much oftener two labels meet on it than by chance
    lift = lambda t: np.log(t / t.sum()) - np.log(t.sum(1) / t.sum())[:, None] - np.log(t.sum(0) / t.sum())[None, :]
    return {"weights": weights, "chain": lift(pair), "skip": lift((skips + skips.T) / 2)}


def added_spans(found: list[Nodes], model: dict) -> list[list[tuple[int, int, int]]]:
    """Per document the spans that the field adds to the base spans."""
    start = np.concatenate(([0], np.cumsum([len(n.word) for n in found], dtype=np.int64)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in found]
    if not start[-1]:
        return out
    feature = np.asarray([n.features(i) for n in found for i in range(len(n.word))])
    label = np.asarray([k for n in found for k in n.label])
    node = model["weights"][feature].sum(1)
    covered = label != OUTSIDE
    node[covered] = -30.0
    node[covered, label[covered]] = 0.0
    links, factors, reach = [], [], []
    for base, n in zip(start.tolist(), found, strict=False):
        for kind, pairs in zip(("chain", "skip"), n.edges(), strict=True):
            links += [(base + a, base + b) for a, b in pairs]
            factors += [model[kind]] * len(pairs)
            reach += [2 * len(n.word)] * len(pairs)
    edges = np.asarray(links, np.int64).reshape(-1, 2)
    factor = np.asarray(factors).reshape(-1, LABELS, LABELS)
    best = messages(node, edges, factor, reach=np.asarray(reach, np.int64)).argmax(1)
    for d, n in enumerate(found):
        for i in range(len(n.word)):
            kind = int(best[start[d] + i])
            if kind != OUTSIDE and n.label[i] == OUTSIDE:
                w = n.word[i]
                lead = len(w) - len(w.lstrip(EDGE))
                tail = len(w) - len(w.rstrip(EDGE))
                a, b = n.begin[i] + lead, n.end[i] - tail
                out[d].append((a, kind, b) if a < b else (n.begin[i], kind, n.end[i]))
    return out


SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "spans string, n_added long"
)


def find(docs: DataFrame, model: dict) -> DataFrame:
    """Counts and digest of the base spans of each whole text, and all spans as text."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for row, end, texts in slices(batch.column(1)):
                data, starts = buffer(texts)
                cues = np.diff(np.concatenate(([0], np.cumsum(IS_CUE[data])))[starts])
                which = np.flatnonzero(cues)
                raw = [texts[int(i)].as_py() for i in which]
                base = [base_spans(t) for t in raw]
                more = added_spans([Nodes(t, s) for t, s in zip(raw, base, strict=True)], model)
                n = end - row
                counts = np.zeros((len(KINDS), n), np.int64)
                none = hashlib.sha256(b"").hexdigest()
                digest, every, added = [none] * n, [""] * n, [0] * n
                for i, spans, extra in zip(which.tolist(), base, more, strict=True):
                    for _, kind, _ in spans:
                        counts[kind, i] += 1
                    digest[i] = hashlib.sha256(render(spans).encode()).hexdigest()
                    every[i] = render(sorted(spans + extra))
                    added[i] = len(extra)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, n), *map(pa.array, counts)]
                    + [pa.array(digest), pa.array(every), pa.array(added, pa.int64())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def detect(docs: DataFrame) -> DataFrame:
    return find(docs, fit(docs))
