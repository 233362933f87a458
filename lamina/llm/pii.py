"""Personal data: base patterns, and a skip-chain conditional random field that adds spans.

The base finds emails, IPv4 addresses, card numbers and phone numbers by fixed patterns and checks.
The field then labels every candidate: the base's spans, which are observed, and other stretches that
look alike (long groups of digits, or words around an @). Neighbouring candidates of a text share
transition potentials; candidates with the same digits or letters, however far apart, are joined by
skip edges. Loopy sum-product message passing over both kinds of edge gives each candidate's
marginals, so that a number written once with all its marks labels its other mentions too. A
candidate whose marginal for a kind reaches ADD_FROM becomes a span of that kind.

Weights come from piecewise training: unary weights by a softmax on the shapes of base spans and of
other candidates, where half of the base spans are also shown with their deciding marks removed;
transition and skip potentials from counts of equal labels. The sample is bounded (sample_rows,
sample_longest); all texts are searched whole, and skip edges span whole documents.

Edge cases: null and empty texts have no spans; offsets are code points, end exclusive; spans of
different kinds may overlap; repeated rows and null ids keep one row each; without a sample the field
adds nothing but what the skip edges say; extra columns pass through redact().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, lean, prepare

by_value(__name__)

KINDS = ("email", "ip", "card", "phone")
#: Fixed values of the contract, in forms that take a time in proportion to the text: a match of IP can
#: only begin where a group of digits does, and gives no digit back.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

CANDIDATE = re.compile(r"[+(]?[0-9][0-9\x20().-]{5,}[0-9]")
AT_CHARS = re.compile(r"[^\s@<>()\[\]{},;:\"']+")
NO_AT_CHARS = frozenset("@<>()[]{},;:\"'")
DIGIT = re.compile(r"[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: A candidate becomes a span from this marginal on.
ADD_FROM = 0.9
#: Rounds of message passing at most; it ends once no message moves by SETTLED any more.
ROUNDS, SETTLED = 60, 1e-4
LABELS = 5  # none, and the kinds
FEATURES = 16


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the whole pattern would match, but from each @ outwards."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            free = m.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def _around_at(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of AT_CHARS on both sides of an @, leftmost first, from each @ outwards."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] not in NO_AT_CHARS and not text[start - 1].isspace():
            start -= 1
        if start < at and (m := AT_CHARS.match(text, at + 1)):
            free = m.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every base span, by kind and start."""
    out = []
    if "@" in text:
        out += [(0, s, e) for s, e in _emails(text)]
    if DIGIT.search(text):
        if text.count(".") >= 3:
            out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-9:] if p.lstrip("0") else "0") <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label or -1) of the base spans and of stretches that look alike, in text order."""
    nodes = [(s, e, k + 1) for k, s, e in base]
    found = [m.span() for m in CANDIDATE.finditer(text) if sum(c.isdigit() for c in m.group()) >= 7] if DIGIT.search(text) else []
    if "@" in text:
        found += list(_around_at(text))
    if found:
        taken = sorted((s, e) for _, s, e in base)
        begins = [s for s, _ in taken]
        from bisect import bisect_left

        reach, furthest = [], 0
        for _, e in taken:
            furthest = max(furthest, e)
            reach.append(furthest)
        for s, e in found:
            i = bisect_left(begins, e)
            if i == 0 or reach[i - 1] <= s:  # no base span overlaps it
                nodes.append((s, e, -1))
    return sorted(nodes)


def similarity_key(piece: str) -> str:
    """Candidates with the same key are mentions of one thing: its letters and last ten digits."""
    if "@" in piece:
        return piece.lower().strip(".")
    digits = "".join(c for c in piece if "0" <= c <= "9")
    return digits if piece.count(".") == 3 else digits[-10:]


def shape(piece: str) -> list[float]:
    digits = sum("0" <= c <= "9" for c in piece)
    dots = piece.count(".")
    return [
        1.0,
        float("@" in piece),
        float("@" in piece and "." in piece.partition("@")[2]),
        float(piece.startswith("+")),
        float("(" in piece),
        float(" " in piece),
        float("-" in piece),
        float(dots == 3),
        float(dots > 0 and dots != 3),
        float(digits < 8),
        float(8 <= digits <= 11),
        float(12 <= digits <= 15),
        float(16 <= digits <= 19),
        float(digits > 19),
        float(digits == len(piece)),
        float(16 <= digits <= 19 and luhn("".join(c for c in piece if "0" <= c <= "9"))),
    ]


@dataclass
class Field:
    unary: np.ndarray  # FEATURES x LABELS
    chain: np.ndarray  # LABELS x LABELS, log potentials
    skip: np.ndarray


def untrained() -> Field:
    return Field(np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.eye(LABELS) * 4)


def graph(texts: list[str], nodes: list[list[tuple[int, int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chain edges, skip edges (as node pairs over all texts) and the first node of each text.

    A skip edge joins each candidate to the next one with its key, so a text has as many at most as
    it has candidates.
    """
    starts = np.cumsum([0, *map(len, nodes)])
    chain, skip = [], []
    for text, own, first in zip(texts, nodes, starts, strict=False):
        last: dict[str, int] = {}
        for i, (s, e, _) in enumerate(own):
            if i:
                chain.append((first + i - 1, first + i))
            key = similarity_key(text[s:e])
            if key in last:
                skip.append((last[key], first + i))
            last[key] = first + i
    return np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2), starts


def marginals(field: Field, shapes: np.ndarray, observed: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Label marginals of every node by loopy sum-product message passing with damping."""
    score = shapes @ field.unary
    clamp = observed >= 0
    score[clamp] = -30
    score[clamp, observed[clamp]] = 0
    edges = np.concatenate([chain, skip])
    tables = np.concatenate([np.repeat(field.chain[None], len(chain), 0), np.repeat(field.skip[None], len(skip), 0)])
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
    reverse = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros((len(source), LABELS))
    for _ in range(ROUNDS if len(source) else 0):
        belief = score.copy()
        np.add.at(belief, target, message)
        out = (belief[source] - message[reverse])[:, :, None] + tables
        peak = out.max(1, keepdims=True)
        new = np.log(np.exp(out - peak).sum(1)) + peak[:, 0]
        new -= new.max(1, keepdims=True)
        moved = np.abs(new - message).max()
        message = 0.5 * message + 0.5 * new
        if moved < SETTLED:
            break
    belief = score.copy()
    np.add.at(belief, target, message)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def train(texts: list[str], steps: int = 300, agreements: float = 20.0) -> Field:
    """Piecewise training on base labels; see the module's text.

    agreements is the prior of the skip potential: so many pairs of mentions of one thing count as
    agreeing, and one as not, before the sample speaks.
    """
    rows, labels, pairs, links = [], [], [], []
    for text in texts:
        nodes = candidates(text, base_spans(text))
        known = [max(0, y) for _, _, y in nodes]
        seen: dict[str, int] = {}
        for i, (s, e, _) in enumerate(nodes):
            piece = text[s:e]
            rows.append(shape(piece))
            labels.append(known[i])
            if known[i]:  # the same thing without the marks that the base decides by, with both answers
                bare = piece.lstrip("+").replace("@", " at ", 1)
                rows += [shape(bare), shape(bare)]
                labels += [known[i], 0]
            if i:
                pairs.append((known[i - 1], known[i]))
            key = similarity_key(piece)
            if key in seen:
                links.append((seen[key], known[i]))
            seen[key] = known[i]
    if not rows:
        return untrained()
    x, y = np.array(rows), np.array(labels)
    w = np.zeros((FEATURES, LABELS))
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        w -= 0.5 * (x.T @ p / len(y) + 1e-3 * w)
    prior = np.bincount(y, minlength=LABELS) + 1.0
    prior /= prior.sum()
    chain = np.full((LABELS, LABELS), 1.0)
    for a, b in pairs:
        chain[a, b] += 1
    chain = np.log(chain / chain.sum()) - np.log(prior[:, None] * prior[None])
    agree = sum(a == b for a, b in links)
    strength = float(np.log((agree + agreements) / (len(links) - agree + 1.0) * (LABELS - 1)))
    return Field(w, np.clip(chain, -0.5, 0.5), np.eye(LABELS) * max(strength, 0.0))


def find_spans(field: Field, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text the base spans and all spans, both by kind and start."""
    base = [base_spans(t) for t in texts]
    nodes = [candidates(t, b) for t, b in zip(texts, base, strict=True)]
    open_ = [i for i, own in enumerate(nodes) if any(y < 0 for _, _, y in own)]
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if open_:
        some, own = [texts[i] for i in open_], [nodes[i] for i in open_]
        chain, skip, starts = graph(some, own)
        shapes = np.array([shape(t[s:e]) for t, ns in zip(some, own, strict=True) for s, e, _ in ns])
        observed = np.array([y for ns in own for _, _, y in ns])
        p = marginals(field, shapes, observed, chain, skip)
        for i, ns, first in zip(open_, own, starts, strict=False):
            for j, (s, e, y) in enumerate(ns):
                kind = int(p[first + j].argmax())
                if y < 0 and kind and p[first + j, kind] >= ADD_FROM:
                    added[i].append((kind - 1, s, e))
    return [(b, sorted(b + a)) for b, a in zip(base, added, strict=True)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def learn(docs: DataFrame, text: str = "text", sample_rows: int = 1000, sample_longest: int = 10_000) -> Field:
    """A field from at most sample_rows texts that hold an @ or seven digits, chosen by a hash."""
    useful = docs.where(F.col(text).isNotNull() & (F.length(text) <= sample_longest)).where(F.col(text).rlike(r"@|[0-9]{7}|\+[0-9]"))
    h = F.xxhash64(F.col(text))
    rows = useful.select(F.col(text).alias("t"), h.alias("h")).where(F.pmod(h, F.lit(1024)) < _slots(docs, sample_rows)).orderBy("h", "t").limit(sample_rows).collect()
    return train([r["t"] for r in rows])


def _slots(docs: DataFrame, rows: int) -> int:
    """Of 1024 hash slots, how many hold a few times the sample among all rows."""
    total = docs.count()
    return max(1, min(1024, -(-1024 * 16 * rows // max(1, total))))


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def detect(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans of every row; no shuffle."""
    sent = prepare(docs.sparkSession).sparkContext.broadcast(field)

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_spans(sent.value, _texts(batch, "text"))
            counts = [pa.array([sum(k == kind for k, _, _ in b) for b, _ in found], pa.int64()) for kind in range(4)]
            digest = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string())
            spans = pa.array([joined(every) for _, every in found], pa.string())
            total = pa.array([len(every) for _, every in found], pa.int64())
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, spans, total], names)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, schema)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind, as in <email>; overlapping spans become one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if start < at:
            at = max(at, end)
            continue
        out += [text[at:start], f"<{KINDS[kind]}>"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs with the spans in text masked; other columns stay as they are, null texts stay null."""
    sent = prepare(docs.sparkSession).sparkContext.broadcast(field)
    at = docs.columns.index(text)

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(at).to_pylist()
            found = find_spans(sent.value, [t or "" for t in col])
            new = [t if t is None else mask(t, s) for t, (_, s) in zip(col, found, strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(work, plain.schema).toDF(*docs.columns)
