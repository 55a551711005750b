"""Personal data by weak supervision.

Fixed patterns give the base spans (email, ip, card, phone), which always stay. Wider patterns propose candidates. Each
candidate gets a vote (yes, no, abstain) from three labelers - a strict pattern, a gazetteer, the words
before it. Expectation-maximisation (Dawid and Skene, two classes) estimates from vote counts over the whole corpus how
reliable each labeler is for each kind; the posteriors train a logistic span classifier on votes and shape; candidates that
it accepts and that touch no base span are added.

A candidate is described by a small integer code (kind, votes, shape), so the statistics over any corpus are a table of at
most ``N_CODES`` rows. Offsets are code points, ends exclusive. Null text is empty. Rows are independent: repeated rows
and null ids give a row each, an empty table gives an empty result and a model that accepts no candidate.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import map_batches, texts_of

BASE = ("email", "ip", "card", "phone")
#: Kinds in the order of the output.
KINDS = (*BASE, "secret", "id")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# candidates beyond the base patterns
# of any length: possessive or walked once, so time is linear
_VEILED_HOST = re.compile(r"\s?[(\[{]\s?at\s?[)\]}]\s?[A-Za-z0-9-]++(?:\s?(?:[(\[{]\s?dot\s?[)\]}]|\.)\s?[A-Za-z0-9-]++)+", re.I)
_VEILED_MARK = re.compile(r"[(\[{]\s?at", re.I)
_VEILED_LOCAL = _LOCAL | frozenset("\u0130\u0131\u017f\u212a")  # letters without regard to case
_ASSIGNED = re.compile(r"\b(?:password|passwd|pwd|token|secret|api[_-]?key)\s?[:=]\s?[\"']?([^\s\"',;]{6,}+)", re.I)
_OPAQUE = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+")
_LOCAL_CALL = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_NUMBERED = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")

#: Gazetteers (fixed values): what speaks for a kind, and what speaks against it.
_FOR = {
    "email": frozenset("com org net edu gov info io de fr es uk eu".split()),
    "ip": frozenset(),
    "card": ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65"),
    "phone": ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91"),
    "secret": ("AKIA", "ASIA", "ghp_", "sk_", "xox", "eyJ"),
    "id": frozenset(),
}
_AGAINST = {"ip": ("0.0.0.0", "127.0.0.1", "255.255.255.255")}
#: Context words (fixed values) within ``CONTEXT`` characters before a span.
CONTEXT = 40
_WORDS = {
    "email": re.compile(r"mail|contact|write|address|kontakt|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr|client|login", re.I),
    "card": re.compile(r"card|visa|master|credit|karte|tarjeta|carte|payment", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|fax|contact|whatsapp", re.I),
    "secret": re.compile(r"password|passwd|pwd|token|secret|api.?key|credential", re.I),
    "id": re.compile(r"ssn|social|iban|account|passport|tax|konto|cuenta", re.I),
}
_OTHER = re.compile(r"version|order|invoice|isbn|chapter|page|section|figure|part no", re.I)
_SHAPES = 8
N_CODES = len(KINDS) * 27 * _SHAPES


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        host = _HOST.match(text, at + 1) if begin < at else None
        free = host.end() if host else at + 1
        if host:
            out.append((begin, free))
        at = text.find("@", free)
    return out


def _veiled(text: str) -> list[tuple[int, int]]:
    out, free, m = [], 0, _VEILED_HOST.search(text)
    while m:
        begin = m.start()
        while begin > free and text[begin - 1] in _VEILED_LOCAL:
            begin -= 1
        if begin < m.start():
            free = m.end()
            out.append((begin, free))
        m = _VEILED_HOST.search(text, max(free, m.start() + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Candidates of the wider patterns."""
    out = []
    if _VEILED_MARK.search(text):
        out += [("email", *s) for s in _veiled(text)]
    if "=" in text or ":" in text:
        out += [("secret", *m.span(1)) for m in _ASSIGNED.finditer(text)]
    if _DIGIT.search(text):
        out += [("secret", *m.span()) for m in _OPAQUE.finditer(text) if _DIGIT.search(m[0]) and re.search("[A-Za-z]", m[0])]
        out += [("phone", *m.span()) for m in _LOCAL_CALL.finditer(text)]
        out += [("id", *m.span()) for m in _NUMBERED.finditer(text)]
    return out


def _strict(kind: str, span: str, base: bool) -> int:
    if base:
        return 1
    if kind == "secret":
        return 1 if re.fullmatch(r"[0-9a-f]{16,}|[A-Z0-9]{16,}|[A-Za-z0-9+/_=-]{24,}", span) else 0
    if kind == "id":
        return 1
    return -1 if kind in ("ip", "card") else 0


def _listed(kind: str, span: str) -> int:
    if span in _AGAINST.get(kind, ()):
        return -1
    if kind == "email":
        return 1 if re.split(r"[.\s)\]}]+", span.lower())[-1] in _FOR[kind] else -1
    if kind in ("card", "phone"):
        return 1 if re.sub("[^0-9]", "", span).startswith(_FOR[kind]) else -1
    if kind == "secret":
        return 1 if span.startswith(_FOR[kind]) else 0
    return 0


def code_of(text: str, kind: str, begin: int, end: int, base: bool) -> int:
    """Kind, votes and shape as one number below ``N_CODES``."""
    span, before = text[begin:end], text[max(0, begin - CONTEXT) : begin]
    context = 1 if _WORDS[kind].search(before) else -1 if _OTHER.search(before) else 0
    votes = (_strict(kind, span, base), _listed(kind, span), context)
    digits = sum(map(str.isdigit, span))
    shape = (len(span) >= 20) + 2 * (2 * digits >= len(span)) + 4 * (end >= len(text) or not text[end].isalnum())
    return ((KINDS.index(kind) * 3 + votes[0] + 1) * 9 + (votes[1] + 1) * 3 + votes[2] + 1) * _SHAPES + shape


def candidates(text: str) -> list[tuple[int, int, int, bool, int]]:
    """(kind, start, end, base, code) of every base span and of every proposal that touches none."""
    base = base_spans(text)
    begins, ends = [], []  # disjoint and sorted
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(b, ends[-1])
        else:
            begins.append(a)
            ends.append(b)
    out = [(KINDS.index(k), a, b, True, code_of(text, k, a, b, True)) for k, a, b in base]
    for kind, a, b in sorted(proposals(text), key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        at = bisect_left(begins, b)
        if not at or ends[at - 1] <= a:
            begins.insert(at, a)
            ends.insert(at, b)
            out.append((KINDS.index(kind), a, b, False, code_of(text, kind, a, b, False)))
    return sorted(out)


_SPANS = "array<struct<kind:int,start:int,end:int,base:boolean,code:int>>"


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, spans): the candidates of each document, in one pass and without a shuffle."""
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("code", pa.int32())]))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [[dict(zip(("kind", "start", "end", "base", "code"), c)) for c in candidates(t)] for t in texts_of(b)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, one, f"doc_id long, spans {_SPANS}")


@dataclass(frozen=True)
class SpanModel:
    """Which codes are personal data; ``reliability`` has P(vote agrees) of each kind and labeler, for inspection."""

    accepted: tuple[int, ...]
    reliability: tuple[tuple[float, ...], ...]


def _parts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shape, rest = codes % _SHAPES, codes // _SHAPES
    votes = np.stack([rest // 9 % 3, rest // 3 % 3, rest % 3], axis=1) - 1
    return rest // 27, votes, shape


def expectation_maximisation(votes: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(P(span is personal data) of each row of votes, P(vote right) of each labeler); abstentions carry no weight."""
    right, prior = np.full(votes.shape[1], 0.8), 0.7
    for _ in range(rounds):
        yes = np.log(prior) + np.where(votes > 0, np.log(right), np.where(votes < 0, np.log(1 - right), 0)).sum(axis=1)
        no = np.log(1 - prior) + np.where(votes > 0, np.log(1 - right), np.where(votes < 0, np.log(right), 0)).sum(axis=1)
        p = 1 / (1 + np.exp(no - yes))
        agree = np.where(votes > 0, p[:, None], np.where(votes < 0, 1 - p[:, None], 0))
        cast = (votes != 0) * weight[:, None]
        # two agreeing and one opposing vote beforehand keep estimates inside (0, 1) and better than chance
        right = np.clip(((agree * weight[:, None]).sum(axis=0) + 4) / (cast.sum(axis=0) + 5), 0.55, 0.99)
        prior = np.clip((p @ weight + 1) / (weight.sum() + 2), 0.05, 0.95)
    return p, right


def train(counts: dict[int, int]) -> SpanModel:
    """From candidates counted by code: EM within each kind, then the classifier over all kinds."""
    if not counts:
        return SpanModel((), tuple((0.8,) * 3 for _ in KINDS))
    codes = np.array(sorted(counts))
    weight = np.array([counts[c] for c in codes], float)
    kind, votes, shape = _parts(codes)
    soft, reliability = np.zeros(len(codes)), []
    for k in range(len(KINDS)):
        own = kind == k
        right = np.full(3, 0.8)
        if own.any():
            soft[own], right = expectation_maximisation(votes[own], weight[own])
        reliability.append(tuple(float(x) for x in right))
    every = np.arange(N_CODES)
    x_of = lambda k, v, s: np.concatenate([np.eye(len(KINDS))[k], (v > 0), (v < 0), np.stack([s & 1, s >> 1 & 1, s >> 2 & 1], axis=1)], axis=1).astype(float)
    x, w = x_of(kind, votes, shape), np.zeros(len(KINDS) + 9)
    share = np.log1p(weight) / np.log1p(weight).sum()
    for _ in range(2000):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 4.0 * (x.T @ ((p - soft) * share) + 1e-4 * w)
    accepted = every[1 / (1 + np.exp(-x_of(*_parts(every)) @ w)) >= 0.5]
    return SpanModel(tuple(int(c) for c in accepted), tuple(reliability))


def fit(annotated: DataFrame) -> SpanModel:
    """A model from the candidates of all documents; the driver gets at most ``N_CODES`` counts."""
    rows = annotated.select(F.explode("spans.code").alias("code")).groupBy("code").count().collect()
    return train({r["code"]: r["count"] for r in rows})


def kept_spans(model: SpanModel) -> Column:
    """The base spans and the accepted candidates, in order."""
    accepted = F.array(*[F.lit(c) for c in model.accepted]) if model.accepted else F.array().cast("array<int>")
    return F.filter("spans", lambda s: s["base"] | F.array_contains(accepted, s["code"]))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """``docs`` with every kept span replaced by its kind in brackets; null texts stay null."""
    accepted, schema = frozenset(model.accepted), docs.schema

    def clean(text: str) -> str:
        out, free = [], 0
        for kind, a, b, base, code in sorted(candidates(text), key=lambda c: (c[1], -c[2])):
            if base or code in accepted:
                if a >= free:
                    out += [text[free:a], f"[{KINDS[kind].upper()}]"]
                free = max(free, b)
        return "".join([*out, text[free:]])

    at = schema.names.index(text_col)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(b.columns)
        columns[at] = pa.array([None if t is None else clean(t) for t in b.column(at).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays(columns, b.schema.names)

    return map_batches(docs, one, schema)
