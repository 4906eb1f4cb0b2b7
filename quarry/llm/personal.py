"""Personal data: generators propose spans, boosted trees judge those beyond the base kinds.

Base spans (email, ip, card, phone) follow fixed patterns and are always reported. Further
generators propose overlapping spans of looser forms; trees boosted on the logistic loss, trained
on generated examples, score them by format and context; each kind's threshold is calibrated on
held-out examples to ``PRECISION``. A proposed span that overlaps a base span is dropped; of
proposed spans that overlap each other the one furthest above its threshold stays.

Defined cases: null text is empty and has no spans; repeated rows give repeated rows; equal scores
go to the span that starts first; an empty table gives an empty one; extra columns are ignored. A
text is scanned whole, in time in proportion to its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "ssn", "mac", "mail_words", "phone_local")
PRECISION = 0.95
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PROPOSE = {
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "mac": re.compile(r"(?<![0-9A-Fa-f:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:-])"),
    "mail_words": re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]{1,63})+"),
    "phone_local": re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])"),
}
CONTEXT = re.compile(r"(?i)\b(?:call|phone|tel|mobile|fax|contact|iban|account|bank|ssn|social|security|mac|device|mail|write|reach)\b")
DECOY = re.compile(r"(?i)\b(?:isbn|version|order|part|build|page|date|serial|invoice|sku|model)\b")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """In order of kind, then start."""
    out, last, p = [], 0, text.find("@")
    while p >= 0:
        if p >= last:
            i = p
            while i > last and text[i - 1] in LOCAL:
                i -= 1
            m = DOMAIN.match(text, p + 1) if i < p else None
            if m:
                out.append(("email", i, m.end()))
                last = m.end()
        p = text.find("@", p + 1)
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def span_features(text: str, kind: str, a: int, b: int) -> list[float]:
    s, around = text[a:b], text[max(0, a - 40) : a] + " " + text[b : b + 20]
    digits = [c for c in s if c.isdigit()]
    checksum = 0.0
    if kind == "iban":
        flat = s.replace(" ", "")
        checksum = float(int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1)
    if kind == "ssn":
        checksum = float(s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000")
    return [float(MORE.index(kind)), len(s), len(digits), len(set(digits)), checksum, float(bool(CONTEXT.search(around))), float(bool(DECOY.search(around))), float(sum(not c.isalnum() for c in s))]


def _examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Generated spans in context with their truth."""
    rng = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join("ka lo mi ter son vel da ru pen ost".split()[i] for i in rng.integers(0, 10, rng.integers(1, 4)))
    x, y = [], []
    for _ in range(n):
        kind, real = MORE[rng.integers(len(MORE))], bool(rng.integers(2))
        if kind == "iban":
            body = digits(18)
            check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
            s = f"DE{check:02d}{body}" if real else "DE" + digits(20)
        elif kind == "ssn":
            s = f"{rng.integers(1, 665):03d}-{rng.integers(1, 99):02d}-{rng.integers(1, 9999):04d}" if real else f"{('000', '666', '9' + digits(2))[rng.integers(3)]}-{digits(2)}-{digits(4)}"
        elif kind == "mac":
            s = ":".join(f"{v:02x}" for v in rng.integers(0, 256, 6)) if real else ":".join([f"{rng.integers(0, 2):02x}"] * 6)
        elif kind == "mail_words":
            at, dot = [("(at)", "(dot)"), ("[at]", "[dot]"), ("( at )", "( dot )")][rng.integers(3)]
            s = f"{word()}{'.' + word() if real else ''} {at} {word() if real else word()[:1]} {dot} {('com', 'org', 'net', 'edu')[rng.integers(4)] if real else word()[:1]}"
        else:
            s = f"{digits(3)}{'-. '[rng.integers(3)]}{digits(3)}-{digits(4)}"
        context = real == (rng.random() < 0.9)
        lead = [("call", "tel", "contact", "account", "mail", "phone", "write to"), ("order", "version", "part", "invoice", "serial", "the", word())][not context]
        near = f"{word()} {word()} {lead[rng.integers(len(lead))]}{(' ', ': ')[rng.integers(2)]}"
        text = f"{near}{s} {word()} ."
        x.append(span_features(text, kind, len(near), len(near) + len(s)))
        y.append(real)
    return np.array(x), np.array(y, float)


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple:
    leaf = float(g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 20:
        return (leaf,)
    best = (1e-6, None, None)
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            gain = score(left) + score(~left) - g.sum() ** 2 / (h.sum() + 1.0)
            if gain > best[0]:
                best = (gain, f, cut)
    _, f, cut = best
    if f is None:
        return (leaf,)
    left = x[:, f] <= cut
    return (f, cut, _tree(x[left], g[left], h[left], depth - 1), _tree(x[~left], g[~left], h[~left], depth - 1))


def _value(tree: tuple, row) -> float:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


@lru_cache(1)
def model(rounds: int = 25, depth: int = 3, rate: float = 0.3) -> tuple[list, dict[str, float]]:
    """(trees, thresholds by kind); the same on every executor."""
    x, y = _examples(1500, 1)
    z, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        trees.append(_tree(x, y - p, p * (1 - p), depth))
        z += rate * np.array([_value(trees[-1], r) for r in x])
    vx, vy = _examples(1000, 2)
    scores = np.array([sum(rate * _value(t, r) for t in trees) for r in vx])
    cuts = {}
    for i, kind in enumerate(MORE):
        s, truth = scores[vx[:, 0] == i], vy[vx[:, 0] == i]
        order = np.argsort(-s)
        precision = np.cumsum(truth[order]) / np.arange(1, len(s) + 1)
        good = np.flatnonzero(precision >= PRECISION)
        cuts[kind] = float(s[order][good[-1]]) if len(good) else float("inf")
    return trees, cuts


def extra_spans(text: str, base: list[tuple[str, int, int]], rate: float = 0.3) -> list[tuple[str, int, int]]:
    proposed = [(kind, *m.span()) for kind, rx in PROPOSE.items() for m in rx.finditer(text)]
    if not proposed:
        return []
    trees, cuts = model()
    taken = np.zeros(len(text) + 1, bool)
    for _, a, b in base:
        taken[a:b] = True
    judged = []
    for kind, a, b in proposed:
        row = span_features(text, kind, a, b)
        margin = sum(rate * _value(t, row) for t in trees) - cuts[kind]
        if margin >= 0:
            judged.append((-margin, a, b, kind))
    kept = []
    for _, a, b, kind in sorted(judged):
        if not taken[a:b].any():
            kept.append((kind, a, b))
            taken[a:b] = True
    return sorted(kept, key=lambda x: (MORE.index(x[0]), x[1]))


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    show = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    for f in frames:
        out = []
        for doc, text in zip(f.doc_id, f.text):
            text = text or ""
            base = base_spans(text)
            n = {k: sum(x[0] == k for x in base) for k in BASE}
            out.append((doc, *n.values(), hashlib.sha256(show(base).encode()).hexdigest(), show(base + extra_spans(text, base))))
        yield pd.DataFrame(out, columns=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def report(docs: DataFrame) -> DataFrame:
    # ids travel as strings: beside a null one, pandas would round large ones
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(_rows, "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
