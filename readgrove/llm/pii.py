"""Personal data in texts: fixed formats, and candidates that boosted trees select.

High-recall generators propose overlapping spans. Validators that know more than the fixed formats label
them: mail that is spelled out and comes to a domain, addresses of either version, check digits whatever
stands between the digits, national phone plans. Gradient-boosted trees, fitted on a bounded sample of
candidates, score format and context, not what the validators compute. The sample also has its own
fixed-format spans written in other formats in their places, since a corpus may hold few of these. A
candidate outside the fixed formats becomes a span if it is valid and its calibrated probability passes the
threshold of its kind; of overlapping ones the likeliest.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from ipaddress import ip_address

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in this order, and the formats of each.
KINDS = ["email", "ip", "card", "phone"]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match never starts inside a run of digits, so only the start of a run is tried
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

#: Rows: documents whose candidates are looked at for fitting, and candidates fitted on, at most.
SAMPLE_DOCS, FIT_ROWS = 20_000, 20_000
#: Groups of digits that make a candidate at most, and how far around it the context reaches.
GROUPS, AROUND = 8, 32
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
#: Share of selected candidates that must be right among those kept apart for calibration.
PRECISION = 0.99

Span = tuple[int, int, int]  # start, rank of the kind, end


# ---- fixed formats


def luhn(digits: str) -> bool:
    total = 0
    for n, digit in enumerate(reversed(digits)):
        d = int(digit) * (1 + n % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` with the run of letters before it and the domain after it, in time linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed formats, by start, then kind."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


# ---- candidates

# a run is looked at from its start only, so the time stays linear in the text
MAILBOX = re.compile(r"(?<![^\s<>\"',;:()\[\]])[^\s@<>\"',;:()\[\]]+@[^\s@<>\"',;:()\[\]]+")
AT, DOT = r"(?: ?[\[({] ?(?:at|AT) ?[\])}] ?| (?:at|AT) )", r"(?: ?[\[({] ?(?:dot|DOT) ?[\])}] ?| (?:dot|DOT) )"
SPELLED = re.compile(rf"(?<![\w.+-])[\w.+-]+{AT}[\w-]+(?:{DOT}[\w-]+)+")
NUMBERS = re.compile(r"\+?\(?[0-9](?:[ ().\-/]{0,3}[0-9])*")
COLONS = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
DIGITS = re.compile("[0-9]+")
CUES = [
    re.compile("mail|correo|write|contact|schreib|courriel", re.I), re.compile(r"\bip\b|host|server|address|adresse", re.I),
    re.compile("card|visa|carte|tarjeta|karte", re.I), re.compile("phone|tel|call|mobile|fax|anruf|appel|llam", re.I),
]
#: Ends of domains that spelled-out mail is believed of, besides those of two letters.
DOMAIN_ENDS = {"com", "org", "net", "edu", "gov", "info", "example", "test"}
#: National phone numbers: an area code in brackets or from a leading zero, or three groups of which the last has four digits.
NATIONAL = re.compile(r"\([0-9]{2,5}\)[ -]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|0[0-9]{1,4}(?:[ ./-][0-9]{2,4}){2,4}")


#: A word for a telephone with nothing but marks and blanks after it, right before a number.
CALLED = re.compile(f"(?:{CUES[3].pattern})[^0-9(]*$", re.I)


def spelled_out(body: str) -> str | None:
    """The mail address that a spelled-out one comes to, if it has a domain."""
    mail = re.sub(DOT, ".", re.sub(AT, "@", body, count=1))
    end = mail.rsplit(".", 1)[-1].lower()
    believed = end in DOMAIN_ENDS or len(end) == 2 and end.isalpha()
    return mail if believed and re.fullmatch(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", mail) else None


def valid(kind: int, body: str, before: str) -> bool:
    """Whether a candidate is that kind of personal data, by rules of its own for each kind."""
    digits = NOT_DIGIT.sub("", body)
    if kind == 0:
        if "@" not in body:
            return spelled_out(body) is not None
        local, _, domain = body.partition("@")
        labels = domain.rstrip(".").split(".")
        return bool(local) and len(labels) > 1 and all(x.replace("-", "").isalnum() for x in labels) and labels[-1].isalpha() and len(labels[-1]) > 1
    if kind == 1:
        try:
            return ip_address(body).version == 4 or len(body) > 6
        except ValueError:
            return False
    if kind == 2:
        return 14 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits)
    if body.startswith("+"):
        return 10 <= len(digits) <= 15
    return 9 <= len(digits) <= 12 and NATIONAL.fullmatch(body) is not None or 7 <= len(digits) <= 12 and CALLED.search(before[-16:]) is not None


def _number_spans(start: int, body: str) -> Iterator[Span]:
    """A run of numbers, whole and in stretches of its groups, so that a list of numbers is found number by number."""
    groups = [(m.start(), m.end()) for m in DIGITS.finditer(body)]
    for n, (first, _) in enumerate(groups):
        begin = first - (body[first - 1] in "(+" if first else 0)
        if begin and body[begin - 1] == "+":
            begin -= 1
        for _, end in groups[n : n + GROUPS]:
            count = sum(map(str.isdigit, body[first:end]))
            if count > 19:
                break
            span = body[begin:end]
            if span.count("(") != span.count(")"):
                continue
            if span.count(".") == 3 and DOTTED.fullmatch(span):
                yield start + begin, 1, start + end
            if count >= 14:
                yield start + begin, 2, start + end
            if 7 <= count <= 15:
                yield start + begin, 3, start + end


DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")


def candidates(text: str) -> list[Span]:
    """Spans that may be personal data, one kind after the other; they may overlap."""
    found = []
    if "@" in text:
        found += [(m.start(), 0, m.end()) for m in MAILBOX.finditer(text)]
    if "dot" in text or "DOT" in text:
        found += [(m.start(), 0, m.end()) for m in SPELLED.finditer(text)]
    if ":" in text:
        found += [(m.start(), 1, m.end()) for m in COLONS.finditer(text) if m.end() - m.start() > 6]
    if DIGIT.search(text):
        for m in NUMBERS.finditer(text):
            if m.end() - m.start() >= 7:
                found += _number_spans(m.start(), m[0])
    return found


def features(text: str, span: Span, others: int) -> list[float]:
    """Format and context of a candidate."""
    start, kind, end = span
    body = text[start:end]
    groups = [len(g) for g in DIGITS.findall(body)]
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    low = body.lower()
    return [
        *(float(kind == k) for k in range(4)), len(body), sum(groups), len(groups), max(groups, default=0), min(groups, default=0),
        groups[0] if groups else 0, groups[-1] if groups else 0, body.count(" "), body.count("-"), body.count("."), body.count("("), body.count(":"),
        body.count("@"), float(body.startswith("+")), float(body.startswith("(")), float(body.startswith("0")), sum(map(str.isalpha, body)), sum(map(str.isupper, body)),
        len(body) - max(body.rfind("."), low.rfind("dot ") + 3), body.rfind(".") - body.rfind("@"), float("at" in low), float("dot" in low), len({*groups}),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in " \n" or not before), float(after[:1] in " \n.," or not after),
        float(before[-2:-1].isdigit()), float(after[1:2].isdigit()), sum(map(str.isdigit, before)), sum(map(str.isdigit, after)),
        float(bool(CUES[kind].search(before))), float(others),
    ]


class Taken:
    """Disjoint stretches of a text in order, so that a meeting is found by bisection."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, _, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        n = bisect_right(self.ends, a)
        return n < len(self.starts) and self.starts[n] < b

    def add(self, a: int, b: int) -> None:
        n = bisect_right(self.starts, a)
        self.starts.insert(n, a)
        self.ends.insert(n, b)


def described(text: str) -> tuple[list[Span], np.ndarray, np.ndarray]:
    """Candidates of a text, their features, and whether they are valid."""
    spans = candidates(text)
    rows = [features(text, span, len(spans)) for span in spans]
    labels = [valid(k, text[a:b], text[max(0, a - AROUND) : a]) for a, k, b in spans]
    return spans, np.array(rows, np.float64), np.array(labels, np.int64)


def rewritten(text: str, span: Span, turn: int) -> tuple[str, Span]:
    """A text with a span of a fixed format written in another one, and the new span; ``turn`` picks the format."""
    start, kind, end = span
    body = text[start:end]
    digits = NOT_DIGIT.sub("", body)
    if kind == 0:
        at, dot = ((" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "))[turn % 3]
        name, _, domain = body.partition("@")
        labels = domain.split(".")
        if labels[-1].lower() not in DOMAIN_ENDS:
            labels[-1] = ("com", "org", "de")[turn % 3]
        new = re.sub("[^A-Za-z0-9_.+-]", "", name) + at + dot.join(labels)
    elif kind == 1:
        parts = [f"{int(p):x}" for p in body.split(".")]
        new = ("2001:db8::{}:{}:{}:{}", "fe80:0:0:0:{}:{}:{}:{}", "2a02:{}:{}:{}:{}::1")[turn % 3].format(*parts)
    elif kind == 2:
        mark = (".", "/", "  ")[turn % 3]
        new = mark.join(digits[n : n + 4] for n in range(0, len(digits), 4))
    else:
        last = digits[-10:]
        new = (f"({last[:3]}) {last[3:6]}-{last[6:]}", f"{last[:3]}-{last[3:6]}-{last[6:]}", f"0{last[1:4]} {last[4:7]} {last[7:]}")[turn % 3]
    return text[:start] + new + text[end:], (start, kind, start + len(new))


def sampled(text: str, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows to fit on: the candidates of a text, and of its rewritten spans those candidates that meet them."""
    spans, x, y = described(text)
    rows, labels = [*x], [*y]
    for n, span in enumerate(base_spans(text) if spans else []):
        other, (start, _, end) = rewritten(text, span, turn + n)
        around = max(0, start - 4 * AROUND)
        piece = other[around : end + 4 * AROUND]
        found = candidates(piece)
        for a, k, b in found:
            if a < end - around and start - around < b:
                rows.append(np.array(features(piece, (a, k, b), len(found)), np.float64))
                labels.append(int(valid(k, piece[a:b], piece[max(0, a - AROUND) : a])))
    return np.array(rows, np.float64), np.array(labels, np.int64)


# ---- boosted trees


@dataclass
class Boosted:
    """Trees of equal depth: per level and node a feature and a bound, then a value per leaf."""

    start: float = 0.0
    trees: list[tuple[list[np.ndarray], list[np.ndarray], np.ndarray]] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0
    #: Calibrated probability from which on a candidate of each kind is selected; above 1: never.
    bounds: list[float] = field(default_factory=lambda: [2.0] * len(KINDS))

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, bound, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for f, b in zip(feature, bound, strict=True):
                node = 2 * node + (x[np.arange(len(x)), f[node]] > b[node])
            out += leaf[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.logit(x) + self.shift)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Second-order boosting of the log loss over histograms of the features."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col) for c, col in zip(cuts, x.T, strict=True)], axis=1)
    n_features = x.shape[1]
    logit = np.full(len(x), model.start)
    for _ in range(TREES):
        p = _sigmoid(logit)
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(x), np.int64)
        feature, bound = [], []
        for level in range(DEPTH):
            size = 1 << level
            best, f_best, b_best = np.full(size, 1e-9), np.zeros(size, np.int64), np.full(size, np.inf)
            for f in range(n_features):
                if not len(cuts[f]):
                    continue
                cell = node * BINS + binned[:, f]
                g = np.bincount(cell, grad, size * BINS).reshape(size, BINS).cumsum(axis=1)
                h = np.bincount(cell, hess, size * BINS).reshape(size, BINS).cumsum(axis=1)
                left = g**2 / (h + 1)
                right = (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1)
                gain = (left + right - g[:, -1:] ** 2 / (h[:, -1:] + 1))[:, : len(cuts[f])]
                at = gain.argmax(axis=1)
                top = gain[np.arange(size), at]
                better = top > best
                best[better], f_best[better], b_best[better] = top[better], f, cuts[f][at[better]]
            feature.append(f_best)
            bound.append(b_best)
            node = 2 * node + (x[np.arange(len(x)), f_best[node]] > b_best[node])
        size = 1 << DEPTH
        leaf = -RATE * np.bincount(node, grad, size) / (np.bincount(node, hess, size) + 1)
        model.trees.append((feature, bound, leaf))
        logit += leaf[node]
    return model


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray) -> None:
    """Platt's line for the logits, and the bound of each kind, on rows kept apart."""
    z, target = model.logit(x), np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * z + b)
        w = np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, np.array([((p - target) * z).sum(), (p - target).sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    if np.isfinite(a) and np.isfinite(b) and a > 0:
        model.slope, model.shift = float(a), float(b)
    p = model.probability(x)
    for k in range(len(KINDS)):
        of = x[:, k] == 1
        order = np.argsort(-p[of], kind="stable")
        right = np.cumsum(y[of][order]) / np.arange(1, of.sum() + 1)
        good = np.flatnonzero(right >= PRECISION)
        model.bounds[k] = max(0.5, float(p[of][order][good[-1]])) if len(good) else 2.0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, fit_rows: int = FIT_ROWS) -> Boosted:
    """Trees for the candidates of ``docs``; the driver gets at most ``fit_rows`` rows of features.

    Without candidates of both labels nothing is learned, and no candidate is selected.
    """
    every = max(1, -(-docs.count() // sample_docs))
    key = F.xxhash64(F.col(id_col))
    texts = docs.where(F.pmod(key, F.lit(every)) == 0).select(key.alias("key"), F.col(text_col).cast("string").alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, text in zip(frame["key"], frame["text"], strict=True):
                x, y = sampled(text or "", key % 3)
                out += [(key, n, int(y[n]), x[n]) for n in range(len(y))]
            yield pd.DataFrame(out, columns=["key", "n", "y", "x"])

    rows = texts.mapInPandas(run, "key long, n int, y int, x array<double>")
    rows = rows.orderBy(F.xxhash64("key", "n"), "key", "n", "y", "x").limit(fit_rows).collect()
    y = np.array([r["y"] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return Boosted()
    x = np.array([r["x"] for r in rows])
    apart = np.arange(len(y)) % 4 == 3
    if len(set(y[~apart].tolist())) < 2:
        apart[:] = False
    model = boost(x[~apart], y[~apart])
    if apart.any():
        calibrate(model, x[apart], y[apart])
    return model


def added_spans(text: str, base: list[Span], model: Boosted) -> list[Span]:
    """Selected valid candidates that meet no span of the fixed formats, the likeliest first where they overlap."""
    taken, added = Taken(base), []
    spans = candidates(text)
    free = [s for s in spans if not taken.meets(s[0], s[2]) and valid(s[1], text[s[0] : s[2]], text[max(0, s[0] - AROUND) : s[0]])]
    if not free:
        return []
    p = model.probability(np.array([features(text, s, len(spans)) for s in free], np.float64))
    # of about equally likely ones the longer
    for n in sorted(range(len(free)), key=lambda i: (-round(p[i], 2), free[i][0] - free[i][2], free[i])):
        a, k, b = free[n]
        if p[n] >= model.bounds[k] and not taken.meets(a, b):
            taken.add(a, b)
            added.append((a, k, b))
    return added


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` per row of ``docs``.

    Counts and digest are of the fixed formats; ``spans`` has these and the selected candidates. Null
    text is empty; empty texts have no spans; whole texts are read; rows come back as often as
    given, null ids too; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, **options))

    def row(text: str) -> tuple:
        base = base_spans(text)
        added = added_spans(text, base, shared.value)
        counts = [sum(k == n for _, k, _ in base) for n in range(len(KINDS))]
        return *counts, hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(base + added), len(added)

    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    types = [*([pa.int64()] * len(KINDS)), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(text.as_py() or "") for text in batch.column(1)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {counts}, base_sha256 string, spans string, n_added long")
    return out.select(F.col("id").alias(id_col), *names)
