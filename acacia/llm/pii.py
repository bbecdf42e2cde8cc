"""Personal data by weak supervision.

Candidate spans come from the base patterns (which always count) and from the method's own
patterns. Three kinds of labelers vote on each candidate: a regex labeler on its form, a gazetteer
labeler on words in or beside it, and a context labeler on the ``CONTEXT`` characters before it. Over all
documents the candidates are counted by kind and votes; for every kind, expectation-maximisation on those
counts estimates each labeler's reliability, and a logistic span classifier is trained on the posteriors. A
candidate of the method's own is kept from a probability of one half on.

The labelers are small on purpose: forms are checks of digits, prefixes and separators, the gazetteer is a
list of some 120 given names and of words that mark a value as a made-up one, and the context is a list of
words for each kind in four languages.

What is gathered is one row for each combination of kind, votes and features, however large the
corpus is.

Defined cases: null and empty texts have no spans; texts are searched whole, in time that grows with
their length; of candidates that overlap, all that pass are reported; repeated rows are reported one by
one; an empty table gives no rows, and a classifier that keeps every candidate; positions are code points,
ends exclusive; other columns are kept in ``redacted`` and ignored in ``report``.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
#: The method's own kinds, after the base kinds in all orders.
OWN_KINDS = ("secret", "iban", "name", "ssn")
KINDS = BASE_KINDS + OWN_KINDS

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A match of either pattern begins at the first digit of a digit run, and its parts end where their runs end.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_SECRET = re.compile(r"\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b\s{0,3}[=:]\s{0,3}[\"']?([^\s\"']{6,}+)", re.I)
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b")
_NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.?\x20([A-ZÀ-Þ][a-zß-ÿ]++(?:[\x20-][A-ZÀ-Þ][a-zß-ÿ]++)?)(?![A-Za-zÀ-ÿ])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Cheap signs that one of the method's patterns may match.
_SECRET_SIGNS = ("passw", "pwd", "secret", "token", "api", "access")
_NAME_SIGNS = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Señor", "Monsieur", "Madame")
_IBAN_SIGN = re.compile(r"[0-9](?<=[A-Z]{2}[0-9])[0-9]")
#: Given names of the gazetteer, in four languages.
_FIRST_NAMES = frozenset(
    "adam alan albert alex alice amy andrea andrew angela anna anne anthony antoine antonio barbara benjamin bernd brian camille carl carla carlos carmen carol caroline catherine charles charlotte "
    "christian christine claire claudia daniel david deborah dennis diana diego dieter donald dorothy edward elena elisabeth elizabeth emily emma eric ernst eva fernando florian francisco frank "
    "françois franz friedrich gabriel george gisela hans harold heinz helen helga henri henry ines isabel jacques james jan jane javier jean jennifer jessica joan johann john jorge jose joseph "
    "juan julia julie karen karl katharina kevin klaus laura lisa louis lucas luis manuel marco margaret maria marie mark martin martina mary michael michel miguel monika nicolas nicole olivia "
    "pablo patricia patrick paul pedro peter petra philippe pierre rafael ralf richard robert rosa ruth sabine sandra sara sarah sofia sophie stefan stephen susan susanne sylvie teresa thomas "
    "uwe victor walter werner william wolfgang".split()
)
#: Words that mark a value as an example.
_MADE_UP = ("example", "changeme", "placeholder", "your_", "xxxx", "<")
CONTEXT = 40
_CONTEXT = {
    "email": ("mail", "contact", "write", "kontakt", "contacto", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "fon", "móvil"),
    "secret": ("login", "user", "key", "auth", "config", "export"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "name": ("name", "dear", "signed", "by", "von", "de"),
    "ssn": ("ssn", "social", "security", "insurance", "number"),
}


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: from each @, back over the local part and on over the domain."""
    out: list[tuple[int, int]] = []
    taken, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append((start, match.end()))
            taken = match.end()
        else:
            taken = max(taken, at + 1)
        at = text.find("@", max(at + 1, taken))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans, by kind and then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m.groups()))]
        out += [("card", a, b) for a, b in _cards(text)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def own_candidates(text: str) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(sign in low for sign in _SECRET_SIGNS):
        for m in _SECRET.finditer(text):
            # Punctuation after a value that is not in quotes ends the sentence.
            size = len(m[1]) if text[m.end(1) : m.end(1) + 1] in ('"', "'") else len(m[1].rstrip(",.;:!?)]}"))
            if size >= 6:
                out.append(("secret", m.start(1), m.start(1) + size))
    if _IBAN_SIGN.search(text):
        out += [("iban", *m.span()) for m in _IBAN.finditer(text)]
    if any(sign in text for sign in _NAME_SIGNS):
        out += [("name", *m.span(1)) for m in _NAME.finditer(text)]
    if "-" in text:
        out += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    return out


def _iban_sum(text: str) -> bool:
    text = text.replace(" ", "")
    if not 15 <= len(text) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _form(text: str, kind: str, start: int, end: int) -> int:
    """The regex labeler's vote."""
    span = text[start:end]
    if kind == "email":
        return 1 if span.rsplit(".", 1)[1].isalpha() and ".." not in span else -1
    if kind == "ip":
        return -1 if any(len(p) > 1 and p[0] == "0" for p in span.split(".")) or text[end : end + 1] == "." or text[start - 1 : start] in (".", "v") else 1
    if kind == "card":
        return (1 if span[0] in "3456" else -1) if len({c for c in span if not c.isdigit()}) < 2 else 0
    if kind == "phone":
        return 1 if not re.search(r"[^0-9+]{3}", span) else 0
    if kind == "secret":
        return 1 if len(span) >= 8 and _DIGIT.search(span) and not any(word in span.lower() for word in _MADE_UP) else -1
    if kind == "iban":
        return 1 if _iban_sum(span) else -1
    if kind == "ssn":
        return -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" else 1
    return 1 if " " in span or "-" in span else 0


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, int, int]:
    """Regex, gazetteer and context votes: 1 for, -1 against, 0 abstains."""
    span = text[start:end].lower()
    near = text[max(0, start - CONTEXT) : start].lower()
    words = re.split(r"[\s.,;:@_+-]+", near[-12:] + " " + span[:64])
    gazetteer = 1 if not _FIRST_NAMES.isdisjoint(words) else 0
    context = 1 if any(word in near for word in _CONTEXT[kind]) else 0
    return _form(text, kind, start, end), gazetteer, context


def features(kind: str, pattern: tuple[int, int, int], text: str, start: int, end: int) -> tuple[int, ...]:
    """Small integers for the span classifier: kind, votes, length class, share of digits in quarters."""
    size = end - start
    digits = sum("0" <= c <= "9" for c in text[start:end])
    return (KINDS.index(kind), *pattern, min(3, size // 8), 4 * digits // size if size else 0)


def _counted(texts: list[str | None]) -> Counter:
    out: Counter = Counter()
    for text in texts:
        if text:
            for kind, a, b in (*base_spans(text), *own_candidates(text)):
                out[features(kind, votes(text, kind, a, b), text, a, b)] += 1
    return out


_COLUMNS = ("kind", "form", "gazetteer", "context", "size", "digits")


def gathered(docs: DataFrame) -> DataFrame:
    """How many candidates of all documents have each combination of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _counted(batch.column(0).to_pylist())
            rows = [[k[i] for k in counts] for i in range(len(_COLUMNS))]
            yield pa.RecordBatch.from_arrays([*(pa.array(r, pa.int32()) for r in rows), pa.array(list(counts.values()), pa.int64())], [*_COLUMNS, "n"])

    schema = ", ".join(f"{c} int" for c in _COLUMNS) + ", n long"
    return docs.select("text").mapInArrow(run, schema).groupBy(*_COLUMNS).agg(F.sum("n").alias("n"))


def estimate(patterns: np.ndarray, n: np.ndarray, prior: float = 0.7, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1): posteriors, and each labeler's chance of each vote by class."""
    states = patterns + 1
    table = np.empty((2, patterns.shape[1], 3))
    table[1], table[0] = (0.1, 0.3, 0.6), (0.5, 0.4, 0.1)
    for _ in range(rounds):
        log = np.stack([np.log(table[c])[np.arange(patterns.shape[1]), states].sum(axis=1) for c in (0, 1)])
        log += np.log([[1 - prior], [prior]])
        posterior = 1 / (1 + np.exp(log[0] - log[1]))
        weight = np.stack([n * (1 - posterior), n * posterior])
        for c in (0, 1):
            for j in range(patterns.shape[1]):
                # Two made-up votes keep a labeler from becoming certain on few candidates.
                seen = np.bincount(states[:, j], weight[c], minlength=3) + 2 * np.array([(0.5, 0.4, 0.1), (0.1, 0.3, 0.6)][c])
                table[c, j] = seen / seen.sum()
        # A labeler is no worse than chance: a vote for never speaks against, nor one against for.
        for j in range(patterns.shape[1]):
            for vote, better in ((0, 0), (2, 1)):
                if table[better, j, vote] < table[1 - better, j, vote]:
                    table[:, j, vote] = table[:, j, vote].mean()
            table[:, j] /= table[:, j].sum(axis=1, keepdims=True)
        prior = float(np.clip((weight[1].sum() + 1) / (n.sum() + 2), 0.05, 0.95))
    return posterior, table


def _design(rows: np.ndarray) -> np.ndarray:
    """One column for each value of each feature."""
    ranges = [(0, len(KINDS)), (-1, 3), (-1, 3), (-1, 3), (0, 4), (0, 5)]
    return np.concatenate([np.ones((len(rows), 1))] + [(rows[:, [i]] == np.arange(low, low + n)).astype(float) for i, (low, n) in enumerate(ranges)], axis=1)


def fit(docs: DataFrame, ridge: float = 1e-3, rounds: int = 300) -> np.ndarray:
    """Weights of the span classifier."""
    table = gathered(docs).toArrow()  # bounded by the number of combinations
    rows = np.array([table[c].to_pylist() for c in _COLUMNS], np.int64).T.reshape(-1, len(_COLUMNS))
    x = _design(rows)
    weights = np.zeros(x.shape[1])
    if not len(rows):
        weights[0] = 1.0
        return weights
    order = np.lexsort(rows.T)
    rows, x, n = rows[order], x[order], np.asarray(table["n"], float)[order]
    target = np.empty(len(rows))
    for kind in np.unique(rows[:, 0]).tolist():
        own = rows[:, 0] == kind
        target[own], _ = estimate(rows[own, 1:4], n[own])  # a labeler may be good at one kind and poor at another
    share = np.log1p(n) / np.log1p(n).sum()  # frequent combinations don't drown rare ones
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ weights))
        gradient = x.T @ (share * (p - target)) + ridge * weights
        weights -= 4.0 * gradient
    return weights


def accepted(text: str, weights: np.ndarray) -> list[tuple[str, int, int]]:
    """Base spans, and the method's own that the classifier keeps; by kind and then start."""
    out = base_spans(text)
    own = own_candidates(text)
    if own:
        rows = np.array([features(k, votes(text, k, a, b), text, a, b) for k, a, b in own])
        keep = _design(rows) @ weights >= 0
        out += [c for c, yes in zip(own, keep, strict=True) if yes]
    return out


def _written_out(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_REPORT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def report(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in BASE_KINDS}
            digests, all_spans = [], []
            for text in batch.column(1).to_pylist():
                spans = accepted(text, weights) if text else []
                base = [s for s in spans if s[0] in BASE_KINDS]
                for kind in BASE_KINDS:
                    counts[kind].append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(_written_out(base).encode()).hexdigest())
                all_spans.append(_written_out(spans))
            arrays = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), pa.array(digests, pa.string()), pa.array(all_spans, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _REPORT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _REPORT)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span, or run of overlapping spans, becomes the tag of its first kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """All columns of ``docs``, with tags for spans in text and n_chars made to fit."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = dict(zip(columns, batch.columns, strict=True))
            texts = batch.column(columns.index("text")).to_pylist()
            sizes = arrays["n_chars"].to_pylist() if "n_chars" in arrays else []
            for i, text in enumerate(texts):
                spans = accepted(text, weights) if text else []
                if spans:
                    texts[i] = redact(text, spans)
                    if sizes:
                        sizes[i] = len(texts[i])
            arrays["text"] = pa.array(texts, arrays["text"].type)
            if sizes:
                arrays["n_chars"] = pa.array(sizes, arrays["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(arrays.values()), columns)

    return docs.mapInArrow(run, docs.schema)
