r"""Personal data by weak supervision.

Base spans come from four fixed patterns (email, ip, card, phone) and always stay. Further candidates (credentials,
account numbers, social security numbers, spelled-out addresses) come from loose patterns. On each span, base or
further, labelers vote yes, no or nothing: a strict pattern, gazetteers (mail suffixes, card issuers, calling codes,
reserved networks, credential words), the words before it, and its own make-up. Expectation-maximisation over the
counts of vote patterns of all documents estimates how reliable each labeler is for each kind of span and class,
which gives each pattern a soft label; a logistic span classifier over features of the spans is trained on those.
Further candidates that it accepts are added.

Votes and features make a cell; cells are bounded in number (KINDS x 3^4 x 2^6), so all that the driver gathers is
their counts, whatever the size of the input, and the classifier is applied as a set of accepted cells.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Repeated rows count each. A corpus
without candidates gives a classifier that accepts none.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "iban", "ssn", "contact")
#: Gazetteers (fixed values).
SUFFIXES = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au jp cn br ch at be se no dk fi pl pt ru in mx".split())
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38", "30")
CREDENTIAL = re.compile(r"pass(?:word|wd|phrase)?|pwd|token|secret|api[_-]?key|access[_-]?key|credential", re.I)
YES_WORDS = {
    "email": "mail email e-mail contact write reach", "ip": "ip host server address from login client", "card": "card visa mastercard amex credit debit payment pay",
    "phone": "tel phone call mobile fax cell dial contact", "secret": "password passwd token secret key login user credential", "iban": "iban account bank transfer", "ssn": "ssn social security", "contact": "mail email e-mail contact write reach",
}
NO_WORDS = frozenset("version release v. ver isbn issn section page chapter figure table no. rev build example".split())
YES = {k: frozenset(v.split()) for k, v in YES_WORDS.items()}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# runs of digits are entered at their start only, and never given back: the same matches in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Words before a secret, by what each of their matches holds when case is folded.
_BEFORE = {"pass": "pass(?:word|wd)?", "pwd": "pwd", "token": "token", "secret": "secret", "key": "(?:api|access)[_-]?key"}
_SECRET = re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|(?i:(?<![a-z0-9])(?:" + "|".join(_BEFORE.values()) + r")\s{0,3}[=:]\s{0,3})[\"']?([A-Za-z0-9+/_.~-]{8,}+)[\"']?")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_CONTACT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z0-9-]{1,63}){1,5}")
_NOT_DIGIT = str.maketrans("", "", " -().+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) << (i & 1)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, from each @ outwards; linear where a scan from every start is not."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as in BASE, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().translate(_NOT_DIGIT)
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(m.group().translate(_NOT_DIGIT)) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def further_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Loose candidates that do not overlap base spans or one another."""
    found: list[tuple[str, int, int]] = []
    folded = text.casefold()
    if "AKIA" in text or "ASIA" in text or any(t in folded for t in _BEFORE):
        for m in _SECRET.finditer(text):
            found.append(("secret", m.start(1) if m.group(1) else m.start(), m.end(1) if m.group(1) else m.end()))
    if _DIGIT.search(text):
        found += [("iban", m.start(), m.end()) for m in _IBAN.finditer(text)] + [("ssn", m.start(), m.end()) for m in _SSN.finditer(text)]
    if "[at]" in text or "(at)" in text:
        found += [("contact", m.start(), m.end()) for m in _CONTACT.finditer(text)]
    taken: list[tuple[int, int]] = []  # stretches that base spans cover, then the spans found too: apart, by start
    for a, b in sorted((a, b) for _, a, b in base) if found else ():
        if taken and a <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    out: list[tuple[str, int, int]] = []
    for kind, a, b in found:
        at = bisect_left(taken, (b,))
        if not at or taken[at - 1][1] <= a:
            taken.insert(at, (a, b))
            out.append((kind, a, b))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def _iban_checks(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes_and_features(text: str, kind: str, a: int, b: int) -> tuple[tuple[int, ...], tuple[bool, ...]]:
    """Votes (1, 0, -1) of strict pattern, gazetteer, context and make-up; features of the span and its surroundings."""
    span = text[a:b]
    digits = "".join(c for c in span if "0" <= c <= "9")
    before = re.findall(r"[^\W\d_]+[-.]?(?:[^\W\d_]+)?", text[max(0, a - 32) : a].lower())[-3:]
    strict = gazetteer = make = 0
    if kind in ("email", "contact"):
        suffix = re.split(r"[^A-Za-z]", span)[-1].lower()
        strict = 1 if re.fullmatch(r"[A-Za-z]{2,24}", suffix) else -1
        gazetteer = 1 if suffix in SUFFIXES else 0
        make = 1 if any(c.isalpha() for c in re.split(r"@|\[at\]|\(at\)", span)[0]) else -1
    elif kind == "ip":
        parts = [int(p) if len(p) < 9 else 999 for p in span.split(".")]
        strict = -1 if any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else 1
        gazetteer = -1 if parts[0] in (0, 127) or parts[0] >= 224 else 1
        make = -1 if text[a - 1 : a] == "." or text[b : b + 1] == "." and text[b + 1 : b + 2].isdigit() else 1 if max(parts) > 20 else 0
    elif kind == "card":
        strict = 1 if len(digits) in (14, 15, 16, 19) else 0
        gazetteer = 1 if digits.startswith(ISSUERS) else -1
        make = -1 if len(set(digits)) < 4 else 1
    elif kind == "phone":
        strict = 1 if 10 <= len(digits) <= 14 else 0
        gazetteer = 1 if any(digits[:n] in CALLING for n in (1, 2)) else 0
        make = -1 if len(set(digits)) < 3 else 1
    elif kind == "secret":
        mixed = any(c.isdigit() for c in span) and any(c.isalpha() for c in span)
        strict = 1 if re.fullmatch(r"(?:AKIA|ASIA)[0-9A-Z]{16}|[0-9a-f]{16,}|[A-Za-z0-9+/_-]{20,}", span) else 0
        gazetteer = 1 if CREDENTIAL.search(text[max(0, a - 20) : a]) or span[:4] in ("AKIA", "ASIA") else 0
        make = 1 if mixed and len(set(span)) >= 8 else -1
    elif kind == "iban":
        strict, gazetteer, make = (1 if _iban_checks(span) else -1), (1 if span[:2] in ("DE", "FR", "ES", "GB", "IT", "NL", "BE", "AT", "CH") else 0), (1 if len(digits) >= 10 else -1)
    else:
        strict = -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 1
        make = 1 if len(set(digits)) > 2 else -1
    context = 1 if YES[kind].intersection(before) else -1 if NO_WORDS.intersection(before) else 0
    alone = not (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum())
    features = (alone, len(digits) * 2 >= len(span), len(span) >= 16, any(c.isalpha() for c in span), len(set(span)) >= 8, bool(before))
    return (strict, gazetteer, context, make), features


def cell_of(kind: str, votes: tuple[int, ...], features: tuple[bool, ...]) -> int:
    n = KINDS.index(kind)
    for v in votes:
        n = n * 3 + v + 1
    for f in features:
        n = n * 2 + f
    return n


def _unpacked(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    feats = np.column_stack([cells >> i & 1 for i in range(5, -1, -1)])
    rest, votes = cells >> 6, []
    for _ in range(4):
        votes.append(rest % 3)
        rest = rest // 3
    return rest, np.column_stack(votes[::-1]), feats


def reliabilities(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over cells: class prior by kind, P(vote | class) by kind, labeler; soft label by cell."""
    lean = (votes - 1).sum(axis=1)
    soft = 1 / (1 + np.exp(-1.5 * lean))
    prior, table = np.zeros(len(KINDS)), np.full((len(KINDS), 2, votes.shape[1], 3), 1 / 3)
    for _ in range(steps):
        for k in np.unique(kinds):
            own = kinds == k
            n, s = counts[own], soft[own]
            prior[k] = ((n * s).sum() + 1) / (n.sum() + 2)
            for z, w in ((0, n * (1 - s)), (1, n * s)):
                for v in range(votes.shape[1]):
                    # a labeler is held to be better than chance: its prior counts lean to its own class
                    seen = np.bincount(votes[own, v], w, 3) + np.array([1.0, 1.0, 0.2] if z == 0 else [0.2, 1.0, 1.0])
                    table[k, z, v] = seen / seen.sum()
            odds = np.log(prior[k] / (1 - prior[k])) + sum(np.log(table[k, 1, v, votes[own, v]] / table[k, 0, v, votes[own, v]]) for v in range(votes.shape[1]))
            soft[own] = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return prior, table, soft


def accepted(cells: np.ndarray, counts: np.ndarray, cut: float = 0.5) -> dict[int, float]:
    """Cells that the span classifier accepts, with their probability."""
    if not len(cells):
        return {}
    kinds, votes, feats = _unpacked(cells)
    _, _, soft = reliabilities(kinds, votes, counts.astype(float))
    x = np.column_stack([np.eye(len(KINDS))[kinds], feats, (votes == 2).astype(float), (votes == 0).astype(float)])
    w, weight = np.zeros(x.shape[1]), np.log1p(counts.astype(float))  # a frequent cell counts more, but not for all
    for _ in range(60):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (soft - p)) - 0.1 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {int(c): float(q) for c, q in zip(cells, p) if q >= cut}


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cell", pa.int32()), ("base", pa.bool_())]))


def spans_of(text: str) -> list[dict]:
    base = base_spans(text)
    every = [(*s, True) for s in base] + [(*s, False) for s in further_spans(text, base)]
    return [{"kind": k, "start": a, "end": b, "cell": cell_of(k, *votes_and_features(text, k, a, b)), "base": own} for k, a, b, own in every]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and all candidate spans of each row."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([spans_of(t) for t in common.texts_of(batch)], SPAN)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(common.by_batch(kernel), "doc_id bigint, spans array<struct<kind: string, start: int, end: int, cell: int, base: boolean>>")


def classifier(found: DataFrame) -> dict[int, float]:
    """Trained on the cells of all candidates; found: spans."""
    got = found.select(F.explode("spans.cell").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).toPandas().sort_values("cell")  # bounded by the number of cells
    return accepted(got["cell"].to_numpy(dtype=np.int64), got["n"].to_numpy(dtype=np.int64))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, cell, base) of each row of docs: base ones and those accepted."""
    found = common.cut(candidates(docs), "pii")
    model = sorted(classifier(found))
    keep = (lambda s: s["base"] | s["cell"].isin(model)) if model else (lambda s: s["base"])
    return found.select("doc_id", F.filter("spans", keep).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span in text replaced by its kind in angle brackets, n_chars renewed; texts without stay as they are."""
    model = set(classifier(candidates(docs)))

    def masked(text: str) -> str:
        out, at = [], 0
        for s in sorted((s for s in spans_of(text) if s["base"] or s["cell"] in model), key=lambda s: (s["start"], -s["end"])):
            if s["start"] >= at:
                out += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
            at = max(at, s["end"])
        return "".join([*out, text[at:]]) if out else text

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if t is None else masked(t) for t in batch.column("text").to_pylist()]
        columns = {n: batch.column(n) for n in batch.schema.names} | {"text": pa.array(texts, batch.schema.field("text").type)}
        if "n_chars" in columns:
            old = batch.column("n_chars").to_pylist()
            columns["n_chars"] = pa.array([o if t is None else len(t) for o, t in zip(old, texts)], batch.schema.field("n_chars").type)
        return pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(common.by_batch(kernel), docs.schema)
