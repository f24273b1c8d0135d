"""Personal data: regular expressions propose, checksums confirm, context words weigh.

Base kinds (email, ip, card, phone) stay wherever pattern and validator agree.  Further kinds
(iban, ssn, local phone) must reach a score made of the pattern's weight, the checksum and
words found just before the span, and never overlap a base span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from spectraloom.llm.common import slices

Span = tuple[str, int, int, float]

# Fixed values of the base kinds.
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone")

# Fixed values of the added kinds.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])?[0-9]{3}[.-][0-9]{4}(?![0-9-])")
CONTEXT = {
    "email": ("email", "mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "llame"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "insurance"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "llame"),
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.3, "ssn": 0.4, "local_phone": 0.3}
CONFIRMED, NEARBY, ENOUGH, REACH = 0.4, 0.3, 0.6, 40
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod_97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, not overlapping; walks from one ``@`` to the next, so long words cost once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        domain = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def _digits(piece: str) -> str:
    return "".join(c for c in piece if "0" <= c <= "9")


def _score(kind: str, text: str, start: int, checked: bool) -> float:
    near = _WORD.findall(text[max(0, start - REACH) : start].lower())
    hit = any(w in CONTEXT[kind] for w in near)
    return round(min(1.0, PRIOR[kind] + CONFIRMED * checked + NEARBY * hit), 2)


def find_spans(text: str | None) -> list[Span]:
    """(kind, start, end, score) in code points, end exclusive, by kind then start."""
    if not text:
        return []
    spans: list[Span] = [("email", s, e, _score("email", text, s, False)) for s, e in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
            spans.append(("ip", m.start(), m.end(), _score("ip", text, m.start(), True)))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            spans.append(("card", m.start(), m.end(), _score("card", text, m.start(), True)))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                spans.append(("phone", m.start(), m.end(), _score("phone", text, m.start(), False)))
    taken = bytearray(len(text))  # code points inside a span
    for _, s, e, _ in spans:
        taken[s:e] = b"\x01" * (e - s)
    for kind, pattern in (("iban", IBAN), ("ssn", SSN), ("local_phone", LOCAL_PHONE)):
        for m in pattern.finditer(text):
            checked = kind == "iban" and mod_97(m[0].replace(" ", ""))
            if kind == "iban" and not checked:
                continue
            score = _score(kind, text, m.start(), checked)
            if score >= ENOUGH and taken.find(1, m.start(), m.end()) < 0:
                spans.append((kind, m.start(), m.end(), score))
                taken[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1]))


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind; of overlapping spans the first one names it."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
)


def _struct(spans: list[Span]) -> list[dict]:
    return [{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in spans]


def detect(docs: DataFrame) -> DataFrame:
    """``(doc_id, found)``: the spans of every whole text.

    Null and empty texts have none; repeated rows stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [_struct(find_spans(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, _SPANS)], names=["doc_id", "found"]
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, found array<struct<kind:string,start:bigint,end:bigint,score:double>>"
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced; all columns, rows and null texts stay.

    ``n_chars``, where there is such a column, is counted anew for texts that changed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [redacted(t, find_spans(t)) for t in batch.column("text").to_pylist()]
            cols = {n: batch.column(n) for n in batch.schema.names}
            if "n_chars" in cols:
                old = zip(batch.column("text").to_pylist(), texts, cols["n_chars"].to_pylist())
                cols["n_chars"] = pa.array([n if a == b else len(b) for a, b, n in old], cols["n_chars"].type)
            cols["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    fields = [StructField("text", StringType()) if f.name == "text" else f for f in docs.schema.fields]
    return docs.mapInArrow(run, StructType(fields))


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def summary(found: DataFrame) -> DataFrame:
    """Counts and digests of detected spans."""
    base = ", ".join(f"'{k}'" for k in BASE)
    counts = [F.expr(f"CAST(size(filter(found, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined(f"filter(found, s -> s.kind IN ({base}))").cast("binary"), 256).alias("base_sha256"),
        _joined("found").alias("spans"),
    )
