"""Personal data: regular expressions propose spans, checksums confirm them, context words nearby raise or lower the score. A span is acted upon if its score reaches a threshold; all are reported.

Kinds: email, ip, card (Luhn), phone, and, added by the method, iban (mod-97).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

KINDS = ("email", "ip", "card", "phone", "iban")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Score of a span that its checksum, if it has one, confirms; what a word that speaks for the kind adds, and what one that speaks of another number takes.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.95}
BOOST, DROP = 0.3, 0.3
#: Score from which a span is acted upon.
LEAST = 0.5
#: Code points before the span in which either is looked for, and after it in which only words for the kind are.
REACH, AFTER = 40, 20
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
}
AGAINST = {
    "ip": ("version", "release", "build", "firmware", "chapter", "section", "kapitel", "abschnitt"),
    "card": ("isbn", "order", "invoice", "serial", "tracking", "ticket", "article", "bestellung", "rechnung", "pedido", "commande"),
    "phone": ("isbn", "order", "invoice", "serial", "tracking", "coordinates", "bestellung", "rechnung", "pedido", "commande"),
}
FOR, NOT = ({k: re.compile(rf"\b(?:{'|'.join(v)})", re.I) for k, v in words.items()} for words in (CONTEXT, AGAINST))
#: The length of an IBAN by country.
IBAN_LENGTH = {k: int(n) for k, n in (x.split(":") for x in (
    "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 "
    "HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 "
    "QA:29 RO:24 RS:22 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20"
).split())}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address starts as far left of its @ as local characters and the match before it allow; time is in proportion to the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (x.lstrip("0") for x in m.groups())):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() < 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in IBAN.finditer(text):
        found = m[0]  # a capital word may follow the last group
        while found:
            code = found.replace(" ", "")
            if len(code) == IBAN_LENGTH.get(code[:2]) and mod97(code):
                yield m.start(), m.start() + len(found)
                break
            found = found.rpartition(" ")[0]


FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans}


def find(text: str) -> list[tuple[str, int, int, float]]:
    """All confirmed spans (kind, start, end, score), by kind as listed and then by start; positions are code points."""
    out = []
    for kind in KINDS:
        for a, b in FINDERS[kind](text):
            before = max(0, a - REACH)
            score = PRIOR[kind] + BOOST * bool(FOR[kind].search(text, before, a) or FOR[kind].search(text, b, b + AFTER))
            if kind in NOT:
                score -= DROP * bool(NOT[kind].search(text, before, a))
            out.append((kind, a, b, min(1.0, round(score, 2))))
    return out


def redact(text: str, spans: list[tuple[str, int, int, float]], least: float) -> str:
    """The text with each span of at least that score replaced by its kind; overlapping spans are replaced as one, named by the first."""
    out, done = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b, score in spans if score >= least):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
SPAN_DDL = "array<struct<kind string, start int, end int, score double>>"


def find_pii(docs: DataFrame, redacted: bool = False, least: float = LEAST) -> DataFrame:
    """docs(doc_id, text, ...) to doc_id, spans and, if `redacted`, the text with spans of score `least` or more replaced.

    One row for each row given, repeated ones too; a null or empty text has no spans and stays as it is. Other columns are not read. No rows give no rows.
    """
    names = ["doc_id", "spans", *["text"] * redacted]
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(SPAN)), ("text", pa.string())][: len(names)])

    def run(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            found = [find(t) if t else [] for t in texts]
            spans = pa.array([[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in x] for x in found], pa.list_(SPAN))
            new = [pa.array([redact(t, x, least) if x else t for t, x in zip(texts, found, strict=True)], pa.string())] if redacted else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), spans, *new], schema=schema)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, f"doc_id long, spans {SPAN_DDL}" + ", text string" * redacted)
