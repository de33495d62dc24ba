"""PII: patterns propose spans, checksums confirm them, words nearby adjust a score.

Four kinds are always reported once their check holds: email, ip (parts at most 255), card (Luhn) and
phone (9 to 15 digits); their score says how sure they are. Two more are proposed by this method and reported from a
score of 0.5: iban (mod-97) and secret (a long hexadecimal value near a word such as "token", or any long mixed value that
such a word is set to).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE = KINDS[:4]

_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits, as it would have started at the run's first digit
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,64}(?![A-Za-z0-9])")
#: A value of letters and digits that a telling name is set to, as in api_key = "..."
_NAMED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?\x20?[:=]\x20?[\"']?(?P<value>[A-Za-z0-9_/+-]{16,128})(?![A-Za-z0-9_/+-])")
_NAME = re.compile("token|secret|passw|key", re.IGNORECASE)

#: How sure a confirmed span is by itself.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "secret": 0.3}
#: Words that raise a kind's score when they stand within CONTEXT code points before or after a span.
NEARBY = {
    "email": {"email", "mail", "contact", "write"},
    "ip": {"ip", "address", "host", "server"},
    "card": {"card", "visa", "mastercard", "credit", "payment"},
    "phone": {"phone", "tel", "call", "mobile", "fax"},
    "iban": {"iban", "account", "bank", "transfer"},
    "secret": {"token", "key", "secret", "password", "api"},
}
#: Words that lower any score.
AGAINST = {"version", "example", "isbn", "build", "serial", "release"}
CONTEXT, RAISE, LOWER, REPORTED = 32, 0.3, 0.2, 0.5
_WORD = re.compile("[a-z]+")


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of account numbers: letters count from 10, the first four go last, remainder 1."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ outwards: no @ lies inside a local part."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", at + 1)


def _candidates(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        yield from (("email", a, b) for a, b in _emails(text))
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        part = m[0]
        while len(part.replace(" ", "")) >= 15:
            if mod97(part.replace(" ", "")):
                yield "iban", m.start(), m.start() + len(part)
                break
            part = part.rpartition(" ")[0]
    found = set()
    for m in _SECRET.finditer(text):
        if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
            found.add(m.span())
    if _NAME.search(text):
        for m in _NAMED.finditer(text):
            if any(c.isdigit() for c in m["value"]) and any(c.isalpha() for c in m["value"]):
                found.add(m.span("value"))
    yield from (("secret", a, b) for a, b in sorted(found))


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's own score, raised by words that go with it nearby and lowered by words against it."""
    near = set(_WORD.findall(text[max(0, start - CONTEXT) : start].lower())) | set(_WORD.findall(text[end : end + CONTEXT].lower()))
    return round(min(1.0, max(0.0, PRIOR[kind] + RAISE * bool(near & NEARBY[kind]) - LOWER * bool(near & AGAINST))), 2)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """All reported spans of a text as (kind, start, end, score), by start, then kind; code points, end exclusive."""
    found = [(k, a, b, score(text, k, a, b)) for k, a, b in _candidates(text)]
    return sorted((x for x in found if x[0] in BASE or x[3] >= REPORTED), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def pii_spans(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, and ``found``, an array of (kind, start, end, score, value).

    Null texts count as empty and hold nothing. Each row stands for itself, so null or repeated doc_ids
    and repeated rows change nothing; an empty table gives an empty result.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("value", pa.string())]))
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                found.append([{"kind": k, "start": a, "end": b, "score": s, "value": text[a:b]} for k, a, b, s in find(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, found array<struct<kind string, start long, end long, score double, value string>>")


def pii_digest(docs: DataFrame) -> DataFrame:
    """``pii_spans`` as counts, a SHA-256 over the four base kinds' spans, all spans as one string, and their scores in the same order.

    Nulls, repeated rows and empty tables as in ``pii_spans``.
    """
    found = F.col("found")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return pii_spans(docs).select(
        "doc_id",
        *(count(k) for k in BASE),
        F.sha2(listed(F.filter(found, lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"),
        listed(found).alias("spans"),
        *(count(k) for k in KINDS[4:]),
        F.array_join(F.transform(found, lambda x: F.format_number(x["score"], 2)), ",").alias("scores"),
    )


def base_sha256(spans: list[tuple[str, int, int]]) -> str:
    """The digest of base spans, for tests."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
