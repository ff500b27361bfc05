"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Four base kinds are fixed patterns with their checks and always stay.  Further
kinds (IBAN with mod-97, social security numbers, local phone numbers, secrets)
start from a score of their own; words nearby raise or lower it, and spans at or
above ``THRESHOLD`` that touch no other span are added.

Row by row: nothing is shuffled or gathered.  Every pattern runs in time linear
in the text.  Defined cases: a null text has no spans; offsets are code points,
ends exclusive; repeated rows are searched one by one; an empty table gives an
empty table; other columns pass through :func:`redact` untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The kinds in listed order (base kinds first), their patterns and limits.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone", "secret")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
# Proposals of the further kinds: pattern, score before context, context that supports, context that contradicts.
PROPOSALS = {
    "iban": (re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"), 0.9, ("iban", "account", "bank", "konto", "compte", "cuenta"), ()),
    "ssn": (re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), 0.4, ("ssn", "social security"), ("invoice", "order", "part no", "serial")),
    "local_phone": (re.compile(r"(?<![0-9])(?:\([0-9]{3}\)\x20|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])"), 0.4,
                    ("phone", "tel", "call", "mobile", "fax", "cell"), ("isbn", "version", "order", "serial")),
    "secret": (re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_+/-]{24,}+"), 0.2,
               ("token", "secret", "password", "passwd", "api key", "api_key", "apikey", "access key", "credential"), ("sha256", "md5", "checksum", "commit", "http")),
}
THRESHOLD, SUPPORT, CONTRADICTION, REACH = 0.6, 0.4, 0.3, 40


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, at sign, dotted domain; each character is looked at once or twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in emails(text)]
    if not DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return found


def ibans(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """Proposals cut at the last end of a group of characters at which mod-97 holds."""
    m = pattern.search(text)
    while m:
        ends = [b for b in range(m.end(), m.start() + 14, -1) if b == m.end() or text[b] == " "]
        stop = next((b for b in ends if mod97(text[m.start():b])), None)
        if stop is not None:
            yield m.start(), stop
        m = pattern.search(text, stop or m.start() + 1)


def proposals(text: str, kind: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    return ibans(text, pattern) if kind == "iban" else (m.span() for m in pattern.finditer(text) if _confirmed(kind, m[0]))


def _confirmed(kind: str, match: str) -> bool:
    if kind == "ssn":
        area, group, serial = match.split("-")
        return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
    if kind == "secret":
        return len(set(match)) >= 8 and any(c.isdigit() for c in match) and any(c.isalpha() for c in match)
    return True


def further_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
    proposed = []
    for kind, (pattern, score, support, contradiction) in PROPOSALS.items():
        for start, stop in proposals(text, kind, pattern):
            near = f"{text[max(0, start - REACH):start]} {text[stop:stop + REACH]}".lower()
            sure = score + SUPPORT * any(w in near for w in support) - CONTRADICTION * any(w in near for w in contradiction)
            if sure >= THRESHOLD:
                proposed.append((-sure, KINDS.index(kind), start, stop))
    kept: list[tuple[str, int, int, float]] = []
    held = sorted((a, b) for _, a, b in taken)
    for minus, kind, a, b in sorted(proposed):
        if not any(x < b and a < y for x, y in held):
            held.append((a, b))
            kept.append((KINDS[kind], a, b, round(-minus, 2)))
    return kept


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, stop, score) by start, then kind as listed; base kinds score 1."""
    if not text:
        return []
    base = base_spans(text)
    found = [(*s, 1.0) for s in base]
    if DIGIT.search(text):
        found += further_spans(text, base)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def masked(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at, stop = [], 0, -1
    for kind, a, b, _ in spans:
        if a >= stop:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = stop = max(b, stop)
    return "".join([*out, text[at:]])


def _digest(spans: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (key, counts of the base kinds, found: the spans as structs, base and spans as text)."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans_of(x) for x in batch.column(1).to_pylist()]
            base = [[s for s in f if s[0] in BASE] for f in found]
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in BASE]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *counts, pa.array([[dict(zip(("kind", "start", "stop", "score"), s)) for s in f] for f in found], span),
                pa.array([hashlib.sha256(_digest(b).encode()).hexdigest() for b in base]), pa.array([_digest(f) for f in found]),
            ], names=["key", *(f"n_{k}" for k in BASE), "found", "base_sha256", "spans"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = StructType([rows.schema["key"], *StructType.fromDDL(
        "n_email long, n_ip long, n_card long, n_phone long, found array<struct<kind: string, start: int, stop: int, score: double>>, base_sha256 string, spans string").fields])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span masked; ``length``, if such a column exists, is the code points of the new text."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [None if x is None else masked(x, spans_of(x)) for x in batch.column(columns.index(text)).to_pylist()]
            arrays = [pa.array(new, f.type) if f.name == text
                      else pa.array([None if x is None else len(x) for x in new], f.type) if f.name == length else batch.column(i) for i, f in enumerate(batch.schema)]
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
