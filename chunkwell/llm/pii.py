"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, ``://``, plus signs,
digits and identifier cues. At each anchor a small deterministic parser reads to
the left and right until the boundary of an email, an address or an account, and
validates what it read. Every parser is linear in what it reads and none starts
again inside what it has read, so a text costs time in proportion to its length.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwell.llm.common import map_texts, slices

#: Kinds in the order of reports. The first four follow fixed patterns.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("wide_email", "masked_email", "login", "ipv6", "iban", "ssn", "secret")

#: Account numbers of these countries are recognised.
IBAN_COUNTRIES = (
    "AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO "
    "SE SI SK SM TR"
).split()
SECRET_CUES = ("token", "api_key", "apikey", "secret", "password", "passwd", "access_key")
SSN_CUES = ("SSN", "ssn", "Social Security", "social security")
MASKED_AT = ("[at]", "(at)", "[AT]", "(AT)")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WIDE_DOMAIN = re.compile(r"@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
_MASKED_TAIL = re.compile(
    r" ?([A-Za-z0-9-]+(?: ?(?:\.|\[dot\]|\(dot\)|\[DOT\]|\(DOT\)) ?[A-Za-z0-9-]+)+)"
)
_USERINFO = re.compile(r"://[^\s/?#@:]+(?::[^\s/?#@]*)?@[^\s/?#@]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"[^0-9\n]{0,20}?\b(?!000|666|9)([0-9]{3})-(?!00)([0-9]{2})-(?!0000)([0-9]{4})\b")
_SECRET = re.compile(r"[\"']?\s{0,4}[:=]\s{0,4}[\"']?([A-Za-z0-9_+/.~-]{12,})")
_HEX_RUN = re.compile(r"[0-9A-Fa-f:]*")

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def anchors() -> ahocorasick.Automaton:
    """The automaton over all anchors; its values are the kinds of anchors."""
    automaton = ahocorasick.Automaton()
    for digit in "0123456789":
        automaton.add_word(digit, ("digit", digit))
    for name, words in (
        ("at", ("@",)),
        ("plus", ("+",)),
        ("scheme", ("://",)),
        ("colon", ("::", ":")),
        ("masked", MASKED_AT),
        ("iban", IBAN_COUNTRIES),
        ("ssn", SSN_CUES),
        ("secret", SECRET_CUES),
    ):
        for word in words:
            automaton.add_word(word, (name, word))
    automaton.make_automaton()
    return automaton


def _left(text: str, at: int, stop: int) -> int:
    """Where the run of local characters before ``at`` starts, not before ``stop``."""
    while at > stop and text[at - 1] in _LOCAL:
        at -= 1
    return at


def _wide_left(text: str, at: int, stop: int) -> int:
    while at > stop and (text[at - 1] in _LOCAL or text[at - 1].isalnum()):
        at -= 1
    while at < len(text) and text[at] in ".-+%":
        at += 1
    return at


def find_spans(text: str, automaton: ahocorasick.Automaton) -> list[Span]:
    """All spans ``(kind, start, end)`` of a text, by kind in the order of ``KINDS``, then start."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    email_end = ip_end = card_end = six_end = iban_end = wide_end = secret_end = 0
    for last, (kind, word) in automaton.iter(text):
        start = last - len(word) + 1
        if kind == "digit":
            if start >= ip_end:
                m = _DOTTED.match(text, start)
                ip_end = m.end()
                if "." in m[0]:
                    runs = [r.span() for r in re.finditer("[0-9]+", m[0])]
                    for k in range(0, len(runs) - 3, 4):
                        four = runs[k : k + 4]
                        if all(b - a < 200 and int(m[0][a:b]) <= 255 for a, b in four):
                            found["ip"].append((start + four[0][0], start + four[3][1]))
            if start >= card_end:
                m = _DIGITS.match(text, start)
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    found["card"].append(m.span())
        elif kind == "at":
            base = None
            left = _left(text, start, email_end)
            if left < start and (m := _DOMAIN.match(text, start)):
                base = (left, m.end())
                found["email"].append(base)
                email_end = m.end()
            if m := _WIDE_DOMAIN.match(text, start):
                left = _wide_left(text, start, wide_end)
                if left < start and (left, m.end()) != base:
                    inside = base and base[0] <= left and m.end() <= base[1]
                    if not inside:
                        found["wide_email"].append((left, m.end()))
                    wide_end = m.end()
        elif kind == "plus":
            m = _PHONE.match(text, start)
            if m and 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found["phone"].append(m.span())
        elif kind == "scheme":
            if m := _USERINFO.match(text, start):
                left = start
                while left > 0 and (text[left - 1].isascii() and text[left - 1].isalpha()):
                    left -= 1
                found["login"].append((left, m.end()))
        elif kind == "masked":
            at = start - (start > 0 and text[start - 1] == " ")
            left = _left(text, at, 0) if at - 64 < 0 else _left(text, at, at - 64)
            m = _MASKED_TAIL.match(text, last + 1)
            if left < at and m:
                found["masked_email"].append((left, m.end()))
        elif kind == "colon" and start >= six_end:
            left = start
            while left > max(six_end, start - 4) and text[left - 1] in "0123456789abcdefABCDEF":
                left -= 1
            end = _HEX_RUN.match(text, left).end()
            six_end = end
            run = text[left:end].rstrip(":") if not text[left:end].endswith("::") else text[left:end]
            if 4 <= len(run) <= 39 and len(re.findall("[0-9A-Fa-f]+", run)) >= 3:
                try:
                    ipaddress.IPv6Address(run)
                    found["ipv6"].append((left, left + len(run)))
                except ValueError:
                    pass
        elif kind == "iban" and start >= iban_end:
            if start == 0 or not text[start - 1].isalnum():
                if m := _IBAN.match(text, start):
                    if _mod97(m[0].replace(" ", "")):
                        found["iban"].append(m.span())
                        iban_end = m.end()
        elif kind == "ssn":
            if m := _SSN.match(text, last + 1):
                found["ssn"].append((m.start(1), m.end(3)))
        elif kind == "secret" and start >= secret_end:
            if (m := _SECRET.match(text, last + 1)) and any("0" <= c <= "9" for c in m[1]):
                found["secret"].append(m.span(1))
                secret_end = m.end()
    return [(kind, a, b) for kind in KINDS for a, b in sorted(set(found[kind]))]


def redact_text(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlaps become one."""
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    parts, at = [], 0
    for kind, a, b in merged:
        parts += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join(parts + [text[at:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans array<struct<kind, start, end>>)``, one row per input row.

    Offsets count code points, ends are exclusive. A NULL text is the empty text and has
    no spans. Repeated rows stay repeated rows; NULL ids are kept; other columns are not
    read, whatever their names. No shuffle: a document is scanned where it is read.
    """

    def setup():
        automaton = anchors()

        def scan(texts: list[str]) -> dict[str, list]:
            found = [find_spans(t, automaton) for t in texts]
            return {"spans": [[dict(zip(("kind", "start", "end"), s)) for s in f] for f in found]}

        return scan

    rest = "spans array<struct<kind string, start bigint, end bigint>>"
    return map_texts(docs, id_col, text_col, rest, setup)


def span_list(spans: str | Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """Spans of the given kinds as ``kind:start:end`` joined by commas."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(
        F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input rows with personal data in the text replaced; all columns stay.

    A NULL text stays NULL. Done in the task that reads the row, without a join.
    """
    place = docs.columns.index(text_col)

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in slices(stream):
            clean = [
                t and redact_text(t, find_spans(t, automaton))
                for t in batch.column(place).to_pylist()
            ]
            columns = batch.columns
            columns[place] = pa.array(clean, type=batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(scan, docs.schema)
