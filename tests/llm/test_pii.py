"""Base spans against the plain patterns; extra kinds; odd rows."""

from __future__ import annotations

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from chunkwell.llm import pii

SMALL = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute(text):
    spans = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            spans.append((kind, *m.span()))
    return spans


def base(text):
    return [s for s in pii.find_spans(text, pii.anchors()) if s[0] in pii.BASE_KINDS]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab.@-+0123 ():é\n", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert base(text) == brute(text)


def test_cards_ips_and_phones_mixed():
    rng = random.Random(7)
    parts = ["4111 1111-1111 1111", "4111111111111111", "1.2.3.4.5.6.7.8", "300.1.1.1", "+1 (487) 555-7209",
             "a@b.c@d.e", "x@y", "@", "+", "é.x@mail.example.com", "9" * 40, "1.2.3", " ", ", ", "12-34"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(12))
        assert base(text) == brute(text)


def test_extra_kinds():
    def kinds(text):
        return [(k, text[a:b]) for k, a, b in pii.find_spans(text, pii.anchors())]

    assert ("wide_email", "josé@exämple.com") in kinds("an josé@exämple.com.")
    assert ("login", "https://ann:pw@host.org") in kinds("see https://ann:pw@host.org/x")
    assert ("iban", "DE89 3704 0044 0532 0130 00") in kinds("IBAN DE89 3704 0044 0532 0130 00, ok")
    assert ("ssn", "123-45-6789") in kinds("SSN: 123-45-6789")
    assert ("secret", "9b0b3c6a43eb78aa") in kinds('token = "9b0b3c6a43eb78aa"')
    assert ("ipv6", "2001:db8::ff00:42:8329") in kinds("at 2001:db8::ff00:42:8329.")
    assert ("masked_email", "ann.b [at] mail [dot] org") in kinds("write ann.b [at] mail [dot] org now")
    assert kinds("A clean line: 12:30, 3.14, C++ and std::vector; price 10-20.") == []


def test_rows_as_they_come(spark):
    big = "x " * 300_000 + "a@b.co"
    rows = [(1, None, "z"), (None, "a@b.co", "z"), (2, "", None), (2, "", None), (3, big, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = {(r.id, len(r.spans)) for r in pii.find_pii(docs).collect()}
    assert got == {(1, 0), (None, 1), (2, 0), (3, 1)}
    assert pii.find_pii(docs).count() == 5
    assert pii.find_pii(docs.limit(0)).count() == 0
    out = pii.redact(docs)
    assert out.schema == docs.schema
    texts = [r.text for r in out.collect()]
    assert texts.count(None) == 1 and texts.count("") == 2
    assert {(t or "")[-9:] for t in texts} == {"", "<EMAIL>", "x <EMAIL>"}


def test_query_digest(spark):
    from chunkwell.llm.queries import REGISTRY

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = REGISTRY["op1_pii"](spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = brute(texts[r.doc_id])
        joined = ",".join(":".join(map(str, s)) for s in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in PATTERNS]
