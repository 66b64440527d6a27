import hashlib
import re

import pytest
from helpers import DOCS, corpus, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from echosieve.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def brute(t):
    bare = lambda m: re.sub(r"[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 16 <= len(bare(m)) <= 19 and luhn(bare(m))],
        "phone": [m.span() for m in PHONE.finditer(t) if 8 <= len(bare(m)) <= 15],
    }


@settings(max_examples=1500, deadline=None)
@given(st.one_of(*(st.text(alphabet=a, max_size=50) for a in ("a@.-1 ", "12.3 -+()", "+12 ().-", "0123456789 -", "255.0.1.300.4@x+", "É@.İ1+a9 -"))))
def test_base_kinds_against_patterns(text):
    found = pii.find(text)
    assert {k: found[k] for k in pii.BASE_KINDS} == brute(text)


@pytest.mark.parametrize(("text", "kind", "span"), [
    ("mail jo [at] mail [dot] example [dot] com now", "obfuscated", "jo [at] mail [dot] example [dot] com"),
    ("see https://bob:secret@host.org/x", "userinfo", "bob:secret"),
    ("IBAN GB82 WEST 1234 5698 7654 32.", "iban", "GB82 WEST 1234 5698 7654 32"),
    ("Account number: 1234-567890", "account", "1234-567890"),
    ('x token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" y', "secret", "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"),
    ("client_secret: 's3cr3t-value'", "secret", "s3cr3t-value"),
    ("API_KEY=abcd1234efgh, next", "secret", "abcd1234efgh"),
    ("Authorization: Bearer abc.def-123456", "secret", "abc.def-123456"),
    ('"password": "correct horse battery"', "secret", "correct horse battery"),
    ("a (GB82WEST12345698765432)", "iban", "GB82WEST12345698765432"),
])
def test_added_kinds(text, kind, span):
    assert [text[a:b] for a, b in pii.find(text)[kind]] == [span]


@pytest.mark.parametrize("text", ["meet at noon. or at dot com times", "GB82 WEST 1234 5698 7654 33", "The assn 12 met", "http://host/path", "look at example.com today", "a token of thanks: gratitude", "the secret: nothing", "password = \"short\"", "tokens12345678", "bearer of news"])
def test_clean_texts_have_no_added_spans(text):
    found = pii.find(text)
    assert not any(found[k] for k in pii.ADDED_KINDS)


def test_query_columns(spark):
    rows = [*corpus(1, 10), (100, "a@b.co, +49 (30) 1234567, 10.0.0.1 and 4485 1684 3212 3129é x@y.z", "en", None, 1), (101, "7 a " * 50_000 + " é q@w.de", "en", None, 1)]
    docs = frame(spark, [*rows, rows[-1]])
    got = [r for r in pii.personal_data(docs, with_text=True).collect()]
    assert len(got) == len(rows) + 1
    texts = {i: t or "" for i, t, *_ in rows}
    for r in got:
        want = brute(texts[r.doc_id])
        base = ",".join(f"{k}:{a}:{b}" for k in pii.BASE_KINDS for a, b in want[k])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in pii.BASE_KINDS]
    assert next(r.redacted for r in got if r.doc_id == 100).startswith("[email], [phone]")
    assert pii.personal_data(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize(("text", "kind", "span"), [
    ("İstanbul: SSN 123-456789", "account", "123-456789"),
    ("İ Account Number: 1234-567890", "account", "1234-567890"),
    ("İİ HTTPS://bob:secret@host.org/x", "userinfo", "bob:secret"),
    ("İ JO [AT] mail [DOT] example [DOT] com", "obfuscated", "JO [AT] mail [DOT] example [DOT] com"),
])
def test_capital_cues_beside_a_letter_that_grows(text, kind, span):
    assert [text[a:b] for a, b in pii.find(text)[kind]] == [span]


def test_added_kinds_planted(spark):
    """Of added kinds planted in long texts all are found, and their counts are reported."""
    planted = {
        "iban": "GB82 WEST 1234 5698 7654 32", "account": "Account no: 12345678", "userinfo": "ftp://joe:hunter22@host", "obfuscated": "jo [at] mail [dot] com",
        "secret": 'token = "0123456789abcdef0123456789abcdef01234567"',
    }
    rows = [(i, "filler words " * (i % 50) + " ; ".join([p, "more words"] * (i % 3 + 1)), "en", k, i) for i in range(100) for k, p in planted.items()]
    rows += [(None, planted["secret"], "en", "secret", 0), (7, None, "en", "none", 0)]
    docs = frame(spark, rows)
    got = pii.personal_data(docs).collect()
    for kind in planted:
        assert sum(r[f"n_{kind}"] for r in got) == sum(i % 3 + 1 for i, _, _, k, _ in rows if k == kind and i is not None) + (kind == "secret")
    assert sum(r.doc_id is None for r in got) == 1


def test_recall_of_secrets_in_the_given_documents(spark):
    from pathlib import Path

    d = "/root/testdata/sf0.01"
    if not Path(d).exists():
        pytest.skip("no tables here")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    with_one = docs.where("text rlike '[0-9a-f]{32,}'")
    found = pii.personal_data(with_one).where("n_secret > 0").count()
    assert found >= 0.9 * with_one.count() > 0
