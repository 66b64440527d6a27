"""Personal data by anchor expansion: an automaton finds cues, local parsers settle the spans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of reports: the base kinds, then what the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "account", "userinfo", "obfuscated", "secret")

#: Cues that announce an account or identity number, in lower case.
ACCOUNT_CUES = (
    "account number", "account no", "account #", "acct no", "acct #", "acct.", "routing number", "passport no",
    "passport number", "social security number", "ssn", "tax id", "kontonummer", "numéro de compte", "número de cuenta",
)
#: Cues that announce a value to keep secret, in lower case.
SECRET_CUES = (
    "token", "secret", "password", "passwd", "pwd", "passphrase", "api key", "api_key", "api-key", "apikey",
    "access key", "access_key", "accesskey", "private key", "private_key", "credential", "bearer",
)
#: Characters of a secret: fewer are none, and a quoted one ends after as many.
SECRET_LEAST, SECRET_MOST = 8, 4096
#: Schemes whose address may carry a user and a password.
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "sftp://", "postgres://", "postgresql://", "mysql://", "mongodb://", "redis://", "amqp://")
#: Spellings of the at-sign that avoid it.
AT_SPELLINGS = ("[at]", "(at)", "{at}", " at ")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_DIGIT = frozenset("0123456789")
_CALL = frozenset(" ().0123456789-")


@lru_cache(maxsize=1)
def _cues() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for cue in ("@", "+"):
        out.add_word(cue, (cue, 1))
    for d in "0123456789":
        out.add_word(d, ("digit", 1))
    for cue in SCHEMES:
        out.add_word(cue, ("scheme", len(cue)))
    for cue in ACCOUNT_CUES:
        out.add_word(cue, ("account", len(cue)))
    for cue in SECRET_CUES:
        out.add_word(cue, ("secret", len(cue)))
    for cue in AT_SPELLINGS:
        out.add_word(cue, ("spelled", len(cue)))
    out.make_automaton()
    return out


def _left(text: str, at: int, least: int, kind: frozenset) -> int:
    while at > least and text[at - 1] in kind:
        at -= 1
    return at


def _right(text: str, at: int, kind: frozenset) -> int:
    while at < len(text) and text[at] in kind:
        at += 1
    return at


def _domain(text: str, at: int) -> int:
    """Where a domain of two labels or more that starts at ``at`` ends; -1 if there is none."""
    end = _right(text, at, _LABEL)
    if end == at:
        return -1
    labels = 1
    while end < len(text) and text[end] == "." and (nxt := _right(text, end + 1, _LABEL)) > end + 1:
        end, labels = nxt, labels + 1
    return end if labels > 1 else -1


def _email(text: str, at: int, least: int) -> tuple[int, int] | None:
    start = _left(text, at, least, _LOCAL)
    if start == at or (end := _domain(text, at + 1)) < 0:
        return None
    return start, end


def _four_numbers(text: str, at: int) -> tuple[int, bool] | None:
    """The end of four dotted numbers from ``at``, and whether each is 255 at most."""
    parts = []
    for i in range(4):
        if i and (at >= len(text) or text[at] != "."):
            return None
        at += bool(i)
        end = _right(text, at, _DIGIT)
        if end == at:
            return None
        parts.append(text[at:end])
        at = end
    return at, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _digits_run(text: str, at: int) -> int:
    """The end of digits from ``at`` with at most one space or hyphen between two."""
    end = at + 1
    while end < len(text):
        if text[end] in _DIGIT:
            end += 1
        elif text[end] in " -" and end + 1 < len(text) and text[end + 1] in _DIGIT:
            end += 2
        else:
            break
    return end


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    """Whether an account number in the international form has the right check digits."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _phone(text: str, at: int) -> int:
    """The end of a call number from its plus sign; -1 if there is none."""
    if at + 1 >= len(text) or text[at + 1] not in _DIGIT:
        return -1
    end = _right(text, at + 2, _CALL)
    while end > at + 3 and text[end - 1] not in _DIGIT:
        end -= 1
    return end if end >= at + 4 and text[end - 1] in _DIGIT else -1


_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"[\s:#=]{0,4}([0-9][0-9-]{5,18}[0-9])(?![0-9A-Za-z])")
_ASSIGNED = re.compile(r"""["'`]?[ \t]{0,4}(?:=>|:=|[:=])[ \t]{0,4}""")
_USER = re.compile(r"([^\s/@:]+:[^\s/@]+)@")
_DOT = re.compile(r"\s?(?:[\[({]dot[\])}]| dot |\.)\s?", re.IGNORECASE)


def _spelled_email(text: str, start: int, end: int) -> tuple[int, int] | None:
    """``name [at] host [dot] com``: at least one of at-sign and dot must be bracketed."""
    left = _left(text, start - (text[start - 1 : start] == " "), 0, _LOCAL)
    at = end + (text[end : end + 1] == " ")
    stop, labels, bracketed = _right(text, at, _LABEL), 1, text[start] != " "
    if left >= start - (text[start - 1 : start] == " ") or stop == at:
        return None
    while (dot := _DOT.match(text, stop)) and (nxt := _right(text, dot.end(), _LABEL)) > dot.end():
        bracketed |= any(c in dot.group() for c in "[({")
        stop, labels = nxt, labels + 1
    return (left, stop) if labels > 1 and bracketed else None


def _secret(text: str, at: int, bearer: bool) -> tuple[int, int] | None:
    """The value assigned by a cue that ends at ``at``: up to its closing quote, or bare with a digit in it."""
    sign = _ASSIGNED.match(text, at)
    if not sign:
        if not bearer or text[at : at + 1] != " ":
            return None
        start = at + 1
    else:
        start = sign.end()
    quote = text[start : start + 1]
    if quote and quote in "\"'`":
        start += 1
        end = text.find(quote, start, start + SECRET_MOST + 1)
        return (start, end) if end - start >= SECRET_LEAST and "\n" not in text[start:end] else None
    end = start
    while end < len(text) and not text[end].isspace() and text[end] not in "\"'`,;<>()[]{}":
        end += 1
    found = text[start:end]
    return (start, end) if end - start >= SECRET_LEAST and any(c in _DIGIT for c in found) else None


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in a whole text, in code points, end exclusive; a null text is empty.

    Spans of a kind don't overlap and are the leftmost; what fails its check is passed over whole.
    """
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE_KINDS, *ADDED_KINDS)}
    if not text:
        return out
    past = dict.fromkeys(out, 0)
    low = text.lower()
    if len(low) != len(text):
        # A few capitals grow in lower case and stay as they are, so that positions match.
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    for last, (cue, length) in _cues().iter(low):
        at = last - length + 1
        if cue == "digit":
            if at >= past["card"]:
                end = _digits_run(text, at)
                if end > at + 1:
                    digits = text[at:end].replace(" ", "").replace("-", "")
                    past["card"] = end
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append((at, end))
            if at >= past["iban"] + 2 and (m := _IBAN.match(text, at - 2)):
                past["iban"] = m.end()
                if 15 <= len(bare := m.group().replace(" ", "")) <= 34 and iban_valid(bare):
                    out["iban"].append(m.span())
            if at >= past["ip"]:
                if four := _four_numbers(text, at):
                    past["ip"] = four[0]
                    if four[1]:
                        out["ip"].append((at, four[0]))
                else:
                    past["ip"] = _right(text, at, _DIGIT)
        elif cue == "@":
            if at >= past["email"] and (span := _email(text, at, past["email"])):
                out["email"].append(span)
                past["email"] = span[1]
        elif cue == "+":
            if at >= past["phone"] and (end := _phone(text, at)) > 0:
                past["phone"] = end
                if 8 <= sum(c in _DIGIT for c in text[at:end]) <= 15:
                    out["phone"].append((at, end))
        elif cue == "account":
            edge = at == 0 or not text[at - 1].isalnum()
            if edge and last + 1 >= past["account"] and (m := _ACCOUNT.match(text, last + 1)):
                out["account"].append(m.span(1))
                past["account"] = m.end(1)
        elif cue == "scheme":
            if last + 1 >= past["userinfo"] and (m := _USER.match(text, last + 1)):
                out["userinfo"].append(m.span(1))
                past["userinfo"] = m.end(1)
        elif cue == "secret":
            edge = at == 0 or not text[at - 1].isalnum()
            if edge and last + 1 >= past["secret"] and (span := _secret(text, last + 1, low.startswith("bearer", at))):
                out["secret"].append(span)
                past["secret"] = span[1]
        elif at >= past["obfuscated"] and (span := _spelled_email(text, at, last + 1)):
            if span[0] >= past["obfuscated"]:
                out["obfuscated"].append(span)
                past["obfuscated"] = span[1]
    return out


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` of the kinds in order, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def redact(text: str | None, found: dict[str, list[tuple[int, int]]]) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first and longest."""
    if text is None:
        return None
    spans = sorted((a, -b, k) for k, v in found.items() for a, b in v)
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k}]"]
            at = -b
    return "".join([*out, text[at:]])


_COUNTS = ", ".join(f"n_{k} long" for k in BASE_KINDS)
_MORE = ", ".join(f"n_{k} long" for k in ADDED_KINDS)


def personal_data(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Find personal data in every whole text of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns a row per row: doc_id,
    the base kinds' counts, ``base_sha256``, ``spans`` and the added kinds' counts, and with ``with_text`` the ``redacted`` text.
    A null text counts as empty and has no spans (its redacted text is null); rows that repeat get
    equal rows; null doc_ids stay null; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, hashes, spans, texts = {k: [] for k in (*BASE_KINDS, *ADDED_KINDS)}, [], [], []
            for value in b.column("text"):
                text = value.as_py()
                found = find(text)
                for k, into in counts.items():
                    into.append(len(found[k]))
                hashes.append(hashlib.sha256(joined(found, BASE_KINDS).encode()).hexdigest())
                spans.append(joined(found, (*BASE_KINDS, *ADDED_KINDS)))
                if with_text:
                    texts.append(redact(text, found))
            number = lambda kinds: [pa.array(counts[k], pa.int64()) for k in kinds]
            columns = [b.column("doc_id"), *number(BASE_KINDS), pa.array(hashes, pa.string()), pa.array(spans, pa.string()), *number(ADDED_KINDS)]
            names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", *(f"n_{k}" for k in ADDED_KINDS)]
            if with_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id long, {_COUNTS}, base_sha256 string, spans string, {_MORE}" + ", redacted string" * with_text
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
