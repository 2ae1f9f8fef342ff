"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, schemes and identifier cues); deterministic
local parsers expand each anchor to its boundaries and validate it. Work beyond the automaton's pass follows the
anchors, not the text.

Defined results: a null text counts as an empty one and has no spans; repeated rows are scanned each on its own; an
empty table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

from pyspark.sql import DataFrame

from .common import map_columns, text_rows

KINDS = ("email", "ip", "card", "phone", "iban", "account", "login_url")

# The base grammar of the contract, each rule anchored at a position given by the automaton.
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_card = re.compile(r"[0-9]([\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_run = re.compile(r"[0-9]+")

_iban = re.compile(r"[\x20:#=]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_account = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?|id))?[\x20:#=]{1,3}([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9])", re.I | re.A)
_login = re.compile(r"://([^\s/:@]+:[^\s/@]+)@[A-Za-z0-9.-]+")
CUES = ("IBAN", "iban", "account", "Account", "acct", "Acct", "SSN", "ssn", "passport", "Passport")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in ("@", "+", "://", *"0123456789", *CUES):
        found.add_word(word, word)
    found.make_automaton()
    return found


def scan(text: str, anchors) -> list[tuple[str, int, int]]:
    """All (kind, start, end) by start and then kind; ends are exclusive, in code points."""
    found: list[tuple[str, int, int]] = []
    email_end = ip_end = card_end = phone_end = run_end = 0
    for last, word in anchors.iter(text):
        if word == "@":
            start = last
            while start > email_end and text[start - 1] in _local:
                start -= 1
            if start < last and (m := _domain.match(text, last)):
                found.append(("email", start, email_end := m.end()))
        elif word == "+":
            if last >= phone_end and (m := _phone.match(text, last)):
                phone_end = m.end()
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.append(("phone", last, phone_end))
        elif word == "://":
            if m := _login.match(text, last - 2):
                found.append(("login_url", m.start(1), m.end(1)))
        elif len(word) == 1:
            if last < run_end:
                continue
            run_end = _run.match(text, last).end()
            if last >= ip_end and (m := _ip.match(text, last)):
                ip_end = m.end()
                if all(len(v := p.lstrip("0")) <= 3 and int(v or 0) <= 255 for p in m[0].split(".")):
                    found.append(("ip", last, ip_end))
            if last >= card_end and (m := _card.match(text, last)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", last, card_end))
        elif word in ("IBAN", "iban"):
            if (m := _iban.match(text, last + 1)) and iban_valid(m[1]):
                found.append(("iban", m.start(1), m.end(1)))
        elif m := _account.match(text, last + 1):
            found.append(("account", m.start(1), m.end(1)))
    return sorted(set(found), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def pii_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts of the base kinds, digest of the base spans, all spans."""

    def make():
        anchors = automaton()

        def fn(ids, texts):
            for i, text in zip(ids, texts, strict=True):
                spans = scan(text, anchors) if text else []
                base = [x for x in spans if x[0] in KINDS[:4]]
                n = Counter(k for k, _, _ in base)
                yield i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)

        return fn

    return map_columns(text_rows(docs, id_col, text_col), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
