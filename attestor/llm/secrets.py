"""Secret scans by assignment-aware lexing.

Source and configuration text is lexed into names, string literals (plain, with prefixes, triple-quoted), bare words and
operators, and these into name-literal pairs (``name = "literal"``, ``"name": literal``, ``NAME=literal``, ``name: type =
literal``, ``name := literal``, ``name => literal``). Values are folded over ``+`` and over adjacent strings; names in
them stand for the constants last assigned to them in a scope that is still open (a line that is less indented than an
assignment ends its scope). Each value is scored by how sensitive its target name is and how random it looks. The three
base kinds are grammar rules of the same scan.

Defined results: a null text counts as an empty one and has no spans; repeated rows are scanned each on its own; an
empty table gives an empty table; only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

from pyspark.sql import DataFrame

from .common import map_columns, replace_texts, text_rows

# The base grammar of the contract. All three are ASCII; only the keywords of `assign` ignore case.
ASSIGN = r"""(?a:(?i:(?:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
KINDS = ("assign", "access", "hex", "literal", "constant")

#: Words in a target name and how much each says that the value is a credential.
NAME_WEIGHTS = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "authkey": 1.0, "bearer": 0.8, "auth": 0.6, "signature": 0.5, "key": 0.4, "pass": 0.7}
PLACEHOLDER = re.compile(r"(?i)(changeme|placeholder|example|your[_-]?\w*|null|none|true|false|undefined|x{3,}|\*{3,}|\.{3,}|<[^>]*>|\$\{?\w.*|\{\{.*)\Z")
LITERAL_MIN = 8
#: Characters above which a value that constants are folded into is no longer followed.
FOLDED_MOST = 1024
THRESHOLD = 1.0

_assign, _access, _hex = re.compile(ASSIGN), re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{%d,}" % HEX_MIN)
_token = re.compile(
    r"""(?P<space>[ \t]++)
    | (?P<line>\r?\n|\r)
    | (?P<string>(?:\b[rRbBuUfF]{1,2}(?=["']))?(?P<q>\"{3}|'{3}|["']))
    | (?P<assign>=>|:=|[:=](?![=/]))
    | (?P<plus>\+)
    | (?P<word>[A-Za-z0-9_$][A-Za-z0-9_.$/-]*+(?:\+[A-Za-z0-9_.$/-]++)*+(?:={1,2}(?![A-Za-z0-9+/_.=$"'-]))?)
    | (?P<open>[\[({])
    | (?P<close>[\])}])
    | (?P<other>.)""",
    re.X,
)
_string_end = {q: re.compile(rf"(?:[^\\{q[0]}\n]|\\.)*+{q}" if len(q) == 1 else rf"(?:[^\\{q[0]}]|\\[\s\S]|{q[0]}(?!{q[1:]}))*+{q}") for q in ('"', "'", '"' * 3, "'" * 3)}
_bare_name = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$-]*\Z")
_sensitive = re.compile("|".join(sorted({re.escape(w[:4]) for w in NAME_WEIGHTS})) + "|api.?key", re.I)  # no name weighs anything without one
_space = re.compile(r"\s")
_split = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")


def name_weight(name: str) -> float:
    """The largest weight among the name's words, taken singly or two joined (``api`` + ``key``)."""
    words = [w.lower() for w in _split.split(name) if w]
    return max((NAME_WEIGHTS.get(w, 0.0) for w in [*words, *(a + b for a, b in zip(words, words[1:]))]), default=0.0)


def randomness(value: str) -> float:
    """0 to 1: Shannon entropy against 4 bits a character, less for one class of characters only."""
    if not value:
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = bool(re.search("[a-z]", value)) + bool(re.search("[A-Z]", value)) + bool(re.search("[0-9]", value)) + bool(re.search(r"[^A-Za-z0-9\s]", value))
    return min(1.0, bits / 4.0) * (0.4 + 0.2 * min(classes, 3))


def tokens(text: str):
    """(kind, value, start, end) of a text, from left to right: strings by their content, with the place of it. A quote
    that nothing closes is a character like others."""
    at, n = 0, len(text)
    dead: dict[str, int] = {}  # where each kind of quote may open a string again, after one that nothing closes
    while at < n:
        m = _token.match(text, at)
        kind = m.lastgroup if m.lastgroup != "q" else "string"
        if m["q"]:
            q = m["q"]
            end = None
            if m.end() > dead.get(q, -1):
                end = _string_end[q].match(text, m.end())
                if not end:
                    line = text.find("\n", m.end()) if len(q) == 1 else n
                    dead[q] = line if line >= 0 else n
            if end:
                yield "string", text[m.end() : end.end() - len(q)], m.end(), end.end() - len(q)
                at = end.end()
            else:
                yield "other", m[0], m.start(), m.end()
                at = m.end()
            continue
        at = m.end()
        if kind != "space":
            yield kind, m[0], m.start(), at


class Constants:
    """Values by name, in scopes by indentation."""

    def __init__(self):
        self.values: dict[str, list] = {}
        self.order: list[tuple[int, str]] = []

    def leave(self, indent: int) -> None:
        while self.order and self.order[-1][0] > indent:
            self.values[self.order.pop()[1]].pop()

    def put(self, name: str, indent: int, value) -> None:
        self.values.setdefault(name, []).append(value)
        self.order.append((indent, name))

    def get(self, name: str):
        found = self.values.get(name)
        return found[-1] if found else None


def lex_pairs(text: str):
    """(name, value, whether the value is a bare name, spans, whether constants are part of it) of each assignment.

    A span delimits a literal without its quotes, for a constant where it was assigned; strings that are folded are one
    span from the first to the last.
    """
    given = [*tokens(text), ("line", "", len(text), len(text))]
    known = Constants()
    indent = line_start = k = 0
    fresh = True
    while k < len(given):
        kind, value, start, end = given[k]
        if kind == "line":
            line_start, fresh = end, True
            k += 1
            continue
        if fresh:
            indent, fresh = start - line_start, False
            known.leave(indent)
        if kind not in ("word", "string") or not (kind == "string" or _bare_name.match(value)) or not value or len(value) > 200:
            k += 1
            continue
        name, j = value, k + 1
        while given[j][0] == "close" and given[j][1] in "])":
            j += 1
        if given[j][0] != "assign":
            k += 1
            continue
        j += 1
        if given[j - 1][1] == ":" and given[j][0] == "word" and given[j + 1][0] == "assign" and given[j + 1][1] == "=":
            j += 2  # name: type = value
        parts, spans, folded, bare = [], [], False, False
        while True:
            kind, value, start, end = given[j]
            if kind == "string":
                parts.append(value)
                if spans and not folded and spans[-1][2]:
                    spans[-1] = (spans[-1][0], end, True)
                else:
                    spans.append((start, end, True))
            elif kind == "word":
                constant = known.get(value) if _bare_name.match(value) else None
                if constant:
                    parts.append(constant[0])
                    spans += [(a, b, False) for a, b in constant[1]]
                    folded = True
                elif parts:
                    break
                else:
                    parts, bare = [value], _bare_name.match(value) is not None
                    spans = [(start, end, False)]
                    j += 1
                    break
            else:
                break
            j += 1
            if given[j][0] == "plus":
                j += 1
            elif given[j][0] != "string":
                break
        if not parts:
            k += 1
            continue
        places = list(dict.fromkeys((a, b) for a, b, _ in spans))
        if folded and sum(map(len, parts)) > FOLDED_MOST:  # k = k + k, again and again
            known.put(name, indent, None)
        else:
            value = "".join(parts)
            yield name, value, bare, places, folded
            known.put(name, indent, (value, places))
        # The last word may be the name of the next pair, as in a=b=c.
        k = j - 1 if given[j][0] in ("assign", "close") and given[j - 1][0] in ("word", "string") and j - 1 > k else j


def scan(text: str) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of a text, by start and then kind; ends are exclusive, in code points."""
    found = [("assign", m.start(), m.end()) for m in _assign.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_MIN]
    found += [("access", m.start(), m.end()) for m in _access.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    found += [("hex", m.start(), m.end()) for m in _hex.finditer(text)]
    if ("=" in text or ":" in text) and _sensitive.search(text):
        base = [(s, e) for k, s, e in found if k == "assign"]  # in order and disjoint
        starts = [s for s, _ in base]
        more = set()
        for name, value, bare, spans, constants in lex_pairs(text):
            weight = name_weight(name)
            if not weight or len(value) < LITERAL_MIN or PLACEHOLDER.match(value) or _space.search(value) or (bare and weight < 0.9):
                continue
            if weight + randomness(value) > THRESHOLD + (0.6 if bare else 0.4):
                for s, e in spans:
                    k = bisect_right(starts, s) - 1
                    if constants:
                        more.add(("constant", s, e))
                    elif k < 0 or base[k][1] < e:
                        more.add(("literal", s, e))
        found += more
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each (merged) span replaced by ``mark``."""
    out, at = [], 0
    for _, s, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:] if spans else text


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts of the base kinds, digest of the base spans, all spans and the redacted text."""

    def make():
        def fn(ids, texts):
            for i, text in zip(ids, texts, strict=True):
                spans = scan(text)
                base = [x for x in spans if x[0] in KINDS[:3]]
                n = Counter(k for k, _, _ in base)
                yield i, n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), redact(text, spans) if spans else None

        return fn

    return map_columns(text_rows(docs, id_col, text_col), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string")


def without_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with each secret in their texts replaced by a mark; null texts stay null."""
    return replace_texts(docs, text_col, lambda: lambda text: redact(text, scan(text)) if text else text)
