"""Scalar functions over columns: safe ratios, digests, category names, identities, patterns, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered rules of the two category rule sets; the first rule with a phrase in the text wins.
_EXACT_OTHER = ("other",)
RULES_A: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("other", _EXACT_OTHER, ()),
    ("reentrancy", (), ("reentr",)),
    ("arithmetic", (), ("overflow", "underflow", "arithmetic", "arithm")),
    ("unchecked_low_level_calls", (), ("unchecked low level", "unchecked ll", "unhandled exception", "unchecked call", "unchecked external call")),
    ("locked_ether", (), ("locked ether",)),
    ("bad_randomness", (), ("randomness",)),
    ("denial_of_service", ("dos",), ("denial of service",)),
    ("transaction_ordering", (), ("front running", "front run", "transaction order")),
    ("time_manipulation", (), ("time manipulation", "timestamp dependence", "block timestamp")),
    ("tx_origin", (), ("tx origin", "txorigin")),
    ("short_addresses", (), ("short address",)),
    ("access_control", (), ("access control", "authorization", "unauthorized", "privilege escalation", "unprotected function")),
)
EXTRA_B = {
    "transaction_ordering": ("timestamp ordering",),
    "time_manipulation": ("timestamp dependency", "timing attack"),
    "access_control": ("unprotected ether withdrawal", "unprotected fallback"),
}
RULES_B = tuple((name, exact, (*phrases, *EXTRA_B.get(name, ()))) for name, exact, phrases in RULES_A)
RULESETS = {"A": RULES_A, "B": RULES_B}


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as double, 0.0 where the denominator is 0 or the ratio null."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def code_digest(text: Column) -> Column:
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)


def canonical_category(category: Column, ruleset: str = "A") -> Column:
    """The closed-taxonomy name of a free-text category, or null."""
    text = F.trim(F.regexp_replace(F.lower(category), r"[^\p{L}\p{N}]+", " "))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, exact, phrases in RULESETS[ruleset]:
        tests = [text == e for e in exact] + [F.contains(text, F.lit(p)) for p in phrases]
        hit = tests[0]
        for t in tests[1:]:
            hit = hit | t
        out = out.when(hit, F.lit(name))
    return out


def normalize_category(category: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(category), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def dedupe_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def canonical_dataset(name: Column, aliases: dict[str, str]) -> Column:
    key = normalize_category(name)
    pairs = [F.lit(x) for kv in aliases.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key) if pairs else key


def safe_filename(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_")


def source_identifier(address: Column, name: Column, contract_index: Column, position: Column) -> Column:
    """First non-empty of address, name and contract index, else ``contract_{position}``."""
    filled = [F.nullif(c.cast("string"), F.lit("")) for c in (address, name, contract_index)]
    return F.coalesce(*filled, F.concat(F.lit("contract_"), position.cast("string")))


def stable_id(identifier: Column, text: Column, index: Column) -> Column:
    return F.concat_ws("::", identifier.cast("string"), F.substring(code_digest(text), 1, 16), F.lpad(index.cast("string"), 8, "0"))


def json_hash(columns: dict[str, Column]) -> Column:
    """SHA-256 of compact JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)])), 256)


def hash32(text: Column) -> Column:
    """The first eight hex digits of SHA-256 as an integer."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def stable_seed(base: int, *parts: Column) -> Column:
    return F.pmod(F.lit(base).cast("long") + hash32(F.concat_ws("|", *parts)), F.lit(1 << 32).cast("long"))


def exact_family(text: Column) -> Column:
    lines = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"^\s+|\s+$", ""), r"[ \t\x0B\f\r]+(?=\n)", "")
    return F.sha2(lines, 256)


# What each step of the lexical normaliser replaces, in order, and the tokens of what is left.
LEXICAL_STEPS = (
    (r"(?s)/\*.*?\*/", " "),
    (r"//[^\n]*", " "),
    (r'"(?:\\.|[^"\\])*"', " <string> "),
    (r"'(?:\\.|[^'\\])*'", " <string> "),
    (r"\b0x[0-9a-fA-F]+\b", " <hex> "),
    (r"(?i)\b\d+(?:\.\d+)?(?:e[+-]?\d+)?\b", " <number> "),
)
LEXICAL_TOKENS = r"[A-Za-z_$][A-Za-z0-9_$]*|==|!=|<=|>=|=>|&&|\|\||\+\+|--|\S"


def lexical_tokens(text: Column) -> Column:
    out = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    for pattern, by in LEXICAL_STEPS:
        out = F.regexp_replace(out, pattern, by)
    return F.regexp_extract_all(F.lower(out), F.lit(LEXICAL_TOKENS), F.lit(0))


def lexical_family(text: Column) -> Column:
    return F.sha2(F.array_join(lexical_tokens(text), " "), 256)


def parse_labels(text: Column) -> Column:
    return F.filter(F.split(text, ";"), lambda x: x != "")


def agreement_pattern(*votes: Column) -> Column:
    return F.concat(*[v.cast("int").cast("string") for v in votes])


def record_stratum(labels: Column) -> Column:
    return F.when(F.size(labels) > 0, F.array_join(F.array_sort(labels), "|")).otherwise("clean")


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def format_duration(seconds: Column, with_days: bool = True) -> Column:
    """``1d 02h 03m``, ``2h 03m 04s``, ``3m 04s`` or ``4s``; ``n/a`` (``unknown`` without days) where not known."""
    whole = F.rint(seconds).cast("long")
    days, rest = (F.floor(whole / 86400), whole % 86400) if with_days else (F.lit(0), whole)
    hours, minutes, secs = F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60
    out = F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0) | (F.abs(seconds) == float("inf")), "n/a" if with_days else "unknown")
    if with_days:
        out = out.when(days > 0, F.concat(days.cast("string"), F.lit("d "), _two(hours), F.lit("h "), _two(minutes), F.lit("m")))
    out = out.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), _two(minutes), F.lit("m "), _two(secs), F.lit("s")))
    return out.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), _two(secs), F.lit("s"))).otherwise(F.concat(secs.cast("string"), F.lit("s")))


def model_label(text: Column, names: dict[str, str]) -> Column:
    """The first of ``names`` (needle -> name) found in the lower-cased text; an error if there is none."""
    out = None
    for needle, name in names.items():
        hit = F.contains(F.lower(text), F.lit(needle))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.raise_error(F.concat(F.lit("no model name in "), text)).cast("string"))


ACCEPTED_LEGACY = r"^valid_after_(?:structural|targeted|closed_choice)_repair_[a-z0-9.]+$"


def is_accepted(status: Column, accepted: tuple[str, ...]) -> Column:
    return status.isin(*accepted) | status.rlike(ACCEPTED_LEGACY)


def record_status(chunk_accepted: Column) -> Column:
    """ok, partial or failed from an array of booleans."""
    return F.when(F.forall(chunk_accepted, lambda x: x), "ok").when(F.exists(chunk_accepted, lambda x: x), "partial").otherwise("failed")


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of token windows of ``size`` with ``overlap``; one window where everything fits."""
    step = size - overlap
    return F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (n - 1).cast("int"), F.lit(step)))


def split_windows(tokens: Column, size: int, overlap: int) -> Column:
    return F.transform(window_starts(F.size(tokens), size, overlap), lambda s: F.slice(tokens, s + 1, F.lit(size)))
