"""Reading model responses: JSON candidates, closed-choice markers, attempt outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import normalize_category

FENCE = r"(?is)```(?:json)?\s*(.*?)```"


def json_candidates(text: Column) -> Column:
    """The whole trimmed text, then what each code fence holds."""
    fenced = F.regexp_extract_all(text, F.lit(FENCE), F.lit(1))
    return F.concat(F.array(F.trim(text)), F.transform(fenced, lambda x: F.trim(x)))


def extract_result(text: Column, key: str = "vulnerabilities") -> Column:
    """The first JSON object (as text) with ``key`` at its top level; null if there is none.

    Each candidate is tried whole and then from each of its opening braces on; the JSON reader stops at the end of an
    object, so text after it does no harm.
    """

    def first(candidate: Column) -> Column:
        """The first object with the key from one of the candidate's braces on; the rest is not read."""
        braces = F.length(candidate) - F.length(F.replace(candidate, F.lit("{"), F.lit("")))
        later = F.when(braces > 0, F.sequence(-braces, F.lit(-1))).otherwise(F.array().cast("array<int>"))

        def step(found: Column, k: Column) -> Column:
            tail = F.concat(F.lit("{"), F.call_function("substring_index", candidate, F.lit("{"), k))
            return F.when(found.isNotNull(), found).when(F.get_json_object(tail, f"$.{key}").isNotNull(), tail)

        return F.aggregate(later, F.lit(None).cast("string"), step)

    def either(found: Column, candidate: Column) -> Column:
        return F.when(found.isNotNull(), found).otherwise(first(candidate))

    return F.aggregate(json_candidates(text), F.lit(None).cast("string"), either)


def _once(value: Column, use) -> Column:
    """``use(value)`` where ``value`` is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _categories(body: Column, allowed: list[str]) -> Column:
    def checked(found: Column) -> Column:
        return F.when(F.forall(found, lambda x: F.coalesce(x.isin(*allowed), F.lit(False))), F.array_sort(F.array_distinct(found)))

    names = F.from_json(body, "array<struct<category:string>>")
    return _once(F.transform(names, lambda x: normalize_category(x["category"])), checked)


def result_categories(text: Column, allowed: list[str]) -> Column:
    """Distinct category names of the first result object; null unless all of them are in the taxonomy."""
    return _categories(F.get_json_object(extract_result(text), "$.vulnerabilities"), allowed)


def response_outcome(text: Column, allowed: list[str]) -> Column:
    """valid, missing_result, schema_violation or taxonomy_violation of a raw response."""

    def outcome(body: Column) -> Column:
        return F.when(body.isNull(), "missing_result").when(~F.startswith(F.trim(body), F.lit("[")), "schema_violation").when(_categories(body, allowed).isNull(), "taxonomy_violation").otherwise("valid")

    return _once(F.get_json_object(extract_result(text), "$.vulnerabilities"), outcome)


def validated_findings(text: Column, allowed: list[str], key: str = "vulnerabilities") -> Column:
    """struct(findings, errors) of a response: its findings with five fields each, and an error text by index for each
    item that is no object or has a category outside the taxonomy. Null where the field is no list."""

    def field(item: Column, name: str) -> Column:
        return F.trim(F.coalesce(F.get_json_object(item, f"$.{name}"), F.lit("")))

    def read(item: Column, k: Column) -> Column:
        def told(given: Column) -> Column:
            category = normalize_category(F.coalesce(given, F.lit("none")))
            at = F.concat(F.lit("finding["), k.cast("string"), F.lit("]"))
            error = F.when(~F.coalesce(F.startswith(F.trim(item), F.lit("{")), F.lit(False)), F.concat(at, F.lit(" is not an object"))).when(
                ~category.isin(*allowed), F.concat(at, F.lit(" category "), F.coalesce(F.concat(F.lit("'"), given, F.lit("'")), F.lit("None")), F.lit(" is outside the allowed taxonomy"))
            )
            finding = F.struct(category.alias("category"), field(item, "function").alias("function"), F.lower(field(item, "severity")).alias("severity"), field(item, "description").alias("description"), field(item, "recommendation").alias("recommendation"))
            return F.struct(error.alias("error"), F.when(error.isNull(), finding).alias("finding"))

        return _once(F.get_json_object(item, "$.category"), told)

    def split(found: Column) -> Column:
        good = F.transform(F.filter(found, lambda x: x["error"].isNull()), lambda x: x["finding"])
        bad = F.transform(F.filter(found, lambda x: x["error"].isNotNull()), lambda x: x["error"])
        return F.when(found.isNotNull(), F.struct(good.alias("findings"), bad.alias("errors")))

    def listed(body: Column) -> Column:
        return F.when(F.startswith(F.trim(body), F.lit("[")), F.from_json(body, "array<string>"))

    body = F.get_json_object(extract_result(text, key), f"$.{key}")
    return _once(_once(body, lambda b: F.transform(listed(b), read)), split)


# Phrases that tell the outcomes of an attempt apart, in order of precedence.
RUNTIME_STATUS = ("inference_error", "runtime_error")
RUNTIME_TEXT = ("cuda", "out of memory", "traceback", "generation failed")
TAXONOMY_TEXT = ("outside the allowed taxonomy", "outside the taxonomy")
SCHEMA_TEXT = ("is not an object", "is not a list", "must be a list", "missing vulnerabilities")
SYNTAX_TEXT = ("no valid json result object", "jsondecodeerror", "unterminated", "expecting value", "extra data")


def _any(text: Column, phrases) -> Column:
    out = F.contains(text, F.lit(phrases[0]))
    for p in phrases[1:]:
        out = out | F.contains(text, F.lit(p))
    return out


def classify_attempt(status: Column, text: Column) -> Column:
    """The outcome of one attempt from its parse status and all of its text."""
    status, text = F.lower(F.coalesce(status, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(status == "valid", "valid")
        .when(_any(status, RUNTIME_STATUS) | _any(text, RUNTIME_TEXT), "runtime_failure")
        .when(_any(text, TAXONOMY_TEXT), "taxonomy_violation")
        .when(_any(text, SCHEMA_TEXT), "schema_violation")
        .when(_any(text, SYNTAX_TEXT), "json_syntax_or_missing_result")
        .when(F.contains(status, F.lit("valid_with_rejected_items")), "other_validation_failure")
        .otherwise("other_failure")
    )


def _agreed(parsed: Column) -> Column:
    """The one value of all markers, or null if there is none, one is invalid, or they differ."""
    ok = (F.size(parsed) > 0) & F.forall(parsed, lambda x: x.isNotNull()) & (F.size(F.array_distinct(parsed)) == 1)
    return F.when(ok, F.element_at(parsed, 1))


def _marker_values(text: Column, name: str) -> Column:
    raw = F.regexp_extract_all(text, F.lit(rf"(?im)\b{name}\s*=\s*([^\r\n]+)"), F.lit(1))
    return F.transform(raw, lambda x: F.regexp_replace(x, r"^[`* .\s]+|[`* .\s]+$", ""))


def marker_categories(text: Column, allowed: list[str]) -> Column:
    def one(value):
        names = F.transform(F.filter(F.split(value, ","), lambda p: F.trim(p) != ""), normalize_category)
        valid = (F.size(names) > 0) & F.forall(names, lambda n: n.isin(*allowed))
        return F.when(F.upper(value) == "NONE", F.array().cast("array<string>")).when(valid, F.array_distinct(names))

    return _agreed(F.transform(_marker_values(text, "CATEGORIES"), one))


def marker_ids(text: Column, allowed: list[str]) -> Column:
    names = F.array(*[F.lit(a) for a in allowed])

    def one(value):
        ids = F.array_distinct(F.transform(F.split(value, ","), lambda p: F.trim(p).try_cast("int")))
        valid = value.rlike(r"^\d+(?:\s*,\s*\d+)*$") & F.forall(ids, lambda k: k.isNotNull() & (k >= 1) & (k <= len(allowed)))
        return F.when(F.upper(value) == "NONE", F.array().cast("array<string>")).when(valid, F.transform(ids, lambda k: F.try_element_at(names, k)))

    return _agreed(F.transform(_marker_values(text, "LABEL_IDS"), one))


def marker_bits(text: Column, allowed: list[str]) -> Column:
    names = F.array(*[F.lit(a) for a in allowed])
    raw = F.regexp_extract_all(text, F.lit(r"(?im)\bBITVECTOR\s*=\s*([01](?:\s*,\s*[01])*)"), F.lit(1))

    def one(value):
        bits = F.transform(F.split(value, ","), lambda p: F.trim(p))
        chosen = F.filter(F.transform(bits, lambda b, k: F.when(b == "1", F.try_element_at(names, k + 1))), lambda x: x.isNotNull())
        return F.when(F.size(bits) == len(allowed), chosen)

    return _agreed(F.transform(raw, one))


def findings_for_categories(categories: Column) -> Column:
    """Finding structs that carry a category only."""
    empty = [F.lit("").alias(x) for x in ("function", "severity", "description", "recommendation")]
    return F.transform(categories, lambda c: F.struct(c.alias("category"), *empty))


def structural_repair(responses: Column, allowed: list[str]) -> Column:
    """The newest response whose list is only of taxonomy strings, as categories; null if there is none."""

    def one(text):
        names = F.from_json(F.get_json_object(extract_result(text), "$.vulnerabilities"), "array<string>")
        return _once(names, lambda x: F.when(F.forall(x, lambda n: F.coalesce(n.isin(*allowed), F.lit(False))), F.array_distinct(x)))

    return F.try_element_at(F.filter(F.transform(F.reverse(responses), one), lambda x: x.isNotNull()), F.lit(1))


def system_prompt(categories: list[str], variant: str = "strict") -> str:
    """A closed-schema instruction in one of three wordings."""
    listed = ", ".join(categories)
    schema = '{"vulnerabilities": [{"category": "...", "function": "...", "severity": "...", "description": "...", "recommendation": "..."}]}'
    texts = {
        "strict": f"Report findings as one JSON object of this schema and nothing else: {schema} Categories: {listed}.",
        "stepwise": f"Go through the source function by function, then answer with a JSON object. Schema: {schema} Allowed categories: {listed}.",
        "audit": f"Act as an auditor. Use only these categories: {listed}. The answer is JSON with this schema: {schema}",
    }
    return texts[variant]
