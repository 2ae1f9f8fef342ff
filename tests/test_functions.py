import pytest
from pyspark.sql import functions as F

from attestor.functions import parse, scalar


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {kind(v)}" for n, v in values.items())).select(column(*[F.col(n) for n in names]).alias("x")).first().x


def kind(v):
    return {int: "long", float: "double", str: "string", type(None): "string", list: "array<string>"}[type(v)]


@pytest.mark.parametrize(
    "text, a, b",
    [
        ("Reentrancy Attack", "reentrancy", "reentrancy"),
        ("Re-entrancy", None, None),
        ("Integer Overflow", "arithmetic", "arithmetic"),
        ("tx.origin", "tx_origin", "tx_origin"),
        ("DoS", "denial_of_service", "denial_of_service"),
        ("dos attack", None, None),
        ("Timestamp dependency", None, "time_manipulation"),
        ("timestamp ordering", None, "transaction_ordering"),
        ("Unprotected Ether Withdrawal", None, "access_control"),
        ("arithmetic access control", "arithmetic", "arithmetic"),
        ("others", None, None),
    ],
)
def test_canonical_category(spark, text, a, b):
    assert one(spark, lambda c: scalar.canonical_category(c, "A"), t=text) == a
    assert one(spark, lambda c: scalar.canonical_category(c, "B"), t=text) == b


def test_taxonomy_names_map_to_themselves(spark):
    from attestor.sources.readers import ADDRESS_TAXONOMY, CURATED_TAXONOMY

    for name in {*ADDRESS_TAXONOMY, *CURATED_TAXONOMY}:
        assert one(spark, lambda c: scalar.canonical_category(c, "A"), t=name) == name


def test_durations(spark):
    for seconds, text in ((4.0, "4s"), (64.0, "1m 04s"), (3661.0, "1h 01m 01s"), (90061.0, "1d 01h 01m"), (-1.0, "n/a")):
        assert one(spark, scalar.format_duration, s=seconds) == text
    assert one(spark, lambda c: scalar.format_duration(c, False), s=90061.0) == "25h 01m 01s"


def test_windows(spark):
    assert one(spark, lambda c: F.transform(scalar.split_windows(c, 4, 1), F.size), t=[str(k) for k in range(10)]) == [4, 4, 4, 1]
    assert one(spark, lambda n: scalar.window_starts(n.cast("int"), 4, 1), n=10) == [0, 3, 6, 9]
    assert one(spark, lambda n: scalar.window_starts(n.cast("int"), 4, 1), n=3) == [0]


def test_fenced_json(spark):
    fence = "```"
    text = f'text {fence}json\n{{"vulnerabilities":[{{"category":"reentrancy"}}]}}\n{fence}'
    assert one(spark, lambda c: parse.result_categories(c, ["reentrancy"]), t=text) == ["reentrancy"]
    bad = '{"vulnerabilities":[{"category":"imaginary_bug"}]}'
    assert one(spark, lambda c: parse.response_outcome(c, ["reentrancy"]), t=bad) == "taxonomy_violation"


def test_attempt_outcomes(spark):
    def outcome(status, text):
        return one(spark, parse.classify_attempt, s=status, t=text)

    assert outcome("valid_with_rejected_items", "finding[0] is not an object") == "schema_violation"
    assert outcome("valid_with_rejected_items", "outside the allowed taxonomy") == "taxonomy_violation"
    assert outcome("valid_with_rejected_items", "") == "other_validation_failure"
    assert outcome("VALID", "cuda") == "valid"
    assert outcome("inference_error", "") == "runtime_failure"
    assert outcome("x", "JSONDecodeError: Expecting value") == "json_syntax_or_missing_result"


def test_markers(spark):
    names = ["a_b", "c", "d"]
    assert one(spark, lambda c: parse.marker_categories(c, names), t="CATEGORIES=NONE") == []
    assert one(spark, lambda c: parse.marker_categories(c, names), t="x\ncategories = `A-B, c`.") == ["a_b", "c"]
    assert one(spark, lambda c: parse.marker_categories(c, names), t="CATEGORIES=NONE\nCATEGORIES=c") is None
    assert one(spark, lambda c: parse.marker_ids(c, names), t="LABEL_IDS=1,2") == ["a_b", "c"]
    assert one(spark, lambda c: parse.marker_ids(c, names), t="LABEL_IDS=4") is None
    assert one(spark, lambda c: parse.marker_bits(c, names), t="BITVECTOR=0,1,0") == ["c"]
    assert one(spark, lambda c: parse.marker_bits(c, names), t="BITVECTOR=0,1") is None


def test_structural_repair(spark):
    rows = ['{"vulnerabilities": ["c"]}', '{"vulnerabilities": ["nope"]}']
    assert one(spark, lambda c: parse.structural_repair(c, ["c"]), t=rows) == ["c"]


def test_prompts_keep_schema():
    texts = {parse.system_prompt(["reentrancy", "arithmetic"], v) for v in ("strict", "stepwise", "audit")}
    assert len(texts) == 3
    assert all("schema" in t.lower() and "reentrancy" in t and "arithmetic" in t for t in texts)


def test_identifiers(spark):
    assert one(spark, lambda a, b, c, p: scalar.source_identifier(a, b, c, p), a="", b="n", c="", p=3) == "n"
    assert one(spark, lambda a, b, c, p: scalar.source_identifier(a, b, c, p), a="", b="", c="", p=3) == "contract_3"
    assert one(spark, scalar.safe_divide, a=1, b=0) == 0.0
    assert one(spark, lambda s: scalar.is_accepted(s, ("valid",)), s="valid_after_targeted_repair_v1.2") is True
    assert one(spark, scalar.sigmoid, x=-800.0) == 0.0
