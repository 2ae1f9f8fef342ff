"""What must not grow faster than the tables: texts read once, rows that a task holds, rows that are shuffled."""

from pyspark.sql import functions as F

from attestor.functions import parse
from attestor.operators import evaluate, folds, metrics
from attestor.plans import catalogue
from attestor.sources import adapters

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_families_are_lexed_once(spark):
    """The query's folds, inner folds and decisions read a table of families, not the texts."""
    for name in ("grouped_folds", "grouped_crossfit"):
        assert _plan(catalogue.queries()[name](spark, SF)).count("regexp_extract_all") <= 1, name


def _systems_multiply_profiles(spark, name):
    plan = _plan(catalogue.queries()[name](spark, SF))
    assert "Aggregate [profile" in plan and plan.rindex("Generate") < plan.index("Aggregate [profile")


def test_systems_multiply_profiles_not_records(spark):
    """Records are counted by profile before anything multiplies them: no task holds a row a record and system."""
    _systems_multiply_profiles(spark, "sample_f1")


def test_weighted_scores_are_those_of_repeated_records(spark):
    rows = [(1, 0, 0, 3), (0, 0, 0, 2), (1, 1, 0, 4), (0, 0, 2, 1)]
    schema = "s string, tp long, fp long, fn long, w long"
    once = spark.createDataFrame([("a", *r) for r in rows], schema)
    repeated = spark.createDataFrame([("a", *r) for r in rows for _ in range(r[3])], schema)
    for both_empty in (0.0, 1.0):
        assert metrics.sample_scores(once, ["s"], both_empty, "w").collect() == metrics.sample_scores(repeated, ["s"], both_empty).collect()


def test_profiles_hold_the_decisions(spark):
    records = adapters.orders_records(spark, SF)
    columns = ["dataset", "label", "truth", "v1", "v2", "v3", "pattern"]
    direct = adapters.decisions_of(records).select("record_key", *columns)
    packed = adapters.profile_decisions(adapters.profiles(records), ["record_key"]).select("record_key", *columns)
    assert direct.dtypes == packed.dtypes
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, packed.collect()))


def test_systems_multiply_profiles_where_empty_is_zero(spark):
    _systems_multiply_profiles(spark, "sample_f1_empty_zero")


def test_run_problems_join_no_wide_rows(spark):
    """Rows and entries meet by digest: no join carries their fields, and every pair of equal index still counts."""
    schema = "record_index int, record_id string, source_id string, source_sha256 string, ground_truth_binary int"
    entries = [(0, "r0", "s0", "h", 1), (1, "r1", "s1", "h", None), (1, "r1", "s1", "h", 0), (2, "r2", None, "h", 1), (4, "a", "b:c", "", 1), (5, "r5", "s5", "h", 1), (None, "n", "m", "h", 1)]
    rows = [(0, "r0", "s0", "h", 1), (1, "r1", "s1", "h", None), (1, "r1", "s1", "h", 1), (1, "r1", "s1", "h", 1), (2, "r2", "", "h", 1), (4, "a", "b", ":c", 1), (5, "r5", "s5", "h", 1), (5, "r5", "s5", "h", 1), (9, "r9", "s9", "h", 0), (9, "r9", "t9", "h", 0), (None, "r", "q", "h", 0)]
    df = evaluate.run_problems(spark.createDataFrame(rows, schema), spark.createDataFrame(entries, schema), len(entries), False)
    expected = [("manifest_without_index", "n"), ("row_without_index", "r"), ("manifest_duplicate_index", "1"), ("duplicate_index", "1"), ("duplicate_index", "5"), ("duplicate_index", "9"), ("unknown_index", "9"), ("row_without_identity", "2"), ("duplicate_identity", "s1"), ("duplicate_identity", "s5")]
    expected += [("manifest_mismatch", str(r[0])) for r in rows for e in entries if r[0] is not None and r[0] == e[0] and r != e]
    assert sorted(map(tuple, df.collect())) == sorted(expected)
    assert "Join" not in _plan(df)


def test_responses_are_read_once(spark):
    """The result's list is looked up once to find its object and once to read it, however many parts the answer has."""
    assert _plan(catalogue.queries()["validate_response"](spark, SF)).count("$.vulnerabilities") <= 2


def test_first_object_of_odd_responses(spark):
    texts = [None, "", "{", "{{{", '{"x": {"vulnerabilities": [1]}} {"vulnerabilities": [2]}', 'a{b {"vulnerabilities": null} {"vulnerabilities": []} z', 'é{"a": "{"} ```json\n{"vulnerabilities": {}}\n```', '{"vulnerabilities": ["é{"]} t']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", parse.extract_result(F.col("t")).alias("r")).orderBy("i")
    # An object's text runs to the end of its candidate.
    expected = [None, None, None, None, '{"vulnerabilities": [1]}} {"vulnerabilities": [2]}', '{"vulnerabilities": []} z', '{"vulnerabilities": {}}\n```', '{"vulnerabilities": ["é{"]} t']
    assert [r.r for r in df.collect()] == expected


def _folds_shuffle_narrow_rows(spark, name):
    """What folds are dealt by crosses shuffles without its hash, and decisions come from counts by profile: no join and
    no shuffle has a row a decision."""
    plan = _plan(catalogue.queries()[name](spark, SF))
    assert "Aggregate [outer_fold" in plan and "profile" in plan
    decisions = [line for line in plan.split("\n") if "Generate explode(array(struct(label" in line]
    assert decisions and all("profile" in line or "four" in line for line in decisions)
    assert not [line for line in plan.split("\n") if "RepartitionByExpression" in line and "_h#" in line]


def test_prevalence_crossfit_shuffles_narrow_rows(spark):
    _folds_shuffle_narrow_rows(spark, "prevalence_crossfit")


def test_rank_is_the_order_of_hashes(spark):
    """With groups that are null, of two columns or of none, and rows that are equal but for a column beside them."""
    import hashlib

    rows = [(k, [None, "a", "a|b", ""][k % 4], k % 3 if k % 5 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, g string, h int")
    for by in ([], ["g"], ["g", "h"]):
        found = folds.hashed_rank(df, by, F.col("k").cast("string")).collect()
        groups = {}
        for r in found:
            groups.setdefault(tuple(r[c] for c in by), []).append((r["rank"], hashlib.sha256(str(r.k).encode()).hexdigest()))
        assert sum(map(len, groups.values())) == 400
        for members in groups.values():
            assert [n for n, _ in sorted(members)] == list(range(1, len(members) + 1))
            assert [x for _, x in sorted(members)] == sorted(x for _, x in members)


def test_logistic_stacker_shuffles_narrow_rows(spark):
    _folds_shuffle_narrow_rows(spark, "logistic_stacker")
