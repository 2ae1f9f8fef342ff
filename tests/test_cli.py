"""Runs as files: from JSON lines and metadata to reports, and what makes a run unsafe to resume."""

import json

import pytest

from attestor import cli
from attestor.operators import evaluate, exposure, runs
from attestor.sources import readers, sinks

LABELS = ["access_control", "arithmetic", "reentrancy"]
FIELDS = ("record_id", "source_id", "source_sha256", "ground_truth_binary")


def entry(k):
    return {"record_index": k, "record_id": f"r{k}", "source_id": f"a{k}", "source_sha256": f"s{k}", "ground_truth_binary": None}


def attempt(status, text="", error=None):
    return {"parse_status": status, "raw_response": text, "error": error}


def row(k, categories, chunks=None, **more):
    good = attempt("valid", json.dumps({"vulnerabilities": [{"category": c} for c in categories]}))
    return {**entry(k), "status": "ok", "runtime_seconds": 2.0, "vulnerabilities": [{"category": c} for c in categories], "chunks": chunks or [{"chunk_index": 0, "parse_status": "valid", "attempts": [good]}], **more}


def write_run(root, dataset, model, rows, n, count=None, fingerprint="f"):
    folder = root / dataset
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{model}.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    (folder / f"{model}.metadata.json").write_text(json.dumps({"record_count": n if count is None else count, "run_fingerprint": fingerprint, "config": {"model": model, "dataset": dataset}, "records": [entry(k) for k in range(n)]}, indent=1))


@pytest.fixture
def root(tmp_path):
    early = [{"chunk_index": 0, "parse_status": "valid_after_format_retry", "attempts": [attempt("parse_or_validation_error", "not json", "No valid JSON result object"), attempt("valid", '{"vulnerabilities":[]}')]}]
    write_run(tmp_path / "runs", "one", "m1", [row(0, ["Reentrancy"]), "", row(1, [], early), row(2, ["arithmetic", "Access-Control"])], 4)
    write_run(tmp_path / "runs", "one", "m2", [row(k, ["arithmetic"], repair_details={"actions": {"structural": k, "inference": 0}}) for k in range(4)], 4)
    truth = {"a0": ["reentrancy"], "a1": ["reentrancy"], "a2": ["arithmetic"], "a3": []}
    (tmp_path / "truth.jsonl").write_text("\n".join(json.dumps({"record_key": k, "truth": t}) for k, t in truth.items()))
    return tmp_path


def test_evaluate(spark, root):
    args = ["evaluate", str(root / "runs"), "--datasets", "one", "--runs", "2", "--labels", *LABELS, "--truth", str(root / "truth.jsonl"), "--out", str(root / "out")]
    assert cli.main(args, spark) == 0
    tables = cli.evaluate_runs(spark, cli.arguments(args))
    by = {(r.system, r.label): (r.tp, r.fp, r.fn, r.tn) for r in tables["per_class"].collect()}
    assert by["m1", "reentrancy"] == (1, 0, 1, 2) and by["m1", "access_control"] == (0, 1, 0, 3) and by["m2", "arithmetic"] == (1, 3, 0, 0)
    coverage = {r.system: r for r in tables["coverage"].collect()}
    assert (coverage["m1"].records_expected, coverage["m1"].records_missing, coverage["m1"].total_findings) == (4, 1, 3)
    report = (root / "out" / "report.md").read_text()
    assert report.startswith("# evaluate") and "## per_class" in report
    with pytest.raises(ValueError, match="run files"):
        cli.main([*args[:4], "--runs", "3", *args[6:]], spark)


def test_exposure(spark, root):
    args = ["exposure", str(root / "runs"), "--datasets", "one", "--runs", "2", "--labels", *LABELS, "--out", str(root / "audit")]
    assert cli.main(args, spark) == 0
    summary = {r.model: r for r in cli.audit_runs(spark, cli.arguments(args))["exposure"].collect()}
    assert (summary["m1"].format_retry_chunks, summary["m1"].format_recovered_chunks, summary["m1"].recovery_exposed_records) == (1, 1, 1)
    assert (summary["m2"].structural_repair_chunks, summary["m2"].recovery_exposed_records) == (6, 3)


def test_early_retry_is_exposure(spark, root):
    rows = readers.json_lines(spark, str(root / "runs" / "one" / "m1.jsonl"))
    r = exposure.inspect_records(rows, LABELS, ["record_index"]).where("record_index = 1").first()
    assert r.any_recovery_exposure and not r.first_attempt_native_valid
    assert (r.format_retry_chunks, r.format_recovered_chunks, r.outcomes) == (1, 1, ["json_syntax_or_missing_result"])


def test_progress_and_exit_code(spark, root, capsys):
    args = ["progress", str(root / "runs"), "--datasets", "one", "two"]
    assert cli.main(args, spark) == 0
    assert "7 of 8 records" in capsys.readouterr().out
    write_run(root / "runs", "two", "m1", [row(0, []), row(0, ["x"]), "{broken", {**row(1, []), "source_id": "z"}, row(9, [])], 3, count=5)
    assert cli.main([*args, "--json"], spark) == cli.UNSAFE
    run = next(r for r in json.loads(capsys.readouterr().out) if r["dataset"] == "two")
    assert run["completed"] == 3 and run["last_record_index"] == 9 and not run["resumable"]
    assert [p.split(" ", 1)[1] for p in run["problems"]] == ["lists 3 records", "corrupt line(s)", "duplicate record_index value(s)", "record_index value(s) absent from the metadata", "row(s) mismatch the manifest"]


def test_bad_lines_are_named(spark, root):
    path = root / "runs" / "bad.jsonl"
    path.write_text("\n".join(["{}", "", json.dumps(row(1, [])), "[1]", "{}"]))
    with pytest.raises(Exception, match=r"bad\.jsonl:4"):
        readers.json_lines(spark, str(path)).collect()
    tolerant = readers.json_lines(spark, str(path), strict=False)
    assert [r.line_no for r in tolerant.where("_corrupt is not null").collect()] == [4]
    with pytest.raises(ValueError, match="without a record_index"):
        path.write_text("{}\n")
        readers.completed_records(spark, str(path))


def test_strict_runs(spark, root):
    good = readers.json_lines(spark, str(root / "runs" / "one" / "m2.jsonl"))
    manifest = spark.createDataFrame([tuple(entry(k).values()) for k in range(4)], readers.MANIFEST)
    assert evaluate.load_run(good, manifest, 4, False).count() == 4
    for rows, count, message in ((good, 5, "record_count"), (good.unionByName(good.limit(1)), 4, "duplicate_index"), (good.where("false").unionByName(good.limit(1)).selectExpr("* except (source_id)", "'q' as source_id"), 4, "manifest_mismatch")):
        with pytest.raises(ValueError, match=message):
            evaluate.load_run(rows.select(good.columns), manifest, count, False)
    assert evaluate.completed_rows(good.limit(2), manifest).count() == 2
    with pytest.raises(ValueError):
        evaluate.manifest_truth(manifest, spark.createDataFrame([("a0", ["x"])], "record_key string, truth array<string>"), False)
    corpus = spark.createDataFrame([("k", "code", 1), ("", "code", 0)], "key string, text string, label int")
    with pytest.raises(ValueError, match="without text"):
        evaluate.require_corpus(corpus, "text", "key", "label")
    assert evaluate.require_corpus(corpus.where("key <> ''"), "text", "key", "label").count() == 1
    assert evaluate.head(manifest, "record_index", 2).count() == 2 and evaluate.head(manifest, "record_index", None).count() == 4


def test_values_outside_their_range_are_errors(spark, root):
    rows = readers.json_lines(spark, str(root / "runs" / "one" / "m1.jsonl"))
    with pytest.raises(Exception, match="outside the taxonomy"):
        exposure.inspect_records(rows, ["reentrancy"], ["record_index"]).collect()
    with pytest.raises(Exception, match="no chunks"):
        exposure.inspect_records(rows.selectExpr("* except (chunks)", "slice(chunks, 1, 0) as chunks"), LABELS, ["record_index"]).collect()


def test_paths_and_parents(spark, tmp_path):
    assert runs.run_paths("/r/", "org/model", "0123456789abcdef", "one") == ("/r/one/results_org_model_0123456789ab_one.jsonl", "/r/one/results_org_model_0123456789ab_one.metadata.json")
    assert runs.shard_paths("/r", "m_one", 3, 8)[0] == "/r/shards/m_one_shard_03_of_08.jsonl"
    assert runs.portable_path("/r/a\\b.csv", "/r") == "a/b.csv" and runs.portable_path("/x/y.csv", "/r") == "y.csv"
    found = spark.createDataFrame([("p1", 0, "m", "r", "d", 3, "h"), ("p2", 0, "m", "r", "d", 4, "h"), ("p3", 1, "m", "r", "d", 3, "g")], "path string, rank int, model string, model_revision string, dataset string, record_count int, records_sha256 string")
    with pytest.raises(ValueError, match="2 different"):
        runs.require_parent(found, "m", "r", "d", 3)
    assert runs.require_parent(found, "m", "r", "d", 4).path == "p2"
    with pytest.raises(ValueError, match="'p1'"):
        runs.require_parent(found, "m", "r", "d", 9)
    entries = spark.createDataFrame([tuple(entry(k).values()) for k in range(5)], readers.MANIFEST)
    digest = runs.manifest_digest(entries.where("record_index < 3")).first().records_sha256
    assert runs.matching_records(entries, digest, 3).count() == 3
    with pytest.raises(ValueError):
        runs.matching_records(entries, "other", 3)
    stamp = runs.completion_stamp({"a": 1}, spark.createDataFrame([("ok",), ("ok",), ("failed",)], "status string"), 4, "now")
    assert stamp["completion"]["status_counts"] == {"failed": 1, "ok": 2} and stamp["completion"]["completed_records"] == 3
    sinks.verified_text(spark, str(tmp_path / "m.json"), json.dumps(stamp))
    assert json.loads((tmp_path / "m.json").read_text()) == stamp


def test_replacement_survives_a_crash(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.replace_verified(spark.range(3).toDF("x"), path) == 3
    assert sinks.replace_verified(spark.range(5).toDF("x"), path) == 5 and spark.read.parquet(path).count() == 5
    (tmp_path / "t").rename(tmp_path / "t.old")  # a crash between the two renames
    assert sinks.replace_verified(spark.range(2).toDF("x"), path) == 2 and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t"]


def test_declared_order(spark):
    df = spark.createDataFrame([("b", 1), ("z", 2), ("a", 3)], "dataset string, n int")
    assert [r.dataset for r in exposure.in_order(df, {"dataset": ["b", "a"]}).collect()] == ["b", "a", "z"]


def test_tables_over_the_bound_are_errors(spark):
    with pytest.raises(ValueError):
        sinks.markdown_table(spark.range(5).toDF("x"), most=4)
