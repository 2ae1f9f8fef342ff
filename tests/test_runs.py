import pytest
from pyspark.sql import functions as F

from attestor.operators import runs


def test_manifest_and_digest(spark):
    corpus = spark.createDataFrame([(0, "0xa", "x\r\ny", 1), (1, "0xb", "z", 0)], "n long, address string, code string, label int")
    entries = runs.manifest(corpus, "address", "code", "n", "label")
    assert entries.first().record_id.startswith("0xa::") and entries.first().record_id.endswith("::00000000")
    row = runs.manifest_digest(entries).first()
    assert (row.record_count, row.positives, row.negatives) == (2, 1, 1)
    assert runs.manifest_digest(entries.orderBy(F.desc("record_index"))).first().records_sha256 == row.records_sha256
    assert runs.manifest_digest(entries.where("record_index = 0")).first().records_sha256 != row.records_sha256


def test_fingerprints():
    meta = {"config": {"model": "m"}, "record_count": 3, "created_at_utc": "a"}
    meta["run_fingerprint"] = runs.fingerprint(meta)
    assert runs.fingerprint({**meta, "created_at_utc": "b"}) == meta["run_fingerprint"]
    shard = runs.derived(meta, "shard", shard=1)
    assert shard["parent_fingerprint"] == meta["run_fingerprint"] != shard["run_fingerprint"]
    runs.require_same_run(meta, dict(meta))
    with pytest.raises(ValueError, match="shard"):
        runs.require_same_run(meta, shard)
    assert runs.model_spec("org/name@0123abc") == ("org/name", "0123abc")
    with pytest.raises(ValueError):
        runs.model_spec("org/name@main")


def test_parents(spark):
    rows = [("m", "r", "d", 3, 1, "b", "h"), ("m", "r", "d", 3, 0, "c", "h"), ("m", "r", "d", 2, 0, "a", "g")]
    found = runs.find_parent(spark.createDataFrame(rows, "model string, model_revision string, dataset string, record_count int, rank int, path string, records_sha256 string"), "m", "r", "d", 3).first()
    assert (found.path, found.versions) == ("c", 1)


def test_latest_repair_and_flat_text(spark):
    rows = [(1, '{"repair_a": {"x": 1}, "repair_b": {"x": 2}, "repair_c": 3}'), (2, '{"repair_details": {"x": 9}, "repair_z": {"x": 1}}'), (3, '{"a": ["b", {"c": "d"}], "e": 1}')]
    df = spark.createDataFrame(rows, "k long, raw string")
    assert {r.k: r.repair for r in runs.latest_repair(df, "k", "raw").collect()} == {1: '{"x": 2}', 2: '{"x": 9}', 3: None}
    assert {r.k: r.flat for r in runs.flattened_text(df, "k", "raw").collect()}[3] == "b d"


def test_repair_and_recompute(spark):
    rows = [
        ("a", 0, "valid", [], ["x"]),
        ("a", 1, "parse_or_validation_error", ['{"vulnerabilities": ["y", "x"]}', "noise"], None),
        ("b", 0, "parse_or_validation_error", ["noise"], None),
        ("c", 0, "valid_after_retry", [], []),
    ]
    chunks = spark.createDataFrame(rows, "record_key string, chunk_index int, parse_status string, responses array<string>, categories array<string>")
    fixed = runs.structural_rewrite(chunks, ["x", "y"])
    assert [r.action for r in fixed.orderBy("record_key", "chunk_index").collect()] == ["already_valid", "structural", "inference", "already_valid"]
    records = {r.record_key: r for r in runs.recompute(fixed).collect()}
    assert {k: r.status for k, r in records.items()} == {"a": "ok", "b": "failed", "c": "ok"}
    assert [v.category for v in records["a"].vulnerabilities] == ["x", "y"]
    assert {r.kind: r.records for r in runs.audit_parent(fixed).collect()} == {"structural": 1, "inference": 1, "already_valid": 1}
    assert runs.completion(runs.recompute(fixed)).where("status = 'ok'").first().records == 2


def test_shards_merge(spark):
    entries = spark.range(10).select(F.col("id").alias("record_index"))
    parts = [entries.where(f"record_index % 3 = {k}") for k in range(3)]
    assert [p.count() for p in parts] == [4, 3, 3]
    assert runs.merge_shards(parts, entries, 3).count() == 10
    with pytest.raises(ValueError, match="differ"):
        runs.merge_shards([parts[0], parts[1], parts[2].limit(2)], entries, 3)
    with pytest.raises(ValueError, match="wrong"):
        runs.merge_shards([parts[1], parts[0], parts[2]], entries, 3)
