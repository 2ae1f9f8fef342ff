import json

import pytest
from pyspark.sql import functions as F

from attestor.sources import readers, sinks
from attestor.streaming import ingest


def test_json_lines(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"record_index": 0, "status": "ok"}\n\n{"record_index": 1, "status": "partial"}\n')
    assert [r.status for r in readers.json_lines(spark, str(good)).orderBy("record_index").collect()] == ["ok", "partial"]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"record_index": 0}\n[1]\n{"record_index": 1} trailing\n{bad\n{"record_index": 0}\n')
    with pytest.raises(Exception, match="bad JSON line"):
        readers.json_lines(spark, str(bad)).collect()
    first, counters = readers.tolerant_runs(readers.json_lines(spark, str(bad), strict=False))
    assert first.count() == 1
    row = counters.first()
    assert (row.corrupt_rows, row.duplicate_rows) == (3, 1)


def test_truths(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"code": "a\r\nb", "vulnerabilities": [{"category": "front_running"}, {"category": "nope"}]}]))
    curated = readers.json_document(spark, str(tmp_path / "c.json"), "code string, vulnerabilities array<struct<category:string>>")
    assert readers.curated_truth(curated).first().truth == ["transaction_ordering"]
    (tmp_path / "a.json").write_text(json.dumps([{"address": "0x1", "code": "x", "vulnerabilities": [{"RENT": 1}, {"DOS": 0}, {"Tx-Origin": 1}]}]))
    address = readers.json_document(spark, str(tmp_path / "a.json"), "address string, code string, vulnerabilities array<map<string,int>>")
    assert readers.address_truth(address).first().truth == ["reentrancy", "tx_origin"]
    binary = spark.createDataFrame([("0x1", "x", 1)], "address string, code string, vulnerablility int")
    assert readers.binary_truth(binary, binary).count() == 2


def test_discovery_and_provenance(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("{}\n")
    (tmp_path / "x.metadata.json").write_text("{}")
    (tmp_path / "y.jsonl").write_text("{}\n")
    pairs = readers.pair_sidecars(readers.discover(spark, str(tmp_path)), readers.discover(spark, str(tmp_path), "*.metadata.json"))
    assert {r.stem: r.metadata_path is not None for r in pairs.collect()} == {"x": True, "y": False}
    assert readers.provenance(spark, str(tmp_path / "x.jsonl")).first().bytes == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "k string, v double")
    sinks.write_csv(df, str(tmp_path / "out"), columns=["k", "v"])
    assert readers.csv_rows(spark, str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError):
        sinks.write_csv(df, str(tmp_path / "other"), columns=["k"])
    with pytest.raises(ValueError):
        sinks.write_csv(df.where("false"), str(tmp_path / "other"), refuse_empty=True)
    assert json.loads(sinks.json_bundle({"t": df}))["t"][0] == {"k": "a", "v": 0.5}
    assert "| a | 0.500000 |" in sinks.report({"Table": df}, "Title")
    assert sinks.replace_verified(df, str(tmp_path / "table")) == 2
    assert sinks.replace_verified(df.where("v = 0.5"), str(tmp_path / "table")) == 1
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1


def test_ingest_is_resumable(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows = spark.createDataFrame([(k, f"v{k}") for k in range(10)], "record_index long, v string")
    rows.write.parquet(source)
    for _ in range(2):
        ingest.append_new(ingest.stream_of(spark, source, rows.schema), target, check, ["record_index"]).awaitTermination()
    assert spark.read.parquet(target).count() == 10
    rows.withColumn("record_index", F.col("record_index") + 5).write.mode("append").parquet(source)
    ingest.append_new(ingest.stream_of(spark, source, rows.schema), target, check, ["record_index"]).awaitTermination()
    assert spark.read.parquet(target).count() == 15
    manifest = spark.range(20).withColumnRenamed("id", "record_index")
    assert ingest.pending(manifest, spark.read.parquet(target), ["record_index"]).count() == 5


def test_windowed_progress(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:10' AS ts, 'u' AS user, 2.0D AS value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.windowed_progress(ingest.stream_of(spark, str(tmp_path / "in"), rows.schema), "ts", "1 minute", "1 minute", ["user"])
    stream.writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("progress").first().rows == 1


def test_imports_are_checked(spark, tmp_path):
    (tmp_path / "b").write_text("x")
    assert readers.first_existing(spark, [str(tmp_path / "a"), str(tmp_path / "b")]) == str(tmp_path / "b")
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, [str(tmp_path / "a")])
    records = spark.createDataFrame([("d", "1"), ("d", "2")], "dataset string, record_key string")
    folds = records.withColumn("fold", F.col("record_key").cast("int") - 1)
    assert readers.import_folds(folds, records, 2).count() == 2
    with pytest.raises(ValueError, match="range"):
        readers.import_folds(folds, records, 1)
    with pytest.raises(ValueError, match="differ"):
        readers.import_folds(folds.where("fold = 0"), records, 2)
    with pytest.raises(ValueError, match="several"):
        readers.import_folds(folds.unionByName(folds), records, 2)
    rows = spark.createDataFrame([("static", "s", 2), ("static", "s", 1), ("llm", "s", 0)], "system_type string, system string, n int")
    assert [r.n for r in readers.reference_rows(rows, ["static"], ["system"], ["n"]).collect()] == [1]
    assert sinks.union_rows([records, folds]).columns == ["dataset", "record_key", "fold"]
