"""Scans: JSON documents, strict and tolerant JSON lines, CSV, run discovery, ground truth, file provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Label maps and taxonomies of the three corpora.
CURATED_LABELS = {"access_control": "access_control", "arithmetic": "arithmetic", "bad_randomness": "bad_randomness", "denial_of_service": "denial_of_service", "front_running": "transaction_ordering", "other": "other", "reentrancy": "reentrancy", "short_addresses": "short_addresses", "time_manipulation": "time_manipulation", "unchecked_low_level_calls": "unchecked_low_level_calls"}
ADDRESS_LABELS = {"ARTHM": "arithmetic", "DOS": "denial_of_service", "LE": "locked_ether", "RENT": "reentrancy", "TimeM": "time_manipulation", "TimeO": "transaction_ordering", "TX-Origin": "tx_origin", "Tx-Origin": "tx_origin", "UE": "unchecked_low_level_calls"}
CURATED_TAXONOMY = tuple(sorted(set(CURATED_LABELS.values())))
ADDRESS_TAXONOMY = tuple(sorted(set(ADDRESS_LABELS.values())))
BINARY_TAXONOMY = tuple(sorted((set(CURATED_TAXONOMY) | set(ADDRESS_TAXONOMY)) - {"other"}))

FINDING = "struct<category:string,function:string,severity:string,description:string,recommendation:string>"
ATTEMPT = "struct<attempt_index:int,chat_protocol:string,input_tokens:int,raw_response:string,generated_token_count:int,parse_status:string,validation_errors:array<string>,error:string,traceback:string>"
CHUNK = f"struct<chunk_index:int,input_tokens:int,raw_response:string,generated_token_count:int,parse_status:string,validation_errors:array<string>,error:string,traceback:string,accepted_findings:array<{FINDING}>,attempts:array<{ATTEMPT}>,repair_details:struct<method:string,old_parse_status:string,parent_parse_status:string,resolved:boolean>>"
PREDICTION = f"record_index int, record_id string, source_id string, source_sha256 string, ground_truth_binary int, status string, chunk_count int, valid_chunk_count int, runtime_seconds double, vulnerabilities array<{FINDING}>, chunks array<{CHUNK}>, repair_details struct<parent_status:string,actions:map<string,int>,resolved:boolean,runtime_seconds:double,prompt_version:string>"
MANIFEST = "record_index int, record_id string, source_id string, source_sha256 string, ground_truth_binary int"


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1) and value of text lines. Lines are counted by file split, so files need not be whole in a
    task; the counts, one row a split, are broadcast."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_nr"))
    blocks = lines.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_nr").alias("_first"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "_block", "_first", earlier.alias("_earlier"))
    return lines.join(F.broadcast(blocks), ["file", "_block"]).select("file", (F.col("_earlier") + F.col("_nr") - F.col("_first") + 1).alias("line_no"), "value")


def json_lines(spark: SparkSession, path: str, schema: str = PREDICTION, strict: bool = True) -> DataFrame:
    """JSON lines with their file and line_no, blank ones skipped. Strict: a bad line is an error that names both; else
    ``_corrupt`` holds it. A line is bad if it is no object or has text after one.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    struct = T.StructType.fromDDL(schema).add("_corrupt_record", "string")
    parsed = lines.select("value", "file", "line_no", F.from_json("value", struct, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r._corrupt_record").isNotNull() | ~F.col("value").rlike(r"^\s*\{[\s\S]*\}\s*$")
    columns = [F.col(f"r.{c}").alias(c) for c in T.StructType.fromDDL(schema).fieldNames()]
    if strict:
        place = F.concat(F.lit("bad JSON line at "), "file", F.lit(":"), F.col("line_no").cast("string"))
        checked = parsed.withColumn("r", F.when(bad, F.raise_error(place).cast(struct)).otherwise(F.col("r")))
        return checked.select(*columns, "file", "line_no")
    return parsed.select(*columns, "file", "line_no", F.when(bad, F.col("value")).alias("_corrupt"))


def tolerant_runs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first row of each file and record index, counters of corrupt and duplicate rows by file)."""
    counters = lines.groupBy("file").agg(F.count_if(F.col("_corrupt").isNotNull()).alias("corrupt_rows"), (F.count_if(F.col("_corrupt").isNull()) - F.count_distinct(F.when(F.col("_corrupt").isNull(), F.col("record_index")))).alias("duplicate_rows"))
    good = lines.where("_corrupt is null").drop("_corrupt")
    first = good.groupBy("file", "record_index").agg(F.min_by(F.struct(*good.columns), "line_no").alias("r"))
    return first.select("r.*"), counters


def completed_records(spark: SparkSession, path: str, schema: str = PREDICTION) -> DataFrame:
    """The rows of a run that is to be resumed: strict JSON lines, each with an index that no other line has."""
    from ..operators.validate import duplicate_keys, require_empty

    rows = json_lines(spark, path, schema)
    require_empty(rows.where("record_index is null").select("file", "line_no"), "lines without a record_index")
    require_empty(duplicate_keys(rows, ["record_index"]), "record_index values twice")
    return rows


def run_files(spark: SparkSession, root: str, datasets: list[str], each: int = 3) -> DataFrame:
    """The run files of the datasets (folders of the root), or an error if one does not have exactly ``each``."""
    from ..operators.validate import require_empty

    found = discover(spark, root).withColumn("dataset", F.regexp_extract("directory", r"([^/]+)$", 1)).where(F.col("dataset").isin(*datasets))
    wanted = spark.createDataFrame([(d,) for d in datasets], "dataset string")
    counts = wanted.join(found.groupBy("dataset").agg(F.count("*").alias("files")), "dataset", "left").select("dataset", F.coalesce("files", F.lit(0)).alias("files"))
    require_empty(counts.where(F.col("files") != each), f"each dataset needs {each} run files")
    return found


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; quoted line breaks and a byte-order mark are understood."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', encoding="UTF-8")


def discover(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, directory, stem, length of the files below a root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")
    return files.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory"), F.regexp_extract("path", r"([^/]+?)(?:\.metadata)?\.[^./]+$", 1).alias("stem"), "length")


def pair_sidecars(data: DataFrame, metadata: DataFrame) -> DataFrame:
    """Data files with their metadata sidecars; orphans of either kind have a null on the other side."""
    a = data.select("directory", "stem", F.col("path").alias("data_path"))
    b = metadata.select("directory", "stem", F.col("path").alias("metadata_path"))
    return a.join(b, ["directory", "stem"], "full_outer")


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def curated_truth(corpus: DataFrame, labels: dict[str, str] = CURATED_LABELS) -> DataFrame:
    """record_key (digest of the source) and the set of mapped categories."""
    from ..functions.scalar import code_digest

    mapping = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    names = F.transform("vulnerabilities", lambda v: F.try_element_at(mapping, v["category"]))
    return corpus.select(code_digest(F.col("code")).alias("record_key"), "code", F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull()))).alias("truth"))


def address_truth(corpus: DataFrame, labels: dict[str, str] = ADDRESS_LABELS) -> DataFrame:
    """record_key (address) and the set of mapped tags with a true value."""
    mapping = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    tags = F.flatten(F.transform("vulnerabilities", lambda m: F.map_keys(F.map_filter(m, lambda _, v: v != 0))))
    names = F.transform(tags, lambda t: F.try_element_at(mapping, t))
    return corpus.select(F.col("address").alias("record_key"), "code", F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull()))).alias("truth"))


def binary_truth(vulnerable: DataFrame, secure: DataFrame) -> DataFrame:
    """record_key and a 0/1 label of the two files together (the source spells its column "vulnerablility")."""
    return vulnerable.unionByName(secure).select(F.col("address").alias("record_key"), "code", F.col("vulnerablility").alias("truth"))


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists in its file system; an error that names all of them otherwise."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    raise FileNotFoundError(f"none of these exists: {', '.join(paths)}")


def import_folds(folds: DataFrame, records: DataFrame, n: int, keys: tuple[str, ...] = ("dataset", "record_key")) -> DataFrame:
    """A fold table made elsewhere, checked: every record once, folds 0 to n - 1, nothing unknown."""
    from ..operators.validate import duplicate_keys, key_set_difference, require_empty

    keys = list(keys)
    require_empty(duplicate_keys(folds, keys), "records with several folds")
    require_empty(key_set_difference(folds, records, keys), "fold table and records differ")
    require_empty(folds.where(~F.col("fold").between(0, n - 1) | F.col("fold").isNull()), "folds out of range")
    return folds.select(*keys, F.col("fold").cast("int").alias("fold"))


def import_oof(scores: DataFrame, records: DataFrame, folds: DataFrame, labels: list[str]) -> DataFrame:
    """An out-of-fold table made elsewhere, checked: every record and label once, nothing unknown, scores in [0, 1], and
    the folds and truths that the records have."""
    from ..operators.validate import duplicate_keys, key_set_difference, require_empty

    keys = ["dataset", "record_key", "label"]
    cells = records.select("dataset", "record_key", F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"), *(["truth"] if "truth" in records.columns else []))
    require_empty(duplicate_keys(scores, keys), "cells with several scores")
    require_empty(key_set_difference(scores, cells, keys), "scored cells and records differ")
    require_empty(scores.where(~F.coalesce(F.col("score").between(0, 1), F.lit(False))), "scores out of range")
    other = scores.join(folds.select("dataset", "record_key", F.col("fold").alias("_fold")), ["dataset", "record_key"]).where(~F.col("fold").eqNullSafe(F.col("_fold")))
    require_empty(other, "scores of another fold")
    if "truth" in scores.columns and "truth" in cells.columns:
        wrong = scores.join(cells.withColumnRenamed("truth", "_truth"), keys).where(F.col("truth") != F.array_contains("_truth", F.col("label")).cast("int"))
        require_empty(wrong, "scores with another truth")
    return scores.select(*keys, "fold", "score")


def reference_rows(rows: DataFrame, system_types: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """Published rows of the given kinds, the first of each key."""
    from ..operators.folds import dedupe_first

    return dedupe_first(rows.where(F.col("system_type").isin(*system_types)), keys, order)
