"""Runs: manifests and fingerprints, resumption, parents, selective repair, shards."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.parse import findings_for_categories, structural_repair
from ..functions.scalar import code_digest, is_accepted, record_status, stable_id

ACCEPTED = ("valid", "valid_after_retry")
UNHASHED = ("created_at_utc", "run_fingerprint", "records")


def manifest(records: DataFrame, identifier: str, text: str, order: str, label: str | None = None) -> DataFrame:
    """Ordered entries: record_index from 0, record_id, source_id, source_sha256 and the binary label or null.

    The index is the position by ``order``, which the caller's records carry (a corpus file's row number): consecutive
    already, it is taken as it is; no global sort is needed.
    """
    index = F.col(order).cast("long")
    truth = F.col(label).cast("int") if label else F.lit(None).cast("int")
    return records.select(index.alias("record_index"), stable_id(F.col(identifier), F.col(text), index).alias("record_id"), F.col(identifier).cast("string").alias("source_id"), code_digest(F.col(text)).alias("source_sha256"), truth.alias("ground_truth_binary"))


def manifest_digest(entries: DataFrame) -> DataFrame:
    """records, a digest of all entries that does not depend on their order, and label counts: one row.

    Each entry's SHA-256 gives four 32-bit parts, which are summed apart and hashed: a parallel aggregation.
    """
    digest = F.sha2(F.to_json(F.struct("record_index", "record_id", "source_id", "source_sha256", "ground_truth_binary")), 256)
    parts = [F.sum(F.conv(F.substring("_d", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    g = entries.select(digest.alias("_d"), "ground_truth_binary").agg(F.count("*").alias("record_count"), *[p.alias(f"_p{k}") for k, p in enumerate(parts)], F.count_if(F.col("ground_truth_binary") == 1).alias("positives"), F.count_if(F.col("ground_truth_binary") == 0).alias("negatives"))
    return g.select("record_count", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f"_p{k}"), F.lit(0)).cast("string") for k in range(4)]), 256).alias("records_sha256"), "positives", "negatives")


def fingerprint(metadata: dict) -> str:
    """SHA-256 of a run's metadata as compact sorted JSON, without its time, its own fingerprint and its entries."""
    kept = {k: v for k, v in metadata.items() if k not in UNHASHED}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def derived(metadata: dict, kind: str, **changes) -> dict:
    """Metadata of a shard, a merge or a repair: the parent's fingerprint, the changes, a fingerprint of its own."""
    out = {**metadata, **changes, "derived": kind, "parent_fingerprint": metadata["run_fingerprint"]}
    return {**out, "run_fingerprint": fingerprint(out)}


def require_same_run(held: dict, wanted: dict) -> None:
    if held["run_fingerprint"] != wanted["run_fingerprint"]:
        differ = sorted(k for k in {*held, *wanted} - set(UNHASHED) if held.get(k) != wanted.get(k))
        raise ValueError(f"another run is held there; these differ: {', '.join(differ)}")


def model_spec(text: str) -> tuple[str, str]:
    """(repository, pinned revision) of ``repository@revision``."""
    m = re.fullmatch(r"([^@\s]+)@([0-9a-f]{7,64})", text)
    if not m:
        raise ValueError(f"not a pinned model: {text!r}")
    return m[1], m[2]


def find_parent(runs: DataFrame, model: str, revision: str, dataset: str, expected: int) -> DataFrame:
    """The run of least (rank, path) that matches; runs of one root rank before those of the next."""
    good = (F.col("model") == model) & (F.col("model_revision") == revision) & (F.col("dataset") == dataset) & (F.col("record_count") == expected)
    return runs.where(good).agg(F.min_by(F.struct(*runs.columns), F.struct("rank", "path")).alias("r"), F.count_distinct("records_sha256").alias("versions")).select("r.*", "versions")


def latest_repair(raw: DataFrame, key: str, text: str) -> DataFrame:
    """key and the repair object of a raw JSON row: ``repair_details``, else the last key ``repair_...`` with an object.

    The order of keys is in the text alone, so the rows are parsed in Arrow batches.
    """
    kind = dict(raw.dtypes)[key]

    def run(frames):
        for pdf in frames:
            out = []
            for t in pdf[text]:
                row = json.loads(t)
                found = row.get("repair_details")
                if not isinstance(found, dict):
                    found = next((v for k, v in reversed(row.items()) if k.startswith("repair_") and isinstance(v, dict)), None)
                out.append(None if found is None else json.dumps(found, sort_keys=True))
            yield pdf[[key]].assign(repair=out)

    return raw.select(key, text).mapInPandas(run, f"{key} {kind}, repair string")


def flattened_text(raw: DataFrame, key: str, text: str) -> DataFrame:
    """key and all string values of a raw JSON row, at any depth, joined by spaces."""
    kind = dict(raw.dtypes)[key]

    def strings(value):
        stack, out = [value], []
        while stack:
            v = stack.pop()
            if isinstance(v, str):
                out.append(v)
            elif isinstance(v, dict):
                stack += reversed(list(v.values()))
            elif isinstance(v, list):
                stack += reversed(v)
        return " ".join(out)

    def run(frames):
        for pdf in frames:
            yield pdf[[key]].assign(flat=[strings(json.loads(t)) for t in pdf[text]])

    return raw.select(key, text).mapInPandas(run, f"{key} {kind}, flat string")


def structural_rewrite(chunks: DataFrame, taxonomy: list[str], accepted: tuple[str, ...] = ACCEPTED) -> DataFrame:
    """Chunks (record_key, chunk_index, parse_status, responses oldest first, categories) with those repaired whose
    newest readable response only lists taxonomy names; ``action`` is already_valid, structural or inference."""
    repaired = structural_repair(F.col("responses"), taxonomy)
    valid = is_accepted(F.col("parse_status"), accepted)
    action = F.when(valid, "already_valid").when(repaired.isNotNull(), "structural").otherwise("inference")
    return chunks.select(
        "record_key",
        "chunk_index",
        F.when(action == "structural", "valid_after_structural_repair_v1").otherwise(F.col("parse_status")).alias("parse_status"),
        F.when(action == "structural", repaired).otherwise(F.col("categories")).alias("categories"),
        action.alias("action"),
    )


def recompute(chunks: DataFrame, accepted: tuple[str, ...] = ACCEPTED) -> DataFrame:
    """Records from chunks: status, findings of accepted chunks (first of each category, in chunk order), counts."""
    good = is_accepted(F.col("parse_status"), accepted)
    rows = chunks.groupBy("record_key").agg(F.array_sort(F.collect_list(F.struct("chunk_index", good.alias("good"), "categories", "action"))).alias("c"))
    categories = F.array_distinct(F.flatten(F.transform(F.filter("c", lambda x: x["good"]), lambda x: F.coalesce(x["categories"], F.array().cast("array<string>")))))

    def count(action: str) -> Column:
        return F.size(F.filter("c", lambda x: x["action"] == action))

    return rows.select("record_key", record_status(F.transform("c", lambda x: x["good"])).alias("status"), findings_for_categories(categories).alias("vulnerabilities"), F.size("c").alias("chunk_count"), F.size(F.filter("c", lambda x: x["good"])).alias("valid_chunk_count"), *[count(a).alias(f"{a}_chunks") for a in ("already_valid", "structural", "inference")])


def audit_parent(chunks: DataFrame) -> DataFrame:
    """Chunks and records by action; a record counts under its heaviest: inference, structural, already valid."""
    per_record = chunks.groupBy("record_key").agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("inference", "structural", "already_valid")])
    kind = F.when(F.col("inference") > 0, "inference").when(F.col("structural") > 0, "structural").otherwise("already_valid")
    return per_record.withColumn("kind", kind).groupBy("kind").agg(F.count("*").alias("records"), *[F.sum(a).cast("long").alias(f"{a}_chunks") for a in ("inference", "structural", "already_valid")])


def completion(records: DataFrame) -> DataFrame:
    return records.groupBy("status").agg(F.count("*").alias("records"), F.sum("structural_chunks").cast("long").alias("structural_chunks"), F.sum("inference_chunks").cast("long").alias("inference_chunks"))


def merge_shards(shards: list[DataFrame], entries: DataFrame, n: int) -> DataFrame:
    """The union of shards in manifest terms, or an error: each row in its shard, none twice, none missing."""
    from .validate import duplicate_keys, key_set_difference, require_empty

    tagged = [s.withColumn("_shard", F.lit(k)) for k, s in enumerate(shards)]
    merged = tagged[0]
    for s in tagged[1:]:
        merged = merged.unionByName(s)
    require_empty(merged.where(F.pmod(F.col("record_index"), F.lit(n)) != F.col("_shard")).select("record_index", "_shard"), "rows in a wrong shard")
    require_empty(duplicate_keys(merged, ["record_index"]), "rows twice")
    require_empty(key_set_difference(merged, entries, ["record_index"]), "rows and manifest differ")
    return merged.drop("_shard")


def first_of_each(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row by window, where all columns with their nulls are wanted."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def run_paths(root: str, model: str, revision: str, dataset: str) -> tuple[str, str]:
    """Data and metadata path of a run: a folder for each dataset, the pinned model in the name."""
    stem = f"{root.rstrip('/')}/{dataset}/results_{re.sub('[^A-Za-z0-9._-]+', '_', model)}_{revision[:12]}_{dataset}"
    return f"{stem}.jsonl", f"{stem}.metadata.json"


def shard_paths(root: str, name: str, shard: int, shards: int) -> tuple[str, str]:
    """Data and manifest path of a shard."""
    if not 0 <= shard < shards:
        raise ValueError(f"no shard {shard} of {shards}")
    stem = f"{root.rstrip('/')}/shards/{name}_shard_{shard:02d}_of_{shards:02d}"
    return f"{stem}.jsonl", f"{stem}.manifest.json"


def portable_path(path: str, root: str) -> str:
    """The path below the root with forward slashes, or its last part if it lies elsewhere."""
    path, root = (p.replace("\\", "/").rstrip("/") for p in (path, root))
    return path[len(root) + 1 :] if path.startswith(root + "/") else path.rsplit("/", 1)[-1]


def near_misses(runs: DataFrame, model: str, revision: str, dataset: str, expected: int) -> DataFrame:
    """Runs of the model, revision and dataset that have another number of records, for the message of a failed search."""
    same = (F.col("model") == model) & (F.col("model_revision") == revision) & (F.col("dataset") == dataset)
    return runs.where(same & (F.col("record_count") != expected)).select("path", "record_count", "records_sha256").orderBy("path")


def require_parent(runs: DataFrame, model: str, revision: str, dataset: str, expected: int):
    """The parent run as a row. None at all, or several with different manifests, is an error that describes them."""
    found = find_parent(runs, model, revision, dataset, expected).first()
    if found is None or found["path"] is None:
        close = [r.asDict() for r in near_misses(runs, model, revision, dataset, expected).limit(20).collect()]
        raise ValueError(f"no run of {model}@{revision} on {dataset} with {expected} records; of another size: {close}")
    if found["versions"] > 1:
        raise ValueError(f"runs of {model}@{revision} on {dataset} have {found['versions']} different manifests")
    return found


def matching_records(entries: DataFrame, digest: str, count: int) -> DataFrame:
    """The input that a run was made from: all entries of the corpus, else its first ``count``, whichever has the run's
    digest; an error if neither has."""
    for records in (entries, entries.where(F.col("record_index") < count)):
        if manifest_digest(records).first().records_sha256 == digest:
            return records
    raise ValueError("the corpus does not match the run's manifest")


def completion_stamp(metadata: dict, rows: DataFrame, expected: int, at: str) -> dict:
    """The metadata with what has been completed: time, records written and expected, and statuses."""
    statuses = {str(r["status"]): r["n"] for r in rows.groupBy("status").agg(F.count("*").alias("n")).orderBy("status").collect()}
    return {**metadata, "completion": {"completed_at_utc": at, "completed_records": sum(statuses.values()), "expected_records": expected, "status_counts": statuses}}


def compact_runs(details: DataFrame, predicted: DataFrame) -> DataFrame:
    """What analyses need of each record: key, truth, final and first-attempt predictions, exposure and actions."""
    kept = details.select("record_key", "record_index", F.col("first_attempt_categories").alias("first_attempt_predicted"), "any_recovery_exposure", "first_attempt_native_valid", "format_retry_chunks", "actions", "final_record_status")
    return predicted.select("record_key", "truth", "predicted").join(kept, "record_key")
