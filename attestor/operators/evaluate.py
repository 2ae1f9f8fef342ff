"""From prediction rows, their manifest and the ground truth to decisions, coverage and summaries.

Every check is a table of violations (``run_problems``); strict loading raises them, progress reports count them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import agreement_pattern, format_duration, safe_divide
from .exposure import accepted_predictions, identity
from .validate import duplicate_keys, missing, require_empty

FIELDS = ("record_id", "source_id", "source_sha256", "ground_truth_binary")


def run_problems(rows: DataFrame, manifest: DataFrame, record_count: int | None, curated: bool) -> DataFrame:
    """(problem, item) of a run: a manifest of the wrong length or with an index twice or none, rows without an index,
    with one twice, with an unknown one or with other fields than their entry, and identities that occur twice."""

    def found(df: DataFrame, problem: str, item: Column) -> DataFrame:
        return df.select(F.lit(problem).alias("problem"), item.cast("string").alias("item"))

    index = F.col("record_index")
    length = manifest.agg(F.count("*").alias("n"))
    wrong = length.where(F.lit(True) if record_count is None else F.col("n") != record_count)
    out = found(wrong, "record_count", F.col("n"))
    out = out.unionByName(found(manifest.where(index.isNull()), "manifest_without_index", F.col("record_id")))
    out = out.unionByName(found(rows.where(index.isNull()), "row_without_index", F.col("record_id")))
    out = out.unionByName(_index_problems(rows.where(index.isNotNull()), manifest.where(index.isNotNull())))
    key = F.col("source_sha256" if curated else "source_id")
    out = out.unionByName(found(rows.where(F.coalesce(key, F.lit("")) == ""), "row_without_identity", index))
    return out.unionByName(found(duplicate_keys(rows.where(F.coalesce(key, F.lit("")) != "").select(key.alias("k")), ["k"]), "duplicate_identity", F.col("k")))


def _index_problems(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Indices that occur twice, rows of unknown ones, and each row and entry of an index whose fields differ.

    Rows and entries meet by index with a digest of their fields (128 bits of SHA-256) in one shuffle; the fields
    themselves are neither shuffled nor sorted, and an index counts all of its pairs without forming them.
    """

    def sided(df: DataFrame, rows: int) -> DataFrame:
        fields = []
        for f in FIELDS:
            text = F.col(f).cast("string")
            fields.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
        digest = F.unhex(F.substring(F.sha2(F.concat(*fields), 256), 1, 32))
        return df.select("record_index", digest.alias("digest"), F.lit(rows).alias("r"), F.lit(1 - rows).alias("e"))

    both = sided(rows, 1).unionByName(sided(manifest, 0)).repartition("record_index")
    alike = both.groupBy("record_index", "digest").agg(F.sum("r").alias("r"), F.sum("e").alias("e"))
    seen = alike.groupBy("record_index").agg(F.sum("r").alias("r"), F.sum("e").alias("e"), F.sum(F.col("r") * F.col("e")).alias("same"))
    r, e = F.col("r"), F.col("e")
    counted = (("manifest_duplicate_index", (e > 1).cast("long")), ("duplicate_index", (r > 1).cast("long")), ("unknown_index", ((r > 0) & (e == 0)).cast("long")), ("manifest_mismatch", r * e - F.col("same")))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("problem"), n.alias("n")) for name, n in counted])).alias("p")
    found = seen.select("record_index", each).select("p.problem", F.col("record_index").cast("string").alias("item"), "p.n").where("n > 0")
    most = 1 << 16  # items made at once
    parts = found.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most))).alias("part"))
    return parts.select("problem", F.explode(F.array_repeat("item", F.least(F.lit(most), F.col("n") - F.col("part") * most).cast("int"))).alias("item"))


def load_run(rows: DataFrame, manifest: DataFrame, record_count: int | None, curated: bool) -> DataFrame:
    """The rows with their record_key, or an error with the first problems."""
    require_empty(run_problems(rows, manifest, record_count, curated), "the run does not fit its manifest")
    return rows.withColumn("record_key", identity(curated))


def completed_rows(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows that a resumed run may keep, keyed by index, or an error: an index null, twice or unknown, or other fields."""
    problems = run_problems(rows, manifest, None, False).where("problem in ('row_without_index', 'duplicate_index', 'unknown_index', 'manifest_mismatch')")
    require_empty(problems, "rows cannot be resumed")
    return rows


def require_corpus(corpus: DataFrame, text: str, key: str, label: str | None = None) -> DataFrame:
    """The corpus, or an error that shows rows without text or key, or with a label that is neither 0 nor 1."""
    bad = (F.coalesce(F.trim(F.col(text)), F.lit("")) == "") | (F.coalesce(F.col(key).cast("string"), F.lit("")) == "")
    if label:
        bad = bad | ~F.coalesce(F.col(label).isin(0, 1), F.lit(False))
    require_empty(corpus.where(bad).select(key, *([label] if label else [])), "corpus rows without text, key or label")
    return corpus


def head(records: DataFrame, order: str, limit: int | None) -> DataFrame:
    """The first records by their index; all of them without a limit. Indices run from 0, so no sort is needed."""
    return records if limit is None else records.where(F.col(order) < limit)


def manifest_truth(manifest: DataFrame, truth: DataFrame, curated: bool) -> DataFrame:
    """Manifest entries with the truth of their key; an entry without one is an error."""
    entries = manifest.withColumn("record_key", identity(curated))
    require_empty(missing(entries, truth, ["record_key"]), "manifest records without ground truth")
    return entries.join(truth.select("record_key", "truth"), "record_key")


def predictions(entries: DataFrame, rows: DataFrame, ruleset: str = "A") -> DataFrame:
    """Every manifest entry (record_key, truth) with its canonical predictions; a missing row predicts nothing."""
    found = rows.select("record_key", accepted_predictions(ruleset).alias("a"), "status", F.lit(True).alias("written"))
    joined = entries.select("record_key", "truth").join(found, "record_key", "left")
    none = F.array().cast("array<string>")
    return joined.select("record_key", "truth", F.coalesce("a.predicted", none).alias("predicted"), F.coalesce("a.unknown", F.lit(0)).alias("unknown"), F.coalesce("a.total", F.lit(0)).alias("total"), "status", F.coalesce("written", F.lit(False)).alias("written"))


def decisions(predicted: DataFrame, labels: list[str], keep: list[str] = ()) -> DataFrame:
    """record_key, label, truth and prediction as 0 or 1 for each label."""
    each = F.explode(F.array(*[F.lit(x) for x in labels])).alias("label")
    return predicted.select(*keep, "record_key", "truth", "predicted", each).select(*keep, "record_key", "label", F.array_contains("truth", F.col("label")).cast("int").alias("truth"), F.array_contains("predicted", F.col("label")).cast("int").alias("predicted"))


def evaluation(predicted: DataFrame, by: list[str]) -> DataFrame:
    """Coverage, status counts and findings outside the taxonomy of runs."""
    written = F.col("written")
    known = ("ok", "partial", "failed")
    g = predicted.groupBy(*by).agg(
        F.count("*").alias("records_expected"),
        F.count_if(written).alias("records_written"),
        F.count_if(~written).alias("records_missing"),
        F.count_if(F.col("total") > 0).alias("records_with_findings"),
        F.sum("total").cast("long").alias("total_findings"),
        F.sum("unknown").cast("long").alias("out_of_taxonomy_findings"),
        *[F.count_if(F.col("status") == s).alias(f"status_{s}") for s in known],
        F.count_if(written & (~F.col("status").isin(*known) | F.col("status").isNull())).alias("status_other"),
    )
    return g.select("*", safe_divide(F.col("out_of_taxonomy_findings"), F.col("total_findings")).alias("out_of_taxonomy_rate"), (F.col("total_findings") == 0).alias("all_predictions_empty"))


def binary_decisions(predicted: DataFrame, keep: list[str] = ()) -> DataFrame:
    """record_key, truth and whether any canonical finding was predicted; findings outside the taxonomy count as none."""
    return predicted.select(*keep, "record_key", F.lit("vulnerable").alias("label"), F.col("truth").cast("int").alias("truth"), (F.size("predicted") > 0).cast("int").alias("predicted"))


def aligned_votes(runs: DataFrame, models: list[str]) -> DataFrame:
    """record_key, label, truth, one vote column a model and the pattern, from the long decisions of several runs.

    Runs that lack a record, or differ in a record's truth, are an error; so is a model that is unknown or missing.
    """
    from .validate import model_alignment

    require_empty(model_alignment(runs.withColumn("_cell", F.concat_ws("|", "record_key", "label")), models, "_cell", "truth"), "runs do not align")
    votes = [F.max(F.when(F.col("model") == m, F.col("predicted"))).cast("int").alias(f"v{k + 1}") for k, m in enumerate(models)]
    wide = runs.groupBy("record_key", "label").agg(F.max("truth").cast("int").alias("truth"), *votes)
    return wide.withColumn("pattern", agreement_pattern(*[F.col(f"v{k + 1}") for k in range(len(models))]))


def inspect_progress(lines: DataFrame, manifest: DataFrame, record_count: int | None, fingerprint: str | None) -> DataFrame:
    """One row on a run that may be unfinished: completed, percent, runtime, time left, last index, problems, and whether
    it can be resumed and is complete. ``lines`` are of ``readers.json_lines`` with strict=False; the first of the rows
    of one index counts."""
    from ..sources.readers import tolerant_runs

    rows, _ = tolerant_runs(lines)
    rows = rows.where("record_index is not null")
    counted = lines.agg(
        F.count_if(F.col("_corrupt").isNotNull() | F.col("record_index").isNull()).alias("corrupt"),
        (F.count_if(F.col("_corrupt").isNull() & F.col("record_index").isNotNull()) - F.count_distinct(F.when(F.col("_corrupt").isNull(), F.col("record_index")))).alias("duplicate"),
    )
    entries = manifest.select("record_index", *[F.col(f).alias(f"_{f}") for f in FIELDS], F.lit(True).alias("_known"))
    same = F.lit(True)
    for f in FIELDS:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    runtime = F.when((F.col("runtime_seconds") >= 0) & (F.abs("runtime_seconds") < float("inf")) & ~F.isnan("runtime_seconds"), F.col("runtime_seconds"))
    done = rows.join(entries, "record_index", "left").agg(
        F.count("*").alias("completed"),
        F.avg(runtime).alias("average_runtime_seconds"),
        F.max("record_index").alias("last_record_index"),
        F.count_if(F.col("_known").isNull()).alias("unknown"),
        F.count_if(F.col("_known").isNotNull() & ~same).alias("mismatches"),
        *[F.count_if(F.col("status") == s).alias(f"status_{s}") for s in ("ok", "partial", "failed")],
    )
    listed = manifest.agg(F.count("*").alias("listed"), (F.count("record_index") - F.count_distinct("record_index")).alias("twice"), F.count_if(F.col("record_index").isNull()).alias("no_index"))
    one = done.crossJoin(counted).crossJoin(listed)  # a row each
    expected = F.col("listed") if record_count is None else F.lit(record_count)
    checks = (
        (F.lit(record_count is None), F.lit("record_count is missing or invalid")),
        (F.col("listed") != expected, F.concat(F.lit("metadata lists "), F.col("listed").cast("string"), F.lit(" records"))),
        (F.lit(not fingerprint), F.lit("run_fingerprint is missing")),
        (F.col("no_index") > 0, F.concat(F.col("no_index").cast("string"), F.lit(" metadata record(s) without an index"))),
        (F.col("twice") > 0, F.concat(F.col("twice").cast("string"), F.lit(" metadata record_index value(s) twice"))),
        (F.col("corrupt") > 0, F.concat(F.col("corrupt").cast("string"), F.lit(" corrupt line(s)"))),
        (F.col("duplicate") > 0, F.concat(F.col("duplicate").cast("string"), F.lit(" duplicate record_index value(s)"))),
        (F.col("unknown") > 0, F.concat(F.col("unknown").cast("string"), F.lit(" record_index value(s) absent from the metadata"))),
        (F.col("mismatches") > 0, F.concat(F.col("mismatches").cast("string"), F.lit(" row(s) mismatch the manifest"))),
    )
    problems = F.array_compact(F.array(*[F.when(test, text) for test, text in checks]))
    left = F.greatest(expected - F.col("completed"), F.lit(0))
    out = one.select("*", expected.cast("long").alias("expected"), problems.alias("problems"), (F.col("average_runtime_seconds") * left).alias("estimated_remaining_seconds"))
    percent = F.when(F.col("expected") == 0, 100.0).otherwise(100.0 * safe_divide(F.col("completed"), F.col("expected")))
    return out.select(
        "expected", "completed", percent.alias("percent"), "average_runtime_seconds", "estimated_remaining_seconds", format_duration(F.col("estimated_remaining_seconds")).alias("time_left"),
        "last_record_index", "status_ok", "status_partial", "status_failed", "problems", (F.size("problems") == 0).alias("resumable"), ((F.size("problems") == 0) & (F.col("completed") == F.col("expected"))).alias("complete"),
    )
