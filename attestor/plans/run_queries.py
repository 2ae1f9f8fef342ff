"""Queries over prediction runs: chunk-level exposure, repairs, validation, evaluation, alignment of models. The SQL works
on flat rows and states every rule and value itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse
from ..operators import evaluate, exposure, selective
from ..sources import adapters
from ..sources.adapters import MODELS, table
from .catalogue import query

ALLOWED = ["access_control", "arithmetic", "reentrancy"]
BY = ["dataset", "model"]

_FLAT = """att AS (SELECT conv_id, (rn - 1) // 2 AS chunk, (rn - 1) % 2 AS attempt, n FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, length(text) AS n FROM conversations WHERE role = 'assistant')),
firsts AS (SELECT conv_id, chunk, n, CASE WHEN n % 2 = 0 THEN 'valid' WHEN n % 7 = 0 THEN 'schema_violation' WHEN n % 11 = 0 THEN 'runtime_failure' WHEN n % 13 = 0 THEN 'taxonomy_violation' WHEN n % 3 = 0 THEN 'json_syntax_or_missing_result' WHEN n % 5 = 0 THEN 'other_validation_failure' ELSE 'other_failure' END AS outcome FROM att WHERE attempt = 0),
later AS (SELECT conv_id, chunk, bool_or(n % 2 = 0) AS recovered FROM att WHERE attempt = 1 GROUP BY ALL),
chunks AS (SELECT f.conv_id, f.chunk, outcome, outcome = 'valid' AND n % 4 = 0 AS reentrancy, outcome = 'valid' AND n % 4 = 2 AS mismatch, l.recovered IS NOT NULL AS retried, coalesce(l.recovered, false) AS recovered,
  (f.conv_id + f.chunk) % 5 = 2 AS structural, (f.conv_id + f.chunk) % 5 = 3 AS targeted, (f.conv_id + f.chunk) % 7 = 0 AS inferred FROM firsts f LEFT JOIN later l USING (conv_id, chunk)),
rec AS (SELECT conv_id, 'set_' || conv_id % 2 AS dataset, ['qwen', 'codellama', 'mistral'][(conv_id % 3 + 1)::INTEGER] AS model, count(*) AS chunks, count(*) FILTER (WHERE outcome = 'valid') AS valid_chunks, count(*) FILTER (WHERE retried) AS retry_chunks, count(*) FILTER (WHERE recovered) AS recovered_chunks,
  greatest(count(*) FILTER (WHERE structural), CASE WHEN conv_id % 5 <> 0 THEN conv_id % 2 ELSE 0 END) AS structural_chunks, greatest(count(*) FILTER (WHERE targeted), CASE WHEN conv_id % 5 <> 0 THEN conv_id % 4 ELSE 0 END) AS targeted_chunks,
  CASE WHEN bool_or(reentrancy) THEN 'reentrancy' ELSE '' END AS first_categories, ['', 'reentrancy', 'access_control;arithmetic'][(conv_id % 3 + 1)::INTEGER] AS final_categories,
  CASE WHEN conv_id % 5 <> 0 AND conv_id % 4 > 0 THEN conv_id % 4 ELSE count(*) FILTER (WHERE inferred) END AS inference, CASE WHEN conv_id % 5 <> 0 THEN conv_id % 2 ELSE 0 END AS structural, CASE WHEN conv_id % 5 <> 0 THEN 1 ELSE 0 END AS already_valid,
  count(*) FILTER (WHERE outcome = 'json_syntax_or_missing_result') AS json_failures, count(*) FILTER (WHERE outcome = 'schema_violation') AS schema_violations, count(*) FILTER (WHERE outcome = 'taxonomy_violation') AS taxonomy_violations, count(*) FILTER (WHERE outcome = 'runtime_failure') AS runtime_failures,
  count(*) FILTER (WHERE outcome IN ('other_validation_failure', 'other_failure')) + count(*) FILTER (WHERE mismatch) AS other_failures, CASE WHEN conv_id % 6 = 0 THEN 'partial' ELSE 'ok' END AS status FROM chunks GROUP BY conv_id),
det AS (SELECT *, valid_chunks = chunks AS native, valid_chunks < chunks OR retry_chunks > 0 OR structural_chunks > 0 OR targeted_chunks > 0 AS exposed, (first_categories = '') <> (final_categories = '') AS binary_changed, first_categories <> final_categories AS set_changed,
  CASE first_categories WHEN '' THEN 0 ELSE 1 END <> CASE final_categories WHEN '' THEN 0 WHEN 'reentrancy' THEN 1 ELSE 2 END AS count_changed FROM rec)"""


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END"


def _details(spark, sf_dir):
    return exposure.inspect_records(adapters.prediction_rows(spark, sf_dir), ALLOWED, [*BY, "record_index"])


@query(f"WITH {_FLAT} SELECT conv_id::INTEGER AS record_index, dataset, model, chunks::INTEGER AS chunks, valid_chunks::INTEGER AS first_attempt_valid_chunks, retry_chunks::INTEGER AS format_retry_chunks, recovered_chunks::INTEGER AS format_recovered_chunks, structural_chunks::INTEGER AS structural_repair_chunks, targeted_chunks::INTEGER AS targeted_reinference_chunks, first_categories AS first_attempt_categories, final_categories, native AS first_attempt_native_valid, exposed AS any_recovery_exposure, count_changed AS category_count_changed, set_changed AS category_set_changed, binary_changed AS binary_decision_changed FROM det")
def chunk_exposure(spark, sf_dir):
    joined = [F.array_join(c, ";").alias(c) for c in ("first_attempt_categories", "final_categories")]
    return _details(spark, sf_dir).select("record_index", *BY, "chunks", "first_attempt_valid_chunks", "format_retry_chunks", "format_recovered_chunks", "structural_repair_chunks", "targeted_reinference_chunks", *joined, "first_attempt_native_valid", "any_recovery_exposure", "category_count_changed", "category_set_changed", "binary_decision_changed")


@query(f"""WITH {_FLAT}, g AS (SELECT dataset, model, count(*) AS records, sum(chunks)::BIGINT AS chunks, sum(valid_chunks)::BIGINT AS first_attempt_valid_chunks, sum(json_failures)::BIGINT AS first_attempt_json_failures, sum(schema_violations)::BIGINT AS first_attempt_schema_violations, sum(taxonomy_violations)::BIGINT AS first_attempt_taxonomy_violations, sum(runtime_failures)::BIGINT AS first_attempt_runtime_failures, sum(other_failures)::BIGINT AS first_attempt_other_failures, count(*) FILTER (WHERE native) AS first_attempt_native_valid_records,
sum(retry_chunks)::BIGINT AS format_retry_chunks, sum(recovered_chunks)::BIGINT AS format_recovered_chunks, sum(structural_chunks)::BIGINT AS structural_repair_chunks, sum(targeted_chunks)::BIGINT AS targeted_reinference_chunks, count(*) FILTER (WHERE exposed) AS recovery_exposed_records, count(*) FILTER (WHERE exposed AND count_changed) AS changed_category_count_records, count(*) FILTER (WHERE exposed AND set_changed) AS changed_category_set_records, count(*) FILTER (WHERE exposed AND binary_changed) AS changed_binary_decision_records, count(*) FILTER (WHERE status <> 'ok') AS final_non_ok_records FROM det GROUP BY 1, 2)
SELECT *, {_ratio("first_attempt_valid_chunks", "chunks")} AS first_attempt_valid_chunk_rate, {_ratio("first_attempt_native_valid_records", "records")} AS first_attempt_native_valid_record_rate, {_ratio("recovery_exposed_records", "records")} AS recovery_exposed_record_rate, {_ratio("changed_category_set_records", "recovery_exposed_records")} AS changed_category_set_rate_among_exposed, {_ratio("changed_binary_decision_records", "recovery_exposed_records")} AS changed_binary_rate_among_exposed FROM g""")
def exposure_by_run(spark, sf_dir):
    return exposure.inspect_summary(_details(spark, sf_dir), BY)


@query(f"""WITH {_FLAT}, g AS (SELECT dataset, model, count(*) AS records_total, count(*) FILTER (WHERE inference > 0 OR structural > 0) AS records_touched, count(*) FILTER (WHERE exposed) AS records_any_recovery, count(*) FILTER (WHERE native) AS records_first_attempt_native_valid, sum(retry_chunks)::BIGINT AS chunk_format_retry_actions, count(*) FILTER (WHERE inference > 0) AS records_with_inference, count(*) FILTER (WHERE structural > 0) AS records_with_structural_repair, sum(inference)::BIGINT AS chunk_inference_actions, sum(structural)::BIGINT AS chunk_structural_actions, sum(already_valid)::BIGINT AS chunk_already_valid_actions, count(*) FILTER (WHERE status = 'ok') AS final_ok_records FROM det GROUP BY 1, 2)
SELECT *, {_ratio("records_touched", "records_total")} AS records_touched_rate, {_ratio("records_any_recovery", "records_total")} AS records_any_recovery_rate, {_ratio("records_first_attempt_native_valid", "records_total")} AS records_first_attempt_native_valid_rate FROM g""")
def repair_audit(spark, sf_dir):
    return exposure.repair_audit(_details(spark, sf_dir), BY)


@query("SELECT conv_id::INTEGER AS record_index, ['', 'reentrancy', 'access_control;arithmetic'][(conv_id % 3 + 1)::INTEGER] AS predicted, 0 AS unknown, [0, 1, 3][(conv_id % 3 + 1)::INTEGER]::INTEGER AS total FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant')")
def accepted_predictions(spark, sf_dir):
    return adapters.prediction_rows(spark, sf_dir).select("record_index", exposure.accepted_predictions().alias("a")).select("record_index", F.array_join("a.predicted", ";").alias("predicted"), "a.unknown", "a.total")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'reentrancy|f|high|d|' WHEN 1 THEN 'arithmetic||||' WHEN 2 THEN '' END AS findings, CASE event_id % 4 WHEN 0 THEN 'finding[1] is not an object;finding[2] category ''Other Thing'' is outside the allowed taxonomy' WHEN 1 THEN 'finding[0] category None is outside the allowed taxonomy' WHEN 2 THEN '' END AS errors FROM events""")
def validate_response(spark, sf_dir):
    texts = (
        '{"vulnerabilities": [{"category": "Reentrancy", "function": " f ", "severity": "HIGH", "description": "d"}, "text", {"category": "Other Thing"}]}',
        'so {"vulnerabilities": [{"function": "g"}, {"category": "arithmetic"}]} end',
        '{"vulnerabilities": []}',
        '{"vulnerabilities": {"category": "arithmetic"}}',
    )
    text = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("event_id") % 4 + 1).cast("int"))
    r = table(spark, sf_dir, "events").select("event_id", parse.validated_findings(text, ALLOWED).alias("r"))
    listed = F.array_join(F.transform("r.findings", lambda f: F.concat_ws("|", f["category"], f["function"], f["severity"], f["description"], f["recommendation"])), ";")
    return r.select("event_id", listed.alias("findings"), F.array_join("r.errors", ";").alias("errors"))


def _broken(spark, sf_dir):
    """Orders as a manifest and as rows: some twice, some unknown, some with another source, some without an index."""
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("int").alias("record_index"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("record_id"), F.col("o_orderkey").cast("string").alias("source_id"), F.lit("s").alias("source_sha256"), F.lit(None).cast("int").alias("ground_truth_binary"))
    k = F.col("record_index")
    rows = entries.withColumn("source_id", F.when(k % 11 == 0, "x").otherwise(F.col("source_id"))).withColumn("record_index", F.when(k % 13 == 0, F.lit(None)).when(k % 17 == 0, -k).otherwise(k))
    return rows.unionByName(entries.where(k % 19 == 0)), entries


@query("""WITH m AS (SELECT o_orderkey AS k FROM orders), r AS (SELECT k, CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN -k ELSE k END AS i, CASE WHEN k % 11 = 0 THEN 'x' ELSE k::VARCHAR END AS s FROM m UNION ALL SELECT k, k, k::VARCHAR FROM m WHERE k % 19 = 0)
SELECT 'record_count' AS problem, 1::BIGINT AS items UNION ALL SELECT 'row_without_index', count(*) FROM r WHERE i IS NULL UNION ALL SELECT 'duplicate_index', count(*) FROM (SELECT i FROM r WHERE i IS NOT NULL GROUP BY i HAVING count(*) > 1)
UNION ALL SELECT 'unknown_index', count(DISTINCT i) FROM r WHERE i IS NOT NULL AND i NOT IN (SELECT k FROM m) UNION ALL SELECT 'manifest_mismatch', count(*) FROM r WHERE i IN (SELECT k FROM m) AND s <> i::VARCHAR UNION ALL SELECT 'duplicate_identity', count(*) FROM (SELECT s FROM r GROUP BY s HAVING count(*) > 1)""")
def run_problems(spark, sf_dir):
    rows, entries = _broken(spark, sf_dir)
    return evaluate.run_problems(rows, entries, -1, False).groupBy("problem").agg(F.count("*").alias("items"))


def _evaluated(spark, sf_dir):
    """Conversations in both runs of their dataset's models; every seventh row was not written."""
    rows = adapters.prediction_rows(spark, sf_dir).withColumn("record_key", F.col("source_id"))
    truth = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("reentrancy"))).otherwise(F.array(F.lit("arithmetic"), F.lit("reentrancy")))
    entries = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id").distinct().select(F.col("conv_id").cast("string").alias("source_id"), F.lit("").alias("source_sha256"), F.col("conv_id").cast("string").alias("record_id"))
    truths = table(spark, sf_dir, "conversations").select("conv_id").distinct().select(F.col("conv_id").cast("string").alias("record_key"), truth.alias("truth"))
    return evaluate.predictions(evaluate.manifest_truth(entries, truths, False), rows.where("record_index % 7 <> 3"))


_RECORDS = "rec AS (SELECT conv_id AS k, conv_id % 7 <> 3 AS written, conv_id % 3 AS kind, conv_id % 2 AS odd, CASE WHEN conv_id % 6 = 0 THEN 'partial' ELSE 'ok' END AS status FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant'))"


@query(f"""WITH {_RECORDS}, f AS (SELECT *, CASE WHEN written THEN [0, 1, 3][(kind + 1)::INTEGER] ELSE 0 END AS total FROM rec), g AS (SELECT count(*) AS records_expected, count(*) FILTER (WHERE written) AS records_written, count(*) FILTER (WHERE NOT written) AS records_missing, count(*) FILTER (WHERE total > 0) AS records_with_findings, sum(total)::BIGINT AS total_findings, 0::BIGINT AS out_of_taxonomy_findings,
count(*) FILTER (WHERE written AND status = 'ok') AS status_ok, count(*) FILTER (WHERE written AND status = 'partial') AS status_partial, 0::BIGINT AS status_failed, 0::BIGINT AS status_other FROM f) SELECT *, 0.0::DOUBLE AS out_of_taxonomy_rate, total_findings = 0 AS all_predictions_empty FROM g""")
def run_evaluation(spark, sf_dir):
    return evaluate.evaluation(_evaluated(spark, sf_dir), [])


@query(f"""WITH {_RECORDS}, d AS (SELECT label, CASE WHEN label = 'reentrancy' OR (label = 'arithmetic' AND odd = 1) THEN 1 ELSE 0 END AS truth, CASE WHEN written AND ((label = 'reentrancy' AND kind = 1) OR (label <> 'reentrancy' AND kind = 2)) THEN 1 ELSE 0 END AS predicted FROM rec, (SELECT unnest(['access_control', 'arithmetic', 'reentrancy']) AS label))
SELECT label, count(*) FILTER (WHERE truth = 1 AND predicted = 1) AS tp, count(*) FILTER (WHERE truth = 0 AND predicted = 1) AS fp, count(*) FILTER (WHERE truth = 1 AND predicted = 0) AS fn, count(*) FILTER (WHERE truth = 0 AND predicted = 0) AS tn FROM d GROUP BY 1""")
def run_decisions(spark, sf_dir):
    t, p = F.col("truth") == 1, F.col("predicted") == 1
    return evaluate.decisions(_evaluated(spark, sf_dir), ALLOWED).groupBy("label").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))


@query("""SELECT o_orderpriority AS label, pattern, count(*) AS n, sum(truth)::BIGINT AS positives FROM (SELECT o_orderpriority, (o_orderkey % 2)::INTEGER AS truth, concat((o_orderkey % 2)::INTEGER, (o_orderkey % 3 = 0)::INTEGER, (o_orderkey % 5 = 0)::INTEGER) AS pattern FROM orders) GROUP BY 1, 2""")
def aligned_votes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_key"), F.col("o_orderpriority").alias("label"), (F.col("o_orderkey") % 2).cast("int").alias("truth"))
    k = F.col("record_key")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), v.cast("int").alias("predicted")) for m, v in zip(MODELS, (k % 2 == 1, k % 3 == 0, k % 5 == 0), strict=True)])).alias("r")
    runs = orders.select("record_key", "label", "truth", each).select("record_key", "label", "truth", "r.*")
    return evaluate.aligned_votes(runs, list(MODELS)).groupBy("label", "pattern").agg(F.count("*").alias("n"), F.sum("truth").cast("long").alias("positives"))


@query("""WITH t AS (SELECT c_nationkey AS label, c_custkey % 10 AS score, (c_custkey % 3 = 0)::INTEGER AS truth FROM customer), c AS (SELECT label, score, count(*) AS n, sum(truth) AS p FROM t GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY label ORDER BY score) - n + (n + 1) / 2.0 AS midrank, sum(n) OVER (PARTITION BY label) AS all_n, sum(p) OVER (PARTITION BY label) AS all_p FROM c),
a AS (SELECT label, CASE WHEN any_value(all_p) > 0 AND any_value(all_p) < any_value(all_n) THEN (sum(p * midrank) - any_value(all_p) * (any_value(all_p) + 1) / 2.0)::DOUBLE / (any_value(all_p)::DOUBLE * (any_value(all_n) - any_value(all_p))) END AS auc FROM r GROUP BY 1)
SELECT round(avg(auc), 9) AS mean_auc, count(auc) AS finite_labels, count(*) AS labels FROM a""")
def mean_auc(spark, sf_dir):
    scored = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("label"), (F.col("c_custkey") % 10).cast("double").alias("score"), (F.col("c_custkey") % 3 == 0).cast("int").alias("truth"))
    cells = scored.groupBy("label", "score").agg(F.count("*").alias("n"), F.sum("truth").cast("long").alias("p"))
    return selective.discrimination(cells, ["label"]).withColumn("mean_auc", F.round("mean_auc", 9))
