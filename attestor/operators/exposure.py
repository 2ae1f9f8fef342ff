"""Recovery exposure of prediction rows: what the first attempt of each chunk gave and what was repaired later.

Rows have the nested shape of ``readers.PREDICTION``. All work on a row's chunks and attempts is in higher-order
functions, so a record needs no shuffle; only the summaries aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import classify_attempt, result_categories
from ..functions.scalar import canonical_category, normalize_category, safe_divide
from .audit import OUTCOMES

REINFERENCE = "progressive_closed_choice_reinference"
#: First outcomes beside those of ``classify_attempt``.
MISSING, MISMATCH = "missing_first_attempt", "stored_status_content_mismatch"
OTHER = ("other_validation_failure", "other_failure", MISSING, MISMATCH)


def _items(array: str, test) -> Column:
    """How many items of an array column pass; 0 for a null array."""
    return F.greatest(F.lit(0), F.coalesce(F.size(F.filter(array, lambda x: F.coalesce(test(x), F.lit(False)))), F.lit(0)))


def identity(curated: bool) -> Column:
    """The key of a row or manifest entry: the source's digest in the curated corpus, else its id; an error if empty."""
    key = F.nullif(F.col("source_sha256" if curated else "source_id"), F.lit(""))
    return F.coalesce(key, F.raise_error(F.lit("a row lacks its identity field")).cast("string"))


def action_count(actions: Column, name: str) -> Column:
    """The count of a repair action, 0 where there is none; text that is no number is an error."""
    value = F.try_element_at(actions, F.lit(name)).cast("string")
    wrong = F.raise_error(F.concat(F.lit(f"invalid repair action count {name}="), value)).cast("int")
    return F.when(value.isNull(), 0).otherwise(F.coalesce(value.try_cast("int"), wrong))


def repair_actions() -> Column:
    """struct(touched, inference, structural, already_valid) of a row. Without a count of inferences, the chunks that say
    they were inferred again are counted."""
    actions = F.col("repair_details.actions")
    given, structural = action_count(actions, "inference"), action_count(actions, "structural")
    inference = F.when(given == 0, _items("chunks", lambda c: c["repair_details"]["method"] == REINFERENCE)).otherwise(given)
    return F.struct(((inference > 0) | (structural > 0)).alias("touched"), inference.alias("inference"), structural.alias("structural"), action_count(actions, "already_valid").alias("already_valid"))


def final_categories(allowed: list[str]) -> Column:
    """Distinct categories of a row's findings; one outside the taxonomy is an error."""
    names = F.transform("vulnerabilities", lambda f: F.coalesce(normalize_category(f["category"]), F.lit("")))
    strange = F.try_element_at(F.filter(names, lambda n: ~n.isin(*allowed)), F.lit(1))
    error = F.raise_error(F.concat(F.lit("final category outside the taxonomy: "), strange)).cast("array<string>")
    return F.coalesce(F.when(strange.isNotNull(), error).otherwise(F.array_sort(F.array_distinct(names))), F.array().cast("array<string>"))


def accepted_predictions(ruleset: str = "A") -> Column:
    """struct(predicted: canonical categories, unknown: findings without one, total) of a row's findings."""
    names = F.coalesce(F.transform("vulnerabilities", lambda f: canonical_category(F.coalesce(f["category"], F.lit("")), ruleset)), F.array().cast("array<string>"))
    known = F.filter(names, lambda n: n.isNotNull())
    return F.struct(F.array_sort(F.array_distinct(known)).alias("predicted"), (F.size(names) - F.size(known)).alias("unknown"), F.size(names).alias("total"))


def _chunk(c: Column, allowed: list[str]) -> Column:
    attempts = F.greatest(F.lit(0), F.coalesce(F.size(c["attempts"]), F.lit(0)))
    first = F.try_element_at(c["attempts"], F.lit(1))
    # What tells an attempt's outcome apart may be in any of its strings.
    text = F.concat_ws(" ", first["chat_protocol"], first["raw_response"], first["parse_status"], F.concat_ws(" ", first["validation_errors"]), first["error"], first["traceback"])
    outcome = F.when(attempts == 0, MISSING).otherwise(classify_attempt(first["parse_status"], text))
    categories = F.when(outcome == "valid", result_categories(F.coalesce(first["raw_response"], F.lit("")), allowed))
    later = F.slice(c["attempts"], F.lit(2), F.greatest(attempts - 1, F.lit(0)))
    status = F.lower(F.coalesce(c["parse_status"], F.lit("")))
    return F.struct(
        outcome.alias("outcome"),
        categories.alias("categories"),
        (attempts > 1).alias("retried"),
        F.coalesce((attempts > 1) & F.exists(later, lambda a: F.lower(a["parse_status"]) == "valid"), F.lit(False)).alias("recovered"),
        F.contains(status, F.lit("structural_repair")).alias("structural"),
        (F.contains(status, F.lit("targeted_repair")) | F.contains(status, F.lit("closed_choice_repair"))).alias("targeted"),
    )


def inspect_records(rows: DataFrame, allowed: list[str], keep: list[str]) -> DataFrame:
    """One row a record with the columns ``keep``: chunks and the first outcome of each, first-attempt validity, retries,
    repairs, exposure, first and final categories and whether their number, their set or their emptiness differ."""
    empty = F.array().cast("array<string>")
    none = F.raise_error(F.lit("a record has no chunks")).cast("int")
    actions = F.col("repair_details.actions")
    given = rows.select(
        *keep,
        F.coalesce("status", F.lit("missing_status")).alias("final_record_status"),
        F.when(F.coalesce(F.size("chunks"), F.lit(0)) <= 0, none).otherwise(F.size("chunks")).alias("chunks"),
        F.transform("chunks", lambda c: _chunk(c, allowed)).alias("_c"),
        action_count(actions, "structural").alias("_structural"),
        action_count(actions, "inference").alias("_inference"),
        repair_actions().alias("actions"),
        final_categories(allowed).alias("final_categories"),
    )
    first = F.array_sort(F.array_distinct(F.flatten(F.transform("_c", lambda c: F.coalesce(c["categories"], empty)))))
    counted = given.select(
        *keep,
        "chunks",
        F.concat(F.transform("_c", lambda c: c["outcome"]), F.transform(F.filter("_c", lambda c: (c["outcome"] == "valid") & c["categories"].isNull()), lambda c: F.lit(MISMATCH))).alias("outcomes"),
        _items("_c", lambda c: c["outcome"] == "valid").alias("first_attempt_valid_chunks"),
        _items("_c", lambda c: c["retried"]).alias("format_retry_chunks"),
        _items("_c", lambda c: c["recovered"]).alias("format_recovered_chunks"),
        F.greatest(_items("_c", lambda c: c["structural"]), F.col("_structural")).alias("structural_repair_chunks"),
        F.greatest(_items("_c", lambda c: c["targeted"]), F.col("_inference")).alias("targeted_reinference_chunks"),
        first.alias("first_attempt_categories"),
        "final_categories",
        "actions",
        "final_record_status",
    )
    native = F.col("first_attempt_valid_chunks") == F.col("chunks")
    exposed = ~native | (F.col("format_retry_chunks") > 0) | (F.col("structural_repair_chunks") > 0) | (F.col("targeted_reinference_chunks") > 0)
    a, b = F.col("first_attempt_categories"), F.col("final_categories")
    return counted.select(
        "*",
        native.alias("first_attempt_native_valid"),
        exposed.alias("any_recovery_exposure"),
        (F.size(a) != F.size(b)).alias("category_count_changed"),
        (a != b).alias("category_set_changed"),
        ((F.size(a) > 0) != (F.size(b) > 0)).alias("binary_decision_changed"),
    )


def _sum(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def inspect_summary(details: DataFrame, by: list[str]) -> DataFrame:
    """Records and chunks by run: the histogram of first outcomes, rates, recoveries, and changes among exposed records."""
    n, exposed = F.count("*"), F.col("any_recovery_exposure")

    def outcomes(*names: str) -> Column:
        return F.coalesce(F.sum(_items("outcomes", lambda o: o.isin(*names))), F.lit(0)).cast("long")

    g = details.groupBy(*by).agg(
        n.alias("records"),
        _sum("chunks").alias("chunks"),
        _sum("first_attempt_valid_chunks").alias("first_attempt_valid_chunks"),
        outcomes("json_syntax_or_missing_result").alias("first_attempt_json_failures"),
        outcomes("schema_violation").alias("first_attempt_schema_violations"),
        outcomes("taxonomy_violation").alias("first_attempt_taxonomy_violations"),
        outcomes("runtime_failure").alias("first_attempt_runtime_failures"),
        outcomes(*OTHER).alias("first_attempt_other_failures"),
        F.count_if("first_attempt_native_valid").alias("first_attempt_native_valid_records"),
        *[_sum(c).alias(c) for c in ("format_retry_chunks", "format_recovered_chunks", "structural_repair_chunks", "targeted_reinference_chunks")],
        F.count_if(exposed).alias("recovery_exposed_records"),
        *[F.count_if(exposed & F.col(c)).alias(f"{name}_records") for c, name in (("category_count_changed", "changed_category_count"), ("category_set_changed", "changed_category_set"), ("binary_decision_changed", "changed_binary_decision"))],
        F.count_if(F.col("final_record_status") != "ok").alias("final_non_ok_records"),
    )
    rates = (
        ("first_attempt_valid_chunk_rate", "first_attempt_valid_chunks", "chunks"),
        ("first_attempt_native_valid_record_rate", "first_attempt_native_valid_records", "records"),
        ("recovery_exposed_record_rate", "recovery_exposed_records", "records"),
        ("changed_category_set_rate_among_exposed", "changed_category_set_records", "recovery_exposed_records"),
        ("changed_binary_rate_among_exposed", "changed_binary_decision_records", "recovery_exposed_records"),
    )
    return g.select("*", *[safe_divide(F.col(a), F.col(b)).alias(name) for name, a, b in rates])


def repair_audit(details: DataFrame, by: list[str]) -> DataFrame:
    """Records touched by selective repair and by any recovery, and repair actions, by run."""
    n = F.count("*")
    g = details.groupBy(*by).agg(
        n.alias("records_total"),
        F.count_if("actions.touched").alias("records_touched"),
        F.count_if("any_recovery_exposure").alias("records_any_recovery"),
        F.count_if("first_attempt_native_valid").alias("records_first_attempt_native_valid"),
        _sum("format_retry_chunks").alias("chunk_format_retry_actions"),
        F.count_if(F.col("actions.inference") > 0).alias("records_with_inference"),
        F.count_if(F.col("actions.structural") > 0).alias("records_with_structural_repair"),
        _sum("actions.inference").alias("chunk_inference_actions"),
        _sum("actions.structural").alias("chunk_structural_actions"),
        _sum("actions.already_valid").alias("chunk_already_valid_actions"),
        F.count_if(F.col("final_record_status") == "ok").alias("final_ok_records"),
    )
    return g.select("*", *[safe_divide(F.col(c), F.col("records_total")).alias(f"{c}_rate") for c in ("records_touched", "records_any_recovery", "records_first_attempt_native_valid")])


def in_order(rows: DataFrame, orders: dict[str, list[str]]) -> DataFrame:
    """Rows sorted by the declared order of the values of some columns; undeclared values come last, by name."""
    keys = []
    for column, values in orders.items():
        declared = F.array(*[F.lit(v) for v in values])
        place = F.array_position(declared, F.col(column))
        keys += [F.when(place > 0, place).otherwise(len(values) + 1), F.col(column)]
    return rows.orderBy(*keys)


OUTCOME_NAMES = (*OUTCOMES, MISSING, MISMATCH)
