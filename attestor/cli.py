"""Command line: evaluate runs against their truth, audit their recovery, report their progress.

A root holds a folder for each dataset, with ``name.jsonl`` and ``name.metadata.json`` for each run; paths may lie in
any file system that Spark reads. A truth file has one JSON object a line: record_key and truth (an array of labels,
or 0/1).
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluate, exposure, metrics
from .operators.runs import run_paths
from .operators.validate import EvaluationConfig
from .sources import readers, sinks

UNSAFE = 2
METADATA = f"record_count int, records_sha256 string, run_fingerprint string, config struct<model:string,model_revision:string,dataset:string,seed:int>, records array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in readers.MANIFEST.split(', '))}>>"


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="attestor", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("evaluate", "metrics, coverage and per-class rows of each run"), ("exposure", "first attempts, recoveries and repairs of each run"), ("progress", "how far each run is and whether it can be resumed")):
        c = commands.add_parser(name, help=text)
        c.add_argument("root")
        c.add_argument("--datasets", nargs="+", required=True)
        c.add_argument("--labels", nargs="+", default=list(readers.CURATED_TAXONOMY))
        c.add_argument("--curated", nargs="*", default=[], help="datasets whose records are keyed by the digest of their source")
        c.add_argument("--runs", type=int, default=3, help="run files that each dataset must have")
        if name == "evaluate":
            c.add_argument("--truth", required=True)
        if name == "progress":
            c.add_argument("--json", action="store_true")
        else:
            c.add_argument("--out", required=True)
    out = parser.parse_args(argv)
    EvaluationConfig()
    if out.runs < 1:
        parser.error("--runs must be 1 at least")
    return out


def _runs(spark: SparkSession, args: argparse.Namespace, strict: bool = True):
    """(dataset, name, data path, metadata row) of each run, by dataset and name; a bounded number of files."""
    data = readers.run_files(spark, args.root, args.datasets, args.runs) if strict else readers.discover(spark, args.root)
    pairs = readers.pair_sidecars(data, readers.discover(spark, args.root, "*.metadata.json")).orderBy("directory", "stem").collect()
    for p in pairs:
        dataset = p.directory.rstrip("/").split("/")[-1]
        if dataset not in args.datasets:
            continue
        if p.metadata_path is None or (strict and p.data_path is None):
            if strict:
                raise ValueError(f"{p.data_path or p.metadata_path} has no partner")
            yield dataset, p.stem, p.data_path, None
            continue
        yield dataset, p.stem, p.data_path, readers.json_document(spark, p.metadata_path, METADATA).first()


def _manifest(spark: SparkSession, metadata) -> DataFrame:
    return spark.createDataFrame(metadata.records or [], readers.MANIFEST)


def _model(metadata, name: str) -> str:
    return (metadata.config.model if metadata and metadata.config else None) or name


def evaluate_runs(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    truth = spark.read.schema("record_key string, truth array<string>").json(args.truth)
    coverage, decisions = [], []
    for dataset, name, path, metadata in _runs(spark, args):
        curated = dataset in args.curated
        entries = evaluate.manifest_truth(_manifest(spark, metadata), truth, curated)
        rows = evaluate.load_run(readers.json_lines(spark, path), _manifest(spark, metadata), metadata.record_count, curated)
        predicted = evaluate.predictions(entries, rows).select(F.lit(dataset).alias("dataset"), F.lit(_model(metadata, name)).alias("system"), "*")
        coverage.append(evaluate.evaluation(predicted, ["dataset", "system"]))
        decisions.append(evaluate.decisions(predicted, args.labels, ["dataset", "system"]))
    t, p = F.col("truth") == 1, F.col("predicted") == 1
    cells = sinks.union_rows(decisions).groupBy("dataset", "system", "label").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"), F.count_if(t).alias("support"), F.count("*").alias("n"))
    return {"summary": metrics.system_summary(cells, ["dataset", "system"]), "per_class": metrics.with_metrics(cells, "precision", "recall", "f1"), "coverage": sinks.union_rows(coverage)}


def audit_runs(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    details = []
    for dataset, name, path, metadata in _runs(spark, args):
        rows = evaluate.load_run(readers.json_lines(spark, path), _manifest(spark, metadata), metadata.record_count, dataset in args.curated)
        rows = rows.select(F.lit(dataset).alias("dataset"), F.lit(_model(metadata, name)).alias("model"), "*")
        details.append(exposure.inspect_records(rows, args.labels, ["dataset", "model", "record_key", "record_index"]))
    every = sinks.union_rows(details)
    return {"exposure": exposure.inspect_summary(every, ["dataset", "model"]), "repairs": exposure.repair_audit(every, ["dataset", "model"])}


def progress_of_runs(spark: SparkSession, args: argparse.Namespace) -> list[dict]:
    out = []
    for dataset, name, path, metadata in _runs(spark, args, strict=False):
        run = {"dataset": dataset, "run": name, "model": _model(metadata, name)}
        if metadata is None:
            out.append({**run, "expected": 0, "completed": 0, "problems": ["no metadata"], "resumable": False, "complete": False})
            continue
        lines = readers.json_lines(spark, path, strict=False) if path else spark.createDataFrame([], readers.PREDICTION + ", file string, line_no long, _corrupt string")
        out.append(run | evaluate.inspect_progress(lines, _manifest(spark, metadata), metadata.record_count, metadata.run_fingerprint).first().asDict(True))
    return out


def progress_text(runs: list[dict]) -> str:
    lines = [f"{sum(r['completed'] for r in runs)} of {sum(r['expected'] for r in runs)} records in {len(runs)} runs", f"safe to resume all: {'yes' if all(r['resumable'] for r in runs) else 'no'}"]
    for r in runs:
        state = "complete" if r["complete"] else "resumable" if r["resumable"] else "do not resume"
        lines.append(f"[{state}] {r['dataset']} {r['model']}: {r['completed']} of {r['expected']}, time left {r.get('time_left') or 'n/a'}" + "".join(f"; {p}" for p in r["problems"]))
    return "\n".join(lines)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    spark = spark or SparkSession.builder.appName("attestor").getOrCreate()
    if args.command == "progress":
        runs = progress_of_runs(spark, args)
        print(json.dumps(runs, indent=2, default=str) if args.json else progress_text(runs))
        return 0 if runs and all(r["resumable"] for r in runs) else UNSAFE
    tables = evaluate_runs(spark, args) if args.command == "evaluate" else audit_runs(spark, args)
    for name, df in tables.items():
        sinks.write_csv(df.orderBy(*df.columns[:3]), f"{args.out}/{name}.csv", refuse_empty=True)
    sinks.verified_text(spark, f"{args.out}/report.md", sinks.report(tables, args.command))
    return 0


__all__ = ["arguments", "evaluate_runs", "audit_runs", "progress_of_runs", "progress_text", "main", "run_paths"]
