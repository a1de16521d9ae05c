"""Run a flow from a file: ``spark-submit --master ... -m millrace flow.yaml`` or ``python -m millrace flow.yaml``."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from millrace.functions.workspace import literal_rows
from millrace.operators.versions import changed_versions, latest
from millrace.plans.run import compact_target, run_flow
from millrace.plans.spec import load_spec
from millrace.sources.files import path_is_missing

_VERSIONS = "flow STRING, version INT, text STRING"


def record_version(spark: SparkSession, path: str, flow: str, text: str) -> int:
    """Append the specification to the version table at ``path`` if it changed; return its version."""
    try:
        history = spark.read.schema(_VERSIONS).parquet(path)
    except AnalysisException as error:
        if not path_is_missing(error):
            raise
        history = literal_rows(spark, [], _VERSIONS)
    incoming = literal_rows(spark, [{"flow": flow, "text": text}], "flow STRING, text STRING")
    changed_versions(history, incoming, "flow", "text").coalesce(1).write.mode("append").parquet(path)
    history = spark.read.schema(_VERSIONS).parquet(path)
    return latest(history.filter(history.flow == flow), "flow").first()["version"]


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace", description="Run a flow once.")
    parser.add_argument("flow", help="YAML specification")
    parser.add_argument("--connections", default="connections.yaml", help="YAML file of named connections")
    parser.add_argument("--as-of", help="moment of the load, e.g. '2025-01-01 00:00:00'")
    parser.add_argument("--compact", action="store_true", help="afterwards, join the small files of a file target")
    parser.add_argument("--versions", help="folder in which versions of specifications are recorded")
    options = parser.parse_args(arguments)

    spec = load_spec(options.flow, options.connections)
    spark = SparkSession.builder.appName(spec.name).getOrCreate()
    result = run_flow(spark, spec, options.as_of)
    print(f"{spec.name}: run {result.run_id} as of {result.as_of}, cursors {dict(result.cursors)}")
    if options.compact:
        compact_target(spark, spec)
    if options.versions:
        text = Path(options.flow).read_text(encoding="utf-8")
        print(f"{spec.name}: specification version {record_version(spark, options.versions, spec.name, text)}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
