"""The same flows, with Structured Streaming deciding what is new.

For a folder that files are only ever added to, the stream's checkpoint replaces the cursor: every
file is one increment's worth of rows, read exactly once. Each micro-batch takes the batch path
(transforms, then upsert, type 2 load or change log). A batch that is repeated after a failure
changes nothing, which is why plain append targets are refused.
"""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.cdc import apply_cdc
from millrace.plans.run import load_increment, transformed
from millrace.plans.spec import FlowSpec
from millrace.sinks import MERGE

_FILE_SOURCES = ("s3", "files", "csv", "parquet")


def check_streamable(spec: FlowSpec) -> None:
    if len(spec.sources) != 1 or spec.sources[0].type not in _FILE_SOURCES:
        raise ValueError("a streamed flow reads exactly one file source")
    if not spec.sources[0].config.get("schema"):
        raise ValueError("a streamed source needs a 'schema'")
    if not (spec.target.scd2 or spec.change_log or spec.target.mode == MERGE):
        raise ValueError("a streamed flow needs a target that can take a batch twice: "
                         "mode 'merge', scd2 or a change log")


def stream_flow(spark: SparkSession, spec: FlowSpec, checkpoint: str, as_of: Any = None,
                max_files: int | None = None) -> StreamingQuery:
    """Load all files that have arrived since the last call, then stop.

    ``max_files`` bounds a micro-batch, so that a large backlog is worked off in steps.
    """
    check_streamable(spec)
    source = spec.sources[0]
    config = source.config
    reader = (spark.readStream.format(config.get("format") or source.type)
              .schema(config["schema"]).options(**dict(config.get("options") or {})))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def load(batch: DataFrame, _: int) -> None:
        moment = as_of or datetime.now(timezone.utc).replace(tzinfo=None)
        increment = transformed(spec, apply_cdc(batch, source.cdc))
        load_increment(batch.sparkSession, spec, increment, moment)

    return (reader.load(config["path"]).writeStream.foreachBatch(load)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
