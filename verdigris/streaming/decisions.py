"""Decisions over streams: the same plan, written with exactly-once file sinks or counted in windows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdigris.functions.registry import FunctionRegistry
from verdigris.model import Ruleset
from verdigris.plans.evaluation import evaluate


def decide_stream(stream: DataFrame, ruleset: Ruleset, registry: FunctionRegistry | None = None, **options: Any) -> DataFrame:
    """Input and decision columns of a streaming DataFrame; stateless, so any output mode and trigger will do."""
    options.setdefault("fail_on_error", False)
    return evaluate(stream, ruleset, registry, **options).attached_df


def write_decisions(decided: DataFrame, path: str, checkpoint: str, **options: Any) -> StreamingQuery:
    """Append decisions to parquet files; the checkpoint makes each input row count once."""
    return decided.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start(path)


def windowed_coverage(decided: DataFrame, event_time: str, window: str, lateness: str, prefix: str = "rules") -> DataFrame:
    """Rows, unmatched rows and errors per window of event time; rows later than ``lateness`` are left out."""
    matched, error = F.col(f"{prefix}_matched"), F.col(f"{prefix}_error")
    counts = decided.withWatermark(event_time, lateness).groupBy(F.window(event_time, window)).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~matched & error.isNull()).alias("n_unmatched"), F.count_if(error.isNotNull()).alias("n_errors")
    )
    return counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n_rows", "n_unmatched", "n_errors")
