"""Overlap filters on streams: the predicates are stateless, so lines flow through as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strandframe.functions.overlap import Filter
from strandframe.sources.readers import PARSERS


def overlap_stream(spark: SparkSession, folder: str, kind: str = "paf") -> DataFrame:
    """Overlaps of the files that appear in a folder, with the lines they came from (raw)."""
    lines = spark.readStream.text(folder).selectExpr("value", "value as raw")
    return PARSERS[kind](lines).withColumnsRenamed({"a_name": "a_id", "b_name": "b_id"})


def filtered_lines(overlaps: DataFrame, rules: str, removed_pairs: DataFrame | None = None) -> DataFrame:
    """The lines of valid overlaps; those of listed pairs (t, q), a static table, are left out."""
    from pyspark.sql import functions as F

    out = overlaps.where(Filter.parse(rules).valid())
    if removed_pairs is not None:
        known = removed_pairs.select(F.least("t", "q").alias("_lo"), F.greatest("t", "q").alias("_hi")).distinct()
        out = out.withColumns({"_lo": F.least("a_id", "b_id"), "_hi": F.greatest("a_id", "b_id")}).join(known, ["_lo", "_hi"], "left_anti")
    return out.selectExpr("raw as value")


def write_lines(lines: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write lines until all files that are there now are read; a restart goes on from the checkpoint."""
    return lines.writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
