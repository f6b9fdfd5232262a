"""The same operators over streams of changed files and of rule hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, is_text


def clean_stream(files: DataFrame) -> DataFrame:
    """A stream (or table) of files (repo, path, content, ...) with text contents cleaned; stateless, binary files are left out."""
    return files.filter(is_text(F.col("content"))).withColumn("text", clean(F.col("path"), F.col("content").cast("string"))).drop("content")


def result_counts(reports: DataFrame, window: str = "1 hour", late: str = "3 days", time: str = "reported_at") -> DataFrame:
    """Distinct reports per window, ruleset and result from a stream of `reports` rows. Redelivered reports count once as long as they come within `late`; the
    watermark bounds the state. Uncertain reports and errors don't count."""
    own = reports.filter(~F.col("maybe") & F.col("result").isNotNull()).withWatermark(time, late)
    once = own.dropDuplicatesWithinWatermark(["report_id"])
    return once.groupBy(F.window(time, window).alias("window"), "ruleset", "result").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "ruleset", "result", "n")
