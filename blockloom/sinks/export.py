"""Query results to files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from blockloom.sinks.files import list_files

EXPORT_FORMATS = ("parquet", "json", "csv")


@dataclass(frozen=True)
class ExportResult:
    location: str
    output_format: str
    row_count: int
    bytes: int


def export_result(df: DataFrame, path: str, output_format: str = "parquet") -> ExportResult:
    """Write ``df`` below a path of its own and measure it in the same job.

    Writing the same query id again replaces its folder.
    """
    if output_format not in EXPORT_FORMATS:
        raise ValueError(f"unsupported output format: {output_format}")
    seen = Observation("export")
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").format(output_format)
    if output_format == "csv":
        writer = writer.option("header", "true")
    writer.save(path)
    size = list_files(df.sparkSession, path, glob=f"*.{output_format}*").agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return ExportResult(path, output_format, seen.get["rows"], size)
