"""Sinks: exports of results and metrics as JSON and CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_results(path: str, sections: dict[str, DataFrame], mode: str = "overwrite") -> None:
    """Each section's rows as JSON lines in its own folder under ``path``; null fields are kept."""
    for name, rows in sections.items():
        rows.write.mode(mode).option("ignoreNullFields", "false").json(f"{path}/{name}")


def export_csv(path: str, rows: DataFrame, mode: str = "overwrite") -> None:
    """Rows as CSV with a header; arrays, maps and structs are written as JSON."""
    nested = {f.name for f in rows.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    rows.select([F.to_json(c).alias(c) if c in nested else F.col(c) for c in rows.columns]).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def metrics_json(metrics: DataFrame) -> DataFrame:
    """(line): (name, type, value, labels, timestamp) as one JSON object a metric."""
    return metrics.select(F.to_json(F.struct("name", "type", "value", *[c for c in ("labels", "timestamp") if c in metrics.columns])).alias("line"))
