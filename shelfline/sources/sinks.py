"""Result sinks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame

from shelfline.session import stage


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row, NULL fields kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def export_report(
    df: DataFrame, directory: str, kind: str, as_of: date, drop: Sequence[str] = ()
) -> str:
    """Write the rows as CSV under ``Reportes_<kind>_<date>`` and return the path.

    ``drop`` leaves out columns that only serve the page. A report without rows
    is refused.
    """
    rows = stage(df.drop(*drop), "report")
    if rows.isEmpty():
        raise ValueError("no rows to export")
    path = f"{directory.rstrip('/')}/Reportes_{kind}_{as_of.isoformat()}"
    rows.write.mode("overwrite").option("header", True).csv(path)
    return path
