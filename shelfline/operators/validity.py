"""Validity of recovery codes at the time they are tried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.operators.running import running

# Kinds of rows in the code feed.
ISSUED, TRIED, CONSUMED = "emitido", "intento", "consumido"
TTL_MINUTES = 15


def still_open(issued: Column, tried: Column, minutes: int = TTL_MINUTES) -> Column:
    """Expiry is kept to the second and must lie after the attempt."""
    expiry = F.date_trunc("second", issued) + F.make_dt_interval(mins=F.lit(minutes))
    return expiry > F.date_trunc("second", tried)


def code_validity(feed: DataFrame, minutes: int = TTL_MINUTES) -> DataFrame:
    """Each attempt with the code it meets and whether that code is valid.

    ``feed`` has id_usuario, ts, event_id and tipo. A new code replaces the old
    one and a consumed code is gone; rows count in (ts, event_id) sequence. The
    latest code and the latest use come from running maxima, so one pass over
    the feed serves all attempts.
    """
    at = F.struct("ts", "event_id")
    marked = feed.withColumns(
        {"_issue": F.when(F.col("tipo") == ISSUED, at), "_use": F.when(F.col("tipo") == CONSUMED, at)}
    )
    seen = running(
        marked,
        ["id_usuario"],
        ["ts", "event_id"],
        {"_last_issue": ("max", "_issue"), "_last_use": ("max", "_use")},
    )
    current = F.when(
        F.col("_last_use").isNull() | (F.col("_last_issue") > F.col("_last_use")),
        F.col("_last_issue.ts"),
    )
    return seen.filter(F.col("tipo") == TRIED).select(
        "event_id",
        "id_usuario",
        "ts",
        current.alias("emitido_en"),
        F.coalesce(still_open(current, F.col("ts"), minutes), F.lit(False)).alias("valido"),
    )
