"""Validity of recovery codes, answered as attempts arrive.

An attempt is joined with the codes issued and consumed by the same user in the
minutes a code lives, and the latest of each decide. Both sides have a watermark:
an attempt is answered once it has passed the attempt, and rows later than the
watermark are dropped, as everywhere in Structured Streaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.operators.validity import CONSUMED, ISSUED, TRIED, TTL_MINUTES, still_open
from shelfline.streaming.runner import require_utc


def stream_validity(feed: DataFrame, minutes: int = TTL_MINUTES, delay: str = "10 minutes") -> DataFrame:
    """event_id, id_usuario, ts and valido for every attempt of the stream.

    ``feed`` has id_usuario, ts, event_id and tipo; rows count in (ts, event_id)
    sequence. A code or its use before the life of a code cannot matter: an older
    code is expired, and an older use precedes every code that is not.
    """
    require_utc(feed.sparkSession)
    timed = feed.withColumn("at", F.col("ts").cast("timestamp"))
    tried = timed.filter(F.col("tipo") == TRIED).select("event_id", "id_usuario", "at").withWatermark("at", delay)
    marks = timed.filter(F.col("tipo").isin(ISSUED, CONSUMED)).select(
        F.col("event_id").alias("mark_id"), F.col("id_usuario").alias("mark_user"), "tipo", F.col("at").alias("mark_at")
    ).withWatermark("mark_at", delay)
    met = tried.join(
        marks,
        F.expr(
            f"id_usuario = mark_user AND mark_at <= at AND mark_at >= at - INTERVAL {minutes * 60 + 1} SECONDS "
            "AND (mark_at < at OR mark_id < event_id)"
        ),
        "left",
    )
    mark = F.struct("mark_at", "mark_id")
    last = met.groupBy("at", "event_id", "id_usuario").agg(
        F.max(F.when(F.col("tipo") == ISSUED, mark)).alias("issue"), F.max(F.when(F.col("tipo") == CONSUMED, mark)).alias("use")
    )
    current = F.when(F.col("use").isNull() | (F.col("issue") > F.col("use")), F.col("issue.mark_at"))
    return last.select(
        "event_id",
        "id_usuario",
        F.col("at").cast("timestamp_ntz").alias("ts"),
        F.coalesce(still_open(current, F.col("at"), minutes), F.lit(False)).alias("valido"),
    )
