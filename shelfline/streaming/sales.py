"""Delivered sales per time window, as orders arrive."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryProgress

from shelfline.streaming.runner import observed, require_utc, updated

#: Name of the metric of every batch: delivered orders that arrived.
ARRIVED = "entregadas"


def windowed_sales(orders: DataFrame, width: str = "1 day", delay: str = "10 days") -> DataFrame:
    """Order count and delivered total per window, as they change.

    Meant for the update mode: a window comes out whenever orders for it arrive, its
    last row has its sums. An order more than ``delay`` behind the newest one may be
    dropped; ``late_orders`` counts them.
    """
    require_utc(orders.sparkSession)
    return (
        orders.filter((F.col("estado") == "Entregada") & F.col("fecha_solicitud").isNotNull())
        .observe(ARRIVED, F.count(F.lit(1)).alias("n"))
        .withColumn("ts", F.col("fecha_solicitud").cast("timestamp"))
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("_window"))
        .agg(F.count(F.lit(1)).alias("pedidos"), F.sum("total").alias("ventas"))
        .select(
            F.col("_window.start").cast("timestamp_ntz").alias("desde"),
            F.col("_window.end").cast("timestamp_ntz").alias("hasta"),
            "pedidos",
            "ventas",
        )
    )


def late_orders(windows: DataFrame, progress: Iterable[StreamingQueryProgress]) -> int:
    """Delivered orders that came too late for their window: those that arrived less those in the windows' last rows."""
    return observed(progress, ARRIVED, "n") - (windows.agg(F.sum("pedidos")).first()[0] or 0)


def sales_to_end(orders: DataFrame, width: str = "1 day", delay: str = "10 days") -> tuple[DataFrame, int]:
    """(the windows of all orders that there are, the number of orders that came too late)."""
    windows, progress = updated(windowed_sales(orders, width, delay), ["desde", "hasta"], "sales")
    return windows, late_orders(windows, progress)
