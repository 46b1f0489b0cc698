"""Status changes of orders, with stock given back on rejection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.functions.order import PAGE_TRANSITIONS, stored_status
from shelfline.operators.allocation import change_stock
from shelfline.operators.running import running
from shelfline.schema import ORDER_STATES

MODES = ("reference", "strict")


@dataclass
class StatusResult:
    """Orders and products after the changes, the steps taken, the rejected rows."""

    solicitud: DataFrame
    producto: DataFrame
    steps: DataFrame
    rejects: DataFrame


def screen_changes(changes: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable changes with the order's ``actual`` status, rejected changes).

    Synonyms become stored names. Missing values, names outside the status list
    and unknown orders are rejected.
    """
    named = changes.withColumn("estado", stored_status("estado")).join(
        orders.select(
            F.col("id_solicitud").alias("id"), F.col("estado").alias("actual"), F.lit(True).alias("_known")
        ),
        "id",
        "left",
    )
    reason = (
        F.when(F.col("id").isNull() | (F.coalesce("estado", F.lit("")) == ""), "datos")
        .when(~F.col("estado").isin(*ORDER_STATES), "estado")
        .when(F.col("_known").isNull(), "solicitud")
    )
    marked = named.withColumn("motivo", reason).drop("_known")
    return (
        marked.filter("motivo IS NULL").drop("motivo"),
        marked.filter("motivo IS NOT NULL").drop("actual"),
    )


def status_transitions(usable: DataFrame) -> DataFrame:
    """Each change with the status it replaces, in (ts, event_id) sequence.

    ``devuelve`` marks the changes that give stock back: those into
    ``Rechazada`` from any other status.
    """
    stepped = running(
        usable.withColumn("_at", F.struct("ts", "event_id", "estado")),
        ["id"],
        ["ts", "event_id"],
        {"_before": ("max", "_at")},
        inclusive=False,
    )
    previous = F.when(F.col("_before").isNull(), F.col("actual")).otherwise(F.col("_before.estado"))
    return stepped.withColumn("previo", previous).select(
        "event_id",
        "ts",
        "id",
        "previo",
        F.col("estado").alias("nuevo"),
        (
            (F.col("estado") == "Rechazada") & ~F.col("previo").eqNullSafe("Rechazada")
        ).alias("devuelve"),
    )


def page_transitions(usable: DataFrame) -> DataFrame:
    """The changes that the order page would offer at their time, as steps.

    An order makes at most two: the first approval or rejection while pending,
    then the first delivery after an approval. Both are minima per order, so no
    order has to be read in sequence by one task.
    """
    at = F.struct("ts", "event_id", "estado")
    first = usable.groupBy("id").agg(
        F.min("actual").alias("actual"),
        F.min(
            F.when(
                (F.col("actual") == "Pendiente") & F.col("estado").isin("Aprobada", "Rechazada"), at
            )
        ).alias("first"),
    )
    approved_at = F.when(F.col("first.estado") == "Aprobada", F.col("first"))
    deliverable = (F.col("actual") == "Aprobada") | (
        approved_at.isNotNull() & (at > approved_at)
    )
    second = (
        usable.filter(F.col("estado") == "Entregada")
        .join(first.select("id", "first"), "id")
        .filter(deliverable)
        .groupBy("id")
        .agg(F.min(at).alias("step"))
    )
    steps = (
        first.filter(F.col("first").isNotNull())
        .select("id", F.col("first").alias("step"))
        .unionByName(second)
        .select("id", "step.*")
    )
    previous = F.when(F.col("estado") == PAGE_TRANSITIONS[2][1], PAGE_TRANSITIONS[2][0]).otherwise(
        PAGE_TRANSITIONS[0][0]
    )
    return steps.select(
        "event_id",
        "ts",
        "id",
        previous.alias("previo"),
        F.col("estado").alias("nuevo"),
        (F.col("estado") == "Rechazada").alias("devuelve"),
    )


def apply_status(
    changes: DataFrame,
    orders: DataFrame,
    lines: DataFrame,
    producto: DataFrame,
    mode: str = "reference",
) -> StatusResult:
    """Apply a batch of status changes to orders and stock.

    ``mode="reference"`` allows every change, so a second rejection gives stock
    back a second time; ``mode="strict"`` takes only what the order page offers
    and rejects the rest.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    usable, rejects = screen_changes(changes, orders)
    if mode == "reference":
        steps = status_transitions(usable)
    else:
        steps = page_transitions(usable)
        refused = usable.drop("actual").join(steps.select("event_id"), "event_id", "left_anti")
        rejects = rejects.unionByName(refused.withColumn("motivo", F.lit("transicion")))
    last = steps.groupBy(F.col("id").alias("id_solicitud")).agg(
        F.max_by("nuevo", F.struct("ts", "event_id")).alias("_last"),
        F.count_if("devuelve").alias("_times"),
    )
    final = orders.join(last.select("id_solicitud", "_last"), "id_solicitud", "left").withColumn(
        "estado", F.coalesce("_last", "estado")
    )
    returned = (
        lines.join(last.filter("_times > 0").select("id_solicitud", "_times"), "id_solicitud")
        .groupBy("id_producto")
        .agg(F.sum(F.col("cantidad").cast("long") * F.col("_times")).alias("cambio"))
    )
    return StatusResult(
        final.select(orders.columns), change_stock(producto, returned), steps, rejects
    )
