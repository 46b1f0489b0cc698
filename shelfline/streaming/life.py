"""Receipts, status changes and cancellations as one stream of commands.

All commands on orders go through keyed state, a key for every 64 order ids that follow each other: an order's commands wait
until the watermark has passed them, then they are applied in (ts, event_id) sequence, whatever batch brought
them. So a late change never undoes a newer one, and a cancellation is final: what follows it is a
reject, a second cancellation too. Steps, stock changes and rejects of a batch go to the log
under one batch number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from shelfline.functions.order import PAGE_TRANSITIONS, stored_status
from shelfline.operators.status import MODES
from shelfline.operators.stock import apply_receipts
from shelfline.schema import ORDER_STATES
from shelfline.session import stage
from shelfline.streaming.log import BatchLog
from shelfline.streaming.runner import require_utc, rocks

#: Kinds of commands: ``id`` is an order for the first two, a product for the third.
STATUS, CANCEL, RECEIPT = "estado", "anular", "recepcion"
COMMAND = "event_id long, ts timestamp_ntz, tipo string, id long, estado string, cantidad int"
_STEP = "event_id long, micros long, tipo string, id long, previo string, nuevo string, devuelve boolean, motivo string"

#: Two to this power order ids are one key of the state, which bounds it whatever the number of orders.
ID_BITS = 6


def _keeper(strict: bool) -> StatefulProcessor:
    """The processor as an inner class, which executors get without this package."""
    offered, cancel, rejected = set(PAGE_TRANSITIONS), CANCEL, "Rechazada"
    names = [field.split(" ")[0] for field in _STEP.split(", ")]

    class Keeper(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.orders = handle.getValueState("orders", "ids array<long>, estados array<string>, anuladas array<boolean>, alarm long")
            self.waiting = handle.getListState("waiting", "micros long, event_id long, id long, tipo string, estado string, actual string")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            new = []
            for part in rows:
                columns = [part[c].tolist() for c in ("micros", "event_id", "id", "tipo", "estado", "actual")]
                new += [(m, e, i, t, s if isinstance(s, str) else None, a) for m, e, i, t, s, a in zip(*columns)]
            self.waiting.appendList(new)
            kept = self.orders.get()
            ids, states, gone, alarm = kept if kept is not None else ([], [], [], None)
            due = -(-min(c[0] for c in new) // 1000)
            if alarm is None or due < alarm:
                if alarm is not None:
                    self.handle.deleteTimer(alarm)
                self._wake(ids, states, gone, due)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            ids, states, cancelled, _ = self.orders.get()
            orders = {i: (s, g) for i, s, g in zip(ids, states, cancelled)}
            commands = sorted(self.waiting.get(), key=lambda c: (c[0], c[1], c[3], c[4] or ""))
            due = [c for c in commands if c[0] <= passed]
            later = commands[len(due) :]
            out = []
            for micros, event_id, number, kind, wanted, actual in due:
                state, gone = orders.get(number, (actual, False))
                reason, back, before = None, False, state
                if gone:
                    reason = "solicitud"
                elif kind == cancel:
                    gone, back = True, state != rejected
                elif strict and (state, wanted) not in offered:
                    reason = "transicion"
                else:
                    back = wanted == rejected and state != rejected
                if reason is None and kind != cancel:
                    state = wanted
                orders[number] = state, gone
                out.append((event_id, micros, kind, number, before, wanted, back, reason))
            self.waiting.clear()
            if later:
                self.waiting.put(later)
            kept = list(orders.items())
            due_at = -(-later[0][0] // 1000) if later else None
            self._wake([i for i, _ in kept], [s for _, (s, _) in kept], [g for _, (_, g) in kept], due_at)
            yield pd.DataFrame(out, columns=names)

        def _wake(self, ids, states, gone, due) -> None:
            """The states, and one timer for all of them, at the earliest waiting command."""
            if due is not None:
                self.handle.registerTimer(due)
            self.orders.update((list(ids), list(states), list(gone), due))

    return Keeper()


def order_steps(commands: DataFrame, orders: DataFrame, mode: str = "reference", delay: str = "1 day") -> DataFrame:
    """A stream of what each command on an order does: its step, or the reason (``motivo``) for its rejection.

    ``commands`` has the columns of COMMAND, of which receipts are left out here; ``orders`` gives the status an
    order has before its first command. ``devuelve`` marks steps that give the order's stock back.
    Commands later than the watermark are dropped by Spark, which counts them in the progress.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    require_utc(commands.sparkSession)
    known = orders.select(F.col("id_solicitud").alias("id"), F.col("estado").alias("actual"), F.lit(True).alias("_known"))
    timed = commands.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    named = timed.filter(F.col("tipo").isin(STATUS, CANCEL)).withColumn("estado", stored_status("estado")).join(known, "id", "left")
    changes = F.col("tipo") == STATUS
    reason = (
        F.when(F.col("id").isNull() | F.col("ts").isNull() | F.col("event_id").isNull() | (changes & (F.coalesce("estado", F.lit("")) == "")), "datos")
        .when(changes & ~F.col("estado").isin(*ORDER_STATES), "estado")
        .when(F.col("_known").isNull(), "solicitud")
    )
    marked = named.withColumns({"motivo": reason, "micros": F.unix_micros("at")})
    refused = marked.filter("motivo IS NOT NULL").select(
        "event_id", "micros", "tipo", "id", "actual", "estado", F.lit(False), "motivo"
    ).toDF(*[field.split(" ")[0] for field in _STEP.split(", ")])
    usable = marked.filter("motivo IS NULL").select("id", "at", "micros", "event_id", "tipo", "estado", "actual")
    keyed = usable.withColumn("_orders", F.shiftright("id", ID_BITS)).groupBy("_orders")
    steps = keyed.transformWithStateInPandas(_keeper(mode == "strict"), _STEP, "append", "EventTime")
    return steps.unionByName(refused).withColumn("ts", F.timestamp_micros("micros").cast("timestamp_ntz")).drop("micros")


def run_commands(commands: DataFrame, log: BatchLog, checkpoint: str, mode: str = "reference", delay: str = "1 day") -> StreamingQuery:
    """Start all commands that are there on the orders, lines and products of ``log``.

    A batch logs statuses, changes of stock and rejects; running it again overwrites its own rows.
    """
    steps = order_steps(commands, log.rows("solicitud"), mode, delay)
    receipts = commands.filter(F.coalesce(F.col("tipo"), F.lit("")) == RECEIPT).select("event_id", "ts", "tipo", "id", "cantidad")
    odd = commands.filter(~F.coalesce(F.col("tipo").isin(STATUS, CANCEL, RECEIPT), F.lit(False)))
    odd = odd.select("event_id", "ts", "tipo", "id", F.lit("tipo").alias("motivo"))
    whole = steps.unionByName(receipts, allowMissingColumns=True).unionByName(odd, allowMissingColumns=True)

    def take(batch: DataFrame, batch_id: int) -> None:
        rows = stage(batch, "commands")
        if rows.isEmpty():
            return
        done = rows.filter(F.col("tipo").isin(STATUS, CANCEL) & F.col("motivo").isNull())
        log.write(
            "estado",
            batch_id,
            done.select(
                F.col("id").alias("id_solicitud"), F.coalesce("nuevo", "previo").alias("estado"), "ts", "event_id", (F.col("tipo") == CANCEL).alias("anulada")
            ),
        )
        times = done.filter("devuelve").groupBy(F.col("id").alias("id_solicitud")).agg(F.count(F.lit(1)).alias("_times"))
        returned = log.rows("detalle_solicitud").join(times, "id_solicitud").select("id_producto", (F.col("cantidad").cast("long") * F.col("_times")).alias("cambio"))
        feed = rows.filter(F.col("tipo") == RECEIPT).select(F.col("id").alias("id_producto"), "cantidad")
        _, booked, wrong = apply_receipts(feed, log.tables["producto"])
        changes = returned.unionByName(booked.select("id_producto", F.col("cantidad").cast("long").alias("cambio")))
        log.write("cambio_stock", batch_id, changes.groupBy("id_producto").agg(F.sum("cambio").alias("cambio")))
        refused = rows.filter(F.col("motivo").isNotNull()).select(F.col("id").cast("string").alias("pedido"), "motivo")
        log.write("rechazo", batch_id, refused.unionByName(wrong.select(F.col("id_producto").cast("string").alias("pedido"), "motivo")))

    with rocks(commands.sparkSession):
        return whole.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
