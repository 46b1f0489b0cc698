"""Low-stock alerts as movements arrive.

Movements are summed per product and minute first, so that a product with very
many of them is one row a minute. The balances are keyed state, carried on from
minute to minute in Arrow batches, a key for every 64 ids that follow each other:
one call of Python books the minutes of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfline.schema import LOW_STOCK
from shelfline.streaming.runner import require_utc

ALERT = "id_producto long, ts timestamp, cantidad long, saldo long"
#: Two to this power ids have their balances in one state. It bounds the state of a key, whatever the number of products.
ID_BITS = 6


def _book(low: int):
    """The crossing rule as an inner function, which executors get without this package."""

    def book(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True)
        order = np.lexsort((rows["ts"].to_numpy(), rows["id_producto"].to_numpy()))
        product, moved = rows["id_producto"].to_numpy()[order], rows["cantidad"].fillna(0).to_numpy(np.int64)[order]
        first = np.flatnonzero(np.diff(product, prepend=product[0] - 1))
        ids, opening = product[first].tolist(), rows["opening"].to_numpy()[order[first]].tolist()
        balances = dict(zip(*state.get)) if state.exists else {}
        start = np.array([balances.get(i, own) for i, own in zip(ids, opening)], np.int64)
        upto = np.cumsum(moved)
        # Sums run through all products, so each begins at its own balance less what came before it.
        balance = upto + np.repeat(start - (upto - moved)[first], np.diff(first, append=len(product)))
        balances.update(zip(ids, balance[np.append(first[1:], len(product)) - 1].tolist()))
        state.update((list(balances), list(balances.values())))
        crossed = np.flatnonzero((balance - moved >= low) & (balance < low))
        found = rows.iloc[order[crossed]][["id_producto", "ts", "cantidad"]]
        yield found.assign(saldo=balance[crossed])

    return book


def minute_sums(moves: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Movements (id_producto, ts, signed cantidad) summed per product and minute.

    A minute comes out once the watermark has passed it, so minutes come in
    sequence; movements later than the watermark are dropped.
    """
    require_utc(moves.sparkSession)
    return (
        moves.withColumn("at", F.col("ts").cast("timestamp"))
        .withWatermark("at", delay)
        .groupBy(F.window("at", "1 minute").alias("_minute"), "id_producto")
        .agg(F.sum("cantidad").alias("cantidad"))
        .select("id_producto", F.col("_minute.start").alias("ts"), "cantidad")
    )


def stream_alerts(minutes: DataFrame, producto: DataFrame, low: int = LOW_STOCK) -> DataFrame:
    """Minutes that take a product from enough stock to low stock: id_producto, ts, cantidad, saldo.

    ``minutes`` is a stream of ``minute_sums`` in sequence, written by a query of its
    own; movements of products that are unknown or have no stock given are left out.
    """
    require_utc(minutes.sparkSession)
    opening = producto.filter("stock_actual IS NOT NULL").select("id_producto", F.col("stock_actual").cast("long").alias("opening"))
    keyed = minutes.join(opening, "id_producto").withColumn("_products", F.shiftright("id_producto", ID_BITS)).groupBy("_products")
    alerts = keyed.applyInPandasWithState(_book(low), ALERT, "ids array<long>, saldos array<long>", "append", GroupStateTimeout.NoTimeout)
    return alerts.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
