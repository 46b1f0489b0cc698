"""All-or-nothing allocation of stock to orders in their sequence.

The rule is sequential: an order takes its stock only if every line finds
enough after the earlier accepted orders, otherwise it takes nothing. It is
evaluated in rounds over whole tables. With ``free`` the stock left on a product
after all accepted orders, each round

* rejects undecided orders with a line above ``free``: no earlier decision can
  give stock back, so the line can never fit;
* accepts orders whose every line fits even if all earlier undecided orders
  were accepted, using a running sum per product;
* subtracts accepted quantities from ``free``.

Lines of products whose whole demand is covered cannot fail and are left out
from the start.

Taking off an accepted order that comes later than an undecided one is safe: it
was accepted with the earlier one already counted. The earliest undecided order
is always decided, so the rounds end; a round that rejects an order leaves
less demand, and one that accepts leaves fewer lines. A chain of orders of which
each depends on the one before takes a round per link.

Lines are written once in blocks by product and sequence, as many as their number
asks for, so that no task's share grows with the table; a round reads the
undecided ones and writes them back with its verdicts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.functions.order import line_amount
from shelfline.operators.running import blocked, over_blocks
from shelfline.session import discard, spread, stage, tasks_for


@dataclass
class Allocation:
    """Accepted lines, rejected order ids, products with the stock that is left."""

    accepted: DataFrame
    rejected: DataFrame
    producto: DataFrame
    rounds: int


def confirm_orders(lines: DataFrame, producto: DataFrame) -> Allocation:
    """Allocate stock to the orders in ``lines``, in (ts, id_solicitud) sequence.

    ``lines`` has id_solicitud, ts, id_producto, cantidad and any further
    columns. Repeated products of an order add up, and the earliest ts of an
    order's lines is the order's. An order with a quantity below 1 or an unknown
    product is rejected whole.
    """
    stocks = producto.select("id_producto", F.col("stock_actual").alias("free"))
    needs = stage(_needs(lines, stocks), "needs")
    count = needs.count()
    dealt = spread(needs, count, "id_solicitud")
    orders = dealt.groupBy("id_solicitud").agg(F.max("unfit").alias("_unfit"), F.min("ts").alias("ts"))
    rejected = [needs.filter("unfit").select("id_solicitud").distinct()]
    # Demand, the lines in doubt and the bounds of the blocks are each read from it.
    fit = stage(dealt.drop("unfit", "ts").join(orders.filter(~F.col("_unfit")).drop("_unfit"), "id_solicitud"), "fit")
    undecided = blocked(_contended(fit), ["id_producto"], ["ts", "id_solicitud"], tasks_for(needs.sparkSession, count))
    written, rounds = [needs, fit, undecided], 0
    while True:
        decided = stage(_decide(undecided), f"round_{rounds}")
        written.append(decided)
        left, done, denied = decided.agg(
            F.count(F.lit(1)), F.count("accepted"), F.count_if(~F.col("accepted"))
        ).first()
        if left and not done:
            raise RuntimeError("no order could be decided; (ts, id_solicitud) must be unique")
        rounds += bool(left)
        if denied:
            rejected.append(decided.filter(~F.col("accepted")).select("id_solicitud").distinct())
        if done == left:
            break
        undecided = _carry_over(decided)
    refused = stage(reduce(DataFrame.unionByName, rejected), "rejected")
    discard(*written)
    accepted = lines.join(refused, "id_solicitud", "left_anti")
    return Allocation(accepted, refused, take_stock(producto, accepted), rounds)


def take_stock(producto: DataFrame, lines: DataFrame) -> DataFrame:
    """Products with the quantities of ``lines`` taken off their stock."""
    return change_stock(
        producto,
        lines.groupBy("id_producto").agg((-F.sum(F.col("cantidad").cast("long"))).alias("cambio")),
    )


def change_stock(producto: DataFrame, changes: DataFrame) -> DataFrame:
    """Products with ``cambio``, at most one row per product, added to their stock."""
    stock = F.col("stock_actual") + F.coalesce("cambio", F.lit(0))
    kept = [
        stock.cast(producto.schema["stock_actual"].dataType).alias(c) if c == "stock_actual" else c
        for c in producto.columns
    ]
    return producto.join(changes.select("id_producto", "cambio"), "id_producto", "left").select(*kept)


def append_orders(accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(order headers, order lines) of accepted cart lines.

    The subtotal is quantity times unit price whatever the feed says, and the
    total is the sum of the subtotals, counted once.
    """
    lines = accepted.withColumn("subtotal", line_amount())
    headers = lines.groupBy("id_solicitud").agg(
        F.min("ts").alias("fecha_solicitud"),
        F.min("id_cliente").alias("id_cliente"),
        F.sum("subtotal").alias("total"),
    )
    return (
        headers.select(
            "id_solicitud",
            "fecha_solicitud",
            F.lit("Pendiente").alias("estado"),
            F.col("total").cast("decimal(22,2)").alias("total"),
            "id_cliente",
        ),
        lines.select("id_solicitud", "id_producto", "cantidad", "precio_unitario", "subtotal"),
    )


def _needs(lines: DataFrame, stocks: DataFrame) -> DataFrame:
    """One row per order and product, marked unfit where it can never be served."""
    merged = lines.groupBy("id_solicitud", "id_producto").agg(
        F.min("ts").alias("ts"),
        F.sum(F.col("cantidad").cast("long")).alias("q"),
        F.min("cantidad").alias("_least"),
        F.count_if(F.col("cantidad").isNull()).alias("_unknown"),
    )
    serviceable = (F.col("_least") > 0) & (F.col("_unknown") == 0) & (F.col("q") <= F.col("free"))
    return merged.join(stocks, "id_producto", "left").select(
        "id_solicitud",
        "ts",
        "id_producto",
        "q",
        F.col("free").cast("long").alias("free"),
        (~F.coalesce(serviceable, F.lit(False))).alias("unfit"),
    )


def _contended(lines: DataFrame) -> DataFrame:
    """Lines of products whose whole demand is above the stock left."""
    short = (
        lines.groupBy("id_producto")
        .agg(F.sum("q").alias("_demand"), F.min("free").alias("_free"))
        .filter(F.col("_demand") > F.col("_free"))
        .select("id_producto")
    )
    return lines.join(short, "id_producto", "left_semi")


def _decide(lines: DataFrame) -> DataFrame:
    """The lines with their order's verdict: true, false or NULL for not yet."""
    ranked = over_blocks(lines, ["id_producto"], ["ts", "id_solicitud"], {"_upto": ("sum", "q")}).select(
        *lines.columns,
        (F.col("_upto") <= F.col("free")).alias("_fits"),
        (F.col("q") > F.col("free")).alias("_lacks"),
    )
    verdict = F.when(F.min("_fits"), F.lit(True)).when(F.max("_lacks"), F.lit(False))
    verdicts = ranked.groupBy("id_solicitud").agg(verdict.alias("accepted"))
    return ranked.drop("_fits", "_lacks").join(verdicts, "id_solicitud")


def _carry_over(decided: DataFrame) -> DataFrame:
    """Undecided lines, with the newly accepted quantities taken off ``free``."""
    taken = (
        decided.filter("accepted").groupBy("id_producto").agg(F.sum("q").alias("_taken"))
    )
    return (
        decided.filter(F.col("accepted").isNull())
        .drop("accepted")
        .join(taken, "id_producto", "left")
        .withColumn("free", F.col("free") - F.coalesce("_taken", F.lit(0)))
        .drop("_taken")
    )
