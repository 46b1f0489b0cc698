"""Order lists, order lines and order boards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.functions.order import line_amount, status_class
from shelfline.functions.product import description_fields, product_code
from shelfline.functions.text import contains_lower, or_default, padded
from shelfline.session import spread

Tables = Mapping[str, DataFrame]


def with_customer(orders: DataFrame, t: Tables, *columns: str) -> DataFrame:
    """Orders joined to their customer's person; orders without one drop out."""
    return orders.join(t["cliente"].select("id_cliente", "id_persona"), "id_cliente").join(
        t["persona"].select("id_persona", *columns), "id_persona"
    )


def order_list(t: Tables) -> DataFrame:
    """Orders with customer name and time to the minute, newest first."""
    return (
        with_customer(t["solicitud"], t, "nombre")
        .select(
            "id_solicitud",
            "estado",
            "total",
            F.date_format("fecha_solicitud", "yyyy-MM-dd HH:mm").alias("fecha"),
            F.col("nombre").alias("cliente"),
        )
        .orderBy(F.desc("id_solicitud"))
    )


def order_sheet(listed: DataFrame) -> DataFrame:
    """The order list as its page shows it: padded number, day, status class."""
    return listed.select(
        "id_solicitud",
        F.concat(F.lit("#"), padded("id_solicitud", 4)).alias("numero"),
        "cliente",
        F.substring_index("fecha", " ", 1).alias("dia"),
        "estado",
        status_class("estado").alias("clase"),
        "total",
    )


def order_search(listed: DataFrame, text: str = "", status: str = "todos") -> DataFrame:
    """Orders by customer substring and status; ``todos`` keeps every status."""
    found = listed.filter(contains_lower("cliente", text))
    return found if status == "todos" else found.filter(F.col("estado") == status)


def latest_orders(t: Tables, n: int = 5) -> DataFrame:
    return (
        with_customer(t["solicitud"], t, "nombre")
        .orderBy(F.desc("id_solicitud"))
        .limit(n)
        .select(
            "id_solicitud",
            F.col("nombre").alias("cliente"),
            "total",
            F.col("fecha_solicitud").alias("fecha"),
        )
    )


def order_lines(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Lines with product name and code, of the orders in ``ids`` or of all."""
    lines = t["detalle_solicitud"]
    if ids is not None:
        lines = lines.join(ids, "id_solicitud", "left_semi")
    products = t["producto"].select(
        "id_producto",
        "nombre_producto",
        product_code("id_producto", description_fields("descripcion")["codigo"]).alias("codigo"),
    )
    return lines.select(
        "id_solicitud", "id_producto", "cantidad", "precio_unitario", "subtotal"
    ).join(products, "id_producto")


def order_items(lines: DataFrame, producto: DataFrame) -> DataFrame:
    """The product names of each order, a row per name, with its lines and pieces.

    A name is listed however many lines an order has, so nothing is cut; lines of
    unknown products have no name and no row. Lines are counted first, so that a
    task of either sum gets a bounded share of them.
    """
    count = lines.count()
    sums = _per_product(spread(lines.select("id_solicitud", "id_producto", "cantidad"), count, "id_solicitud", "id_producto"))
    named = sums.join(producto.select("id_producto", "nombre_producto"), "id_producto").filter(F.col("nombre_producto").isNotNull())
    return (
        spread(named, count, "id_solicitud", "nombre_producto")
        .groupBy("id_solicitud", "nombre_producto")
        .agg(F.sum("lineas").alias("lineas"), F.sum("cantidad").alias("cantidad"))
    )


def _per_product(lines: DataFrame) -> DataFrame:
    """Lines and pieces per order and product."""
    return (
        lines.filter(F.col("id_solicitud").isNotNull())
        .groupBy("id_solicitud", "id_producto")
        .agg(F.count(F.lit(1)).alias("lineas"), F.sum(F.col("cantidad").cast("long")).alias("cantidad"))
    )


def order_board(t: Tables) -> DataFrame:
    """Orders with contact data, number of product names and of pieces, newest first.

    Lines are summed before any other join, and a person with several users
    shows the first user's mail, so neither repeats nor inflates an order. The
    names themselves are rows of ``order_items``.
    """
    names = t["producto"].select("id_producto", F.col("nombre_producto").isNotNull().alias("_named"))
    items = (
        _per_product(t["detalle_solicitud"])
        .join(names, "id_producto", "left")
        .groupBy("id_solicitud")
        .agg(F.sum(F.when(F.col("_named"), F.col("lineas"))).alias("productos"), F.sum("cantidad").alias("total_items"))
    )
    mails = t["usuario"].groupBy("id_persona").agg(F.min_by("correo", "id_usuario").alias("correo"))
    board = (
        with_customer(
            t["solicitud"].select("id_solicitud", "id_cliente", "estado"),
            t,
            "nombre",
            "telefono",
            "direccion",
        )
        .join(mails, "id_persona", "left")
        .join(items, "id_solicitud", "left")
    )
    return board.select(
        "id_solicitud",
        F.col("nombre").alias("cliente"),
        or_default("telefono", "N/A").alias("telefono"),
        "direccion",
        or_default("correo", "N/A").alias("correo"),
        "estado",
        F.coalesce("productos", F.lit(0)).alias("productos"),
        F.coalesce("total_items", F.lit(0)).alias("total_items"),
    ).orderBy(F.desc("id_solicitud"))


def cart_totals(lines: DataFrame) -> DataFrame:
    """Cart total per order: sum of price times quantity."""
    return lines.groupBy("id_solicitud").agg(F.sum(line_amount()).alias("total"))


def merge_lines(lines: DataFrame, producto: DataFrame) -> DataFrame:
    """Lines of one product in one cart put together, and whether stock covers them."""
    merged = lines.groupBy("id_solicitud", "id_producto").agg(
        F.sum(F.col("cantidad").cast("long")).alias("cantidad")
    )
    return merged.join(
        producto.select("id_producto", "stock_actual"), "id_producto", "left"
    ).select(
        "id_solicitud",
        "id_producto",
        "cantidad",
        F.coalesce(F.col("cantidad") <= F.col("stock_actual"), F.lit(False)).alias("alcanza"),
    )


def price_orders(lines: DataFrame, producto: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(priced lines, lines of unknown products): total = current price x quantity."""
    priced = lines.join(
        producto.select("id_producto", "precio", F.lit(True).alias("_known")), "id_producto", "left"
    )
    known = priced.filter("_known").withColumn("total", line_amount("cantidad", "precio"))
    return known.drop("_known"), priced.filter("_known IS NULL").select(lines.columns)


def derive_totals(headers: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, lines) with subtotal = quantity x unit price, total = sum of subtotals."""
    computed = lines.withColumn("subtotal", line_amount())
    sums = computed.groupBy("id_solicitud").agg(F.sum("subtotal").alias("_sum"))
    totals = headers.join(sums, "id_solicitud", "left").withColumn(
        "total", F.coalesce("_sum", F.lit(0)).cast("decimal(22,2)")
    )
    return totals.select(headers.columns), computed
