"""JSON feeds of orders and products, read into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.product import description_json

STRICT_JSON = {"allowSingleQuotes": "false"}

# Fields of an order document, with order_id and ts for the sequence.
# Numbers are read as text, as one page sends them quoted.
ORDER_SCHEMA = (
    "order_id bigint, ts timestamp_ntz, cedula string, nombre string, direccion string, "
    "telefono string, carrito array<struct<id_producto string, cant string, precio string>>"
)

# Fields of a product document.
PRODUCT_SCHEMA = (
    "id_producto string, codigo string, nombre string, marca_repuesto string, "
    "marca_carro string, transmision string, compra string, precio string, stock string"
)


def parse_orders(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(order headers, cart lines, rejected documents) of JSON texts in ``value``.

    A document that is no order object or has an empty cart is rejected.
    """
    return split_orders(read_orders(raw))


def _opened(raw: DataFrame, schema: str, *keep: str) -> DataFrame:
    """The documents' fields beside the columns to keep, NULL where a text is no document.

    A generator reads the document once: filters and columns made of its fields stay above
    it, where Spark would repeat the reading for each of them. Its outer form keeps every text.
    """
    return raw.select(*keep, F.inline_outer(F.array(F.from_json("value", schema, STRICT_JSON))))


def read_orders(raw: DataFrame, *keep: str) -> DataFrame:
    """The texts with the fields of the order document read from each, and columns to keep."""
    return _opened(raw, ORDER_SCHEMA, "value", *keep)


def order_keys(raw: DataFrame) -> DataFrame:
    """order_id and ts of each order document, without its other fields."""
    return _opened(raw, "order_id bigint, ts timestamp_ntz")


def split_orders(read: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, lines, broken texts) of documents read; headers and lines have the columns kept."""
    filled = F.coalesce(F.size("carrito"), F.lit(0)) > 0
    headers = read.filter(filled).withColumnRenamed("order_id", "id_solicitud").drop("carrito", "value")
    # The outer form keeps the cart filter above, which an inner explode would repeat below itself.
    items = read.select(
        F.col("order_id").alias("id_solicitud"),
        "ts",
        F.posexplode_outer("carrito").alias("linea", "_item"),
        *keep,
    ).filter(F.col("linea").isNotNull())
    lines = items.select(
        "id_solicitud",
        "ts",
        "linea",
        _number("_item.id_producto", "bigint").alias("id_producto"),
        _number("_item.cant", "int").alias("cantidad"),
        _number("_item.precio", "decimal(12,2)").alias("precio_unitario"),
        *keep,
    )
    return headers, lines, read.filter(~filled).select("value")


def document_totals(read: DataFrame) -> DataFrame:
    """id_solicitud, ts, lineas, piezas and total of each order document, added up inside its cart.

    ``read`` comes from ``read_orders``. Items without a usable quantity or price add nothing;
    a text without a cart has no row. Nothing is exploded or shuffled.
    """
    quantity, price = (lambda item: _number(item["cant"], "int")), (lambda item: _number(item["precio"], "decimal(12,2)"))
    nothing = F.lit(0).cast("decimal(24,2)")
    amount = F.aggregate("carrito", nothing, lambda sum_, item: (sum_ + F.coalesce(quantity(item) * price(item), nothing)).cast("decimal(24,2)"))
    pieces = F.aggregate("carrito", F.lit(0).cast("long"), lambda sum_, item: sum_ + F.coalesce(quantity(item), F.lit(0)))
    carts = read.filter(F.coalesce(F.size("carrito"), F.lit(0)) > 0)
    return carts.select(
        F.col("order_id").alias("id_solicitud"), "ts", F.size("carrito").alias("lineas"), pieces.alias("piezas"), amount.alias("total")
    )


def parse_products(raw: DataFrame) -> DataFrame:
    """Product feed rows, with the description they are stored under.

    Missing brands, car, gearbox and code become empty text and a missing
    purchase price becomes 0; a missing name, price or stock stays NULL.
    """
    doc = _opened(raw, PRODUCT_SCHEMA)
    blank = F.lit("")
    texts = ("codigo", "marca_repuesto", "marca_carro", "transmision")
    described = description_json(
        F.col("marca_repuesto"), F.col("marca_carro"), F.col("transmision"), F.col("compra"), F.col("codigo")
    )
    return doc.withColumn("descripcion", described).select(
        _number("id_producto", "bigint").alias("id_producto"),
        "nombre",
        *[F.coalesce(name, blank).alias(name) for name in texts],
        F.coalesce(_number("compra", "decimal(12,2)"), F.lit(0)).cast("decimal(12,2)").alias("compra"),
        _number("precio", "decimal(12,2)").alias("precio"),
        _number("stock", "int").alias("stock"),
        "descripcion",
    )


def _number(column: str | Column, dtype: str) -> Column:
    return F.trim(column).try_cast(dtype)
