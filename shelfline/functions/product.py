"""Rules of a single product row: description attributes, code, stock level."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfline.schema import LOW_STOCK

MISSING = "N/A"

# Keys of the JSON object kept in the description.
DESCRIPTION_SCHEMA = (
    "marca_repuesto string, marca_vehiculo string, transmision string, "
    "precio_compra string, codigo string"
)

# Texts of a JSON code that count as no code.
EMPTY_CODES = ("", "0", "false", "[]", "{}")


def description_fields(description: str | Column) -> Column:
    """The description's JSON object as a struct, NULL fields where it is none.

    Text that does not end with the closing brace is no JSON object; the JSON
    reader alone would accept an object followed by other text.
    """
    whole_object = F.rlike(description, F.lit(r"(?s)\A\s*\{.*\}\s*\z"))
    return F.from_json(
        F.when(whole_object, description if isinstance(description, Column) else F.col(description)),
        DESCRIPTION_SCHEMA,
        {"allowSingleQuotes": "false"},
    )


def product_code(id_producto: str | Column, code: Column) -> Column:
    """The code, or ``PROD-<id>`` where it is missing or empty."""
    fallback = F.concat(F.lit("PROD-"), F.col(id_producto) if isinstance(id_producto, str) else id_producto)
    return F.when(F.coalesce(code, F.lit("")).isin(*EMPTY_CODES), fallback).otherwise(code)


def or_missing(column: Column) -> Column:
    return F.coalesce(column, F.lit(MISSING))


def stock_flag(stock: str | Column) -> Column:
    column = F.col(stock) if isinstance(stock, str) else stock
    return F.when(column < LOW_STOCK, "stock-alert").otherwise("stock-ok")


def description_json(brand: Column, car: Column, gearbox: Column, cost: Column, code: Column) -> Column:
    """The JSON text stored as description; missing parts become empty or 0."""
    blank = F.lit("")
    return F.to_json(
        F.struct(
            F.coalesce(brand, blank).alias("marca_repuesto"),
            F.coalesce(car, blank).alias("marca_vehiculo"),
            F.coalesce(gearbox, blank).alias("transmision"),
            F.coalesce(cost.cast("string"), F.lit("0")).alias("precio_compra"),
            F.coalesce(code, blank).alias("codigo"),
        )
    )
