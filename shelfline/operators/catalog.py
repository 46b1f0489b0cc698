"""Catalogue, inventory lists and product searches."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.product import description_fields, or_missing, product_code, stock_flag
from shelfline.functions.text import contains_lower, or_default, two_decimals
from shelfline.schema import LOW_STOCK


def _with_attributes(df: DataFrame) -> DataFrame:
    """Adds the struct of description fields that the display columns come from."""
    return df.withColumn("_desc", description_fields("descripcion"))


def _display_attributes() -> dict[str, Column]:
    return {
        "codigo": product_code("id_producto", F.col("_desc.codigo")),
        "marca_repuesto": or_missing(F.col("_desc.marca_repuesto")),
        "marca_carro": or_missing(F.col("_desc.marca_vehiculo")),
        "transmision": or_missing(F.col("_desc.transmision")),
    }


def catalog(producto: DataFrame) -> DataFrame:
    """Products in stock; code, brands and gearbox as the description states them."""
    in_stock = _with_attributes(producto.filter(F.col("stock_actual") > 0))
    return in_stock.withColumns(_display_attributes()).drop("_desc")


def inventory(producto: DataFrame) -> DataFrame:
    """Every product with its purchase price, newest first."""
    base = _with_attributes(
        producto.select("id_producto", "nombre_producto", "descripcion", "precio", "stock_actual")
    )
    cost = F.coalesce(F.col("_desc.precio_compra"), F.lit("0"))
    return (
        base.withColumns({**_display_attributes(), "compra": cost})
        .drop("_desc")
        .orderBy(F.desc("id_producto"))
    )


def facet_search(
    producto: DataFrame,
    name: str = "",
    brand: str = "",
    car: str = "",
    model: str = "",
    transmission: str = "",
    year: str = "",
) -> DataFrame:
    """Catalogue rows meeting every facet given; an empty facet does not restrict.

    Brand and vehicle are the catalogue's; transmission and year are the
    product's own columns.
    """
    shown_brand = or_default(or_missing(F.col("_desc.marca_repuesto")), "Genérica")
    shown_car = or_default(or_missing(F.col("_desc.marca_vehiculo")), "Universal")
    facets = [
        (name, contains_lower("nombre_producto", name)),
        (brand, F.col("marca") == brand),
        (car, F.col("modelo") == car),
        (model, contains_lower("modelo", model)),
        (transmission, F.col("transmision") == transmission),
        (year, F.col("ano") == year),
    ]
    wanted = reduce(and_, [test for value, test in facets if value], F.lit(True))
    return (
        _with_attributes(producto.filter(F.col("stock_actual") > 0))
        .select(
            "id_producto",
            _display_attributes()["codigo"].alias("codigo"),
            "nombre_producto",
            shown_brand.alias("marca"),
            shown_car.alias("modelo"),
            "transmision",
            "ano",
            "precio",
            "stock_actual",
        )
        .filter(wanted)
    )


def stock_search(listed: DataFrame, term: str = "", low_only: bool = False) -> DataFrame:
    """Inventory rows whose joined name, brand, car and code contain the term.

    The fields are joined by blanks, so a term may run from one into the next.
    """
    board_text = F.lower(
        F.concat_ws(" ", "nombre_producto", "marca_repuesto", "marca_carro", "codigo")
    )
    found = listed.filter(F.contains(board_text, F.lit(term.lower())))
    return found.filter(F.coalesce("stock_actual", F.lit(0)) < LOW_STOCK) if low_only else found


def any_field_search(listed: DataFrame, term: str) -> DataFrame:
    """Inventory rows with the term inside the code, name, brand or car."""
    fields = ("codigo", "nombre_producto", "marca_repuesto", "marca_carro")
    return listed.filter(reduce(or_, [contains_lower(field, term) for field in fields]))


def inventory_report(
    producto: DataFrame, kind: str = "inventario", brand: str | None = None
) -> DataFrame:
    """Stock and line value, lowest stock first; ``kind="bajo-stock"`` keeps low stock only.

    A product without a brand never matches a brand filter.
    """
    if kind not in ("inventario", "bajo-stock"):
        raise ValueError(f"unknown report {kind!r}")
    rows = producto
    if kind == "bajo-stock":
        rows = rows.filter(F.col("stock_actual") < LOW_STOCK)
    if brand:
        rows = rows.filter(contains_lower("marca_repuesto", brand))
    return rows.select(
        "id_producto",
        "nombre_producto",
        F.col("marca_repuesto").alias("marca"),
        "stock_actual",
        "precio",
        stock_flag("stock_actual").alias("nivel"),
        (F.col("precio") * F.col("stock_actual")).cast("decimal(22,2)").alias("valor"),
    ).orderBy("stock_actual", "id_producto")


def inventory_stats(producto: DataFrame) -> DataFrame:
    """Critical products, stock value and product count in one pass."""
    value = (F.col("precio") * F.col("stock_actual")).cast("decimal(22,2)")
    return producto.agg(
        F.count_if(F.col("stock_actual") < LOW_STOCK).alias("critico"),
        F.coalesce(F.sum(value), F.lit(0)).alias("valor_inventario"),
        F.count(F.lit(1)).alias("total_productos"),
    ).withColumn("valor_texto", two_decimals("valor_inventario"))


def stock_by_category(producto: DataFrame, categoria: DataFrame, n: int = 5) -> DataFrame:
    """The categories with most stock; products without a category form one group."""
    sums = producto.groupBy("id_categoria").agg(
        F.sum(F.col("stock_actual").cast("long")).alias("cantidad")
    )
    return (
        sums.join(categoria.select("id_categoria", "nombre_categoria"), "id_categoria", "left")
        .orderBy(F.desc("cantidad"), "id_categoria")
        .limit(n)
        .select("id_categoria", F.col("nombre_categoria").alias("marca"), "cantidad")
    )
