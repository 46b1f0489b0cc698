"""Changes of stock and catalogue, and the ledger of stock movements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.product import description_json
from shelfline.operators.allocation import change_stock
from shelfline.operators.cascade import remove_rows
from shelfline.operators.orders import Tables
from shelfline.operators.running import highest, number_rows, running
from shelfline.schema import LOW_STOCK, MONEY


def apply_receipts(feed: DataFrame, producto: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(products, booked receipts, rejected receipts).

    A quantity must be a whole number above 0; a receipt of an unknown product
    changes nothing and is reported as rejected.
    """
    checked = feed.withColumn("_qty", F.trim(F.col("cantidad").cast("string")).try_cast("int")).join(
        producto.select("id_producto", F.lit(True).alias("_known")), "id_producto", "left"
    )
    reason = (
        F.when(F.col("id_producto").isNull() | F.col("cantidad").isNull(), "datos")
        .when(F.coalesce(F.col("_qty") <= 0, F.lit(True)), "cantidad")
        .when(F.col("_known").isNull(), "producto")
    )
    marked = checked.withColumn("motivo", reason)
    booked = marked.filter("motivo IS NULL").withColumn("cantidad", F.col("_qty"))
    sums = booked.groupBy("id_producto").agg(F.sum(F.col("cantidad").cast("long")).alias("cambio"))
    return (
        change_stock(producto, sums),
        booked.select(*feed.columns),
        marked.filter("motivo IS NOT NULL").select(*feed.columns, "motivo"),
    )


def cancel_orders(ids: DataFrame, t: Tables) -> dict[str, DataFrame]:
    """Delete orders with their lines; unless rejected, their stock comes back."""
    wanted = ids.select("id_solicitud").distinct()
    returning = t["solicitud"].filter(~F.col("estado").eqNullSafe("Rechazada")).join(
        wanted, "id_solicitud", "left_semi"
    )
    returned = (
        t["detalle_solicitud"]
        .join(returning.select("id_solicitud"), "id_solicitud", "left_semi")
        .groupBy("id_producto")
        .agg(F.sum(F.col("cantidad").cast("long")).alias("cambio"))
    )
    return {"producto": change_stock(t["producto"], returned), **remove_rows("solicitud", wanted, t)}


def product_text() -> Column:
    """The description that a row of a product feed is stored under."""
    return description_json(F.col("marca_repuesto"), F.col("marca_carro"), F.col("transmision"), F.col("compra"), F.col("codigo"))


def upsert_products(feed: DataFrame, producto: DataFrame) -> DataFrame:
    """New products appended, known ones changed in name, description and price.

    ``feed`` has id_producto (NULL for a new product), codigo, nombre,
    marca_repuesto, marca_carro, transmision, compra, precio, stock, seq, the
    sequence number of the row, and may have imagen, kept for new products. The last change of a product wins. A change of an
    unknown product does nothing. New products number on from the highest id.
    """
    rows = feed.withColumns({"_text": product_text(), "_price": F.col("precio").cast(MONEY)})
    changes = (
        rows.filter(F.col("id_producto").isNotNull())
        .groupBy("id_producto")
        .agg(F.max_by(F.struct("nombre", "_text", "_price"), "seq").alias("_new"))
    )
    changed = producto.join(changes, "id_producto", "left")
    given = F.col("_new").isNotNull()
    replaced = {
        "nombre_producto": F.when(given, F.col("_new.nombre")).otherwise(F.col("nombre_producto")),
        "descripcion": F.when(given, F.col("_new._text")).otherwise(F.col("descripcion")),
        "precio": F.when(given, F.col("_new._price")).otherwise(F.col("precio")),
    }
    return (
        changed.withColumns(replaced)
        .select(producto.columns)
        .unionByName(new_products(feed, producto), allowMissingColumns=True)
    )


def new_products(feed: DataFrame, producto: DataFrame) -> DataFrame:
    """The products that the rows of ``feed`` without an id add, numbered on from the highest id in ``seq`` sequence."""
    rows = feed.withColumns({"_text": product_text(), "_price": F.col("precio").cast(MONEY)})
    new = rows.filter(F.col("id_producto").isNull()).drop("id_producto")
    fresh = number_rows(new, ["seq"], "id_producto", highest(producto, "id_producto"))
    code = F.coalesce(F.nullif(F.col("codigo"), F.lit("")), F.concat(F.lit("PROD-"), F.col("id_producto")))
    return fresh.select(
        "id_producto",
        code.alias("codigo"),
        F.col("nombre").alias("nombre_producto"),
        F.col("_text").alias("descripcion"),
        F.col("_price").alias("precio"),
        F.col("stock").cast("int").alias("stock_actual"),
        *([F.col("imagen")] if "imagen" in feed.columns else []),
    )

def delete_products(ids: DataFrame, t: Tables) -> dict[str, DataFrame]:
    """Delete products and their order lines; order totals stay as they are."""
    return remove_rows("producto", ids, t)


def remove_categories(ids: DataFrame, t: Tables) -> dict[str, DataFrame]:
    """Delete categories; their products stay, without a category."""
    return remove_rows("categoria", ids, t)


def movements(sales: DataFrame, receipts: DataFrame, returns: DataFrame) -> DataFrame:
    """Sales as outflows, receipts and returns as inflows, in one table.

    Each input has id_producto, ts, ref (the row that caused it) and cantidad.
    """
    parts = ((sales, "venta", -1), (receipts, "recepcion", 1), (returns, "devolucion", 1))
    frames = [
        df.select(
            "id_producto",
            "ts",
            F.lit(kind).alias("tipo"),
            "ref",
            (F.col("cantidad").cast("long") * sign).alias("cantidad"),
        )
        for df, kind, sign in parts
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def stock_ledger(moves: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """Movements with the balance after each, from ``opening`` (default 0).

    The sequence is (ts, tipo, ref). Movements of one product with the same
    sequence key are one movement.
    """
    known = moves.filter(F.col("id_producto").isNotNull())
    merged = known.groupBy("id_producto", "ts", "tipo", "ref").agg(F.sum("cantidad").alias("cantidad"))
    ledger = running(merged, ["id_producto"], ["ts", "tipo", "ref"], {"saldo": ("sum", "cantidad")})
    if opening is None:
        return ledger
    start = opening.select("id_producto", F.col("stock_actual").cast("long").alias("_start"))
    return (
        ledger.join(start, "id_producto", "left")
        .withColumn("saldo", F.col("saldo") + F.coalesce("_start", F.lit(0)))
        .drop("_start")
    )


def low_stock_crossings(ledger: DataFrame) -> DataFrame:
    """Movements that take a product from enough stock to low stock."""
    before = F.col("saldo") - F.col("cantidad")
    return ledger.filter((before >= LOW_STOCK) & (F.col("saldo") < LOW_STOCK))
