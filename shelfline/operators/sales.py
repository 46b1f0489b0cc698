"""Sales aggregates and rankings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.functions.product import or_missing
from shelfline.functions.text import month_label, thousands
from shelfline.operators.orders import Tables


def dashboard_metrics(t: Tables) -> DataFrame:
    """Product count, pending orders and delivered sales as one row.

    The two tables are summed apart and their rows put together without a join.
    """
    products = t["producto"].agg(F.count(F.lit(1)).alias("productos"))
    orders = t["solicitud"].agg(
        F.count_if(F.col("estado") == "Pendiente").alias("pendientes"),
        F.sum(F.when(F.col("estado") == "Entregada", F.col("total"))).alias("ventas"),
    )
    return products.unionByName(orders, allowMissingColumns=True).agg(
        F.max("productos").alias("productos"),
        F.max("pendientes").alias("pendientes"),
        F.coalesce(F.max("ventas"), F.lit(0)).alias("ventas"),
    ).withColumn("ventas_texto", thousands("ventas"))


def delivered_in_year(solicitud: DataFrame, year: int) -> DataFrame:
    """Delivered orders of one year, as a date range the scan can use."""
    start = F.lit(f"{year:04d}-01-01").cast("timestamp_ntz")
    end = F.lit(f"{year + 1:04d}-01-01").cast("timestamp_ntz")
    when = F.col("fecha_solicitud")
    return solicitud.filter((F.col("estado") == "Entregada") & (when >= start) & (when < end))


def monthly_sales(solicitud: DataFrame, as_of: date) -> DataFrame:
    """Delivered sales per month of the year of ``as_of``."""
    return (
        delivered_in_year(solicitud, as_of.year)
        .groupBy(F.month("fecha_solicitud").alias("mes"))
        .agg(F.sum("total").alias("ventas"))
        .select("mes", month_label("mes").alias("etiqueta"), "ventas")
        .orderBy("mes")
    )


def frequent_customers(t: Tables, n: int = 10) -> DataFrame:
    """Customers by spend: order count and sum, highest first.

    Orders are summed per customer before the joins, so names travel once per
    customer and a customer with very many orders is reduced before the shuffle.
    """
    spent = t["solicitud"].groupBy("id_cliente").agg(
        F.count("id_solicitud").alias("pedidos"), F.sum("total").alias("total_gastado")
    )
    return (
        spent.join(t["cliente"].select("id_cliente", "id_persona"), "id_cliente")
        .join(t["persona"].select("id_persona", "nombre"), "id_persona")
        .orderBy(F.desc("total_gastado"), "id_cliente")
        .limit(n)
        .select("id_cliente", "nombre", "pedidos", "total_gastado")
    )


def revenue_by_car(t: Tables) -> DataFrame:
    """Revenue per vehicle brand over all orders; no brand shows as N/A."""
    per_product = t["detalle_solicitud"].groupBy("id_producto").agg(F.sum("subtotal").alias("_sum"))
    return (
        per_product.join(t["producto"].select("id_producto", "marca_carro"), "id_producto")
        .groupBy("marca_carro")
        .agg(F.sum("_sum").cast("decimal(38,2)").alias("ingresos"))
        .select(or_missing(F.col("marca_carro")).alias("marca_carro"), "ingresos")
        .orderBy(F.desc("ingresos"), "marca_carro")
    )
