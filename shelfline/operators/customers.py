"""Customer directory, purchase history, lookups by document number."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.functions.text import key, matches, or_default
from shelfline.operators.orders import Tables


def customer_directory(t: Tables, term: str = "", mode: str = "literal") -> DataFrame:
    """Customers whose name, document or phone contains the term, with user mail.

    A person with two users appears twice, as in a plain left join.
    """
    people = t["persona"]
    if term:
        fields = ("nombre", "cedula", "telefono")
        people = people.filter(reduce(or_, [matches(field, term, mode) for field in fields]))
    return (
        t["cliente"]
        .join(people, "id_persona")
        .join(t["usuario"].select("id_persona", "correo"), "id_persona", "left")
        .select(
            "id_cliente", "nombre", "telefono", or_default("correo", "N/A").alias("correo"), "direccion"
        )
    )


def customer_history(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Purchased lines of the customers in ``ids`` or of all, newest first."""
    orders = t["solicitud"].select("id_solicitud", "id_cliente", "fecha_solicitud", "estado")
    if ids is not None:
        orders = orders.join(ids, "id_cliente", "left_semi")
    lines = t["detalle_solicitud"].select("id_solicitud", "id_producto", "cantidad", "subtotal")
    return (
        lines.join(orders, "id_solicitud")
        .join(t["producto"].select("id_producto", "nombre_producto", "marca_carro"), "id_producto")
        .select(
            "id_cliente",
            "id_solicitud",
            "fecha_solicitud",
            F.col("nombre_producto").alias("producto"),
            F.col("marca_carro").alias("carro"),
            "cantidad",
            F.col("subtotal").alias("total"),
            "estado",
        )
        .orderBy(F.desc("fecha_solicitud"), "id_solicitud", "producto", "cantidad", "total")
    )


def lookup_customers(keys: DataFrame, persona: DataFrame) -> DataFrame:
    """For each document number: whether a person has it, and the name."""
    known = persona.select(key("cedula").alias("_key"), F.col("nombre"))
    wanted = keys.select("cedula", key("cedula").alias("_key"))
    return wanted.join(known, "_key", "left").select(
        "cedula", F.col("nombre").isNotNull().alias("existe"), "nombre"
    )


def split_known(keys: DataFrame, persona: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of known document numbers, rows of new ones)."""
    known = persona.select(key("cedula").alias("_key"))
    same = key(keys["cedula"]) == known["_key"]
    return keys.join(known, same, "left_semi"), keys.join(known, same, "left_anti")
