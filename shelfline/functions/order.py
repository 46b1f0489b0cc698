"""Rules of a single order row: status names and line amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfline.schema import MONEY

# Names a status change may use for a stored status.
STATUS_SYNONYMS = {"En Proceso": "Aprobada", "Completada": "Entregada"}

# Display class of a stored status, where it is not the status itself.
STATUS_CLASSES = {"aprobada": "proceso", "entregada": "completada"}

# Changes the order page offers.
PAGE_TRANSITIONS = (
    ("Pendiente", "Aprobada"),
    ("Pendiente", "Rechazada"),
    ("Aprobada", "Entregada"),
)


def _renamed(column: Column, names: dict[str, str]) -> Column:
    pairs = [F.lit(text) for pair in names.items() for text in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), column), column)


def stored_status(column: str | Column) -> Column:
    return _renamed(F.col(column) if isinstance(column, str) else column, STATUS_SYNONYMS)


def status_class(column: str | Column) -> Column:
    return _renamed(F.replace(F.lower(column), F.lit(" "), F.lit("")), STATUS_CLASSES)


def line_amount(quantity: str = "cantidad", price: str = "precio_unitario") -> Column:
    return (F.col(quantity) * F.col(price)).cast(MONEY)
