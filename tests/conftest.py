from __future__ import annotations

import sys
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from shelfline.schema import SCHEMAS  # noqa: E402
from shelfline.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("shelfline-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    )
    session = configure(builder).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def split(spark):
    """Small tables keep all their partitions, so that running values cross blocks."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def money(text: str | None) -> Decimal | None:
    return None if text is None else Decimal(text)


# The shop's seed rows that the hand-computed answers rest on.
# Document numbers, phones, mails and hashes are invented.
SEED = {
    "categoria": [
        (1, "Motor", None),
        (2, "Frenos", None),
        (3, "Suspensión", None),
        (4, "Eléctrico", None),
        (5, "Filtros", None),
    ],
    "persona": [
        (1, "100", "Administrador Principal", "Oficina", "0400000001"),
        (2, "200", "Santiago Perez", "Los Teques", "0400000002"),
        (3, "300", "Empleado", None, None),
        (4, "400", "Maria Garcia", "Los Teques", "0400000004"),
        (5, "500", "Moises Perez", "Los Teques", "0400000005"),
        (6, "600", "Santiago Perez", None, None),
        (7, "700", "Reina Garcia", None, None),
        (8, "800", "Pedro", "ezequiel zamora", "0400000008"),
    ],
    "cliente": [(1, 4), (2, 5), (3, 6), (4, 7), (5, 8)],
    "usuario": [
        (1, "jefe@example.org", "hash-1", "Administrador", datetime(2026, 4, 13, 13, 53, 26), 1),
        (2, "ayuda@example.org", "hash-2", "Empleado", datetime(2026, 4, 13, 13, 54, 34), 3),
    ],
    "empleado": [(1, "Operador", 2)],
    "producto": [
        (1, "PROD-01", "Amortiguador delantero", None, money("95.00"), 24, "Monroe", "Toyota", None, None, "a.jpg", 3),
        (2, "PROD-02", "Batería 12V", None, money("120.00"), 12, "Bosch", "Universal", None, None, "b.jpg", 4),
        (3, "PROD-03", "Filtro de aceite", None, money("6.75"), 199, "ACDelco", "Universal", None, None, "f.jpg", 5),
        (4, "PROD-04", "Pastillas de freno", None, money("35.00"), 60, "Bosch", "Ford", None, None, "p.jpg", 2),
        (5, "PROD-05", "Bieleta", None, money("32.00"), 10, "MHW", "Chevrolet", None, None, "c.jpg", 3),
    ],
    "solicitud": [
        (1, datetime(2026, 4, 13, 16, 11, 49), "Rechazada", money("253.50"), 1),
        (2, datetime(2026, 4, 13, 16, 12, 30), "Entregada", money("430.00"), 2),
        (3, datetime(2026, 4, 13, 16, 13, 27), "Rechazada", money("70.00"), 3),
        (4, datetime(2026, 4, 13, 16, 27, 45), "Rechazada", money("13.50"), 4),
        (5, datetime(2026, 4, 13, 16, 30, 17), "Rechazada", money("64.00"), 5),
    ],
    "detalle_solicitud": [
        (1, 1, 3, 1, money("6.75"), money("6.75")),
        (2, 1, 2, 1, money("120.00"), money("120.00")),
        (3, 2, 2, 1, money("120.00"), money("120.00")),
        (4, 2, 1, 1, money("95.00"), money("95.00")),
        (5, 3, 4, 1, money("35.00"), money("35.00")),
        (6, 4, 3, 1, money("6.75"), money("6.75")),
        (7, 5, 5, 1, money("32.00"), money("32.00")),
    ],
}


@pytest.fixture(scope="session")
def seed(spark):
    return {name: spark.createDataFrame(rows, SCHEMAS[name]) for name, rows in SEED.items()}


@pytest.fixture
def table(spark):
    """Rows as a table of the model: table("producto", {...}, {...})."""

    def build(name: str, *rows: dict):
        schema = SCHEMAS[name]
        return spark.createDataFrame([tuple(row.get(f.name) for f in schema.fields) for row in rows], schema)

    return build


def rows(df, *columns: str) -> list[tuple]:
    return [tuple(row) for row in (df.select(*columns) if columns else df).collect()]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
