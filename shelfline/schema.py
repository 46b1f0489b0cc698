"""Table schemas of the retail model and the Parquet / JDBC table source.

Column names are those of the data model, so existing tables load unchanged.
Ids are 64 bit, quantities 32 bit, money is ``decimal(12,2)`` and timestamps
carry no time zone.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)

_ID = T.LongType()
_TEXT = T.StringType()
_QTY = T.IntegerType()
_TIME = T.TimestampNTZType()


def _table(*columns: tuple) -> T.StructType:
    """(name, type) is a nullable column, (name, type, False) a required one."""
    return T.StructType([T.StructField(*column) for column in columns])


SCHEMAS: dict[str, T.StructType] = {
    "categoria": _table(
        ("id_categoria", _ID, False),
        ("nombre_categoria", _TEXT, False),
        ("descripcion", _TEXT),
    ),
    "persona": _table(
        ("id_persona", _ID, False),
        ("cedula", _TEXT, False),
        ("nombre", _TEXT, False),
        ("direccion", _TEXT),
        ("telefono", _TEXT),
    ),
    "cliente": _table(("id_cliente", _ID, False), ("id_persona", _ID)),
    "usuario": _table(
        ("id_usuario", _ID, False),
        ("correo", _TEXT, False),
        ("contraseña", _TEXT, False),
        ("rol", _TEXT, False),
        ("fecha_registro", _TIME, False),
        ("id_persona", _ID, False),
    ),
    "empleado": _table(("id_empleado", _ID, False), ("cargo", _TEXT), ("id_usuario", _ID)),
    "producto": _table(
        ("id_producto", _ID, False),
        ("codigo", _TEXT, False),
        ("nombre_producto", _TEXT, False),
        ("descripcion", _TEXT),
        ("precio", MONEY, False),
        ("stock_actual", _QTY),
        ("marca_repuesto", _TEXT),
        ("marca_carro", _TEXT),
        ("ano", _TEXT),
        ("transmision", _TEXT),
        ("imagen", _TEXT),
        ("id_categoria", _ID),
    ),
    "solicitud": _table(
        ("id_solicitud", _ID, False),
        ("fecha_solicitud", _TIME, False),
        ("estado", _TEXT),
        ("total", MONEY),
        ("id_cliente", _ID),
    ),
    "detalle_solicitud": _table(
        ("id_detalle", _ID, False),
        ("id_solicitud", _ID),
        ("id_producto", _ID),
        ("cantidad", _QTY, False),
        ("precio_unitario", MONEY, False),
        ("subtotal", MONEY),
    ),
}

# Columns added to the user table after its first release.
RECOVERY_COLUMNS: dict[str, T.DataType] = {
    "codigo_recuperacion": _TEXT,
    "expiracion_codigo": _TIME,
}

# Fixed values of the data model.
ORDER_STATES = ("Pendiente", "Aprobada", "Rechazada", "Entregada")
USER_ROLES = ("Administrador", "Empleado", "Cliente")
LOW_STOCK = 5

PRIMARY_KEYS = {
    "categoria": "id_categoria",
    "persona": "id_persona",
    "cliente": "id_cliente",
    "usuario": "id_usuario",
    "empleado": "id_empleado",
    "producto": "id_producto",
    "solicitud": "id_solicitud",
    "detalle_solicitud": "id_detalle",
}

UNIQUE_KEYS = {
    "persona": "cedula",
    "cliente": "id_persona",
    "usuario": "correo",
    "empleado": "id_usuario",
    "producto": "codigo",
}

# What happens to a row whose parent is removed.
CASCADE, SET_NULL = "CASCADE", "SET NULL"


class ForeignKey(NamedTuple):
    child: str
    column: str
    parent: str
    on_delete: str = CASCADE


FOREIGN_KEYS = (
    ForeignKey("cliente", "id_persona", "persona"),
    ForeignKey("detalle_solicitud", "id_solicitud", "solicitud"),
    ForeignKey("detalle_solicitud", "id_producto", "producto"),
    ForeignKey("empleado", "id_usuario", "usuario"),
    ForeignKey("producto", "id_categoria", "categoria", SET_NULL),
    ForeignKey("solicitud", "id_cliente", "cliente"),
    ForeignKey("usuario", "id_persona", "persona"),
)

# Columns that hold one of a list of values.
DOMAINS = {("solicitud", "estado"): ORDER_STATES, ("usuario", "rol"): USER_ROLES}


def load_tables(
    spark: SparkSession, directory: str, names: Iterable[str] | None = None
) -> dict[str, DataFrame]:
    """Lazy DataFrames over ``<directory>/<table>`` Parquet, one per table."""
    return {
        name: spark.read.schema(SCHEMAS[name]).parquet(f"{directory}/{name}")
        for name in (names or SCHEMAS)
    }


def load_versions(spark: SparkSession, path: str, name: str, added: dict[str, T.DataType]) -> DataFrame:
    """One table from files written before and after columns were ``added``; rows written before have NULL there.

    The files' own schemas are merged, so any mixture of both will do, and none at all with the new columns.
    """
    schema = T.StructType(SCHEMAS[name].fields + [T.StructField(c, dtype) for c, dtype in added.items()])
    rows = spark.read.option("mergeSchema", True).parquet(path)
    return conform(ensure_columns(rows, added), schema)


def load_jdbc_table(
    spark: SparkSession, url: str, name: str, partitions: int, **options: str
) -> DataFrame:
    """One table from a database, read as ``partitions`` primary-key ranges.

    The key range is asked from the database first, so that every executor reads
    its own slice and no row goes through one connection alone.
    """
    key = PRIMARY_KEYS[name]
    reader = spark.read.format("jdbc").options(url=url, **options)
    low, high = (
        reader.option("query", f"SELECT MIN({key}) AS low, MAX({key}) AS high FROM {name}")
        .load()
        .first()
    )
    source = reader.option("dbtable", name)
    if low is not None and partitions > 1:
        source = source.options(
            partitionColumn=key,
            lowerBound=str(low),
            upperBound=str(high + 1),
            numPartitions=str(partitions),
        )
    return conform(source.load(), SCHEMAS[name])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns, cast to its types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def ensure_columns(df: DataFrame, columns: dict[str, T.DataType]) -> DataFrame:
    """Add the missing columns as NULL; columns already there stay as they are."""
    missing = {
        name: F.lit(None).cast(dtype) for name, dtype in columns.items() if name not in df.columns
    }
    return df.withColumns(missing) if missing else df
