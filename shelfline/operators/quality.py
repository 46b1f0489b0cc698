"""Checks of the model's constraints over whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions.text import is_digits, key, trimmed
from shelfline.schema import DOMAINS, FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS, UNIQUE_KEYS

PHONE_DIGITS = 15


def unique_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, text compared as a natural key.

    A key with a NULL part is never a violation. One spelling stands for all.
    """
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    compared = {f"_key_{c}": key(c) if c in texts else F.col(c) for c in columns}
    return (
        df.select(*columns)
        .na.drop(subset=list(columns))
        .withColumns(compared)
        .groupBy(*compared)
        .agg(*[F.min(c).alias(c) for c in columns], F.count(F.lit(1)).alias("veces"))
        .filter(F.col("veces") > 1)
        .select(*columns, "veces")
    )


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent row; NULL keys are allowed."""
    parents = parent.select(F.col(parent_key).alias("_parent"))
    return child.filter(F.col(column).isNotNull()).join(
        parents, F.col(column) == F.col("_parent"), "left_anti"
    )


def reconcile_totals(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders whose total is not the sum of their lines, with difference and ratio."""
    sums = lines.groupBy("id_solicitud").agg(F.sum("subtotal").alias("_sum"))
    both = headers.select("id_solicitud", "total").join(sums, "id_solicitud", "left").select(
        "id_solicitud", "total", F.coalesce("_sum", F.lit(0)).cast("decimal(22,2)").alias("suma_lineas")
    )
    ratio = F.col("total").cast("double") / F.nullif(F.col("suma_lineas").cast("double"), F.lit(0.0))
    return both.filter(~F.col("total").eqNullSafe(F.col("suma_lineas"))).select(
        "id_solicitud",
        "total",
        "suma_lineas",
        (F.col("total") - F.col("suma_lineas")).alias("diferencia"),
        F.round(ratio, 4).alias("razon"),
    )


def null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and NULLs of each required column, as (columna, filas, nulos)."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    return counts.unpivot("_rows", list(columns), "columna", "nulos").select(
        "columna", F.col("_rows").alias("filas"), "nulos"
    )


def domain_violations(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose value is outside the list; NULL is allowed."""
    return df.filter(~F.col(column).isin(*values))


CHECKED = "tabla string, regla string, columna string, filas long, fallos long"


def _row_rules(name: str, columns: Sequence[str]) -> list[tuple[str, str, Column]]:
    """(rule, column, whether a row breaks it) for the rules that a row alone can break."""
    required = [("nulo", f.name, F.col(f.name).isNull()) for f in SCHEMAS[name].fields if not f.nullable and f.name in columns]
    lists = [("dominio", c, ~F.col(c).isin(*values)) for (table, c), values in DOMAINS.items() if table == name and c in columns]
    return required + lists


def write_checked(df: DataFrame, name: str, path: str) -> list[tuple[str, str, str, int, int]]:
    """Write a table; its rows, and those that break each NULL and list rule, counted on the way by the same scan."""
    rules = _row_rules(name, df.columns)
    seen = Observation()
    counts = [F.count_if(broken).alias(f"_{i}") for i, (*_, broken) in enumerate(rules)]
    df.observe(seen, F.count(F.lit(1)).alias("_rows"), *counts).write.parquet(path)
    found = seen.get
    return [(name, rule, column, found["_rows"], found[f"_{i}"]) for i, (rule, column, _) in enumerate(rules)]


def check_tables(t: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """CHECKED: a row per rule of the model, with the rows of its table and those that break it.

    Every table is written to ``folder``, counting what single rows can tell; unique keys and references are then
    counted on the written columns. Text keys are compared as natural keys; NULL is no key.
    """
    spark = next(iter(t.values())).sparkSession
    rows, sizes, kept = [], {}, {}
    for name, df in t.items():
        path = f"{folder}/{name}"
        rows += (own := write_checked(df, name, path))
        kept[name] = spark.read.schema(df.schema).parquet(path)
        sizes[name] = own[0][3]
    several = []
    for name, df in kept.items():
        for column in dict.fromkeys(c for c in (PRIMARY_KEYS[name], UNIQUE_KEYS.get(name)) if c in df.columns):
            broken = unique_violations(df, [column]).agg(F.coalesce(F.sum("veces"), F.lit(0)).alias("fallos"))
            several.append(broken.select(F.lit(name), F.lit("unico"), F.lit(column), F.lit(sizes[name]).cast("long"), "fallos"))
    for fk in FOREIGN_KEYS:
        if fk.child in kept and fk.parent in kept:
            broken = orphans(kept[fk.child], fk.column, kept[fk.parent], PRIMARY_KEYS[fk.parent]).agg(F.count(F.lit(1)).alias("fallos"))
            several.append(broken.select(F.lit(fk.child), F.lit("referencia"), F.lit(fk.column), F.lit(sizes[fk.child]).cast("long"), "fallos"))
    return reduce(DataFrame.union, several, spark.createDataFrame(rows, CHECKED))


def _failed(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row fails, in the order given."""
    marks = [F.when(~F.coalesce(passed, F.lit(False)), F.lit(name)) for name, passed in rules.items()]
    return F.filter(F.array(*marks), lambda mark: mark.isNotNull())


def order_rules() -> dict[str, Column]:
    phone = F.regexp_replace(trimmed("telefono"), "[- ]", "")
    quantity = trimmed(F.col("cantidad").cast("string")).try_cast("int")
    return {
        "cedula": is_digits(trimmed("cedula")),
        "nombre": F.length(trimmed("nombre")) > 0,
        "telefono": F.col("telefono").isNull()
        | (phone == "")
        | (is_digits(phone) & (F.length(phone) <= PHONE_DIGITS)),
        "producto": F.col("id_producto").isNotNull(),
        "cantidad": quantity >= 1,
        "pedido": F.col("id_solicitud").isNotNull(),
        "fecha": F.col("ts").isNotNull(),
        "precio": F.col("precio_unitario") >= 0,
    }


def product_rules() -> dict[str, Column]:
    """A new product needs every field; a change of one needs name and price."""
    new = F.col("id_producto").isNull()
    required = {
        name: ~new | (F.length(trimmed(name)) > 0) for name in ("codigo", "marca_repuesto", "marca_carro")
    }
    return {
        "nombre": F.length(trimmed("nombre")) > 0,
        "precio": F.col("precio").isNotNull(),
        **required,
        "compra": ~new | F.col("compra").isNotNull(),
        "stock": ~new | F.col("stock").isNotNull(),
    }


def check_orders(feed: DataFrame) -> DataFrame:
    """All rows with the names of the rules they fail in ``motivos``."""
    return feed.withColumn("motivos", _failed(order_rules()))


def check_products(feed: DataFrame) -> DataFrame:
    """All rows with the names of the rules they fail in ``motivos``."""
    return feed.withColumn("motivos", _failed(product_rules()))


def _split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    valid = F.size("motivos") == 0
    return checked.filter(valid).drop("motivos"), checked.filter(~valid)


def validate_orders(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with the names of the failed rules)."""
    return _split(check_orders(feed))


def validate_products(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with the names of the failed rules)."""
    return _split(check_products(feed))
