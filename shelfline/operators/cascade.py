"""Removal of rows with all that hangs on them, by the model's list of foreign keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.operators.orders import Tables
from shelfline.operators.quality import orphans
from shelfline.schema import CASCADE, FOREIGN_KEYS, PRIMARY_KEYS, ForeignKey


def reached(table: str) -> list[tuple[str, list[ForeignKey]]]:
    """The tables that a removal from ``table`` touches, parents first, each with the keys that touch it.

    Rows go along by CASCADE keys only; a SET NULL key touches its own table and goes no further.
    """
    going = {table}
    while more := {k.child for k in FOREIGN_KEYS if k.parent in going and k.on_delete == CASCADE} - going:
        going |= more
    touching = {}
    for key in FOREIGN_KEYS:
        if key.parent in going:
            touching.setdefault(key.child, []).append(key)
    touching.pop(table, None)
    found, done = [], {table}
    while touching:
        ready = [c for c, keys in touching.items() if {k.parent for k in keys if k.parent in going} <= done]
        if not ready:
            raise ValueError(f"the keys from {table} run in a circle: {sorted(touching)}")
        for child in sorted(ready):
            found.append((child, touching.pop(child)))
            done.add(child)
    return found


def remove_rows(table: str, ids: DataFrame, t: Tables) -> dict[str, DataFrame]:
    """The tables that removing the rows ``ids`` (the primary key) from ``table`` changes, as they are afterwards.

    Each table meets the keys that are gone from its parents in semi and anti joins; only keys are carried from
    table to table.
    """
    key = PRIMARY_KEYS[table]
    gone = {table: ids.select(F.col(key).alias("_gone")).distinct()}
    after = {table: t[table].join(gone[table], F.col(key) == F.col("_gone"), "left_anti")}
    for child, keys in reached(table):
        left, lost = t[child], []
        for fk in keys:
            met = F.col(fk.column) == F.col("_gone")
            if fk.on_delete == CASCADE:
                left = left.join(gone[fk.parent], met, "left_anti")
                lost.append(t[child].join(gone[fk.parent], met, "left_semi"))
            else:
                nulled = F.when(F.col("_gone").isNull(), F.col(fk.column)).alias(fk.column)
                left = left.join(gone[fk.parent], met, "left").select(*[nulled if c == fk.column else c for c in t[child].columns])
        after[child] = left
        if lost and any(k.parent == child for k in FOREIGN_KEYS):
            gone[child] = reduce(DataFrame.unionByName, [rows.select(F.col(PRIMARY_KEYS[child]).alias("_gone")) for rows in lost]).distinct()
    return after


def foreign_key_orphans(t: Tables) -> DataFrame:
    """(tabla, columna, referencia, huerfanas): rows without a parent, for every foreign key of the model."""
    counts = [
        orphans(t[k.child], k.column, t[k.parent], PRIMARY_KEYS[k.parent])
        .agg(F.count(F.lit(1)).alias("huerfanas"))
        .select(F.lit(k.child).alias("tabla"), F.lit(k.column).alias("columna"), F.lit(k.parent).alias("referencia"), "huerfanas")
        for k in FOREIGN_KEYS
    ]
    return reduce(DataFrame.unionByName, counts)
