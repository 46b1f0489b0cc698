"""Running sums and maxima, and numbering, spread over tasks whatever the keys are.

Rows are range-partitioned by key and order into blocks and written once, which
fixes the block of each row. Every block is reduced to a row per key, the block
totals are accumulated, and a row adds its block's start to a window inside the
block. A key that holds most rows runs through many blocks. There is one way for
all sizes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.session import stage

_REDUCE = {"sum": F.sum, "max": F.max}
#: Name of the block column that ``blocked`` adds.
BLOCK = "_block"


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, tuple[str, str]],
    *,
    inclusive: bool = True,
) -> DataFrame:
    """``df`` with a running value per entry of ``totals``.

    ``totals`` maps a new column to ("sum" | "max", source column). ``order``
    must make a total order inside a key, up to rows equal in every used column.
    With ``inclusive=False`` the row itself is left out and the first row gets
    NULL.
    """
    return over_blocks(blocked(df, keys, order), keys, order, totals, inclusive=inclusive).drop(BLOCK)


def blocked(df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """``df`` written in blocks that follow each other by key and order, as many as Spark makes if ``blocks`` is not given."""
    # Range bounds come from a sample, so the block of a row is fixed by writing it down once.
    columns = [F.col(c) for c in [*keys, *order]]
    ranged = df.repartitionByRange(blocks, *columns) if blocks else df.repartitionByRange(*columns)
    return stage(ranged.withColumn(BLOCK, F.spark_partition_id()), "blocks")


def over_blocks(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, tuple[str, str]],
    *,
    inclusive: bool = True,
) -> DataFrame:
    """Running values over rows that ``blocked`` gave, or a part of them."""
    sums = rows.groupBy(*keys, BLOCK).agg(*[_REDUCE[how](col).alias(name) for name, (how, col) in totals.items()])
    before = _frame(keys, [BLOCK], inclusive=False)
    starts = [_REDUCE[how](name).over(before).alias(f"_start_{name}") for name, (how, _) in totals.items()]
    names = [f"_key_{i}" for i in range(len(keys))]
    # A block goes on with one key at most, so no more rows are left than there are blocks.
    carried = sums.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(BLOCK).alias("_of"), *starts)
    carried = carried.filter(reduce(Column.__or__, [F.col(f"_start_{name}").isNotNull() for name in totals]))
    frame = _frame([*keys, BLOCK], order, inclusive)
    inside = rows.withColumns({name: _REDUCE[how](col).over(frame) for name, (how, col) in totals.items()})
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    joined = inside.join(F.broadcast(carried), reduce(Column.__and__, same, F.col(BLOCK) == F.col("_of")), "left")
    return joined.withColumns(
        {name: _added(how, F.col(f"_start_{name}"), F.col(name)) for name, (how, _) in totals.items()}
    ).drop("_of", *names, *[f"_start_{name}" for name in totals])


def number_rows(df: DataFrame, order: Sequence[str], name: str, start: int) -> DataFrame:
    """Consecutive ids ``start + 1, start + 2, ...`` in the given order.

    Each block numbers its rows; only the blocks' sizes are added up in one place.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    ranged = stage(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = ranged.groupBy(part.alias(BLOCK)).agg(F.count(F.lit(1)).alias("_rows"))
    before = _frame([], [BLOCK], inclusive=False)
    starts = sizes.select(BLOCK, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    number = F.expr("_at & 8589934591") + F.col("_before") + F.lit(start + 1).cast("long")
    return ranged.withColumn(BLOCK, part).join(F.broadcast(starts), BLOCK).withColumn(name, number).drop(BLOCK, "_at", "_before")


def number_each(df: DataFrame, order: Sequence[str], ids: Mapping[str, tuple[str, int]]) -> DataFrame:
    """``df``, written once, with several columns of consecutive ids.

    ``ids`` maps a column to (flag column, start): rows with the flag get ``start + 1, start + 2, ...`` in the given
    order, all others keep what the column has.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order])
    ranged = stage(ranged.withColumn(BLOCK, F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy(BLOCK).agg(*[F.count_if(flag).alias(f"_rows_{name}") for name, (flag, _) in ids.items()])
    before = _frame([], [BLOCK], inclusive=False)
    starts = sizes.select(BLOCK, *[F.coalesce(F.sum(f"_rows_{n}").over(before), F.lit(0)).alias(f"_rows_{n}") for n in ids])
    inside = _frame([BLOCK], order, inclusive=True)
    placed = ranged.withColumns({f"_place_{n}": F.count_if(flag).over(inside) for n, (flag, _) in ids.items()}).join(F.broadcast(starts), BLOCK)
    numbered = {
        n: F.when(F.col(flag), F.lit(start).cast("long") + F.col(f"_rows_{n}") + F.col(f"_place_{n}")).otherwise(F.col(n) if n in df.columns else F.lit(None))
        for n, (flag, start) in ids.items()
    }
    return placed.withColumns(numbered).drop(BLOCK, *[f"_{kind}_{n}" for kind in ("rows", "place") for n in ids])


def highest_of(*columns: tuple[DataFrame, str]) -> list[int]:
    """The highest id in use of each (table, column), 0 for an empty table, in one job."""
    tops = [df.agg(F.max(column).alias("top")).select(F.lit(i).alias("i"), "top") for i, (df, column) in enumerate(columns)]
    found = {row.i: row.top or 0 for row in reduce(DataFrame.unionByName, tops).collect()}
    return [found[i] for i in range(len(columns))]


def highest(df: DataFrame, column: str) -> int:
    """The highest id in use, 0 for an empty table."""
    return df.agg(F.max(column)).first()[0] or 0


def _frame(keys: Sequence[str], order: Sequence[str | Column], inclusive: bool):
    spec = Window.partitionBy(*keys).orderBy(*order)
    return spec.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)


def _added(how: str, start: Column, value: Column) -> Column:
    if how == "sum":
        return F.coalesce(start + value, start, value)
    return F.greatest(start, value)
