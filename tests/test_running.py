"""Running values over blocks give the same result as a plain loop."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfline import session
from shelfline.operators import allocation
from shelfline.operators.running import BLOCK, blocked, number_rows, running


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_running_sum_and_max(spark, split, inclusive, seed):
    rng = random.Random(seed)
    data = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(5), n, rng.randrange(100)) for n in range(400)]
    df = spark.createDataFrame(data, "k int, ts int, id int, v int").repartition(7)
    got = {
        r["id"]: (r["total"], r["top"])
        for r in running(df, ["k"], ["ts", "id"], {"total": ("sum", "v"), "top": ("max", "v")},
                         inclusive=inclusive).collect()
    }
    want, seen = {}, {}
    for k, _, n, v in sorted(data, key=lambda r: (r[1], r[2])):
        before = seen.setdefault(k, [])
        values = before + [v] if inclusive else list(before)
        want[n] = (sum(values), max(values)) if values else (None, None)
        before.append(v)
    assert got == want


def test_one_key_with_most_rows_is_split(spark, split):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(-1)).alias("k"), F.col("id").alias("ts"), F.lit(1).alias("v"))
    assert blocked(df, ["k"], ["ts"]).filter("k = -1").select(BLOCK).distinct().count() > 1
    got = running(df, ["k"], ["ts"], {"n": ("sum", "v")}).filter("k = -1")
    assert sorted(r[0] for r in rows(got, "n")) == list(range(1, 2001))


def test_struct_maximum_gives_the_row_before(spark, split):
    df = spark.createDataFrame([(1, n, f"s{n}") for n in range(50)], "k int, ts int, s string").withColumn(
        "at", F.struct("ts", "s"))
    got = running(df, ["k"], ["ts"], {"before": ("max", "at")}, inclusive=False)
    assert dict(rows(got, "ts", "before.s")) == {n: f"s{n - 1}" if n else None for n in range(50)}


def test_numbering(spark, split):
    df = spark.createDataFrame([(n,) for n in range(100)], "seq int").repartition(5)
    got = number_rows(df, ["seq"], "id", 7)
    assert dict(rows(got, "seq", "id")) == {n: n + 8 for n in range(100)}


def test_blocks_and_shares_follow_the_rows(spark, seed, monkeypatch):
    """An allocation's blocks and a round's shares grow in number with the lines, and nothing else changes."""
    lines = spark.range(600).selectExpr(
        "id AS id_solicitud", "1 + id % 5 AS id_producto", "cast(1 + id % 3 AS int) AS cantidad", "timestamp_ntz'2026-01-01' + make_dt_interval(0, 0, 0, id % 50) AS ts"
    )
    want = allocation.confirm_orders(lines, seed["producto"])
    want = sorted(rows(want.rejected)), sorted(rows(want.producto, "id_producto", "stock_actual"))
    blocks = []
    monkeypatch.setattr(session, "ROWS_A_TASK", 20)
    monkeypatch.setattr(allocation, "blocked", lambda *given: blocks.append(blocked(*given)) or blocks[0])
    shares = []
    monkeypatch.setattr(allocation, "spread", lambda df, *given: shares.append(session.spread(df, *given)) or shares[-1])
    monkeypatch.setattr(allocation, "discard", lambda *staged: None)
    got = allocation.confirm_orders(lines, seed["producto"])
    assert (sorted(rows(got.rejected)), sorted(rows(got.producto, "id_producto", "stock_actual"))) == want
    assert blocks[0].select(BLOCK).distinct().count() > 20
    assert shares[0].rdd.getNumPartitions() == 30
