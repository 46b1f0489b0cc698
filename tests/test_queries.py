"""Every registered query against its SQL counterpart on the smallest driver tables.

No plan may pair rows without a key or run Python per row.
"""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry
from conftest import plan
from compare import canonical, tables

from shelfline.plans import oracle, registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables not there")


def test_every_query_has_its_sql():
    assert set(registry.build()) == set(oracle.build())


@pytest.fixture(scope="module")
def duck():
    return tables(DATA)


@pytest.mark.parametrize("name", list(registry.build()))
def test_query_equals_sql(spark, duck, name):
    df = registry.build()[name](spark, DATA)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInArrow"):
        assert operator not in plan(df), operator
    got = df.toPandas()
    want = duck.execute(oracle.build()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 10
