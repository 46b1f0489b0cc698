"""Plan shapes that have to hold at scale."""

import re
from pathlib import Path

import pytest
from conftest import plan

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables not there")


def test_year_is_a_pushed_range(spark):
    text = plan(entry.queries()["monthly_sales"](spark, DATA))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_orderdate,2000-01-01.*LessThan\(o_orderdate,2001-01-01", text)
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz" in text


def test_ranking_keeps_only_its_top(spark):
    for name in ("frequent_customers", "stock_by_category", "latest_orders"):
        assert "TakeOrderedAndProject" in plan(entry.queries()[name](spark, DATA))


def test_sums_shrink_before_the_shuffle_and_the_join(spark):
    text = plan(entry.queries()["frequent_customers"](spark, DATA))
    assert "partial_sum(total" in text and text.index("Join") < text.index("partial_sum")
    text = plan(entry.queries()["revenue_by_car"](spark, DATA))
    assert "ReadSchema: struct<l_partkey:bigint,l_extendedprice:double>" in text


@pytest.mark.parametrize(
    "name, keys",
    [
        ("order_list", [("id_solicitud", True)]), ("order_board", [("id_solicitud", True)]), ("inventory", [("id_producto", True)]),
        ("latest_orders", [("id_solicitud", True)]), ("stock_by_category", [("cantidad", True)]),
        ("frequent_customers", [("total_gastado", True), ("id_cliente", False)]), ("revenue_by_car", [("ingresos", True)]),
        ("inventory_report", [("stock_actual", False), ("id_producto", False)]), ("monthly_sales", [("mes", False)]),
        ("customer_history", [("fecha_solicitud", True)]),
    ],
)
def test_rows_come_in_their_order(spark, name, keys):
    found = entry.queries()[name](spark, DATA).toPandas()[[k for k, _ in keys]]
    again = found.sort_values([k for k, _ in keys], ascending=[not down for _, down in keys], kind="stable")
    assert len(found) and list(found.itertuples(index=False)) == list(again.itertuples(index=False))


@pytest.mark.parametrize("name", ["parse_orders", "parse_order_headers", "parse_order_rejects", "validate_products", "document_totals"])
def test_documents_are_read_once(spark, name):
    assert plan(entry.queries()[name](spark, DATA)).count("from_json(") == 1


def test_totals_inside_a_document_move_nothing(spark):
    assert "Exchange" not in plan(entry.queries()["document_totals"](spark, DATA))
