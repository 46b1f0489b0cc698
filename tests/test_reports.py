"""Hand-computed answers over the seed rows, and edge rows of the reports."""

from datetime import date, datetime
from decimal import Decimal as D

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfline import session
from shelfline.operators import catalog, customers, orders, people, quality, sales


def test_dashboard(seed):
    assert rows(sales.dashboard_metrics(seed)) == [(5, 0, D("430.00"), "430.00")]


def test_dashboard_of_empty_tables(seed):
    empty = {name: df.limit(0) for name, df in seed.items()}
    assert rows(sales.dashboard_metrics(empty)) == [(0, 0, D(0), "0.00")]


def test_stock_by_category(seed):
    got = rows(catalog.stock_by_category(seed["producto"], seed["categoria"]), "marca", "cantidad")
    assert got == [("Filtros", 199), ("Frenos", 60), ("Suspensión", 34), ("Eléctrico", 12)]


def test_products_without_category_form_one_group(seed):
    loose = seed["producto"].withColumn("id_categoria", F.lit(None).cast("long"))
    assert rows(catalog.stock_by_category(loose, seed["categoria"]), "marca", "cantidad") == [(None, 305)]


def test_monthly_sales(seed):
    assert rows(sales.monthly_sales(seed["solicitud"], date(2026, 6, 1))) == [(4, "Abr", D("430.00"))]
    assert rows(sales.monthly_sales(seed["solicitud"], date(2025, 6, 1))) == []


def test_inventory_stats(seed):
    assert rows(catalog.inventory_stats(seed["producto"])) == [(0, D("7483.25"), 5, "7483.25")]


def test_frequent_customers_keeps_equal_names_apart(seed):
    got = rows(sales.frequent_customers(seed), "nombre", "pedidos", "total_gastado")
    assert got == [
        ("Moises Perez", 1, D("430.00")),
        ("Maria Garcia", 1, D("253.50")),
        ("Santiago Perez", 1, D("70.00")),
        ("Pedro", 1, D("64.00")),
        ("Reina Garcia", 1, D("13.50")),
    ]


def test_revenue_by_car(seed):
    assert rows(sales.revenue_by_car(seed)) == [
        ("Universal", D("253.50")),
        ("Toyota", D("95.00")),
        ("Ford", D("35.00")),
        ("Chevrolet", D("32.00")),
    ]


def test_latest_orders(seed):
    got = rows(orders.latest_orders(seed), "cliente", "total")
    assert got == [
        ("Pedro", D("64.00")),
        ("Reina Garcia", D("13.50")),
        ("Santiago Perez", D("70.00")),
        ("Moises Perez", D("430.00")),
        ("Maria Garcia", D("253.50")),
    ]


def test_order_board(seed):
    got = rows(orders.order_board(seed), "id_solicitud", "productos", "total_items", "correo")
    assert got == [(5, 1, 1, "N/A"), (4, 1, 1, "N/A"), (3, 1, 1, "N/A"), (2, 2, 2, "N/A"), (1, 2, 2, "N/A")]
    names = rows(orders.order_items(seed["detalle_solicitud"], seed["producto"]), "id_solicitud", "nombre_producto", "cantidad")
    assert sorted(names)[:3] == [(1, "Batería 12V", 1), (1, "Filtro de aceite", 1), (2, "Amortiguador delantero", 1)]


def test_order_without_lines_and_person_with_two_users(seed, table):
    t = dict(seed)
    t["detalle_solicitud"] = seed["detalle_solicitud"].filter("id_solicitud <> 5")
    now = datetime(2026, 1, 1)
    t["usuario"] = table(
        "usuario",
        *[
            {"id_usuario": n, "correo": f"m{n}@example.org", "contraseña": "h", "rol": "Cliente",
             "fecha_registro": now, "id_persona": 5}
            for n in (8, 7)
        ],
    )
    board = {r["id_solicitud"]: r for r in orders.order_board(t).collect()}
    assert (board[5]["productos"], board[5]["total_items"]) == (0, 0)
    assert (board[2]["total_items"], board[2]["correo"]) == (2, "m7@example.org")
    assert len(board) == 5
    # The directory is a plain left join: two users, two rows.
    assert customers.customer_directory(t, "moises").count() == 2


def test_long_order_is_one_row_of_the_board(spark, seed):
    count = 20_000
    products = spark.range(count).select(
        F.col("id").alias("id_producto"), F.when(F.col("id") != 7, F.format_string("p%05d", "id")).alias("nombre_producto"))
    lines = spark.range(count + 2).select(
        F.lit(2).cast("long").alias("id_solicitud"), (F.col("id") % count).alias("id_producto"), F.lit(2).alias("cantidad"))
    items = orders.order_items(lines, products)
    assert items.count() == count - 1
    assert rows(items.filter("nombre_producto = 'p00001'"), "lineas", "cantidad") == [(2, 4)]
    board = orders.order_board({**seed, "detalle_solicitud": lines, "producto": products})
    found = {r["id_solicitud"]: (r["productos"], r["total_items"]) for r in board.collect()}
    assert found == {1: (0, 0), 2: (count + 1, 2 * count + 4), 3: (0, 0), 4: (0, 0), 5: (0, 0)}


def test_reconcile_finds_doubled_totals(seed):
    got = rows(quality.reconcile_totals(seed["solicitud"], seed["detalle_solicitud"]), "razon")
    assert got == [(2.0,)] * 5


def test_derive_totals_counts_lines_once(seed):
    headers, lines = orders.derive_totals(seed["solicitud"], seed["detalle_solicitud"])
    totals = dict(rows(headers, "id_solicitud", "total"))
    assert totals == {1: D("126.75"), 2: D("215.00"), 3: D("35.00"), 4: D("6.75"), 5: D("32.00")}
    assert quality.reconcile_totals(headers, lines).isEmpty()


def test_catalog_of_seed(seed):
    got = rows(catalog.catalog(seed["producto"]), "codigo", "marca_repuesto", "marca_carro", "transmision")
    assert sorted(got) == [(f"PROD-{n}", "N/A", "N/A", "N/A") for n in range(1, 6)]


DESCRIPTIONS = [
    # description, code, brand, gearbox, purchase price
    (None, "PROD-1", "N/A", "N/A", "0"),
    ("", "PROD-1", "N/A", "N/A", "0"),
    ("0", "PROD-1", "N/A", "N/A", "0"),
    ("texto", "PROD-1", "N/A", "N/A", "0"),
    ("[1,2]", "PROD-1", "N/A", "N/A", "0"),
    ("7", "PROD-1", "N/A", "N/A", "0"),
    ('{"codigo":""}', "PROD-1", "N/A", "N/A", "0"),
    ('{"codigo":"0"}', "PROD-1", "N/A", "N/A", "0"),
    ('{"codigo":0}', "PROD-1", "N/A", "N/A", "0"),
    ('{"codigo":false}', "PROD-1", "N/A", "N/A", "0"),
    ('{"codigo":[]}', "PROD-1", "N/A", "N/A", "0"),
    ('{"codigo":null,"marca_repuesto":null}', "PROD-1", "N/A", "N/A", "0"),
    ('{"codigo":"X","marca_repuesto":""}', "X", "", "N/A", "0"),
    ('{"codigo":"X"} junk', "PROD-1", "N/A", "N/A", "0"),
    ("{'codigo':'X'}", "PROD-1", "N/A", "N/A", "0"),
    ('{"codigo":"X", bad', "PROD-1", "N/A", "N/A", "0"),
    (' {"codigo":12,"marca_repuesto":"B","transmision":"T","precio_compra":"3.50"}\n', "12", "B", "T", "3.50"),
]


def test_description_variants(table):
    products = table("producto", *[
        {"id_producto": 1, "codigo": "c", "nombre_producto": str(n), "descripcion": case[0],
         "precio": D(1), "stock_actual": 0}
        for n, case in enumerate(DESCRIPTIONS)
    ])
    got = {int(r[0]): tuple(r[1:]) for r in catalog.inventory(products).select(
        "nombre_producto", "codigo", "marca_repuesto", "transmision", "compra").collect()}
    assert got == {n: case[1:] for n, case in enumerate(DESCRIPTIONS)}


def test_facets(seed, table):
    def product(n, brand, car, gearbox, year):
        text = f'{{"marca_repuesto":"{brand}","marca_vehiculo":"{car}"}}'
        return {"id_producto": n, "codigo": "c", "nombre_producto": f"Filtro {n}", "descripcion": text,
                "precio": D(1), "stock_actual": 1, "transmision": gearbox, "ano": year}

    stock = table("producto", product(1, "Bosch", "Ford", "Automática", "2010"),
                  product(2, "", "", "Sincrónica", "2011"), {**product(3, "Bosch", "Ford", None, None), "stock_actual": 0})
    ids = lambda **facets: sorted(r[0] for r in rows(catalog.facet_search(stock, **facets), "id_producto"))
    assert ids() == [1, 2]
    assert ids(name="FILTRO", brand="Bosch") == [1]
    assert ids(brand="Genérica", car="Universal", model="univ") == [2]
    assert ids(transmission="Automática", year="2010") == [1]
    assert ids(year="1999") == []


def test_stock_and_field_search(seed):
    listed = seed["producto"]
    names = lambda df: sorted(r[0] for r in rows(df, "id_producto"))
    # Across the border of name and brand.
    assert names(catalog.stock_search(listed, "DE ACEITE acd")) == [3]
    assert names(catalog.any_field_search(listed, "de aceite acd")) == []
    assert names(catalog.any_field_search(listed, "bosch")) == [2, 4]
    low = listed.withColumn("stock_actual", F.expr("CASE id_producto WHEN 1 THEN 4 WHEN 2 THEN NULL ELSE 5 END"))
    assert names(catalog.stock_search(low, "", low_only=True)) == [1, 2]


def test_inventory_report(seed):
    got = rows(catalog.inventory_report(seed["producto"], brand="bos"), "id_producto", "nivel", "valor")
    assert got == [(2, "stock-ok", D("1440.00")), (4, "stock-ok", D("2100.00"))]
    unbranded = seed["producto"].withColumn("marca_repuesto", F.lit(None).cast("string"))
    assert catalog.inventory_report(unbranded, brand="bos").isEmpty()
    assert catalog.inventory_report(seed["producto"], kind="bajo-stock").isEmpty()
    with pytest.raises(ValueError):
        catalog.inventory_report(seed["producto"], kind="otro")


def test_order_list_search_and_sheet(seed):
    listed = orders.order_list(seed)
    assert rows(listed, "fecha")[0] == ("2026-04-13 16:30",)
    assert rows(orders.order_search(listed, "GARCIA", "Rechazada"), "id_solicitud") == [(4,), (1,)]
    assert orders.order_search(listed, "", "todos").count() == 5
    assert rows(orders.order_sheet(listed), "numero", "dia", "clase")[3] == ("#0002", "2026-04-13", "completada")


def test_order_lines(seed, spark):
    ids = spark.createDataFrame([(1,)], "id_solicitud long")
    got = sorted(rows(orders.order_lines(seed, ids), "id_producto", "codigo", "nombre_producto"))
    assert got == [(2, "PROD-2", "Batería 12V"), (3, "PROD-3", "Filtro de aceite")]


def test_customer_search_ignores_case_and_accents(seed):
    ids = lambda term, **kw: sorted(r[0] for r in rows(customers.customer_directory(seed, term, **kw), "id_cliente"))
    assert ids("GARCÍA") == [1, 4]
    assert ids("600") == [3]
    assert ids("0400000005") == [2]
    assert ids("%") == []
    assert ids("%", mode="like") == [1, 2, 3, 4, 5]
    assert ids("r_ina", mode="like") == [4]
    assert ids("") == [1, 2, 3, 4, 5]


def test_customer_history(seed, spark):
    ids = spark.createDataFrame([(2,)], "id_cliente long")
    got = rows(customers.customer_history(seed, ids), "producto", "carro", "total")
    assert got == [("Amortiguador delantero", "Toyota", D("95.00")), ("Batería 12V", "Universal", D("120.00"))]


def test_lookup_ignores_case_accents_and_trailing_blanks(spark):
    people_ = spark.createDataFrame([(1, "v-ñ1", "Ana")], "id_persona long, cedula string, nombre string")
    keys = spark.createDataFrame([("V-N1  ",), ("v-2",)], "cedula string")
    assert sorted(rows(customers.lookup_customers(keys, people_))) == [("V-N1  ", True, "Ana"), ("v-2", False, None)]
    known, new = customers.split_known(keys, people_)
    assert rows(known) == [("V-N1  ",)] and rows(new) == [("v-2",)]


def test_user_directory(seed):
    blank = {**seed, "persona": seed["persona"].withColumn("nombre", F.when(F.col("id_persona") != 3, F.col("nombre")).otherwise(""))}
    assert sorted(rows(people.user_directory(blank), "id_usuario", "nombre")) == [
        (1, "Administrador Principal"), (2, "ayuda@example.org")]
    assert people.users(seed["usuario"]).columns == ["id_usuario", "correo", "rol"]


def test_merge_and_price(spark, seed):
    lines = spark.createDataFrame(
        [(1, 1, 20), (1, 1, 4), (2, 1, 25), (2, 99, 1)], "id_solicitud long, id_producto long, cantidad int")
    got = sorted(rows(orders.merge_lines(lines, seed["producto"])))
    assert got == [(1, 1, 24, True), (2, 1, 25, False), (2, 99, 1, False)]
    known, unknown = orders.price_orders(lines, seed["producto"])
    assert sorted(rows(known, "id_solicitud", "total")) == [(1, D("380.00")), (1, D("1900.00")), (2, D("2375.00"))]
    assert rows(unknown) == [(2, 99, 1)]


def test_cart_totals(seed):
    assert dict(rows(orders.cart_totals(seed["detalle_solicitud"])))[2] == D("215.00")


def test_order_items_deal_lines_out_by_their_number(spark, seed, monkeypatch):
    """Tasks of both sums grow in number with the lines, not in size, whatever the session's shuffle partitions are."""
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    lines = spark.range(6000).selectExpr("id % 1500 AS id_solicitud", "1 + id % 5 AS id_producto", "cast(id % 3 AS int) AS cantidad")
    found = orders.order_items(lines, seed["producto"])
    assert found.rdd.getNumPartitions() == 60
    got = {(o, n): (lines, pieces) for o, n, lines, pieces in rows(found, "id_solicitud", "nombre_producto", "lineas", "cantidad")}
    names, want = dict(rows(seed["producto"], "id_producto", "nombre_producto")), {}
    for n in range(6000):
        before = want.get((n % 1500, names[1 + n % 5]), (0, 0))
        want[n % 1500, names[1 + n % 5]] = before[0] + 1, before[1] + n % 3
    assert got == want
