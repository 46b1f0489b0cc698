"""The registered queries: each operator bound to the driver's whole tables.

Money leaves as double, after exact decimal sums, so that results compare by
value with the SQL counterpart.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable, Mapping
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions import text
from shelfline.operators import (
    allocation,
    cascade,
    catalog,
    customers,
    orders,
    people,
    quality,
    sales,
    status,
    stock,
    validity,
)
from shelfline.plans.standin import StandIn
from shelfline.schema import ORDER_STATES, PRIMARY_KEYS, RECOVERY_COLUMNS, SCHEMAS, conform, ensure_columns, load_tables, load_versions
from shelfline.session import scratch_path, spread
from shelfline.sources import feeds, sinks
from shelfline.streaming import intake, life
from shelfline.streaming.alerts import minute_sums, stream_alerts
from shelfline.streaming.codes import stream_validity
from shelfline.streaming.log import BatchLog
from shelfline.streaming.runner import in_batches, relay, run_to_end, update_to_end
from shelfline.streaming.sales import windowed_sales

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = date(2000, 12, 31)

_QUERIES: dict[str, Callable[[StandIn], DataFrame]] = {}


def _query(name: str):
    def register(fn: Callable[[StandIn], DataFrame]) -> Callable[[StandIn], DataFrame]:
        _QUERIES[name] = fn
        return fn

    return register


def plain_types(df: DataFrame) -> DataFrame:
    """Decimals as double."""
    money = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({name: F.col(name).cast("double") for name in money}) if money else df


def build() -> dict[str, Query]:
    def bind(fn: Callable[[StandIn], DataFrame]) -> Query:
        return lambda spark, directory: plain_types(fn(StandIn(spark, directory)))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


# Catalogue and searches


@_query("catalog")
def _catalog(t: StandIn) -> DataFrame:
    return catalog.catalog(t["producto"])


@_query("inventory")
def _inventory(t: StandIn) -> DataFrame:
    return catalog.inventory(t["producto"])


@_query("facet_search")
def _facet_search(t: StandIn) -> DataFrame:
    return catalog.facet_search(
        t["producto"], name="Ring", car="ECONOMY", model="eco", transmission="Sincrónica"
    )


@_query("stock_search")
def _stock_search(t: StandIn) -> DataFrame:
    return catalog.stock_search(catalog.inventory(t["producto"]), "ring brand#1", low_only=True)


@_query("any_field_search")
def _any_field_search(t: StandIn) -> DataFrame:
    return catalog.any_field_search(catalog.inventory(t["producto"]), "C-1")


@_query("inventory_report")
def _inventory_report(t: StandIn) -> DataFrame:
    return catalog.inventory_report(t["producto"], brand="BRAND#1")


@_query("full_inventory_report")
def _full_inventory_report(t: StandIn) -> DataFrame:
    return catalog.inventory_report(t["producto"])


@_query("low_stock_report")
def _low_stock_report(t: StandIn) -> DataFrame:
    return catalog.inventory_report(t["producto"], kind="bajo-stock")


@_query("inventory_stats")
def _inventory_stats(t: StandIn) -> DataFrame:
    return catalog.inventory_stats(t["producto"])


@_query("stock_by_category")
def _stock_by_category(t: StandIn) -> DataFrame:
    return catalog.stock_by_category(t["producto"], t["categoria"])


# Orders


@_query("order_list")
def _order_list(t: StandIn) -> DataFrame:
    return orders.order_list(t)


@_query("order_sheet")
def _order_sheet(t: StandIn) -> DataFrame:
    return orders.order_sheet(orders.order_list(t))


@_query("order_search")
def _order_search(t: StandIn) -> DataFrame:
    return orders.order_search(orders.order_list(t), "CUSTOMER#00000001", "Aprobada")


@_query("order_lines")
def _order_lines(t: StandIn) -> DataFrame:
    return orders.order_lines(ChainMap({"detalle_solicitud": t["detalle_con_precio"]}, t))


@_query("order_lines_of")
def _order_lines_of(t: StandIn) -> DataFrame:
    """Lines of the approved orders."""
    approved = t["solicitud"].filter("estado = 'Aprobada'").select("id_solicitud")
    return orders.order_lines(ChainMap({"detalle_solicitud": t["detalle_con_precio"]}, t), approved)


@_query("latest_orders")
def _latest_orders(t: StandIn) -> DataFrame:
    return orders.latest_orders(t)


@_query("order_board")
def _order_board(t: StandIn) -> DataFrame:
    return orders.order_board(t)


@_query("order_items")
def _order_items(t: StandIn) -> DataFrame:
    return orders.order_items(t["detalle_solicitud"], t["producto"])


@_query("cart_totals")
def _cart_totals(t: StandIn) -> DataFrame:
    return orders.cart_totals(t["detalle_con_precio"])


@_query("merge_lines")
def _merge_lines(t: StandIn) -> DataFrame:
    return orders.merge_lines(t["detalle_solicitud"], t["producto"])


@_query("price_orders")
def _price_orders(t: StandIn) -> DataFrame:
    """All lines priced; a line in seven names a product that nobody has."""
    product = F.when(F.col("id_solicitud") % 7 == 0, -F.col("id_producto") - 1).otherwise(F.col("id_producto"))
    lines = t["detalle_solicitud"].select("id_solicitud", product.alias("id_producto"), "cantidad")
    known, unknown = orders.price_orders(lines, t["producto"])
    return known.withColumn("conocido", F.lit(True)).unionByName(
        unknown.withColumn("conocido", F.lit(False)), allowMissingColumns=True
    )


@_query("derive_totals")
def _derive_totals(t: StandIn) -> DataFrame:
    return orders.derive_totals(t["solicitud"], t["detalle_con_precio"])[0]


@_query("derive_subtotals")
def _derive_subtotals(t: StandIn) -> DataFrame:
    return orders.derive_totals(t["solicitud"], t["detalle_con_precio"])[1]


# Customers and users


@_query("customer_directory")
def _customer_directory(t: StandIn) -> DataFrame:
    return customers.customer_directory(t, "CÚSTOMER#0000000")


@_query("customer_directory_like")
def _customer_directory_like(t: StandIn) -> DataFrame:
    return customers.customer_directory(t, "cüstomer#%1_3", mode="like")


@_query("customer_history")
def _customer_history(t: StandIn) -> DataFrame:
    return customers.customer_history(t)


def _asked_keys(t: StandIn) -> DataFrame:
    """Document numbers asked for, one per event, some with a trailing blank."""
    number = (F.col("user_id") * 11 + 10000000).cast("string")
    return t.raw("events").select(
        "event_id", F.when(F.col("event_type") == "click", F.concat(number, F.lit(" "))).otherwise(number).alias("cedula")
    )


@_query("lookup_customers")
def _lookup_customers(t: StandIn) -> DataFrame:
    return customers.lookup_customers(_asked_keys(t), t["persona"])


@_query("known_customers")
def _known_customers(t: StandIn) -> DataFrame:
    return customers.split_known(_asked_keys(t), t["persona"])[0]


@_query("new_customers")
def _new_customers(t: StandIn) -> DataFrame:
    return customers.split_known(_asked_keys(t), t["persona"])[1]


@_query("user_directory")
def _user_directory(t: StandIn) -> DataFrame:
    return people.user_directory(t)


@_query("users")
def _users(t: StandIn) -> DataFrame:
    return people.users(t["usuario"])


@_query("set_roles")
def _set_roles(t: StandIn) -> DataFrame:
    """Suppliers in debt become administrators."""
    changes = t.raw("supplier").filter("s_acctbal < 0").select(F.upper("s_name").alias("correo"))
    return people.set_roles(changes, t["usuario"], "Administrador")


def _users_in_debt(t: StandIn) -> DataFrame:
    return t.raw("supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("id_usuario"))


def _removal(table: str, with_person: bool) -> Callable[[StandIn], DataFrame]:
    """Rows left of a table after removing the users in debt."""
    return lambda t: people.remove_users(_users_in_debt(t), t, with_person)[table]


for _table in ("persona", "usuario", "empleado", "cliente", "solicitud", "detalle_solicitud"):
    _query(f"remove_persons_{_table}")(_removal(_table, True))
for _table in ("usuario", "empleado"):
    _query(f"remove_users_{_table}")(_removal(_table, False))


def _staff_feed(t: StandIn) -> DataFrame:
    kind = F.col("event_type")
    mail = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.org"))
    return t.raw("events").select(
        F.col("event_id").alias("seq"),
        "ts",
        F.when(kind != "view", (F.col("user_id") * 20 + 10000000).cast("string")).alias("cedula"),
        F.concat(F.lit("Persona "), F.col("user_id").cast("string")).alias("nombre"),
        F.when(kind == "click", F.upper(mail)).otherwise(mail).alias("email"),
        F.lit("hash").alias("clave_hash"),
        F.when(~kind.isin("error", "signup"), "Administrador").alias("role_solicitante"),
    )


def _staff_tables(t: StandIn) -> Mapping[str, DataFrame]:
    mail = F.concat(F.lit("U"), F.col("id_usuario").cast("string"), F.lit("@EXAMPLE.ORG "))
    return ChainMap({"usuario": t["usuario"].withColumn("correo", mail)}, t)


def _staff_rows(change: people.StaffChange) -> DataFrame:
    """Accepted rows with the ids they got, and rejected ones with the reason."""
    created = change.persona.select("id_persona", "cedula", "nombre")
    accepted = (
        change.usuario.join(change.empleado, "id_usuario", "left")
        .join(created, "id_persona", "left")
        .select(
            "id_usuario", "correo", "rol", "fecha_registro", "id_persona", "id_empleado", "cargo", "cedula", "nombre"
        )
    )
    rejected = change.rejects.select("seq", F.col("email").alias("correo"), "cedula", "nombre", "motivo")
    return accepted.unionByName(rejected, allowMissingColumns=True)


for _variant in people.STAFF_VARIANTS:
    _query("register_staff" if _variant == "managed" else f"register_staff_{_variant}")(
        lambda t, variant=_variant: _staff_rows(people.register_staff(_staff_feed(t), _staff_tables(t), variant))
    )


def _order_persons_feed(t: StandIn) -> DataFrame:
    stranger = F.when(F.col("o_custkey") % 5 == 0, 50000000).otherwise(10000000)
    number = (F.col("o_custkey") + stranger).cast("string")
    return t.raw("orders").select(
        F.col("o_orderkey").alias("id_solicitud"),
        F.col("o_orderdate").alias("ts"),
        F.concat(F.lit("\t "), number, F.lit(" \n")).alias("cedula"),
        F.concat(F.lit(" <"), "o_orderpriority", F.lit("> & 'co' ")).alias("nombre"),
        F.concat(F.lit('"'), "o_orderstatus", F.lit('"')).alias("direccion"),
        F.lit(None).cast("string").alias("telefono"),
    )


def _known_people(t: StandIn) -> tuple[DataFrame, DataFrame]:
    """All customers, each a person; the feed asks for some numbers that nobody has."""
    return t["persona"], t["cliente"]


@_query("resolve_customers")
def _resolve_customers(t: StandIn) -> DataFrame:
    """Every order with its customer id, and the person's data where it is new."""
    found = people.resolve_customers(_order_persons_feed(t), *_known_people(t))
    clients = _known_people(t)[1].unionByName(found.new_cliente)
    created = found.new_persona.select(
        "id_persona", F.col("cedula").alias("cedula_nueva"), F.col("nombre").alias("nombre_nuevo"),
        F.col("direccion").alias("direccion_nueva"),
    )
    return (
        found.feed.select("id_solicitud", "cedula", "id_cliente")
        .join(clients, "id_cliente")
        .join(created, "id_persona", "left")
    )


# Sales


@_query("dashboard_metrics")
def _dashboard_metrics(t: StandIn) -> DataFrame:
    return sales.dashboard_metrics(t)


@_query("monthly_sales")
def _monthly_sales(t: StandIn) -> DataFrame:
    return sales.monthly_sales(t["solicitud"], AS_OF)


@_query("frequent_customers")
def _frequent_customers(t: StandIn) -> DataFrame:
    return sales.frequent_customers(t)


@_query("revenue_by_car")
def _revenue_by_car(t: StandIn) -> DataFrame:
    return sales.revenue_by_car(t)


# Checks


@_query("unique_violations")
def _unique_violations(t: StandIn) -> DataFrame:
    lines = t.raw("lineitem").select(
        F.col("l_orderkey").alias("id_solicitud"), F.col("l_linenumber").alias("linea")
    )
    return quality.unique_violations(lines, ["id_solicitud", "linea"])


@_query("unique_text_violations")
def _unique_text_violations(t: StandIn) -> DataFrame:
    """Mail names that are the same but for case, accents and trailing blanks."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    mail = (
        F.when(kind == "click", F.concat(F.lit("ÚSER"), user, F.lit("  ")))
        .when(kind == "view", F.concat(F.lit("usér"), user))
        .otherwise(F.concat(F.lit("User"), user, kind))
    )
    found = quality.unique_violations(t.raw("events").select(mail.alias("correo")), ["correo"])
    return found.select(F.translate(F.lower(F.rtrim("correo")), "úé", "ue").alias("correo"), "veces")


@_query("orphans")
def _orphans(t: StandIn) -> DataFrame:
    """Order lines whose supplier number is no product number."""
    lines = t.raw("lineitem").select(
        F.col("l_orderkey").alias("id_solicitud"), F.col("l_linenumber").alias("linea"),
        F.when(F.col("l_linenumber") == 3, F.col("l_partkey") + 1000000).when(F.col("l_linenumber") != 5, F.col("l_partkey")).alias("id_producto"),
    )
    return quality.orphans(lines, "id_producto", t["producto"], "id_producto")


@_query("reconcile_totals")
def _reconcile_totals(t: StandIn) -> DataFrame:
    return quality.reconcile_totals(t["solicitud"], t["detalle_solicitud"])


@_query("null_violations")
def _null_violations(t: StandIn) -> DataFrame:
    return quality.null_violations(t["persona"], ["cedula", "nombre", "direccion", "telefono"])


@_query("domain_violations")
def _domain_violations(t: StandIn) -> DataFrame:
    return quality.domain_violations(t["cambios_estado"], "estado", ORDER_STATES)


def _faulty_tables(t: StandIn) -> Mapping[str, DataFrame]:
    """The tables with some rules broken."""
    user, order, person = F.col("id_usuario"), F.col("id_solicitud"), F.col("id_persona")
    return {
        **{name: t[name] for name in SCHEMAS},
        "persona": t["persona"].withColumn("cedula", F.when(person % 13 == 0, F.lit("9 ")).otherwise(F.col("cedula"))),
        "usuario": t["usuario"].withColumns(
            {"rol": F.when(user % 7 == 0, "Jefe").otherwise(F.col("rol")), "correo": F.when(user % 11 != 0, F.col("correo"))}
        ),
        "solicitud": t["solicitud"].withColumns(
            {"estado": F.when(order % 10 == 0, "Anulada").otherwise(F.col("estado")), "id_cliente": F.when(order % 9 != 0, F.col("id_cliente")).otherwise(-order)}
        ),
    }


@_query("table_checks")
def _table_checks(t: StandIn) -> DataFrame:
    """Every rule of the model with the rows that break it."""
    return quality.check_tables(_faulty_tables(t), scratch_path(t.spark))


@_query("foreign_key_orphans")
def _foreign_key_orphans(t: StandIn) -> DataFrame:
    return cascade.foreign_key_orphans(_faulty_tables(t))


def _unchecked_feed(t: StandIn) -> DataFrame:
    kind = F.col("event_type")
    number = (F.col("user_id") + 10000000).cast("string")
    return t.raw("events").select(
        "event_id",
        F.when(kind == "signup", F.concat(F.lit("V-"), number)).otherwise(number).alias("cedula"),
        F.when(kind != "error", F.concat(F.lit(" "), kind)).otherwise("  ").alias("nombre"),
        F.when(kind == "click", F.concat(F.lit("0412-"), number))
        .when(kind == "view", F.concat(number, number))
        .alias("telefono"),
        F.get_json_object("props", "$.k").cast("long").alias("id_producto"),
        (F.floor("value").cast("int") % 10).cast("string").alias("cantidad"),
        F.when(kind != "purchase", F.col("event_id")).alias("id_solicitud"),
        F.when(F.col("event_id") % 50 != 0, F.col("ts")).alias("ts"),
        F.when(kind == "click", -F.col("value")).otherwise(F.col("value")).alias("precio_unitario"),
    )


@_query("validate_orders")
def _validate_orders(t: StandIn) -> DataFrame:
    """Every row with the rules it fails."""
    return quality.check_orders(_unchecked_feed(t)).select("event_id", F.array_join("motivos", ",").alias("motivos"))


@_query("phone_numbers")
def _phone_numbers(t: StandIn) -> DataFrame:
    return _unchecked_feed(t).select("event_id", text.phone_input("telefono").alias("telefono"))


@_query("escape_html")
def _escape_html(t: StandIn) -> DataFrame:
    return t.raw("pages").select("page_id", text.escape_html("html").alias("texto"))


@_query("escape_documents")
def _escape_documents(t: StandIn) -> DataFrame:
    return t.raw("documents").select("doc_id", text.escape_html("text").alias("texto"))


# Feeds, sinks and tables


@_query("validate_products")
def _validate_products(t: StandIn) -> DataFrame:
    """Product documents read, with the rules each one fails."""
    kind = F.col("event_type")
    document = F.to_json(
        F.struct(
            F.when(kind == "view", F.col("event_id")).alias("id_producto"),
            F.concat(F.lit("C-"), F.col("event_id").cast("string")).alias("codigo"),
            F.when(kind != "error", F.concat(F.lit("pieza "), kind)).otherwise(" ").alias("nombre"),
            F.when(kind != "purchase", F.lit("Marca")).alias("marca_repuesto"),
            F.lit("Auto").alias("marca_carro"),
            F.col("user_id").cast("string").alias("compra"),
            F.when(kind != "click", F.col("value").cast("decimal(12,2)").cast("string")).otherwise("caro").alias("precio"),
            (F.floor("value").cast("int") % 10).cast("string").alias("stock"),
        )
    )
    read = feeds.parse_products(t.raw("events").select(document.alias("value")))
    return quality.check_products(read).select(
        "id_producto", "codigo", "nombre", "precio", "stock", F.array_join("motivos", ",").alias("motivos")
    )


@_query("json_round_trip")
def _json_round_trip(t: StandIn) -> DataFrame:
    folder = scratch_path(t.spark)
    products = t["producto"].select("id_producto", "nombre_producto", "precio", "descripcion", "id_categoria")
    sinks.write_json(products, folder)
    return t.spark.read.schema(products.schema).json(folder)


@_query("report_round_trip")
def _report_round_trip(t: StandIn) -> DataFrame:
    folder = scratch_path(t.spark)
    report = catalog.inventory_report(t["producto"], kind="bajo-stock")
    sinks.export_report(report, folder, "bajo-stock", AS_OF, drop=["nivel"])
    left = report.drop("nivel")
    return t.spark.read.schema(left.schema).option("header", True).csv(f"{folder}/*")


@_query("table_round_trip")
def _table_round_trip(t: StandIn) -> DataFrame:
    """Users written as a table, loaded by schema, with the columns added later."""
    folder = scratch_path(t.spark)
    types = {f.name: f.dataType for f in SCHEMAS["usuario"].fields}
    conform(ensure_columns(t["usuario"], types), SCHEMAS["usuario"]).write.parquet(f"{folder}/usuario")
    users = load_tables(t.spark, folder, ["usuario"])["usuario"]
    return ensure_columns(users, {"codigo_recuperacion": "string", "expiracion_codigo": "timestamp_ntz"}).select(
        "id_usuario", "correo", "rol", "id_persona", "codigo_recuperacion", F.col("expiracion_codigo").cast("string").alias("expiracion_codigo")
    )


@_query("tables_round_trip")
def _tables_round_trip(t: StandIn) -> DataFrame:
    """All eight tables written and loaded by schema: rows, keys and rows that differ from what was written."""
    folder = scratch_path(t.spark)
    whole = {name: conform(ensure_columns(t[name], {f.name: f.dataType for f in schema.fields}), schema) for name, schema in SCHEMAS.items()}
    for name, df in whole.items():
        df.write.parquet(f"{folder}/{name}")
    counts, none = [], F.lit(0).cast("long")
    for name, df in load_tables(t.spark, folder).items():
        rows = df.agg(F.count(F.lit(1)).alias("filas"), F.countDistinct(PRIMARY_KEYS[name]).alias("claves")).withColumn("perdidas", none)
        lost = whole[name].exceptAll(df).agg(none.alias("filas"), none.alias("claves"), F.count(F.lit(1)).alias("perdidas"))
        counts += [part.select(F.lit(name).alias("tabla"), "filas", "claves", "perdidas") for part in (rows, lost)]
    sums = [F.sum(c).alias(c) for c in ("filas", "claves", "perdidas")]
    return reduce(DataFrame.unionByName, counts).groupBy("tabla").agg(*sums)


@_query("table_versions")
def _table_versions(t: StandIn) -> DataFrame:
    """Users written before and after the table got its new columns, read as one table; adding the columns twice changes nothing."""
    folder = scratch_path(t.spark)
    types = {f.name: f.dataType for f in SCHEMAS["usuario"].fields}
    users = conform(ensure_columns(t["usuario"], types), SCHEMAS["usuario"])
    users.filter("id_usuario % 3 <> 0").write.parquet(f"{folder}/before")
    newer = ensure_columns(ensure_columns(users, RECOVERY_COLUMNS), RECOVERY_COLUMNS).filter("id_usuario % 3 = 0")
    newer = newer.withColumns(
        {"codigo_recuperacion": F.concat(F.lit("R"), F.col("id_usuario")), "expiracion_codigo": F.lit("2026-01-01").cast("timestamp_ntz")}
    )
    newer.write.parquet(f"{folder}/after")
    return load_versions(t.spark, f"{folder}/*", "usuario", RECOVERY_COLUMNS).select(
        "id_usuario", "correo", "rol", "id_persona", "codigo_recuperacion", F.col("expiracion_codigo").cast("string").alias("expiracion_codigo")
    )


# Changes


def _order_documents(t: StandIn) -> DataFrame:
    """One order document per line item, with two cart items or an empty cart."""

    def item(product: str, quantity: str, price: str):
        return F.struct(
            F.col(product).alias("id_producto"),
            F.col(quantity).cast("int").alias("cant"),
            F.col(price).cast("decimal(12,2)").alias("precio"),
        )

    both = F.array(
        item("l_partkey", "l_quantity", "l_extendedprice"), item("l_suppkey", "l_linenumber", "l_tax")
    )
    cart = F.when(F.col("l_returnflag") == "R", F.filter(both, lambda _: F.lit(False))).otherwise(both)
    return t.raw("lineitem").select(
        F.to_json(
            F.struct(
                F.col("l_orderkey").alias("order_id"),
                F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
                F.lit("1").alias("cedula"),
                cart.alias("carrito"),
            )
        ).alias("value")
    )


@_query("parse_orders")
def _parse_orders(t: StandIn) -> DataFrame:
    return feeds.parse_orders(_order_documents(t))[1]


@_query("parse_order_headers")
def _parse_order_headers(t: StandIn) -> DataFrame:
    return feeds.parse_orders(_order_documents(t))[0]


@_query("parse_order_rejects")
def _parse_order_rejects(t: StandIn) -> DataFrame:
    return feeds.parse_orders(_order_documents(t))[2]


@_query("document_totals")
def _document_totals(t: StandIn) -> DataFrame:
    return feeds.document_totals(feeds.read_orders(_order_documents(t)))


def _order_feed(t: StandIn) -> DataFrame:
    """Lines with their order's date, dealt out by order, which the sums per order and product make use of."""
    dates = t["solicitud"].select("id_solicitud", F.col("fecha_solicitud").alias("ts"), "id_cliente")
    lines = spread(t["detalle_con_precio"].drop("subtotal"), t["detalle_solicitud"].count(), "id_solicitud")
    return lines.join(dates, "id_solicitud")


@_query("confirm_orders")
def _confirm_orders(t: StandIn) -> DataFrame:
    """Headers of the orders that get their stock."""
    result = allocation.confirm_orders(_order_feed(t), t["producto"])
    return allocation.append_orders(result.accepted)[0]


@_query("confirm_order_lines")
def _confirm_order_lines(t: StandIn) -> DataFrame:
    """Lines of the orders that get their stock."""
    result = allocation.confirm_orders(_order_feed(t), t["producto"])
    return allocation.append_orders(result.accepted)[1]


@_query("confirm_orders_stock")
def _confirm_orders_stock(t: StandIn) -> DataFrame:
    """Stock left when every product starts with twenty times its stock."""
    plenty = t["producto"].withColumn("stock_actual", F.col("stock_actual") * 20)
    result = allocation.confirm_orders(_order_feed(t), plenty)
    return result.producto.select("id_producto", "stock_actual")


@_query("apply_receipts")
def _apply_receipts(t: StandIn) -> DataFrame:
    changed = stock.apply_receipts(t["recepciones"], t["producto"])[0]
    return changed.select("id_producto", "stock_actual")


@_query("receipt_rejects")
def _receipt_rejects(t: StandIn) -> DataFrame:
    return stock.apply_receipts(t["recepciones"], t["producto"])[2]


@_query("status_transitions")
def _status_transitions(t: StandIn) -> DataFrame:
    usable, _ = status.screen_changes(t["cambios_estado"], t["solicitud"])
    return status.status_transitions(usable)


def _status_result(t: StandIn, mode: str) -> status.StatusResult:
    return status.apply_status(
        t["cambios_estado"], t["solicitud"], t["detalle_solicitud"], t["producto"], mode
    )


@_query("apply_status")
def _apply_status(t: StandIn) -> DataFrame:
    return _status_result(t, "reference").producto.select("id_producto", "stock_actual")


@_query("final_status")
def _final_status(t: StandIn) -> DataFrame:
    return _status_result(t, "reference").solicitud.select("id_solicitud", "estado")


@_query("status_rejects")
def _status_rejects(t: StandIn) -> DataFrame:
    """Changes of which some lack an order, name one that is not there or a status that is not on the list."""
    number = F.col("event_id")
    feed = t["cambios_estado"].select(
        "event_id",
        "ts",
        F.when(number % 11 == 0, -F.col("id") - 1).otherwise(F.col("id")).alias("id"),
        F.when(number % 13 == 0, "Anulada").when(number % 19 == 0, "").otherwise(F.col("estado")).alias("estado"),
    )
    feed = feed.withColumn("id", F.when(number % 17 != 0, F.col("id")))
    return status.apply_status(feed, t["solicitud"], t["detalle_solicitud"], t["producto"]).rejects


@_query("strict_status_rejects")
def _strict_status_rejects(t: StandIn) -> DataFrame:
    return _status_result(t, "strict").rejects


@_query("strict_status")
def _strict_status(t: StandIn) -> DataFrame:
    return _status_result(t, "strict").steps


def _stale_orders(t: StandIn) -> DataFrame:
    """Orders before 1999 that were not delivered."""
    return t["solicitud"].filter(
        (F.col("estado") != "Entregada") & (F.col("fecha_solicitud") < F.lit("1999-01-01").cast("timestamp_ntz"))
    ).select("id_solicitud")


@_query("cancel_orders")
def _cancel_orders(t: StandIn) -> DataFrame:
    return stock.cancel_orders(_stale_orders(t), t)["producto"].select("id_producto", "stock_actual")


@_query("cancel_orders_lines")
def _cancel_orders_lines(t: StandIn) -> DataFrame:
    return stock.cancel_orders(_stale_orders(t), t)["detalle_solicitud"]


@_query("cancel_orders_left")
def _cancel_orders_left(t: StandIn) -> DataFrame:
    return stock.cancel_orders(_stale_orders(t), t)["solicitud"]


_PRODUCT_COLUMNS = ("id_producto", "codigo", "nombre_producto", "descripcion", "precio", "stock_actual", "marca_repuesto", "imagen")


def _product_feed(t: StandIn) -> DataFrame:
    """Sign-ups add a product; all other events change the one they name."""
    kind = F.col("event_type")
    return t.raw("events").select(
        F.col("event_id").alias("seq"),
        F.when(kind != "signup", F.get_json_object("props", "$.k").cast("long")).alias("id_producto"),
        F.when(kind == "signup", F.concat(F.lit("N-"), F.col("event_id").cast("string"))).alias("codigo"),
        F.concat(F.lit("nombre "), F.col("user_id").cast("string")).alias("nombre"),
        F.lit("Marca").alias("marca_repuesto"),
        F.lit(None).cast("string").alias("marca_carro"),
        F.lit("Automática").alias("transmision"),
        F.col("user_id").alias("compra"),
        F.col("value").cast("decimal(12,2)").alias("precio"),
        (F.floor("value").cast("int") % 10).alias("stock"),
        F.concat(F.lit("foto-"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("imagen"),
    )


@_query("upsert_products")
def _upsert_products(t: StandIn) -> DataFrame:
    return stock.upsert_products(_product_feed(t), t["producto"]).select(*_PRODUCT_COLUMNS)


def _empty_products(t: StandIn) -> DataFrame:
    return t["producto"].filter("stock_actual = 0").select("id_producto")


@_query("delete_products")
def _delete_products(t: StandIn) -> DataFrame:
    return stock.delete_products(_empty_products(t), t)["producto"].select("id_producto")


@_query("delete_products_lines")
def _delete_products_lines(t: StandIn) -> DataFrame:
    return stock.delete_products(_empty_products(t), t)["detalle_solicitud"]


@_query("remove_categories")
def _remove_categories(t: StandIn) -> DataFrame:
    gone = t["categoria"].filter("nombre_categoria LIKE 'A%'").select("id_categoria")
    return stock.remove_categories(gone, t)["producto"].select("id_producto", "id_categoria")


def _movements(t: StandIn) -> DataFrame:
    """Sales are order lines, receipts come from events, returns from rejections."""
    sold = t.raw("lineitem").select(
        F.col("l_partkey").alias("id_producto"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("ref"),
        F.col("l_quantity").cast("int").alias("cantidad"),
    )
    received = t["recepciones"].withColumnRenamed("event_id", "ref")
    rejected = t["solicitud"].filter("estado = 'Rechazada'").select(
        "id_solicitud", F.col("fecha_solicitud").alias("ts")
    )
    returned = t["detalle_solicitud"].join(rejected, "id_solicitud").withColumnRenamed("id_solicitud", "ref")
    return stock.movements(sold, received, returned)


@_query("stock_ledger")
def _stock_ledger(t: StandIn) -> DataFrame:
    return stock.stock_ledger(_movements(t), t["producto"])


@_query("low_stock_crossings")
def _low_stock_crossings(t: StandIn) -> DataFrame:
    """Movements that take a product below the low-stock mark."""
    return stock.low_stock_crossings(stock.stock_ledger(_movements(t), t["producto"]))


@_query("code_validity")
def _code_validity(t: StandIn) -> DataFrame:
    return validity.code_validity(t["codigos"])


# Streams, run over all of their input


@_query("stream_daily_sales")
def _stream_daily_sales(t: StandIn) -> DataFrame:
    arriving = in_batches(t["solicitud"], "fecha_solicitud", 3)
    return update_to_end(windowed_sales(arriving), ["desde", "hasta"], "sales")


@_query("stream_low_stock")
def _stream_low_stock(t: StandIn) -> DataFrame:
    """Sales, receipts and returns against twenty times the stock; a last row moves the watermark on."""
    moves = _movements(t).select("id_producto", "ts", "cantidad")
    closing = moves.agg(F.expr("max(ts) + INTERVAL 2 DAYS").alias("ts")).select(
        F.lit(None).cast("long").alias("id_producto"), "ts", F.lit(0).cast("long").alias("cantidad")
    )
    opening = t["producto"].withColumn("stock_actual", F.col("stock_actual") * 20)
    minutes = relay(minute_sums(in_batches(moves, "ts", 3, closing)), "minutes")
    return run_to_end(stream_alerts(minutes, opening), "alerts")


@_query("stream_code_validity")
def _stream_code_validity(t: StandIn) -> DataFrame:
    feed = t["codigos"]
    closing = [
        feed.agg(F.expr(f"max(ts) + INTERVAL {days} DAYS").alias("ts")).select(
            F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(-1).cast("long").alias("id_usuario"),
            F.explode(F.array(F.lit("emitido"), F.lit("intento"))).alias("tipo"),
        )
        for days in (2, 4)
    ]
    answers = run_to_end(stream_validity(in_batches(feed, "ts", 3, *closing)), "codes")
    return answers.filter("event_id >= 0")


def _order_intake(t: StandIn, repeats: bool = False) -> BatchLog:
    """The log after all order documents came in, three batches and an empty one; with ``repeats`` some come again a day later."""
    item = F.struct("id_producto", F.col("cantidad").alias("cant"), F.col("precio_unitario").alias("precio"))
    carts = t["detalle_con_precio"].groupBy("id_solicitud").agg(F.collect_list(item).alias("carrito"))
    number = (F.col("id_cliente") + 10000000).cast("string")
    document = F.struct(
        F.col("id_solicitud").alias("order_id"),
        F.date_format("fecha_solicitud", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"),
        number.alias("cedula"), F.concat(F.lit("Cliente "), number).alias("nombre"), "carrito",
    )
    orders_of = t["solicitud"]
    if repeats:
        again = orders_of.filter("id_solicitud % 50 = 0").withColumn("fecha_solicitud", F.expr("fecha_solicitud + INTERVAL 1 DAY"))
        orders_of = orders_of.unionByName(again)
    documents = orders_of.join(carts, "id_solicitud").select(F.to_json(document).alias("value"), "fecha_solicitud")
    base = {**t, "solicitud": t["solicitud"].limit(0), "detalle_solicitud": t["detalle_con_precio"].limit(0)}
    log = intake.intake_log(t.spark, scratch_path(t.spark), base)
    arriving = in_batches(documents, "fecha_solicitud", 3)
    intake.run(intake.once(arriving), log, intake.take_orders, scratch_path(t.spark)).awaitTermination()
    return log


@_query("stream_order_intake")
def _stream_order_intake(t: StandIn) -> DataFrame:
    """Orders stored by the stream."""
    return _order_intake(t).logged("solicitud")


@_query("stream_order_effects")
def _stream_order_effects(t: StandIn) -> DataFrame:
    """Lines, rejects and stock that the stream leaves; every fiftieth order comes again a day later."""
    log = _order_intake(t, repeats=True)
    columns = ("tabla", "id", "id_producto", "valor")
    parts = (
        log.logged("detalle_solicitud").select(F.lit("linea"), "id_solicitud", "id_producto", F.col("cantidad").cast("string")),
        log.logged("rechazo").select(F.lit("rechazo"), F.col("pedido").cast("long"), F.lit(None).cast("long"), "motivo"),
        intake.current_products(log).select(F.lit("producto"), F.lit(None).cast("long"), "id_producto", F.col("stock_actual").cast("string")),
    )
    return reduce(DataFrame.unionByName, [part.toDF(*columns) for part in parts])


def _closing_command(t: StandIn, days: int) -> DataFrame:
    """A command on no order that moves the watermark on."""
    return t.raw("events").agg(F.max("ts").alias("last")).select(
        F.lit(-1).cast("long").alias("event_id"), (F.col("last") + F.expr(f"INTERVAL {days} DAYS")).alias("ts"), F.lit(life.STATUS).alias("tipo"),
        F.lit(-1).cast("long").alias("id"), F.lit("Aprobada").alias("estado"), F.lit(None).cast("int").alias("cantidad"),
    )


def _commands_done(t: StandIn, commands: DataFrame) -> BatchLog:
    """The log after commands that arrive up to two days late, in three batches and an empty one."""
    late = commands.withColumn("_arrival", F.col("ts") + F.expr("make_dt_interval(cast(event_id % 3 as int))"))
    closing = [_closing_command(t, days).withColumn("_arrival", F.col("ts")) for days in (9, 10)]
    log = intake.intake_log(t.spark, scratch_path(t.spark), t).stream("life").create()
    arriving = in_batches(late, "_arrival", 3, *closing).drop("_arrival")
    life.run_commands(arriving, log, scratch_path(t.spark), delay="3 days").awaitTermination()
    return log


@_query("stream_status")
def _stream_status(t: StandIn) -> DataFrame:
    """Stock after all status changes."""
    commands = t["cambios_estado"].select(
        "event_id", "ts", F.lit(life.STATUS).alias("tipo"), "id", "estado", F.lit(None).cast("int").alias("cantidad")
    )
    return intake.current_products(_commands_done(t, commands)).select("id_producto", "stock_actual")


@_query("stream_order_life")
def _stream_order_life(t: StandIn) -> DataFrame:
    """Stock and living orders after receipts, status changes and cancellations."""
    receipt = (F.col("event_type") == "view") & (F.col("event_id") % 2 == 0)
    status_of = t["cambios_estado"].select("event_id", "estado")
    commands = t.raw("events").join(status_of, "event_id").select(
        "event_id",
        "ts",
        F.when(F.col("event_id") % 501 == 0, life.CANCEL).when(receipt, life.RECEIPT).otherwise(life.STATUS).alias("tipo"),
        F.col("user_id").alias("id"),
        "estado",
        (F.floor("value").cast("int") % 10).alias("cantidad"),
    )
    log = _commands_done(t, commands)
    stocks = intake.current_products(log).select(F.lit("producto"), "id_producto", F.col("stock_actual").cast("string"))
    living = intake.current_orders(log).select(F.lit("solicitud"), "id_solicitud", "estado")
    return stocks.toDF("tabla", "id", "valor").unionByName(living.toDF("tabla", "id", "valor"))


@_query("stream_products")
def _stream_products(t: StandIn) -> DataFrame:
    """Products after all new ones and changes came in three batches, the changes out of sequence."""
    feed = _product_feed(t).join(t.raw("events").select(F.col("event_id").alias("seq"), "ts"), "seq")
    late = F.when(F.col("id_producto").isNull(), F.col("seq")).otherwise(F.col("seq") + F.col("seq") % 3 * 1000)
    log = intake.intake_log(t.spark, scratch_path(t.spark), t)
    arriving = in_batches(feed.withColumn("_arrival", late), "_arrival", 3).drop("_arrival")
    intake.run(arriving, log, intake.take_products, scratch_path(t.spark)).awaitTermination()
    return intake.current_products(log).select(*_PRODUCT_COLUMNS)
