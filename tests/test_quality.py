from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F

from shelfline.functions import text
from shelfline.operators import quality
from shelfline.schema import FOREIGN_KEYS, ORDER_STATES, PRIMARY_KEYS, SCHEMAS, UNIQUE_KEYS


def test_seed_meets_its_constraints(seed):
    for table, column in [*PRIMARY_KEYS.items(), *UNIQUE_KEYS.items()]:
        assert quality.unique_violations(seed[table], [column]).isEmpty(), (table, column)
    for child, column, parent, _ in FOREIGN_KEYS:
        assert quality.orphans(seed[child], column, seed[parent], PRIMARY_KEYS[parent]).isEmpty(), child
    for table, schema in SCHEMAS.items():
        required = [f.name for f in schema.fields if not f.nullable]
        assert quality.null_violations(seed[table], required).filter("nulos > 0").isEmpty(), table
    assert quality.domain_violations(seed["solicitud"], "estado", ORDER_STATES).isEmpty()


def test_unique_compares_text_as_a_key(spark):
    df = spark.createDataFrame([("Batería",), ("BATERIA ",), ("bateria",), ("otro",), (None,), (None,)], "codigo string")
    assert rows(quality.unique_violations(df, ["codigo"]), "veces") == [(3,)]


def test_orphans_allow_null(spark):
    child = spark.createDataFrame([(1,), (2,), (None,)], "ref long")
    parent = spark.createDataFrame([(1,)], "id long")
    assert rows(quality.orphans(child, "ref", parent, "id")) == [(2,)]


def test_order_rules(spark):
    feed = spark.createDataFrame(
        [
            (1, "123", "Ana", "0412-123 45", 1, "2"),
            (2, "12a", " ", "04x", None, "0"),
            (3, "", None, None, 1, "1.5"),
            (4, "1", "A", "1234567890123456", 1, "tres"),
            (5, "1\n", "A", "", 1, "-1"),
            (6, None, "A", "", 1, None),
        ],
        "n int, cedula string, nombre string, telefono string, id_producto long, cantidad string",
    )
    feed = feed.withColumns({
        "id_solicitud": F.when(F.col("n") != 5, F.col("n")),
        "ts": F.when(F.col("n") != 4, F.lit("2026-01-01").cast("timestamp_ntz")),
        "precio_unitario": F.when(F.col("n") == 2, -1).when(F.col("n") != 6, 0),
    })
    valid, rejects = quality.validate_orders(feed)
    assert rows(valid, "n") == [(1,)]
    assert dict(rows(rejects, "n", "motivos")) == {
        2: ["cedula", "nombre", "telefono", "producto", "cantidad", "precio"],
        3: ["cedula", "nombre", "cantidad"],
        4: ["telefono", "cantidad", "fecha"],
        5: ["cantidad", "pedido"],
        6: ["cedula", "cantidad", "precio"],
    }


def test_product_rules(spark):
    feed = spark.createDataFrame(
        [
            (None, "c", "n", "m", "a", 1, 1, 1),
            (None, "", "n", "", "a", None, 1, None),
            (7, None, "n", None, None, None, 1, None),
            (8, None, " ", None, None, None, None, None),
        ],
        "id_producto long, codigo string, nombre string, marca_repuesto string, marca_carro string, "
        "compra int, precio int, stock int",
    )
    valid, rejects = quality.validate_products(feed)
    assert sorted(r[0] or 0 for r in rows(valid, "id_producto")) == [0, 7]
    assert dict(rows(rejects, "id_producto", "motivos")) == {
        None: ["codigo", "marca_repuesto", "compra", "stock"], 8: ["nombre", "precio"]}


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_formats(spark):
    assert one(spark, text.thousands(F.lit("1234.125").cast("decimal(12,3)"))) == "1,234.13"
    assert one(spark, text.two_decimals(F.lit("1234.125").cast("decimal(12,3)"))) == "1234.13"
    assert [one(spark, text.padded(F.lit(n), 4)) for n in (7, 12345)] == ["0007", "12345"]
    assert one(spark, text.digits_only(F.lit("0412-12 3"))) == "0412123"
    assert one(spark, text.phone_input(F.lit("+58 (412) 123-45-67-89-01-23"))) == "584121234567890"
    # The entities and month labels of the pages.
    assert one(spark, text.escape_html(F.lit("""<a href="x">&'</a>"""))) == (
        "&lt;a href=&quot;x&quot;&gt;&amp;&#039;&lt;/a&gt;")
    assert one(spark, text.clean_input(F.lit("\t <b> \n"))) == "&lt;b&gt;"
    assert [r[0] for r in spark.range(1, 13).select(F.col("id").cast("int").alias("m")).select(text.month_label("m")).collect()] == [
        "Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic"]


def test_wildcards_compare_as_the_collation_does(spark):
    df = spark.createDataFrame([("Łukasz Nowak",), ("Ştefan Őri",), ("ab1x3cd",), (None,), ("",), ("árbol",)], "t string")

    def found(term):
        return [r[0] for r in df.filter(text.matches("t", term, "like")).collect()]

    for term, want in {
        "őri": ["Ştefan Őri"], "stefan%ori": ["Ştefan Őri"], "ori%stefan": [], "1_3": ["ab1x3cd"], "1__3": [],
        "_B1": ["ab1x3cd"], "ARBOL": ["árbol"], "lukasz%k": ["Łukasz Nowak"], "a%b_l": ["árbol"],
    }.items():
        assert found(term) == want, term
        if "%" not in term and "_" not in term:
            assert found(term) == [r[0] for r in df.filter(text.matches("t", term)).collect()]
