import json
from datetime import date, datetime
from decimal import Decimal as D

import pytest
from conftest import rows
from pyspark.sql import types as T

from shelfline import session
from shelfline.schema import RECOVERY_COLUMNS, SCHEMAS, ensure_columns, load_jdbc_table, load_tables
from shelfline.sources import feeds, sinks


def test_parse_orders(spark):
    documents = [
        {"order_id": 1, "ts": "2026-01-01T10:00:00", "cedula": "1", "nombre": "A",
         "carrito": [{"id_producto": 4, "cant": 2, "precio": 1.5}, {"id_producto": "5", "cant": "x", "precio": None}]},
        {"order_id": 2, "carrito": []},
        {"order_id": 3, "cedula": "1"},
    ]
    texts = [(json.dumps(d),) for d in documents] + [("no json",), ("[1]",), (None,)]
    headers, lines, rejects = feeds.parse_orders(spark.createDataFrame(texts, "value string"))
    assert rows(headers, "id_solicitud", "ts", "cedula", "direccion") == [(1, datetime(2026, 1, 1, 10), "1", None)]
    assert rows(lines, "id_solicitud", "linea", "id_producto", "cantidad", "precio_unitario") == [
        (1, 0, 4, 2, D("1.50")), (1, 1, 5, None, None)]
    assert rejects.count() == 5


def test_document_totals(spark):
    documents = [
        {"order_id": 1, "ts": "2026-01-01T10:00:00", "carrito": [{"cant": "2", "precio": "1.50"}, {"cant": "x", "precio": 9}, {"cant": 3, "precio": None}, None]},
        {"order_id": 2, "carrito": []},
        {"order_id": 3, "carrito": [{"cant": 2000000000, "precio": "9999999999.99"}, {"cant": 2000000000, "precio": "9999999999.99"}]},
    ]
    read = feeds.read_orders(spark.createDataFrame([(json.dumps(d),) for d in documents] + [("no json",), (None,)], "value string"))
    assert sorted(rows(feeds.document_totals(read), "id_solicitud", "lineas", "piezas", "total")) == [
        (1, 4, 5, D("3.00")), (3, 2, 4_000_000_000, D("39999999999960000000.00"))]


def test_parse_products(spark):
    texts = [('{"codigo":"C","nombre":"N","precio":"2.5","stock":3,"compra":1}',), ('{"id_producto":"7","nombre":"M"}',)]
    got = rows(feeds.parse_products(spark.createDataFrame(texts, "value string")))
    assert [r[:9] for r in got] == [
        (None, "N", "C", "", "", "", D("1.00"), D("2.50"), 3), (7, "M", "", "", "", "", D("0.00"), None, None)]
    assert json.loads(got[0][9]) == {
        "marca_repuesto": "", "marca_vehiculo": "", "transmision": "", "precio_compra": "1", "codigo": "C"}


def test_json_sink_keeps_nulls(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_json(spark.createDataFrame([(1, None)], "a int, b string"), path)
    assert [r[0] for r in spark.read.text(path).collect()] == ['{"a":1,"b":null}']


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "x, y", "ver")], "id int, nombre string, accion string")
    path = sinks.export_report(df, str(tmp_path), "bajo-stock", date(2026, 4, 16), drop=["accion"])
    assert path.endswith("/Reportes_bajo-stock_2026-04-16")
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["id", "nombre"] and rows(back) == [("1", "x, y")]
    with pytest.raises(ValueError):
        sinks.export_report(df.limit(0), str(tmp_path), "x", date(2026, 4, 16))


def test_ensure_columns_is_idempotent(seed):
    once = ensure_columns(seed["usuario"], RECOVERY_COLUMNS)
    assert once.schema["expiracion_codigo"].dataType == T.TimestampNTZType()
    assert ensure_columns(once, RECOVERY_COLUMNS).columns == once.columns
    assert len(once.columns) == len(seed["usuario"].columns) + 2


def test_load_tables(spark, seed, tmp_path):
    for name, df in seed.items():
        df.write.parquet(str(tmp_path / name))
    loaded = load_tables(spark, str(tmp_path))
    assert set(loaded) == set(SCHEMAS)
    for name, df in loaded.items():
        assert sorted(rows(df)) == sorted(rows(seed[name]), key=lambda r: r[0])


class Reader:
    """Records the options of each JDBC read and hands back fixed frames."""

    def __init__(self, frames):
        self.frames, self.seen, self.current = frames, [], {}

    @property
    def read(self):
        return self

    def format(self, name):
        assert name == "jdbc"
        return self

    def options(self, **options):
        other = Reader(self.frames)
        other.seen, other.current = self.seen, {**self.current, **options}
        return other

    def option(self, name, value):
        return self.options(**{name: value})

    def load(self):
        self.seen.append(self.current)
        return self.frames["query" if "query" in self.current else "dbtable"]


def test_jdbc_read_is_split_by_key_range(spark, seed):
    bounds = spark.createDataFrame([(3, 40)], "low long, high long")
    texts = seed["producto"].select(*[c for c in reversed(seed["producto"].columns)])
    reader = Reader({"query": bounds, "dbtable": texts})
    got = load_jdbc_table(reader, "jdbc:x", "producto", 4, user="u")
    assert got.schema.names == SCHEMAS["producto"].names
    assert reader.seen[1] == {
        "url": "jdbc:x", "user": "u", "dbtable": "producto", "partitionColumn": "id_producto",
        "lowerBound": "3", "upperBound": "41", "numPartitions": "4"}
    empty = Reader({"query": spark.createDataFrame([(None, None)], "low long, high long"), "dbtable": texts})
    load_jdbc_table(empty, "jdbc:x", "producto", 4)
    assert "numPartitions" not in empty.seen[1]


class Conf(dict):
    def get(self, name, default=None):
        return dict.get(self, name, default)


class Session:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})


def test_shared_folder():
    assert session.shared_dir(Session(spark_checkpoint_dir="hdfs://a/b/")) == "hdfs://a/b"
    beside = Session(spark_sql_warehouse_dir="hdfs://a/warehouse/")
    assert session.shared_dir(beside) == "hdfs://a/warehouse/shelfline-scratch"
