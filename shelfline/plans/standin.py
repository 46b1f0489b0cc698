"""The retail tables as views over the driver's Parquet tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.schema import MONEY


# Columns of the driver's tables, so that opening one needs no look into its files.
RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
    "props string",
}


class StandIn(Mapping[str, DataFrame]):
    """Each view is built when asked for; Spark prunes what a query leaves out."""

    def __init__(self, spark: SparkSession, directory: str, streaming: bool = False):
        self.spark = spark
        self._directory = directory
        self._streaming = streaming

    def streamed(self) -> StandIn:
        """The same views over a stream of the tables' files."""
        return StandIn(self.spark, self._directory, streaming=True)

    def raw(self, name: str) -> DataFrame:
        if self._streaming:
            reader = self.spark.readStream.schema(RAW_SCHEMAS[name])
            return reader.option("pathGlobFilter", f"{name}.parquet").parquet(self._directory)
        reader = self.spark.read
        if name in RAW_SCHEMAS:
            reader = reader.schema(RAW_SCHEMAS[name])
        return reader.parquet(f"{self._directory}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        return _VIEWS[name](self)

    def __iter__(self) -> Iterator[str]:
        return iter(_VIEWS)

    def __len__(self) -> int:
        return len(_VIEWS)


def _categoria(t: StandIn) -> DataFrame:
    return t.raw("region").select(
        F.col("r_regionkey").cast("long").alias("id_categoria"),
        F.col("r_name").alias("nombre_categoria"),
    )


def _description() -> Column:
    head = F.concat(
        F.lit('{"marca_repuesto":"'), "p_brand", F.lit('","marca_vehiculo":"'), "p_type", F.lit('",')
    )
    full = F.concat(
        head,
        F.lit('"transmision":"Automática","precio_compra":'),
        F.col("p_size").cast("string"),
        F.lit(',"codigo":"C-'),
        F.col("p_partkey").cast("string"),
        F.lit('"}'),
    )
    kind = F.col("p_partkey") % 5
    return (
        F.when(kind == 1, "texto libre")
        .when(kind == 2, "[1,2]")
        .when(kind == 3, F.concat(head, F.lit('"codigo":""}')))
        .when(kind == 4, full)
    )


def _producto(t: StandIn) -> DataFrame:
    part_id = F.col("p_partkey")
    return t.raw("part").select(
        part_id.alias("id_producto"),
        F.concat(F.lit("PROD-"), part_id.cast("string")).alias("codigo"),
        F.col("p_name").alias("nombre_producto"),
        _description().alias("descripcion"),
        F.col("p_retailprice").cast(MONEY).alias("precio"),
        (F.col("p_size") % 25).alias("stock_actual"),
        F.col("p_brand").alias("marca_repuesto"),
        F.col("p_type").alias("marca_carro"),
        (part_id % 17 + 2010).cast("string").alias("ano"),
        F.when(part_id % 3 == 0, "Automática")
        .when(part_id % 3 == 1, "Sincrónica")
        .otherwise("No aplica")
        .alias("transmision"),
        F.lit("default.jpg").alias("imagen"),
        F.nullif(part_id % 6, F.lit(5)).alias("id_categoria"),
    )


def _persona(t: StandIn) -> DataFrame:
    nations = t.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    customer_id = F.col("c_custkey")
    phone = F.concat(F.lit("0412"), F.lpad(customer_id.cast("string"), 7, "0"))
    return (
        t.raw("customer")
        .join(nations, "c_nationkey", "left")
        .select(
            customer_id.alias("id_persona"),
            (customer_id + 10000000).cast("string").alias("cedula"),
            F.col("c_name").alias("nombre"),
            F.col("n_name").alias("direccion"),
            F.when(customer_id % 7 != 0, phone).alias("telefono"),
        )
    )


def _cliente(t: StandIn) -> DataFrame:
    return t.raw("customer").select(
        F.col("c_custkey").alias("id_cliente"), F.col("c_custkey").alias("id_persona")
    )


def _usuario(t: StandIn) -> DataFrame:
    supplier_id = F.col("s_suppkey")
    return t.raw("supplier").select(
        supplier_id.alias("id_usuario"),
        F.col("s_name").alias("correo"),
        F.when(supplier_id == 0, "Administrador").otherwise("Empleado").alias("rol"),
        (supplier_id * 10).alias("id_persona"),
    )


def _empleado(t: StandIn) -> DataFrame:
    return t.raw("supplier").select(
        (F.col("s_suppkey") + 1).alias("id_empleado"),
        F.lit("Operador").alias("cargo"),
        F.col("s_suppkey").alias("id_usuario"),
    )


def _solicitud(t: StandIn) -> DataFrame:
    code = F.col("o_orderstatus")
    status = (
        F.when(code == "O", "Pendiente")
        .when(code == "F", "Entregada")
        .when(F.col("o_orderpriority") == "5-LOW", "Rechazada")
        .otherwise("Aprobada")
    )
    return t.raw("orders").select(
        F.col("o_orderkey").alias("id_solicitud"),
        F.col("o_orderdate").alias("fecha_solicitud"),
        status.alias("estado"),
        F.col("o_totalprice").cast(MONEY).alias("total"),
        F.col("o_custkey").alias("id_cliente"),
    )


def _detalle_solicitud(t: StandIn) -> DataFrame:
    return t.raw("lineitem").select(
        F.col("l_orderkey").alias("id_solicitud"),
        F.col("l_partkey").alias("id_producto"),
        F.col("l_quantity").cast("int").alias("cantidad"),
        F.col("l_extendedprice").cast(MONEY).alias("subtotal"),
    )


def _detalle_con_precio(t: StandIn) -> DataFrame:
    prices = t["producto"].select("id_producto", F.col("precio").alias("precio_unitario"))
    return t["detalle_solicitud"].join(prices, "id_producto")


def _cambios_estado(t: StandIn) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", "Pendiente")
        .when(kind == "click", "En Proceso")
        .when(kind == "view", "Aprobada")
        .when(kind == "purchase", "Completada")
        .when(kind == "error", "Rechazada")
    )
    return t.raw("events").select("event_id", "ts", F.col("user_id").alias("id"), status.alias("estado"))


def _recepciones(t: StandIn) -> DataFrame:
    return (
        t.raw("events")
        .filter(F.col("event_type") == "view")
        .select(
            "event_id",
            F.get_json_object("props", "$.k").cast("long").alias("id_producto"),
            (F.floor("value").cast("int") % 10).alias("cantidad"),
            "ts",
        )
    )


def _codigos(t: StandIn) -> DataFrame:
    kind = F.col("event_type")
    role = (
        F.when(kind == "click", "emitido")
        .when(kind == "purchase", "intento")
        .when(kind == "error", "consumido")
    )
    return (
        t.raw("events")
        .select("event_id", "ts", F.col("user_id").alias("id_usuario"), role.alias("tipo"))
        .filter(F.col("tipo").isNotNull())
    )


_VIEWS: dict[str, Callable[[StandIn], DataFrame]] = {
    "categoria": _categoria,
    "producto": _producto,
    "persona": _persona,
    "cliente": _cliente,
    "usuario": _usuario,
    "empleado": _empleado,
    "solicitud": _solicitud,
    "detalle_solicitud": _detalle_solicitud,
    "detalle_con_precio": _detalle_con_precio,
    "cambios_estado": _cambios_estado,
    "recepciones": _recepciones,
    "codigos": _codigos,
}
