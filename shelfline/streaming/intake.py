"""Order, receipt and product streams over a log of batches.

Each stream is the batch operator applied to a micro-batch and to the tables as
they stood before it. A batch writes its own rows only: orders, lines, persons,
customers, rejects, new products, versions of products and changes of stock; an empty batch
writes nothing. The present products are the base and the new ones, with the newest version of each and the sum of
the changes. Commands on orders that are stored have a stream of their own, ``life``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfline.operators.allocation import append_orders, change_stock, confirm_orders
from shelfline.operators.people import resolve_customers
from shelfline.operators.quality import check_orders
from shelfline.operators.stock import apply_receipts, new_products, product_text
from shelfline.session import discard, stage
from shelfline.sources.feeds import order_keys, read_orders, split_orders
from shelfline.streaming.log import BatchLog
from shelfline.streaming.runner import require_utc

STOCK_CHANGES = "id_producto long, cambio long"
STATUS_LOG = "id_solicitud long, estado string, ts timestamp_ntz, event_id long, anulada boolean"
REJECTS = "pedido string, motivo string"
VERSIONS = "id_producto long, ts timestamp_ntz, seq long, nombre_producto string, descripcion string, precio decimal(12,2)"
#: What a batch of order documents holds: a document in ``value``, or in ``nuevo`` an id met for the first time.
DOCUMENTS = "value string, nuevo long"


def intake_log(spark: SparkSession, root: str, t: dict[str, DataFrame]) -> BatchLog:
    """A log over the retail tables producto, persona, cliente, solicitud and detalle_solicitud."""
    tables = {name: t[name] for name in ("producto", "persona", "cliente", "solicitud", "detalle_solicitud")}
    for name, schema in (("cambio_stock", STOCK_CHANGES), ("estado", STATUS_LOG), ("rechazo", REJECTS), ("version", VERSIONS)):
        tables[name] = spark.createDataFrame([], schema)
    tables["producto_nuevo"] = t["producto"].limit(0)
    return BatchLog(spark, root, tables).create()


def products_ever(log: BatchLog, batch_id: int | None = None) -> DataFrame:
    """The base and the new products, as they were at first."""
    return log.tables["producto"].unionByName(log.logged("producto_nuevo", batch_id))


def current_products(log: BatchLog, batch_id: int | None = None) -> DataFrame:
    """All products with their newest version, by (ts, seq), and their present stock."""
    products = products_ever(log, batch_id)
    changes = log.logged("cambio_stock", batch_id).groupBy("id_producto").agg(F.sum("cambio").alias("cambio"))
    attributes = [c for c in ("nombre_producto", "descripcion", "precio") if c in products.columns]
    newest = log.logged("version", batch_id).groupBy("id_producto").agg(F.max_by(F.struct(*attributes), F.struct("ts", "seq")).alias("_new"))
    versioned = products.join(newest, "id_producto", "left")
    given = F.col("_new").isNotNull()
    replaced = {c: F.when(given, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in attributes}
    return change_stock(versioned.select(*[replaced.get(c, F.col(c)) for c in products.columns]), changes)


def current_orders(log: BatchLog, batch_id: int | None = None) -> DataFrame:
    """Orders that are not cancelled, with the last status logged for each; a cancellation is final."""
    last = log.logged("estado", batch_id).groupBy("id_solicitud").agg(
        F.struct(F.max_by("estado", F.struct("ts", "event_id")).alias("estado"), F.max("anulada").alias("anulada")).alias("_last")
    )
    orders = log.rows("solicitud", batch_id)
    return (
        orders.join(last, "id_solicitud", "left")
        .filter(~F.coalesce("_last.anulada", F.lit(False)))
        .withColumn("estado", F.coalesce("_last.estado", "estado"))
        .select(orders.columns)
    )


def take_orders(batch: DataFrame, batch_id: int, log: BatchLog) -> None:
    """A batch of DOCUMENTS: check the orders, allocate stock, find customers, append.

    One document counts per order id: the earliest of the batch, if the batch brings the id as
    a new one and the base table does not have it; every other one is a reject. A refused order leaves
    no trace but its reject row, which has all reasons of all its lines; its customer is not created
    either.
    """
    read = read_orders(batch.select("value", "nuevo").withColumn("_doc", F.monotonically_increasing_id()), "nuevo", "_doc")
    # A document's text is needed only where it turns out to be no order.
    whole = stage(read.withColumn("value", F.when(F.coalesce(F.size("carrito"), F.lit(0)) == 0, F.col("value"))), "documents")
    if whole.isEmpty():
        return
    documents = whole.filter("nuevo IS NULL").drop("nuevo")
    headers, lines, broken = split_orders(documents, "_doc")
    base = log.tables["solicitud"].select("id_solicitud")
    new = whole.select(F.col("nuevo").alias("id_solicitud")).filter("id_solicitud IS NOT NULL").join(base, "id_solicitud", "left_anti")
    new = new.distinct().withColumn("_new", F.lit(True))
    dated = headers.filter("id_solicitud IS NOT NULL AND ts IS NOT NULL")
    earliest = dated.groupBy("id_solicitud").agg(F.min(F.struct("ts", "_doc")).alias("_first"))
    known = dated.join(earliest, "id_solicitud").join(new, "id_solicitud", "left")
    chosen = (F.col("_doc") == F.col("_first._doc")) & F.col("_new").isNotNull()
    fresh = stage(known.filter(chosen).drop("_first", "_new"), "fresh")
    repeated = dated.join(fresh.select("_doc"), "_doc", "left_anti").select("_doc", F.lit("repetido").alias("motivo"))
    nameless = headers.filter("id_solicitud IS NULL").select("_doc", F.lit("pedido").alias("motivo"))
    undated = headers.filter("ts IS NULL").select("_doc", F.lit("fecha").alias("motivo"))

    # The carts are opened and checked once; what reads them more than once are the needs and the accepted lines.
    checked = check_orders(lines.drop("id_solicitud", "ts").join(fresh, "_doc"))
    carts = stage(checked.select("_doc", "id_solicitud", "ts", "id_producto", "cantidad", "precio_unitario", "motivos"), "carts")
    bad = stage(carts.select("_doc", F.explode("motivos").alias("motivo")).distinct(), "bad")
    result = confirm_orders(carts.drop("motivos").join(bad, "_doc", "left_anti"), current_products(log, batch_id))
    # Every document chosen has a line, so those with neither fault nor lack of stock are the accepted ones.
    taken = fresh.join(bad, "_doc", "left_anti").join(result.rejected, "id_solicitud", "left_anti")
    people = resolve_customers(taken, log.rows("persona", batch_id), log.rows("cliente", batch_id))
    owners = stage(people.feed.groupBy("id_solicitud").agg(F.min("id_cliente").alias("id_cliente")), "owners")
    accepted = stage(result.accepted.join(owners, "id_solicitud"), "accepted")
    orders, order_lines = append_orders(accepted)

    reasons = bad.unionByName(repeated).unionByName(nameless).unionByName(undated).distinct()
    # There are no more reasons than rules, so a list of them is short.
    reasons = reasons.groupBy("_doc").agg(F.concat_ws(",", F.sort_array(F.collect_set("motivo"))).alias("motivo"))
    named = headers.select("_doc", F.col("id_solicitud").cast("string").alias("pedido"))
    short = result.rejected.select(F.col("id_solicitud").cast("string").alias("pedido"), F.lit("stock").alias("motivo"))
    rejects = (
        named.join(reasons, "_doc").select("pedido", "motivo")
        .unionByName(short)
        .unionByName(broken.select(F.col("value").alias("pedido"), F.lit("documento").alias("motivo")))
    )
    sold = accepted.groupBy("id_producto").agg((-F.sum(F.col("cantidad").cast("long"))).alias("cambio"))
    for name, rows in (
        ("solicitud", orders), ("detalle_solicitud", order_lines), ("persona", people.new_persona),
        ("cliente", people.new_cliente), ("rechazo", rejects), ("cambio_stock", sold),
    ):
        log.write(name, batch_id, rows)
    discard(whole, fresh, carts, bad, owners, accepted)


def take_products(batch: DataFrame, batch_id: int, log: BatchLog) -> None:
    """Product feed rows as ``upsert_products`` takes them, with ``ts``: log new products and new versions of known ones.

    Stock is not touched by a change: versions have a log of their own beside that of the sums.
    A change of a product that is not known when its batch comes does nothing.
    """
    feed = stage(batch, "products")
    if feed.isEmpty():
        return
    known = products_ever(log, batch_id)
    changes = feed.filter("id_producto IS NOT NULL").join(known.select("id_producto"), "id_producto", "left_semi")
    versions = changes.select(
        "id_producto", "ts", "seq", F.col("nombre").alias("nombre_producto"), product_text().alias("descripcion"), "precio"
    )
    log.write("producto_nuevo", batch_id, new_products(feed, known))
    log.write("version", batch_id, versions)


def take_receipts(batch: DataFrame, batch_id: int, log: BatchLog) -> None:
    """Stock receipts: book them on the stock, keep the rejected ones."""
    _, booked, rejects = apply_receipts(stage(batch, "receipts"), log.tables["producto"])
    sums = booked.groupBy("id_producto").agg(F.sum(F.col("cantidad").cast("long")).alias("cambio"))
    log.write("cambio_stock", batch_id, sums)
    log.write("rechazo", batch_id, rejects.select(F.col("id_producto").cast("string").alias("pedido"), "motivo"))


def once(documents: DataFrame, delay: str = "30 days") -> DataFrame:
    """A stream of DOCUMENTS: the documents of ``value`` and, in the same batch, the ids met for the first time.

    Which ids were met is kept as Spark's own state, so that no batch looks at the orders stored before. An id is remembered
    until documents dated ``delay`` after its first one have come, and a document more than that behind the newest one
    is not looked at any more: neither brings a new id, so both are rejects like any repeat. An id that comes back
    with a date more than ``delay`` after its first counts as a new order.
    """
    require_utc(documents.sparkSession)
    keys = order_keys(documents).filter("order_id IS NOT NULL AND ts IS NOT NULL").withColumn("at", F.col("ts").cast("timestamp"))
    ids = keys.withWatermark("at", delay).dropDuplicatesWithinWatermark(["order_id"])
    return documents.select("value", F.lit(None).cast("long").alias("nuevo")).unionByName(
        ids.select(F.lit(None).cast("string").alias("value"), F.col("order_id").alias("nuevo"))
    )


def run(stream: DataFrame, log: BatchLog, take: Callable[[DataFrame, int, BatchLog], None], checkpoint: str) -> StreamingQuery:
    """Start ``take(batch, batch_id, log)`` on every micro-batch that is available now."""
    return (
        stream.writeStream.foreachBatch(lambda batch, batch_id: take(batch, batch_id, log))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
