"""Streams over split files equal the batch operators and survive a restart."""

import json
import random
from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfline.functions.order import PAGE_TRANSITIONS
from shelfline.operators import stock, validity
from shelfline.session import stage
from shelfline.streaming import alerts, codes, intake, life, runner, sales
from shelfline.streaming.runner import dropped_rows, in_batches, relay, require_utc, run_to_end

START = datetime(2026, 1, 1)


def order(number, minute, cedula, *cart):
    return json.dumps({
        "order_id": number, "ts": (START + timedelta(minutes=minute)).isoformat(), "cedula": cedula, "nombre": f"N{number}",
        "carrito": [{"id_producto": p, "cant": q, "precio": "2.00"} for p, q in cart]})


def stock_of(log):
    return dict(rows(intake.current_products(log), "id_producto", "stock_actual"))


def seed_log(spark, seed, folder):
    return intake.intake_log(spark, folder, seed)


def test_order_life(spark, seed, tmp_path):
    log = seed_log(spark, seed, str(tmp_path / "log"))
    feed = tmp_path / "orders"
    feed.mkdir()
    (feed / "a.json").write_text("\n".join([
        order(10, 1, "700", (5, 6)),
        order(11, 2, "900", (5, 6), (1, 1)),  # not enough left after order 10
        order(12, 3, "900", (5, 4)),
        order(13, 4, "9x", (1, 1)),  # malformed document number
        "nonsense",
    ]))
    documents = spark.readStream.text(str(feed))

    def start():
        intake.run(intake.once(documents), log, intake.take_orders, str(tmp_path / "ck_orders")).awaitTermination()

    start()
    start()  # a restart finds nothing new
    assert stock_of(log) == {1: 24, 2: 12, 3: 199, 4: 60, 5: 0}
    assert sorted(rows(log.rows("rechazo"))) == [("11", "stock"), ("13", "cedula"), ("nonsense", "documento")]
    new = sorted(rows(intake.current_orders(log).filter("id_solicitud >= 10"), "id_solicitud", "estado", "total", "id_cliente"))
    assert new == [(10, "Pendiente", D("12.00"), 4), (12, "Pendiente", D("8.00"), 6)]
    # The refused order did not create its customer; the later one of the same number did.
    assert rows(log.rows("persona").filter("id_persona > 8"), "id_persona", "cedula", "nombre") == [(9, "900", "N12")]

    (feed / "b.json").write_text(order(14, 9, "900", (4, 60)))
    start()
    assert stock_of(log)[4] == 0
    assert rows(log.rows("solicitud").filter("id_solicitud = 14"), "id_cliente") == [(6,)]

    def after(minutes, event_id, kind, number, state=None, pieces=None):
        return (event_id, START + timedelta(minutes=minutes), kind, number, state, pieces)

    sent = commands(
        spark,
        [after(20, 1, life.STATUS, 10, "Rechazada"), after(20, 2, life.STATUS, 12, "En Proceso"), after(21, 3, life.STATUS, 77, "Aprobada"),
         after(22, 4, life.RECEIPT, 5, pieces=4), after(23, 5, life.RECEIPT, 5, pieces=0), after(24, 6, "otra", 1)],
        # Order 12 gives its four back, the rejected order 10 does not do so again; nothing follows a cancellation.
        [after(60, 9, life.CANCEL, 12), after(61, 10, life.CANCEL, 10), after(62, 11, life.CANCEL, 12), after(70, 12, life.STATUS, 12, "Rechazada")],
    )
    for _ in range(2):  # a restart finds nothing new
        life.run_commands(sent, log.stream("life").create(), str(tmp_path / "ck_life"), delay="1 hour").awaitTermination()
    assert stock_of(log)[5] == 6 + 4 + 4
    assert {10, 12}.isdisjoint(r[0] for r in rows(intake.current_orders(log), "id_solicitud"))
    assert dict(rows(intake.current_orders(log), "id_solicitud", "estado"))[2] == "Entregada"
    refused = spark.read.parquet(f"{log.root}/rechazo/source=life")
    assert sorted(rows(refused.filter("pedido <> '-1'"), "pedido", "motivo")) == [
        ("1", "tipo"), ("12", "solicitud"), ("12", "solicitud"), ("5", "cantidad"), ("77", "solicitud")]


def commands(spark, *batches):
    """A stream of commands, a batch each, and two that move the watermark past them."""
    end = max(r[1] for batch in batches for r in batch) + timedelta(days=30)
    closing = [[(-1, end + timedelta(days=d), life.STATUS, -1, "Aprobada", None)] for d in (0, 1)]
    numbered = [(k, *row) for k, batch in enumerate([*batches, *closing]) for row in batch]
    df = spark.createDataFrame(numbered, "batch long, " + life.COMMAND)
    return in_batches(df, "batch", len(batches) + 2).drop("batch")


def replayed(stocks, orders, lines, sent, strict):
    """The commands one after the other: (stock, statuses of living orders, steps, rejects)."""
    stocks, states = dict(stocks), dict(orders)
    steps, refused = [], []
    for event_id, ts, kind, number, state, pieces in sorted(sent, key=lambda r: (r[1], r[0])):
        state = {"En Proceso": "Aprobada", "Completada": "Entregada"}.get(state, state)
        if kind == life.RECEIPT:
            stocks[number] += pieces
            continue
        before = states.get(number)
        if before is None or (kind == life.STATUS and strict and (before, state) not in PAGE_TRANSITIONS):
            refused.append((event_id, "solicitud" if before is None else "transicion"))
            continue
        back = before != "Rechazada" and (kind == life.CANCEL or state == "Rechazada")
        steps.append((event_id, before, back))
        for product, quantity in lines.get(number, []) if back else []:
            stocks[product] += quantity
        if kind == life.CANCEL:
            del states[number]
        else:
            states[number] = state
    return stocks, states, sorted(steps), sorted(refused)


@pytest.mark.parametrize("mode", ["reference", "strict"])
def test_commands_equal_a_replay_in_any_order_of_arrival(spark, seed, tmp_path, mode):
    """Late and repeated changes and cancellations over three batches; stock and pieces in living lines stay what they were."""
    rng = random.Random(5)
    orders = [(n, START, rng.choice(["Pendiente", "Aprobada", "Rechazada"]), D(1), 1) for n in range(1, 25)]
    lines = {n: [(1 + n % 5, 1 + n % 3), (1 + (n + 2) % 5, 2)] for n in range(1, 25)}
    t = {
        **seed,
        "solicitud": spark.createDataFrame(orders, seed["solicitud"].schema),
        "detalle_solicitud": spark.createDataFrame(
            [(10 * n + k, n, p, q, D(1), D(q)) for n, cart in lines.items() for k, (p, q) in enumerate(cart)], seed["detalle_solicitud"].schema),
    }
    kinds = [life.STATUS] * 6 + [life.CANCEL, life.RECEIPT]
    sent = []
    for event_id in range(260):
        kind = rng.choice(kinds)
        state = rng.choice(["Aprobada", "En Proceso", "Rechazada", "Completada"]) if kind == life.STATUS else None
        number = rng.randint(1, 5) if kind == life.RECEIPT else rng.randint(1, 26)
        sent.append((event_id, START + timedelta(minutes=rng.randint(0, 400), microseconds=rng.randint(0, 2) * 333), kind, number, state, 3 if kind == life.RECEIPT else None))
    arrival = sorted(sent, key=lambda r: r[1] + timedelta(minutes=rng.randint(0, 500)))
    batches = [arrival[k::3] if k == 9 else arrival[k * 90 : (k + 1) * 90] for k in range(3)]
    log = intake.intake_log(spark, str(tmp_path / "log"), t).stream("life").create()
    life.run_commands(commands(spark, *batches), log, str(tmp_path / "ck"), mode, "1 day").awaitTermination()
    stocks = dict(rows(seed["producto"], "id_producto", "stock_actual"))
    want, states, _, refused = replayed(stocks, {o[0]: o[2] for o in orders}, lines, sent, mode == "strict")
    assert stock_of(log) == want
    assert dict(rows(intake.current_orders(log), "id_solicitud", "estado")) == states
    found = rows(log.logged("rechazo").filter("pedido <> '-1'"), "motivo")
    assert sorted(r[0] for r in found) == sorted(reason for _, reason in refused)
    if mode == "strict":  # in which no order can give its stock back twice
        def held(living):
            return sum(q for n, state in living.items() if state != "Rechazada" for _, q in lines[n])
        received = sum(r[5] for r in sent if r[2] == life.RECEIPT)
        assert sum(stock_of(log).values()) + held(states) == sum(stocks.values()) + received + held({o[0]: o[2] for o in orders})


def test_64_orders_are_one_state(spark, seed, tmp_path):
    """Commands of 200 orders, some twice in a batch, leave four states, and each order goes its own way."""
    orders = [(n, START, "Rechazada" if n % 5 == 0 else "Pendiente", D(1), 1) for n in range(1, 201)]
    lines = {n: [(1 + n % 5, 1)] for n in range(1, 201)}
    t = {
        **seed,
        "solicitud": spark.createDataFrame(orders, seed["solicitud"].schema),
        "detalle_solicitud": spark.createDataFrame([(n, n, p, q, D(1), D(q)) for n, cart in lines.items() for p, q in cart], seed["detalle_solicitud"].schema),
    }
    first = [(n, START + timedelta(minutes=n % 7), life.STATUS, n, "Rechazada" if n % 3 else "Aprobada", None) for n in range(1, 201)]
    second = [(1000 + n, START + timedelta(minutes=9), life.CANCEL, n, None, None) for n in range(1, 201) if n % 4 == 0]
    second += [(2000 + n, START + timedelta(minutes=10 + n % 2), life.STATUS, n, "Rechazada", None) for n in range(1, 201) if n % 2 == 0]
    log = intake.intake_log(spark, str(tmp_path / "log"), t).stream("life").create()
    query = life.run_commands(commands(spark, first, second), log, str(tmp_path / "ck"), delay="1 hour")
    query.awaitTermination()
    want, states, _, refused = replayed(dict(rows(seed["producto"], "id_producto", "stock_actual")), {o[0]: o[2] for o in orders}, lines, first + second, False)
    assert stock_of(log) == want
    assert dict(rows(intake.current_orders(log), "id_solicitud", "estado")) == states
    assert log.logged("rechazo").filter("pedido <> '-1'").count() == len(refused) == 50
    assert 4 <= sum(state.numRowsTotal for state in query.lastProgress.stateOperators) < 20


def test_commands_beyond_the_watermark_are_counted(spark, seed, tmp_path):
    """A change that comes after the watermark has passed it changes nothing, and the progress has its number."""
    log = intake.intake_log(spark, str(tmp_path / "log"), seed).stream("life").create()
    first = [(1, START + timedelta(days=9), life.STATUS, 2, "Aprobada", None)]
    second = [(2, START + timedelta(days=20), life.STATUS, 2, "Rechazada", None)]
    late = [(3, START, life.STATUS, 2, "Aprobada", None), (4, START, life.CANCEL, 2, None, None)]
    query = life.run_commands(commands(spark, first, second, late), log, str(tmp_path / "ck"), delay="1 hour")
    query.awaitTermination()
    assert dict(rows(intake.current_orders(log), "id_solicitud", "estado"))[2] == "Rechazada"
    assert dropped_rows(query.recentProgress) == 2


def test_odd_documents_take_no_stock(spark, seed, tmp_path):
    log = seed_log(spark, seed, str(tmp_path / "log"))
    unpriced = json.loads(order(24, 5, "700", (3, 1), (2, -1)))
    del unpriced["carrito"][0]["precio"]
    batch = [
        order(None, 1, "700", (3, 5)),
        order(20, 2, "700", (3, 3)), order(20, 2, "700", (3, 3)), order(20, 3, "700", (3, 9)),
        json.dumps({**json.loads(order(21, 1, "700", (3, 5))), "ts": None}),
        order(2, 1, "700", (3, 5)),  # stored already
        json.dumps(unpriced),
    ]
    def documents(*new):
        return spark.createDataFrame([(v, None) for v in batch] + [(None, n) for n in new], intake.DOCUMENTS)

    for batch_id, new in ((0, (2, 20, 24)), (0, (2, 20, 24)), (1, ())):  # run again, then sent again
        intake.take_orders(documents(*new), batch_id, log)
    taken = 199 - stock_of(log)[3]
    pieces = log.logged("detalle_solicitud").agg(F.sum("cantidad")).first()[0]
    assert taken == pieces == 3
    assert rows(log.logged("solicitud"), "id_solicitud", "total") == [(20, D("6.00"))]
    first = spark.read.parquet(f"{log.root}/rechazo/source=orders/batch=0")
    assert sorted(rows(first), key=str) == sorted(
        [("2", "repetido"), ("20", "repetido"), ("20", "repetido"), ("21", "fecha"), ("24", "cantidad,precio"), (None, "pedido")], key=str)
    again = spark.read.parquet(f"{log.root}/rechazo/source=orders/batch=1")
    assert rows(again.filter("pedido = '20'"), "motivo") == [("repetido",)] * 3


def test_carts_are_opened_once_and_an_order_has_one_owner(spark, seed, tmp_path, monkeypatch):
    plans = {}

    def watched(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return stage(df, label)

    monkeypatch.setattr(intake, "stage", watched)
    twin = seed["persona"].orderBy("id_persona").limit(1)
    log = seed_log(spark, {**seed, "persona": seed["persona"].unionByName(twin.withColumn("id_persona", F.col("id_persona") + 1000))}, str(tmp_path / "log"))
    document = order(20, 2, twin.first().cedula, (3, 3), (1, 1))
    intake.take_orders(spark.createDataFrame([(document, None), (None, 20)], intake.DOCUMENTS), 0, log)
    assert "Generate" in plans["carts"] and "Generate" not in plans["accepted"]
    assert sorted(rows(log.logged("detalle_solicitud"), "id_producto", "cantidad")) == [(1, 1), (3, 3)]
    assert rows(log.logged("solicitud"), "id_solicitud", "total") == [(20, D("8.00"))]


def test_an_empty_batch_changes_nothing(spark, seed, tmp_path):
    log = seed_log(spark, seed, str(tmp_path / "log"))
    before = stock_of(log)
    intake.take_orders(spark.createDataFrame([], intake.DOCUMENTS), 0, log)
    assert stock_of(log) == before and log.logged("solicitud").count() == log.logged("rechazo").count() == 0


def test_ids_met_in_earlier_batches_are_repeats(spark, seed, tmp_path):
    """Ids live in Spark's state, for as long as documents may still repeat them; then a late one is refused."""
    log = intake.intake_log(spark, str(tmp_path / "log"), seed)
    feed = tmp_path / "orders"
    feed.mkdir()

    def send(name, *documents):
        (feed / name).write_text("\n".join(documents))
        stream = intake.once(spark.readStream.text(str(feed)), "1 day")
        intake.run(stream, log, intake.take_orders, str(tmp_path / "ck")).awaitTermination()

    day = 24 * 60
    send("a.json", order(30, 1, "700", (3, 1)), order(2, 1, "700", (3, 1)))
    send("b.json", order(30, 2, "700", (3, 5)), order(31, 2 * day, "700", (3, 2)))
    send("c.json", order(31, 2 * day + 5, "700", (3, 5)), order(32, 5, "700", (3, 5)), order(33, 2 * day, "700", (3, 4)))
    assert sorted(rows(log.logged("solicitud"), "id_solicitud")) == [(30,), (31,), (33,)]
    assert 199 - stock_of(log)[3] == 1 + 2 + 4
    assert sorted(rows(log.logged("rechazo"))) == [("2", "repetido"), ("30", "repetido"), ("31", "repetido"), ("32", "repetido")]


def test_product_stream_equals_batch(spark, seed, tmp_path):
    """New products and changes in three batches, changes out of sequence; stock is left as it is."""
    feed = []
    for seq in range(60):
        number = None if seq % 7 == 0 else 1 + seq % 6  # 6 is not there at first
        feed.append((seq, START + timedelta(minutes=seq), number, f"C{seq}" if seq % 2 else None, f"nombre {seq}", "M", "A", "T", "1", D(seq), seq % 9))
    schema = ("seq long, ts timestamp_ntz, id_producto long, codigo string, nombre string, marca_repuesto string, marca_carro string, "
              "transmision string, compra string, precio decimal(12,2), stock int")
    df = spark.createDataFrame(feed, schema)
    log = intake.intake_log(spark, str(tmp_path / "log"), seed)
    order_of = F.when(F.col("id_producto").isNull() | (F.col("id_producto") == 6), F.col("seq")).otherwise((F.col("seq") * 17) % 60)
    arriving = in_batches(df.withColumn("at", order_of), "at", 3).drop("at")
    for _ in range(2):
        intake.run(arriving, log, intake.take_products, str(tmp_path / "ck")).awaitTermination()
    want = stock.upsert_products(df.filter("id_producto IS NULL OR id_producto <> 6"), seed["producto"])
    columns = ("id_producto", "codigo", "nombre_producto", "descripcion", "precio", "stock_actual")
    got = intake.current_products(log)
    known = rows(want.filter("id_producto <> 6"), *columns)
    assert sorted(rows(got.filter("id_producto <> 6"), *columns), key=str) == sorted(known, key=str)
    # The product made from seq 0 is number 6, and changes that came in later batches count.
    assert rows(got.filter("id_producto = 6"), "nombre_producto", "stock_actual") == [("nombre 59", 0)]


def test_batches_come_in_as_many_files_as_their_rows_ask_for(spark, monkeypatch):
    monkeypatch.setattr(runner, "ROWS_A_FILE", 20)
    df = spark.range(100).withColumn("at", F.when(F.col("id") < 90, F.col("id") % 30).otherwise(F.lit(60)))
    seen = []
    query = in_batches(df, "at", 2, df.limit(1)).writeStream.foreachBatch(lambda b, k: seen.append((b.count(), b.rdd.getNumPartitions()))).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [n for n, _ in seen] == [90, 0, 10, 1] and seen[0][1] > 1


def test_large_batches_come_in_files_of_a_task(spark, monkeypatch, tmp_path):
    """Beyond some files a core, a file takes what a task does; every row arrives in its batch."""
    monkeypatch.setattr(runner, "ROWS_A_FILE", 1)
    monkeypatch.setattr(runner, "ROWS_A_TASK", 10)
    most = runner.FILES_A_CORE * spark.sparkContext.defaultParallelism
    for rows_there, files in ((100, most), (20 * most, 2 * most)):
        folder, seen = tmp_path / str(files), []
        monkeypatch.setattr(runner, "scratch_path", lambda _: str(folder))
        stream = in_batches(spark.range(rows_there), "id", 1)
        assert [len(list(part.glob("*.parquet"))) for part in sorted(folder.glob("part=*"))] == [files, files]
        stream.writeStream.foreachBatch(lambda b, k: seen.append(b.count())).trigger(availableNow=True).start().awaitTermination()
        assert seen == [rows_there, 0]


def test_windowed_sales_come_out_for_all_days(spark):
    data = [(n, START + timedelta(hours=n), "Entregada" if n % 2 else "Pendiente", D(n)) for n in range(240)]
    schema = "id_solicitud long, fecha_solicitud timestamp_ntz, estado string, total decimal(12,2)"
    orders = spark.createDataFrame(data, schema)
    # Three too late, two of them for one window; an order without a date and one not delivered do not count.
    late = spark.createDataFrame(
        [(999, START, "Entregada", D(1000)), (998, START, "Entregada", D(1)), (997, START + timedelta(days=1), "Entregada", D(1)),
         (996, None, "Entregada", D(1)), (995, START, "Pendiente", D(1))], schema)
    arriving = in_batches(orders, "fecha_solicitud", 3, late)
    windows, missed = sales.sales_to_end(arriving, "1 day", "1 day")
    got = dict(rows(windows, "desde", "ventas"))
    assert missed == 3
    want = {}
    for _, ts, state, total in data:
        if state == "Entregada":
            day = datetime(ts.year, ts.month, ts.day)
            want[day] = want.get(day, 0) + total
    assert got == want


def test_alert_stream_equals_batch(spark):
    data = [(n % 3, START + timedelta(minutes=n), "venta" if n % 4 else "recepcion", n, -(n % 5) if n % 4 else n % 7) for n in range(240)]
    moves = spark.createDataFrame(data, "id_producto long, ts timestamp_ntz, tipo string, ref long, cantidad long")
    opening = spark.createDataFrame([(0, 30), (1, 9)], "id_producto long, stock_actual int")
    closing = spark.createDataFrame([(None, START + timedelta(days=2), 0)], "id_producto long, ts timestamp_ntz, cantidad long")
    dropped = spark.createDataFrame([(0, START, -1000)], closing.schema)
    arriving = in_batches(moves.select("id_producto", "ts", "cantidad"), "ts", 3, closing, dropped)
    got = run_to_end(alerts.stream_alerts(relay(alerts.minute_sums(arriving, "10 minutes"), "minutes"), opening), "alerts")
    known = stock.stock_ledger(moves.filter("id_producto < 2"), opening)
    columns = ("id_producto", "ts", "cantidad", "saldo")
    want = sorted(rows(stock.low_stock_crossings(known), *columns))
    assert sorted(rows(got, *columns)) == want and want


def test_sums_and_balances_keep_their_state_outside_the_heap(spark, monkeypatch, tmp_path):
    """State of all queries run to their end is RocksDB's, of bounded memory, whatever the session's own stores are."""
    folders = iter("abcdefgh")
    monkeypatch.setattr(runner, "scratch_path", lambda _: str(tmp_path / next(folders)))
    data = [(n % 3, START + timedelta(minutes=n), -n) for n in range(30)]
    moves = spark.createDataFrame(data, "id_producto long, ts timestamp_ntz, cantidad long")
    opening = spark.createDataFrame([(0, 30), (1, 9)], "id_producto long, stock_actual int")
    before = {name: spark.conf.get(name, None) for name in runner._STATE}
    minutes = relay(alerts.minute_sums(in_batches(moves, "ts", 2), "1 minute"), "minutes")
    assert run_to_end(alerts.stream_alerts(minutes, opening), "alerts").count() == 2
    assert {name: spark.conf.get(name, None) for name in runner._STATE} == before
    for query in (tmp_path / "b", tmp_path / "c"):
        stores = {p.suffix for p in (query / "checkpoint" / "state" / "0").rglob("*.*") if not p.name.startswith(("_", "."))}
        assert ".zip" in stores and not stores & {".delta", ".snapshot"}
        offsets = "".join(p.read_text() for p in (query / "checkpoint" / "offsets").iterdir() if p.name.isdigit())
        assert runner._STATE["spark.sql.streaming.stateStore.providerClass"] in offsets


def test_alerts_keep_one_state_for_64_products(spark, tmp_path):
    """Over several batches and keys, beside a product that has no stock given."""
    data = [(n % 150 - 10, START + timedelta(minutes=n // 150), "venta", n, -(n % 4)) for n in range(3000)]
    moves = spark.createDataFrame(data, "id_producto long, ts timestamp_ntz, tipo string, ref long, cantidad long")
    opening = spark.createDataFrame([(p, None if p == 7 else 5 + p % 30) for p in range(-10, 140)], "id_producto long, stock_actual int")
    minutes = in_batches(moves.select("id_producto", F.col("ts").cast("timestamp").alias("ts"), "cantidad"), "ts", 3)
    out = str(tmp_path / "alerts")
    query = alerts.stream_alerts(minutes, opening).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    columns = ("id_producto", "ts", "cantidad", "saldo")
    want = sorted(rows(stock.low_stock_crossings(stock.stock_ledger(moves, opening)), *columns))
    assert sorted(rows(spark.read.parquet(out), *columns)) == want and len({r[0] for r in want}) > 64
    assert query.lastProgress.stateOperators[0].numRowsTotal == 4  # ids from -64, 0, 64 and 128


def test_batches_are_written_in_one_go(spark, monkeypatch):
    """No job more for more files, and the rows are computed once."""
    monkeypatch.setattr(runner, "ROWS_A_FILE", 2)
    made = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            made.add(part.num_rows)
            yield part

    df = spark.range(60).mapInArrow(count, "id long")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("batches", "batches")
    stream = in_batches(df, "id", 3, spark.range(90, 91))
    jobs = len(tracker.getJobIdsForGroup("batches"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert made.value == 60 and jobs < 30
    seen = []
    stream.writeStream.foreachBatch(lambda b, k: seen.append(sorted(r.id for r in b.collect()))).trigger(availableNow=True).start().awaitTermination()
    assert [len(ids) for ids in seen] == [20, 0, 20, 20, 1] and sum(seen, []) == [*range(60), 90]


def test_code_stream_equals_batch(spark):
    kinds = [validity.ISSUED, validity.TRIED, validity.CONSUMED, validity.TRIED]
    data = [(n, (n * 7) % 5, START + timedelta(seconds=97 * n, microseconds=n * 1111), kinds[(n * n // 3) % 4]) for n in range(300)]
    # A code issued before an empty batch, and an attempt that another user's event has passed already.
    data += [(900, 7, START, validity.ISSUED), (901, 8, START + timedelta(minutes=6), validity.CONSUMED), (902, 7, START + timedelta(minutes=5), validity.TRIED)]
    schema = "event_id long, id_usuario long, ts timestamp_ntz, tipo string"
    feed = spark.createDataFrame(data, schema)
    end = START + timedelta(days=2)
    closing = [
        spark.createDataFrame([(-1, -1, end + timedelta(days=d), k) for k in (validity.ISSUED, validity.TRIED)], schema) for d in (0, 2)
    ]
    late = spark.createDataFrame([(999, 7, START, validity.TRIED)], schema)
    got = run_to_end(codes.stream_validity(in_batches(feed, "event_id", 3, *closing, late), delay="2 days"), "codes")
    want = dict(rows(validity.code_validity(feed), "event_id", "valido"))
    assert dict(rows(got.filter("event_id >= 0"), "event_id", "valido")) == want
    assert want[902] and any(want.values()) and not all(want.values())


def test_streams_need_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Caracas")
    try:
        with pytest.raises(ValueError):
            require_utc(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
