"""Change operators against row-by-row replays of their rules, and edge rows."""

import random
from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfline.operators import allocation, cascade, people, running, status, stock, validity
from shelfline.schema import FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS, SET_NULL, ForeignKey

START = datetime(2026, 1, 1)

LINE = "id_solicitud long, ts timestamp_ntz, id_producto long, cantidad int, precio_unitario decimal(12,2)"


def replay_orders(lines, stocks):
    """The rule order by order: all lines or nothing; a line of 0 changes no row and fails."""
    stocks, accepted = dict(stocks), set()
    carts = {}
    for order, ts, product, quantity, _ in lines:
        carts.setdefault((ts, order), []).append((product, quantity))
    for (_, order), cart in sorted(carts.items()):
        trial = dict(stocks)
        for product, quantity in cart:
            have = trial.get(product)
            if quantity is None or quantity < 1 or have is None or have < quantity:
                break
            trial[product] = have - quantity
        else:
            stocks = trial
            accepted.add(order)
    return accepted, stocks


def random_orders(rng, orders, products, hot=False):
    lines = []
    for order in range(orders):
        ts = START + timedelta(minutes=rng.randrange(orders // 3 + 1))
        for _ in range(rng.randint(1, 4)):
            product = 0 if hot and rng.random() < 0.6 else rng.randrange(products + (rng.random() < 0.05))
            quantity = rng.choice([1, 1, 2, 3, 5, 8]) if rng.random() > 0.03 else rng.choice([0, -1])
            lines.append((order, ts, product, quantity, D("2.50")))
    return lines


@pytest.mark.parametrize("trial", range(4))
def test_confirm_orders_equals_replay(spark, split, trial):
    rng = random.Random(trial * 7)
    lines = random_orders(rng, 120, 8, hot=True)
    stocks = {p: rng.choice([None, 0, 5, 20, 60, 500]) for p in range(8)}
    stocks[0] = 150
    products = spark.createDataFrame(list(stocks.items()), "id_producto long, stock_actual int")
    result = allocation.confirm_orders(spark.createDataFrame(lines, LINE), products)
    accepted, left = replay_orders(lines, stocks)
    assert {r[0] for r in rows(result.accepted, "id_solicitud")} == accepted
    assert {r[0] for r in rows(result.rejected)} == {line[0] for line in lines} - accepted
    assert dict(rows(result.producto)) == left


def test_long_chain_of_dependent_orders(spark):
    # Order n takes the last unit of product n and wants one of product n - 1.
    count = 40
    lines = [(0, START, 0, 1, D(1))]
    for n in range(1, count):
        lines += [(n, START + timedelta(minutes=n), n - 1, 1, D(1)), (n, START + timedelta(minutes=n), n, 1, D(1))]
    products = spark.createDataFrame([(n, 1) for n in range(count)], "id_producto long, stock_actual int")
    result = allocation.confirm_orders(spark.createDataFrame(lines, LINE), products)
    assert {r[0] for r in rows(result.accepted, "id_solicitud")} == set(range(0, count, 2))
    assert result.rounds > count / 2


def test_an_order_stands_at_its_earliest_line(spark):
    # Order 1 begins before order 2, though its line of product 0 is later.
    later = START + timedelta(minutes=9)
    lines = [(1, START, 1, 1, D(1)), (1, later, 0, 1, D(1)), (2, START + timedelta(minutes=1), 0, 1, D(1))]
    products = spark.createDataFrame([(0, 1), (1, 1)], "id_producto long, stock_actual int")
    result = allocation.confirm_orders(spark.createDataFrame(lines, LINE), products)
    assert rows(result.rejected) == [(2,)]


def test_nothing_contended(spark):
    feed = spark.createDataFrame([(1, START, 1, 2, D(1)), (1, START, 1, 2, D(1))], LINE)
    enough = spark.createDataFrame([(1, 4)], "id_producto long, stock_actual int")
    short = spark.createDataFrame([(1, 3)], "id_producto long, stock_actual int")
    assert rows(allocation.confirm_orders(feed, enough).producto) == [(1, 0)]
    assert rows(allocation.confirm_orders(feed, short).producto) == [(1, 3)]


def test_append_orders(spark):
    accepted = spark.createDataFrame(
        [(1, START, 7, 2, D("1.25"), 9, D(99)), (1, START, 8, 1, D("3.00"), 9, None)],
        LINE + ", id_cliente long, subtotal decimal(12,2)")
    headers, lines = allocation.append_orders(accepted)
    assert rows(headers) == [(1, START, "Pendiente", D("5.50"), 9)]
    assert sorted(rows(lines, "id_producto", "subtotal")) == [(7, D("2.50")), (8, D("3.00"))]


def test_receipts(spark):
    products = spark.createDataFrame([(1, 5), (2, None)], "id_producto long, stock_actual int")
    feed = spark.createDataFrame(
        [(1, "3"), (1, " 4 "), (1, "0"), (1, "-2"), (1, "x"), (1, None), (None, "1"), (9, "1"), (2, "1")],
        "id_producto long, cantidad string")
    changed, booked, rejects = stock.apply_receipts(feed, products)
    assert dict(rows(changed)) == {1: 12, 2: None}
    assert booked.count() == 3
    assert sorted(r[0] for r in rows(rejects, "motivo")) == ["cantidad"] * 3 + ["datos"] * 2 + ["producto"]


def replay_status(changes, states, strict):
    names = {"En Proceso": "Aprobada", "Completada": "Entregada"}
    offered = {("Pendiente", "Aprobada"), ("Pendiente", "Rechazada"), ("Aprobada", "Entregada")}
    states, steps, returns = dict(states), [], {}
    for event, ts, order, name in sorted(changes, key=lambda c: (c[1], c[0])):
        new = names.get(name, name)
        if order not in states or new not in ("Pendiente", "Aprobada", "Rechazada", "Entregada"):
            continue
        old = states[order]
        if strict and (old, new) not in offered:
            continue
        if new == "Rechazada" and old != "Rechazada":
            returns[order] = returns.get(order, 0) + 1
        steps.append((event, old, new))
        states[order] = new
    return states, steps, returns


@pytest.mark.parametrize("mode", status.MODES)
@pytest.mark.parametrize("seed", [1_000_000, 20])
def test_status_equals_replay(spark, split, mode, seed):
    rng = random.Random(seed)
    states = {n: rng.choice(["Pendiente", "Pendiente", "Aprobada", "Rechazada", "Entregada", None]) for n in range(20)}
    changes = [
        (n, START + timedelta(minutes=rng.randrange(60)), rng.choice([0, 0, 0, *range(22)]),
         rng.choice(["En Proceso", "Completada", "Aprobada", "Rechazada", "Rechazada", "Pendiente", "Nada", "", None]))
        for n in range(300)
    ]
    orders = spark.createDataFrame(list(states.items()), "id_solicitud long, estado string")
    lines = spark.createDataFrame([(n, n % 3, n + 1) for n in range(20)], "id_solicitud long, id_producto long, cantidad int")
    products = spark.createDataFrame([(n, 10) for n in range(3)], "id_producto long, stock_actual int")
    feed = spark.createDataFrame(changes, "event_id long, ts timestamp_ntz, id long, estado string")
    result = status.apply_status(feed, orders, lines, products, mode)
    final, steps, returns = replay_status(changes, states, mode == "strict")
    assert dict(rows(result.solicitud)) == final
    assert sorted(rows(result.steps, "event_id", "previo", "nuevo")) == sorted(steps)
    want = {n: 10 for n in range(3)}
    for order, times in returns.items():
        want[order % 3] += times * (order + 1)
    assert dict(rows(result.producto)) == want
    assert result.rejects.count() == len(changes) - len(steps)


def test_cancel_orders(seed, spark):
    ids = spark.createDataFrame([(1,), (2,), (2,), (77,)], "id_solicitud long")
    after = stock.cancel_orders(ids, seed)
    # Order 1 is rejected and gives nothing back; order 2 was delivered and does.
    assert dict(rows(after["producto"], "id_producto", "stock_actual")) == {1: 25, 2: 13, 3: 199, 4: 60, 5: 10}
    assert sorted(r[0] for r in rows(after["solicitud"], "id_solicitud")) == [3, 4, 5]
    assert sorted(r[0] for r in rows(after["detalle_solicitud"], "id_solicitud")) == [3, 4, 5]


def test_upsert_products(seed, spark):
    feed = spark.createDataFrame(
        [
            (1, 3, None, "viejo", "M", "C", "T", "1", "7.00", 1),
            (2, 3, None, "Filtro nuevo", "M", "C", "T", "2", "8.00", 2),
            (3, None, "N-1", "Nuevo", "M", None, "T", None, "9.00", 4),
            (4, None, "", "Sin código", "M", "C", "T", "1", "1.00", 0),
            (5, 99, None, "nadie", "M", "C", "T", "1", "1.00", 1),
        ],
        "seq long, id_producto long, codigo string, nombre string, marca_repuesto string, marca_carro string, "
        "transmision string, compra string, precio string, stock int",
    )
    got = {r["id_producto"]: r for r in stock.upsert_products(feed, seed["producto"]).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7]
    assert (got[3]["nombre_producto"], got[3]["precio"], got[3]["stock_actual"], got[3]["codigo"]) == (
        "Filtro nuevo", D("8.00"), 199, "PROD-03")
    assert got[3]["descripcion"] == (
        '{"marca_repuesto":"M","marca_vehiculo":"C","transmision":"T","precio_compra":"2","codigo":""}')
    assert (got[6]["codigo"], got[6]["stock_actual"], got[6]["id_categoria"]) == ("N-1", 4, None)
    assert '"marca_vehiculo":"","transmision":"T","precio_compra":"0"' in got[6]["descripcion"]
    assert got[7]["codigo"] == "PROD-7"
    assert got[1]["descripcion"] is None


def test_delete_products_and_categories(seed, spark):
    after = stock.delete_products(spark.createDataFrame([(2,)], "id_producto long"), seed)
    assert after["producto"].count() == 4 and after["detalle_solicitud"].count() == 5
    after = stock.remove_categories(spark.createDataFrame([(3,)], "id_categoria long"), seed)
    assert after["categoria"].count() == 4
    assert dict(rows(after["producto"], "id_producto", "id_categoria")) == {1: None, 2: 4, 3: 5, 4: 2, 5: None}


def test_removal_follows_the_list_of_keys(seed, spark, monkeypatch):
    """Every row that hangs on a removed one by CASCADE goes, whatever lies between; SET NULL goes no further."""
    data = {name: [r.asDict() for r in df.collect()] for name, df in seed.items()}

    def plain(table, ids):
        left, gone = {n: [dict(r) for r in rs] for n, rs in data.items()}, [(table, i) for i in ids]
        while gone:
            name, number = gone.pop()
            left[name] = [r for r in left[name] if r[PRIMARY_KEYS[name]] != number]
            for fk in FOREIGN_KEYS:
                for r in [r for r in left[fk.child] if fk.parent == name and r[fk.column] == number]:
                    if fk.on_delete == SET_NULL:
                        r[fk.column] = None
                    else:
                        gone.append((fk.child, r[PRIMARY_KEYS[fk.child]]))
        return left

    for table, ids in (("persona", [2, 4, 6, 99]), ("categoria", [3, 4]), ("producto", [2, 5]), ("solicitud", [1]), ("cliente", [1, 2]), ("usuario", [2]), ("persona", [])):
        key = PRIMARY_KEYS[table]
        after, want = cascade.remove_rows(table, spark.createDataFrame([(i,) for i in ids * 2], f"{key} long"), seed), plain(table, ids)
        assert set(after) == {table, *(child for child, _ in cascade.reached(table))}
        for name, df in after.items():
            assert df.columns == seed[name].columns
            assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(tuple(r.values())) for r in want[name]), (table, name)
        assert all(want[name] == data[name] for name in data if name not in after)
    assert [child for child, _ in cascade.reached("persona")] == ["cliente", "usuario", "empleado", "solicitud", "detalle_solicitud"]
    monkeypatch.setattr(cascade, "FOREIGN_KEYS", (*FOREIGN_KEYS, ForeignKey("solicitud", "id_solicitud", "detalle_solicitud")))
    with pytest.raises(ValueError):
        cascade.reached("cliente")


def test_several_ids_are_numbered_at_once(spark, split):
    data = [(i, i % 3 == 0, i % 2 == 0, 900 + i) for i in range(200)]
    df = spark.createDataFrame(data, "seq long, a boolean, b boolean, y long").repartition(7)
    got = {r.seq: r for r in running.number_each(df, ["seq"], {"x": ("a", 10), "y": ("b", 0)}).collect()}
    assert [got[i].x for i in range(200)] == [10 + i // 3 + 1 if i % 3 == 0 else None for i in range(200)]
    assert [got[i].y for i in range(200)] == [i // 2 + 1 if i % 2 == 0 else 900 + i for i in range(200)]
    assert running.highest_of((df, "seq"), (df.limit(0), "seq")) == [199, 0]


def test_ledger_and_low_stock(spark):
    def moves(*data):
        return spark.createDataFrame(
            [(p, START + timedelta(minutes=m), r, q) for p, m, r, q in data],
            "id_producto long, ts timestamp_ntz, ref long, cantidad int")

    all_moves = stock.movements(
        moves((1, 1, 1, 4), (1, 3, 2, 3), (1, 5, 3, 2), (2, 1, 4, 1)), moves((1, 2, 1, 6)), moves((1, 4, 1, 1)))
    opening = spark.createDataFrame([(1, 6)], "id_producto long, stock_actual int")
    ledger = stock.stock_ledger(all_moves, opening)
    got = sorted(rows(ledger.filter("id_producto = 1"), "ts", "tipo", "saldo"))
    assert [r[1:] for r in got] == [
        ("venta", 2), ("recepcion", 8), ("venta", 5), ("devolucion", 6), ("venta", 4)]
    assert sorted(rows(stock.low_stock_crossings(ledger), "id_producto", "ref")) == [(1, 1), (1, 3)]


def test_code_validity(spark, split):
    def at(minute, second=0, micro=0):
        return START + timedelta(minutes=minute, seconds=second, microseconds=micro)

    events = [
        (1, 7, at(0, 0, 900_000), "emitido"),
        (2, 7, at(14, 59), "intento"),
        (3, 7, at(15, 0, 100_000), "intento"),  # expiry is not after the attempt
        (4, 7, at(20), "emitido"),
        (5, 7, at(21), "consumido"),
        (6, 7, at(22), "intento"),
        (7, 7, at(23), "emitido"),
        (8, 7, at(37, 59), "intento"),
        (9, 8, at(1), "intento"),
        (10, 8, at(2), "emitido"),
        (11, 8, at(3), "emitido"),
        (12, 8, at(17, 30), "intento"),
    ]
    feed = spark.createDataFrame(events, "event_id long, id_usuario long, ts timestamp_ntz, tipo string")
    got = dict(rows(validity.code_validity(feed), "event_id", "valido"))
    assert got == {2: True, 3: False, 6: False, 8: True, 9: False, 12: True}


def norm(text):
    return text.lower().rstrip(" ")


def test_resolve_customers_equals_replay(spark):
    for trial in range(2):
        rng = random.Random(trial)
        persona = [(n, f"C{n}", f"P{n}", None, None) for n in range(1, 7)]
        cliente = [(n * 3, n) for n in (1, 2, 5)]
        feed = [
            (n, START + timedelta(minutes=rng.randrange(10)), rng.choice([" c{}", "C{} ", "\tc{}\n"]).format(rng.randrange(1, 14)),
             f" <N{n}> ", rng.choice([None, "calle & 1"]), None)
            for n in range(60)
        ]
        result = people.resolve_customers(
            spark.createDataFrame(feed, "id_solicitud long, ts timestamp_ntz, cedula string, nombre string, direccion string, telefono string"),
            spark.createDataFrame(persona, SCHEMAS["persona"]),
            spark.createDataFrame(cliente, SCHEMAS["cliente"]),
        )
        persons, clients, want = {norm(p[1]): p[0] for p in persona}, {p: c for c, p in cliente}, {}
        new_p, new_c = [], []
        next_p, next_c = 7, 16
        for order, ts, ced, name, addr, _ in sorted(feed, key=lambda f: (f[1], f[0])):
            ced = ced.strip(" \t\n")
            if norm(ced) not in persons:
                persons[norm(ced)] = next_p
                new_p.append((next_p, ced, f"&lt;N{order}&gt;", addr and "calle &amp; 1", None))
                next_p += 1
            person = persons[norm(ced)]
            if person not in clients:
                clients[person] = next_c
                new_c.append((next_c, person))
                next_c += 1
            want[order] = clients[person]
        assert dict(rows(result.feed, "id_solicitud", "id_cliente")) == want
        assert sorted(rows(result.new_persona)) == new_p
        assert sorted(rows(result.new_cliente)) == new_c


def replay_staff(feed, persona, mails, variant):
    persons, used = {norm(p): n for n, p in persona}, {norm(m) for m in mails}
    created, accepted, rejected = [], [], {}
    for seq, ced, name, mail, role in feed:
        if variant != "direct" and role != "Administrador":
            rejected[seq] = "permiso"
        elif norm(mail) in used or (variant == "direct" and norm(ced) in persons):
            rejected[seq] = "otro"
        else:
            if variant == "anonymous" or norm(ced) not in persons:
                number = 100 + len(created) + 1
                created.append((number, name))
                if variant == "anonymous":
                    ced = f"auto {seq}"
                persons[norm(ced)] = number
            used.add(norm(mail))
            accepted.append((seq, mail, persons[norm(ced)]))
    return created, accepted, rejected


@pytest.mark.parametrize("variant", people.STAFF_VARIANTS)
def test_register_staff_equals_replay(spark, variant):
    rng = random.Random(len(variant))
    persona = [(n, f"c{n}") for n in range(1, 6)] + [(100, "c100")]
    mails = ["m1@x", "M2@X "]
    feed = [
        (n, rng.choice(["c{}", "C{} "]).format(rng.randrange(1, 16)), f"N{n}",
         rng.choice(["m{}@x", "M{}@X"]).format(rng.randrange(1, 14)),
         rng.choice(["Administrador", "Administrador", "Empleado", None]))
        for n in range(50)
    ]
    now = START
    t = {
        "persona": spark.createDataFrame([(n, c, "p", None, None) for n, c in persona], SCHEMAS["persona"]),
        "usuario": spark.createDataFrame([(n, m, "h", "Empleado", now, 1) for n, m in enumerate(mails)], SCHEMAS["usuario"]),
        "empleado": spark.createDataFrame([(4, "Operador", 1)], SCHEMAS["empleado"]),
    }
    df = spark.createDataFrame(
        [(s, now, c, n, m, "h", r) for s, c, n, m, r in feed],
        "seq long, ts timestamp_ntz, cedula string, nombre string, email string, clave_hash string, role_solicitante string")
    change = people.register_staff(df, t, variant)
    created, accepted, rejected = replay_staff(feed, persona, mails, variant)
    assert sorted(rows(change.persona, "id_persona", "nombre")) == created
    assert sorted(rows(change.usuario, "id_usuario", "correo", "id_persona")) == [
        (n + 2, mail, person) for n, (_, mail, person) in enumerate(accepted)]
    assert {r[0] for r in rows(change.usuario, "rol")} == {"Empleado"}
    want_staff = [(n + 5, "Operador", n + 2) for n in range(len(accepted))] if variant == "managed" else []
    assert sorted(rows(change.empleado)) == want_staff
    assert {r[0] for r in rows(change.rejects, "seq")} == set(rejected)


def test_missing_document_number_is_made_up(spark, seed):
    df = spark.createDataFrame(
        [(1, START, None, "A", "a@x", "h", "Administrador"), (2, START, None, "B", "b@x", "h", "Administrador")],
        "seq long, ts timestamp_ntz, cedula string, nombre string, email string, clave_hash string, role_solicitante string")
    made = rows(people.register_staff(df, seed).persona, "cedula")
    assert len(set(made)) == 2 and all(len(c) == 13 for (c,) in made)


def test_remove_users(seed, spark):
    ids = spark.createDataFrame([(2,)], "id_usuario long")
    only = people.remove_users(ids, seed)
    assert (only["usuario"].count(), only["empleado"].count()) == (1, 0)
    # Give the user's person a customer with an order, and a second user.
    t = dict(seed)
    t["cliente"] = seed["cliente"].withColumn("id_persona", F.when(F.col("id_cliente") == 2, 3).otherwise(F.col("id_persona")).cast("long"))
    second = seed["usuario"].filter("id_usuario = 2").withColumn("id_usuario", F.lit(9).cast("long"))
    t["usuario"] = seed["usuario"].unionByName(second)
    after = {name: df.count() for name, df in people.remove_users(ids, t, with_person=True).items()}
    assert after == {"persona": 7, "usuario": 1, "empleado": 0, "cliente": 4, "solicitud": 4, "detalle_solicitud": 5}


def test_set_roles(seed, spark):
    by_mail = people.set_roles(spark.createDataFrame([("AYUDA@example.org ",)], "correo string"), seed["usuario"], "Administrador")
    assert dict(rows(by_mail, "id_usuario", "rol")) == {1: "Administrador", 2: "Administrador"}
    by_id = people.set_roles(spark.createDataFrame([(1,)], "id_usuario long"), seed["usuario"])
    assert dict(rows(by_id, "id_usuario", "rol")) == {1: "Empleado", 2: "Empleado"}
    assert by_id.columns == seed["usuario"].columns
