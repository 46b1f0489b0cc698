"""SQL counterparts of the registered queries, for DuckDB over the same files."""

from __future__ import annotations

import re

# The retail tables as views, the same expressions as in ``standin``.
VIEWS = {
    "categoria": "SELECT CAST(r_regionkey AS BIGINT) AS id_categoria, r_name AS nombre_categoria FROM region",
    "producto": """
SELECT p_partkey AS id_producto, 'PROD-' || p_partkey AS codigo, p_name AS nombre_producto,
  CASE p_partkey % 5
    WHEN 1 THEN 'texto libre'
    WHEN 2 THEN '[1,2]'
    WHEN 3 THEN '{"marca_repuesto":"' || p_brand || '","marca_vehiculo":"' || p_type || '","codigo":""}'
    WHEN 4 THEN '{"marca_repuesto":"' || p_brand || '","marca_vehiculo":"' || p_type
      || '","transmision":"Automática","precio_compra":' || p_size || ',"codigo":"C-' || p_partkey || '"}'
  END AS descripcion,
  CAST(p_retailprice AS DECIMAL(12,2)) AS precio, p_size % 25 AS stock_actual,
  p_brand AS marca_repuesto, p_type AS marca_carro, CAST(2010 + p_partkey % 17 AS VARCHAR) AS ano,
  CASE p_partkey % 3 WHEN 0 THEN 'Automática' WHEN 1 THEN 'Sincrónica' ELSE 'No aplica' END AS transmision,
  'default.jpg' AS imagen, nullif(p_partkey % 6, 5) AS id_categoria
FROM part""",
    "persona": """
SELECT c_custkey AS id_persona, CAST(10000000 + c_custkey AS VARCHAR) AS cedula, c_name AS nombre,
  n_name AS direccion,
  CASE WHEN c_custkey % 7 <> 0 THEN '0412' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS telefono
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "cliente": "SELECT c_custkey AS id_cliente, c_custkey AS id_persona FROM customer",
    "usuario": """
SELECT s_suppkey AS id_usuario, s_name AS correo,
  CASE WHEN s_suppkey = 0 THEN 'Administrador' ELSE 'Empleado' END AS rol, s_suppkey * 10 AS id_persona
FROM supplier""",
    "empleado": "SELECT s_suppkey + 1 AS id_empleado, 'Operador' AS cargo, s_suppkey AS id_usuario FROM supplier",
    "solicitud": """
SELECT o_orderkey AS id_solicitud, o_orderdate AS fecha_solicitud,
  CASE WHEN o_orderstatus = 'O' THEN 'Pendiente' WHEN o_orderstatus = 'F' THEN 'Entregada'
    WHEN o_orderpriority = '5-LOW' THEN 'Rechazada' ELSE 'Aprobada' END AS estado,
  CAST(o_totalprice AS DECIMAL(12,2)) AS total, o_custkey AS id_cliente
FROM orders""",
    "detalle_solicitud": """
SELECT l_orderkey AS id_solicitud, l_partkey AS id_producto, CAST(l_quantity AS INTEGER) AS cantidad,
  CAST(l_extendedprice AS DECIMAL(12,2)) AS subtotal
FROM lineitem""",
    "detalle_con_precio": """
SELECT id_solicitud, id_producto, cantidad, subtotal, precio AS precio_unitario
FROM detalle_solicitud JOIN producto USING (id_producto)""",
    "cambios_estado": """
SELECT event_id, ts, user_id AS id,
  CASE event_type WHEN 'signup' THEN 'Pendiente' WHEN 'click' THEN 'En Proceso' WHEN 'view' THEN 'Aprobada'
    WHEN 'purchase' THEN 'Completada' WHEN 'error' THEN 'Rechazada' END AS estado
FROM events""",
    "recepciones": """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS id_producto,
  CAST(floor(value) AS INTEGER) % 10 AS cantidad, ts
FROM events WHERE event_type = 'view'""",
    "codigos": """
SELECT event_id, ts, user_id AS id_usuario,
  CASE event_type WHEN 'click' THEN 'emitido' WHEN 'purchase' THEN 'intento' ELSE 'consumido' END AS tipo
FROM events WHERE event_type IN ('click', 'purchase', 'error')""",
    # Product attributes out of the description's JSON object.
    "atributos": """
SELECT *, CASE WHEN descripcion LIKE '{%' THEN json_extract_string(descripcion, '$.marca_repuesto') END AS j_marca,
  CASE WHEN descripcion LIKE '{%' THEN json_extract_string(descripcion, '$.marca_vehiculo') END AS j_carro,
  CASE WHEN descripcion LIKE '{%' THEN json_extract_string(descripcion, '$.transmision') END AS j_trans,
  CASE WHEN descripcion LIKE '{%' THEN json_extract_string(descripcion, '$.precio_compra') END AS j_compra,
  CASE WHEN descripcion LIKE '{%' THEN json_extract_string(descripcion, '$.codigo') END AS j_codigo
FROM producto""",
    "inventario": """
SELECT id_producto, nombre_producto, descripcion, CAST(precio AS DOUBLE) AS precio, stock_actual,
  CASE WHEN coalesce(j_codigo, '') IN ('', '0', 'false', '[]', '{}') THEN 'PROD-' || id_producto
    ELSE j_codigo END AS codigo,
  coalesce(j_marca, 'N/A') AS marca_repuesto, coalesce(j_carro, 'N/A') AS marca_carro,
  coalesce(j_trans, 'N/A') AS transmision, coalesce(j_compra, '0') AS compra
FROM atributos""",
    "lista": """
SELECT id_solicitud, estado, CAST(total AS DOUBLE) AS total,
  strftime(fecha_solicitud, '%Y-%m-%d %H:%M') AS fecha, nombre AS cliente
FROM solicitud JOIN cliente USING (id_cliente) JOIN persona USING (id_persona)""",
    "items": """
SELECT d.id_solicitud, count(p.nombre_producto) AS productos, CAST(sum(d.cantidad) AS BIGINT) AS total_items
FROM detalle_solicitud d LEFT JOIN producto p ON p.id_producto = d.id_producto GROUP BY d.id_solicitud""",
    "pedidas": """
SELECT event_id, CAST(10000000 + user_id * 11 AS VARCHAR)
  || CASE WHEN event_type = 'click' THEN ' ' ELSE '' END AS cedula
FROM events""",
    "transiciones": """
SELECT event_id, ts, id, coalesce(lag(nuevo) OVER w, actual) AS previo, nuevo
FROM (SELECT event_id, ts, id, s.estado AS actual,
    CASE c.estado WHEN 'En Proceso' THEN 'Aprobada' WHEN 'Completada' THEN 'Entregada' ELSE c.estado END AS nuevo
  FROM cambios_estado c JOIN solicitud s ON s.id_solicitud = c.id)
WINDOW w AS (PARTITION BY id ORDER BY ts, event_id)""",
    "comandos": """
SELECT event_id, ts, CASE WHEN event_id % 501 = 0 THEN 'anular' WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'recepcion' ELSE 'estado' END AS tipo,
  user_id AS id, CASE event_type WHEN 'signup' THEN 'Pendiente' WHEN 'error' THEN 'Rechazada' WHEN 'purchase' THEN 'Entregada' ELSE 'Aprobada' END AS estado,
  CAST(floor(value) AS INTEGER) % 10 AS cantidad
FROM events""",
    "anuladas": """
SELECT id, min({'ts': ts, 'event_id': event_id}) AS fin FROM comandos WHERE tipo = 'anular' AND id IN (SELECT id_solicitud FROM solicitud) GROUP BY id""",
    "pasos_vivos": """
SELECT event_id, ts, id, tipo, nuevo, coalesce(lag(nuevo) OVER (PARTITION BY id ORDER BY ts, event_id), actual) AS previo FROM (
  SELECT c.event_id, c.ts, c.id, c.tipo, c.estado AS nuevo, s.estado AS actual
  FROM comandos c JOIN solicitud s ON s.id_solicitud = c.id LEFT JOIN anuladas a ON a.id = c.id
  WHERE c.tipo IN ('estado', 'anular') AND (a.fin IS NULL OR {'ts': c.ts, 'event_id': c.event_id} <= a.fin))""",
    "faltas_persona": "SELECT * REPLACE (CASE WHEN id_persona % 13 = 0 THEN '9 ' ELSE cedula END AS cedula) FROM persona",
    "faltas_usuario": """
SELECT * REPLACE (CASE WHEN id_usuario % 7 = 0 THEN 'Jefe' ELSE rol END AS rol, CASE WHEN id_usuario % 11 <> 0 THEN correo END AS correo) FROM usuario""",
    "faltas_solicitud": """
SELECT * REPLACE (CASE WHEN id_solicitud % 10 = 0 THEN 'Anulada' ELSE estado END AS estado,
  CASE WHEN id_solicitud % 9 <> 0 THEN id_cliente ELSE -id_solicitud END AS id_cliente) FROM solicitud""",
    "vencidas": """
SELECT id_solicitud, estado FROM solicitud
WHERE estado <> 'Entregada' AND fecha_solicitud < TIMESTAMP '1999-01-01'""",
    "movimientos": """
SELECT id_producto, ts, tipo, ref, CAST(sum(cantidad) AS BIGINT) AS cantidad FROM (
  SELECT l_partkey AS id_producto, l_shipdate AS ts, 'venta' AS tipo, l_orderkey AS ref,
    -CAST(l_quantity AS BIGINT) AS cantidad FROM lineitem
  UNION ALL SELECT id_producto, ts, 'recepcion', event_id, cantidad FROM recepciones
  UNION ALL SELECT id_producto, fecha_solicitud, 'devolucion', id_solicitud, cantidad
    FROM detalle_solicitud JOIN solicitud USING (id_solicitud) WHERE estado = 'Rechazada')
GROUP BY ALL""",
    "libro": """
SELECT m.*, CAST(sum(cantidad) OVER (PARTITION BY id_producto ORDER BY ts, tipo, ref) AS BIGINT)
  + coalesce(p.stock_actual, 0) AS saldo
FROM movimientos m LEFT JOIN (SELECT id_producto AS pid, stock_actual FROM producto) p ON pid = id_producto""",
    "pedidos": """
SELECT o_orderkey AS id_solicitud, o_orderdate AS ts,
  CAST(CASE WHEN o_custkey % 5 = 0 THEN 50000000 ELSE 10000000 END + o_custkey AS VARCHAR) AS cedula,
  '&lt;' || o_orderpriority || '&gt; &amp; &#039;co&#039;' AS nombre,
  '&quot;' || o_orderstatus || '&quot;' AS direccion, o_custkey, o_custkey % 5 <> 0 AS conocida FROM orders""",
    "primeros": """
SELECT * FROM pedidos QUALIFY row_number() OVER (PARTITION BY cedula ORDER BY ts, id_solicitud) = 1""",
    "personas_resueltas": """
SELECT cedula, nombre, direccion, ts, id_solicitud, conocida, CASE WHEN conocida THEN o_custkey ELSE
  (SELECT max(c_custkey) FROM customer)
  + sum(CASE WHEN conocida THEN 0 ELSE 1 END) OVER (ORDER BY ts, id_solicitud) END AS id_persona
FROM primeros""",
    "clientes_resueltos": """
SELECT *, CASE WHEN conocida THEN id_persona ELSE
  (SELECT max(c_custkey) FROM customer)
  + sum(CASE WHEN conocida THEN 0 ELSE 1 END) OVER (ORDER BY ts, id_solicitud) END AS id_cliente
FROM personas_resueltas""",
    "bajas": "SELECT s_suppkey AS id_usuario, s_suppkey * 10 AS id_persona FROM supplier WHERE s_acctbal < 0",
    "pasos_1": """
SELECT id, actual, min(CASE WHEN actual = 'Pendiente' AND nuevo IN ('Aprobada', 'Rechazada')
  THEN {'ts': ts, 'event_id': event_id, 'nuevo': nuevo} END) AS paso
FROM (SELECT t.*, s.estado AS actual FROM transiciones t JOIN solicitud s ON s.id_solicitud = t.id)
GROUP BY id, actual""",
    "cambios_producto": """
SELECT event_id AS seq, CASE WHEN event_type <> 'signup' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS id_producto,
  'nombre ' || user_id AS nombre,
  '{"marca_repuesto":"Marca","marca_vehiculo":"","transmision":"Automática","precio_compra":"' || user_id
    || '","codigo":"' || CASE WHEN event_type = 'signup' THEN 'N-' || event_id ELSE '' END || '"}' AS texto,
  CAST(value AS DECIMAL(12,2)) AS precio, CAST(floor(value) AS INTEGER) % 10 AS stock
FROM events""",
}

# The staff feed under each rule: who may ask, which document number counts, who comes first.
_MADE_UP = "left(sha256(event_id || '|' || email), 13)"
_NUMBER = f"CASE WHEN event_type <> 'view' THEN CAST(10000000 + user_id * 20 AS VARCHAR) ELSE {_MADE_UP} END"
for _variant, _number, _asks, _free in (
    ("managed", _NUMBER, "event_type IN ('error', 'signup')", "true"),
    ("anonymous", _MADE_UP, "event_type IN ('error', 'signup')", "true"),
    ("direct", _NUMBER, "false", "cedula NOT IN (SELECT cedula FROM persona)"),
):
    VIEWS[f"personal_{_variant}"] = f"""
SELECT *, motivo IS NULL AND {_free} AS libre FROM (
  SELECT event_id AS seq, ts, {_number} AS cedula, 'Persona ' || user_id AS nombre, email,
    CASE WHEN {_asks} THEN 'permiso'
      WHEN lower(email) IN (SELECT 'u' || s_suppkey || '@example.org' FROM supplier) THEN 'correo' END AS motivo
  FROM (SELECT *, CASE WHEN event_type = 'click' THEN upper('u' || user_id || '@example.org')
    ELSE 'u' || user_id || '@example.org' END AS email FROM events))"""
    VIEWS[f"altas_{_variant}"] = f"""
SELECT * FROM personal_{_variant} WHERE libre QUALIFY row_number() OVER (PARTITION BY lower(email) ORDER BY seq) = 1"""
    VIEWS[f"personas_{_variant}"] = f"""
SELECT cedula, nombre, (SELECT max(id_persona) FROM persona) + row_number() OVER (ORDER BY seq) AS id_persona
FROM (SELECT * FROM altas_{_variant} WHERE cedula NOT IN (SELECT cedula FROM persona)
  QUALIFY row_number() OVER (PARTITION BY cedula ORDER BY seq) = 1)"""

# One element per order in sequence, each with its summed lines.
VIEWS["carritos"] = """
SELECT list({'libre': CAST([] AS BIGINT[]), 'aceptadas': [id_solicitud], 'lineas': lineas} ORDER BY ts, id_solicitud) AS pasos
FROM (SELECT id_solicitud, any_value(fecha_solicitud) AS ts, list({'p': id_producto, 'q': q}) AS lineas
  FROM (SELECT id_solicitud, id_producto, CAST(sum(cantidad) AS BIGINT) AS q FROM detalle_solicitud GROUP BY ALL)
  JOIN solicitud USING (id_solicitud) GROUP BY id_solicitud)"""

# The orders taken one after another: stock per product (ids count from 0) and accepted ids.
for _times in (1, 20):
    VIEWS[f"reparto_{_times}"] = f"""
SELECT list_reduce(pasos, lambda acc, x:
  CASE WHEN len(list_filter(x.lineas, lambda l: l.q > acc.libre[l.p + 1])) > 0 THEN acc
  ELSE {{'libre': list_transform(acc.libre, lambda s, i: s
      - coalesce(list_sum(list_transform(list_filter(x.lineas, lambda l: l.p + 1 = i), lambda l: l.q)), 0)),
    'aceptadas': list_concat(acc.aceptadas, x.aceptadas), 'lineas': acc.lineas}} END,
  {{'libre': libre, 'aceptadas': CAST([] AS BIGINT[]), 'lineas': CAST([] AS STRUCT(p BIGINT, q BIGINT)[])}}) AS f
FROM carritos, (SELECT list(CAST(stock_actual * {_times} AS BIGINT) ORDER BY id_producto) AS libre FROM producto)"""

_SQL = {
    "catalog": """
SELECT i.id_producto, i.codigo, i.nombre_producto, i.descripcion, i.precio, i.stock_actual, i.marca_repuesto,
  i.marca_carro, p.ano, i.transmision, p.imagen, p.id_categoria
FROM inventario i JOIN producto p USING (id_producto) WHERE p.stock_actual > 0""",
    "inventory": "SELECT * FROM inventario ORDER BY id_producto DESC",
    "facet_search": """
SELECT i.id_producto, i.codigo, i.nombre_producto, i.marca_repuesto AS marca, i.marca_carro AS modelo,
  p.transmision, p.ano, i.precio, i.stock_actual
FROM inventario i JOIN producto p USING (id_producto)
WHERE p.stock_actual > 0 AND contains(lower(i.nombre_producto), 'ring') AND i.marca_carro = 'ECONOMY'
  AND contains(lower(i.marca_carro), 'eco') AND p.transmision = 'Sincrónica'""",
    "stock_search": """
SELECT * FROM inventario
WHERE contains(lower(nombre_producto || ' ' || marca_repuesto || ' ' || marca_carro || ' ' || codigo), 'ring brand#1')
  AND stock_actual < 5 ORDER BY id_producto DESC""",
    "any_field_search": """
SELECT * FROM inventario WHERE contains(lower(codigo), 'c-1') OR contains(lower(nombre_producto), 'c-1')
  OR contains(lower(marca_repuesto), 'c-1') OR contains(lower(marca_carro), 'c-1')
ORDER BY id_producto DESC""",
    "inventory_report": """
SELECT id_producto, nombre_producto, marca_repuesto AS marca, stock_actual, CAST(precio AS DOUBLE) AS precio,
  CASE WHEN stock_actual < 5 THEN 'stock-alert' ELSE 'stock-ok' END AS nivel,
  CAST(precio * stock_actual AS DOUBLE) AS valor
FROM producto WHERE contains(lower(marca_repuesto), 'brand#1') ORDER BY stock_actual, id_producto""",
    "full_inventory_report": """
SELECT id_producto, nombre_producto, marca_repuesto AS marca, stock_actual, CAST(precio AS DOUBLE) AS precio,
  CASE WHEN stock_actual < 5 THEN 'stock-alert' ELSE 'stock-ok' END AS nivel,
  CAST(precio * stock_actual AS DOUBLE) AS valor
FROM producto ORDER BY stock_actual, id_producto""",
    "low_stock_report": """
SELECT id_producto, nombre_producto, marca_repuesto AS marca, stock_actual, CAST(precio AS DOUBLE) AS precio,
  'stock-alert' AS nivel, CAST(precio * stock_actual AS DOUBLE) AS valor
FROM producto WHERE stock_actual < 5 ORDER BY stock_actual, id_producto""",
    "inventory_stats": """
SELECT count(*) FILTER (WHERE stock_actual < 5) AS critico,
  CAST(coalesce(sum(precio * stock_actual), 0) AS DOUBLE) AS valor_inventario, count(*) AS total_productos,
  CAST(CAST(sum(precio * stock_actual) AS DECIMAL(38,2)) AS VARCHAR) AS valor_texto
FROM producto""",
    "stock_by_category": """
SELECT p.id_categoria, c.nombre_categoria AS marca, CAST(sum(p.stock_actual) AS BIGINT) AS cantidad
FROM producto p LEFT JOIN categoria c USING (id_categoria) GROUP BY p.id_categoria, c.nombre_categoria
ORDER BY cantidad DESC NULLS LAST, p.id_categoria NULLS FIRST LIMIT 5""",
    "order_list": "SELECT * FROM lista ORDER BY id_solicitud DESC",
    "order_sheet": """
SELECT id_solicitud, '#' || lpad(CAST(id_solicitud AS VARCHAR), CAST(greatest(4, length(CAST(id_solicitud AS VARCHAR))) AS INTEGER), '0') AS numero,
  cliente, left(fecha, 10) AS dia, estado,
  CASE estado WHEN 'Aprobada' THEN 'proceso' WHEN 'Entregada' THEN 'completada' ELSE lower(estado) END AS clase, total
FROM lista ORDER BY id_solicitud DESC""",
    "order_search": """
SELECT * FROM lista WHERE contains(lower(cliente), 'customer#00000001') AND estado = 'Aprobada'
ORDER BY id_solicitud DESC""",
    "order_lines": """
SELECT id_producto, id_solicitud, cantidad, CAST(precio_unitario AS DOUBLE) AS precio_unitario,
  CAST(subtotal AS DOUBLE) AS subtotal, i.nombre_producto, i.codigo
FROM detalle_con_precio JOIN inventario i USING (id_producto)""",
    "order_lines_of": """
SELECT id_producto, id_solicitud, cantidad, CAST(precio_unitario AS DOUBLE) AS precio_unitario,
  CAST(subtotal AS DOUBLE) AS subtotal, i.nombre_producto, i.codigo
FROM detalle_con_precio JOIN inventario i USING (id_producto)
WHERE id_solicitud IN (SELECT id_solicitud FROM solicitud WHERE estado = 'Aprobada')""",
    "latest_orders": """
SELECT id_solicitud, nombre AS cliente, CAST(total AS DOUBLE) AS total, fecha_solicitud AS fecha
FROM solicitud JOIN cliente USING (id_cliente) JOIN persona USING (id_persona)
ORDER BY id_solicitud DESC LIMIT 5""",
    "order_board": """
SELECT s.id_solicitud, p.nombre AS cliente, coalesce(p.telefono, 'N/A') AS telefono, p.direccion,
  coalesce(u.correo, 'N/A') AS correo, s.estado, coalesce(i.productos, 0) AS productos,
  coalesce(i.total_items, 0) AS total_items
FROM solicitud s JOIN cliente c ON c.id_cliente = s.id_cliente JOIN persona p ON p.id_persona = c.id_persona
LEFT JOIN usuario u ON u.id_persona = p.id_persona LEFT JOIN items i ON i.id_solicitud = s.id_solicitud
ORDER BY s.id_solicitud DESC""",
    "order_items": """
SELECT id_solicitud, nombre_producto, count(*) AS lineas, CAST(sum(cantidad) AS BIGINT) AS cantidad
FROM detalle_solicitud JOIN producto USING (id_producto) WHERE nombre_producto IS NOT NULL GROUP BY ALL""",
    "cart_totals": """
SELECT id_solicitud, CAST(sum(cantidad * precio_unitario) AS DOUBLE) AS total
FROM detalle_con_precio GROUP BY id_solicitud""",
    "merge_lines": """
SELECT id_solicitud, id_producto, CAST(sum(cantidad) AS BIGINT) AS cantidad,
  sum(cantidad) <= max(stock_actual) AS alcanza
FROM detalle_solicitud JOIN producto USING (id_producto) GROUP BY id_solicitud, id_producto""",
    "price_orders": """
SELECT d.id_producto, d.id_solicitud, d.cantidad, CAST(p.precio AS DOUBLE) AS precio,
  CAST(p.precio * d.cantidad AS DOUBLE) AS total, p.id_producto IS NOT NULL AS conocido
FROM (SELECT id_solicitud, cantidad, CASE WHEN id_solicitud % 7 = 0 THEN -id_producto - 1 ELSE id_producto END AS id_producto
  FROM detalle_solicitud) d LEFT JOIN producto p ON p.id_producto = d.id_producto""",
    "derive_totals": """
SELECT s.id_solicitud, s.fecha_solicitud, s.estado, CAST(coalesce(t.total, 0) AS DOUBLE) AS total, s.id_cliente
FROM solicitud s LEFT JOIN (SELECT id_solicitud, sum(cantidad * precio_unitario) AS total
  FROM detalle_con_precio GROUP BY id_solicitud) t ON t.id_solicitud = s.id_solicitud""",
    "derive_subtotals": """
SELECT id_producto, id_solicitud, cantidad, CAST(cantidad * precio_unitario AS DOUBLE) AS subtotal,
  CAST(precio_unitario AS DOUBLE) AS precio_unitario
FROM detalle_con_precio""",
    "customer_directory": """
SELECT c.id_cliente, p.nombre, p.telefono, coalesce(u.correo, 'N/A') AS correo, p.direccion
FROM cliente c JOIN persona p ON p.id_persona = c.id_persona LEFT JOIN usuario u ON u.id_persona = p.id_persona
WHERE contains(strip_accents(lower(p.nombre)), 'customer#0000000') OR contains(p.cedula, 'customer#0000000')
  OR contains(p.telefono, 'customer#0000000')""",
    "customer_directory_like": """
SELECT c.id_cliente, p.nombre, p.telefono, coalesce(u.correo, 'N/A') AS correo, p.direccion
FROM cliente c JOIN persona p ON p.id_persona = c.id_persona LEFT JOIN usuario u ON u.id_persona = p.id_persona
WHERE lower(p.nombre) LIKE '%customer#%1_3%' OR p.cedula LIKE '%customer#%1_3%' OR p.telefono LIKE '%customer#%1_3%'""",
    "customer_history": """
SELECT id_cliente, id_solicitud, fecha_solicitud, nombre_producto AS producto, marca_carro AS carro, cantidad,
  CAST(subtotal AS DOUBLE) AS total, estado
FROM detalle_solicitud JOIN solicitud USING (id_solicitud) JOIN producto USING (id_producto)
ORDER BY fecha_solicitud DESC, id_solicitud""",
    "lookup_customers": """
SELECT k.cedula, p.id_persona IS NOT NULL AS existe, p.nombre
FROM pedidas k LEFT JOIN persona p ON p.cedula = rtrim(k.cedula)""",
    "known_customers": "SELECT * FROM pedidas WHERE rtrim(cedula) IN (SELECT cedula FROM persona)",
    "new_customers": "SELECT * FROM pedidas WHERE rtrim(cedula) NOT IN (SELECT cedula FROM persona)",
    "user_directory": """
SELECT u.id_usuario, u.correo, u.rol, coalesce(nullif(p.nombre, ''), u.correo) AS nombre
FROM usuario u JOIN persona p ON p.id_persona = u.id_persona""",
    "users": "SELECT id_usuario, correo, rol FROM usuario",
    "set_roles": """
SELECT id_usuario, correo, CASE WHEN s_acctbal < 0 THEN 'Administrador' ELSE rol END AS rol, id_persona
FROM usuario JOIN supplier ON s_suppkey = id_usuario""",
    "remove_persons_persona": """
SELECT * FROM persona WHERE id_persona NOT IN (SELECT id_persona FROM bajas)""",
    "remove_persons_usuario": """
SELECT * FROM usuario WHERE id_persona NOT IN (SELECT id_persona FROM bajas)""",
    "remove_persons_empleado": """
SELECT * FROM empleado WHERE id_usuario NOT IN (SELECT id_usuario FROM bajas)""",
    "remove_persons_cliente": """
SELECT * FROM cliente WHERE id_persona NOT IN (SELECT id_persona FROM bajas)""",
    "remove_persons_solicitud": """
SELECT id_solicitud, fecha_solicitud, estado, CAST(total AS DOUBLE) AS total, id_cliente FROM solicitud
WHERE id_cliente NOT IN (SELECT id_persona FROM bajas)""",
    "remove_persons_detalle_solicitud": """
SELECT id_solicitud, id_producto, cantidad, CAST(subtotal AS DOUBLE) AS subtotal FROM detalle_solicitud
WHERE id_solicitud NOT IN (SELECT id_solicitud FROM solicitud WHERE id_cliente IN (SELECT id_persona FROM bajas))""",
    "remove_users_usuario": """
SELECT * FROM usuario WHERE id_usuario NOT IN (SELECT id_usuario FROM bajas)""",
    "remove_users_empleado": """
SELECT * FROM empleado WHERE id_usuario NOT IN (SELECT id_usuario FROM bajas)""",
    "resolve_customers": """
SELECT CAST(c.id_persona AS BIGINT) AS id_persona, CAST(c.id_cliente AS BIGINT) AS id_cliente,
  o.id_solicitud, o.cedula, CASE WHEN NOT c.conocida THEN c.cedula END AS cedula_nueva,
  CASE WHEN NOT c.conocida THEN c.nombre END AS nombre_nuevo,
  CASE WHEN NOT c.conocida THEN c.direccion END AS direccion_nueva
FROM pedidos o JOIN clientes_resueltos c ON c.cedula = o.cedula""",
    "dashboard_metrics": """
SELECT (SELECT count(*) FROM producto) AS productos,
  (SELECT count(*) FROM solicitud WHERE estado = 'Pendiente') AS pendientes,
  CAST(coalesce((SELECT sum(total) FROM solicitud WHERE estado = 'Entregada'), 0) AS DOUBLE) AS ventas,
  format('{:,.2f}', CAST((SELECT sum(total) FROM solicitud WHERE estado = 'Entregada') AS DOUBLE)) AS ventas_texto""",
    # The month labels.
    "monthly_sales": """
SELECT CAST(month(fecha_solicitud) AS INTEGER) AS mes,
  (['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic'])[month(fecha_solicitud)] AS etiqueta,
  CAST(sum(total) AS DOUBLE) AS ventas
FROM solicitud WHERE estado = 'Entregada' AND year(fecha_solicitud) = 2000
GROUP BY month(fecha_solicitud) ORDER BY mes""",
    "frequent_customers": """
SELECT c.id_cliente, p.nombre, count(s.id_solicitud) AS pedidos, CAST(sum(s.total) AS DOUBLE) AS total_gastado
FROM cliente c JOIN persona p ON p.id_persona = c.id_persona JOIN solicitud s ON s.id_cliente = c.id_cliente
GROUP BY c.id_cliente, p.nombre ORDER BY sum(s.total) DESC NULLS LAST, c.id_cliente LIMIT 10""",
    "revenue_by_car": """
SELECT coalesce(marca_carro, 'N/A') AS marca_carro, CAST(sum(subtotal) AS DOUBLE) AS ingresos
FROM detalle_solicitud JOIN producto USING (id_producto) GROUP BY marca_carro ORDER BY sum(subtotal) DESC""",
    "unique_violations": """
SELECT l_orderkey AS id_solicitud, l_linenumber AS linea, count(*) AS veces
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    "orphans": """
SELECT l_orderkey AS id_solicitud, l_linenumber AS linea, l_partkey + 1000000 AS id_producto FROM lineitem
WHERE l_linenumber = 3 AND l_partkey + 1000000 NOT IN (SELECT id_producto FROM producto)""",
    "unique_text_violations": """
SELECT CASE WHEN event_type IN ('click', 'view') THEN 'user' || user_id ELSE 'user' || user_id || event_type END AS correo,
  count(*) AS veces
FROM events GROUP BY 1 HAVING count(*) > 1""",
    "reconcile_totals": """
SELECT id_solicitud, CAST(total AS DOUBLE) AS total, CAST(suma AS DOUBLE) AS suma_lineas,
  CAST(total - suma AS DOUBLE) AS diferencia,
  round(CAST(total AS DOUBLE) / nullif(CAST(suma AS DOUBLE), 0), 4) AS razon
FROM (SELECT s.id_solicitud, s.total, coalesce(d.suma, 0) AS suma FROM solicitud s LEFT JOIN
  (SELECT id_solicitud, sum(subtotal) AS suma FROM detalle_solicitud GROUP BY id_solicitud) d
  ON d.id_solicitud = s.id_solicitud)
WHERE total <> suma""",
    "null_violations": """
SELECT 'cedula' AS columna, count(*) AS filas, count(*) - count(cedula) AS nulos FROM persona
UNION ALL SELECT 'nombre', count(*), count(*) - count(nombre) FROM persona
UNION ALL SELECT 'direccion', count(*), count(*) - count(direccion) FROM persona
UNION ALL SELECT 'telefono', count(*), count(*) - count(telefono) FROM persona""",
    "domain_violations": """
SELECT event_id, ts, id, estado FROM cambios_estado
WHERE estado NOT IN ('Pendiente', 'Aprobada', 'Rechazada', 'Entregada')""",
    "validate_orders": """
SELECT event_id, concat_ws(',', CASE WHEN event_type = 'signup' THEN 'cedula' END,
  CASE WHEN event_type = 'error' THEN 'nombre' END, CASE WHEN event_type = 'view' THEN 'telefono' END,
  CASE WHEN CAST(floor(value) AS INTEGER) % 10 = 0 THEN 'cantidad' END,
  CASE WHEN event_type = 'purchase' THEN 'pedido' END, CASE WHEN event_id % 50 = 0 THEN 'fecha' END,
  CASE WHEN event_type = 'click' AND value > 0 THEN 'precio' END) AS motivos
FROM events""",
    "phone_numbers": """
SELECT event_id, CASE event_type WHEN 'click' THEN left('0412' || (user_id + 10000000), 15)
  WHEN 'view' THEN left((user_id + 10000000) || '' || (user_id + 10000000), 15) END AS telefono
FROM events""",
    "escape_html": """
SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '"', '&quot;'), '''', '&#039;'),
  '<', '&lt;'), '>', '&gt;') AS texto FROM pages""",
    "escape_documents": """
SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '"', '&quot;'), '''', '&#039;'),
  '<', '&lt;'), '>', '&gt;') AS texto FROM documents""",
    "validate_products": """
SELECT CASE WHEN event_type = 'view' THEN event_id END AS id_producto, 'C-' || event_id AS codigo,
  CASE WHEN event_type <> 'error' THEN 'pieza ' || event_type ELSE ' ' END AS nombre,
  CASE WHEN event_type <> 'click' THEN CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) END AS precio,
  CAST(floor(value) AS INTEGER) % 10 AS stock,
  CASE event_type WHEN 'error' THEN 'nombre' WHEN 'click' THEN 'precio' WHEN 'purchase' THEN 'marca_repuesto' ELSE '' END AS motivos
FROM events""",
    "json_round_trip": """
SELECT id_producto, nombre_producto, CAST(precio AS DOUBLE) AS precio, descripcion, id_categoria FROM producto""",
    "report_round_trip": """
SELECT id_producto, nombre_producto, marca_repuesto AS marca, stock_actual, CAST(precio AS DOUBLE) AS precio,
  CAST(precio * stock_actual AS DOUBLE) AS valor
FROM producto WHERE stock_actual < 5""",
    "table_round_trip": """
SELECT id_usuario, correo, rol, id_persona, CAST(NULL AS VARCHAR) AS codigo_recuperacion,
  CAST(NULL AS VARCHAR) AS expiracion_codigo FROM usuario""",
    "parse_orders": """
SELECT l_orderkey AS id_solicitud, l_shipdate AS ts, 0 AS linea, l_partkey AS id_producto,
  CAST(l_quantity AS INTEGER) AS cantidad,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS precio_unitario
FROM lineitem WHERE l_returnflag <> 'R'
UNION ALL SELECT l_orderkey, l_shipdate, 1, l_suppkey, l_linenumber,
  CAST(CAST(l_tax AS DECIMAL(12,2)) AS DOUBLE) FROM lineitem WHERE l_returnflag <> 'R'""",
    "parse_order_headers": """
SELECT l_orderkey AS id_solicitud, l_shipdate AS ts, '1' AS cedula, CAST(NULL AS VARCHAR) AS nombre,
  CAST(NULL AS VARCHAR) AS direccion, CAST(NULL AS VARCHAR) AS telefono
FROM lineitem WHERE l_returnflag <> 'R'""",
    "document_totals": """
SELECT l_orderkey AS id_solicitud, l_shipdate AS ts, 2 AS lineas, CAST(l_quantity AS INTEGER)::BIGINT + l_linenumber AS piezas,
  CAST(CAST(l_quantity AS INTEGER) * CAST(l_extendedprice AS DECIMAL(12,2)) + l_linenumber * CAST(l_tax AS DECIMAL(12,2)) AS DOUBLE) AS total
FROM lineitem WHERE l_returnflag <> 'R'""",
    "parse_order_rejects": """
SELECT '{"order_id":' || l_orderkey || ',"ts":"' || strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '","cedula":"1","carrito":[]}' AS value
FROM lineitem WHERE l_returnflag = 'R'""",
    "confirm_orders": """
SELECT id_solicitud, fecha_solicitud, 'Pendiente' AS estado, CAST(sum(cantidad * precio_unitario) AS DOUBLE) AS total,
  id_cliente
FROM detalle_con_precio JOIN solicitud USING (id_solicitud)
WHERE id_solicitud IN (SELECT unnest(f.aceptadas) FROM reparto_1) GROUP BY ALL""",
    "confirm_order_lines": """
SELECT id_solicitud, id_producto, cantidad, CAST(precio_unitario AS DOUBLE) AS precio_unitario,
  CAST(cantidad * precio_unitario AS DOUBLE) AS subtotal
FROM detalle_con_precio WHERE id_solicitud IN (SELECT unnest(f.aceptadas) FROM reparto_1)""",
    "confirm_orders_stock": """
SELECT generate_subscripts(f.libre, 1) - 1 AS id_producto, CAST(unnest(f.libre) AS INTEGER) AS stock_actual
FROM reparto_20""",
    "apply_receipts": """
SELECT p.id_producto, CAST(p.stock_actual + coalesce(r.cantidad, 0) AS INTEGER) AS stock_actual
FROM producto p LEFT JOIN (SELECT id_producto, sum(cantidad) AS cantidad FROM recepciones
  WHERE cantidad > 0 GROUP BY id_producto) r ON r.id_producto = p.id_producto""",
    "receipt_rejects": """
SELECT r.*, CASE WHEN cantidad <= 0 THEN 'cantidad' ELSE 'producto' END AS motivo FROM recepciones r
WHERE cantidad <= 0 OR id_producto NOT IN (SELECT id_producto FROM producto)""",
    "status_transitions": """
SELECT event_id, ts, id, previo, nuevo, nuevo = 'Rechazada' AND previo <> 'Rechazada' AS devuelve
FROM transiciones""",
    "apply_status": """
SELECT p.id_producto, CAST(p.stock_actual + coalesce(r.cantidad, 0) AS INTEGER) AS stock_actual
FROM producto p LEFT JOIN (SELECT id_producto, sum(cantidad) AS cantidad
  FROM transiciones t JOIN detalle_solicitud d ON d.id_solicitud = t.id
  WHERE nuevo = 'Rechazada' AND previo <> 'Rechazada' GROUP BY id_producto) r ON r.id_producto = p.id_producto""",
    "final_status": """
SELECT s.id_solicitud, coalesce(t.nuevo, s.estado) AS estado FROM solicitud s LEFT JOIN
  (SELECT id, arg_max(nuevo, ts) AS nuevo FROM transiciones GROUP BY id) t ON t.id = s.id_solicitud""",
    "status_rejects": """
SELECT * FROM (SELECT event_id, ts, id, estado,
    CASE WHEN id IS NULL OR coalesce(estado, '') = '' THEN 'datos'
      WHEN estado NOT IN ('Pendiente', 'Aprobada', 'Rechazada', 'Entregada') THEN 'estado'
      WHEN id NOT IN (SELECT id_solicitud FROM solicitud) THEN 'solicitud' END AS motivo
  FROM (SELECT event_id, ts,
      CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 11 = 0 THEN -id - 1 ELSE id END AS id,
      CASE WHEN event_id % 13 = 0 THEN 'Anulada' WHEN event_id % 19 = 0 THEN ''
        WHEN estado = 'En Proceso' THEN 'Aprobada' WHEN estado = 'Completada' THEN 'Entregada' ELSE estado END AS estado
    FROM cambios_estado))
WHERE motivo IS NOT NULL""",
    "strict_status_rejects": """
SELECT event_id, ts, id, CASE estado WHEN 'En Proceso' THEN 'Aprobada' WHEN 'Completada' THEN 'Entregada' ELSE estado END AS estado,
  CASE WHEN id IN (SELECT id_solicitud FROM solicitud) THEN 'transicion' ELSE 'solicitud' END AS motivo
FROM cambios_estado WHERE event_id NOT IN (
  SELECT paso.event_id FROM pasos_1 WHERE paso IS NOT NULL
  UNION ALL SELECT arg_min(t.event_id, t.ts) FROM transiciones t JOIN pasos_1 p ON p.id = t.id
  WHERE t.nuevo = 'Entregada' AND (p.actual = 'Aprobada' OR (p.paso.nuevo = 'Aprobada' AND t.ts > p.paso.ts)) GROUP BY t.id)""",
    "strict_status": """
SELECT paso.event_id AS event_id, paso.ts AS ts, id, 'Pendiente' AS previo, paso.nuevo AS nuevo,
  paso.nuevo = 'Rechazada' AS devuelve FROM pasos_1 WHERE paso IS NOT NULL
UNION ALL SELECT arg_min(t.event_id, t.ts), min(t.ts), t.id, 'Aprobada', 'Entregada', false
FROM transiciones t JOIN pasos_1 p ON p.id = t.id
WHERE t.nuevo = 'Entregada' AND (p.actual = 'Aprobada' OR (p.paso.nuevo = 'Aprobada' AND t.ts > p.paso.ts))
GROUP BY t.id""",
    "cancel_orders": """
SELECT p.id_producto, CAST(p.stock_actual + coalesce(r.cantidad, 0) AS INTEGER) AS stock_actual
FROM producto p
LEFT JOIN (SELECT id_producto, sum(cantidad) AS cantidad FROM detalle_solicitud JOIN vencidas USING (id_solicitud)
  WHERE estado <> 'Rechazada' GROUP BY id_producto) r ON r.id_producto = p.id_producto""",
    "cancel_orders_lines": """
SELECT id_solicitud, id_producto, cantidad, CAST(subtotal AS DOUBLE) AS subtotal FROM detalle_solicitud
WHERE id_solicitud NOT IN (SELECT id_solicitud FROM vencidas)""",
    "cancel_orders_left": """
SELECT id_solicitud, fecha_solicitud, estado, CAST(total AS DOUBLE) AS total, id_cliente FROM solicitud
WHERE id_solicitud NOT IN (SELECT id_solicitud FROM vencidas)""",
    "upsert_products": """
SELECT p.id_producto, p.codigo, coalesce(c.nombre, p.nombre_producto) AS nombre_producto,
  CASE WHEN c.seq IS NULL THEN p.descripcion ELSE c.texto END AS descripcion,
  CAST(coalesce(c.precio, p.precio) AS DOUBLE) AS precio, p.stock_actual, p.marca_repuesto, p.imagen
FROM producto p LEFT JOIN (SELECT * FROM cambios_producto WHERE id_producto IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id_producto ORDER BY seq DESC) = 1) c ON c.id_producto = p.id_producto
UNION ALL SELECT (SELECT max(id_producto) FROM producto) + row_number() OVER (ORDER BY seq),
  'N-' || seq, nombre, texto, CAST(precio AS DOUBLE), stock, NULL, 'foto-' || seq || '.jpg'
FROM cambios_producto WHERE id_producto IS NULL""",
    "delete_products": """
SELECT id_producto FROM producto WHERE stock_actual <> 0""",
    "delete_products_lines": """
SELECT id_solicitud, id_producto, cantidad, CAST(subtotal AS DOUBLE) AS subtotal FROM detalle_solicitud
WHERE id_producto NOT IN (SELECT id_producto FROM producto WHERE stock_actual = 0)""",
    "remove_categories": """
SELECT p.id_producto, CASE WHEN c.nombre_categoria LIKE 'A%' THEN NULL ELSE p.id_categoria END AS id_categoria
FROM producto p LEFT JOIN categoria c USING (id_categoria)""",
    "stock_ledger": "SELECT id_producto, ts, tipo, ref, cantidad, saldo FROM libro",
    "low_stock_crossings": """
SELECT id_producto, ts, tipo, ref, cantidad, saldo FROM libro WHERE saldo - cantidad >= 5 AND saldo < 5""",
    "code_validity": """
SELECT a.event_id, a.id_usuario, a.ts,
  CASE WHEN c.ts IS NULL OR c.ts < i.ts THEN i.ts END AS emitido_en,
  coalesce((c.ts IS NULL OR c.ts < i.ts) AND date_trunc('second', i.ts) + INTERVAL 15 MINUTE > date_trunc('second', a.ts), false) AS valido
FROM (SELECT * FROM codigos WHERE tipo = 'intento') a
ASOF LEFT JOIN (SELECT * FROM codigos WHERE tipo = 'emitido') i ON i.id_usuario = a.id_usuario AND i.ts <= a.ts
ASOF LEFT JOIN (SELECT * FROM codigos WHERE tipo = 'consumido') c ON c.id_usuario = a.id_usuario AND c.ts <= a.ts""",
    "stream_daily_sales": """
SELECT date_trunc('day', fecha_solicitud) AS desde, date_trunc('day', fecha_solicitud) + INTERVAL 1 DAY AS hasta,
  count(*) AS pedidos, CAST(sum(total) AS DOUBLE) AS ventas
FROM solicitud WHERE estado = 'Entregada'
GROUP BY 1, 2""",
    "stream_low_stock": """
SELECT id_producto, ts, cantidad, saldo FROM (
  SELECT id_producto, ts, cantidad, CAST(inicio + sum(cantidad) OVER (PARTITION BY id_producto ORDER BY ts) AS BIGINT) AS saldo
  FROM (SELECT id_producto, date_trunc('minute', ts) AS ts, CAST(sum(cantidad) AS BIGINT) AS cantidad FROM movimientos GROUP BY ALL)
  JOIN (SELECT id_producto, stock_actual * 20 AS inicio FROM producto) USING (id_producto))
WHERE saldo - cantidad >= 5 AND saldo < 5""",
    "stream_order_intake": """
SELECT id_solicitud, fecha_solicitud, 'Pendiente' AS estado, CAST(sum(cantidad * precio_unitario) AS DOUBLE) AS total,
  id_cliente
FROM detalle_con_precio JOIN solicitud USING (id_solicitud)
WHERE id_solicitud IN (SELECT unnest(f.aceptadas) FROM reparto_1) GROUP BY ALL""",
    "stream_order_effects": """
SELECT 'linea' AS tabla, id_solicitud AS id, id_producto, CAST(cantidad AS VARCHAR) AS valor FROM detalle_con_precio
WHERE id_solicitud IN (SELECT unnest(f.aceptadas) FROM reparto_1)
UNION ALL SELECT DISTINCT 'rechazo', id_solicitud, NULL, 'stock' FROM detalle_con_precio WHERE id_solicitud NOT IN (SELECT unnest(f.aceptadas) FROM reparto_1)
UNION ALL SELECT DISTINCT 'rechazo', id_solicitud, NULL, 'repetido' FROM detalle_con_precio WHERE id_solicitud % 50 = 0
UNION ALL SELECT 'producto', NULL, generate_subscripts(f.libre, 1) - 1, CAST(CAST(unnest(f.libre) AS INTEGER) AS VARCHAR) FROM reparto_1""",
    "stream_status": """
SELECT p.id_producto, CAST(p.stock_actual + coalesce(r.cantidad, 0) AS INTEGER) AS stock_actual
FROM producto p LEFT JOIN (SELECT id_producto, sum(cantidad) AS cantidad
  FROM transiciones t JOIN detalle_solicitud d ON d.id_solicitud = t.id
  WHERE nuevo = 'Rechazada' AND previo <> 'Rechazada' GROUP BY id_producto) r ON r.id_producto = p.id_producto""",
    "stream_order_life": """
SELECT 'producto' AS tabla, p.id_producto AS id, CAST(CAST(p.stock_actual + coalesce(sum(r.cantidad), 0) AS INTEGER) AS VARCHAR) AS valor
FROM producto p LEFT JOIN (
  SELECT id_producto, cantidad FROM pasos_vivos t JOIN detalle_solicitud d ON d.id_solicitud = t.id
  WHERE previo <> 'Rechazada' AND (tipo = 'anular' OR nuevo = 'Rechazada')
  UNION ALL SELECT id, cantidad FROM comandos WHERE tipo = 'recepcion' AND cantidad > 0) r ON r.id_producto = p.id_producto
GROUP BY p.id_producto, p.stock_actual
UNION ALL SELECT 'solicitud', s.id_solicitud, coalesce(u.nuevo, s.estado) FROM solicitud s
LEFT JOIN (SELECT id, arg_max(nuevo, {'ts': ts, 'event_id': event_id}) AS nuevo FROM pasos_vivos GROUP BY id) u ON u.id = s.id_solicitud
WHERE s.id_solicitud NOT IN (SELECT id FROM anuladas)""",
    "foreign_key_orphans": """
SELECT 'cliente' AS tabla, 'id_persona' AS columna, 'persona' AS referencia, count(*) AS huerfanas FROM cliente WHERE id_persona NOT IN (SELECT id_persona FROM persona)
UNION ALL SELECT 'detalle_solicitud', 'id_solicitud', 'solicitud', count(*) FROM detalle_solicitud WHERE id_solicitud NOT IN (SELECT id_solicitud FROM solicitud)
UNION ALL SELECT 'detalle_solicitud', 'id_producto', 'producto', count(*) FROM detalle_solicitud WHERE id_producto NOT IN (SELECT id_producto FROM producto)
UNION ALL SELECT 'empleado', 'id_usuario', 'usuario', count(*) FROM empleado WHERE id_usuario NOT IN (SELECT id_usuario FROM usuario)
UNION ALL SELECT 'producto', 'id_categoria', 'categoria', count(*) FROM producto WHERE id_categoria NOT IN (SELECT id_categoria FROM categoria)
UNION ALL SELECT 'solicitud', 'id_cliente', 'cliente', count(*) FROM faltas_solicitud WHERE id_cliente NOT IN (SELECT id_cliente FROM cliente)
UNION ALL SELECT 'usuario', 'id_persona', 'persona', count(*) FROM usuario WHERE id_persona NOT IN (SELECT id_persona FROM persona)""",
    "table_versions": """
SELECT id_usuario, correo, rol, id_persona, CASE WHEN id_usuario % 3 = 0 THEN 'R' || id_usuario END AS codigo_recuperacion,
  CASE WHEN id_usuario % 3 = 0 THEN '2026-01-01 00:00:00' END AS expiracion_codigo FROM usuario""",
    "stream_code_validity": """
SELECT a.event_id, a.id_usuario, a.ts,
  coalesce((c.ts IS NULL OR c.ts < i.ts) AND date_trunc('second', i.ts) + INTERVAL 15 MINUTE > date_trunc('second', a.ts), false) AS valido
FROM (SELECT * FROM codigos WHERE tipo = 'intento') a
ASOF LEFT JOIN (SELECT * FROM codigos WHERE tipo = 'emitido') i ON i.id_usuario = a.id_usuario AND i.ts <= a.ts
ASOF LEFT JOIN (SELECT * FROM codigos WHERE tipo = 'consumido') c ON c.id_usuario = a.id_usuario AND c.ts <= a.ts""",
}

_SQL["stream_products"] = _SQL["upsert_products"]

# Keys of each table, and whether it has them here: the order lines have no number of their own.
_KEYS = {
    "categoria": "id_categoria", "persona": "id_persona", "cliente": "id_cliente", "usuario": "id_usuario", "empleado": "id_empleado",
    "producto": "id_producto", "solicitud": "id_solicitud", "detalle_solicitud": "NULL",
}
_SQL["tables_round_trip"] = "\nUNION ALL ".join(
    f"SELECT '{_name}' AS tabla, count(*) AS filas, count(DISTINCT {_key}) AS claves, CAST(0 AS BIGINT) AS perdidas FROM {_name}" for _name, _key in _KEYS.items()
)

# Rule, table, column, and the rows that break it.
_RULES = [
    *[("nulo", table, column, f"count(*) - count({column})") for table, columns in (
        ("categoria", "id_categoria nombre_categoria"), ("persona", "id_persona cedula nombre"), ("cliente", "id_cliente"),
        ("usuario", "id_usuario correo rol id_persona"), ("empleado", "id_empleado"), ("producto", "id_producto codigo nombre_producto precio"),
        ("solicitud", "id_solicitud fecha_solicitud"), ("detalle_solicitud", "cantidad"),
    ) for column in columns.split()],
    ("dominio", "solicitud", "estado", "count(*) FILTER (estado NOT IN ('Pendiente', 'Aprobada', 'Rechazada', 'Entregada'))"),
    ("dominio", "usuario", "rol", "count(*) FILTER (rol NOT IN ('Administrador', 'Empleado', 'Cliente'))"),
    *[("unico", table, column, None) for table, columns in (
        ("categoria", "id_categoria"), ("persona", "id_persona cedula"), ("cliente", "id_cliente id_persona"), ("usuario", "id_usuario correo"),
        ("empleado", "id_empleado id_usuario"), ("producto", "id_producto codigo"), ("solicitud", "id_solicitud"),
    ) for column in columns.split()],
    *[("referencia", table, column, f"count(*) FILTER ({column} NOT IN (SELECT {key} FROM {parent}))") for table, column, parent, key in (
        ("cliente", "id_persona", "persona", "id_persona"), ("detalle_solicitud", "id_solicitud", "solicitud", "id_solicitud"),
        ("detalle_solicitud", "id_producto", "producto", "id_producto"), ("empleado", "id_usuario", "usuario", "id_usuario"),
        ("producto", "id_categoria", "categoria", "id_categoria"), ("solicitud", "id_cliente", "cliente", "id_cliente"),
        ("usuario", "id_persona", "persona", "id_persona"),
    )],
]


def _rule(rule: str, table: str, column: str, broken: str | None) -> str:
    rows = f"faltas_{table}" if table in ("persona", "usuario", "solicitud") else table
    if rule == "unico":
        broken = f"(SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM {rows} WHERE {column} IS NOT NULL GROUP BY {column} HAVING count(*) > 1))"
    return f"SELECT '{table}' AS tabla, '{rule}' AS regla, '{column}' AS columna, count(*) AS filas, {broken} AS fallos FROM {rows}"


_SQL["table_checks"] = "\nUNION ALL ".join(_rule(*rule) for rule in _RULES)

for _variant in ("managed", "anonymous", "direct"):
    _employee = (
        "(SELECT max(id_empleado) FROM empleado) + row_number() OVER (ORDER BY n.seq), 'Operador'"
        if _variant == "managed"
        else "CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR)"
    )
    _SQL["register_staff" if _variant == "managed" else f"register_staff_{_variant}"] = f"""
SELECT id_usuario, correo, rol, fecha_registro, id_persona, id_empleado, cargo, cedula, nombre, seq, motivo FROM (
  SELECT (SELECT max(id_usuario) FROM usuario) + row_number() OVER (ORDER BY n.seq), n.email, 'Empleado', n.ts,
    coalesce(c.id_persona, p.id_persona), {_employee}, c.cedula, c.nombre, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR)
  FROM altas_{_variant} n LEFT JOIN personas_{_variant} c ON c.cedula = n.cedula
  LEFT JOIN persona p ON p.cedula = n.cedula)
  AS a(id_usuario, correo, rol, fecha_registro, id_persona, id_empleado, cargo, cedula, nombre, seq, motivo)
UNION ALL SELECT NULL, email, NULL, NULL, NULL, NULL, NULL, cedula, nombre, seq, coalesce(motivo, 'repetido')
FROM personal_{_variant} WHERE seq NOT IN (SELECT seq FROM altas_{_variant})"""

_NAMES = re.compile(r"\b(" + "|".join(VIEWS) + r")\b")


def _needed(text: str, found: dict[str, None]) -> None:
    """Views named in ``text``, each after the views it names itself."""
    for name in _NAMES.findall(re.sub(r"'[^']*'", "''", text)):
        if name not in found:
            _needed(VIEWS[name].replace(f"AS {name}", ""), found)
            found[name] = None


def build() -> dict[str, str]:
    statements = {}
    for key, body in _SQL.items():
        views: dict[str, None] = {}
        _needed(body, views)
        parts = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in views)
        statements[key] = f"WITH {parts}\n{body.strip()}" if parts else body.strip()
    return statements
