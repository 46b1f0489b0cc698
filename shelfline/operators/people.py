"""Customers, staff and users: get-or-create, removal with cascades, roles."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.functions.text import clean_input, key
from shelfline.operators.cascade import remove_rows
from shelfline.operators.orders import Tables
from shelfline.operators.running import highest_of, number_each
from shelfline.session import stage

STAFF_ROLE, STAFF_POST, ADMIN_ROLE = "Empleado", "Operador", "Administrador"


def users(usuario: DataFrame) -> DataFrame:
    return usuario.select("id_usuario", "correo", "rol")


def user_directory(t: Tables) -> DataFrame:
    """Users with the name of their person; without a name the mail stands in."""
    named = t["usuario"].join(t["persona"].select("id_persona", "nombre"), "id_persona")
    return named.select(
        "id_usuario",
        "correo",
        "rol",
        F.coalesce(F.nullif("nombre", F.lit("")), "correo").alias("nombre"),
    )


@dataclass
class Resolved:
    """The feed with customer ids, and the person and customer rows to add."""

    feed: DataFrame
    new_persona: DataFrame
    new_cliente: DataFrame


def resolve_customers(feed: DataFrame, persona: DataFrame, cliente: DataFrame) -> Resolved:
    """Find or create the person and customer of each order.

    ``feed`` has id_solicitud, ts, cedula, nombre, direccion, telefono and any
    further columns. The first order of a new document number, in
    (ts, id_solicitud) sequence, gives the person's data; known persons are left
    as they are. New ids number on from the highest ones in sequence.
    """
    cleaned = feed.withColumns(
        {
            "cedula": clean_input(F.coalesce("cedula", F.lit(""))),
            "nombre": clean_input(F.coalesce("nombre", F.lit(""))),
            "direccion": clean_input("direccion"),
            "telefono": clean_input("telefono"),
        }
    )
    firsts = cleaned.groupBy(key("cedula").alias("_key")).agg(
        F.min_by(
            F.struct("cedula", "nombre", "direccion", "telefono"), F.struct("ts", "id_solicitud")
        ).alias("_data"),
        F.min(F.struct("ts", "id_solicitud")).alias("_at"),
    )
    known = persona.select(key("cedula").alias("_key"), "id_persona").join(cliente, "id_persona", "left")
    asked = firsts.join(known, "_key", "left").select("_data.*", "_at.*", "id_persona", "id_cliente")
    # Persons and customers are numbered on the same written rows; the collated key is rebuilt after the write.
    asked = stage(asked.withColumns({"_person": F.col("id_persona").isNull(), "_client": F.col("id_cliente").isNull()}), "asked")
    top_person, top_client = highest_of((persona, "id_persona"), (cliente, "id_cliente"))
    ids = number_each(asked, ["ts", "id_solicitud"], {"id_persona": ("_person", top_person), "id_cliente": ("_client", top_client)})
    resolved = cleaned.withColumn("_key", key("cedula")).join(
        ids.select(key("cedula").alias("_key"), "id_cliente"), "_key"
    )
    return Resolved(
        resolved.drop("_key"),
        ids.filter("_person").select("id_persona", "cedula", "nombre", "direccion", "telefono"),
        ids.filter("_client").select("id_cliente", "id_persona"),
    )


@dataclass
class StaffChange:
    """Rows to add to persona, usuario and empleado, and the rejected feed rows."""

    persona: DataFrame
    usuario: DataFrame
    empleado: DataFrame
    rejects: DataFrame


STAFF_VARIANTS = ("managed", "anonymous", "direct")


def register_staff(feed: DataFrame, t: Tables, variant: str = "managed") -> StaffChange:
    """Register a batch of staff in ``seq`` sequence; mails are unique.

    ``feed`` has seq, ts, cedula, nombre, email, clave_hash and
    role_solicitante. Role and post are fixed whatever the feed says.

    * managed: the requester must be administrator; the person is found by
      document number or created; the user gets an employee row.
    * anonymous: like managed, but every person is new with a made-up document
      number and there is no employee row.
    * direct: no requester check; the document number must be new; no employee row.
    """
    if variant not in STAFF_VARIANTS:
        raise ValueError(f"unknown variant {variant!r}")
    made_up = F.substring(F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "email"), 256), 1, 13)
    cedula = made_up if variant == "anonymous" else F.coalesce("cedula", made_up)
    blank = F.lit("")
    rows = feed.withColumns(
        {"nombre": F.coalesce("nombre", blank), "email": F.coalesce("email", blank)}
    ).withColumn("cedula", cedula)
    allowed = F.lit(True)
    if variant != "direct":
        allowed = F.coalesce(F.col("role_solicitante") == ADMIN_ROLE, F.lit(False))
    mails = t["usuario"].select(key("correo").alias("_mail"), F.lit(True).alias("_taken"))
    checked = (
        rows.withColumn("_mail", key("email"))
        .join(mails, "_mail", "left")
        .withColumn(
            "motivo",
            F.when(~allowed, "permiso").when(F.col("_taken").isNotNull(), "correo"),
        )
        .drop("_mail", "_taken")
    )
    candidates = checked.filter("motivo IS NULL").drop("motivo")
    if variant == "direct":
        accepted = _first_free(candidates, t["persona"])
    else:
        firsts = candidates.groupBy(key("email").alias("_mail")).agg(F.min("seq").alias("seq"))
        accepted = candidates.join(firsts.select("seq"), "seq", "left_semi")
    accepted = stage(accepted, "accepted")
    refused = candidates.join(accepted.select("seq"), "seq", "left_anti")
    persona, usuario = _new_users(accepted, t)
    empleado = t["empleado"].limit(0)
    if variant == "managed":
        # Users and employees are numbered in the same sequence.
        top_post, top_user = highest_of((t["empleado"], "id_empleado"), (t["usuario"], "id_usuario"))
        shift = top_post - top_user
        empleado = usuario.select(
            (F.col("id_usuario") + shift).alias("id_empleado"),
            F.lit(STAFF_POST).alias("cargo"),
            "id_usuario",
        )
    rejects = checked.filter("motivo IS NOT NULL").unionByName(
        refused.withColumn("motivo", F.lit("repetido"))
    )
    return StaffChange(persona, usuario, empleado, rejects)


def _first_free(candidates: DataFrame, persona: DataFrame) -> DataFrame:
    """Rows whose mail and document number no earlier accepted row has used.

    Rows with a number that a person has are out. In each round a row that is first among the undecided for its
    mail and for its number is accepted, for no earlier one can take either any more, and all others with one of
    these mails or numbers are out. The first undecided row is always decided, so the rounds end.
    """
    taken = persona.select(key("cedula").alias("_c"))
    undecided = stage(candidates.join(taken, key("cedula") == F.col("_c"), "left_anti").select("seq", "email", "cedula"), "undecided")
    accepted = []
    while not undecided.isEmpty():
        keyed = undecided.select("seq", key("email").alias("_m"), key("cedula").alias("_c"))
        mails = keyed.groupBy("_m").agg(F.min("seq").alias("seq"))
        numbers = keyed.groupBy("_c").agg(F.min("seq").alias("seq"))
        first = mails.join(numbers, "seq").select("seq")
        accepted.append(stage(undecided.join(first, "seq", "left_semi"), "first"))
        ends = accepted[-1].select(key("email").alias("_m"), key("cedula").alias("_c"))
        left = undecided.join(ends.select("_m"), key("email") == F.col("_m"), "left_anti")
        undecided = stage(left.join(ends.select("_c"), key("cedula") == F.col("_c"), "left_anti"), "undecided")
    if not accepted:
        return candidates.limit(0)
    return candidates.join(reduce(DataFrame.unionByName, accepted).select("seq"), "seq", "left_semi")


def _new_users(accepted: DataFrame, t: Tables) -> tuple[DataFrame, DataFrame]:
    known = t["persona"].select(key("cedula").alias("_key"), "id_persona")
    firsts = accepted.groupBy(key("cedula").alias("_key")).agg(F.min("seq").alias("_first"))
    marked = accepted.withColumn("_key", key("cedula")).join(firsts, "_key").join(known, "_key", "left").drop("_key")
    marked = marked.withColumns({"_user": F.lit(True), "_person": F.col("id_persona").isNull() & (F.col("seq") == F.col("_first"))})
    top_user, top_person = highest_of((t["usuario"], "id_usuario"), (t["persona"], "id_persona"))
    numbered = number_each(marked, ["seq"], {"id_usuario": ("_user", top_user), "id_persona": ("_person", top_person)})
    created = numbered.filter("_person")
    others = created.select(F.col("_first").alias("_of"), F.col("id_persona").alias("_id"))
    usuario = numbered.join(others, F.col("_first") == F.col("_of"), "left").select(
        "id_usuario",
        F.col("email").alias("correo"),
        F.col("clave_hash").alias("contraseña"),
        F.lit(STAFF_ROLE).alias("rol"),
        F.col("ts").alias("fecha_registro"),
        F.coalesce("id_persona", "_id").alias("id_persona"),
    )
    persona = created.select(
        "id_persona", "cedula", "nombre", F.lit(None).cast("string").alias("direccion"), F.lit(None).cast("string").alias("telefono")
    )
    return persona, usuario


def remove_users(ids: DataFrame, t: Tables, with_person: bool = False) -> dict[str, DataFrame]:
    """Delete users, and with ``with_person`` also their persons, with cascades.

    A user takes its employee row along. A person takes its customer, the
    customer's orders and their lines, and any other users of that person.
    Stock does not come back on this way.
    """
    if not with_person:
        return remove_rows("usuario", ids, t)
    people = t["usuario"].join(ids.select("id_usuario").distinct(), "id_usuario", "left_semi").select("id_persona")
    return remove_rows("persona", people, t)


def set_roles(changes: DataFrame, usuario: DataFrame, role: str = STAFF_ROLE) -> DataFrame:
    """Users with ``role`` given to those named in ``changes``, by id or by mail."""
    marked = F.when(F.col("_hit").isNotNull(), F.lit(role)).otherwise(F.col("rol"))
    if "id_usuario" in changes.columns:
        hits = changes.select("id_usuario", F.lit(True).alias("_hit")).distinct()
        joined = usuario.join(hits, "id_usuario", "left")
    else:
        hits = changes.select(key("correo").alias("_mail")).distinct().withColumn("_hit", F.lit(True))
        joined = usuario.withColumn("_mail", key("correo")).join(hits, "_mail", "left")
    return joined.withColumn("rol", marked).select(usuario.columns)
