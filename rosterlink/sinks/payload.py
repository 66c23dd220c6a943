"""Submission payloads: matched participants of a view as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import stored
from ..functions.text import known, participant_id
from ..operators.cutting import greedy_parts
from ..operators.filters import sort_order
from ..operators.lookup import PERSON, is_matched
from ..operators.ranking import numbered

# Fixed value: the fields of a participant, in order.
PARTICIPANT = ["Id", "ParticipanteDNI", "Participante", "Cargo", "Area"]
_FIELDS = ", ".join(f"{c}: string" for c in PARTICIPANT)


def participants(
    view: DataFrame, id_ref: Column, sort: str | None = None, direction: str = "asc"
) -> DataFrame:
    """One row per matched row of the view: ``IdRef``, ``pos`` (its place in the reference, in
    view order) and ``participante``; see :func:`refused` for rows without ``id_ref``.

    Ids come from places, so they are unique inside a reference.
    """
    named = view.withColumn("IdRef", known(id_ref)).filter((F.col("IdRef") != "") & is_matched())
    person = F.struct(
        *(
            F.upper(known(F.col(f"oficial.{c}"))).alias(name)
            for c, name in zip(PERSON, ("ParticipanteDNI", "Participante", "Cargo", "Area"), strict=True)
        )
    )
    kept = ["IdRef", person.alias("persona"), "seq"] + ([sort] if sort else [])
    placed = numbered(named.select(*kept), sort_order(sort, direction), ["IdRef"])
    own_id = participant_id(F.col("IdRef"), F.col("pos")).alias("Id")
    return placed.select(
        "IdRef", "pos", F.struct(own_id, *(F.col(f"persona.{c}") for c in PARTICIPANT[1:])).alias("participante")
    )


def refused(view: DataFrame, id_ref: Column) -> DataFrame:
    """Matched rows that cannot be sent because they have no reference."""
    return view.filter((known(id_ref) == "") & is_matched())


def payloads(
    view: DataFrame,
    id_ref: Column,
    per_payload: int | None = None,
    sort: str | None = None,
    direction: str = "asc",
    *,
    max_bytes: int | None = None,
) -> DataFrame:
    """``IdRef``, ``parte`` and ``payload``, with the participants in view order.

    For references that leave the cluster as text. A payload is one value, so its size must have a
    bound, which the caller states: ``per_payload`` participants, or ``max_bytes`` of text (a single participant may
    exceed it). A larger reference is sent in several parts, all complete and in
    order, each as full as the bound allows. A reference without participants has no payload.
    """
    if (per_payload is None) == (max_bytes is None):
        raise ValueError("state either per_payload or max_bytes")
    placed = participants(view, id_ref, sort, direction)
    if max_bytes is None:
        cut = placed.withColumn("parte", ((F.col("pos") - 1) / per_payload).cast("long") + 1)
    else:
        placed = stored(placed)
        none = F.struct("IdRef", F.array().cast(f"array<struct<{_FIELDS}>>").alias("participantes"))
        # A comma before each participant but the first.
        sized = placed.select(
            "IdRef",
            "pos",
            (F.octet_length(F.to_json("participante")) + 1).alias("bytes"),
            (F.lit(max_bytes + 1) - F.octet_length(F.to_json(none))).alias("most"),
        )
        parts = greedy_parts(sized, ["IdRef"], "pos", "bytes", F.greatest(F.col("most"), F.lit(1)))
        cut = placed.join(parts, ["IdRef", "pos"])
    ordered = F.array_sort(F.collect_list(F.struct("pos", "participante")))
    return (
        cut.groupBy("IdRef", "parte")
        .agg(F.transform(ordered, lambda p: p["participante"]).alias("participantes"))
        .select("IdRef", "parte", F.to_json(F.struct("IdRef", "participantes")).alias("payload"))
    )
