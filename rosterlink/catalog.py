"""Registered queries: each operator and job over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import shared_folder, stored
from .fixtures import build
from .functions.text import single_line_base64
from .operators.documents import append_documents, remove_documents, source_document
from .operators.edits import apply_corrections
from .operators.facets import facet_counts, facet_index, facet_rows
from .operators.filters import (
    STATES,
    facet_filter,
    facet_values,
    only_unmatched,
    roster_search,
    sort_order,
    text_filter,
    with_highlights,
)
from .operators.lookup import PERSON, lookup, status, summary
from .operators.nearest import link_by_name, link_count
from .operators.order_index import order_index, page
from .operators.ranking import numbered
from .operators.trigrams import search, text_index
from .plans import corrected, keep, kept_summary, ordered, read_once, reconcile_attempts, submit, submit_once, view
from .plans.submit import submitted
from .plans.view import with_official
from .sinks.commits import stage
from .sinks.documents import write_documents
from .sinks.export import HEADER, export_lines, write_export
from .sinks.payload import payloads, refused
from .sinks.register import read_register, register_rows, rejected_payloads, replies
from .sources.documents import (
    accepted_documents,
    read_documents,
    rejected_files,
    request_cuts,
    request_manifest,
    request_parts,
)
from .sources.responses import (
    clean_responses,
    failed_batches,
    resolve_attempts,
    response_rows,
)
from .sources.roster import parse_roster, read_roster

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

ROW = ["seq", "nro", "nombre", "dni", "ocupacion", "area", "sourceFile", "method"]
OFFICIAL = ["estado", "dni_oficial", "nombre_oficial"]

# Arguments of the registered queries; oracle.py states the same values in SQL.
SEARCH_TEXT = "11"
CASED_TEXT = "R#00000001"
INSTRUCTION = "Extrae una sola tabla."
FACETS = {"ocupacion": ["1-URGENT", "2-HIGH"], "area": ["O", "F"]}
ROSTER_TEXT = " 0011 "
PER_PAYLOAD = 1000
MAX_BYTES = 20_000
PAGE_FIRST, PAGE_ROWS = 101, 50


def query(function: Query) -> Query:
    QUERIES[function.__name__.removeprefix("q_")] = function
    return function


def _rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return build(spark, folder, "fx_rows"), build(spark, folder, "fx_roster")


def _with_person(rows: DataFrame) -> DataFrame:
    return rows.select(*ROW, *(F.col(f"oficial.{c}").alias(f"{c}_oficial") for c in PERSON))


# Readers


@query
def q_roster_scan(spark, folder):
    return parse_roster(build(spark, folder, "fx_lines"))


@query
def q_resolve_attempts(spark, folder):
    return resolve_attempts(build(spark, folder, "fx_attempts"))


@query
def q_failed_batches(spark, folder):
    return failed_batches(build(spark, folder, "fx_attempts"))


@query
def q_clean_responses(spark, folder):
    return clean_responses(build(spark, folder, "fx_responses"))


@query
def q_response_rows(spark, folder):
    return response_rows(clean_responses(build(spark, folder, "fx_responses"))).drop("seq")


@query
def q_request_manifest(spark, folder):
    docs = build(spark, folder, "fx_docs")
    return request_manifest(docs.select("doc_seq", F.col("mime").alias("batch"), "name"), ["batch"])


@query
def q_manifest_gaps(spark, folder):
    docs = build(spark, folder, "fx_gaps_docs")
    return request_manifest(docs.select("doc_seq", "batch", "name"), ["batch"])


@query
def q_request_parts(spark, folder):
    docs = build(spark, folder, "fx_gaps_docs").withColumn("content", F.encode("content", "UTF-8"))
    return request_parts(docs, ["batch"], INSTRUCTION)


@query
def q_roster_files(spark, folder):
    """Roster lines written as four files, each with a blank line and a header of its own."""
    body = build(spark, folder, "fx_lines").filter("seq >= 0").withColumn("parte", F.col("seq") % 4)
    top = spark.range(8).select(
        (F.col("id") - 8).alias("seq"),
        F.when(F.col("id") < 4, " ").otherwise("a,header").alias("line"),
        (F.col("id") % 4).alias("parte"),
    )
    path = f"{shared_folder(spark)}/roster-{uuid.uuid4().hex}"
    whole = top.unionByName(body).repartition("parte").sortWithinPartitions("parte", "seq")
    whole.select("parte", "line").write.partitionBy("parte").text(path)
    return read_roster(spark, path).drop("seq")


@query
def q_document_filter(spark, folder):
    return accepted_documents(build(spark, folder, "fx_docs"))


def _scans(spark, folder):
    """Documents written as files under their names."""
    path = f"{shared_folder(spark)}/scans-{uuid.uuid4().hex}"
    docs = build(spark, folder, "fx_docs").withColumn("content", F.encode("content", "UTF-8"))
    write_documents(docs, path)
    return path


@query
def q_named_files(spark, folder):
    """Files of accepted types, read back."""
    found = read_documents(spark, _scans(spark, folder))
    return found.select("name", "size", "mime", F.md5("content").alias("md5"))


@query
def q_rejected_files(spark, folder):
    """Files of other types."""
    left = rejected_files(spark, _scans(spark, folder))
    return left.select(F.element_at(F.split("path", "/"), -1).alias("name"), "size", "mime")


@query
def q_base64_content(spark, folder):
    content = F.encode("content", "UTF-8")
    docs = build(spark, folder, "fx_docs")
    return docs.select("doc_seq", single_line_base64(content).alias("base64"))


# Lookups


@query
def q_lookup_left(spark, folder):
    matched = lookup(*_rows(spark, folder), "left").withColumn("estado", status())
    return matched.select(*ROW, "estado", *(F.col(f"oficial.{c}").alias(f"{c}_oficial") for c in PERSON))


@query
def q_lookup_inner(spark, folder):
    return _with_person(lookup(*_rows(spark, folder), "inner"))


@query
def q_lookup_anti(spark, folder):
    return lookup(*_rows(spark, folder), "left_anti")


@query
def q_lookup_semi(spark, folder):
    return lookup(*_rows(spark, folder), "left_semi")


@query
def q_lookup_gaps(spark, folder):
    """Missing fields on both sides, and several roster rows for an id: the first counts."""
    shown = view(build(spark, folder, "fx_gaps_rows"), build(spark, folder, "fx_gaps_roster"))
    return _with_person(shown)


@query
def q_view_placeholder(spark, folder):
    return with_official(lookup(*_rows(spark, folder), "left")).select(*ROW, *OFFICIAL)


@query
def q_status_labels(spark, folder):
    rows = lookup(*_rows(spark, folder), "left")
    return rows.select("seq", status("VÁLIDO", "SIN MATCH").alias("etiqueta"))


@query
def q_summary(spark, folder):
    return summary(*_rows(spark, folder))


# Filters, facets, sorts


@query
def q_only_unmatched(spark, folder):
    return only_unmatched(*_rows(spark, folder))


@query
def q_text_filter(spark, folder):
    return text_filter(build(spark, folder, "fx_rows"), SEARCH_TEXT)


@query
def q_text_filter_case(spark, folder):
    return text_filter(build(spark, folder, "fx_rows"), CASED_TEXT)


@query
def q_facet_filter(spark, folder):
    return facet_filter(build(spark, folder, "fx_rows"), FACETS)


@query
def q_facet_status(spark, folder):
    shown = view(*_rows(spark, folder), facets={**FACETS, "estado": ["OK"]})
    return shown.select(*ROW, *OFFICIAL)


@query
def q_highlight(spark, folder):
    marked = with_highlights(build(spark, folder, "fx_rows"), SEARCH_TEXT)
    return marked.select("seq", "nombre_marcado", "dni_marcado")


@query
def q_highlight_case(spark, folder):
    marked = with_highlights(build(spark, folder, "fx_rows"), CASED_TEXT)
    return marked.select("seq", "nombre_marcado", "dni_marcado")


def _facets(spark, folder):
    """Index of a view's facets, the status among them."""
    return facet_index(view(*_rows(spark, folder)), ["estado", "ocupacion", "area"])


@query
def q_facet_states(spark, folder):
    """The states in their order, with the rows that have each."""
    counted = facet_counts(_facets(spark, folder), "estado")
    place = F.array_position(F.array(*map(F.lit, STATES)), F.col("valor"))
    return counted.select("valor", place.cast("long").alias("pos"), F.col("n").alias("filas"))


@query
def q_facet_counts(spark, folder):
    """Rows of each value of each facet under the selection of all others."""
    index, chosen = _facets(spark, folder), {**FACETS, "estado": ["OK"]}
    counted = [facet_counts(index, c, chosen).withColumn("columna", F.lit(c)) for c in index.columns]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query
def q_facet_rows(spark, folder):
    """The rows that pass a selection, found by bitmaps."""
    return facet_rows(_facets(spark, folder), {**FACETS, "estado": ["OK"]}).select(*ROW, *OFFICIAL)


@query
def q_text_index(spark, folder):
    """A search through the index of trigrams."""
    return search(text_index(build(spark, folder, "fx_rows")), CASED_TEXT)


@query
def q_lookup_reduced(spark, folder):
    """The plan of a large roster: rows that cannot match are told by a bitmap and not shuffled."""
    matched = lookup(*_rows(spark, folder), "left", broadcast=False).withColumn("estado", status())
    return matched.select(*ROW, "estado", *(F.col(f"oficial.{c}").alias(f"{c}_oficial") for c in PERSON))


@query
def q_facet_values(spark, folder):
    return facet_values(build(spark, folder, "fx_rows"), "nombre", positions=True)


def _sorted(spark, folder, column, direction):
    shown = ordered(view(*_rows(spark, folder)), column, direction, positions=True)
    return shown.select("seq", column, "pos")


@query
def q_sort_asc(spark, folder):
    return _sorted(spark, folder, "nombre", "asc")


@query
def q_sort_desc(spark, folder):
    return _sorted(spark, folder, "sourceFile", "desc")


@query
def q_sort_status(spark, folder):
    return _sorted(spark, folder, "estado", "asc")


@query
def q_sort_page(spark, folder):
    """One page of a sorted view, from positions that are stored once."""
    shown = view(*_rows(spark, folder)).select(*ROW, *OFFICIAL)
    return page(order_index(shown, ["nombre"]), "nombre", "desc", PAGE_FIRST, PAGE_ROWS)


@query
def q_roster_search(spark, folder):
    return roster_search(build(spark, folder, "fx_roster"), ROSTER_TEXT)


@query
def q_view_full(spark, folder):
    shown = view(
        *_rows(spark, folder),
        only_unmatched=True,
        text=SEARCH_TEXT,
        facets={**FACETS, "estado": ["FUERA"]},
    )
    return ordered(shown, "nombre", "desc", positions=True).select(*ROW, *OFFICIAL, "pos")


# Name links and sources


@query
def q_nearest_name(spark, folder):
    return link_by_name(build(spark, folder, "fx_typos"), build(spark, folder, "fx_roster"))


@query
def q_link_count(spark, folder):
    linked = link_by_name(build(spark, folder, "fx_typos"), build(spark, folder, "fx_roster"))
    return link_count(linked)


@query
def q_nearest_shuffled(spark, folder):
    """The plan for name lists that are too large to broadcast, with blocks of few pairs."""
    rows, roster = build(spark, folder, "fx_typos"), build(spark, folder, "fx_roster")
    return link_by_name(rows, roster, few_pairs=0, pairs_per_task=20_000)


@query
def q_nearest_tokens(spark, folder):
    """Names of common words, whose frequent parts are cut finer or compared in blocks."""
    rows, roster = build(spark, folder, "fx_token_rows"), build(spark, folder, "fx_token_roster")
    return link_by_name(rows, roster, few_pairs=0, pairs_per_task=5_000)


@query
def q_source_document(spark, folder):
    found = source_document(build(spark, folder, "fx_rows"), build(spark, folder, "fx_docs"))
    return found.select(
        "seq",
        "sourceFile",
        F.col("documento.doc_seq").alias("doc_seq"),
        F.col("documento.name").alias("documento"),
        "visible",
    )


# Edits


@query
def q_corrections(spark, folder):
    rows = build(spark, folder, "fx_rows")
    return apply_corrections(rows, build(spark, folder, "fx_corrections"), "turno")


def _kept(spark, folder):
    """A view that is kept, after each of the two turns of the log."""
    rows, roster = _rows(spark, folder)
    log = build(spark, folder, "fx_corrections")
    shown = keep(rows, roster, ["method", "area"])
    for turn in (1, 2):
        shown = corrected(shown, log.filter(F.col("turno") == turn), "turno", roster)
    return shown


@query
def q_kept_view(spark, folder):
    """A view that follows its corrections by differences."""
    return _kept(spark, folder).rows.select(*ROW, *OFFICIAL)


@query
def q_kept_counts(spark, folder):
    """Rows of each facet value of that view, moved by differences."""
    return _kept(spark, folder).counts


@query
def q_kept_summary(spark, folder):
    return kept_summary(_kept(spark, folder))


@query
def q_append_remove_documents(spark, folder):
    docs = build(spark, folder, "fx_docs")
    removed = docs.filter(F.col("mime") == "application/pdf")
    return append_documents(remove_documents(docs, removed), docs).select("doc_seq", "name", "mime")


# Sinks and jobs


@query
def q_export_lines(spark, folder):
    body = export_lines(lookup(*_rows(spark, folder), "inner")).select("seq", "line")
    head = spark.range(1).select(F.lit(None).cast("long").alias("seq"), F.lit(HEADER).alias("line"))
    return head.unionByName(body)


@query
def q_export_gaps(spark, folder):
    shown = view(build(spark, folder, "fx_gaps_rows"), build(spark, folder, "fx_gaps_roster"))
    return export_lines(shown).select("seq", "line")


@query
def q_export_view(spark, folder):
    """Lines of a filtered and sorted view, with their places in the file."""
    shown = view(*_rows(spark, folder), text=SEARCH_TEXT, facets=FACETS)
    lines = export_lines(shown).select("seq", "nombre", "line")
    return numbered(lines, sort_order("nombre", "desc")).select("pos", "line")


@query
def q_export_files(spark, folder):
    """A sorted view written as a file and read back."""
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    write_export(view(*_rows(spark, folder), facets=FACETS), path, "nombre", "desc")
    return spark.read.text(path).withColumnRenamed("value", "line")


def _sent(spark, folder):
    """Payloads as they leave: one reference per priority, stored as text."""
    matched = lookup(*_rows(spark, folder), "inner")
    return stored(payloads(matched, F.col("ocupacion"), per_payload=PER_PAYLOAD))


@query
def q_payload_roundtrip(spark, folder):
    """Stored payloads read back to register rows."""
    return register_rows(_sent(spark, folder))


@query
def q_payload_parts(spark, folder):
    """How each reference is split in payloads, and their text but for the ids."""
    sent = _sent(spark, folder)
    people = F.size(F.from_json("payload", "participantes array<struct<Id: string>>")["participantes"])
    text = F.regexp_replace("payload", '"Id":"x[0-9A-Z]{1,6}"', '"Id":"x"')
    return sent.select(
        "IdRef", "parte", people.cast("long").alias("participantes"), text.alias("payload")
    )


@query
def q_payload_bytes(spark, folder):
    """How each reference is split in payloads of bounded text, and the size of each."""
    matched = lookup(*_rows(spark, folder), "inner")
    sent = payloads(matched, F.col("ocupacion"), max_bytes=MAX_BYTES)
    people = F.size(F.from_json("payload", "participantes array<struct<Id: string>>")["participantes"])
    return sent.select(
        "IdRef",
        "parte",
        people.cast("long").alias("participantes"),
        F.octet_length("payload").cast("long").alias("bytes"),
    )


@query
def q_request_cuts(spark, folder):
    """Batches of documents cut into requests of bounded size."""
    docs = build(spark, folder, "fx_docs").withColumn("content", F.encode("content", "UTF-8"))
    return request_cuts(docs.withColumnRenamed("mime", "batch"), ["batch"], MAX_BYTES)


@query
def q_submit_register(spark, folder):
    """A filtered view submitted, and the register read back."""
    path = f"{shared_folder(spark)}/register-{uuid.uuid4().hex}"
    submit(view(*_rows(spark, folder), facets={"area": ["O", "F"]}), F.col("ocupacion"), path)
    return read_register(spark, path)


@query
def q_submit_once(spark, folder):
    """Two submissions, both run again, and attempts that were cut off: each participant once."""
    path = f"{shared_folder(spark)}/register-{uuid.uuid4().hex}"
    rows, roster = _rows(spark, folder)
    for area in ("O", "F", "O", "F"):
        shown = view(rows, roster, facets={"area": [area]})
        stage(submitted(shown, F.concat("ocupacion", F.lit(" "), "area")), path)
        submit_once(shown, F.concat("ocupacion", F.lit(" "), "area"), path)
    return read_once(spark, path)


@query
def q_submit_refused(spark, folder):
    """Matched rows without a reference."""
    rows = build(spark, folder, "fx_gaps_rows")
    shown = view(rows, build(spark, folder, "fx_roster"))
    return refused(shown, F.col("ocupacion")).select("seq", "dni")


@query
def q_register_rows(spark, folder):
    return register_rows(build(spark, folder, "fx_payloads"))


@query
def q_register_rejects(spark, folder):
    return rejected_payloads(build(spark, folder, "fx_payloads"))


@query
def q_register_replies(spark, folder):
    return replies(build(spark, folder, "fx_payloads")).select("doc_id", "reply")


@query
def q_reconcile_typos(spark, folder):
    """From recorded answers with mistyped names: most rows are linked by name."""
    attempts = build(spark, folder, "fx_typo_attempts")
    done = reconcile_attempts(attempts, build(spark, folder, "fx_roster"))
    return done.select("batch", "pos", *ROW[1:], *OFFICIAL)


@query
def q_reconcile_full(spark, folder):
    attempts = build(spark, folder, "fx_extractions")
    log = build(spark, folder, "fx_corrections").select(
        F.struct(F.col("seq").alias("batch"), F.lit(1).alias("pos")).alias("seq"), "turno", "dni"
    )
    done = reconcile_attempts(attempts, build(spark, folder, "fx_roster"), log, "turno")
    return done.select("batch", "pos", *ROW[1:], *OFFICIAL)
