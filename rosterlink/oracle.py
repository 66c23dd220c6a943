"""SQL for DuckDB that computes what each registered query computes."""

from __future__ import annotations

import re

from .fixtures import VIEWS, duckdb_text


def _key(column: str) -> str:
    return rf"trim(ltrim({column}, '0'), chr(9) || chr(10) || chr(13) || ' ')"


def _index(roster: str) -> str:
    return (
        f"SELECT seq, coalesce(dni, '') AS dni, coalesce(nombre, '') AS nombre, coalesce(cargo, '') AS cargo, "
        f"coalesce(area, '') AS area, llave FROM (SELECT *, {_key("coalesce(dni, '')")} AS llave, row_number() "
        f"OVER (PARTITION BY {_key("coalesce(dni, '')")} ORDER BY seq) AS nth FROM {roster}) WHERE nth = 1"
    )


def _ranked_people(rows: str, index: str = "padron") -> str:
    """Rows with the first roster row of their identity key, if there is one."""
    return (
        f"SELECT r.*, m.dni AS m_dni, m.nombre AS m_nombre, m.cargo AS m_cargo, m.area AS m_area, "
        f"CASE WHEN m.llave IS NULL THEN 'FUERA' ELSE 'OK' END AS estado, "
        f"coalesce(m.dni, '---') AS dni_oficial, coalesce(m.nombre, '---') AS nombre_oficial "
        f"FROM {rows} AS r LEFT JOIN {index} AS m ON {_key('r.dni')} = m.llave"
    )


def _linked(rows: str, looked_up: str, roster: str = "fx_roster") -> str:
    """Rows after the name link: brute force over all distinct names."""
    return f"""
SELECT r.* EXCLUDE (dni, method, m_dni, m_nombre, m_cargo, m_area, estado, dni_oficial, nombre_oficial),
       coalesce(k.dni, r.dni) AS dni, CASE WHEN k.q IS NULL THEN r.method ELSE 'IA' END AS method,
       k.q IS NOT NULL AS vinculado
FROM {looked_up} AS r LEFT JOIN (
  SELECT q, p.dni FROM (
    SELECT q, s, row_number() OVER (PARTITION BY q ORDER BY d, s) AS nth FROM (
      SELECT q, s, levenshtein(q, n) AS d FROM
        (SELECT DISTINCT trim(lower(nombre)) AS q FROM {looked_up} WHERE estado = 'FUERA')
        CROSS JOIN (SELECT lower(nombre) AS n, min(seq) AS s FROM {roster} GROUP BY 1)
      WHERE length(q) >= 4)
    WHERE d <= greatest(3, CAST(floor(length(q) * 0.25) AS INT)))
  JOIN {roster} AS p ON p.seq = s WHERE nth = 1
) AS k ON r.estado = 'FUERA' AND k.q = trim(lower(r.nombre))"""


TEXT = "nro nombre dni ocupacion area sourceFile method".split()

# Common table expressions, each over the ones before it.
COMMON = {
    **{name: duckdb_text(name) for name in VIEWS},
    "padron": _index("fx_roster"),
    "lugares": "SELECT *, row_number() OVER (PARTITION BY batch ORDER BY doc_seq) AS pos FROM fx_gaps_docs",
    "padron_gaps": _index("fx_gaps_roster"),
    "filas_gaps": "SELECT seq, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in TEXT)
    + " FROM fx_gaps_rows",
    "vista_gaps": _ranked_people("filas_gaps", "padron_gaps"),
    "vista_refs": _ranked_people("filas_gaps"),
    "padron_token": _index("fx_token_roster"),
    "vista_token": _ranked_people("fx_token_rows", "padron_token"),
    "token_vinculados": _linked("fx_token_rows", "vista_token", "fx_token_roster"),
    "respuestas": "SELECT batch, 1 AS pos, nro, nombre, dni, ocupacion, area, sourceFile, 'DEFAULT' AS method "
    "FROM (SELECT seq AS batch, * FROM fx_typos)",
    "vista_respuestas": _ranked_people("respuestas"),
    "respuestas_vinculadas": _linked("respuestas", "vista_respuestas"),
    "vista_final": _ranked_people("respuestas_vinculadas"),
    "vista": _ranked_people("fx_rows"),
    "vista_typos": _ranked_people("fx_typos"),
    "typos_vinculados": _linked("fx_typos", "vista_typos"),
    "ultimas": "SELECT seq, arg_max(dni, turno) AS dni FROM fx_corrections GROUP BY seq",
    "corregidas": "SELECT r.* EXCLUDE (dni, method), coalesce(u.dni, r.dni) AS dni, "
    "CASE WHEN u.seq IS NULL THEN method ELSE 'MANUAL' END AS method "
    "FROM fx_rows AS r LEFT JOIN ultimas AS u ON u.seq = r.seq",
    "vista_corregida": _ranked_people("corregidas"),
    "extraidas": "SELECT seq AS batch, 1 AS pos, '1' AS nro, nombre, coalesce(u.dni, r.dni) AS dni, "
    "ocupacion, area, sourceFile, CASE WHEN u.seq IS NULL THEN 'DEFAULT' ELSE 'MANUAL' END AS method "
    "FROM fx_rows AS r LEFT JOIN ultimas AS u USING (seq) "
    "UNION ALL SELECT seq, 3, '3', 'SHORT', nro, '', '', '', 'DEFAULT' FROM fx_rows",
    "vista_extraidas": _ranked_people("extraidas"),
    "vinculadas": _linked("extraidas", "vista_extraidas"),
    "vista_vinculadas": _ranked_people("vinculadas"),
}

ROW = "seq, nro, nombre, dni, ocupacion, area, sourceFile, method"
OFFICIAL = "estado, dni_oficial, nombre_oficial"
PERSON = "m_dni AS dni_oficial, m_nombre AS nombre_oficial, m_cargo AS cargo_oficial, m_area AS area_oficial"
HAS_TEXT = "(contains(nombre, '11') OR contains(dni, '11') OR contains(sourceFile, '11'))"
HAS_CASED_TEXT = (
    "(contains(lower(nombre), 'r#00000001') OR contains(lower(dni), 'r#00000001') "
    "OR contains(lower(sourceFile), 'r#00000001'))"
)
LINE = (
    "concat(upper(dni), ';', upper(m_nombre), ';', upper(m_cargo), ';', upper(m_area), ';', method, ';', "
    "sourceFile) AS line"
)
PEOPLE = (
    "ocupacion AS IdRef, upper(m_dni) AS ParticipanteDNI, upper(m_nombre) AS Participante, "
    "upper(m_cargo) AS Cargo, upper(m_area) AS Area"
)
# Digits of the identity numbers.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _greedy(items: str, group: str, bound: str) -> str:
    """``partes``: items with their part, found by going from part to part."""
    return (
        f"antes_de AS (SELECT *, coalesce(lag(hasta) OVER (PARTITION BY {group} ORDER BY pos), 0) AS antes FROM {items}), "
        f"inicios AS (SELECT {group}, pos, antes, 1 AS parte FROM antes_de WHERE pos = 1 UNION ALL "
        f"SELECT {group}, pos, antes, parte FROM (SELECT a.{group}, a.pos, a.antes, i.parte + 1 AS parte, "
        f"row_number() OVER (PARTITION BY a.{group} ORDER BY a.pos) AS nth FROM inicios AS i JOIN antes_de AS a "
        f"ON a.{group} = i.{group} AND a.pos > i.pos AND a.hasta > i.antes + {bound}) WHERE nth = 1), "
        f"partes AS (SELECT a.*, i.parte FROM antes_de AS a ASOF JOIN inicios AS i ON a.{group} = i.{group} AND a.pos >= i.pos)"
    )


def _with_ids(people: str, more: str = "") -> str:
    """Register rows of ``people``: their ``pos`` in ``IdRef`` goes through four Feistel rounds."""
    text = f"SELECT *, (pos - 1) // 46656 AS l, (pos - 1) % 46656 AS r, md5(IdRef) AS h FROM ({people})"
    for first in (1, 6, 11, 16):
        text = f"SELECT *, r + CAST(concat('0x', substr(h, {first}, 5)) AS BIGINT) AS x FROM ({text})"
        text = (
            "SELECT * EXCLUDE (l, r, x), r AS l, "
            f"(l + (x * x * 48271 + x * 69621) % 2147483647) % 46656 AS r FROM ({text})"
        )
    digits = ", ".join(f"substr('{DIGITS}', CAST(n // {36**i} % 36 + 1 AS INT), 1)" for i in range(5, -1, -1))
    return (
        f"SELECT concat('x', CASE n WHEN 0 THEN '0' ELSE ltrim(concat({digits}), '0') END) AS Id, "
        f"IdRef, ParticipanteDNI, Participante, Cargo, Area{more and ', ' + more} FROM (SELECT *, l * 46656 + r AS n FROM ({text}))"
    )


REFUSED = '{"success":false,"message":"payload without participants"}'
HAS_FACETS = "ocupacion IN ('1-URGENT', '2-HIGH') AND area IN ('O', 'F')"
ANSWER_HEADER = "Nro;Apellidos y Nombres;DNI;Ocupacion;Area;SourceFile"
EXPORT_HEADER = "DNI;NOMBRE OFICIAL;OCUPACION;AREA;METODO;ORIGEN"


def _sorted(column: str, direction: str) -> str:
    return (
        f"SELECT seq, {column}, row_number() OVER (ORDER BY lower({column}) {direction}, seq) AS pos FROM vista"
    )


QUERIES = {
    "roster_scan": "SELECT seq, dni, concat(nombre, ', ', cargo) AS nombre, cargo, area FROM fx_roster",
    "resolve_attempts": "SELECT batch, arg_min(model, model_rank) AS modelUsed, "
    "arg_min(response, model_rank) AS response FROM fx_attempts "
    "WHERE error IS NULL AND response <> '' GROUP BY batch",
    "failed_batches": "SELECT *, concat('Fallaron todos los modelos intentados (', tried, "
    "'). Último error: ', last_error) AS message FROM "
    "(SELECT batch, string_agg(model, ', ' ORDER BY model_rank) AS tried, "
    "arg_max(coalesce(error, 'Respuesta vacía del modelo.'), model_rank) AS last_error "
    "FROM fx_attempts GROUP BY batch "
    "HAVING count(*) FILTER (WHERE error IS NULL AND coalesce(response, '') <> '') = 0)",
    "clean_responses": "SELECT batch, CASE WHEN contains(lower(csv), 'sourcefile') THEN csv "
    f"ELSE concat('{ANSWER_HEADER}', chr(10), csv) END AS csv FROM "
    r"(SELECT batch, trim(regexp_replace(regexp_replace(response, '\A```(csv|txt)?\n', '', 'i'), "
    r"'\n```\z', ''), chr(9) || chr(10) || chr(13) || ' ') AS csv FROM fx_responses)",
    "response_rows": "SELECT seq AS batch, 1 AS pos, '1' AS nro, nombre, dni, ocupacion, area, sourceFile, "
    "'DEFAULT' AS method FROM fx_rows "
    "UNION ALL SELECT seq, 3, '3', 'SHORT', nro, '', '', '', 'DEFAULT' FROM fx_rows",
    "request_manifest": "SELECT *, concat('Archivo ', CAST(pos AS VARCHAR), ': ', name) AS etiqueta FROM "
    "(SELECT doc_seq, mime AS batch, name, row_number() OVER (PARTITION BY mime ORDER BY doc_seq) AS pos "
    "FROM fx_docs)",
    "manifest_gaps": "SELECT *, concat('Archivo ', CAST(pos AS VARCHAR), ': ', name) AS etiqueta FROM "
    "(SELECT doc_seq, batch, name, row_number() OVER (PARTITION BY batch ORDER BY doc_seq) AS pos "
    "FROM fx_gaps_docs)",
    "request_parts": "SELECT batch, pos * 2 - 1 AS parte, concat('Archivo ', CAST(pos AS VARCHAR), ': ', name) AS text, "
    "NULL AS mime, NULL AS base64 FROM lugares UNION ALL "
    "SELECT batch, pos * 2, NULL, mime, to_base64(encode(content)) FROM lugares UNION ALL "
    "SELECT batch, max(pos) * 2 + 1, 'Extrae una sola tabla.', NULL, NULL FROM lugares GROUP BY batch",
    "roster_files": "SELECT dni, concat(nombre, ', ', cargo) AS nombre, cargo, area FROM fx_roster",
    "document_filter": "SELECT * FROM fx_docs WHERE mime LIKE 'image/%' OR mime = 'application/pdf'",
    "named_files": "SELECT name, octet_length(encode(content)) AS size, mime, md5(content) AS md5 FROM fx_docs "
    "WHERE mime LIKE 'image/%' OR mime = 'application/pdf'",
    "rejected_files": "SELECT name, octet_length(encode(content)) AS size, mime FROM fx_docs "
    "WHERE mime = 'text/html'",
    "base64_content": "SELECT doc_seq, to_base64(encode(content)) AS base64 FROM fx_docs",
    "lookup_left": f"SELECT {ROW}, estado, {PERSON} FROM vista",
    "lookup_inner": f"SELECT {ROW}, {PERSON} FROM vista WHERE estado = 'OK'",
    "lookup_anti": f"SELECT {ROW} FROM vista WHERE estado = 'FUERA'",
    "lookup_semi": f"SELECT {ROW} FROM vista WHERE estado = 'OK'",
    "lookup_gaps": f"SELECT {ROW}, {PERSON} FROM vista_gaps",
    "view_placeholder": f"SELECT {ROW}, {OFFICIAL} FROM vista",
    "status_labels": "SELECT seq, CASE estado WHEN 'OK' THEN 'VÁLIDO' ELSE 'SIN MATCH' END AS etiqueta "
    "FROM vista",
    "summary": "SELECT count(*) AS total, count(*) FILTER (WHERE estado = 'FUERA') AS fuera FROM vista",
    "only_unmatched": f"SELECT {ROW} FROM vista WHERE estado = 'FUERA'",
    "text_filter": f"SELECT {ROW} FROM fx_rows WHERE {HAS_TEXT}",
    "text_filter_case": f"SELECT {ROW} FROM fx_rows WHERE {HAS_CASED_TEXT}",
    "facet_filter": f"SELECT {ROW} FROM fx_rows WHERE {HAS_FACETS}",
    "facet_status": f"SELECT {ROW}, {OFFICIAL} FROM vista WHERE estado = 'OK' AND {HAS_FACETS}",
    "highlight": "SELECT seq, replace(nombre, '11', '<mark>11</mark>') AS nombre_marcado, "
    "replace(dni, '11', '<mark>11</mark>') AS dni_marcado FROM fx_rows",
    "highlight_case": r"SELECT seq, regexp_replace(nombre, '(R#00000001)', '<mark>\1</mark>', 'gi') "
    r"AS nombre_marcado, regexp_replace(dni, '(R#00000001)', '<mark>\1</mark>', 'gi') AS dni_marcado FROM fx_rows",
    "facet_states": "SELECT estado AS valor, CASE estado WHEN 'OK' THEN 1 ELSE 2 END AS pos, count(*) AS filas "
    "FROM vista GROUP BY estado",
    "facet_counts": " UNION ALL ".join(
        f"SELECT '{c}' AS columna, valor, count(*) FILTER (WHERE {' AND '.join(o)}) AS n "
        f"FROM (SELECT *, {c} AS valor FROM vista) WHERE valor <> '' GROUP BY valor"
        for c, o in {
            "estado": [HAS_FACETS],
            "ocupacion": ["area IN ('O', 'F')", "estado = 'OK'"],
            "area": ["ocupacion IN ('1-URGENT', '2-HIGH')", "estado = 'OK'"],
        }.items()
    ),
    "facet_rows": f"SELECT {ROW}, {OFFICIAL} FROM vista WHERE estado = 'OK' AND {HAS_FACETS}",
    "text_index": f"SELECT {ROW} FROM fx_rows WHERE {HAS_CASED_TEXT}",
    "lookup_reduced": f"SELECT {ROW}, estado, {PERSON} FROM vista",
    "facet_values": "SELECT valor, row_number() OVER (ORDER BY valor) AS pos FROM "
    "(SELECT DISTINCT nombre AS valor FROM fx_rows WHERE nombre <> '')",
    "sort_asc": _sorted("nombre", "ASC"),
    "sort_desc": _sorted("sourceFile", "DESC"),
    "sort_status": _sorted("estado", "ASC"),
    "sort_page": f"SELECT * FROM (SELECT {ROW}, {OFFICIAL}, row_number() OVER (ORDER BY lower(nombre) DESC, seq) AS pos "
    "FROM vista) WHERE pos BETWEEN 101 AND 150",
    "roster_search": "SELECT seq, dni, nombre, cargo, area FROM fx_roster "
    f"WHERE contains(lower(nombre), '0011') OR contains({_key('dni')}, '11') ORDER BY seq LIMIT 10",
    "view_full": f"SELECT {ROW}, {OFFICIAL}, row_number() OVER (ORDER BY lower(nombre) DESC, seq) AS pos "
    f"FROM vista WHERE estado = 'FUERA' AND {HAS_TEXT} AND {HAS_FACETS}",
    "nearest_name": f"SELECT {ROW}, vinculado FROM typos_vinculados",
    "nearest_shuffled": f"SELECT {ROW}, vinculado FROM typos_vinculados",
    "nearest_tokens": f"SELECT {ROW}, vinculado FROM token_vinculados",
    "link_count": "SELECT count(*) FILTER (WHERE vinculado) AS vinculados FROM typos_vinculados",
    "source_document": "SELECT seq, sourceFile, doc_seq, name AS documento, "
    "coalesce(mime LIKE 'image/%', false) AS visible FROM fx_rows LEFT JOIN "
    "(SELECT stem, arg_min(d.doc_seq, d.doc_seq) AS doc_seq, arg_min(d.name, d.doc_seq) AS name, "
    "arg_min(d.mime, d.doc_seq) AS mime FROM "
    "(SELECT DISTINCT split_part(lower(sourceFile), '.', 1) AS stem FROM fx_rows WHERE sourceFile <> '') "
    "JOIN fx_docs AS d ON contains(lower(d.name), stem) GROUP BY stem) "
    "ON sourceFile <> '' AND stem = split_part(lower(sourceFile), '.', 1)",
    "kept_view": f"SELECT {ROW}, {OFFICIAL} FROM vista_corregida",
    "kept_counts": " UNION ALL ".join(
        f"SELECT '{c}' AS columna, {c} AS valor, count(*) AS n FROM vista_corregida GROUP BY {c}"
        for c in ("estado", "method", "area")
    ),
    "kept_summary": "SELECT count(*) AS total, count(*) FILTER (WHERE estado = 'FUERA') AS fuera "
    "FROM vista_corregida",
    "corrections": "SELECT r.* EXCLUDE (dni, method), coalesce(u.dni, r.dni) AS dni, "
    "CASE WHEN u.seq IS NULL THEN method ELSE 'MANUAL' END AS method "
    "FROM fx_rows AS r LEFT JOIN ultimas AS u ON u.seq = r.seq",
    "append_remove_documents": "SELECT doc_seq, name, mime FROM fx_docs WHERE mime <> 'application/pdf' "
    "UNION ALL SELECT doc_seq + 1 + (SELECT max(doc_seq) FROM fx_docs WHERE mime <> 'application/pdf'), "
    "name, mime FROM fx_docs",
    "export_lines": f"SELECT NULL AS seq, '{EXPORT_HEADER}' AS line UNION ALL "
    f"SELECT seq, {LINE} FROM vista WHERE estado = 'OK'",
    "export_gaps": f"SELECT seq, {LINE} FROM vista_gaps WHERE estado = 'OK'",
    "export_view": f"SELECT row_number() OVER (ORDER BY lower(nombre) DESC, seq) AS pos, {LINE} FROM vista "
    f"WHERE estado = 'OK' AND {HAS_TEXT} AND {HAS_FACETS}",
    "export_files": f"SELECT '{EXPORT_HEADER}' AS line UNION ALL "
    f"SELECT {LINE} FROM vista WHERE estado = 'OK' AND {HAS_FACETS}",
    "payload_roundtrip": _with_ids(
        f"SELECT {PEOPLE}, row_number() OVER (PARTITION BY ocupacion ORDER BY seq) AS pos FROM vista WHERE estado = 'OK'"
    ),
    "payload_parts": "SELECT IdRef, 1 + (nth - 1) // 1000 AS parte, count(*) AS participantes, "
    """concat('{"IdRef":"', IdRef, '","participantes":[', """
    """string_agg(concat('{"Id":"x","ParticipanteDNI":"', ParticipanteDNI, '","Participante":"', Participante, """
    """'","Cargo":"', Cargo, '","Area":"', Area, '"}'), ',' ORDER BY nth), ']}') AS payload FROM """
    f"(SELECT {PEOPLE}, row_number() OVER (PARTITION BY ocupacion ORDER BY seq) AS nth "
    "FROM vista WHERE estado = 'OK') GROUP BY 1, 2",
    "payload_bytes": "WITH RECURSIVE personas AS MATERIALIZED (SELECT IdRef, pos, sum(octet_length(encode(concat("
    """'{"Id":"', Id, '","ParticipanteDNI":"', ParticipanteDNI, '","Participante":"', Participante, """
    """'","Cargo":"', Cargo, '","Area":"', Area, '"},')))) OVER (PARTITION BY IdRef ORDER BY pos) AS hasta, """
    """octet_length(encode(concat('{"IdRef":"', IdRef, '","participantes":[]}'))) AS marco FROM ("""
    + _with_ids(
        f"SELECT {PEOPLE}, row_number() OVER (PARTITION BY ocupacion ORDER BY seq) AS pos FROM vista WHERE estado = 'OK'",
        "pos",
    )
    + ")), "
    + _greedy("personas", "IdRef", "20000 + 1 - marco")
    + " SELECT IdRef, parte, participantes, CAST(bytes + any_marco - 1 AS BIGINT) AS bytes FROM (SELECT IdRef, parte, count(*) AS participantes, "
    "max(hasta) - min(antes) AS bytes, any_value(marco) AS any_marco FROM partes GROUP BY IdRef, parte)",
    "request_cuts": "WITH RECURSIVE tamanos AS MATERIALIZED (SELECT doc_seq, batch, pos, "
    "sum(octet_length(encode(concat('Archivo ', CAST(pos AS VARCHAR), ': ', name))) + (octet_length(encode(content)) + 2) // 3 * 4) "
    "OVER (PARTITION BY batch ORDER BY pos) AS hasta FROM (SELECT *, mime AS batch, "
    "row_number() OVER (PARTITION BY mime ORDER BY doc_seq) AS pos FROM fx_docs)), "
    + _greedy("tamanos", "batch", "20000")
    + " SELECT doc_seq, batch, pos, parte AS peticion FROM partes",
    "submit_register": _with_ids(
        f"SELECT {PEOPLE}, row_number() OVER (PARTITION BY ocupacion ORDER BY seq) AS pos FROM vista "
        "WHERE estado = 'OK' AND area IN ('O', 'F')"
    ),
    "submit_once": _with_ids(
        f"SELECT * REPLACE (concat(IdRef, ' ', area_) AS IdRef) FROM (SELECT {PEOPLE}, area AS area_, "
        "row_number() OVER (PARTITION BY ocupacion, area ORDER BY seq) AS pos FROM vista "
        "WHERE estado = 'OK' AND area IN ('O', 'F'))"
    ),
    "submit_refused": "SELECT seq, dni FROM vista_refs WHERE estado = 'OK' AND ocupacion = ''",
    "register_rows": "SELECT 'x1' AS Id, concat('R', CAST(doc_id AS VARCHAR)) AS IdRef, "
    "CAST(doc_id AS VARCHAR) AS ParticipanteDNI, source AS Participante, 'C' AS Cargo, '' AS Area "
    "FROM documents WHERE doc_id % 5 = 3",
    "register_rejects": "SELECT * FROM fx_payloads WHERE doc_id % 5 IN (0, 2, 4)",
    "register_replies": "SELECT doc_id, CASE WHEN doc_id % 5 IN (1, 3) THEN "
    """'{"success":true}' ELSE """
    f"'{REFUSED}' END AS reply FROM documents",
    "reconcile_typos": f"SELECT batch, pos, {ROW.removeprefix('seq, ')}, {OFFICIAL} "
    "FROM vista_final",
    "reconcile_full": f"SELECT batch, pos, {ROW.removeprefix('seq, ')}, {OFFICIAL} FROM vista_vinculadas",
}


RECURSIVE = "WITH RECURSIVE"


def _needed(text: str) -> set[str]:
    names: set[str] = set()
    for name in set(re.findall(r"\w+", text)) & COMMON.keys():
        names |= {name} | _needed(COMMON[name])
    return names


def oracle_sql() -> dict[str, str]:
    """Each query with the common table expressions it needs, in their order."""
    out = {}
    for key, text in QUERIES.items():
        names = _needed(text)
        common = ", ".join(f"{n} AS ({COMMON[n]})" for n in COMMON if n in names)
        if common and text.startswith(RECURSIVE):
            out[key] = f"{RECURSIVE} {common}, {text.removeprefix(RECURSIVE)}"
        else:
            out[key] = f"WITH {common} {text}" if common else text
    return out
