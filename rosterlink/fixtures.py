"""Inputs of the registered queries, derived from the TPC-H-like tables.

Each text runs in Spark and in DuckDB, apart from the mark ``<ranks>``: seven
attempts for each row of a table.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession

ROSTER = """
SELECT c_custkey AS seq, lpad(CAST(c_custkey AS VARCHAR(20)), 8, '0') AS dni, c_name AS nombre,
       c_mktsegment AS cargo, n_name AS area
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""

ROWS = """
SELECT o_orderkey AS seq, CAST(o_orderkey AS VARCHAR(20)) AS nro, coalesce(c_name, '') AS nombre,
       CASE o_orderkey % 5 WHEN 0 THEN concat('X', CAST(o_custkey AS VARCHAR(20)))
                           WHEN 1 THEN CAST(o_custkey AS VARCHAR(20))
                           WHEN 2 THEN concat('000', CAST(o_custkey AS VARCHAR(20)), ' ')
                           ELSE lpad(CAST(o_custkey AS VARCHAR(20)), 8, '0') END AS dni,
       o_orderpriority AS ocupacion, o_orderstatus AS area,
       concat('A', CAST(o_orderkey % 12 AS VARCHAR(20)), '.jpeg') AS sourceFile, 'DEFAULT' AS method
FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey
"""

# Comma lines as an official roster file has them, with a header and blanks.
LINES = """
SELECT seq, concat(dni, ',x,x,x,x,"', nombre, ', ', cargo, '",x,x, ', cargo, ' ,', area, chr(13)) AS line
FROM {fx_roster}
UNION ALL SELECT -2 - n_nationkey * 2 AS seq, concat(' ', chr(13)) AS line FROM {nation}
UNION ALL SELECT -1 - n_nationkey * 2 AS seq, concat(',', n_name, ',no id') AS line FROM {nation}
"""

ATTEMPTS = """
SELECT doc_id AS batch, r AS model_rank, concat('model_', CAST(r AS VARCHAR(20))) AS model,
       CASE WHEN doc_id % 11 = 0 OR r < doc_id % 7 THEN CASE WHEN doc_id % 2 = 0 THEN '' END
            ELSE concat(CAST(r AS VARCHAR(20)), ':', text) END AS response,
       CASE WHEN (doc_id % 11 = 0 OR r < doc_id % 7) AND doc_id % 2 = 1
            THEN concat('error ', CAST(r AS VARCHAR(20))) END AS error
FROM <ranks>
"""

RESPONSES = """
SELECT o_orderkey AS batch,
       concat(CASE o_orderkey % 4 WHEN 0 THEN concat('```csv', chr(10)) WHEN 1 THEN concat('```TXT', chr(10))
                                  WHEN 2 THEN concat('```', chr(10)) ELSE '' END,
              CASE WHEN o_orderkey % 3 = 0 THEN ''
                   ELSE concat('Nro;Apellidos y Nombres;DNI;Ocupacion;Area;SourceFile', chr(10)) END,
              '1;', nombre, ';', dni, ';', ocupacion, ';', area, '; ', sourceFile, ' ', chr(10),
              '2;;;x;y;z', chr(10), '3;SHORT;', nro,
              CASE WHEN o_orderkey % 4 < 3 THEN concat(chr(10), '```') ELSE '' END) AS response
FROM {fx_rows} JOIN {orders} ON seq = o_orderkey
"""

# Every attempt of every batch: the ranks below a batch's own one failed.
EXTRACTIONS = """
SELECT batch, r AS model_rank, concat('model_', CAST(r AS VARCHAR(20))) AS model,
       CASE WHEN r >= batch % 3 THEN response WHEN batch % 2 = 0 THEN '' END AS response,
       CASE WHEN r < batch % 3 AND batch % 2 = 1 THEN 'quota' END AS error
FROM <ranks>
"""

DOCS = """
SELECT page_id AS doc_seq,
       concat('Sheet A', CAST(page_id AS VARCHAR(20)),
              CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 3 THEN '.html' ELSE '.jpeg' END) AS name,
       CAST(length(html) AS BIGINT) AS size,
       CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 3 THEN 'text/html' ELSE 'image/jpeg' END AS mime,
       html AS content
FROM {pages}
"""

# A log of two corrections for each unreadable id; the later one counts.
CORRECTIONS = """
SELECT seq, 1 AS turno, '99999999999' AS dni FROM {fx_rows} WHERE dni LIKE 'X%'
UNION ALL
SELECT seq, 2 AS turno, CASE WHEN area = 'O' THEN dni ELSE substring(dni, 2) END AS dni
FROM {fx_rows} WHERE dni LIKE 'X%'
"""

# Names as a reader gets them wrong: other case, one character lost, another
# form of the number, and nothing like a roster name.
TYPOS = """
SELECT seq, nro,
       CASE seq % 4
            WHEN 0 THEN upper(nombre)
            WHEN 1 THEN concat(substring(nombre, 1, CAST(seq % 7 AS INT) + 1),
                               substring(nombre, CAST(seq % 7 AS INT) + 3))
            WHEN 2 THEN replace(nombre, '#', ' no. ')
            ELSE reverse(nombre) END AS nombre,
       dni, ocupacion, area, sourceFile, method
FROM {fx_rows}
"""

# A roster with missing fields, and with the same id several times: some earlier, some
# later, with other zeros. The first by ``seq`` counts.
GAPS_ROSTER = """
SELECT seq, dni, nombre, CASE WHEN seq % 3 <> 0 THEN cargo END AS cargo,
       CASE WHEN seq % 4 <> 0 THEN area END AS area FROM {fx_roster}
UNION ALL
SELECT seq + 1000000000 AS seq, concat('00', dni) AS dni, concat(nombre, ' later') AS nombre, cargo, area
FROM {fx_roster} WHERE seq % 2 = 0
UNION ALL
SELECT -1 - seq AS seq, CAST(seq AS VARCHAR(20)) AS dni, concat(nombre, ' earlier') AS nombre, cargo, area
FROM {fx_roster} WHERE seq % 5 = 0
"""

# Rows with any of their fields missing.
GAPS_ROWS = """
SELECT seq, CASE WHEN seq % 7 <> 0 THEN nro END AS nro, CASE WHEN seq % 5 <> 0 THEN nombre END AS nombre,
       CASE WHEN seq % 11 <> 0 THEN dni END AS dni, CASE WHEN seq % 3 <> 0 THEN ocupacion END AS ocupacion,
       CASE WHEN seq % 4 <> 0 THEN area END AS area, CASE WHEN seq % 6 <> 0 THEN sourceFile END AS sourceFile,
       CASE WHEN seq % 9 <> 0 THEN method END AS method
FROM {fx_rows}
"""

# Documents in batches, one of which has no name.
GAPS_DOCS = """
SELECT doc_seq, name, mime, content, CASE WHEN doc_seq % 3 <> 0 THEN mime END AS batch FROM {fx_docs}
"""

# Payloads as they come in: no JSON at all, nobody in it, no list, one person, cut off.
PAYLOADS = """
SELECT doc_id, CASE doc_id % 5
  WHEN 0 THEN text
  WHEN 1 THEN '<open>"IdRef":"test","participantes":[]<close>'
  WHEN 2 THEN '<open>"IdRef":"test"<close>'
  WHEN 3 THEN concat('<open>"IdRef":"R', CAST(doc_id AS VARCHAR(20)),
    '","participantes":[<open>"Id":"x1","ParticipanteDNI":"', CAST(doc_id AS VARCHAR(20)),
    '","Participante":"', source, '","Cargo":"C"<close>]<close>')
  ELSE '<open>"IdRef":"test","participantes":[<open>"Id":"x1"' END AS payload
FROM {documents}
"""

# Names made of a few common words, so that many share their parts; asked for with
# one character lost.
TOKEN_ROSTER = """
SELECT p_partkey AS seq, lpad(CAST(p_partkey AS VARCHAR(20)), 8, '0') AS dni,
       concat(p_type, ' ', p_name, ' ', p_brand) AS nombre, p_type AS cargo, p_brand AS area
FROM {part}
"""

TOKEN_ROWS = """
SELECT seq, CAST(seq AS VARCHAR(20)) AS nro,
       concat(substring(nombre, 1, CAST(seq % 9 AS INT) + 1), substring(nombre, CAST(seq % 9 AS INT) + 3)) AS nombre,
       concat('X', CAST(seq AS VARCHAR(20))) AS dni, cargo AS ocupacion, area, 'A1.jpeg' AS sourceFile, 'DEFAULT' AS method
FROM {fx_token_roster}
"""

# Answers that hold the mistyped names.
TYPO_ATTEMPTS = """
SELECT seq AS batch, r AS model_rank, concat('model_', CAST(r AS VARCHAR(20))) AS model,
       CASE WHEN r >= seq % 3 THEN concat('Nro;Apellidos y Nombres;DNI;Ocupacion;Area;SourceFile', chr(10),
         nro, ';', nombre, ';', dni, ';', ocupacion, ';', area, ';', sourceFile) END AS response,
       CASE WHEN r < seq % 3 THEN 'quota' END AS error
FROM <ranks>
"""

VIEWS = {
    "fx_roster": ROSTER,
    "fx_rows": ROWS,
    "fx_lines": LINES,
    "fx_attempts": ATTEMPTS,
    "fx_responses": RESPONSES,
    "fx_extractions": EXTRACTIONS,
    "fx_docs": DOCS,
    "fx_corrections": CORRECTIONS,
    "fx_typos": TYPOS,
    "fx_gaps_roster": GAPS_ROSTER,
    "fx_gaps_rows": GAPS_ROWS,
    "fx_gaps_docs": GAPS_DOCS,
    "fx_payloads": PAYLOADS,
    "fx_token_roster": TOKEN_ROSTER,
    "fx_token_rows": TOKEN_ROWS,
    "fx_typo_attempts": TYPO_ATTEMPTS,
}

_RANKED = {
    "fx_attempts": "documents",
    "fx_extractions": "fx_responses",
    "fx_typo_attempts": "fx_typos",
}


def build(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view above, or a table of ``folder``, as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    ranked = _RANKED.get(name, "")
    text = VIEWS[name].replace(
        "<ranks>", f"(SELECT *, explode(sequence(0, 6)) AS r FROM {{{ranked}}}) AS k"
    )
    inputs = {n: build(spark, folder, n) for n in _inputs(text)}
    return spark.sql(_braces(text, "{{", "}}"), **inputs)


def duckdb_text(name: str) -> str:
    """The same view for DuckDB, over tables and views of these names."""
    ranked = _RANKED.get(name, "")
    text = VIEWS[name].replace(
        "<ranks>", f"(SELECT *, unnest(range(0, 7)) AS r FROM {{{ranked}}}) AS k"
    )
    return _braces(text.format(**{n: n for n in _inputs(text)}), "{", "}")


def _braces(text: str, opening: str, closing: str) -> str:
    """Braces that are part of a text, not the mark of an input."""
    return text.replace("<open>", opening).replace("<close>", closing)


def _inputs(text: str) -> list[str]:
    return sorted({field for _, field, _, _ in Formatter().parse(text) if field})
