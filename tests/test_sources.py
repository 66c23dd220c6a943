import pytest
from pyspark.sql import functions as F

from rosterlink.plans import extract
from rosterlink.sources.documents import accepted_documents, read_documents, request_manifest
from rosterlink.sources.responses import (
    HEADER,
    clean_responses,
    failed_batches,
    resolve_attempts,
    response_rows,
)
from rosterlink.sources.roster import parse_roster, read_roster


def lines(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq long, line string")


def people(df):
    return [tuple(r) for r in df.orderBy("seq").select("dni", "nombre", "cargo", "area").collect()]


def test_parse_roster(spark):
    df = lines(
        spark,
        [
            "  \r",
            "dni,b,c,d,e,nombre,g,h,cargo,area\r",
            '007,b,c,d,e,"Perez, Ana",g,h, jefe ,norte\r',
            "",
            "8,1\r",
            ",b,c,d,e,Sin Id,g,h,x,y",
            '"unclosed,b,c',
        ],
    )
    assert people(parse_roster(df)) == [
        ("007", "Perez, Ana", "jefe", "norte"),
        ("8", "", "", ""),
        ("unclosed,b,c", "", "", ""),
    ]


def test_read_roster_over_files_and_blocks(spark, tmp_path):
    one = ["　", "head,er"] + [f"{i},,,,,N{i},,,C,A" for i in range(4000)]
    two = ["other"] + [f"{i},,,,,M{i}\r" for i in range(5)]
    (tmp_path / "a.csv").write_text("\n".join(one), encoding="utf-8")
    (tmp_path / "b.csv").write_text("\n".join(two) + "\n", encoding="utf-8")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = people(read_roster(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    expected = [(str(i), f"N{i}", "C", "A") for i in range(4000)]
    expected += [(str(i), f"M{i}", "", "") for i in range(5)]
    assert got == expected


def test_read_documents(spark, tmp_path):
    for name in ("b.PDF", "a.jpeg", "c.html", "d.Png", "e", "sub/f.webp"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(name.encode())
    docs = read_documents(spark, str(tmp_path), arrival=2)
    rows = [
        (r["name"], r["size"], r["mime"], bytes(r["content"]).decode().split("/")[-1])
        for r in docs.orderBy("doc_seq").collect()
    ]
    assert rows == [
        ("a.jpeg", 6, "image/jpeg", "a.jpeg"),
        ("b.PDF", 5, "application/pdf", "b.PDF"),
        ("d.Png", 5, "image/png", "d.Png"),
        ("f.webp", 10, "image/webp", "f.webp"),
    ]
    assert docs.select("doc_seq.arrival").distinct().collect()[0][0] == 2


def test_accepted_documents(spark):
    df = spark.createDataFrame(
        [("image/png",), ("application/pdf",), ("text/html",), ("application/pdfx",), (None,)], "mime string"
    )
    assert {r[0] for r in accepted_documents(df).collect()} == {"image/png", "application/pdf"}


def test_request_manifest(spark):
    docs = spark.createDataFrame(
        [(5, "x", "b.png"), (1, "y", "c.png"), (2, "x", "a.png"), (9, "x", "d.pdf")],
        "doc_seq long, batch string, name string",
    )
    got = {(r["batch"], r["pos"], r["etiqueta"]) for r in request_manifest(docs, ["batch"]).collect()}
    assert got == {
        ("x", 1, "Archivo 1: a.png"),
        ("x", 2, "Archivo 2: b.png"),
        ("x", 3, "Archivo 3: d.pdf"),
        ("y", 1, "Archivo 1: c.png"),
    }


def attempts(spark, data):
    return spark.createDataFrame(
        data, "batch long, model_rank int, model string, response string, error string"
    )


def test_attempts(spark):
    df = attempts(
        spark,
        [
            (1, 1, "m1", "late", None),
            (1, 0, "m0", "", None),
            (2, 0, "m0", None, "quota"),
            (2, 2, "m2", "", None),
            (2, 1, "m1", None, "down"),
            (3, 0, "m0", " ", None),
            (3, 1, "m1", "full", None),
        ],
    )
    won = {r["batch"]: (r["modelUsed"], r["response"]) for r in resolve_attempts(df).collect()}
    assert won == {1: ("m1", "late"), 3: ("m0", " ")}
    failed = failed_batches(df).collect()
    assert [(r["batch"], r["tried"], r["last_error"]) for r in failed] == [
        (2, "m0, m1, m2", "Respuesta vacía del modelo.")
    ]
    assert failed[0]["message"] == (
        "Fallaron todos los modelos intentados (m0, m1, m2). Último error: Respuesta vacía del modelo."
    )
    # A lone blank is an answer without rows.
    assert {r["batch"] for r in extract(df).collect()} == set()


FENCE = "```"


@pytest.mark.parametrize(
    "response, csv",
    [
        (f"{FENCE}csv\n{HEADER}\n1;A\n{FENCE}", f"{HEADER}\n1;A"),
        (f"{FENCE}TXT\n{HEADER}\n1;A", f"{HEADER}\n1;A"),
        (f"{FENCE}\n1;A\n{FENCE}", f"{HEADER}\n1;A"),
        (f"{HEADER}\n1;A\n{FENCE}\n", f"{HEADER}\n1;A\n{FENCE}"),
        (f"{FENCE}json\n{HEADER}\n1;A", f"{FENCE}json\n{HEADER}\n1;A"),
        (" nro;SOURCEFILE\n1;A \r\n", "nro;SOURCEFILE\n1;A"),
        (" ", f"{HEADER}\n"),
    ],
)
def test_clean_responses(spark, response, csv):
    df = spark.createDataFrame([(1, response)], "batch long, response string")
    assert clean_responses(df).first()["csv"] == csv


def test_response_rows(spark):
    text = "\n".join(
        [
            "anything",
            "1;A;9;op;ar; f.png \r;extra",
            "2;;;x;y;z",
            "3; ;;x;y;z",
            "4;B;9",
            "```",
            '5;"C;9";8',
        ]
    )
    df = spark.createDataFrame([(7, text)], "batch long, csv string")
    got = [tuple(r)[2:] for r in response_rows(df).orderBy("seq").collect()]
    assert got == [
        (1, "1", "A", "9", "op", "ar", "f.png", "DEFAULT"),
        (3, "3", " ", "", "x", "y", "z", "DEFAULT"),
        (4, "4", "B", "9", "", "", "", "DEFAULT"),
        (6, "5", '"C', '9"', "8", "", "", "DEFAULT"),
    ]


def test_unknown_fence_keeps_header_as_row(spark):
    df = spark.createDataFrame([(1, f"{FENCE}json\n{HEADER}\n1;A;2")], "batch long, response string")
    rows = response_rows(clean_responses(df)).orderBy("seq").select(F.col("nombre")).collect()
    assert [r[0] for r in rows] == ["Apellidos y Nombres", "A"]
