import pytest
from pyspark.sql import functions as F

from rosterlink.operators.documents import append_documents, remove_documents, source_document
from rosterlink.operators.edits import apply_corrections
from rosterlink.sources.documents import (
    read_documents,
    rejected_files,
    request_manifest,
    request_parts,
)


def listing(spark, data):
    return spark.createDataFrame(data, "doc_seq long, name string, mime string")


def sources(spark, files):
    return spark.createDataFrame(list(enumerate(files)), "seq long, sourceFile string")


@pytest.mark.parametrize("broadcast", [True, False])
def test_source_document(spark, broadcast):
    docs = listing(
        spark,
        [
            (4, "Sheet A1.pdf", "application/pdf"),
            (5, "a1.jpeg", "image/jpeg"),
            (2, "scan A10.JPEG", "image/jpeg"),
            (7, "zz.png", "image/png"),
        ],
    )
    rows = sources(spark, ["A1.jpeg", "", ".jpg", "ZZ", "missing.png", "sheet.x.y", None, "a10.png", "A1.jpeg"])
    got = {
        r["seq"]: (r["documento"]["doc_seq"] if r["documento"] else None, r["visible"])
        for r in source_document(rows, docs, broadcast=broadcast).collect()
    }
    assert got == {
        0: (2, True),
        1: (None, False),
        2: (2, True),
        3: (7, True),
        4: (None, False),
        5: (4, False),
        6: (None, False),
        7: (2, True),
        8: (2, True),
    }


def test_source_document_within_batch(spark):
    docs = listing(spark, [(1, "A1.png", "image/png"), (2, "A1.pdf", "application/pdf")])
    docs = docs.withColumn("batch", F.col("doc_seq"))
    rows = sources(spark, ["a1", "a1", "a1"]).withColumn("batch", F.col("seq"))
    got = {r["seq"]: r["documento"] for r in source_document(rows, docs, ["batch"]).collect()}
    assert got[0] is None and got[1]["doc_seq"] == 1 and got[2]["doc_seq"] == 2


def test_append_and_remove(spark):
    docs = listing(spark, [(0, "a", "m"), (3, "b", "m")])
    both = append_documents(docs, docs)
    assert [tuple(r) for r in both.select("doc_seq", "name").orderBy("doc_seq").collect()] == [
        (0, "a"),
        (3, "b"),
        (4, "a"),
        (7, "b"),
    ]
    removed = both.filter("doc_seq in (3, 4)")
    assert sorted(r["doc_seq"] for r in remove_documents(both, removed).collect()) == [0, 7]
    none = docs.filter(F.lit(False))
    assert append_documents(none, docs).count() == 2
    assert [r[0] for r in append_documents(none, docs).select("doc_seq").orderBy("doc_seq").collect()] == [0, 3]


def test_append_folders(spark):
    docs = listing(spark, [(0, "b", "m"), (3, "a", "m")]).withColumn(
        "doc_seq", F.struct(F.lit(0).alias("arrival"), F.col("name").alias("path"))
    )
    three = append_documents(append_documents(docs, docs), docs)
    got = [(r["doc_seq"]["arrival"], r["name"]) for r in three.orderBy("doc_seq").collect()]
    assert got == [(0, "a"), (0, "b"), (1, "a"), (1, "b"), (2, "a"), (2, "b")]


def test_corrections(spark):
    rows = spark.createDataFrame(
        [(0, "x", "DEFAULT"), (1, "y", "IA"), (2, "z", "DEFAULT")], "seq long, dni string, method string"
    )
    log = spark.createDataFrame([(1, 2, "late"), (1, 1, "early"), (2, 1, ""), (9, 1, "q")], "seq long, n int, dni string")
    for broadcast in (True, False, None):
        fixed = apply_corrections(rows, log, "n", broadcast=broadcast)
        got = {r["seq"]: (r["dni"], r["method"]) for r in fixed.collect()}
        assert got == {0: ("x", "DEFAULT"), 1: ("late", "MANUAL"), 2: ("", "MANUAL")}
    once = log.filter("n = 1")
    got = {r["seq"]: (r["dni"], r["method"]) for r in apply_corrections(rows, once).collect()}
    assert got[1] == ("early", "MANUAL")


def test_null_batches_are_numbered(spark):
    docs = spark.createDataFrame(
        [(1, "a", None), (2, "b", None), (3, "c", "x")], "doc_seq long, name string, batch string"
    )
    got = {r["doc_seq"]: r["etiqueta"] for r in request_manifest(docs, ["batch"]).collect()}
    assert got == {1: "Archivo 1: a", 2: "Archivo 2: b", 3: "Archivo 1: c"}


def test_every_image_type_is_read_and_the_rest_reported(spark, tmp_path):
    names = "a.jpg b.JFIF c.ico d.apng e.jpe f.jxl g.pdf h.webp i.svg j.tga".split()
    others = "x.txt y.unknown z noext.d/w.html".split()
    for name in [*names, *others]:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"data")
    read = read_documents(spark, str(tmp_path)).collect()
    assert sorted(r["name"] for r in read) == sorted(names)
    assert all(r["mime"].startswith("image/") or r["name"] == "g.pdf" for r in read)
    left = {r["path"].rsplit("/", 1)[1]: r["mime"] for r in rejected_files(spark, str(tmp_path)).collect()}
    assert left.keys() == {"x.txt", "y.unknown", "z", "w.html"}
    assert left["y.unknown"] is None and left["x.txt"] == "text/plain"


def test_request_parts(spark):
    docs = spark.createDataFrame(
        [(1, "a", "image/png", b"1" * 100, 7), (2, "b", "image/gif", None, 7), (3, "c", None, b"", None)],
        "doc_seq long, name string, mime string, content binary, batch long",
    )
    parts = sorted(request_parts(docs, ["batch"], "read").collect(), key=lambda r: (r.batch or 0, r.parte))
    assert [(r.batch, r.parte, r.text or r.mime) for r in parts] == [
        (None, 1, "Archivo 1: c"), (None, 2, None), (None, 3, "read"),
        (7, 1, "Archivo 1: a"), (7, 2, "image/png"), (7, 3, "Archivo 2: b"), (7, 4, "image/gif"), (7, 5, "read"),
    ]
    assert "\n" not in parts[4].base64 and len(parts[4].base64) == 136
