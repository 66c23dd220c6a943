"""Documents written under their names and read back."""

import pytest
from pyspark.sql import functions as F

from rosterlink.sinks.documents import NamedFilesWriter, Written, is_complete, write_documents
from rosterlink.sources.documents import read_documents, rejected_files

DATA = [
    ("Sheet A1.jpeg", b"\xff\xd8one"),
    ("ñandú 2.PNG", b""),
    ("scan.pdf", None),
    ("note.txt", b"text"),
    ("no extension", b"x"),
    ("a.b.Jpg", b"\x00" * 3_000_000),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DATA, "name string, content binary").repartition(3)


def test_round_trip(spark, docs, tmp_path):
    path = str(tmp_path / "scans")
    write_documents(docs, path)
    assert is_complete(spark, path)
    assert {p.name for p in (tmp_path / "scans").iterdir()} >= {n for n, _ in DATA}
    assert not any(p.name.startswith(".") and not p.name.endswith(".crc") for p in (tmp_path / "scans").iterdir())
    # Spark's reader passes over empty files.
    made = {r["name"]: (r["size"], r["mime"], bytes(r["content"])) for r in read_documents(spark, path).collect()}
    kinds = {"Sheet A1.jpeg": "image/jpeg", "ñandú 2.PNG": "image/png", "scan.pdf": "application/pdf", "a.b.Jpg": "image/jpeg"}
    assert made == {n: (len(c or b""), kinds[n], c or b"") for n, c in DATA if n in kinds and c}
    left = {r["path"].rsplit("/", 1)[1]: r["size"] for r in rejected_files(spark, path).collect()}
    assert left == {"note.txt": 4, "no extension": 1}
    write_documents(docs.filter("name = 'scan.pdf'").withColumn("content", F.lit(b"new")), path)
    assert (tmp_path / "scans" / "scan.pdf").read_bytes() == b"new"


@pytest.mark.parametrize("names", [["a.png", "a.png"], ["x/a.png"], [None], [""], ["_a.png"]])
def test_bad_names(spark, tmp_path, names):
    docs = spark.createDataFrame([(n, b"") for n in names], "name string, content binary")
    with pytest.raises(ValueError):
        write_documents(docs, str(tmp_path / "scans"))
    assert not (tmp_path / "scans").exists()


def test_a_failed_job_leaves_nothing(spark, docs, tmp_path):
    writer = NamedFilesWriter(str(tmp_path / "scans"))
    done = writer.write(iter(docs.limit(2).collect()))
    assert isinstance(done, Written) and len(done.names) == 2
    writer.abort([done, None])
    assert list((tmp_path / "scans").iterdir()) == []
    assert not is_complete(spark, str(tmp_path / "scans"))
    write_documents(docs.limit(0), str(tmp_path / "none"))
    assert is_complete(spark, str(tmp_path / "none"))
