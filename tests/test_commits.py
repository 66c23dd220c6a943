"""Appends that count once, and ids that never meet."""

import pytest
from pyspark.sql import functions as F

from rosterlink.functions.text import ID_HALF, participant_id
from rosterlink.operators.lookup import lookup
from rosterlink.plans import read_once, submit_once
from rosterlink.plans.submit import submitted
from rosterlink.sinks import commits

SCHEMA = "a string, b string"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(f"a{i % 7}", None if i % 5 == 0 else f"b{i}") for i in range(100)], SCHEMA)


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_repeated_append_adds_nothing(spark, rows, tmp_path):
    path = str(tmp_path / "table")
    assert bag(commits.read_committed(spark, path, SCHEMA)) == []
    first = commits.append_once(rows, path)
    assert first.added and first.n_rows == 100
    again = commits.append_once(rows.repartition(5).orderBy("b"), path)
    assert again == (first.key, 100, False)
    assert bag(commits.read_committed(spark, path, SCHEMA)) == bag(rows)
    assert commits.append_once(rows.limit(99), path).added
    assert commits.append_once(rows.union(rows), path).added
    assert commits.read_committed(spark, path, SCHEMA).count() == 100 + 99 + 200


def test_content_tells_missing_from_empty_and_columns_apart(spark, tmp_path):
    path = str(tmp_path / "table")
    for data in ([("x", None)], [(None, "x")], [("x", "")], [("x", "x"), ("y", "y")], [("x", "y"), ("y", "x")]):
        assert commits.append_once(spark.createDataFrame(data, SCHEMA), path).added
    assert commits.read_committed(spark, path, SCHEMA).count() == 7


def test_cut_off_before_the_entry(spark, rows, tmp_path):
    path = str(tmp_path / "table")
    commits.stage(rows, path)
    assert bag(commits.read_committed(spark, path, SCHEMA)) == []
    # An entry whose job did not commit is not seen either.
    left = tmp_path / "table" / "commits" / "k" / "attempt" / "_temporary" / "0"
    left.mkdir(parents=True)
    (left / "part-00000.json").write_text('{"key":"k","attempt":"attempt","file":"f","n_rows":1}')
    assert bag(commits.read_committed(spark, path, SCHEMA)) == []
    assert commits.append_once(rows, path).added
    assert bag(commits.read_committed(spark, path, SCHEMA)) == bag(rows)


def test_two_runs_at_the_same_time(spark, rows, tmp_path, monkeypatch):
    """Both see no entry and both write one: readers take the same one."""
    path = str(tmp_path / "table")
    one, two = commits.stage(rows, path), commits.stage(rows, path)
    with monkeypatch.context() as blind:
        blind.setattr(commits, "_paths", lambda *_: [])
        assert commits.commit(spark, path, one).added and commits.commit(spark, path, two).added
    assert bag(commits.read_committed(spark, path, SCHEMA)) == bag(rows)
    assert {r.attempt for r in commits.committed(spark, path).collect()} == {min(one, two)}


def test_files_without_an_entry_are_removed(spark, rows, tmp_path):
    path = str(tmp_path / "table")
    commits.append_once(rows, path)
    commits.stage(rows, path)
    assert commits.remove_uncommitted(spark, path, 3600) == 0
    assert commits.remove_uncommitted(spark, path, 0) == 1
    assert bag(commits.read_committed(spark, path, SCHEMA)) == bag(rows)
    assert commits.append_once(rows.limit(0), path) == (None, 0, False)


def test_submission(spark, tmp_path):
    roster = spark.createDataFrame(
        [(i, f"{i:04d}", f"name {i}", "cargo", "área") for i in range(40)],
        "seq long, dni string, nombre string, cargo string, area string",
    )
    rows = spark.createDataFrame(
        [(i, f"{i % 50}", f"ref{i % 3}" if i < 90 else "") for i in range(100)], "seq long, dni string, ref string"
    )
    shown, path = lookup(rows, roster), str(tmp_path / "register")
    commits.stage(submitted(shown, F.col("ref")), path)
    done, told = submit_once(shown, F.col("ref"), path)
    assert done.added and sorted(r.seq for r in told.collect()) == [i for i in range(90, 100) if i % 50 < 40]
    assert not submit_once(shown.repartition(3), F.col("ref"), path)[0].added
    made = read_once(spark, path).collect()
    assert len(made) == done.n_rows == sum(i % 50 < 40 for i in range(90))
    assert len({(r.IdRef, r.Id) for r in made}) == len(made)


def feistel(ref, position):
    """The id, row by row."""
    import hashlib

    digest = hashlib.md5(ref.encode()).hexdigest()
    left, right = divmod((position - 1) % ID_HALF**2, ID_HALF)
    for r in range(4):
        x = right + int(digest[5 * r : 5 * r + 5], 16)
        left, right = right, (left + (x * x * 48271 + x * 69621) % (2**31 - 1)) % ID_HALF
    number, digits = left * ID_HALF + right, ""
    while number:
        number, d = divmod(number, 36)
        digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[d] + digits
    return "x" + (digits or "0")


def test_participant_ids(spark):
    places = spark.range(1, 200_001)
    for ref in ("R-1", "área"):
        made = places.select("id", participant_id(F.lit(ref), F.col("id")).alias("p"))
        assert made.select("p").distinct().count() == 200_000
        some = made.filter("id % 9973 = 1").collect()
        assert some and all(r.p == feistel(ref, r.id) for r in some)
    ends = spark.createDataFrame([(1,), (36**6,), (36**6 + 1,)], "id long")
    first, last, over = [r.p for r in ends.select(participant_id(F.lit("z"), F.col("id")).alias("p")).collect()]
    assert first == over == feistel("z", 1) and last == feistel("z", 36**6)


def test_half_of_the_rounds_is_a_permutation(spark):
    """All numbers of the left half at one right half go to as many different ids."""
    places = spark.range(ID_HALF).select((F.col("id") * ID_HALF + 8).alias("n"))
    made = places.select(participant_id(F.lit("k"), F.col("n")).alias("p"))
    assert made.distinct().count() == ID_HALF
