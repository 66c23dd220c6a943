"""The pipeline against its stages' rules, document by document."""

import numpy as np
import pytest
from test_rules import plain
from test_sketches import expected as components_of
from test_sketches import find, grams
from tokenizers import Tokenizer

import corpus_pipeline
from rosterlink.llm import toxicity
from rosterlink.llm.queries import table
from rosterlink.llm.settings import vocabulary

FOLDER = "/root/testdata/sf0.001"


def test_stages():
    assert [f for _, f in corpus_pipeline.STAGES] == [
        corpus_pipeline.without_toxic,
        corpus_pipeline.of_quality,
        corpus_pipeline.without_near_duplicates,
        corpus_pipeline.packed,
    ]


def test_run(spark):
    docs = {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}
    scores = toxicity.toxicity_scores(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels"))
    left = {r.doc_id: docs[r.doc_id] for r in scores.collect() if r.score < 0.5}
    assert 0 < len(left) < len(docs)

    def good(text):
        p = plain(text)
        lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
        upper = sum(w.isupper() for w in text.split())
        return not (
            p["n_words"] < 50
            or 100 * p["n_repeat_words"] > 50 * p["n_words"]
            or p["n_symbols"] > 0.1 * p["n_words"]
            or p["n_dup_lines"] > 0.5 * len(lines)
            or upper > 0.3 * p["n_words"]
        )

    left = {i: t for i, t in left.items() if good(t)}
    left = {r[1]: left[r[1]] for r in components_of(list(left.items()), 80) if r[5]}
    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    tokens = {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    made = corpus_pipeline.run(spark, FOLDER).collect()
    got = {}
    for r in made:
        assert r.offset + r.length <= 4096 and r.doc_tokens == tokens[r.doc_id]
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == tokens
    places = sorted((r.sequence_id * 4096 + r.offset, r.length) for r in made)
    assert np.array_equal([a for a, _ in places], np.cumsum([0, *(n for _, n in places[:-1])]))


@pytest.mark.parametrize("stage", range(3))
def test_filters_return_the_columns_of_documents(spark, stage):
    docs = table(spark, FOLDER, "documents").selectExpr("*", "1 as score", "2 as failed", "3 as row")
    made = corpus_pipeline.STAGES[stage][1](spark, docs, FOLDER)
    assert made.schema.names == docs.schema.names
    assert made.exceptAll(docs).count() == 0 and 0 < made.count() < docs.count()
    assert corpus_pipeline.STAGES[stage][1](spark, docs.limit(0), FOLDER).count() == 0


def test_near_duplicates_from_80_per_cent_on(spark):
    base = [f"w{i}" for i in range(204)]
    # 200 sets of five words; n new words at the end leave 200 - n of 200 + n.
    rows = [(100 + n, " ".join([*base[: 204 - n], *(f"n{n}x{i}" for i in range(n))]), 200 - n) for n in (20, 22, 23)]
    for doc_id, text, shared in rows:
        pair = spark.createDataFrame([(1, " ".join(base)), (doc_id, text)], "doc_id long, text string")
        kept = {r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, pair, FOLDER).collect()}
        assert kept == ({1} if 100 * shared >= 80 * (400 - shared) else {1, doc_id})


def test_near_duplicates_against_all_pairs_at_80_per_cent(spark):
    docs = table(spark, FOLDER, "documents")
    sets = [(r.doc_id, grams(r.text)) for r in docs.orderBy("doc_id").collect()]
    parent = {i: i for i, _ in sets}
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            n = len(s & t)
            if n and 100 * n >= 80 * (len(s) + len(t) - n):
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    made = corpus_pipeline.without_near_duplicates(spark, docs, FOLDER)
    assert {r.doc_id for r in made.collect()} == {i for i in parent if find(parent, i) == i}


def test_repeated_rows_and_rows_without_an_id_are_reduced(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, one), (5, one), (None, one), (3, one), (None, two), (None, two), (7, "own " + two[:90]), (7, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = corpus_pipeline.without_near_duplicates(spark, docs, FOLDER).collect()
    assert sorted((r.doc_id, r.text) for r in made) == [(3, one), (7, two), (7, "own " + two[:90])]


def test_packing_of_odd_rows(spark):
    rows = [(None, "one two", 1), (None, "one two", 1), (4, None, 2), (4, "", 2), (5, "x " * 9000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int")
    made = corpus_pipeline.packed(spark, docs, FOLDER).collect()
    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = sorted((i is None, i or 0, len(lib.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in rows)
    whole = sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens) for r in made if r.start == 0)
    assert whole == want
    assert sum(r.length for r in made) == sum(n for _, _, n in want)
    assert corpus_pipeline.packed(spark, docs.limit(0), FOLDER).count() == 0


def test_first_stages_with_odd_rows(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, None), (2, ""), (None, good), (None, good), (3, good)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, FOLDER).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted(rows, key=repr)
    kept = stages["quality rules"](spark, docs, FOLDER).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted(rows[2:], key=repr)


def test_work_tables_are_deleted(spark, monkeypatch):
    from rosterlink import durable

    durable.remove_stored(spark)
    corpus_pipeline.run(spark, FOLDER).count()
    # One result of each stage but the last, and the encoded documents of the last.
    assert durable.remove_stored(spark) == len(corpus_pipeline.STAGES)
