"""The two classifiers: held-out accuracy, whole texts, gradients, restored words."""

import itertools
import zlib

import numpy as np
import pytest

from rosterlink.llm import convnet, labelled, toxicity
from rosterlink.llm.queries import QUERIES, table

FOLDER = "/root/testdata/sf0.1"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def accuracy(rows, labels, name):
    told = {r.doc_id: r[name] for r in labels.collect() if r[name] is not None}
    own = [(r, told[r.doc_id]) for r in rows if r.held_out and r.doc_id in told]
    assert all(r.held_out == held(r.doc_id) for r in rows)
    good = [r.score for r, y in own if y == 1]
    bad = [r.score for r, y in own if y == 0]
    ranked = np.mean([[(g > b) + (g == b) / 2 for b in bad] for g in good])
    return ranked, np.mean([r.predicted == y for r, y in own]), len(own)


def test_quality_of_held_out_documents(spark):
    rows = QUERIES["op8_byte_network"](spark, FOLDER).collect()
    ranked, right, n = accuracy(rows, table(spark, FOLDER, "labels"), "quality")
    assert n > 500 and ranked > 0.98 and right > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_toxicity_of_held_out_documents(spark):
    rows = QUERIES["op9_toxicity"](spark, FOLDER).collect()
    ranked, right, n = accuracy(rows, table(spark, FOLDER, "labels"), "toxic")
    assert n > 500 and ranked > 0.93 and right > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_network_gradient():
    net = convnet.fresh()
    net.bias += 0.1
    texts = [b"some text " * 60, b"", b"x", bytes(range(256)) * 3]
    labels = np.array([1, 0, 0, 1], dtype=np.float32)

    def loss():
        p = convnet.score(net, texts)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    made = convnet._gradients(net, texts, labels)
    random = np.random.default_rng(3)
    for parameter, gradient in zip(net.parameters(), made, strict=True):
        flat, slopes = parameter.reshape(-1), gradient.reshape(-1)
        used = np.flatnonzero(slopes)
        for i in random.choice(used, min(12, len(used)), replace=False):
            kept = flat[i]
            flat[i] = kept + 1e-2
            up = loss()
            flat[i] = kept - 1e-2
            down = loss()
            flat[i] = kept
            assert abs((up - down) / 2e-2 - slopes[i]) < 2e-3 + 0.05 * abs(slopes[i])


def test_chunks_cover_every_byte():
    net = convnet.fresh()
    net.table[:] = 0
    net.table[0, ord("!"), 0] = 5.0
    net.layer[:] = 0
    net.layer[0] = 1.0
    plain = convnet.score(net, [b"a" * 1500])[0]
    for at in (0, 1, 63, 64, 191, 192, 255, 256, 800, 1498, 1499):
        text = bytearray(b"a" * 1500)
        text[at] = ord("!")
        assert convnet.score(net, [b"", bytes(text), b"!"])[1] > plain + 0.1
    lengths = np.array([0, 1, 64, 65, 192, 256, 257, 5000]) + convnet.WIDTH
    starts, reach, first = convnet._layout(lengths)
    borders = np.concatenate((first, [len(reach)]))
    cells = np.maximum(1, -(-lengths // convnet.CELL))
    for d in range(len(lengths)):
        own = reach[borders[d] : borders[d + 1]]
        assert set(own.ravel()) == set(range(cells[:d].sum(), cells[: d + 1].sum()))


def test_scores_do_not_depend_on_company():
    net = convnet.fresh()
    texts = [b"abc " * n for n in (0, 1, 40, 3000, 50000)]
    together = convnet.score(net, texts)
    for text, p in zip(texts, together, strict=True):
        assert abs(convnet.score(net, [text])[0] - p) < 1e-6


EDGES = [(1, None), (1, ""), (None, "you idiot"), (2, "x" * 100000), (3, "an idiot " + "word " * 20), (3, "an idiot")]


@pytest.fixture
def small(spark):
    docs = spark.createDataFrame([(i, t, 0.5, "r") for i, t in EDGES], "doc_id long, text string, score double, row string")
    train = [i for i in range(1000, 1400) if not held(i)]
    words = spark.createDataFrame(
        [(i, f"plain text number {i} " + ("idiot " if i % 2 else "fine ") * 3, 0.1, "q") for i in train], docs.schema
    )
    labels = spark.createDataFrame(
        [(i, i % 2, i % 2) for i in train] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int"
    )
    return docs, docs.union(words), labels


def test_edges(spark, small):
    docs, all_docs, labels = small
    for made in (
        convnet.quality_scores(all_docs, labels).filter("doc_id is null or doc_id < 10"),
        toxicity.toxicity_scores(all_docs, labels).filter("doc_id is null or doc_id < 10"),
        convnet.quality_scores(docs, labels.limit(0)),
        toxicity.toxicity_scores(docs, labels.limit(0)),
    ):
        rows = made.collect()
        assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 1, 2, 3, 3]
        assert all(0 <= r.score <= 1 for r in rows)
        scores = [r.score for r in rows if r.doc_id == 1]
        assert abs(scores[0] - scores[1]) < 1e-9
    toxic = toxicity.toxicity_scores(all_docs, labels).filter("predicted = 1")
    assert {(r.doc_id, *r.terms) for r in toxic.collect() if (r.doc_id or 0) < 10} == {(None, "idiot"), (3, "idiot")}
    assert convnet.quality_scores(docs.limit(0), labels).count() == 0
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


def test_sample_is_bounded_and_leaves_held_out_rows(spark, small):
    _, docs, labels = small
    texts = labelled.sample(docs, labels, "toxic", most=50)
    assert len(texts) == 50 and texts == labelled.sample(docs.repartition(7), labels, "toxic", most=50)
    everything = labels.union(spark.createDataFrame([(5, 1, 1), (8, 1, 1)], labels.schema))
    ids = {int(t.split()[3]) for t, _ in labelled.sample(docs, everything, "toxic")}
    assert not any(map(held, ids))


DISGUISES = {
    "1d10t": "idiot", "i d i o t": "idiot", "I.D.I.O.T": "idiot", "idiiiot": "idiot", "m0r0n": "moron",
    "$tupid": "stupid", "5tup1d!!": "stupid", "tr@sh": "trash", "st*pid": "stupid", "l0$er###": "loser",
    "w0rthle$$": "worthless", "worthlesss": "worthless", "s-t-u-p-i-d": "stupid", "i  d  i  o  t": "idiot",
    "you are s t u p i d a lot": "stupid", "p@th3t1c": "pathetic", "cl0wn.": "clown", "d!sgust!ng": "disgusting",
}


@pytest.fixture(scope="module")
def reader(spark):
    return toxicity.Reader(toxicity.learned(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")))


@pytest.mark.parametrize("text", DISGUISES)
def test_disguised_words(reader, text):
    found, n = reader.terms(f"and the {text} of it")
    assert DISGUISES[text] in found and reader.score(found, n) > 0.5
    assert any(DISGUISES[text] in b for _, b in reader.restored(text))


def test_long_disguised_words_take_time_in_proportion(reader):
    for text in ("1a" * 200000, "a b " * 100000, "i" * 300000, "x$" * 100000 + " idiot"):
        found, _ = reader.terms(text)
        assert ("idiot" in found) == ("idiot" in text)


@pytest.mark.parametrize("text", ["closer", "a a a a a a", "7zip", "9233A8ECF7C5B09FE594", "", "1234", "the *** end", "a.b.c.d"])
def test_undisguised_words(reader, text):
    found, n = reader.terms(text)
    assert not found and reader.score(found, n) < 0.5


MORE_DISGUISES = {
    "i d ! o t": "idiot", "$ t u p i d": "stupid", "i/d/i/o/t": "idiot", "i,d,i,o,t": "idiot", "i|d|i|o|t": "idiot",
    "i     d\n\ni     o \t t": "idiot", "id-iot": "idiot", "stu.pid": "stupid", "lo-ser": "loser", "idiiots": "idiot",
    "stuppid": "stupid", "pathettic": "pathetic", "worrthless": "worthless", "s c u m": "scum", "s. c. u. m!": "scum",
    "i*d*i*o*t": "idiot", "m o r 0 n": "moron",
}


@pytest.mark.parametrize("text", MORE_DISGUISES)
def test_more_disguised_words(reader, text):
    found, n = reader.terms(f"and the {text} of it")
    assert MORE_DISGUISES[text] in found and reader.score(found, n) > 0.5


@pytest.mark.parametrize("text", ["looser", "Looser,", "(looser)!", "looser###", "looses", "trass", "los-er", "i.e. idle", "7 , 5 , 3"])
def test_words_that_only_look_like_terms(reader, text):
    found, n = reader.terms(f"a {text} fit")
    assert not found and reader.score(found, n) < 0.5


def test_words_of_three_letters_set_apart():
    rows = [(f"text {i} " + ("oaf " if i % 2 else "fine "), i % 2) for i in range(200)]
    reader = toxicity.Reader(toxicity.fit(rows, np.ones(toxicity._SIZE**3, dtype=np.int64)))
    assert "oaf" in reader.terms("o a f")[0] and "oaf" in reader.terms("0/@/f")[0]


def test_adverse_texts_take_time_in_proportion(reader):
    for text in ("a*" * 100000, "los-" * 60000, "aa-" * 60000, "i!d!" * 50000, "x" + "-" * 200000 + " y"):
        assert not reader.terms(text)[0]


def all_readings(token, chars, inner_end, kept):
    """Cost of each reading of a token, from every path of its lattice."""
    kept = kept if any(c.isalpha() for c in token) else 0.0
    found = {}

    def go(at, a, b, read, before, cost):
        if at == len(token):
            total = cost - chars[a, b, 0]
            found[read] = min(total, found.get(read, np.inf))
            return
        c = token[at]
        letters = toxicity.LOOKS_LIKE.get(c, "")
        ends = not c.isalnum() and 0 < at < len(token) - 1
        after = before if ends else c
        if ends:
            go(at + 1, a, b, read, after, cost + toxicity.APART)
            go(at + 1, 0, 0, read + " ", after, cost + inner_end - chars[a, b, 0])
        for x in (c, *letters):
            if x == c and ends and (not letters or c == "*"):
                continue
            extra = toxicity.REPLACED if x != c else kept if letters else 0.0
            code = toxicity._NUMBER.get(x, 1)
            go(at + 1, b, code, read + x, after, cost + extra - chars[a, b, code])
        if read and b > 1 and (c in (before, read[-1]) or read[-1] in letters):
            go(at + 1, a, b, read, after, cost + toxicity.REPEATED)

    go(0, 0, 0, "", "", 0.0)
    return found


@pytest.mark.parametrize("costs", [(0.0, 0.0), (toxicity.INNER_END, toxicity.KEPT)])
def test_best_reading_against_every_path(costs):
    random = np.random.default_rng(8)
    chars = np.log(random.dirichlet(np.full(toxicity._SIZE, 0.3), (toxicity._SIZE, toxicity._SIZE)) + 1e-6)
    tokens = ["".join(random.choice(list("aiost1$!0 *4"), n)).strip() for n in range(1, 8) for _ in range(40)]
    tokens += ["a", "1", "1d10t", "i d i", "ss", "$$a", "a$$", "b*a", "l|l", "7 5 3", "aa!!"]
    for token in (toxicity.closed(t) for t in tokens if t):
        every = all_readings(token, chars, *costs)
        read, cost = toxicity.restore(token, chars, True, *costs)
        assert abs(cost - min(every.values())) < 1e-9
        assert abs(every[read] - cost) < 1e-9


SET_APART = {"spaced": " ".join, "dotted": ".".join, "dashed": "-".join, "slashed": "/".join}
TERMS = ["idiot", "moron", "stupid", "trash", "loser", "worthless", "pathetic", "clown", "disgusting", "scum"]


@pytest.mark.parametrize("form", SET_APART)
def test_terms_set_apart_are_one_word(reader, form):
    for term in TERMS:
        assert term in reader.terms(f"and the {SET_APART[form](term)} of it")[0]


def test_look_alikes_in_whole_terms(reader):
    tables = [str.maketrans("aeiost", "431057"), str.maketrans("aeio", "@3!0")]
    for term, marks, form in itertools.product(TERMS, tables, ("".join, " ".join)):
        assert term in reader.terms(f"and the {form(term.translate(marks))} of it")[0]


@pytest.mark.parametrize("term", TERMS)
def test_other_scripts_accents_and_wide_letters(reader, term):
    cyrillic = term.translate(str.maketrans("aeocp", "\u0430\u0435\u043e\u0441\u0440"))
    accents = term.translate(str.maketrans("aeiou", "\u00e1\u00e9\u00ed\u00f3\u00fa"))
    wide = "".join(chr(ord(c) + 0xFEE0) for c in term)
    for text in (cyrillic, accents, wide, " ".join(wide)):
        assert term in reader.terms(f"and the {text} of it")[0]


def test_terms_are_no_passages_and_may_be_rare():
    random = np.random.default_rng(4)
    words = ["".join(random.choice(list("bcdfgaeiou"), 6)) for _ in range(400)]
    rows = []
    for i in range(2000):
        text = list(random.choice(words, 30))
        if i % 10 == 0:
            # A rare term, a passage that toxic texts share, and a word said over and over in one text.
            text += ["zzyzx", *random.choice(words, 2)] if i % 80 == 0 else []
            text += ["one", "passage", "quoted", "here"] if i % 20 == 0 else []
            text += ["again"] * 500 if i == 10 else []
        rows.append((" ".join(text), int(i % 10 == 0)))
    terms = toxicity.learn_terms(rows)
    assert any("zzyzx".startswith(t) for t in terms)
    assert not any(w.startswith(t) for t in terms for w in ("passage", "quoted", "again"))
    assert toxicity.learn_terms([]) == {} and toxicity.learn_terms([("", 1), ("a", 0)]) == {}


def test_ordinary_words_are_not_learned(reader):
    assert not any(w.startswith(t) for t in reader.model.weights for w in ("things", "the", "und", "que", "por"))


def test_network_against_a_plain_loop():
    net = convnet.fresh(3)
    net.bias += np.linspace(-0.2, 0.2, convnet.FILTERS).astype(np.float32)
    texts = [b"", b"a", bytes(range(63)), bytes(range(64)), b"some text " * 19, b"xy" * 301]
    for text, p in zip(texts, convnet.score(net, texts), strict=True):
        padded = text + bytes(convnet.WIDTH)
        values = []
        for at in range(len(text) + 1):
            values.append(sum(net.table[j, padded[at + j]].astype(np.float64) for j in range(convnet.WIDTH)))
        cells = [np.max(values[i : i + convnet.CELL], axis=0) for i in range(0, len(values), convnet.CELL)]
        whole = max(1, -(-(len(text) + convnet.WIDTH) // convnet.CELL))
        starts = range(0, max(1, whole - 1), convnet.STEP)
        chunks = [np.maximum(np.max(cells[i : i + convnet.CELLS], axis=0) + net.bias, 0) for i in starts if i < len(cells)]
        pooled = np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0), np.min(chunks, axis=0)])
        assert abs(p - 1 / (1 + np.exp(-(pooled @ net.layer + net.offset[0])))) < 1e-5
