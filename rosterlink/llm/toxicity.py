"""Toxicity of texts whose words may be disguised: a noisy-channel decoder.

Disguise is taken as noise on a word: letters replaced by look-alikes ("1d10t"),
set apart ("i d i o t", "i/d/i/o/t", "id-iot") or repeated ("idiiiot", "idiiot"). A disguised word
is a lattice: at each character it could be itself or one of the letters it may stand for,
it could repeat the letter before it, or it could be a separator that means nothing. The best path
under a character language model and the costs of the channel (Viterbi) restores the word. A
token or stretch of single characters enters if some path of its lattice begins a word with a term;
what no path can spell is never found, so nothing is lost. Tokens of nothing but
letters are read as they stand unless the best path is likelier by a margin ("looser" is no
"loser"). Scores are given to restored text.

The language model counts runs of three characters in the words of all
documents, and the learned terms are added to it. Terms are beginnings of words that the labelled
sample shows to be much denser in toxic texts than in others. A term that no other
text of the sample holds speaks for itself; the others count by how dense they are: as toxic
terms of some languages also come about by chance, a long text may hold a few.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sample
from .pretokens import Table

ROWS_AT_ONCE = 1000

# Letters that a character may stand for (fixed values).
LOOKS_LIKE = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "(": "c",
    "€": "e",
    "£": "l",
    "¡": "i",
    "*": "aeiou",
}
# Letters of other scripts that look like Latin ones (fixed values).
OTHER_SCRIPTS = dict(
    zip("\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0456\u0455\u0458\u04bb\u0501", "aeopcyxisjhd", strict=True)
)
# Costs of the channel, as negative logarithms.
REPLACED, REPEATED, APART = 1.0, 0.5, 0.7
# A token of nothing but letters, without a run of three, is seldom a disguise: what it
# costs to take a mark inside it, or a doubled letter, for one.
MARKED, DOUBLED = 4.0, 11.5

# What it costs to end a word inside a disguised stretch, and to read a look-alike among letters
# as itself: a stretch is one word unless the split reading is likelier by as much.
INNER_END, KEPT = 3.0, 3.0

# A term is so much denser in toxic texts than in the others, and the chance that any beginning of
# a word, of all that were tried, is found in so many of them is at most so small.
LEAST_RATIO = 8.0
CHANCE = 0.001
SHORTEST, LONGEST = 3, 10

# Characters of the model's alphabet: 0 is the end of a word, 1 any other character.
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
_SIZE = len(_LETTERS) + 2
_NUMBER = {c: i + 2 for i, c in enumerate(_LETTERS)}

_AROUND = "#%&<>\"'()[]{}.,;:?-_~^`=/\\*"
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_SYMBOL = "".join(re.escape(c) for c in LOOKS_LIKE if not c.isalnum() and c != "*")
# Characters of words, and characters that may set them apart. "*" may be either.
_UNIT, _GAP = rf"(?:[^\W_]|[{_SYMBOL}])", rf"(?:_|[^\w{_SYMBOL}])"
_GAPS = re.compile(rf"{_GAP}+")
# Three or more single characters set apart, by whatever and however wide.
_APART = re.compile(rf"(?<![^\W_]){_UNIT}(?:{_GAP}++{_UNIT}){{2,}}(?![^\W_])")
_ORDINARY = re.compile(r"[^\W\d_]+(?: [^\W\d_]+)*")
# What is set around an ordinary word as a matter of course.
_SET_AROUND = re.compile(rf"(?:[{re.escape(_AROUND)}!]|(.)\1\1+)*")
_RUN = re.compile(r"(.)\1+")
_LONG_RUN = re.compile(r"(.)\1\1")


@dataclass
class Model:
    """Log probabilities of a character after two others; terms with the logarithm of
    their density ratio; those that no other text holds; density of terms in toxic texts;
    the last layer's offset and two weights; ``plain`` is as ``chars``, without the terms."""

    chars: np.ndarray
    plain: np.ndarray
    weights: dict[str, float]
    certain: frozenset[str]
    density: float
    layer: tuple[float, float, float]


def count_characters(docs: DataFrame) -> DataFrame:
    """``code``, ``n``: how often each run of three characters occurs in words.

    Every whole text counts. Counts are added up in each task, so at most one row per
    run of the alphabet and task is shuffled.
    """
    table = np.ones(0x110000, dtype=np.int64)
    for c, i in _NUMBER.items():
        table[ord(c)] = i
    for c in " \t\n\x0b\x0c\r.,;:!?\"()":
        table[ord(c)] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE**3, dtype=np.int64)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_AT_ONCE):
                texts = whole.slice(first, ROWS_AT_ONCE).column(0)
                joined = "  ".join(["", *(x.as_py() or "" for x in texts), ""]).lower()
                codes = table[np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")]
                # Several ends in a row are one; each word has two before it.
                runs = (codes[:-2] * _SIZE + codes[1:-1]) * _SIZE + codes[2:]
                runs = np.where(codes[1:-1] == 0, codes[2:], runs)
                total += np.bincount(runs, minlength=_SIZE**3)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found), pa.array(total[found])], ["code", "n"]
        )

    counts = docs.select("text").mapInArrow(run, "code long, n long")
    return counts.groupBy("code").agg(F.sum("n").alias("n"))


def language_model(counts: np.ndarray, terms: list[str]) -> np.ndarray:
    """Log probability of the third character of each run, after the first two.

    The learned terms get a tenth of all the weight, so that a term is preferred to an
    accidental likeness. Runs that are rare lean on shorter ones.
    """
    counts = counts.reshape(_SIZE, _SIZE, _SIZE).astype(np.float64)
    own = np.zeros_like(counts)
    for term in terms:
        codes = [0, 0, *(_NUMBER.get(c, 1) for c in term), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            own[0 if b == 0 else a, b, c] += 1
    if own.sum():
        counts += own * (0.1 * max(counts.sum(), 1.0) / own.sum())
    one = counts.sum(axis=(0, 1)) + 1
    one /= one.sum()
    two = counts.sum(axis=0) + 5 * one
    two /= two.sum(axis=1, keepdims=True)
    three = counts + 5 * two
    three /= three.sum(axis=2, keepdims=True)
    return np.log(three)


def _bare(code: int) -> str:
    decomposed = unicodedata.normalize("NFKD", chr(code)).lower()
    return "".join(c for c in decomposed if not unicodedata.combining(c))


# Latin letters with accents, combining accents, and wide forms.
_BARE = {c: _bare(c) for c in (*range(0xC0, 0x250), *range(0x300, 0x370), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F))}
_OTHER = str.maketrans(OTHER_SCRIPTS)
_LATIN = re.compile("[a-z]")


def folded(token: str) -> str:
    """Without accents and wide forms; look-alikes of other scripts among Latin letters as these."""
    if token.isascii():
        return token
    plain = token.translate(_BARE)
    if not plain.isascii() and _LATIN.search(plain):
        plain = plain.translate(_OTHER)
    return plain


def closed(token: str) -> str:
    """The token with each gap as one blank, or as a lone "*", which may be a letter."""
    return _GAPS.sub(lambda m: "*" if m[0].count("*") == 1 else " ", token)


def literal_cost(token: str, chars: np.ndarray) -> float:
    """Cost of letters read as they stand, gaps as ends of words."""
    cost, a, b = 0.0, 0, 0
    for c in token:
        code = 0 if c == " " else _NUMBER.get(c, 1)
        cost -= chars[a, b, code]
        a, b = (b, code) if code else (0, 0)
    return cost


def restore(
    token: str, chars: np.ndarray, whole: bool = True, inner_end: float = 0.0, kept: float = 0.0
) -> tuple[str, float]:
    """The best reading of a closed token and its cost, by Viterbi over its lattice.

    A state is the last two characters read; words inside the token end where the
    model prefers it by more than ``inner_end``, at a gap or symbol. Characters that have no other reading stay; look-alikes
    in a token with letters stay where the model prefers it by more than ``kept``.
    A part of a token (not ``whole``) need not end a word.
    """
    if not any(c.isalpha() for c in token):
        kept = 0.0
    # State: (code before last, last code) -> (cost, what was read, as a chain of links).
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    before = ""
    for at, c in enumerate(token):
        letters = LOOKS_LIKE.get(c, "")
        ends = not c.isalnum() and bool(at) and at + 1 < len(token)
        nexts: dict[tuple[int, int], tuple[float, tuple | None]] = {}

        def offer(state: tuple[int, int], cost: float, read: tuple | None, into: dict = nexts) -> None:
            known = into.get(state)
            if known is None or cost < known[0]:
                into[state] = cost, read

        for (a, b), (cost, read) in best.items():
            row = chars[a, b]
            if ends:
                offer((a, b), cost + APART, read)
                offer((0, 0), cost + inner_end - row[0], (read, " "))
            if not ends or letters:
                code = _NUMBER.get(c, 1)
                if not ends or c not in " *":
                    offer((b, code), cost + (kept if letters else 0.0) - row[code], (read, c))
                for letter in letters:
                    code = _NUMBER[letter]
                    offer((b, code), cost + REPLACED - row[code], (read, letter))
            if read is not None and b > 1 and (c in (before, read[1]) or read[1] in letters):
                offer((a, b), cost + REPEATED, read)
        best = nexts
        before = before if ends else c
    cost, read = min(
        ((cost - whole * chars[a, b][0], read) for (a, b), (cost, read) in best.items()),
        key=_cost,
    )
    found = []
    while read is not None:
        read, c = read
        found.append(c)
    return "".join(reversed(found)), float(cost)


def _cost(reading: tuple) -> float:
    return reading[0]


class Spelled:
    """Whether some path of a token's lattice begins a word with a term.

    Only such tokens are worth the search for the best path: no other reading of a
    token can hold a term.
    """

    def __init__(self, terms: Iterable[str]):
        # Nodes are beginnings of terms.
        self.follow: dict[str, dict[str, str]] = {"": {}}
        self.terms = frozenset(terms)
        for term in self.terms:
            for n, letter in enumerate(term):
                self.follow.setdefault(term[:n], {})[letter] = term[: n + 1]
                self.follow.setdefault(term[: n + 1], {})

    def __call__(self, token: str) -> bool:
        nodes, before, follow = {""}, "", self.follow
        for c in token:
            gap = not c.isalnum()
            if not nodes and not gap:
                before = c
                continue
            letters = c + LOOKS_LIKE.get(c, "")
            nexts = set(nodes) if gap else set()
            for node in nodes:
                after = follow[node]
                nexts.update(after[x] for x in letters if x in after)
                if node and (c == before or node[-1] in letters):
                    nexts.add(node)
            if not self.terms.isdisjoint(nexts):
                return True
            if gap:
                nexts.add("")
            else:
                before = c
            nodes = nexts
        return False

    def end(self, token: str, start: int) -> int:
        """Where the first term ends that an ordinary token can spell from ``start`` on, or 0."""
        nodes, before = {""}, ""
        for at in range(start, len(token)):
            c = token[at]
            if c != " ":
                nexts = {self.follow[node][c] for node in nodes if c in self.follow[node]}
                nodes = nexts | (nodes - {""} if c == before else set())
                if not self.terms.isdisjoint(nodes):
                    return at + 1
            if not nodes:
                return 0
            before = c
        return 0


class Reader:
    """Restores words and finds terms in whole texts; each distinct word is read once."""

    def __init__(self, model: Model):
        self.model = model
        self.spelled = Spelled(model.weights)
        # Terms that double a letter, without it.
        self.doubled = {_RUN.sub(r"\1", t): t for t in model.weights if _RUN.search(t)}
        self.words = Table(lambda token: self._terms_in(self._words(token)))

    def _core(self, token: str) -> str:
        """The token without what is set around a word, in lower case."""
        core = token.strip(_AROUND)
        core = core.rstrip(_AROUND + "!$|@+")
        lead = core.lstrip(_AROUND + "!$|@+")
        # One look-alike right before a letter may be the first letter.
        return core[len(core) - len(lead) - 1 :] if 0 < len(core) - len(lead) < 2 else lead

    def _read(self, whole: str) -> list[str] | None:
        """Words on the best path, if the lattice of a token or stretch can spell a term."""
        token = closed(whole).strip(" ")
        if not self.spelled(token):
            return None
        if self._is_ordinary(token) and not _APART.fullmatch(whole):
            return self._ordinary(token)
        read = restore(token, self.model.chars, inner_end=INNER_END, kept=KEPT)[0]
        return self._checked(read.split())

    def _is_ordinary(self, token: str) -> bool:
        return bool(_ORDINARY.fullmatch(token)) and not _LONG_RUN.search(token)

    def _ordinary(self, token: str) -> list[str]:
        """Words of a token of letters, read as they stand unless a disguise is far likelier."""
        start, model = 0, self.model
        for part in token.split(" "):
            end = self.spelled.end(token, start)
            if end > start + len(part) or end and token[start:end] not in model.weights:
                own = token[start:end]
                prior = MARKED if own.replace(" ", "") in model.weights else DOUBLED
                cost = restore(own, model.chars, whole=False)[1]
                if cost + prior < literal_cost(own, model.plain):
                    read = restore(token[start:], model.chars)[0].split()
                    return token[:start].split() + self._checked(read)
            start += len(part) + 1
        return token.split(" ")

    def _checked(self, words: list[str]) -> list[str]:
        """Restored words, with the letters that a term itself doubles."""
        made = []
        for word in words:
            if not self._terms_in([word]):
                short = _RUN.sub(r"\1", word)
                lengths = range(SHORTEST, min(len(short), LONGEST) + 1)
                term, n = next(
                    ((self.doubled[short[:n]], n) for n in lengths if short[:n] in self.doubled),
                    ("", 0),
                )
                word = term + short[n:] if term else word
            made.append(word)
        return made

    def _may_hold(self, token: str) -> bool:
        core = token.strip(_AROUND)
        return bool(self._terms_in([core])) if core.isalpha() else self.spelled(closed(token))

    def _words(self, token: str) -> list[str]:
        """Words that a token without white space is restored to."""
        core = self._core(token)
        tried = [core]
        around = token.replace(core, "", 1) if core else ""
        if not self._is_ordinary(closed(core)) or not _SET_AROUND.fullmatch(around):
            # What is set around the word may be letters of it.
            tried += [token.strip(_AROUND), token]
        for whole in dict.fromkeys(tried):
            words = self._read(whole)
            if words and self._terms_in(words):
                return words
        other = folded(token)
        if other != token and self._may_hold(other):
            words = self._words(other)
            if self._terms_in(words):
                return words
        return [core] if core else []

    def _spaced(self, spaced: str) -> list[str]:
        words = self._read(spaced) or [spaced]
        other = folded(spaced)
        if other != spaced and not self._terms_in(words):
            return self._read(other) or words
        return words

    def _terms_in(self, words: list[str]) -> tuple[str, ...]:
        known, lengths = self.model.weights, range(SHORTEST, LONGEST + 1)
        return tuple(w[:n] for w in words for n in lengths if len(w) >= n and w[:n] in known)

    def terms(self, text: str) -> tuple[Counter, int]:
        """How often a whole text holds each term, after restoring it; its words."""
        lower = text.lower()
        tokens = _SPACE.split(lower)
        self.words.tidy()
        found: Counter = Counter()
        if self.model.weights:
            for token, n in Counter(tokens).items():
                for term in self.words[token]:
                    found[term] += n
            for spaced in _APART.findall(lower):
                found.update(self._terms_in(self._spaced(spaced)))
        return found, len(tokens)

    def features(self, found: Counter, n_words: int) -> tuple[float, float]:
        """Whether a certain term is there; likelihood ratio of the others' density."""
        model = self.model
        certain = float(any(t in model.certain for t in found))
        others = sum(k * model.weights[t] for t, k in found.items() if t not in model.certain)
        return certain, min(12.0, max(-3.0, others - model.density * n_words))

    def score(self, found: Counter, n_words: int) -> float:
        certain, dense = self.features(found, n_words)
        offset, a, b = self.model.layer
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, offset + a * certain + b * dense))))

    def restored(self, text: str) -> list[tuple[str, str]]:
        """Disguised stretches of a text, in order, with what they are restored to."""
        lower = text.lower()
        found = [(m.start(), m[0], " ".join(self._spaced(m[0]))) for m in _APART.finditer(lower)]
        found = [(at, a, b) for at, a, b in found if a != b]
        for m in re.finditer(r"[^\x20\x09-\x0D]+", lower):
            words = " ".join(self._words(m[0]))
            if words and words != self._core(m[0]):
                found.append((m.start(), m[0], words))
        return [(a, b) for _, a, b in sorted(set(found))]


class _Once:
    """Words of texts that did not stand between the same two words before.

    So passages that texts share, near copies and a word said over and over tell what they tell once. Triples
    are kept as bits of a table, whatever their number: a word in few is taken for known by chance.
    """

    def __init__(self) -> None:
        self.bits = np.zeros(2**26, dtype=bool)

    def __call__(self, words: list[str]) -> list[str]:
        around = ["", *words, ""]
        triples = zip(around, words, around[2:], strict=False)
        places = np.array([zlib.crc32(" ".join(t).encode()) for t in triples], dtype=np.int64) % len(self.bits)
        _, first = np.unique(places, return_index=True)
        new = np.sort(first[~self.bits[places[first]]])
        self.bits[places] = True
        return [words[i] for i in new.tolist()]


def _surprise(n: int, others: int, share: float) -> float:
    """Least negative logarithm (Chernoff) of the chance that so many texts of all with a term are toxic ones."""
    own = n / (n + others)
    if own <= share:
        return 0.0
    rest = (1 - own) * math.log((1 - own) / (1 - share)) if others else 0.0
    return (n + others) * (own * math.log(own / share) + rest)


def learn_terms(rows: list[tuple[str, int]]) -> dict[str, tuple[float, bool]]:
    """Terms with the logarithm of their density ratio, and whether no other text has them.

    Of the beginnings of one word, the one that tells most is taken (toxic texts that
    hold it, times the logarithm), at a tie the longest. Equal texts count once, and
    a word between the same two words counts once for each label.
    """
    seen: dict[str, int] = {}
    for text, label in rows:
        seen[text] = max(label, seen.get(text, 0))
    new = _Once(), _Once()
    texts, times, size = (Counter(), Counter()), (Counter(), Counter()), [1, 1]
    for text, label in seen.items():
        words = Counter(new[label]([w.strip(".,;:!?#%&*$\"'()") for w in _SPACE.split(text.lower())]))
        own: Counter = Counter()
        for word, k in words.items():
            for n in range(SHORTEST, min(len(word), LONGEST) + 1):
                own[word[:n]] += k
        texts[label].update(own.keys())
        times[label].update(own)
        size[label] += sum(words.values())
    bound = math.log(max(1, len(texts[1])) / CHANCE)
    share = size[1] / (size[0] + size[1])
    told = []
    for term, n in texts[1].items():
        ratio = (times[1][term] + 0.5) / size[1] * size[0] / (times[0][term] + 0.5)
        if ratio >= LEAST_RATIO and _surprise(n, texts[0][term], share) >= bound:
            told.append((round(n * math.log(ratio), 9), len(term), term, math.log(ratio)))
    terms: dict[str, tuple[float, bool]] = {}
    for _, _, term, weight in sorted(told, reverse=True):
        if not any(term.startswith(t) or t.startswith(term) for t in terms):
            terms[term] = weight, not times[0][term]
    return dict(sorted(terms.items()))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of a few features, slightly held back, by Newton's method with halved steps."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).mean() + 1e-4 * (w[1:] ** 2).sum())

    w = np.zeros(x.shape[1])
    decay = np.array([1e-9] + [2e-4] * (x.shape[1] - 1))
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x.T * (p * (1 - p))) @ x / len(x) + np.diag(decay + 1e-9)
        step = np.linalg.solve(hessian, x.T @ (p - y) / len(x) + decay * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w -= size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w


def fit(rows: list[tuple[str, int]], counts: np.ndarray) -> Model:
    """Terms, the language model and the last layer; neither feature lowers a score."""
    terms = learn_terms(rows)
    weights = {t: w for t, (w, _) in terms.items()}
    certain = frozenset(t for t, (_, alone) in terms.items() if alone)
    chars, plain = language_model(counts, list(terms)), language_model(counts, [])
    model = Model(chars, plain, weights, certain, 0.0, (0.0, 0.0, 0.0))
    reader = Reader(model)
    read = [reader.terms(text) for text, _ in rows]
    toxic = [r for r, (_, label) in zip(read, rows, strict=True) if label]
    held = [sum(k for t, k in found.items() if t not in certain) for found, _ in toxic]
    words = sum(n for (_, n), k in zip(toxic, held, strict=True) if k)
    model.density = sum(held) / words if words else 0.0
    x = np.array([(1.0, *reader.features(*r)) for r in read]).reshape(-1, 3)
    w = _logistic(x, np.array([label for _, label in rows], dtype=np.float64))
    offset = float(w[0]) if rows else -2.0
    model.layer = offset, max(0.0, float(w[1])), max(0.0, float(w[2]))
    return model


def learned(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Fit on the bounded sample; characters are counted over all documents.

    What reaches the driver is the sample and one count per run of three characters
    of the alphabet (at most 216,000), whatever the number of documents.
    """
    counts = np.zeros(_SIZE**3, dtype=np.int64)
    for row in count_characters(docs).collect():
        counts[row["code"]] = row["n"]
    return fit(sample(docs, labels, label), counts)


def reads(model: Model, docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as it is, in ``row``, with ``score`` and ``terms``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_AT_ONCE):
                rows = whole.slice(first, ROWS_AT_ONCE).column(0)
                read = [reader.terms(x.as_py() or "") for x in rows.field("text")]
                scores = pa.array([reader.score(*r) for r in read], pa.float64())
                terms = pa.array([sorted(found) for found, _ in read], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([rows, scores, terms], ["row", "score", "terms"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    types = f"row {rows.schema['row'].dataType.simpleString()}, score double, terms array<string>"
    return rows.mapInArrow(run, types)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: float = 0.5
) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score``, ``predicted``, ``terms``.

    ``terms`` are the toxic words found after restoring, in order of the alphabet. Every whole
    text is read where it lies. Null and empty texts have no terms and the
    lowest score. Rows that repeat or have a null id are scored like any other (a null
    id is never held out); extra columns are ignored; without usable labels there are no terms and all
    scores are equal.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return reads(learned(docs, labels, label), narrow).select(
        "row.doc_id",
        held_out("row.doc_id").alias("held_out"),
        "score",
        (F.col("score") >= limit).cast("int").alias("predicted"),
        "terms",
    )
