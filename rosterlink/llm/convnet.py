"""Quality classifier: a small convolutional network over bytes, in numpy.

Each filter spans ``WIDTH`` bytes and has a weight for every byte at every place, so a
filter's value at a position is a sum of ``WIDTH`` table entries. The text is covered by
overlapping chunks from its first byte to its last; in each chunk every filter
keeps its largest value (max-pooling). A document's chunks are combined by their largest, mean and
least value for each filter, and a logistic layer makes one probability of
these. The least value shows a chunk that is short of ordinary variety; the
largest shows one that holds something odd.

Filters and layer are learned together by gradient descent from a bounded sample of
labelled documents (``labelled.py``); the gradient of a maximum goes to the position
that made it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sample

WIDTH = 5
FILTERS = 16
# A chunk is four cells long and starts three cells after the one before.
CELL, CELLS, STEP = 64, 4, 3
BYTES_AT_ONCE = 2**17
ROWS_AT_ONCE = 1000

EPOCHS = 6
DOCS_PER_STEP = 32
RATE = 0.02
SEED = 5


@dataclass
class Network:
    """``table[j, byte, filter]``, a bias per filter, and the last layer."""

    table: np.ndarray
    bias: np.ndarray
    layer: np.ndarray
    offset: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.layer, self.offset]


def fresh(seed: int = SEED) -> Network:
    random = np.random.default_rng(seed)
    return Network(
        random.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        random.normal(0, 0.05, 3 * FILTERS).astype(np.float32),
        np.ones(1, np.float32),
    )


def _positions(net: Network, data: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Values of all filters at each position but the last ``WIDTH`` of padded ``data``.

    A position from which a filter would reach into the next text has none.
    """
    n = len(data) - WIDTH
    found = net.table[0][data[:n]]
    for place in range(1, WIDTH):
        found += net.table[place][data[place : place + n]]
    found[between[:n]] = -np.inf
    return found


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cells and chunks of documents that lie one after the other.

    Returns the start of each cell, the cells of each chunk (the last cell again where a
    chunk is short) and the first chunk of each document.
    """
    cells = np.maximum(1, -(-lengths // CELL))
    first_cell = np.cumsum(cells) - cells
    inside = np.arange(cells.sum()) - np.repeat(first_cell, cells)
    starts = np.repeat(np.cumsum(lengths) - lengths, cells) + inside * CELL
    chunks = np.maximum(1, -(-(cells - 1) // STEP))
    first_chunk = np.cumsum(chunks) - chunks
    begin = (np.arange(chunks.sum()) - np.repeat(first_chunk, chunks)) * STEP
    last = np.repeat(cells - 1, chunks)
    reach = np.minimum(begin[:, None] + np.arange(CELLS), last[:, None])
    return starts, reach + np.repeat(first_cell, chunks)[:, None], first_chunk


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end, each followed by as many zero bytes as a filter reaches over.

    Also the length of each with these, and the positions from which a filter would
    reach from one text into the next.
    """
    gap = bytes(WIDTH)
    data = np.frombuffer(b"".join(t + gap for t in texts) + gap, dtype=np.uint8)
    lengths = np.array([len(t) + WIDTH for t in texts])
    between = np.zeros(len(data), dtype=bool)
    for back in range(1, WIDTH):
        between[np.cumsum(lengths) - back] = True
    return data, lengths, between


def _cell_maxima(
    net: Network, data: np.ndarray, between: np.ndarray, starts: np.ndarray
) -> np.ndarray:
    """Largest value of each filter in each cell, a stretch of cells at a time."""
    end = len(data) - WIDTH
    made = []
    per_stretch = BYTES_AT_ONCE // CELL
    for at in range(0, len(starts), per_stretch):
        own = starts[at : at + per_stretch]
        stop = int(starts[at + per_stretch]) if at + per_stretch < len(starts) else end
        stretch = slice(int(own[0]), stop + WIDTH)
        values = _positions(net, data[stretch], between[stretch])
        made.append(np.maximum.reduceat(values, own - own[0], axis=0))
    return np.concatenate(made)


def _pooled(chunks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest, mean and least value over each document's chunks."""
    count = np.diff(np.concatenate((first, [len(chunks)])))[:, None]
    return np.concatenate(
        [
            np.maximum.reduceat(chunks, first, axis=0),
            np.add.reduceat(chunks, first, axis=0) / count,
            np.minimum.reduceat(chunks, first, axis=0),
        ],
        axis=1,
    )


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probability of each whole text."""
    data, lengths, between = _padded(texts)
    starts, reach, first = _layout(lengths)
    cells = _cell_maxima(net, data, between, starts)
    chunks = np.maximum(cells[reach].max(axis=1) + net.bias, 0)
    z = _pooled(chunks, first) @ net.layer + net.offset
    return _probability(z.astype(np.float64))


def _gradients(net: Network, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    data, lengths, between = _padded(texts)
    starts, reach, first = _layout(lengths)
    values = _positions(net, data, between)
    cells = np.maximum.reduceat(values, starts, axis=0)
    best_cell = cells[reach].argmax(axis=1)
    chunk_rows = np.arange(len(reach))[:, None]
    cell = reach[chunk_rows, best_cell]
    raw = cells[cell, np.arange(FILTERS)] + net.bias
    chunks = np.maximum(raw, 0)
    pooled = _pooled(chunks, first)
    wrong = (_probability(pooled @ net.layer + net.offset) - labels) / len(texts)

    back = (wrong[:, None] * net.layer).astype(np.float32)
    high, mean, low = back[:, :FILTERS], back[:, FILTERS : 2 * FILTERS], back[:, 2 * FILTERS :]
    count = np.diff(np.concatenate((first, [len(chunks)])))
    spread = np.repeat(mean / count[:, None], count, axis=0)
    for d, (a, n) in enumerate(zip(first, count, strict=True)):
        own, f = chunks[a : a + n], np.arange(FILTERS)
        spread[a + own.argmax(axis=0), f] += high[d]
        spread[a + own.argmin(axis=0), f] += low[d]
    spread *= raw > 0

    # Each chunk's value came from one position of one cell.
    ends = np.concatenate((starts[1:], [len(values)]))
    chunk, filt = np.nonzero(spread)
    table = np.zeros_like(net.table)
    used = cell[chunk, filt]
    best, inverse = np.unique(used * FILTERS + filt, return_inverse=True)
    at = np.array(
        [starts[u] + values[starts[u] : ends[u], f].argmax() for u, f in zip(*divmod(best, FILTERS), strict=True)],
        dtype=np.int64,
    )
    amount = np.zeros(len(best), np.float32)
    np.add.at(amount, inverse, spread[chunk, filt])
    for place in range(WIDTH):
        np.add.at(table, (place, data[at + place], best % FILTERS), amount)
    return [table, spread.sum(axis=0), (wrong @ pooled).astype(np.float32), wrong.sum(keepdims=True)]


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Learn from texts with labels, by Adam; without rows the network stays as it began."""
    net, random = fresh(seed), np.random.default_rng(seed)
    texts = [t.encode() for t, _ in rows]
    labels = np.array([y for _, y in rows], dtype=np.float32)
    means = [np.zeros_like(p) for p in net.parameters()]
    squares = [np.zeros_like(p) for p in net.parameters()]
    step, total = 0, max(1, epochs * -(-len(rows) // DOCS_PER_STEP))
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for a in range(0, len(rows), DOCS_PER_STEP):
            own = order[a : a + DOCS_PER_STEP]
            gradients = _gradients(net, [texts[i] for i in own], labels[own])
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for p, g, m, s in zip(net.parameters(), gradients, means, squares, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return net


def quality_scores(
    docs: DataFrame, labels: DataFrame, label: str = "quality", limit: float = 0.3
) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score``, ``predicted``.

    The network is fitted on the driver from the bounded sample and sent to the tasks
    (80 KB); every whole text is scored where it lies, nothing is shuffled. Null and
    empty texts get the score of an empty text. Rows that repeat or have a null id are
    scored like any other (a null id is never held out); extra columns are ignored; without usable labels the
    scores say nothing, but are given.
    """
    net = fit(sample(docs, labels, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(first, ROWS_AT_ONCE)
                scores = score(net, [(x.as_py() or "").encode() for x in batch.column(1)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(scores)], ["doc_id", "score"]
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    scored = narrow.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= limit).cast("int").alias("predicted"),
    )
