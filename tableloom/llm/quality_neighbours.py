"""Quality by voting of the nearest labelled neighbours in a latent-semantic space.

Terms of a text are its words and, in a second block, the shapes that its words have and
how they follow each other. Both blocks are weighed by rarity and brought to length 1.
A randomised singular value decomposition of a bounded sample of labelled rows gives the
latent space. The labelled vectors are sent to every task, whose size the sample bounds;
each block of documents is multiplied with all of them, exactly, and the nearest ones
vote with their similarity.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.llm.toxicity import sample

ROWS_PER_CLASS = 2000  # labelled rows that the space is fitted on and that vote, per class
WORDS, SHAPES = 1 << 14, 1 << 10  # hashed terms of either block
AXES = 48
NEIGHBOURS = 25
BLOCK = 256  # documents multiplied at once

_RUNS = (
    (re.compile(rb"[a-z\x80-\xff]+"), b"a"),
    (re.compile(rb"[A-Z]+"), b"A"),
    (re.compile(rb"[0-9]+"), b"0"),
)


def _shape(word: bytes) -> bytes:
    """A word with runs of letters and digits written as one character each."""
    for run, mark in _RUNS:
        word = run.sub(mark, word)
    return word[:8]


class _Terms(dict):
    """Places of the terms that a word gives, remembered for the words of one task."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= 200_000:
            self.clear()
        places = self[word] = (
            crc32(word.lower()) % WORDS,
            WORDS + crc32(_shape(word), 1) % SHAPES,
        )
        return places


def term_counts(text: str | None, known: _Terms | None = None) -> dict[int, int]:
    """Counts by place: hashed words, then hashed shapes, echoes and length."""
    known = _Terms() if known is None else known
    words = (text or "").encode().split()
    counts: Counter[int] = Counter()
    for word, n in Counter(words).items():
        a, b = known[word]
        counts[a] += n
        counts[b] += n
    echoes = sum(a == b for a, b in zip(words, words[1:]))
    if echoes:
        counts[WORDS + crc32(b"echo", 2) % SHAPES] += echoes
    # A term for every doubling of the length that the text stays below.
    for size in (8, 16, 32, 64):
        if len(words) < size:
            counts[WORDS + crc32(b"below %d" % size, 3) % SHAPES] += 1 + len(words) // 4
    return counts


@dataclass
class Space:
    """A latent space with the labelled vectors in it."""

    rarity: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    balance: float  # weight of a vote for low quality, as high ones over low ones

    def rows(self, counted: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _weighed(counted, self.rarity)

    def place(self, counted: list[dict[int, int]]) -> np.ndarray:
        places, values, bounds = self.rows(counted)
        return _unit(_times(places, values, bounds, self.axes))

    def scores(self, counted: list[dict[int, int]]) -> np.ndarray:
        """Share of the neighbours' votes for high quality; 0.5 where nothing is similar."""
        out = np.empty(len(counted))
        for start in range(0, len(counted), BLOCK):
            near = self.place(counted[start : start + BLOCK]) @ self.vectors.T
            most = min(NEIGHBOURS, near.shape[1])
            chosen = np.argpartition(-near, most - 1, axis=1)[:, :most]
            votes = np.maximum(np.take_along_axis(near, chosen, 1), 0) ** 4
            low = self.low[chosen]
            against = (votes * low).sum(axis=1) * self.balance
            whole = (votes * ~low).sum(axis=1) + against
            part = out[start : start + BLOCK]
            part.fill(0.5)
            np.divide(whole - against, whole, where=whole > 0, out=part)
        return out


def _weighed(counted: list[dict[int, int]], rarity: np.ndarray):
    """(places, values, bounds) of the rows, each of the two blocks at length 1."""
    sizes = [len(c) for c in counted]
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    places = np.fromiter((p for c in counted for p in c), np.int64, int(bounds[-1]))
    values = np.fromiter((n for c in counted for n in c.values()), np.float32, int(bounds[-1]))
    shapes = places >= WORDS
    values = np.where(shapes, values, 1 + np.log(np.maximum(values, 1))) * rarity[places]
    row = np.repeat(np.arange(len(counted)), sizes)
    for block in (shapes, ~shapes):
        norm = np.sqrt(np.bincount(row[block], values[block] ** 2, len(counted)))
        values[block] /= np.maximum(norm, 1e-12)[row[block]]
    return places, values.astype(np.float32), bounds


def _times(places, values, bounds, matrix: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense matrix, a few rows at a time."""
    out = np.zeros((len(bounds) - 1, matrix.shape[1]), np.float32)
    for i in range(len(out)):
        a, b = bounds[i], bounds[i + 1]
        if b > a:
            out[i] = values[a:b] @ matrix[places[a:b]]
    return out


def _times_back(places, values, bounds, matrix: np.ndarray, width: int) -> np.ndarray:
    """The sparse rows, transposed, times a dense matrix."""
    out = np.zeros((width, matrix.shape[1]), np.float32)
    for i in range(len(matrix)):
        a, b = bounds[i], bounds[i + 1]
        out[places[a:b]] += values[a:b, None] * matrix[i]  # a row has each place once
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _learned(found: DataFrame) -> tuple[list[dict[int, int]], np.ndarray]:
    """The term counts of the sample, made by its tasks, and which rows are low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [sorted(term_counts(text.as_py()).items()) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([[p for p, _ in c] for c in counted], pa.list_(pa.int32())),
                    pa.array([[n for _, n in c] for c in counted], pa.list_(pa.int32())),
                    batch.column(1),
                ],
                names=["places", "counts", "label"],
            )

    rows = (
        found.select("text", F.col("label").cast("int").alias("label"))
        .mapInArrow(run, "places array<int>, counts array<int>, label int")
        .orderBy("places", "counts", "label")  # the same order each time
        .toPandas()
    )
    counted = [dict(zip(map(int, p), map(int, n))) for p, n in zip(rows["places"], rows["counts"])]
    return counted, (rows["label"] == 0).to_numpy(bool)


def fit(counted: list[dict[int, int]], low: np.ndarray, *, axes: int = AXES) -> Space | None:
    """The space of the labelled rows: rarities, axes and vectors; None without rows."""
    if not counted:
        return None
    width = WORDS + SHAPES
    texts = np.zeros(width)
    for counts in counted:
        texts[list(counts)] += 1
    rarity = np.log((1 + len(counted)) / (1 + texts)) + 1
    places, values, bounds = _weighed(counted, rarity)
    spread = np.random.default_rng(11).standard_normal((width, axes + 8)).astype(np.float32)
    basis = _times(places, values, bounds, spread)
    for _ in range(2):
        basis, _ = np.linalg.qr(basis)
        back = _times_back(places, values, bounds, basis, width)
        basis = _times(places, values, bounds, np.linalg.qr(back)[0])
    basis, _ = np.linalg.qr(basis)
    back = _times_back(places, values, bounds, basis, width)
    directions, _, _ = np.linalg.svd(back, full_matrices=False)
    space = Space(
        rarity,
        np.ascontiguousarray(directions[:, :axes]),
        np.zeros((0, 0), np.float32),
        low,
        max(1.0, (~low).sum() / max(1, low.sum())),
    )
    space.vectors = space.place(counted)
    return space


def score_texts(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    rows_per_class: int = ROWS_PER_CLASS,
) -> DataFrame:
    """(id, score) per row of ``docs``; the score is from 0 to 1, higher is better.

    Learns from at most ``rows_per_class`` labelled rows of each class, of ids whose crc32
    is no multiple of 5. Whole texts are read and nothing else of a row. NULL and blank
    texts are as near to each other as any equal texts. Without labels all scores are 0.5;
    with labels of one class they are 0 or 1. Repeated rows score alike; an empty table
    gives an empty one.
    """
    found, _ = sample(
        docs,
        labels,
        id_col=id_col,
        text_col=text_col,
        label_col=label_col,
        rows_per_class=rows_per_class,
    )
    space = fit(*_learned(found))
    sent = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, space = _Terms(), sent.value
        for batch in batches:
            scores = []
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.column(1).slice(start, BLOCK).to_pylist()
                if space is None:
                    scores += [0.5] * len(part)
                else:
                    scores += space.scores([term_counts(t, known) for t in part]).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"]
            )

    pairs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return pairs.mapInArrow(run, "id long, score double")
