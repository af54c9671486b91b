"""Toxicity by weak supervision.

Lexicon voters look for words, pattern voters for word beginnings and for ways of writing.
Their words and beginnings are those that mark toxic rows in a bounded sample of labelled
ones; each belongs to one voter. All documents are voted on, and equal votes counted. A
generative model of these counts, fitted by expectation maximisation without any label,
estimates each voter's rates for either class; voters that err together, which the model
sees as correlation within a class, are counted less. Labels only tell which of its two
classes is the toxic one, if any is. Its posterior labels train a linear classifier, which scores
every text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.llm.common import fold_of, written

ROWS_PER_CLASS = 4000  # labelled rows that the model is fitted on, of each class
STEMS = (5, 6, 7)  # letters of a word beginning
DENSE = 250
LEXICON = 512  # most terms that are dealt out to voters
VOTERS = 8  # of words, and as many of beginnings; 2 ** (2 * VOTERS + 2) votes at most differ
CLEAR = 2.5  # least log odds of a voter's terms, less their standard error
LEAN = 8  # a text with two voters and over one in LEAN of them starts as toxic
LEAST_TEXTS = 3  # texts of the class in which a term of a voter occurs

_EDGES = b".,;:!?()[]{}\"'*#$%&|<>"


def terms(text: str | None) -> tuple[set[str], list[float]]:
    """Words and word beginnings of a text, and what its way of writing measures.

    Words are lower-cased, without marks at their ends. A beginning of n letters is
    written ``n~letters``, with ``*2`` or ``*3`` if that many different words share it, and
    with ``%`` if at least two do and they are one in ``DENSE`` words or more. Measured
    are the shares of words in capitals and of ``!``.
    """
    raw = (text or "").encode().split()
    words = {w.strip(_EDGES).decode("utf-8", "replace").lower() for w in set(raw)}
    words.discard("")
    size = max(1, len(raw))
    found = set(words)
    for n in STEMS:
        stems = [w[:n] for w in words if len(w) >= n]
        for stem, times in Counter(stems).items():
            term = f"{n}~{stem}"
            found.add(term)
            if times > 1:
                found.add(term + "*2")
                if times > 2:
                    found.add(term + "*3")
                if times * DENSE >= size:
                    found.add(term + "%")
    shouted = sum(w.isupper() and len(w) > 1 for w in raw)
    return found, [shouted / size, (text or "").count("!") / size]


@dataclass(frozen=True)
class Model:
    """Scores a text by the terms in it; ``words`` and their numbers are those of ``weights``."""

    words: dict[str, int]
    weights: np.ndarray
    groups: list[list[int]]
    voter_weights: np.ndarray
    bias: float
    shout: float  # share of capitals, and of !, from which that voter votes

    def read(self, text: str | None) -> tuple[list[int], int]:
        """The numbers of the known terms of a text, and the voters' votes as bits."""
        found, ways = terms(text)
        places = sorted(self.words[t] for t in found if t in self.words)
        has = set(places)
        votes = [not has.isdisjoint(group) for group in self.groups]
        votes += [way > self.shout for way in ways]
        return places, sum(1 << j for j, vote in enumerate(votes) if vote)

    def weigh(self, places: list[int], votes: int) -> float:
        total = self.bias + float(self.weights[places].sum()) if len(places) else self.bias
        total += sum(float(w) for j, w in enumerate(self.voter_weights) if votes >> j & 1)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))

    def score(self, text: str | None) -> float:
        return self.weigh(*self.read(text))


def deal(words: list[str]) -> list[list[int]]:
    """Which numbers of ``words``, the clearest first, each voter looks for: words, then beginnings."""
    starts = tuple(f"{n}~" for n in STEMS)
    kinds = ([], [])
    for i, word in enumerate(words):
        kinds[word.startswith(starts)].append(i)
    return [kind[j::VOTERS] for kind in kinds for j in range(min(VOTERS, len(kind)))]


def bits(patterns: np.ndarray, voters: int) -> np.ndarray:
    """A row per pattern and a column per voter, 1 where it votes."""
    return (patterns[:, None] >> np.arange(voters) & 1).astype(float)


def label_model(
    votes: np.ndarray, times: np.ndarray, rounds: int = 100
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, rates, trust) of a generative model of binary votes.

    ``votes`` has a row per different set of votes and a column per voter; ``times`` is how
    many texts have them. Texts that two voters and more than one in ``LEAN``
    of them vote for start as likely of class 1.
    ``rates[c, j]`` is how often voter j votes in class c. ``trust`` is 1 for a voter that
    errs alone and less the more its votes go with others' within the classes: each pair's
    correlation, beyond what chance gives, is taken from both.
    """
    voters = votes.shape[1]
    start = 4 * (votes.sum(axis=1) - max(1.5, voters / LEAN))
    posterior = 1 / (1 + np.exp(-np.clip(start, -30, 30)))
    trust = np.ones(voters)
    rates = np.full((2, voters), 0.5)
    chance = 3 / math.sqrt(max(1, times.sum()))
    for _ in range(rounds):
        share = np.stack([1 - posterior, posterior]) * times
        size = share.sum(axis=1, keepdims=True)
        rates = (share @ votes + 0.5) / (size + 1)
        balance = (size[:, 0] + 1) / (size.sum() + 2)
        within = np.zeros((voters, voters))
        for c in range(2):
            centred = votes - rates[c]
            spread = np.sqrt(rates[c] * (1 - rates[c]))
            joint = (centred * share[c][:, None]).T @ centred / max(1.0, size[c, 0])
            within = np.maximum(within, joint / np.outer(spread, spread))
        np.fill_diagonal(within, 0)
        trust = 1 / (1 + np.maximum(0, within - chance).sum(axis=1))
        odds = np.log(balance[1] / balance[0])
        odds = odds + votes @ (trust * np.log(rates[1] / rates[0]))
        odds = odds + (1 - votes) @ (trust * np.log((1 - rates[1]) / (1 - rates[0])))
        after = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        moved = np.abs(after - posterior).max(initial=0)
        posterior = after
        if moved < 1e-6:
            break
    return posterior, rates, trust


def linear(
    inputs: np.ndarray, soft: np.ndarray, ridge: float = 0.05, steps: int = 400
) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by accelerated gradient steps."""
    weights, bias = np.zeros(inputs.shape[1]), 0.0
    ahead, ahead_bias, momentum = weights.copy(), 0.0, 1.0
    size = max(1, len(inputs))
    rate = 1 / (0.25 * (np.square(inputs).sum(axis=1).mean() if len(inputs) else 1) + 0.25 + ridge)
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(inputs @ ahead + ahead_bias, -30, 30))) - soft
        after = ahead - rate * (inputs.T @ error / size + ridge * ahead / size)
        after_bias = ahead_bias - rate * error.sum() / size
        nxt = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        push = (momentum - 1) / nxt
        ahead = after + push * (after - weights)
        ahead_bias = after_bias + push * (after_bias - bias)
        weights, bias, momentum = after, after_bias, nxt
    return weights, float(bias)


def lexicon(found: DataFrame, yes: int, no: int, most: int = LEXICON) -> list[str]:
    """Terms that mark the toxic ones of ``found`` (text, label), the clearest first.

    Measured by the smoothed log odds less their standard error; terms of fewer than
    ``LEAST_TEXTS`` toxic texts, or below ``CLEAR``, are no voters' words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                words = list(terms(text.as_py())[0])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(words, pa.string()),
                        pa.array([label.as_py()] * len(words), pa.int32()),
                    ],
                    names=["term", "label"],
                )

    a, b = F.col("hits") + 0.5, F.col("misses") + 0.5
    odds = F.log(a / (yes + 1 - a)) - F.log(b / (no + 1 - b))
    ranked = (
        found.select("text", F.col("label").cast("int").alias("label"))
        .mapInArrow(run, "term string, label int")
        .groupBy("term")
        .agg(F.sum("label").alias("hits"), F.sum(1 - F.col("label")).alias("misses"))
        .where(F.col("hits") >= LEAST_TEXTS)
        .select("term", F.round(odds - F.sqrt(1 / a + 1 / b), 9).alias("clear"))
        .where(F.col("clear") >= CLEAR)
        .orderBy(F.desc("clear"), "term")
        .limit(most)
    )
    return [r["term"] for r in ranked.collect()]


def unweighted(words: list[str], shout: float = 0.5) -> Model:
    """The voters of ``words`` before anything is known about them."""
    groups = deal(words)
    at = {word: i for i, word in enumerate(words)}
    return Model(at, np.zeros(len(words)), groups, np.zeros(len(groups) + 2), 0.0, shout)


def read_texts(found: DataFrame, model: Model, keep: str) -> DataFrame:
    """(``keep``, places, votes) of each row of ``found``, as ``Model.read`` gives them."""
    sent = found.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One text's terms at a time are held.
            rows = [sent.value.read(text.as_py()) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    pa.array([places for places, _ in rows], pa.list_(pa.int32())),
                    pa.array([votes for _, votes in rows], pa.int64()),
                ],
                names=[keep, "places", "votes"],
            )

    return found.select("text", F.col(keep).cast("long").alias(keep)).mapInArrow(
        run, f"{keep} long, places array<int>, votes long"
    )


def train(sampled: pd.DataFrame, counted: pd.DataFrame, model: Model, share: float) -> Model:
    """``model`` with weights.

    ``counted`` (votes, n) are the votes of all documents; ``sampled`` (label, places, votes)
    are labelled rows, ``share`` is how common toxic ones are among all labels. The
    classifier learns the posteriors of the sampled rows, not their labels. Without a clear
    term, or if the classes found are not those of the labels, all texts score ``share``.
    """
    toxic = (sampled["label"] == 1).to_numpy(bool)
    if toxic.all() or not toxic.any():
        bias = 6.0 if len(toxic) and toxic.all() else -6.0
        return replace(model, bias=bias)
    usual = replace(model, bias=math.log(share / (1 - share)))
    if not model.words:
        return usual
    voters = len(model.voter_weights)
    patterns = counted["votes"].to_numpy(np.int64)
    posterior, _, _ = label_model(bits(patterns, voters), counted["n"].to_numpy(float))
    # Labelled rows are documents, so their votes are among those counted.
    soft = posterior[np.searchsorted(patterns, sampled["votes"].to_numpy(np.int64))]
    if soft[toxic].mean() <= soft[~toxic].mean():
        return usual  # the votes tell other classes apart
    inputs = np.zeros((len(sampled), len(model.words)))
    for i, places in enumerate(sampled["places"]):
        inputs[i, places] = 1
    votes = bits(sampled["votes"].to_numpy(np.int64), voters)
    weights, bias = linear(np.hstack([inputs, votes]), soft)
    # The sample may hold more of one class than the labels do.
    bias += math.log(share / (1 - share)) - math.log(toxic.mean() / (1 - toxic.mean()))
    own = len(model.words)
    return replace(model, weights=weights[:own], voter_weights=weights[own:], bias=bias)


def sample(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str,
    text_col: str,
    label_col: str,
    rows_per_class: int,
    folds: int = 5,
) -> tuple[DataFrame, float]:
    """(id, text, label) of at most ``rows_per_class`` labelled documents of each class, as a
    written table, and the share of label 1 among all labels that may be learned from.

    Only ids whose crc32 modulo ``folds`` is not 0, chosen by a hash of the id. NULL ids
    and labels are left out, and a document labelled twice has the higher label. The
    chosen ids are bounded by the parameter, so they go to every executor; documents are
    not shuffled.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
        .where(fold_of(F.col("doc_id"), folds) != 0)
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max(label_col).alias("label"))
    )
    known = written(known, "known-labels")
    total = known.agg(F.count("*"), F.count_if(F.col("label") == 1)).first()
    order = [F.xxhash64("id"), F.col("id")]
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(*order).limit(rows_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(chosen), "id").select("id", "text", "label")
    # Ids that occur more than once could make it longer than the ids chosen.
    found = found.orderBy(*order, "text").limit(2 * rows_per_class)
    return written(found, "labelled-sample"), total[1] / total[0] if total[0] else 0.5


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows_per_class: int = ROWS_PER_CLASS,
) -> tuple[Model, DataFrame]:
    """A model, and (id, places, votes) of each row of ``docs`` as it reads them.

    Terms and classifier come from at most ``rows_per_class`` labelled rows of each class,
    the label model from the votes of all documents. The driver gets the sample and the
    counts of different votes, of which there are at most 2 to the number of voters.
    """
    found, share = sample(
        docs,
        labels,
        id_col=id_col,
        text_col=text_col,
        label_col=label_col,
        rows_per_class=rows_per_class,
    )
    size = found.agg(F.count("*"), F.count_if(F.col("label") == 1)).first()
    model = unweighted(lexicon(found, size[1], size[0] - size[1]))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    read = written(read_texts(texts, model, "id"), "votes")
    counted = read.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes")
    # The same order, and so the same sums, each time.
    sampled = read_texts(found, model, "label").orderBy("places", "votes", "label")
    return train(sampled.toPandas(), counted.toPandas(), model, share), read


def score(model: Model, text: Column) -> Column:
    """The model's score of a text, from 0 to 1."""

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return texts.map(model.score)

    return scores(text)


def score_texts(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows_per_class: int = ROWS_PER_CLASS,
) -> DataFrame:
    """(id, score) per row of ``docs``; the score is from 0 to 1, higher is more toxic.

    Learns from at most ``rows_per_class`` labelled rows per class, of ids whose crc32 is
    no multiple of 5; whole texts are read, in learning and scoring, and nothing else of a
    row. NULL and blank texts score by the bias alone. Without labels of both classes all
    scores are near 0 (or near 1 if all are toxic). Repeated rows score alike; an empty
    table gives an empty one. A term counts once however long the text is.
    """
    model, read = fit(
        docs,
        labels,
        id_col=id_col,
        text_col=text_col,
        label_col=label_col,
        rows_per_class=rows_per_class,
    )

    @F.pandas_udf("double")
    def weighed(places: pd.Series, votes: pd.Series) -> pd.Series:
        return pd.Series([model.weigh(p, v) for p, v in zip(places, votes.tolist())], dtype=float)

    return read.select("id", weighed("places", "votes").alias("score"))


def without_toxic(
    docs: DataFrame, labels: DataFrame, *, text_col: str = "text", reject: float = 0.5, **names
) -> DataFrame:
    """``docs`` without the rows that score ``reject`` or more; all columns stay.

    ``names`` are the other parameters of ``fit``.
    """
    model, _ = fit(docs, labels, text_col=text_col, **names)
    return docs.where(score(model, F.col(text_col)) < reject)
