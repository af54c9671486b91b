"""Quality rules: text statistics and a decision list learned from labels.

The list is learned by sequential covering. A rule is a conjunction of thresholds on
statistics; it is grown condition by condition for the best information gain on two
thirds of the rows, pruned from its end on the last third, and kept if it is precise
there. Rows that it covers are set aside, and the next rule is grown on the rest. The
result is an ordered list, written as one Spark conditional expression.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_distinct_words",
    "n_echoes",
    "n_upper",
    "n_digits",
    "n_marks",
)
RATIOS = {  # of equal conditions the first is taken
    "symbol_share": ("n_symbols", "word_chars"),
    "echo_share": ("n_echoes", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "mark_share": ("n_marks", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "mean_word": ("word_chars", "n_words"),
    "dup_lines": ("n_dup_lines", None),
    "words": ("n_words", None),
    "distinct_share": ("n_distinct_words", "n_words"),
}
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"

_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"


def statistics(text: str | None) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one text; all 0 for NULL.

    Words are runs of anything but the six ASCII blanks. ``n_dup_lines`` counts lines
    with a word that equal an earlier line, ``n_repeat_words`` the words that lie in a
    three-word window found at least twice, ``n_echoes`` the words equal to the word
    before, ``n_marks`` the characters ``!`` and ``?``.
    """
    octets = (text or "").encode()
    words = octets.split()
    chars = len(text or "") - sum(octets.count(b) for b in BLANKS)
    repeated = 0
    grams = list(zip(words, words[1:], words[2:]))
    times = Counter(grams)
    if len(times) < len(grams):
        end = 0  # words before it are counted
        for i, gram in enumerate(grams):
            if times[gram] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    lines = octets.split(b"\n")
    duplicates = 0
    if len(lines) > 1:
        seen: set[bytes] = set()
        for line in lines:
            if line in seen:
                duplicates += bool(line.strip())
            else:
                seen.add(line)
    return (
        len(words),
        chars,
        sum(octets.count(b) for b in SYMBOLS),
        duplicates,
        repeated,
        len(set(words)),
        sum(a == b for a, b in zip(words, words[1:])),
        len(octets) - len(octets.translate(None, _UPPER)),
        len(octets) - len(octets.translate(None, _DIGITS)),
        octets.count(b"!") + octets.count(b"?"),
    )


def text_statistics(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, the counts of ``COUNTS``) per row; whole texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(text.as_py()) for text in batch.column(1)]
            columns = zip(*rows) if rows else [[] for _ in COUNTS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)],
                names=["id", *COUNTS],
            )

    pairs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return pairs.mapInArrow(run, "id long, " + ", ".join(f"{c} long" for c in COUNTS))


def feature(name: str) -> Column:
    """A statistic that rules may test, as a column over ``COUNTS``; 0 where it divides by 0."""
    over, under = RATIOS[name]
    if under is None:
        return F.col(over).cast("double")
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    """``name`` at most, or above, ``bound``."""

    name: str
    above: bool
    bound: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        value = values[self.name]
        return value > self.bound if self.above else value <= self.bound

    def column(self) -> Column:
        value = feature(self.name)
        return value > self.bound if self.above else value <= self.bound

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.bound:g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, values: dict[str, np.ndarray], size: int) -> np.ndarray:
    inside = np.ones(size, bool)
    for condition in rule:
        inside &= condition.holds(values)
    return inside


def learn(
    values: dict[str, np.ndarray],
    low: np.ndarray,
    *,
    least_precision: float = 0.9,
    most_rules: int = 32,
    most_conditions: int = 4,
    cuts: int = 32,
) -> list[Rule]:
    """Rules that find the rows of ``low``, in the order in which they apply.

    Rows go to growing and pruning by position (every third prunes). Learning ends when
    no low row is left, a rule isn't precise enough on the pruning rows, or at
    ``most_rules``.
    """
    left = np.ones(len(low), bool)
    prunes = np.arange(len(low)) % 3 == 2
    rules: list[Rule] = []
    while len(rules) < most_rules and (low & left).any():
        rule = _grow(values, low, left & ~prunes, most_conditions, cuts)
        rule = _prune(rule, values, low, left & prunes)
        inside = covered(rule, values, len(low)) & left
        right, tested = (inside & low & prunes).sum(), (inside & prunes).sum()
        good = (inside & low).sum() >= least_precision * inside.sum()
        if not rule or not (inside & low).any() or not good or right < least_precision * tested:
            break
        rules.append(rule)
        left &= ~inside
    return rules


def _grow(
    values: dict[str, np.ndarray], low: np.ndarray, rows: np.ndarray, most: int, cuts: int
) -> Rule:
    rule: Rule = ()
    inside = rows.copy()
    while len(rule) < most:
        hits, total = (inside & low).sum(), inside.sum()
        if not hits or hits == total:
            break
        now = math.log2(hits / total)
        best, gained = None, 0.0
        for name, value in values.items():
            here = value[inside]
            marks = low[inside]
            for bound in np.unique(np.quantile(here, np.linspace(0, 1, cuts))):
                above = here > bound
                for side, chosen in ((True, above), (False, ~above)):
                    p, n = (chosen & marks).sum(), chosen.sum()
                    gain = p * (math.log2(p / n) - now) if p else 0.0
                    if gain > gained + 1e-9:
                        best, gained = Condition(name, side, float(bound)), gain
        if best is None:
            break
        rule = (*rule, best)
        inside &= best.holds(values)
    return rule


def _prune(rule: Rule, values: dict[str, np.ndarray], low: np.ndarray, rows: np.ndarray) -> Rule:
    """The beginning of the rule that does best on the pruning rows; the whole in a tie."""

    def worth(part: Rule) -> float:
        inside = covered(part, values, len(low)) & rows
        p = (inside & low).sum()
        return (2 * p - inside.sum()) / max(1, inside.sum())

    parts = [rule[:i] for i in range(len(rule), 0, -1)]
    return max(parts, key=worth, default=())


def fit(
    counts: DataFrame, labels: DataFrame, *, label_col: str = "quality", most_rows: int = 20_000
) -> list[Rule]:
    """A decision list from labelled statistics.

    ``counts`` has id and ``COUNTS``; ``labels`` has doc_id and ``label_col``, of which 0
    is low. At most ``most_rows`` labelled rows are used, chosen by a hash of the id; they
    are what reaches the driver. Rows with a NULL id or label teach nothing; a document
    labelled twice counts as low if any label is. Without a low or a good row the list is
    empty.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.min(label_col).alias("label"))
    )
    order = F.xxhash64("id")
    chosen = F.broadcast(known.orderBy(order, "id").limit(most_rows))
    names = list(RATIOS)
    rows = (
        counts.join(chosen, "id")
        .select("id", "label", *(feature(n).alias(n) for n in names))
        .orderBy(order, "id", *names)
        .limit(most_rows)
        .toPandas()
    )
    low = (rows["label"] == 0).to_numpy(bool)
    if low.all() or not low.any():
        return []
    return learn({n: rows[n].to_numpy(float) for n in names}, low)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that a row meets, from 1; NULL if it meets none."""
    out = None
    for number, rule in enumerate(rules, 1):
        test = rule[0].column()
        for condition in rule[1:]:
            test &= condition.column()
        out = F.when(test, F.lit(number)) if out is None else out.when(test, F.lit(number))
    return F.lit(None).cast("int") if out is None else out


def apply_rules(counts: DataFrame, rules: list[Rule]) -> DataFrame:
    """``counts`` with rule (number of the rule met, else NULL) and its text."""
    number = verdict(rules)
    texts = F.array(*(F.lit(" and ".join(map(str, rule))) for rule in rules))
    said = F.get(texts, number - 1) if rules else F.lit(None).cast("string")
    return counts.withColumns({"rule": number, "rule_text": said})


def judge(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    least_words: int = 50,
    most_repeat_percent: int = 50,
    most_rows: int = 20_000,
) -> DataFrame:
    """(id, counts, base_failed, rule, rule_text, kept) per row of ``docs``.

    ``base_failed``: fewer than ``least_words`` words, or over ``most_repeat_percent`` of
    the words in repeated windows. ``kept``: neither that nor a learned rule met; the list
    is learned from the labelled rows that did not fail. NULL,
    empty and blank texts have no words and fail. Repeated rows are judged alike; other
    columns are not read; an empty table gives an empty one.
    """
    counts = text_statistics(docs, id_col=id_col, text_col=text_col)
    failed = (F.col("n_words") < least_words) | (
        100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words")
    )
    rules = fit(counts.where(~failed), labels, label_col=label_col, most_rows=most_rows)
    judged = apply_rules(counts, rules).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
