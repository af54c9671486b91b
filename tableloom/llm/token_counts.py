"""Token counts of byte-level BPE vocabularies by finite-state transducers.

Two deterministic transducers are compiled from the tokenizer file.

The *splitter* reads classes of code points and marks where the pieces begin that BPE
works on. Its transitions emit the marks for the current and the previous code point, so
its one-character lookahead needs no backing up. A batch of texts is one code point
array, cut into equal chunks. Every chunk is run from all states at once, which gives its
state map; the maps are composed by a parallel prefix scan; from its true first state
each chunk then emits its marks.

The *counter* reads the bytes of a piece, and its transitions emit by how much the number
of tokens changes. It is determinised on demand: a state holds the longest suffix that
may still grow into a token, and for each place in that suffix the last token of the
encoding up to there with its number of tokens. By the uniqueness of BPE encodings, the
last token after one more byte is the longest one that fits its predecessor.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

CHUNK = 256  # code points run in lock-step
GROUP = 1 << 20  # code points of texts that are split together
MOST_STATES = 300_000  # of the counter, before it starts over; results do not change
MOST_PIECES = 500_000  # remembered, likewise

# Classes of code points.
LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE, STMD, R, V, E, L, END = range(12)
# States of the splitter. A run of blanks is told apart by length and by its last code point.
(AFRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_SPACE, SPACES, ONE_BLANK, BLANKS) = range(8)
AT_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(8, 12)
STATES = CLASSES = 12
HERE, BEFORE = 1, 2  # marks: a piece begins at this code point, at the previous one


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by state and class."""
    letters = (LETTER, STMD, R, V, E, L)
    begin = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SPACE: ONE_SPACE}
    begin |= {BLANK: ONE_BLANK, QUOTE: AT_QUOTE, END: AFRESH}
    begin |= dict.fromkeys(letters, IN_LETTERS)
    joined = {k: v for k, v in begin.items() if k not in (SPACE, BLANK, END)} | {QUOTE: IN_OTHERS}
    step = np.zeros((STATES, CLASSES), np.uint8)
    mark = np.zeros((STATES, CLASSES), np.uint8)
    for state in range(STATES):
        for kind in range(CLASSES):
            step[state, kind], mark[state, kind] = begin[kind], HERE

    def put(state: int, kinds, target: int | dict, marks: int) -> None:
        for kind in kinds:
            step[state, kind] = target[kind] if isinstance(target, dict) else target
            mark[state, kind] = marks

    put(IN_LETTERS, letters, IN_LETTERS, 0)
    put(IN_NUMBERS, (NUMBER,), IN_NUMBERS, 0)
    put(IN_OTHERS, (OTHER, QUOTE), IN_OTHERS, 0)
    put(ONE_SPACE, joined, joined, 0)
    put(SPACES, joined, joined, BEFORE)
    put(BLANKS, joined, begin, BEFORE | HERE)
    for state in (ONE_SPACE, SPACES, ONE_BLANK, BLANKS):
        put(state, (SPACE,), SPACES, 0)
        put(state, (BLANK,), BLANKS, 0)
    put(AT_QUOTE, (OTHER, QUOTE), IN_OTHERS, 0)
    put(AT_QUOTE, (STMD,), AFRESH, 0)
    for kind, state, last in ((R, QUOTE_R, E), (V, QUOTE_V, E), (L, QUOTE_L, L)):
        put(AT_QUOTE, (kind,), state, 0)
        put(state, range(CLASSES), begin, BEFORE | HERE)
        put(state, letters, IN_LETTERS, BEFORE)
        put(state, (last,), AFRESH, 0)
    return step, mark


STEP, MARK = splitter()


def piece_starts(kinds: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each code point, from their classes.

    State maps of chunks, a prefix scan over them, then the marks.
    """
    size = len(kinds)
    chunks = max(1, -(-size // CHUNK))
    padded = np.full(chunks * CHUNK, END, np.uint8)
    padded[:size] = kinds
    columns = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    step, mark = STEP.ravel(), MARK.ravel()
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (chunks, 1))
    for column in columns:
        maps = step[maps.astype(np.intp) * CLASSES + column[:, None]]
    distance = 1
    while distance < chunks:
        maps[distance:] = np.take_along_axis(maps[distance:], maps[:-distance].astype(np.intp), 1)
        distance *= 2
    state = np.concatenate([[AFRESH], maps[:-1, AFRESH]]).astype(np.intp)
    marks = np.empty((CHUNK, chunks), np.uint8)
    for j, column in enumerate(columns):
        at = state * CLASSES + column
        marks[j] = mark[at]
        state = step[at].astype(np.intp)
    marks = marks.T.ravel()
    starts = (marks & HERE).astype(bool)
    starts[:-1] |= (marks[1:] & BEFORE).astype(bool)
    return starts[:size]


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


_LIBRARY = ByteLevel(add_prefix_space=False, use_regex=True)
BYTES = [bytes([b]) for b in range(256)]


class Counter:
    """Number of BPE tokens of a piece, by a transducer determinised on demand."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in merges}
        # A token that its own letters do not merge into never occurs.
        self.tokens = {t for t in tokens if self.encode(t) == [t]}
        self.prefixes = {t[:i] for t in self.tokens for i in range(len(t) + 1)}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.restart()

    def restart(self) -> None:
        self.numbers: dict[tuple, int] = {(b"", ((0, b"", 0),)): 0}
        self.states: list[tuple] = [*self.numbers]
        self.steps: list[dict[int, tuple[int, int]]] = [{}]

    def encode(self, piece: bytes) -> list[bytes]:
        """Plain merging, for single tokens and pairs of tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, len(self.rank)) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == len(self.rank):
                break
            merged, i = [], 0
            while i < len(parts):
                if i < len(ranks) and ranks[i] == best:
                    merged.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            parts = merged
        return parts

    def fit(self, left: bytes, right: bytes) -> bool:
        """Whether the encoding may have these two tokens side by side."""
        pair = (left, right)
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) >= MOST_STATES:
                self.fits.clear()
            known = self.fits[pair] = self.encode(left + right) == [left, right]
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition for ``byte``: (next state, change of the number of tokens)."""
        suffix, places = self.states[state]
        suffix += BYTES[byte]
        for start, last, count in places:  # longest last token first
            token = suffix[start:]
            if token in self.tokens and (not last or self.fit(last, token)):
                delta = count + 1
                break
        # Only places from which a token may still grow can matter later.
        prefixes = self.prefixes
        places = [p for p in places if suffix[p[0] :] in prefixes]
        cut = places[0][0] if places else len(suffix)
        key = (
            suffix[cut:],
            (*[(i - cut, t, c - delta) for i, t, c in places], (len(suffix) - cut, token, 0)),
        )
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        self.steps[state][byte] = (number, delta)
        return number, delta

    def __call__(self, piece: bytes) -> int:
        if len(self.states) > MOST_STATES:
            self.restart()
        state = total = 0
        for byte in piece:
            known = self.steps[state].get(byte)
            state, delta = known or self.compile(state, byte)
            total += delta
        return total


class _Pieces(dict):
    """Numbers of tokens by piece."""

    def __init__(self, counter: Counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        if len(self) >= MOST_PIECES:
            self.clear()
        n = self[piece] = self.counter(piece.encode("utf-8", "surrogatepass"))
        return n


class Tokens:
    """Counts the tokens of whole texts for a byte-level BPE ``tokenizer.json``."""

    def __init__(self, definition: dict):
        cut = definition["pre_tokenizer"]
        plain = definition["model"]["type"] == "BPE" and cut["type"] == "ByteLevel"
        if not plain or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("not a byte-level BPE vocabulary without a prefix blank")
        if definition.get("normalizer"):
            raise ValueError("texts would be normalised first")
        letters = byte_letters()
        merges = (m if isinstance(m, list) else m.split(" ") for m in definition["model"]["merges"])
        merges = [tuple(bytes(map(letters.__getitem__, part)) for part in m) for m in merges]
        self.pieces = _Pieces(Counter(merges))
        added = [t["content"] for t in definition.get("added_tokens", [])]
        self.special = sorted(added, key=len, reverse=True)
        self.kinds = np.full(0x110000, 255, np.uint8)
        self.kinds[[ord(c) for c in "stmdrvel' "]] = [STMD] * 4 + [R, V, E, L, QUOTE, SPACE]

    def classes(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.kinds[codes]
        unknown = kinds == 255
        if unknown.any():
            for code in np.unique(codes[unknown]):
                self.kinds[code] = kind_of(chr(code))
            kinds = self.kinds[codes]
        return kinds

    def segments(self, text: str) -> tuple[list[str], int]:
        """The text between special strings, and how many of these there are."""
        parts, found = [text], 0
        for special in self.special:
            cut = [part.split(special) for part in parts]
            found += sum(len(c) - 1 for c in cut)
            parts = [p for c in cut for p in c]
        return parts, found

    def counts(self, texts: list[str]) -> list[int]:
        totals, group, size = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            parts, totals[i] = self.segments(text)
            for part in parts:
                if part:
                    group.append((i, part))
                    size += len(part) + 1
            if size >= GROUP:
                self._add(group, totals)
                group, size = [], 0
        self._add(group, totals)
        return totals

    def _add(self, group: list[tuple[int, str]], totals: list[int]) -> None:
        if not group:
            return
        joined = "\0".join(part for _, part in group)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.array([len(part) for _, part in group])
        first = np.cumsum(lengths + 1) - lengths - 1
        kinds = self.classes(codes)
        kinds[first[1:] - 1] = END
        starts = np.flatnonzero(piece_starts(kinds))
        # The separators are marked as pieces of their own; each ends a segment.
        places = np.searchsorted(starts, first)
        pieces = self.pieces
        for (i, _), a, b, begin, size in zip(
            group, places, np.append(places[1:] - 1, len(starts)), first, lengths
        ):
            for low in range(a, b, GROUP):
                cuts = starts[low : min(low + GROUP, b) + 1].tolist()
                if low + GROUP >= b:
                    cuts = [*cuts[: b - low], int(begin + size)]
                totals[i] += sum(pieces[joined[x:y]] for x, y in zip(cuts, cuts[1:]))


def kind_of(letter: str) -> int:
    """Class of a code point, as the library's own table of Unicode properties has it."""
    for probe, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
        if len(_LIBRARY.pre_tokenize_str(probe + letter)) == 1:
            return kind
    return BLANK


def token_counts(
    docs: DataFrame,
    definition: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row of ``docs``.

    ``definition`` is the JSON text of a byte-level BPE tokenizer, read by the caller, so
    executors need no file. No begin, end or added tokens; a special string inside a text
    is one token. NULL and empty texts have 0 bytes and 0 tokens. Rows keep their number,
    repeated ones too; no other column is read. Long texts are split in one pass and
    counted piece by piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(definition)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = tokens.counts(texts)
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([c > limit for c in counts], pa.bool_()),
                ],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    pairs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return pairs.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean")


_compiled: dict[int, Tokens] = {}


def _tokens(definition: str) -> Tokens:
    """One compiled tokenizer per Python worker, which serves many tasks."""
    key = hash(definition)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Tokens(json.loads(definition))
    return _compiled[key]


