"""Benchmark decontamination under edit distance.

CGK embeds a string into Hamming space by a random walk: at each step it writes the
letter it stands on, and a random bit, drawn per step and letter, decides whether it moves
on. Strings that differ by few edits walk alike for long and fall into step again. A few
coordinates of the embedding, drawn at random, are a locality-sensitive hash (bit
sampling for Hamming distance); several walks with several draws reach the target recall.
How many is measured on copies as far away as a copy may be, made of the items that are
hardest to find. If no number of walks of any length reaches it, all places are compared.

Windows begin at the words of a document and of an item alike. Walks are as long as the
item's class allows, so a window that matches is one inside the item's own length. The
hashes of all item windows are bounded by the benchmark and are sent to the tasks in
blocks; documents are never shuffled. A window whose hash begins like none of an item's
is given up after a few coordinates. Every match names a place in the document where the
item would begin, and there the exact edit distance decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.llm.common import free_name, sent_if_small, written

STEPS = (48, 24, 12, 6, 3, 1)  # lengths of walks; an item takes the longest that finds it surely
SAMPLES = 12  # coordinates per hash, at most
WORK_BYTES = 1 << 22  # of document text walked at once
BLOCK_CHARS = 1 << 22  # of item text sent out at once
MOST_WALKS = 16  # an item that needs more takes shorter walks; if none will do, it is searched exactly
HARDEST, COPIES = 6, 40  # items of like length, and copies of each, that recall is measured on
FILTER_SHARE = 16  # bits of a filter per hash in it
HEAD = 8  # bytes of a window that are compared to find those that begin alike; one number
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str | None) -> str:
    """Lower case, with single blanks between the words."""
    return " ".join((text or "").lower().split())


def window_starts(octets: np.ndarray) -> np.ndarray:
    """Where windows begin: at words, and at every letter that follows none of a-z, 0-9."""
    plain = np.zeros(256, bool)
    plain[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True
    begin = np.ones(256, bool)
    begin[[0, 32, *range(0x80, 0xC0)]] = False  # no blank, no inner byte of a letter
    after = np.ones(len(octets), bool)
    after[1:] = ~plain[octets[:-1]]
    return np.flatnonzero(after & begin[octets])


@dataclass
class Walk:
    """One random walk with its sampled coordinates."""

    moves: np.ndarray  # step and letter: 0 or 1
    sampled: np.ndarray  # steps whose letter enters the hash

    @classmethod
    def draw(cls, rng: np.random.Generator, steps: int) -> Walk:
        moves = rng.integers(0, 2, (steps, 256)).astype(np.int64)
        return cls(moves, np.sort(rng.permutation(steps)[: min(SAMPLES, steps)]))

    def hashes(
        self,
        octets: np.ndarray,
        starts: np.ndarray,
        filters: list[np.ndarray] | None = None,
        heads: tuple[np.ndarray, np.ndarray] | None = None,
    ) -> tuple[np.ndarray, np.ndarray]:
        """(index of the start, hash); starts that no filter lets through are left out.

        ``octets`` must go on for as many bytes as the walk has steps. With the ``heads_of`` the
        starts, those that begin alike walk their first steps as one.
        """
        first = starts if heads is None else heads[0]
        index, place = np.arange(len(first)), first.astype(np.int64)
        key = np.zeros(len(first), np.uint64)
        taken = 0
        for step in range(int(self.sampled[-1]) + 1):
            if heads is not None and step == HEAD:
                index, place, key = _spread(index, place, key, starts, heads)
                heads = None
            letter = octets.take(place)
            if self.sampled[taken] == step:
                key = (key + letter + np.uint64(1)) * _MIX
                key ^= key >> np.uint64(29)
                if filters is not None and taken:
                    stays = np.flatnonzero(_among(filters[taken], key))
                    if len(stays) < len(key):
                        index, place = index[stays], place[stays]
                        key, letter = key[stays], letter[stays]
                taken += 1
            place += self.moves[step].take(letter)
        if heads is not None:
            index, place, key = _spread(index, place, key, starts, heads)
        return index, key

    def prefixes(self, octets: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Filters that let pass what begins like the hash of one of the starts."""
        out = []
        for taken in range(len(self.sampled)):
            part = Walk(self.moves, self.sampled[: taken + 1])
            out.append(_bits_of(part.hashes(octets, starts)[1]))
        return out


def heads_of(octets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A start for each different run of ``HEAD`` bytes that starts begin with, and which is whose.

    A walk stands at most as many bytes from its start as it has made steps, so those that
    begin alike are together until then.
    """
    head = np.zeros(len(starts), np.uint64)
    for i in range(HEAD):
        head = head << np.uint64(8) | octets[starts + i]
    _, first, whose = np.unique(head, return_index=True, return_inverse=True)
    return starts[first], whose


def _spread(index, place, key, starts, heads):
    """What walks from ``heads`` have come to, for each of their starts."""
    slot = np.full(len(heads[0]), -1)
    slot[index] = np.arange(len(index))
    slot = slot[heads[1]]
    whole = np.flatnonzero(slot >= 0)
    slot = slot[whole]
    gone = place - heads[0][index]
    return whole, starts[whole] + gone[slot], key[slot]


def _bits_of(keys: np.ndarray) -> np.ndarray:
    """A set of keys as bits by their first digits, packed, as many as the keys call for."""
    digits = max(10, int(FILTER_SHARE * len(keys) - 1).bit_length())
    bits = np.zeros(1 << digits, bool)
    bits[keys >> np.uint64(64 - digits)] = True
    return np.packbits(bits, bitorder="little")


def _among(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the set."""
    slot = (keys >> np.uint64(64 - (8 * len(packed) - 1).bit_length())).astype(np.int64)
    return (packed[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def edit_end(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the substring of ``text`` nearest to ``pattern``, the first of equals.

    None if it is more than ``most`` edits away. Myers' bit-parallel columns, as integers.
    """
    size = len(pattern)
    where: dict[str, int] = {}
    for i, letter in enumerate(pattern):
        where[letter] = where.get(letter, 0) | 1 << i
    mask, top = (1 << size) - 1, 1 << size - 1
    up, down, score = mask, 0, size
    best = (score, 0)
    for end, letter in enumerate(text, 1):
        equal = where.get(letter, 0)
        across = equal | down
        along = (((equal & up) + up) ^ up) | equal
        plus = down | (~(along | up) & mask)
        minus = up & along
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best[0]:
                best = (score, end)
        plus, minus = plus << 1 & mask, minus << 1 & mask
        up = minus | (~(across | plus) & mask)
        down = plus & across
    return best if best[0] <= most else None


def letter_classes(text: str) -> np.ndarray:
    """The letters of a text in 128 classes; a letter of ASCII is a class of its own."""
    return (np.frombuffer(text.encode("utf-32-le"), "<u4") & 127).astype(np.intp)


def laid_letters(texts: list[str]) -> np.ndarray:
    """The letter classes of texts, one in each column; beyond a text's end a class of none."""
    sizes = np.array([len(t) for t in texts], np.int64)
    laid = np.full((len(texts), sizes.max(initial=0)), 128, np.intp)
    laid[np.arange(laid.shape[1]) < sizes[:, None]] = letter_classes("".join(texts))
    return np.ascontiguousarray(laid.T)


class Sieve:
    """Tells which of many (pattern, text) pairs may be within some edits, all at once.

    The columns of ``edit_end`` in words of 64 bits, for thousands of pairs per step. Letters
    of a class count as equal, so a distance may come out too small, never too large.
    """

    def __init__(self, patterns: list[str]):
        self.sizes = np.array([len(p) for p in patterns], np.int64)
        self.words = int(-(-self.sizes.max(initial=1) // 64))
        self.where = np.zeros((len(patterns), 129, self.words), np.uint64)
        for i, pattern in enumerate(patterns):
            for place, letter in enumerate(letter_classes(pattern)):
                self.where[i, letter, place // 64] |= np.uint64(1 << place % 64)

    def passes(self, owners: np.ndarray, texts: list[str], most: np.ndarray) -> np.ndarray:
        """Whether ``texts[i]`` may hold pattern ``owners[i]`` with ``most[i]`` edits.

        First each word of 64 letters is looked for alone. The edits that the words need apart
        are no more than the whole needs, so most pairs are out before all words are tried.
        """
        out = np.zeros(len(texts), bool)
        # Alike in size together, so that a step is not for the longest of all.
        order = np.lexsort([[len(t) for t in texts], self.sizes[owners] // 64])
        for start in range(0, len(texts), 2048):
            part = order[start : start + 2048]
            letters = laid_letters([texts[i] for i in part])
            left = np.arange(len(part))
            needed = np.zeros(len(part), np.int64)
            for word in range(self.words):
                has = left[self.sizes[owners[part[left]]] > 64 * word]
                if not len(has):
                    break
                needed[has] += self._least_of_word(word, owners[part[has]], letters[:, has])
                left = left[needed[left] <= most[part[left]]]
            if len(left):
                chosen = part[left]
                least = self._least(owners[chosen], [texts[i] for i in chosen])
                out[chosen] = least <= most[chosen]
        return out

    def _least_of_word(self, word: int, owners: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The fewest edits with which a pattern's word of 64 letters is in a column of letters."""
        one = np.uint64(1)
        sizes = np.minimum(self.sizes[owners] - 64 * word, 64)
        where, base = self.where[:, :, word].ravel(), owners * self.where.shape[1]
        last = (sizes - 1).astype(np.uint64)
        up, down = np.full(len(owners), ~np.uint64(0)), np.zeros(len(owners), np.uint64)
        score, least = sizes.copy(), sizes.copy()
        plus, minus, across, along = (np.empty(len(owners), np.uint64) for _ in range(4))
        for row in letters:
            equal = where.take(base + row)
            np.bitwise_or(equal, down, out=across)
            np.bitwise_and(equal, up, out=along)
            along += up
            along ^= up
            along |= equal
            np.bitwise_or(along, up, out=plus)
            np.invert(plus, out=plus)
            plus |= down
            np.bitwise_and(up, along, out=minus)
            score += ((plus >> last) & one).view(np.int64)
            score -= ((minus >> last) & one).view(np.int64)
            np.minimum(least, score, out=least)
            plus <<= one
            minus <<= one
            np.bitwise_or(across, plus, out=up)
            np.invert(up, out=up)
            up |= minus
            np.bitwise_and(plus, across, out=down)
        return least

    def _least(self, owners: np.ndarray, texts: list[str]) -> np.ndarray:
        one, high = np.uint64(1), np.uint64(63)
        letters = laid_letters(texts)
        sizes = self.sizes[owners]
        words = int(-(-sizes.max(initial=1) // 64))
        top = np.zeros((words, len(texts)), np.uint64)
        top[(sizes - 1) // 64, np.arange(len(texts))] = one << ((sizes - 1) % 64).astype(np.uint64)
        up = np.full((words, len(texts)), ~np.uint64(0))
        down = np.zeros((words, len(texts)), np.uint64)
        score, least = sizes.copy(), sizes.copy()
        for row in letters:
            equals = self.where[owners, row, :words]
            more = less = np.zeros(len(texts), np.uint64)  # carried from word to word
            for w in range(words):
                equal, p, m = equals[:, w], up[w], down[w]
                across = equal | m
                equal = equal | less
                along = (((equal & p) + p) ^ p) | equal
                plus, minus = m | ~(along | p), p & along
                score += ((plus & top[w]) != 0).astype(np.int64)
                score -= ((minus & top[w]) != 0).astype(np.int64)
                plus_out, minus_out = plus >> high, minus >> high
                plus, minus = plus << one | more, minus << one | less
                up[w], down[w] = minus | ~(across | plus), plus & across
                more, less = plus_out, minus_out
            np.minimum(least, score, out=least)
        return least


@dataclass
class Items:
    """Benchmark items of one class of lengths, ready to be looked for."""

    ids: list[int]
    texts: list[str]
    sizes: list[int]  # in bytes
    exact: bool  # no number of walks is enough: all places are compared
    walks: list[Walk]
    filters: list[list[np.ndarray]]
    keys: list[np.ndarray]  # per walk: sorted hashes, each with item and offset
    owners: list[np.ndarray]
    offsets: list[np.ndarray]
    sieve: Sieve

    @classmethod
    def build(cls, ids, texts, steps: int, count: int) -> Items:
        rng = np.random.default_rng(steps)
        raw = [t.encode() for t in texts]
        octets, starts, owners, offsets = _laid(raw, steps)
        walks = [Walk.draw(rng, steps) for _ in range(count)]
        sizes = [len(r) for r in raw]
        items = cls(list(ids), list(texts), sizes, not count, walks, [], [], [], [], Sieve(texts))
        for walk in walks:
            _, key = walk.hashes(octets, starts)
            order = np.argsort(key, kind="stable")
            items.filters.append(walk.prefixes(octets, starts))
            items.keys.append(key[order])
            items.owners.append(owners[order])
            items.offsets.append(offsets[order])
        return items

    def candidates(self, octets: np.ndarray, starts: np.ndarray, heads=None):
        """(place in ``octets`` where the item would begin, item) of all matching windows."""
        places, items = [], []
        for walk, bits, keys, owners, offsets in zip(
            self.walks, self.filters, self.keys, self.owners, self.offsets
        ):
            index, key = walk.hashes(octets, starts, bits, heads)
            low = np.searchsorted(keys, key, "left")
            wide = np.searchsorted(keys, key, "right") - low
            row = np.repeat(np.arange(len(key)), wide)
            before = np.cumsum(wide) - wide
            at = np.arange(len(row)) + np.repeat(low - before, wide)
            places.append(starts[index[row]] - offsets[at])
            items.append(owners[at])
        return np.concatenate(places), np.concatenate(items)


def _laid(raw: list[bytes], steps: int):
    """(octets, starts, owners, offsets) of the windows of strings laid one after another."""
    pad = bytes(steps + 1)
    octets = np.frombuffer(pad.join(raw) + pad, np.uint8)
    first = np.cumsum([0, *(len(r) + len(pad) for r in raw)])[:-1]
    starts = window_starts(octets)
    owners = np.searchsorted(first, starts, "right") - 1
    offsets = starts - first[owners]
    sizes = np.array([len(r) for r in raw], np.int64)
    whole = (offsets + steps <= sizes[owners]) | (offsets == 0)
    return octets, starts[whole], owners[whole], offsets[whole]


def edited(text: str, edits: int, letters: np.ndarray, rng: np.random.Generator) -> str:
    """``text`` with so many of its letters deleted, replaced, or followed by a new one."""
    copied = list(text)
    for place in rng.permutation(len(text))[:edits]:
        new = rng.choice(letters)
        copied[place] = [text[place] + new, "", new][rng.integers(3)]
    return "".join(copied)


def walks_needed(
    texts: list[str], steps: int, rate: float, recall: float, rng: np.random.Generator
) -> int | None:
    """Walks that find a copy with ``rate`` of its letters edited with probability ``recall``.

    Measured on the items of fewest windows, the hardest of the class, and for each of them:
    the worst one counts. Each is copied with random insertions, deletions and replacements;
    a walk finds a copy if one of its windows has the hash of an item window so near to its
    offset that the search would look in the right place. What counts is the share of copies
    that all of the walks miss, since some copies are harder than others. None if
    ``MOST_WALKS`` are not enough.
    """
    windows = np.bincount(_laid([t.encode() for t in texts], steps)[2], minlength=len(texts))
    chosen = [texts[i] for i in np.lexsort([[len(t) for t in texts], windows])[:HARDEST]]
    letters = np.array(sorted(set("".join(chosen))) or ["a"])
    owner = np.repeat(np.arange(len(chosen)), COPIES)
    copies = [edited(chosen[i], int(rate * len(chosen[i])), letters, rng) for i in owner]
    one = _laid([t.encode() for t in chosen], steps)
    two = _laid([t.encode() for t in copies], steps)
    near = np.array([int(rate * len(t)) for t in chosen], np.int64)
    drawn = 2 * MOST_WALKS
    hits = np.zeros(len(copies), np.int64)
    for _ in range(drawn):
        walk = Walk.draw(rng, steps)
        _, key = walk.hashes(one[0], one[1])
        _, other = walk.hashes(two[0], two[1])
        order = np.argsort(key, kind="stable")
        low = np.searchsorted(key[order], other, "left")
        wide = np.searchsorted(key[order], other, "right") - low
        row = np.repeat(np.arange(len(other)), wide)
        at = order[np.arange(len(row)) + np.repeat(low - (np.cumsum(wide) - wide), wide)]
        copy = two[2][row]
        same = (one[2][at] == owner[copy]) & (np.abs(one[3][at] - two[3][row]) <= near[owner[copy]])
        hits += np.bincount(copy[same], minlength=len(copies)) > 0
    missed = np.ones(len(copies))  # the chance that as many walks, of those drawn, all miss
    for count in range(1, MOST_WALKS + 1):
        missed *= np.maximum(drawn - hits - count + 1, 0) / (drawn - count + 1)
        if count > 1 and missed.reshape(len(chosen), COPIES).mean(axis=1).max() <= 1 - recall:
            return count
    return None


def prepared(rows: list[tuple[int, str]], design_rate: float, recall: float) -> list[Items]:
    """The items by class of walks; empty ones are found nowhere.

    Items with about as many windows are measured together. They take the longest walks of
    which ``MOST_WALKS`` at most reach the recall; a class draws as many as its neediest take.
    """
    alike: dict[tuple[int, int], list[tuple[int, str]]] = {}
    for item, text in rows:
        text = normalised(text)
        if text:
            octets = text.encode()
            longest = next((s for s in STEPS if s <= len(octets) / 1.5), STEPS[-1])
            windows = len(_laid([octets], longest)[1])
            alike.setdefault((longest, int(8 * math.log2(windows)) // 2), []).append((item, text))
    classes: dict[int, list[tuple[int, str]]] = {}
    counts: dict[int, int] = {0: 0}
    for (longest, windows), part in sorted(alike.items()):
        rng = np.random.default_rng([longest, windows])
        for steps in STEPS[STEPS.index(longest) :]:
            count = walks_needed([t for _, t in part], steps, design_rate, recall, rng)
            if count:
                break
        else:
            steps, count = 0, 0
        classes.setdefault(steps, []).extend(part)
        counts[steps] = max(counts.get(steps, 0), count)
    return [
        Items.build([i for i, _ in part], [t for _, t in part], steps, counts[steps])
        for steps, part in sorted(classes.items())
    ]


def search(
    texts: list[str], items: list[Items], most_edits: float
) -> list[tuple[int, int, int, int, int]]:
    """(row, item id, distance, start, stop) for items found in normalised texts.

    Start and stop count letters of the normalised text. An item is given once per text,
    where it is nearest, first in the text among equals.
    """
    out = []
    group: list[int] = []
    size = 0
    for row, text in enumerate(texts):
        group.append(row)
        size += len(text)
        if size >= WORK_BYTES:
            out += _search(texts, group, items, most_edits)
            group, size = [], 0
    return out + _search(texts, group, items, most_edits)


def _search(texts, group, items, most_edits):
    raw = [texts[row].encode() for row in group]
    pad = bytes(STEPS[0] + 1)
    octets = np.frombuffer(pad.join(raw) + pad, np.uint8)
    first = np.cumsum([0, *(len(r) + len(pad) for r in raw)])[:-1]
    starts = window_starts(octets)
    if not len(starts):
        return []
    heads = heads_of(octets, starts)
    lengths = np.array([len(r) for r in raw], np.int64)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for part in items:
        if part.exact:
            tried = _everywhere(raw, part, most_edits)
            _confirm(texts, group, raw, part, tried, best)
            continue
        places, owners = part.candidates(octets, starts, heads)
        # A window may lie before its text's begin by the letters that were edited away.
        sizes = np.array(part.sizes, np.int64)
        slack = (sizes * most_edits).astype(np.int64)[owners]
        rows = np.searchsorted(first, places + np.minimum(slack, len(pad)), "right") - 1
        rows = np.maximum(rows, 0)
        near = (places - first[rows]) // 16
        owners, rows, near = _different(owners, rows, near)
        most = np.array([int(most_edits * len(t)) for t in part.texts], np.int64)
        begins = np.maximum(0, near * 16 - 2 * most[owners])
        stops = np.minimum(near * 16 + 16 + sizes[owners] + 2 * most[owners], lengths[rows])
        tried = [
            (row, item, int(most[item]), begin, raw[row][begin:stop].decode("utf-8", "ignore"))
            for row, item, begin, stop in zip(*(x.tolist() for x in (rows, owners, begins, stops)))
        ]
        _confirm(texts, group, raw, part, tried, best)
    return [(row, item, *found) for (row, item), found in sorted(best.items())]


def _different(owners: np.ndarray, rows: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different (owner, row, near), by row and item."""
    if not len(rows):
        return owners, rows, near
    low = near.min()
    wide, items = int(near.max() - low) + 1, int(owners.max()) + 1
    key = np.unique((rows * items + owners) * wide + (near - low))
    near, key = key % wide + low, key // wide
    return key % items, key // items, near


def _everywhere(raw: list[bytes], part: Items, most_edits: float):
    """Regions of all rows that hold every place where an item may be, one item's at a time."""
    tried = []
    for row, text in enumerate(raw):
        widest = 1 if text.isascii() else 4  # bytes of a letter
        for item, own in enumerate(part.texts):
            most = int(most_edits * len(own))
            # Letters that are not the item's own may be wider than its letters.
            longest = (len(own) + most) * widest
            for begin in range(0, max(1, len(text)), longest):
                region = text[begin : begin + 2 * longest].decode("utf-8", "ignore")
                tried.append((row, item, most, begin, region))
    return tried


def _confirm(texts, group, raw, part: Items, tried, best) -> None:
    """Puts the nearest place of each tried (row, item) into ``best``, if it is near enough."""
    may = part.sieve.passes(
        np.array([t[1] for t in tried], np.int64),
        [t[4] for t in tried],
        np.array([t[2] for t in tried], np.int64),
    )
    for row, item, most, begin, region in (t for t, passed in zip(tried, may) if passed):
        text = part.texts[item]
        key = (group[row], part.ids[item])
        known = best.get(key)
        if known and known[0] == 0:
            continue
        hit = edit_end(text, region, most if known is None else min(most, known[0] - 1))
        if hit:
            distance, end = hit
            back = edit_end(text[::-1], region[:end][::-1], distance)
            start = end - (back[1] if back else len(text))
            lead = len(raw[row][:begin].decode("utf-8", "ignore"))
            best[key] = (distance, lead + start, lead + end)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    most_edits: float = 0.2,
    design_rate: float | None = None,
    recall: float = 0.99,
) -> DataFrame:
    """(id, uid, item_id, distance, start, stop) for each item found in a row of ``docs``.

    Found means: a substring of the normalised text (lower case, single blanks) is within
    ``most_edits`` of the item's length in edits. Start and stop are places in that text.
    Copies with ``design_rate`` of their letters edited, by default ``most_edits``, are found
    with probability ``recall`` at least, nearer ones more surely; what is given is always exact. ``uid``
    hashes id and text. Whole texts are searched. NULL, empty and blank texts and items
    match nothing; repeated rows and items are found each; NULL ids stay NULL; no other
    column is read.

    Items come to the driver in blocks of ``BLOCK_CHARS`` letters, each block a pass over
    the documents. There is no shuffle.
    """
    spark = docs.sparkSession
    design_rate = most_edits if design_rate is None else design_rate
    wanted = benchmark.select(
        F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")
    ).where(F.col("text").isNotNull())
    size = wanted.agg(F.sum(F.char_length("text"))).first()[0] or 0
    passes = max(1, math.ceil(size / BLOCK_CHARS))
    share = F.pmod(F.xxhash64("item", "text"), F.lit(passes))
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(id_col, text_col).alias("uid"),
        F.col(text_col).alias("text"),
    )
    schema = "id long, uid long, item_id long, distance int, start int, stop int"
    found = None
    for number in range(passes):
        part = wanted.where(share == number).orderBy("item", "text")
        rows = [(r["item"], r["text"]) for r in part.toLocalIterator()]
        sent = spark.sparkContext.broadcast(prepared(rows, design_rate, recall))
        hits = texts.mapInArrow(_searcher(sent, most_edits), schema)
        found = hits if found is None else found.unionByName(hits)
    return found


def _searcher(sent, most_edits: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for batch in batches:
            hits = search([normalised(t.as_py()) for t in batch.column(2)], items, most_edits)
            rows = pa.array([h[0] for h in hits], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array([h[1] for h in hits], pa.int64()),
                    *(pa.array([h[c] for h in hits], pa.int32()) for c in (2, 3, 4)),
                ],
                names=["id", "uid", "item_id", "distance", "start", "stop"],
            )

    return run


def clean(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"):
    """``docs`` without the rows in which ``found`` (of ``contaminated``) has an item.

    Rows are recognised by id and text, so repeated rows go together; all columns stay.
    """
    uid = free_name(docs, "uid")
    gone = written(found.select(F.col("uid").alias("gone")).distinct(), "contaminated")
    marked = docs.withColumn(uid, F.xxhash64(id_col, text_col))
    gone = sent_if_small(gone, 24)
    return marked.join(gone, marked[uid] == gone["gone"], "left_anti").select(
        *(marked[c] for c in docs.columns)
    )
