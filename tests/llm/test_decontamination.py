"""Benchmark search against a plain edit distance over all documents and items."""

import random

import numpy as np
from tableloom.llm import decontamination as d
from tableloom.llm import queries

from .conftest import ODD


def plain_distance(pattern, text):
    """Least edits between ``pattern`` and any substring of ``text``."""
    row = np.arange(len(pattern) + 1)
    best = row[-1]
    codes = np.array([ord(c) for c in pattern])
    steps = np.arange(len(pattern) + 1)
    for letter in text:
        change = row[:-1] + (codes != ord(letter))
        new = np.concatenate([[0], np.minimum(change, row[1:] + 1)])
        row = np.minimum.accumulate(new - steps) + steps
        best = min(best, row[-1])
    return int(best)


def test_bit_parallel_distance_is_exact():
    rng = random.Random(4)
    for _ in range(300):
        pattern = "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 12)))
        text = "".join(rng.choice("ab ") for _ in range(rng.randrange(0, 25)))
        distance, end = d.edit_end(pattern, text, 99)
        assert distance == plain_distance(pattern, text)
        assert plain_distance(pattern, text[:end]) == distance


def test_sieve_is_exact_on_plain_letters_and_never_too_strict():
    rng = random.Random(6)
    patterns, owners, texts = [], [], []
    for n in range(60):
        patterns.append("".join(rng.choice("abc é" if n % 2 else "abc ") for _ in range(rng.randrange(1, 200))))
        for _ in range(5):
            copy = "".join(c for c in patterns[-1] if rng.random() > 0.1)
            texts.append("".join(rng.choice("abcñ " if n % 2 else "abc ") for _ in range(30)) + copy + "zz")
            owners.append(n)
    sieve = d.Sieve(patterns)
    least = sieve._least(np.array(owners), texts)
    for owner, text, got in zip(owners, texts, least):
        assert got <= plain_distance(patterns[owner], text)
        if (patterns[owner] + text).isascii():
            assert got == plain_distance(patterns[owner], text)


def test_query_equals_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    items = spark.read.parquet(f"{tables}/benchmark.parquet").collect()
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in queries.op1_decontamination(spark, tables).collect()}
    texts = {r["doc_id"]: d.normalised(r["text"]) for r in docs}
    wanted = {r["item_id"]: d.normalised(r["text"]) for r in items}
    exact = {(i, j) for i, t in texts.items() for j, w in wanted.items() if w in t}
    assert exact and exact <= set(found)
    for (doc, item), distance in found.items():
        assert distance == plain_distance(wanted[item], texts[doc])
        assert distance <= 0.2 * len(wanted[item])
    for i, t in list(texts.items())[:40]:
        for j, w in wanted.items():
            if (hit := d.edit_end(w, t, int(0.2 * len(w)))) is not None:
                assert found[i, j] == hit[0]


def test_edited_copies_reach_the_target_recall(spark, tables):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    docs = [r["text"] for r in spark.read.parquet(f"{tables}/documents.parquet").limit(60).collect()]
    rng = random.Random(9)
    made, expected = [], []
    for n in range(300):
        item, text = items[n % len(items)]
        copy = []
        for letter in text:
            kind = rng.random()
            copy.append(letter if kind > 0.08 else rng.choice(["", "e", letter + "t"]))
        host = docs[n % len(docs)]
        cut = host.find(" ", len(host) // 2) + 1
        made.append(d.normalised(host[:cut] + "".join(copy) + " " + host[cut:]))
        expected.append((n, item))
    hits = {(row, item) for row, item, *_ in d.search(made, d.prepared(items, 0.1, 0.99), 0.2)}
    assert len(hits & set(expected)) >= 0.97 * len(expected)


def test_changed_words_case_and_places(documents, spark):
    item = "the capital of the northern province lies on a wide river between two old hills"
    near = item.replace("northern", "southern").replace("two old", "two very old")
    rows = [
        (1, "Before it. " + item.upper() + " And after."),
        (2, near),
        (3, item.replace(" ", "\n  ")),
        (4, "the capital of another province lies elsewhere"),
        (5, item[: len(item) // 2]),
    ] + [(10 + i, t) for i, t in enumerate(ODD)]
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (7, item)], "item_id long, text string")
    found = d.contaminated(documents(rows, extra="item_id uid"), bench).collect()
    assert sorted({(r["id"], r["item_id"]) for r in found}) == [(1, 7), (2, 7), (3, 7)]
    first = next(r for r in found if r["id"] == 1)
    assert (first["start"], first["stop"]) == (11, 11 + len(item))


def test_other_scripts_and_short_items(documents, spark):
    rows = [(1, "前言。这是一个没有空格的很长的测试题目，用来检查窗口。后记"), (2, "a bc d"), (3, "zz")]
    bench = spark.createDataFrame(
        [(1, "这是一个没有空格的很长的测试题目，用来检查窗口"), (2, "bc")], "item_id long, text string"
    )
    found = d.contaminated(documents(rows), bench).collect()
    assert sorted((r["id"], r["item_id"]) for r in found) == [(1, 1), (2, 2)]


def test_clean_drops_rows_and_keeps_columns(documents, spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = documents([(1, item), (1, "other words"), (None, item), (2, None)], extra="uid gone")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = d.clean(docs, d.contaminated(docs, bench))
    assert left.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == [(1, "other words"), (2, None)]


def test_empty_tables(documents, spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(documents([(1, "a")]), bench).collect() == []
    assert d.contaminated(documents([]), bench).collect() == []


def test_words_that_begin_alike_walk_their_first_steps_as_one():
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "the", "é🙂", "alphabet", "of"]
    text = " ".join(rng.choice(words, 3000)).encode() + bytes(60)
    octets = np.frombuffer(text, np.uint8)
    starts = d.window_starts(octets)
    heads = d.heads_of(octets, starts)
    assert len(heads[0]) < len(starts) / 4
    items = np.frombuffer(" ".join(words).encode() + bytes(60), np.uint8)
    for steps in d.STEPS:
        walk = d.Walk.draw(rng, steps)
        filters = walk.prefixes(items, d.window_starts(items))
        for bits in (None, filters):
            plain, as_one = walk.hashes(octets, starts, bits), walk.hashes(octets, starts, bits, heads)
            assert all(np.array_equal(x, y) for x, y in zip(plain, as_one))


def test_most_pairs_are_out_before_whole_patterns_are_compared(monkeypatch):
    rng = np.random.default_rng(4)
    letters = np.array([*"abcdefgh é🙂"])
    patterns = ["".join(rng.choice(letters, n)) for n in (1, 63, 64, 65, 128, 200, 330)]
    owners = np.repeat(np.arange(len(patterns)), 40)
    texts = ["".join(rng.choice(letters, rng.integers(0, 500))) for _ in owners]
    for i in range(0, len(texts), 4):  # some hold a copy
        own = patterns[owners[i]]
        texts[i] += d.edited(own, rng.integers(0, len(own) // 4 + 1), letters, rng) + texts[i][:30]
    most = np.array([len(patterns[o]) // 5 for o in owners])
    sieve = d.Sieve(patterns)
    right = sieve._least(owners, texts) <= most
    whole, least = [], sieve._least
    monkeypatch.setattr(sieve, "_least", lambda o, t: whole.append(len(o)) or least(o, t))
    assert np.array_equal(sieve.passes(owners, texts, most), right)
    assert right.sum() <= sum(whole) < 1.2 * right.sum() < len(owners) / 2
    assert not len(sieve.passes(owners[:0], [], most[:0]))
    assert sieve.passes(owners[:1], [""], np.array([1])).tolist() == [True]
