"""SimHash against a plain version that compares all pairs."""

import re

import numpy as np
import xxhash
from tableloom.llm import queries, simhash

from .conftest import ODD


def plain_fingerprint(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, marks, bits):
    parent = list(range(len(marks)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(marks):
        for j in range(i):
            if bin(a ^ marks[j]).count("1") <= bits:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, own in enumerate(ids):
        if own is not None:
            least[find(i)] = min(own, least.get(find(i), own))
    return [least.get(find(i)) for i in range(len(marks))]


def test_query_equals_brute_force(spark, tables):
    rows = queries.op7_simhash(spark, tables).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    marks = [plain_fingerprint(texts[r["doc_id"]]) for r in rows]
    assert [int(r["fingerprint"], 16) for r in rows] == marks
    ids = [r["doc_id"] for r in rows]
    assert [r["component_id"] for r in rows] == plain_components(ids, marks, 2)
    assert len(rows) == len(texts)


def test_tree_loses_no_pair(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(-(2**63), 2**63, 600)
    marks = np.unique(
        np.concatenate(
            [centres]
            + [centres ^ (np.int64(1) << rng.integers(0, 63, 600)) for _ in range(2)]
            + [(centres[0] ^ (np.int64(1) << np.arange(63)))]
        )
    )
    df = spark.createDataFrame([(int(m),) for m in marks], "fp long")
    tree = simhash.grow(df, len(marks), 2, leaf_rows=64)
    assert len(tree.levels) > 1
    home = tree.home(marks)
    row, leaf = tree.visits(marks)
    met = {(int(h), int(h_row)) for h_row, h in enumerate(home)} | set(
        zip(leaf.tolist(), row.tolist())
    )
    near = np.bitwise_count((marks[:, None] ^ marks[None, :]).view(np.uint64)) <= 2
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        assert (int(home[i]), int(j)) in met or (int(home[j]), int(i)) in met


def test_odd_texts_ties_and_nulls(spark, documents):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "word"), (None, "word"), (None, None)]
    found = simhash.near_duplicates(documents(rows, extra="fp root component uid")).collect()
    assert len(found) == len(rows)
    by_text = {}
    for r in found:
        by_text.setdefault(r["root"], set()).add(r["component"])
    assert all(len(v) == 1 for v in by_text.values())
    blank = [r for r in found if r["fp"] == 0]
    assert {r["component"] for r in blank} == {0} and len(blank) == 4


def test_one_of_each_keeps_the_first_and_all_columns(spark, documents):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(5, long), (2, long), (2, long), (None, long), (9, "quite another text here"), (7, None)]
    docs = documents(rows, extra="uid gone")
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 7, 9]


def test_empty_table(documents):
    assert simhash.near_duplicates(documents([])).collect() == []
    assert simhash.one_of_each(documents([])).collect() == []
