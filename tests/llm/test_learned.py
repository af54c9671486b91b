"""The learned operators: counts against plain versions, held-out accuracy, odd input."""

import collections
import math
import re
import tracemalloc
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tableloom.llm import quality_neighbours, quality_rules, queries, suffix_tree, toxicity, url_rules

from .conftest import ODD

WORD = r"[^\x20\x09-\x0D]+"
LARGER = "/root/testdata/sf0.01"


def held(i, folds):
    return zlib.crc32(str(i).encode()) % folds == 0


def labels_of(spark, folder):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}


# Quality rules


def plain_statistics(text):
    words = re.findall(WORD, text or "")
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    repeated = {
        i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)
    }
    seen, duplicates = set(), 0
    for line in (text or "").split("\n"):
        if re.search(WORD, line):
            duplicates += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, duplicates, len(repeated)


def test_rules_query(spark, tables):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    rows = queries.op3_quality_rules(spark, tables).collect()
    assert len(rows) == len(texts)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in rows:
        own = plain_statistics(texts[r["doc_id"]])
        assert tuple(r[n] for n in names) == own
        assert r["base_failed"] == (own[0] < 50 or 100 * own[4] > 50 * own[0])
        assert not (r["base_failed"] and r["kept"])
        assert r["kept"] == (not r["base_failed"] and r["rule"] is None)


def test_rules_find_low_rows_and_keep_good_ones(spark):
    labels = labels_of(spark, LARGER)
    rows = [r for r in queries.op3_quality_rules(spark, LARGER).collect() if r["doc_id"] in labels]
    judged = [(r["kept"], labels[r["doc_id"]]["quality"]) for r in rows if not r["base_failed"]]
    low = [kept for kept, quality in judged if quality == 0]
    good = [kept for kept, quality in judged if quality == 1]
    assert sum(low) <= 0.1 * len(low)
    assert sum(good) >= 0.98 * len(good)


def test_learning_covers_a_planted_concept():
    rng = np.random.default_rng(0)
    values = {"x": rng.random(3000), "y": rng.random(3000), "z": rng.random(3000)}
    low = (values["x"] > 0.7) & (values["y"] <= 0.4)
    rules = quality_rules.learn(values, low, cuts=64)
    found = np.zeros(3000, bool)
    for rule in rules:
        found |= quality_rules.covered(rule, values, 3000)
    assert (found & low).sum() >= 0.9 * low.sum()
    assert (found & ~low).sum() <= 0.1 * found.sum()
    assert quality_rules.learn(values, rng.random(3000) < 0.3) == []  # nothing to learn


def test_rules_take_odd_rows(documents, label_table):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "word"), (None, "word")]
    labels = label_table([(3, 0, 0), (3, 1, 0), (None, 0, 0), (4, None, None)])
    found = quality_rules.judge(documents(rows, extra="n_words rule"), labels).collect()
    assert len(found) == len(rows)
    empty = quality_rules.judge(documents([]), label_table([]))
    assert empty.collect() == [] and "kept" in empty.columns


# Toxicity and quality by neighbours


@pytest.mark.parametrize(
    "query, column, least, share",
    [(queries.op5_toxicity, "toxic", 0.5, 0.92), (queries.op8_quality_neighbours, "quality", 0.3, 0.95)],
)
def test_scores_hold_out(spark, query, column, least, share):
    labels = labels_of(spark, LARGER)
    rows = query(spark, LARGER).collect()
    assert len(rows) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    right = total = 0
    for r in rows:
        assert r["held_out"] == held(r["doc_id"], 5)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= least)
        if r["held_out"] and r["doc_id"] in labels:
            total += 1
            right += r["predicted"] == labels[r["doc_id"]][column]
    assert right >= share * total


def test_scores_do_not_use_held_out_labels(spark, documents, label_table):
    texts = [f"plain words number {i} stand here" + (" dreadful slur" if i % 3 == 0 else "") for i in range(120)]
    docs = documents(list(enumerate(texts)))
    rows = [(i, 1, int(i % 3 == 0)) for i in range(120)]
    turned = [(i, q, 1 - t if held(i, 5) else t) for i, q, t in rows]
    one = toxicity.score_texts(docs, label_table(rows)).orderBy("id").collect()
    two = toxicity.score_texts(docs, label_table(turned)).orderBy("id").collect()
    assert one == two
    assert all((r["score"] >= 0.5) == (r["id"] % 3 == 0) for r in one)


def test_toxic_rows_go_and_columns_stay(documents, label_table):
    texts = [f"plain words number {i} stand here" + (" dreadful slur" if i % 3 == 0 else "") for i in range(60)]
    docs = documents(list(enumerate(texts)) + [(None, None), (99, "")], extra="score")
    labels = label_table([(i, 1, int(i % 3 == 0)) for i in range(60)])
    left = toxicity.without_toxic(docs, labels)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.where("doc_id < 60").collect()) == [i for i in range(60) if i % 3]
    assert left.where("doc_id IS NULL OR doc_id = 99").count() == 2


def test_label_model_learns_rates_and_distrusts_echoes_without_labels():
    rng = np.random.default_rng(5)
    truth = rng.random(40000) < 0.1
    alone = [np.where(truth, rng.random(40000) < 0.6, rng.random(40000) < 0.03) for _ in range(7)]
    echo = np.where(rng.random(40000) < 0.95, alone[0], alone[1])
    votes = np.stack([*alone, echo], axis=1)
    patterns = (votes << np.arange(8)).sum(axis=1)
    found, times = np.unique(patterns, return_counts=True)
    posterior, rates, trust = toxicity.label_model(toxicity.bits(found, 8), times.astype(float))
    assert np.abs(rates[1, :7] - 0.6).max() < 0.08 and np.abs(rates[0, :7] - 0.03).max() < 0.02
    assert trust[0] < 0.7 and trust[7] < 0.7 and trust[2:7].min() > 0.8
    likely = posterior[np.searchsorted(found, patterns)]
    assert ((likely > 0.5) == truth).mean() > 0.97


def plain_posterior(votes):
    """Expectation maximisation with a row per text, in loops over voters."""
    m = votes.shape[1]
    p = 1 / (1 + np.exp(-4 * (votes.sum(axis=1) - max(1.5, m / toxicity.LEAN))))
    for _ in range(100):
        rates, corr = [], np.zeros((m, m))
        for share in (1 - p, p):
            r = [(share @ votes[:, j] + 0.5) / (share.sum() + 1) for j in range(m)]
            for j in range(m):
                for k in range(m):
                    if j != k:
                        both = (share * (votes[:, j] - r[j]) * (votes[:, k] - r[k])).sum()
                        spread = (r[j] * (1 - r[j]) * r[k] * (1 - r[k])) ** 0.5
                        corr[j, k] = max(corr[j, k], both / max(1.0, share.sum()) / spread)
            rates.append(r)
        odds = np.full(len(p), np.log((p.sum() + 1) / ((1 - p).sum() + 1)))
        for j in range(m):
            trust = 1 / (1 + sum(max(0.0, corr[j, k] - 3 / len(p) ** 0.5) for k in range(m) if k != j))
            no, yes = rates[0][j], rates[1][j]
            odds += trust * np.where(votes[:, j], np.log(yes / no), np.log((1 - yes) / (1 - no)))
        after = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        moved, p = np.abs(after - p).max(), after
        if moved < 1e-6:
            break
    return p


def test_toxicity_equals_a_plain_version(spark):
    tables = LARGER
    labels = {i: r["toxic"] for i, r in labels_of(spark, tables).items() if r["toxic"] is not None}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    known = [i for i in texts if i in labels and not held(i, 5)]
    yes = sum(labels[i] for i in known)
    hits = collections.Counter(t for i in known for t in toxicity.terms(texts[i])[0] if labels[i])
    misses = collections.Counter(t for i in known for t in toxicity.terms(texts[i])[0] if not labels[i])
    ranked = []
    for term, n in hits.items():
        a, b = n + 0.5, misses[term] + 0.5
        odds = math.log(a / (yes + 1 - a)) - math.log(b / (len(known) - yes + 1 - b))
        low = round(odds - (1 / a + 1 / b) ** 0.5, 9)
        if n >= toxicity.LEAST_TEXTS and low >= toxicity.CLEAR:
            ranked.append((-low, term))
    words = [t for _, t in sorted(ranked)[: toxicity.LEXICON]]
    assert words
    starts = [t for t in words if t[:2] in ("5~", "6~", "7~")]
    lists = []
    for kind in ([t for t in words if t not in starts], starts):
        lists += [set(kind[j :: toxicity.VOTERS]) for j in range(toxicity.VOTERS) if kind[j:]]
    seen, votes = {}, {}
    for i, text in texts.items():
        has, ways = toxicity.terms(text)
        seen[i] = [float(t in has) for t in words]
        votes[i] = [float(bool(has & part)) for part in lists] + [float(w > 0.5) for w in ways]
    soft = dict(zip(votes, plain_posterior(np.array(list(votes.values())))))
    weights, bias = toxicity.linear(
        np.array([seen[i] + votes[i] for i in known]), np.array([soft[i] for i in known])
    )
    rows = queries.op5_toxicity(spark, tables).collect()
    assert len(rows) == len(texts)
    for r in rows:
        total = bias + np.dot(weights, seen[r["doc_id"]] + votes[r["doc_id"]])
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-np.clip(total, -30, 30))), abs=1e-6)


def test_hidden_labels_change_no_posterior(documents, label_table):
    texts = [f"plain words number {i} stand here" + (" dreadful slur" if i % 3 == 0 else "") for i in range(300)]
    docs = documents(list(enumerate(texts)))
    few = [(i, 1, int(i % 3 == 0)) for i in range(60)]
    rows = toxicity.score_texts(docs, label_table(few)).collect()
    assert all((r["score"] >= 0.5) == (r["id"] % 3 == 0) for r in rows)


@pytest.mark.parametrize("module", [toxicity, quality_neighbours])
def test_scores_take_odd_rows(documents, label_table, module):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "word"), (None, "word")]
    docs = documents(rows, extra="score id label")
    for labels in ([], [(3, 1, 0)], [(3, 0, 1), (4, 1, 0), (None, 1, 1), (5, None, None), (6, 1, 0), (0, 0, 1)]):
        found = module.score_texts(docs, label_table(labels)).collect()
        assert len(found) == len(rows)
        assert all(0 <= r["score"] <= 1 for r in found)
    assert module.score_texts(documents([]), label_table([(1, 1, 1)])).collect() == []


def test_neighbours_equal_a_plain_search():
    rng = np.random.default_rng(2)
    counted = [
        {int(p): int(n) for p, n in zip(rng.choice(3000, 30, replace=False), rng.integers(1, 5, 30))}
        for _ in range(80)
    ]
    low = rng.random(80) < 0.3
    space = quality_neighbours.fit(counted, low, axes=16)
    got = space.scores(counted[:20])
    vectors = space.place(counted).astype(float)
    for i in range(20):
        near = sorted(((float(vectors[i] @ v), j) for j, v in enumerate(vectors)), reverse=True)
        near = near[: quality_neighbours.NEIGHBOURS]
        votes = [(max(s, 0) ** 4, low[j]) for s, j in near]
        bad = space.balance * sum(v for v, is_low in votes if is_low)
        good = sum(v for v, is_low in votes if not is_low)
        assert got[i] == pytest.approx(good / (good + bad), abs=1e-3)


# URL rules


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def plain_rule(host, path, rules):
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def plain_tokens(host, path):
    path = path.translate({c: c + 32 for c in range(65, 91)})
    return {f"host={x}" for x in host.split(".") if x} | {f"path={x}" for x in path.split("/") if x}


def test_url_query_equals_brute_force(spark, tables):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{tables}/pages.parquet").collect()}
    rows = queries.op6_url_rules(spark, tables).collect()
    assert len(rows) == len(urls)
    split = {i: plain_url(u) for i, u in urls.items()}
    given = {i: plain_rule(*s, queries.URL_RULES) for i, s in split.items()}
    baskets = [(plain_tokens(*split[i]), r[0] == "block") for i, r in given.items() if r]
    counts, blocks = collections.Counter(), collections.Counter()
    from itertools import combinations

    for items, block in baskets:
        for size in range(2, len(items) + 1):
            for part in combinations(sorted(items), size):
                counts[part] += 1
                blocks[part] += block
    least = math.ceil(0.005 * len(baskets))
    mined = {p for p, n in blocks.items() if n >= least and n >= 0.95 * counts[p]}
    for r in rows:
        host, path = split[r["page_id"]]
        rule = given[r["page_id"]]
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (rule[1] + rule[2] if rule else None)
        own = plain_tokens(host, path)
        block = rule[0] == "block" if rule else any(set(p) <= own for p in mined)
        assert r["verdict"] == ("block" if block else "allow"), r


def test_urls_of_all_kinds(spark):
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "ftp://a.net/es/", "://net/fr/q",
            "x://com?a", "x://com#/b", "http://com/\n/en", "a://b://c/d", "http://notnet/es/x", "http://net/ES/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for r in url_rules.judge(pages, queries.URL_RULES).collect():
        host, path = plain_url(urls[r["id"]])
        rule = plain_rule(host, path, queries.URL_RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule[1] + rule[2] if rule else None)
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(empty, queries.URL_RULES).collect() == []


def test_repeated_urls_and_clashing_names(spark):
    urls = ["http://net/es/a", "http://x.org/p/q", "http://x.org/p/q", None, None] * 3
    pages = spark.createDataFrame([(i % 5, u, "h", "p", "t") for i, u in enumerate(urls)],
                                  "page_id long, url string, host string, tokens string, mined string")
    rows = [tuple(r) for r in url_rules.judge(pages, queries.URL_RULES).collect()]
    assert len(rows) == 15 and len(set(rows)) == 5
    assert all(rows.count(r) == 3 for r in rows)


def test_url_plan_has_no_python(spark, tables):
    plan = queries.op6_url_rules(spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Language model


def test_scores_of_the_suffix_tree(spark, tables):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    counts = collections.Counter()
    for i, text in texts.items():
        if not held(i, 10):
            counts.update([*text.encode().lower().split(), b""])
    size, kinds = sum(counts.values()), len(counts)
    rows = queries.op9_suffix_tree(spark, tables).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = [*texts[r["doc_id"]].encode().lower().split(), b""]
        base = sum(math.log10((counts[w] + 0.1) / (size + 0.1 * (kinds + 1))) for w in words)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert (r["n_tokens"], r["train_tokens"]) == (len(words), size)
        assert r["n_known"] == sum(counts[w] > 0 for w in words)
        assert r["held_out"] == held(r["doc_id"], 10)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


class PlainTree:
    """The suffix tree by dictionaries of words."""

    def __init__(self, texts, depth, least_context, least_next, divergence):
        self.depth, self.kept = depth, {}
        seqs = collections.Counter(
            tuple(t[i : i + n]) for t in texts for n in range(1, depth + 2) for i in range(len(t) - n + 1)
        )
        self.words = {s[0]: n for s, n in seqs.items() if len(s) == 1}
        self.size = sum(self.words.values())
        after = collections.defaultdict(dict)
        for seq, n in seqs.items():
            if len(seq) > 1 and n >= least_next and seqs[seq[:-1]] >= least_context:
                after[seq[:-1]][seq[-1]] = n
        for context in sorted(after, key=len):
            own = {w: (n - 0.5) / seqs[context] for w, n in after[context].items()}
            usual = {w: self.chance(context[1:], w) for w in own}
            rest, usual_rest = 1 - sum(own.values()), 1 - sum(usual.values())
            if min(rest, usual_rest) <= 1e-9:
                continue
            told = sum(p * math.log(p / usual[w]) for w, p in own.items())
            if told + rest * math.log(rest / usual_rest) >= divergence:
                self.kept[context] = own, rest / usual_rest

    def chance(self, context, word):
        if not context:
            return (self.words.get(word, 0) + 0.1) / (self.size + 0.1 * (len(self.words) + 1))
        if context not in self.kept:
            return self.chance(context[1:], word)
        own, factor = self.kept[context]
        return own[word] if word in own else factor * self.chance(context[1:], word)

    def score(self, text):
        places = range(len(text))
        return sum(math.log10(self.chance(tuple(text[max(0, i - self.depth) : i]), text[i])) for i in places)


def chain_texts(count):
    rng = np.random.default_rng(7)
    words = ["a", "b", "c", "d", "e"]
    texts = []
    for n in range(count):
        text = ["a"]
        while len(text) < 30:
            last = words.index(text[-1])
            twice = len(text) > 1 and text[-2] == "b"
            text.append(words[(last + 1 + twice) % 5] if rng.random() < 0.8 else words[rng.integers(5)])
        texts.append(" ".join([*text, f"rare{n % 40}", "Seldom", "é"]))
    return texts


def test_suffix_tree_equals_plain_version(documents):
    texts = chain_texts(300)
    docs = documents(list(enumerate(texts)))
    tokens = {i: [*t.encode().lower().decode().split(), ""] for i, t in enumerate(texts)}
    bounds = {"depth": 3, "least_context": 20, "least_next": 5, "divergence": 0.01}
    plain = PlainTree([t for i, t in tokens.items() if not held(i, 10)], **bounds)
    assert {len(c) for c in plain.kept} == {1, 2, 3}
    for context in [(), ("a",), ("b", "c"), ("a", "b", "d"), ("seldom",), ("unheard",)]:
        total = sum(plain.chance(context, w) for w in [*plain.words, "unheard"])
        assert total == pytest.approx(1, abs=1e-6)
    for row in suffix_tree.score_texts(docs, **bounds).collect():
        assert row["score"] == pytest.approx(plain.score(tokens[row["id"]]), rel=1e-9)
        assert row["score"] > 1.5 * row["base_score"]


@pytest.mark.parametrize("bits", [1 << 27, 64])
def test_suffix_tree_may_be_too_large_to_be_sent(documents, monkeypatch, bits):
    docs = documents(list(enumerate(chain_texts(100))))
    one = suffix_tree.score_texts(docs, least_context=20, least_next=5).orderBy("id").collect()
    monkeypatch.setattr(suffix_tree, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(suffix_tree, "MOST_BITS", bits)
    monkeypatch.setattr(suffix_tree, "BLOCK_TOKENS", 500)
    two = suffix_tree.score_texts(docs, least_context=20, least_next=5).orderBy("id").collect()
    assert [r["score"] for r in one] == pytest.approx([r["score"] for r in two], rel=1e-9)


def test_suffix_tree_grows_with_the_corpus(documents):
    sizes = []
    for count in (60, 120, 240):
        blocks = suffix_tree.tokenised(documents(list(enumerate(chain_texts(count)))), "doc_id", "text", 10)
        words = suffix_tree.corpus_words(blocks)
        tree, _, _ = suffix_tree.grow(
            blocks, words, depth=3, least_context=20, least_next=5, divergence=0.01
        )
        sizes.append(tree.count())
    assert sizes[0] < sizes[1] < sizes[2]


def test_blocks_do_not_change_scores(spark, tables, monkeypatch):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    one = suffix_tree.score_texts(docs).orderBy("id").collect()
    monkeypatch.setattr(suffix_tree, "BLOCK_TOKENS", 3000)
    two = suffix_tree.score_texts(docs.repartition(3)).orderBy("id").collect()
    for a, b in zip(one, two, strict=True):
        assert a["n_known"] == b["n_known"]
        assert a["score"] == pytest.approx(b["score"], rel=1e-9)


def test_a_block_takes_little_more_than_its_answers(documents, monkeypatch):
    """What is made for each token of a block is not in memory, nor sent, for all of them at once."""
    docs = documents([(n, "a b c a b") for n in range(20)])
    run, real = [], type(docs).mapInArrow
    monkeypatch.setattr(
        type(docs), "mapInArrow", lambda df, f, *more: run.append(f) or real(df, f, *more)
    )
    blocks = suffix_tree.tokenised(docs, "doc_id", "text", 10)
    every = suffix_tree.Filter(10, np.full(16, (1 << 64) - 1, np.uint64))
    suffix_tree.count_longer(blocks, 2, every, every, 1)
    count = run[-1]
    sent = types.SimpleNamespace(value=(every, None))
    suffix_tree.answers(blocks, blocks.selectExpr("block AS key", "0D AS value"), sent, 3)
    ask = run[-1]

    rng = np.random.default_rng(3)
    hashes = rng.integers(-(2**63), 2**63 - 1, 300)
    tokens = np.minimum(rng.zipf(1.5, 1 << 20), 300).astype(np.int32) - 1
    columns = {"hashes": hashes, "held": [False, True] * 1024, "sizes": [512] * 2048, "tokens": tokens}
    columns = {c: pa.array([v]) for c, v in columns.items()}
    expected = collections.Counter()
    for n, text in enumerate(tokens.reshape(2048, 512).tolist()):
        if n % 2 == 0:
            expected.update(zip(text, text[1:], text[2:]))
    triples = [[hashes[list(w)] for w in zip(*expected)][i] for i in range(3)]
    for func, batch in (
        (count, pa.RecordBatch.from_pydict(columns)),
        (ask, pa.RecordBatch.from_pydict({"block": [7]} | columns).drop_columns(["held"])),
    ):
        tracemalloc.start()
        sizes = [b.num_rows for b in func(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert max(sizes) <= 1 << 16
        assert peak < 32 * len(tokens)

    found = pa.Table.from_batches(count(iter([pa.RecordBatch.from_pydict(columns)])))
    first, middle, last = triples
    keys = suffix_tree.joined(first, middle), suffix_tree.joined(middle, last)
    assert dict(zip(zip(*(k.tolist() for k in keys)), expected.values())) == {
        (r["context"], r["suffix"]): r["n"] for r in found.to_pylist()
    }


def test_suffix_tree_takes_odd_rows(documents):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "word"), (3, "word"), (None, "word")]
    found = suffix_tree.score_texts(documents(rows, extra="tokens block held")).collect()
    assert len(found) == len(rows)
    assert all(r["score"] < 0 for r in found)
    assert [r["n_tokens"] for r in found if r["id"] == 0] == [1]
    assert suffix_tree.score_texts(documents([])).collect() == []
