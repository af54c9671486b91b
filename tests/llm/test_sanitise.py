"""Personal data and what gives it away, against plain Python."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tableloom.llm import queries, sanitise

from .conftest import DOCS, ODD

# As in the contract.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def is_one(kind, value):
    number = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(number) <= 19 and luhn(number)
    return kind != "phone" or 8 <= len(number) <= 15


def plain_spans(text):
    return [
        (kind, m.start(), m.end(), m.group(0))
        for kind, pattern in PLAIN.items()
        for m in re.finditer(pattern, text or "")
        if is_one(kind, m.group(0))
    ]


def letters(text):
    """The letter runs of a text as (start, stop, lower case)."""
    return [(m.start(), m.end(), m.group(0).lower()) for m in re.finditer(r"[^\W\d_]+", text)]


def plain_near(text, reach):
    """(entity, term) for each term near an entity, once for each of its places."""
    out = []
    for kind, pattern in PLAIN.items():
        found = list(re.finditer(pattern, text))
        edges = [0] + [p for m in found for p in m.span()] + [len(text)]
        for k, m in enumerate(found):
            if not is_one(kind, m.group(0)):
                continue
            left = [t for _, _, t in letters(text[edges[2 * k] : edges[2 * k + 1]])]
            right = [t for _, _, t in letters(text[edges[2 * k + 2] : edges[2 * k + 3]])]
            if k and found[k - 1].group(0) == m.group(0):
                left = left[reach:]
            value = m.group(0).lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", m.group(0))
            out += [(f"{kind}:{value}", t) for t in left[-reach:] + right[:reach]]
    return out


def plain_terms(rows, reach=8, least=3, remove_at=0.97, generalise_at=0.94):
    """{term: action} learned from (id, text) rows."""
    both, seen, around, times = Counter(), Counter(), Counter(), Counter()
    for text in (t or "" for _, t in rows):
        times.update(t for _, _, t in letters(text))
    for doc_id, text in dict.fromkeys(rows):
        for pair in set(pairs := plain_near(text or "", reach)):
            seen[pair] += 1
        copies = sum(r == (doc_id, text) for r in rows)
        for pair in pairs:
            both[pair] += copies
            around[pair[0]] += copies
    total, actions = sum(times.values()), {}
    for (entity, term), n in both.items():
        if seen[entity, term] < least:
            continue
        own = math.log(min(around[entity] / total, 1))
        disclosure = 1 - math.log(min(n / times[term], 1)) / own if own < 0 else 0
        if disclosure >= generalise_at:
            action = "remove" if disclosure >= remove_at else "generalise"
            actions[term] = min(actions.get(term, action), action, key=("remove", "generalise").index)
    return actions


def plain_result(rows, **options):
    actions, out = plain_terms(rows, **options), []
    for doc_id, text in rows:
        base = plain_spans(text)
        more = [
            ("term", a, b) for a, b, t in letters(text or "")
            if t in actions and not any(s < b and a < e for _, s, e, _ in base)
        ]
        listed = [f"{k}:{a}:{b}" for k, a, b, *_ in base]
        every = listed + [f"{k}:{a}:{b}" for k, a, b in more]
        counts = Counter(k for k, *_ in base)
        out.append((doc_id, *(counts[k] for k in PLAIN),
                    hashlib.sha256(",".join(listed).encode()).hexdigest(), ",".join(every)))
    return sorted(out, key=repr)


def results(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_plain_version(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = queries.op13_private_data(spark, tables)
    assert got.columns == [
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans",
    ]
    assert results(got) == plain_result(rows)


TRAPS = [
    "a@b", "a@b.c", "x a.b+c%d_e-f@g-h.i.j. k", "a@b.c@d.e", "a@b.c_d@e.f", "@x.y a@@b.c", "é@b.c é",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256 01.002.0003.255", "12.3.4", "1.2.3.4444444444444444444",
    "4111 1111 1111 1111", "4111-1111-1111-1111-", "41111111111111112", "4111  1111 1111 1111",
    "0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0", "5500005555555559 and 5500005555555559",
    "+1 (361) 555-8283", "+1 5", "+12345678", "+1 (((((((((", "++1 234 567 89 +", "+1.2.3.4.5.6.7.8",
    "🙂🙂 me@home.org 🙂 10.0.0.1 🙂 +49 (30) 1234567 🙂", "a@b.c" * 50, "1.1.1.1 " * 300,
]


def test_base_kinds_on_traps(spark, documents):
    rows = list(enumerate(TRAPS))
    got = sanitise.sanitised(documents(rows)).select("id", sanitise.listing(F.col("base")).alias("l"))
    for r in got.collect():
        assert r["l"] == ",".join(f"{k}:{a}:{b}" for k, a, b, _ in plain_spans(TRAPS[r["id"]])), TRAPS[r["id"]]


def test_long_runs_are_linear(spark, documents):
    rows = [(1, "a" * 300_000), (2, "1" * 300_000), (3, "1 " * 200_000), (4, "a.b@c" + ".d" * 200_000),
            (5, "+1" + " " * 300_000), (6, "9.9.9.9 " * 40_000), (7, "word " * 100_000 + "a@b.c")]
    got = {r["id"]: r["base"] for r in sanitise.sanitised(documents(rows)).collect()}
    assert [len(got[k]) for k in range(1, 8)] == [0, 0, 0, 1, 0, 40_000, 1]
    assert got[6][-1]["start"] == 8 * 39_999 and got[7][0]["start"] == 500_000


def corpus():
    """Texts in which ``Zorblatt`` stands beside one address only, and common words everywhere."""
    rows = [(i, f"the of and {i} in the of to Zorblatt writes me@home.org of the and") for i in range(6)]
    rows += [(10 + i, f"the of and in the of to and nothing of the {i}") for i in range(60)]
    rows += [(100, "only Zorblatt of the hills"), (101, "ZORBLATT, zorblatts and me@home.org"), (102, None)]
    return rows


def test_terms_that_reveal_are_found_everywhere(documents):
    rows = corpus()
    assert plain_terms(rows, reach=2, generalise_at=0.9) == {"zorblatt": "generalise", "writes": "remove"}
    got = sanitise.sanitised(documents(rows), reach=2, generalise_at=0.9)
    texts = dict(rows)
    terms = {r["id"]: [(texts[r["id"]][s["start"] : s["stop"]], s["action"]) for s in r["related"]]
             for r in got.collect() if r["related"]}
    assert terms[100] == [("Zorblatt", "generalise")] and terms[101] == [("ZORBLATT", "generalise")]
    assert terms[0] == [("Zorblatt", "generalise"), ("writes", "remove")]
    assert not any(10 <= k < 70 for k in terms)


def test_cleaned_texts(documents):
    docs = documents(corpus(), "uid spans own_id id base")
    out = sanitise.cleaned(docs, sanitise.sanitised(docs, reach=2, generalise_at=0.9))
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert len(texts) == 69 and texts[102] is None
    assert texts[0] == "the of and 0 in the of to [name]  [email] of the and"
    assert texts[100] == "only [name] of the hills" and texts[15] == dict(corpus())[15]


def test_overlaps_and_other_planes_when_cleaning(documents):
    docs = documents([(1, "🙂 +1.2.3.4.5.6.7.8 🙂 4111111111111111")])
    out = sanitise.cleaned(docs, sanitise.sanitised(docs))
    assert out.first()["text"] == "🙂 [phone] 🙂 [card]"


def test_odd_rows(documents):
    rows = list(enumerate(ODD)) + [(None, "me@home.org"), (3, "word"), (3, "word")]
    got = sanitise.sanitised(documents(rows, "id uid spans near term")).select(
        "id", F.size("base").alias("n"), F.size("related").alias("m")
    )
    assert results(got) == sorted(((i, int("@" in (t or "")), 0) for i, t in rows), key=repr)


def test_empty_table(spark):
    assert sanitise.sanitised(spark.createDataFrame([], DOCS)).count() == 0


def test_no_python_on_the_main_path(spark, tables):
    plan = queries.op13_private_data(spark, tables)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_running_sums(spark, n):
    df = spark.createDataFrame([([7] * n,)], "a array<int>")
    assert df.select(sanitise.running(F.col("a")).alias("r")).first()["r"] == [7 * k for k in range(n)]
