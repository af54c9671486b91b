"""Finding and sanitising personal data, with DataFrame operations only.

Entities are found by pattern. A term near an entity can give it away as well: what the corpus
says about that is the information that the term carries about the entity. With p(e) the
share of all terms that stand near entity e, and p(e | t) that share among the occurrences of
term t, the pointwise mutual information is log(p(e | t) / p(e)), and the entity itself holds
-log p(e). Their quotient, the disclosure, is 0 for a term independent of the entity and
1 for one that stands nowhere else. Terms that disclose some entity to ``remove_at`` are removed
wherever they occur, those from ``generalise_at`` on give way to their kind. A pair must have
been seen in ``least_documents`` documents to count.

Terms are counted over all documents, those near an entity by the ``reach`` letter runs before
and after it, up to the next entity of its kind. Rows are pre-aggregated before each shuffle.
Where a match stands follows from the lengths of matches and of the texts between them, added
up in blocks, so long texts cost no more than their length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.llm.common import free_name, sent_if_small, written

# The patterns of the kinds. Where a run could only match from its first
# character, a look behind keeps the search from trying the others; what a loop has taken it
# need not give back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
TERM = r"\p{L}++"
RELATED = "term"  # the kind of what gives an entity away
STEP = 128  # lengths added up at a time


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(lengths: Column) -> Column:
    """The sum of the numbers before each one; every block of ``STEP`` is added up once."""

    def before(blocks: Column) -> Column:
        return F.aggregate(
            blocks,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
            lambda so_far, block: F.struct(
                (so_far["at"] + block).alias("at"),
                F.concat(so_far["all"], F.array(so_far["at"])).alias("all"),
            ),
        )["all"]

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, b: a + b)

    def sums(own: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(own) - 1, F.lit(STEP))
        blocks = F.transform(starts, lambda s: F.slice(own, s + 1, F.lit(STEP)))
        return let(
            blocks,
            lambda parts: let(
                before(F.transform(parts, total)),
                lambda offsets: F.flatten(
                    F.transform(
                        parts,
                        lambda part, k: F.transform(
                            before(part), lambda inside: inside + F.get(offsets, k)
                        ),
                    )
                ),
            ),
        )

    return F.when(F.size(lengths) > 0, let(lengths, sums)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: Column, kind: str) -> Column:
    """The pattern's matches in a text, in order: array of (kind, start, stop, value, left, right, again).

    Places are code points, the stop not included. ``left`` and ``right`` are the texts up to the
    neighbouring matches; ``again`` is whether the match before has the same value.
    """

    def found(values: Column, gaps: Column) -> Column:
        lengths = F.zip_with(
            F.transform(gaps, F.char_length),
            values,
            lambda gap, value: gap + F.coalesce(F.char_length(value), F.lit(0)),
        )
        return let(
            running(lengths),
            lambda ends: F.transform(
                values,
                lambda value, k: let(
                    F.get(ends, k) + F.char_length(F.get(gaps, k)),
                    lambda start: F.struct(
                        F.lit(kind).alias("kind"),
                        start.alias("start"),
                        (start + F.char_length(value)).alias("stop"),
                        value.alias("value"),
                        F.get(gaps, k).alias("left"),
                        F.get(gaps, k + 1).alias("right"),
                        F.coalesce(F.get(values, k - 1) == value, F.lit(False)).alias("again"),
                    ),
                ),
            ),
        )

    return let(
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda values: F.when(
            F.size(values) > 0,
            let(F.split(text, pattern, F.lit(-1)), lambda gaps: found(values, gaps)),
        ),
    )


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def holds(span: Column) -> Column:
    """Whether a match of a kind's pattern is one."""
    value, kind, count = span["value"], span["kind"], F.char_length(digits(span["value"]))

    def at_most_255(part: Column) -> Column:
        number = F.regexp_replace(part, "^0+", "")
        return F.when(F.char_length(number) > 3, F.lit(False)).otherwise(
            F.coalesce(number.try_cast("int"), F.lit(0)) <= 255
        )

    return (
        F.when(kind == "ip", F.forall(F.split(value, r"\."), at_most_255))
        .when(kind == "card", count.between(16, 19) & F.call_function("luhn_check", digits(value)))
        .when(kind == "phone", count.between(8, 15))
        .otherwise(F.lit(True))
    )


def may_have(text: Column, kind: str) -> Column:
    """A quick look: false only for texts without an entity of the kind."""
    if kind == "ip":
        return F.contains(text, F.lit(".")) & text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")
    if kind == "card":
        return text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")
    return F.contains(text, F.lit({"email": "@", "phone": "+"}[kind]))


def entities(text: Column) -> Column:
    """All entities of a text by kind and place, each with the terms' texts at its sides."""
    empty = F.array().cast(
        "array<struct<kind:string,start:int,stop:int,value:string,left:string,right:string,again:boolean>>"
    )
    found = [
        F.coalesce(
            F.when(may_have(text, kind), F.filter(matches(text, F.lit(PATTERNS[kind]), kind), holds)),
            empty,
        )
        for kind in KINDS
    ]
    return F.concat(*found)


def terms(text: Column) -> Column:
    """The letter runs of a text in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def near(span: Column, reach: int) -> Column:
    """The terms near an entity; between two places of one entity each term is taken once."""
    most = F.lit(reach)

    def last(left: Column) -> Column:
        count = F.when(span["again"], F.greatest(F.size(left) - most, F.lit(0)))
        count = F.least(F.coalesce(count, F.size(left)), most)
        return F.slice(left, F.size(left) - count + 1, count)

    return F.concat(
        let(terms(span["left"]), last), let(terms(span["right"]), lambda r: F.slice(r, 1, most))
    )


def entity(span: Column) -> Column:
    """What an entity is told by: its kind and its value without case or separators."""
    plain = F.when(span["kind"].isin("card", "phone"), digits(span["value"]))
    return F.concat(span["kind"], F.lit(":"), F.coalesce(plain, F.lower(span["value"])))


def marked(docs: DataFrame, id_col: str, text_col: str, reach: int) -> DataFrame:
    """(id, uid, spans) of every row, a written table; a span has its entity and ``near`` terms."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    spans = F.transform(
        entities(text),
        lambda s: F.struct(
            s["kind"].alias("kind"),
            s["start"].alias("start"),
            s["stop"].alias("stop"),
            entity(s).alias("entity"),
            near(s, reach).alias("near"),
        ),
    )
    return written(
        docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("uid"), spans.alias("spans")),
        "entities",
    )


def disclosures(docs: DataFrame, found: DataFrame, text_col: str, least_documents: int) -> DataFrame:
    """(term, entity, disclosure) for the pairs seen near each other, a written table."""
    pairs = (
        found.select("id", "uid", F.explode("spans").alias("s"))
        .select("id", "uid", "s.entity", F.explode("s.near").alias("term"))
        .groupBy("entity", "term", "id", "uid")
        .count()
        .groupBy("entity", "term")
        .agg(F.sum("count").alias("both"), F.count("*").alias("documents"))
    )
    pairs = written(pairs, "entity-terms")
    around = pairs.groupBy("entity").agg(F.sum("both").alias("around"))
    counts = docs.select(F.explode(terms(F.col(f"`{text_col}`").cast("string"))).alias("term"))
    counts = written(counts.groupBy("term").agg(F.count("*").alias("times")), "term-counts")
    total = counts.agg(F.sum("times")).first()[0] or 1
    given = F.log(F.least(F.col("both") / F.col("times"), F.lit(1.0)))
    own = F.log(F.least(F.col("around") / F.lit(total), F.lit(1.0)))
    supported = written(pairs.where(F.col("documents") >= least_documents), "supported-pairs")
    return written(
        supported.join(around, "entity")
        .join(counts, "term")
        .select(
            "term", "entity", F.when(own < 0, 1 - given / own).otherwise(F.lit(0.0)).alias("disclosure")
        ),
        "disclosures",
    )


def revealing(pairs: DataFrame, remove_at: float, generalise_at: float) -> DataFrame:
    """(term, action, entity, disclosure): the terms that disclose an entity too well."""
    most = F.max(F.struct("disclosure", "entity")).alias("most")
    known = pairs.where(F.col("disclosure") >= generalise_at).groupBy("term").agg(most)
    action = F.when(F.col("most.disclosure") >= remove_at, "remove").otherwise("generalise")
    return written(
        known.select("term", action.alias("action"), "most.entity", "most.disclosure"), "revealing-terms"
    )


def related(docs: DataFrame, risky: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, uid, related): where each text has revealing terms, a written table without the others."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("uid"), text.alias("text"))
    risky = risky.select("term", "action")
    in_texts = (
        rows.select("id", "uid", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
        .join(sent_if_small(risky, 64), "term")
        .groupBy(F.col("id").alias("own_id"), F.col("uid").alias("own_uid"))
        .agg(F.collect_set(F.struct("term", "action")).alias("risky"))
    )
    in_texts = written(in_texts, "texts-with-terms")
    bytes_of = in_texts.agg(F.max(F.size("risky"))).first()[0] or 0
    same = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("uid") == F.col("own_uid"))
    met = rows.join(sent_if_small(in_texts, 64 * (1 + bytes_of)), same)

    def span(match: Column) -> Column:
        action = F.filter("risky", lambda r: r["term"] == F.lower(match["value"]))
        return F.struct(
            F.lit(RELATED).alias("kind"),
            match["start"].alias("start"),
            match["stop"].alias("stop"),
            F.get(action, F.lit(0))["action"].alias("action"),
        )

    spans = F.filter(
        F.transform(matches(F.col("text"), F.lit(TERM), RELATED), span), lambda s: s["action"].isNotNull()
    )
    return written(met.select("id", "uid", spans.alias("related")).distinct(), "related-spans")


def sanitised(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    reach: int = 8,
    least_documents: int = 3,
    remove_at: float = 0.97,
    generalise_at: float = 0.94,
) -> DataFrame:
    """Each row's id, its ``base`` entities and ``related`` terms, and a way to clean the text.

    ``base`` and ``related`` are arrays of (kind, start, stop, action) in code points, the stop not
    included, base ones by kind (in the order of ``KINDS``) and then by start, related ones by
    start. A term that shares a character with an entity is not given again. ``uid`` is the
    hash of the text; ``cleaned`` makes the sanitised texts of both.

    A NULL text is empty and has no spans; nor has an empty table any rows. Texts of any length are
    searched whole. Rows alike in id and text count as one document in the statistics, and each
    gets its result. Other columns do not matter, whatever their names.
    """
    found = marked(docs, id_col, text_col, reach)
    pairs = disclosures(docs, found, text_col, least_documents)
    risky = revealing(pairs, remove_at, generalise_at)
    terms_in = related(docs, risky, id_col, text_col)
    sides = terms_in.select(F.col("id").alias("own_id"), F.col("uid").alias("own_uid"), "related")
    same = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("uid") == F.col("own_uid"))
    base = F.transform(
        "spans",
        lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"),
            F.lit("replace").alias("action"),
        ),
    )
    apart = F.filter(
        "related",
        lambda t: ~F.exists("spans", lambda s: (s["start"] < t["stop"]) & (t["start"] < s["stop"])),
    )
    none = F.array().cast("array<struct<kind:string,start:int,stop:int,action:string>>")
    joined = found.join(sides, same, "left")
    return joined.select(
        "id", "uid", base.alias("base"), F.coalesce(apart, none).alias("related")
    )


def cleaned(
    docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with its texts sanitised by the ``spans`` of ``sanitised``; NULL texts stay NULL.

    An entity gives way to its kind in brackets, a generalised term to ``[name]`` or ``[word]``
    by its first letter, a removed one to nothing. Of spans that overlap the first one counts,
    the longer one of two with the same start.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    uid, own_id, own_uid, all_spans = (free_name(docs, n) for n in ("uid", "own_id", "own_uid", "spans"))
    spans = spans.select(
        F.col("id").alias(own_id), F.col("uid").alias(own_uid),
        F.concat("base", "related").alias(all_spans),
    ).where(F.size(all_spans) > 0).dropDuplicates([own_id, own_uid])
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(own_id)) & (F.col(uid) == F.col(own_uid))
    joined = docs.withColumn(uid, F.xxhash64(text)).join(spans, same, "left")
    ordered = F.array_sort(
        F.transform(
            all_spans,
            lambda s: F.struct(s["start"].alias("a"), (-s["stop"]).alias("b"), s["kind"].alias("k"), s["action"].alias("c")),
        )
    )
    kind = "struct<start:int,stop:int,kind:string,action:string,after:int>"
    kept = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("all")),
        lambda so_far, s: F.when(
            s["a"] >= so_far["at"],
            F.struct(
                (-s["b"]).alias("at"),
                F.concat(
                    so_far["all"],
                    F.array(
                        F.struct(
                            s["a"].alias("start"), (-s["b"]).alias("stop"), s["k"].alias("kind"),
                            s["c"].alias("action"), so_far["at"].alias("after"),
                        )
                    ),
                ).alias("all"),
            ),
        ).otherwise(so_far),
    )

    def piece(inside: Column, start: Column, stop: Column) -> Column:
        """A part of the text in four bytes per character, found without a search."""
        return F.decode(F.substr(inside, start * 4 + 1, (stop - start) * 4), "UTF-32")

    def put_together(inside: Column) -> Column:
        def part(s: Column) -> Column:
            value = piece(inside, s["start"], s["stop"])
            term = F.when(value.rlike(r"^\p{Lu}"), "[name]").otherwise("[word]")
            label = (
                F.when(s["action"] == "remove", "")
                .when(s["action"] == "generalise", term)
                .otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
            )
            return F.concat(piece(inside, s["after"], s["start"]), label)

        return let(
            kept,
            lambda k: F.concat(
                F.array_join(F.transform(k["all"], part), ""),
                piece(inside, k["at"], (F.octet_length(inside) / 4).cast("int")),
            ),
        )

    new = F.when(F.col(all_spans).isNull(), F.col(f"`{text_col}`")).otherwise(
        let(F.encode(text, "UTF-32"), put_together)
    )
    return joined.select(*(new.alias(c) if c == text_col else joined[f"`{c}`"] for c in docs.columns))


def listing(spans: Column) -> Column:
    """Spans as ``kind:start:stop``, joined by commas."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")),
        ),
        ",",
    )
