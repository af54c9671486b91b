"""String functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip (and so pandas') removes.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: what lies between two tokens in the classic word count.
TOKEN_BREAK = r"[ \t\n\r\f]+"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def join_text(*parts: Column | str, sep: str) -> Column:
    """Values joined by ``sep``; NULL as soon as one part is NULL."""
    pieces: list[Column] = []
    for part in parts:
        pieces += [F.lit(sep), _column(part)] if pieces else [_column(part)]
    return F.concat(*pieces)


def composite_id(*parts: Column | str) -> Column:
    """An id such as ``state_county_number``; NULL when a part is missing."""
    return join_text(*parts, sep="_")


def _literal_pattern(separator: str) -> str:
    """A pattern for exactly this text; single characters avoid the regex engine."""
    if len(separator) == 1:
        return separator if separator.isalnum() else f"\\{separator}"
    # Letter by letter: quoting as a whole would end at a separator's own end of quote.
    return "".join(map(_literal_pattern, separator))


def split_item(value: Column | str, separator: str, position: int) -> Column:
    """Item ``position`` (from 0) of a string cut at a literal separator, else NULL.

    A string without enough separators gives NULL in ANSI mode too. What follows
    the item is not cut any further, however long the string is.
    """
    cut = F.split(value, _literal_pattern(separator), position + 2)
    return F.get(cut, F.lit(position))


def split_words(value: Column | str) -> Column:
    """A string cut at every single space; repeated and outer spaces give empty words."""
    return F.split(value, " ")


def strip_blanks(value: Column | str) -> Column:
    """Outer white space removed, including line breaks and non-ASCII blanks.

    Trims by character set and not by pattern: a pattern anchored at the end
    retries at every run of blanks inside a long text.
    """
    return F.btrim(value, F.lit(BLANKS))


def tokens(value: Column | str) -> Column:
    """The words of a text as an array: cut at blanks and line breaks, empties dropped."""
    return F.array_remove(F.split(value, TOKEN_BREAK), "")
