"""Text expressions: trimming, tokens, sentences, containment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed value: the characters with Unicode's property White_Space.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def tokens(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def sentences(text: Column) -> Column:
    """Pieces that end with . ! or ? before white space."""
    return F.split(text, r"(?<=[.!?])\s+")


def contains(text: Column, keyword: Column, case_sensitive: bool = False) -> Column:
    return F.contains(text, keyword) if case_sensitive else F.contains(F.lower(text), F.lower(keyword))


def from_marker(text: Column, marker: str) -> Column:
    """The text from the marker's first occurrence on; all of it if there is none."""
    at = F.instr(text, marker)
    return F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(text)


def tagged(text: Column, tag: str) -> Column:
    """What stands between <tag> and </tag>, over lines too; empty if there is none."""
    return F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1)


def ordered_join(items: Column, separator: str, empty: str = "") -> Column:
    """Texts of an array of (rank, text) structs in order, joined; `empty` if there are none."""
    texts = F.transform(F.array_sort(items), lambda x: x["text"])
    return F.when(F.size(items) > 0, F.array_join(texts, separator)).otherwise(F.lit(empty))
