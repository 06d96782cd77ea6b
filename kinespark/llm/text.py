"""Column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in order; none for a null. Plain replacement and a split
    at one character need no regular expression."""
    t = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        t = F.replace(t, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(t, " ", -1), "")


def n_words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.size(words(text)).cast("long")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(c, UPPER, LOWER)


def hashed_share(*cols: Column) -> Column:
    """A seeded-by-content number in [0, 2**60), the same in any engine with MD5:
    the first 15 hex digits of the digest of the columns, null as ``~``."""
    key = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")
