"""Text columns: white space, words, hashes, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapsed(c: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def word_count(c: Column) -> Column:
    t = collapsed(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("int")


def content_hash(c: Column) -> Column:
    return F.sha2(F.lower(collapsed(c)), 256)


def folded(c: Column) -> Column:
    """The key under which titles and descriptions count as equal."""
    return F.lower(F.trim(c))


def csv_field(c: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line feed; null as nothing."""
    s = F.coalesce(c, F.lit(""))
    return F.when(s.rlike('[,"\\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def xml_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def contains_fold(c: Column, needle: str) -> Column:
    """Case-insensitive substring test; null holds nothing."""
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle.lower()))


def byte_size(n: Column) -> Column:
    """A number of bytes as people read it, in steps of a thousand: no decimals for KB, one for MB, two above."""
    short = lambda x, digits: F.regexp_replace(F.regexp_replace(F.format_number(x, digits), ",", ""), r"\.?0+$" if digits else "$^", "")
    unit = lambda power, digits, name: F.concat(short(n / 10.0**power, digits), F.lit(name))
    return F.when(n == 0, "Zero KB").when(n == 1, "1 byte").when(n < 1000, F.concat(n.cast("string"), F.lit(" bytes"))).when(n < 999_500, unit(3, 0, " KB")).when(n < 999_950_000, unit(6, 1, " MB")).otherwise(unit(9, 2, " GB"))
