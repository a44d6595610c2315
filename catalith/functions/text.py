"""Text, rational and format functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def display(kind: str, number: str, text: str, digits: int) -> Column:
    """A value as text: texts as they are, finite numbers with fixed digits, others as 0."""
    n = F.col(number)
    finite = n.isNotNull() & ~F.isnan(n) & (F.abs(n) != F.lit(float("inf")))
    return F.when(F.col(kind) == "text", F.col(text)).when(finite, F.format_string(f"%.{digits}f", n)).otherwise(F.lit("0"))


def ratio_text(num: Column, den: Column) -> Column:
    return F.concat(num.cast("string"), F.lit("/"), den.cast("string"))


#: Steps of the Euclidean algorithm that any two 64-bit numbers need at most.
EUCLID_STEPS = 92


def reduced(num: Column, den: Column) -> Column:
    """struct(num, den) divided by their greatest common divisor, by a fold of Euclid's steps; 0 reduces to 0/1.

    Null where a part is null or both are 0; signs stay with their parts.
    """
    pair = lambda x, y: F.struct(x.cast("long").alias("a"), y.cast("long").alias("b"))
    step = lambda p, _: F.when(p["b"] == 0, p).otherwise(pair(p["b"], p["a"] % F.nullif(p["b"], F.lit(0).cast("long"))))
    g = F.nullif(F.aggregate(F.sequence(F.lit(1), F.lit(EUCLID_STEPS)), pair(F.abs(num), F.abs(den)), step, lambda p: p["a"]), F.lit(0).cast("long"))
    # integer division: no detour by doubles
    return F.struct(F.call_function("div", num, g).alias("num"), F.call_function("div", den, g).alias("den"))


def text_format(c: Column | str) -> Column:
    """Format of a text by its first characters."""
    t = F.ltrim(_col(c))
    low = F.lower(F.substring(t, 1, 9))
    return (
        F.when((low == "<!doctype") | (F.substring(low, 1, 5) == "<html"), "html").when(F.substring(t, 1, 5) == "<?xml", "xml")
        .when(F.substring(t, 1, 1).isin("{", "["), "json").otherwise("unsupported")
    )


def ascii_lower(c: Column | str) -> Column:
    return F.translate(_col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_ascii(c: Column | str, term: str) -> Column:
    """ASCII case-insensitive substring test."""
    return F.contains(ascii_lower(c), F.lit(term))


def normalised_name(c: Column | str) -> Column:
    """Words of a name: acronyms and camel case split, everything but ASCII letters and digits a blank, lower case."""
    t = F.regexp_replace(_col(c), r"([A-Z])([A-Z][a-z])", "$1 $2")
    t = F.regexp_replace(t, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(t, r"[^A-Za-z0-9]+", " ")))
