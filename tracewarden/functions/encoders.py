"""Encodings used to test how robust detection is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_encode(text: Column) -> Column:
    """Form encoding; ``~`` stays and ``*`` is escaped."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def double_url_encode(text: Column) -> Column:
    return url_encode(url_encode(text))


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def html_entity_encode(text: Column) -> Column:
    """``&#x..;`` for every character."""
    point = lambda c: F.lower(F.ltrim(F.hex(F.encode(c, "UTF-32")), F.lit("0")))
    return F.array_join(F.transform(_characters(text), lambda c: F.concat(F.lit("&#x"), point(c), F.lit(";"))), "")


def hex_encode(text: Column) -> Column:
    """``%`` and the hex digits of the UTF-8 bytes of every character."""
    return F.array_join(
        F.transform(_characters(text), lambda c: F.concat(F.lit("%"), F.lower(F.hex(F.encode(c, "UTF-8"))))), ""
    )


def case_vary(text: Column, key: Column, seed: int = 42) -> Column:
    """Upper or lower case by letter, chosen by the sha1 of id, position and seed."""

    def vary(c: Column, i: Column) -> Column:
        digit = F.substring(F.sha1(F.concat_ws(":", key.cast("string"), i.cast("string"), F.lit(str(seed)))), 1, 1)
        return F.when(F.conv(digit, 16, 10).cast("int") % 2 == 0, F.lower(c)).otherwise(F.upper(c))

    return F.array_join(F.transform(_characters(text), vary), "")


# The choices of the augmentation, in the order they are numbered.
ENCODERS = {
    "url_encode": lambda t, k, s: url_encode(t),
    "double_url_encode": lambda t, k, s: double_url_encode(t),
    "html_entity_encode": lambda t, k, s: html_entity_encode(t),
    "case_vary": case_vary,
    "hex_encode": lambda t, k, s: hex_encode(t),
}
