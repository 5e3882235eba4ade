"""Text helpers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(text: Column, delimiter: str) -> Column:
    """Non-empty parts between delimiters."""
    return F.filter(F.split(text, re.escape(delimiter)), lambda x: x != "")


def has_suffix(text: Column, suffix: str, ignore_case: bool = True) -> Column:
    return F.endswith(F.lower(text), F.lit(suffix.lower())) if ignore_case else F.endswith(text, F.lit(suffix))


def as_int(text: Column) -> Column:
    """A whole number if the text is nothing else, else null."""
    return F.when(F.trim(text).rlike(r"^[+-]?[0-9]+$"), F.try_to_number(F.regexp_replace(F.trim(text), r"^\+", ""), F.lit("S9999999999")).cast("long"))


def escaped(text: Column) -> Column:
    """Percent-encoded as in an address; a space becomes %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def unescaped(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
