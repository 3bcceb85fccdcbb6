"""Text cells padded by their length in bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _room(text: Column, width: Column) -> Column:
    return F.repeat(F.lit(" "), F.greatest(width - F.octet_length(text), F.lit(0)))


def pad_end(text: Column, width: Column) -> Column:
    """text with blanks after it up to ``width`` bytes; longer text as it is."""
    return F.concat(text, _room(text, width))


def pad_start(text: Column, width: Column) -> Column:
    """text with blanks before it up to ``width`` bytes; longer text as it is."""
    return F.concat(_room(text, width), text)
