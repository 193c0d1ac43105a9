"""Small column functions over strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_all(text: Column, separator: str) -> Column:
    """The parts between separators (plain text), empty ones included."""
    return F.split(text, F.lit("\\Q" + separator + "\\E"), -1)


def joined(parts: Column, separator: str = ", ") -> Column:
    """The parts with a separator between them."""
    return F.array_join(parts, separator)


def fixed(value: Column, places: int = 10) -> Column:
    """A number with that many decimal places."""
    return F.format_string(f"%.{places}f", value)
