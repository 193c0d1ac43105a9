"""Column functions over aligned sequences (``sites``): all run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: nucleotide symbols, each at the place of its 4-bit code.
NUCLEOTIDES = "-TGKCYSBAWRDMHVN"
HEX = "0123456789ABCDEF"
GAP = "-"


def normalise(sites: Column, protein: bool = False) -> Column:
    """Upper case; U is read as T, and X, O, dots and question marks as gaps (proteins: question marks only)."""
    out = F.upper(sites)
    for symbol in "?" if protein else "UXO.?":  # F.translate looks up every character and takes far longer
        out = F.replace(out, F.lit(symbol), F.lit("T" if symbol == "U" else GAP))
    return out


def is_dna(sites: Column) -> Column:
    """Whether all symbols are upper-case nucleotide codes."""
    return sites.rlike("^[-TGKCYSBAWRDMHVN]+$")


def range_begin(sites: Column) -> Column:
    """Number of leading gaps: where the valid range begins (0-based)."""
    return F.length(sites) - F.length(F.ltrim(sites, F.lit(GAP)))


def range_span(sites: Column) -> Column:
    """Length without leading and trailing gaps; 0 for a sequence of gaps."""
    return F.length(F.trim(sites, F.lit(GAP)))


def encode_hex(sites: Column) -> Column:
    """4-bit codes, two symbols a byte, as hex text; an odd length is filled up with a gap."""
    digits = F.translate(F.upper(sites), NUCLEOTIDES, HEX)
    return F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits)


def encode(sites: Column) -> Column:
    """4-bit codes as binary."""
    return F.unhex(encode_hex(sites))


def decode(packed: Column, length: Column) -> Column:
    """Symbols of a binary value of 4-bit codes."""
    return F.substring(F.translate(F.hex(packed), HEX, NUCLEOTIDES), F.lit(1), length)


def keep_columns(sites: Column, mask: list[bool]) -> Column:
    """The sequence without masked columns, as one concatenation of the runs that stay."""
    runs, start = [], None
    for i, masked in enumerate([*mask, True]):
        if masked and start is not None:
            runs.append(F.substring(sites, start + 1, i - start))
            start = None
        elif not masked and start is None:
            start = i
    return F.concat(*runs) if runs else F.lit("")
