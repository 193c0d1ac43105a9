"""The packed binary alignment format as a Spark data source.

A file is: the magic bytes, the number of sequences, the gap mask as 0/1 text, (id, offset) of every entry,
then entries: label, number of symbols, symbols in four bits each. Whole numbers take eight bytes, little end
first, and a text is preceded by its length. The offset table lets each task read a slice of entries.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cladeflow.functions.sites import NUCLEOTIDES

# Fixed value: the first bytes of a file.
MAGIC = b"BFAST\0\0"
SLICE = 5000


def pack(sites: str) -> bytes:
    """Two symbols a byte, the first in the upper half; raises ValueError on unknown symbols."""
    codes = [NUCLEOTIDES.find("T" if c == "U" else c) for c in sites.upper()]
    if min(codes, default=0) < 0:
        raise ValueError("a sequence holds a symbol that has no 4-bit code")
    codes += [0] * (len(codes) % 2)
    return bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))


def unpack(data: bytes, n: int) -> str:
    return "".join(NUCLEOTIDES[b >> 4] + NUCLEOTIDES[b & 15] for b in data)[:n]


def write_packed(rows, path: str, mask: list[bool] | None = None) -> None:
    """Write (label, sites) pairs to one local file, in two passes over the iterable factory ``rows``."""
    sizes = [(len(label.encode()), len(sites)) for label, sites in rows()]
    bits = "".join("1" if m else "0" for m in mask or [False] * (sizes[0][1] if sizes else 0)).encode()
    offset = len(MAGIC) + 8 + 16 * len(sizes) + len(bits) + 8
    with open(path, "wb") as f:
        f.write(MAGIC + struct.pack("<QQ", len(sizes), len(bits)) + bits)
        for i, (label, sites) in enumerate(sizes):
            f.write(struct.pack("<QQ", i, offset))
            offset += 16 + label + (sites + 1) // 2
        for label, sites in rows():
            text = label.encode()
            f.write(struct.pack("<Q", len(text)) + text + struct.pack("<Q", len(sites)) + pack(sites))


def read_header(f) -> tuple[int, str, int]:
    """(number of sequences, mask, place of the offset table) of an open file."""
    if f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a packed alignment")
    count, size = struct.unpack("<QQ", f.read(16))
    mask = f.read(size).decode()
    return count, mask, f.tell()


class Entries(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class PackedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file:")
        self.slice = int(options.get("slice", SLICE))
        self.masked = options.get("masked", "false").lower() == "true"

    def _files(self) -> list[str]:
        if os.path.isdir(self.path):
            return sorted(os.path.join(self.path, x) for x in os.listdir(self.path) if not x.startswith(("_", ".")))
        return [self.path]

    def partitions(self) -> list[Entries]:
        out = []
        for path in self._files():
            with open(path, "rb") as f:
                count = read_header(f)[0]
            out += [Entries(path, a, min(a + self.slice, count)) for a in range(0, count, self.slice)]
        return out or [Entries("", 0, 0)]

    def read(self, partition: Entries) -> Iterator[tuple[int, str, str]]:
        if partition.begin >= partition.end:
            return
        with open(partition.path, "rb") as f:
            _, mask, table = read_header(f)
            f.seek(table + 16 * partition.begin)
            f.seek(struct.unpack("<QQ", f.read(16))[1])
            for i in range(partition.begin, partition.end):
                label = f.read(struct.unpack("<Q", f.read(8))[0]).decode()
                n = struct.unpack("<Q", f.read(8))[0]
                sites = unpack(f.read((n + 1) // 2), n)
                if self.masked:
                    sites = "".join(c for c, m in zip(sites, mask) if m == "0")
                yield i, label, sites


class PackedFasta(DataSource):
    """``spark.read.format("packed_fasta")``: seq_id, label, sites; options ``slice`` and ``masked``."""

    @classmethod
    def name(cls) -> str:
        return "packed_fasta"

    def schema(self) -> str:
        return "seq_id long, label string, sites string"

    def reader(self, schema) -> PackedReader:
        return PackedReader(self.options)
