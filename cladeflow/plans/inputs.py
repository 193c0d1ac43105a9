"""Alignments and placements derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.operators.ordering import spread

WIDTH = 64
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "ACGTACGTACGTACGTACGTACGTAC"
HEX = "0123456789abcdef"
PIECE = WIDTH << 14  # bases cut at once
_TO_BASE = bytes.maketrans((LETTERS + LETTERS.lower()).encode(), (BASES * 2).encode())
_OTHERS = bytes(b for b in range(256) if chr(b) not in LETTERS + LETTERS.lower())
CHUNKS = 1 << 25  # ids left for the chunks of one text: as many as a string of 2**31 letters has


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of every whole text as nucleotides, cut into rows of equal width; the last row of a text is
    filled with gaps. (seq_id, doc_id, label, sites)"""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    schema = f"seq_id long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, label string, sites string"
    return docs.where("text IS NOT NULL").mapInArrow(_cut, schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In bytes: only the letters A to Z of both cases stay, and no byte of another UTF-8 character is one of them."""
    for batch in batches:
        pieces: list[tuple[int, int, bytes]] = []  # place of the text in the batch, first chunk, bases
        size = 0
        for k, text in enumerate(batch.column(1).cast(pa.binary())):
            bases = text.as_py().translate(_TO_BASE, _OTHERS)
            for a in range(0, len(bases), PIECE):
                pieces.append((k, a // WIDTH, bases[a : a + PIECE]))
                size += len(pieces[-1][2])
                if size >= PIECE:
                    yield _chunks(batch.column(0), pieces)
                    pieces, size = [], 0
        if pieces:
            yield _chunks(batch.column(0), pieces)


def _chunks(doc_ids: pa.Array, pieces: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    counts = np.array([-(-len(p[2]) // WIDTH) for p in pieces])
    n, ends = int(counts.sum()), np.cumsum(counts)
    chunk = np.arange(n) - np.repeat(ends - counts - np.array([p[1] for p in pieces]), counts)
    own = doc_ids.take(pa.array([p[0] for p in pieces]))
    label = pc.binary_join_element_wise("d", own.cast(pa.string()), "")
    which = pa.array(np.repeat(np.arange(len(pieces)), counts))
    data = b"".join(p[2].ljust(c * WIDTH, b"-") for p, c in zip(pieces, counts.tolist()))
    places = pa.array(np.arange(n + 1, dtype=np.int32) * WIDTH)
    sites = pa.StringArray.from_buffers(n, places.buffers()[1], pa.py_buffer(data))
    doc_id = own.take(which)
    seq_id = pc.add_checked(pc.multiply_checked(doc_id.cast(pa.int64()), CHUNKS), pa.array(chunk))
    return pa.RecordBatch.from_arrays([seq_id, doc_id, label.take(which), sites], ["seq_id", "doc_id", "label", "sites"])


ALN = f"""
bases AS (
  SELECT doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS bases FROM documents
), aln AS (
  SELECT doc_id * {CHUNKS} + chunk AS seq_id, doc_id, 'd' || doc_id AS label,
    rpad(substr(bases, (chunk * {WIDTH} + 1)::INT, {WIDTH}), {WIDTH}, '-') AS sites
  FROM (SELECT doc_id, bases, unnest(range((length(bases) - 1) // {WIDTH} + 1)) AS chunk FROM bases WHERE length(bases) > 0)
)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, edge, logl): 97 edges, one query a supplier."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("query"), (F.col("l_partkey") % 97).alias("edge")).agg(
        (F.lit(0.0) - F.round(F.sum("l_discount"), 4) * 20.0).alias("logl")
    )


PAIRS = """
pairs AS (
  SELECT l_suppkey AS query, l_partkey % 97 AS edge, 0e0 - round(sum(l_discount), 4) * 20e0 AS logl FROM lineitem GROUP BY 1, 2
), lwr AS (
  SELECT *, e / sum(e) OVER (PARTITION BY query) AS lwr FROM (
    SELECT *, exp(logl - max(logl) OVER (PARTITION BY query)) AS e FROM pairs)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY lwr DESC, edge) AS rn, count(*) OVER (PARTITION BY query) AS n,
    coalesce(sum(lwr) OVER (PARTITION BY query ORDER BY lwr DESC, edge ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM lwr
)"""


def edge_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sequences and a length for each edge, from digests of names: (edge, lower, upper, length)."""

    def bases(c):
        digits = F.concat(F.md5(c.cast("binary")), F.md5(F.concat(c, F.lit("+")).cast("binary")))
        return F.translate(digits, HEX, "ACGT" * 4)

    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    both = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(
        F.col("n_nationkey").cast("long").alias("edge"),
        bases(F.col("n_name")).alias("lower"),
        bases(F.concat("r_name", "n_name")).alias("upper"),
        ((F.col("n_nationkey") + 1) / 50.0).alias("length"),
    )


EDGES = f"""
edges AS (
  SELECT n_nationkey::BIGINT AS edge,
    translate(md5(n_name) || md5(n_name || '+'), '{HEX}', '{"ACGT" * 4}') AS lower,
    translate(md5(r_name || n_name) || md5(r_name || n_name || '+'), '{HEX}', '{"ACGT" * 4}') AS upper,
    (n_nationkey + 1) / 50e0 AS length
  FROM nation JOIN region ON n_regionkey = r_regionkey
)"""
