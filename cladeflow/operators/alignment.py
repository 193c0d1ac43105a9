"""Operators over alignments: DataFrames (seq_id, label, sites)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.functions import sites as S

WORD = 32


def _flags(gaps: str) -> Column:
    """Sites as 1 for a gap and 0 for all else. gaps: the symbols that count as one."""
    return F.translate(F.regexp_replace(F.translate("sites", gaps, "-" * len(gaps)), "[^-]", "0"), "-", "1")


def gap_mask(rows: DataFrame, width: int, gaps: str = "-") -> list[bool]:
    """Columns that are gaps in every row. Flags are packed into words and folded by bit_and: one row per task."""
    flags = _flags(gaps)
    words = [F.bit_and(F.conv(F.substring(flags, a + 1, WORD), 2, 10).cast("long")).alias(f"w{a}") for a in range(0, width, WORD)]
    found = rows.agg(*words).first()
    mask: list[bool] = []
    for k, a in enumerate(range(0, width, WORD)):
        size = min(WORD, width - a)
        value = found[k] if found is not None and found[k] is not None else 0
        mask += [c == "1" for c in format(value, f"0{size}b")]
    return mask


def mask_table(rows: DataFrame, width: int, gaps: str = "-") -> DataFrame:
    """(pos, masked) of every column, without bringing the mask to the driver."""
    flags = _flags(gaps)
    words = [
        F.lpad(F.bin(F.bit_and(F.conv(F.substring(flags, a + 1, WORD), 2, 10).cast("long"))), min(WORD, width - a), "0")
        for a in range(0, width, WORD)
    ]
    folded = rows.agg(F.concat(*words).alias("mask"))
    bits = folded.select(F.posexplode(F.split(F.substring("mask", 1, width), "")).alias("pos", "bit"))
    return bits.select(F.col("pos").cast("int").alias("pos"), (F.col("bit") == "1").alias("masked"))


def or_mask(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns masked in either table."""
    return a.join(b.withColumnRenamed("masked", "other"), "pos").select("pos", (F.col("masked") | F.col("other")).alias("masked"))


def profile(rows: DataFrame, width: int) -> DataFrame:
    """Number of sequences, width, smallest and largest width, gap columns and their share."""
    counts = rows.agg(
        F.count("*").alias("sequences"),
        F.min(F.length("sites")).cast("int").alias("min_sites"),
        F.max(F.length("sites")).cast("int").alias("max_sites"),
    )
    gaps = mask_table(rows, width).agg(
        F.count_if("masked").alias("gap_columns"), (F.count_if("masked") / F.count("*")).alias("gap_share")
    )
    return counts.crossJoin(gaps)  # two tables of one row


def project(rows: DataFrame, mask: list[bool]) -> DataFrame:
    """Without masked columns. Sequences of another width than the mask's raise an error."""
    checked = F.when(F.length("sites") == len(mask), F.col("sites")).otherwise(
        F.raise_error(F.lit("a sequence and the mask differ in width"))
    )
    return rows.withColumn("sites", S.keep_columns(checked, mask))


def with_range(rows: DataFrame) -> DataFrame:
    """Adds ``begin`` and ``span`` of the valid range."""
    return rows.withColumn("begin", S.range_begin(F.col("sites")).cast("int")).withColumn(
        "span", S.range_span(F.col("sites")).cast("int")
    )


def split_empty(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a valid range, and rows of gaps alone; one bad row does not end a run."""
    ranged = with_range(rows)
    return ranged.where("span > 0"), ranged.where("span = 0")


def collapse_equal(rows: DataFrame) -> DataFrame:
    """One row for each distinct sequence with all its labels, smallest id first."""
    members = F.sort_array(F.collect_list(F.struct("seq_id", "label")))
    return rows.groupBy("sites").agg(F.min("seq_id").alias("seq_id"), members["label"].alias("labels"))


def reference_part(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows whose label is wanted."""
    return rows.join(labels.select("label").distinct(), "label", "left_semi")


def query_part(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows whose label is not wanted."""
    return rows.join(labels.select("label").distinct(), "label", "left_anti")


def first_of_each(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The first row of each wanted label; partial minima keep a frequent label from meeting in one task."""
    wanted = reference_part(rows, labels)
    first = wanted.groupBy("label").agg(F.min(F.struct("seq_id", "sites")).alias("first"))
    return first.select("first.seq_id", "label", "first.sites")


def missing_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Wanted labels without a row."""
    return labels.select("label").distinct().join(rows.select("label"), "label", "left_anti")


def base_frequencies(rows: DataFrame) -> DataFrame:
    """(base, frequency) of A, C, G, T; an ambiguous symbol counts for each of its bases in equal parts.

    Symbols are counted by the lengths that their removal takes off, so no row is exploded.
    """
    members = {c: [b for b, bit in zip("ACGT", (8, 4, 2, 1)) if S.NUCLEOTIDES.index(c) & bit] for c in S.NUCLEOTIDES[1:15]}
    upper = F.upper("sites")
    sums = [
        F.sum((F.length(upper) - F.length(F.replace(upper, F.lit(c), F.lit("")))).cast("long")).alias(f"n_{c}") for c in members
    ]
    counted = rows.agg(*sums)
    parts = {b: sum(F.col(f"n_{c}") / F.lit(float(len(m))) for c, m in members.items() if b in m) for b in "ACGT"}
    total = parts["A"] + parts["C"] + parts["G"] + parts["T"]
    table = counted.select(F.explode(F.array(*[F.struct(F.lit(b).alias("base"), (p / total).alias("frequency")) for b, p in parts.items()])).alias("x"))
    return table.select("x.base", "x.frequency")


def entry_offsets(rows: DataFrame) -> DataFrame:
    """Where each packed sequence would begin: label and size fields of 8 bytes, the label, half a byte a symbol."""
    from cladeflow.operators.ordering import running_sum

    size = (16 + F.octet_length("label") + F.ceil(F.length("sites") / 2)).cast("long")
    return running_sum(rows.withColumn("bytes", size), "seq_id", F.col("bytes"), "offset").select("seq_id", "bytes", "offset")
