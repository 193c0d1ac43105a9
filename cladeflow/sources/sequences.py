"""Reading and writing aligned sequences as DataFrames (seq_id, label, sites)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.operators.alignment import first_of_each, missing_labels, profile, query_part
from cladeflow.operators.ordering import row_numbers


def read_fasta(spark: SparkSession, path: str, wanted_width: int | None = None) -> DataFrame:
    """FASTA records, plain or gzip: upper-case sites, ids in file order. Records are cut by Spark's reader at
    ``>``, so a large file is read by many tasks. With a width given, another one raises an error."""
    raw = spark.read.text(path, lineSep=">").where(F.trim("value") != "").withColumn("__at", F.monotonically_increasing_id())
    head = F.substring_index("value", "\n", 1)
    sites = F.upper(F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", ""))
    if wanted_width is not None:
        sites = F.when(F.length(sites) == wanted_width, sites).otherwise(F.raise_error(F.lit("sequences differ in width")))
    rows = raw.select("__at", F.trim(F.regexp_replace(head, "\r", "")).alias("label"), sites.alias("sites"))
    return row_numbers(rows, "__at", "seq_id").select("seq_id", "label", "sites")


def parse_phylip(text: str) -> list[tuple[str, str]]:
    """(label, sites) of a PHYLIP file: a record's sites may go on over lines, or all records over blocks."""
    lines = [x for x in text.splitlines() if x.strip()]
    try:
        count, width = map(int, lines[0].split()[:2])
    except (ValueError, IndexError):
        raise ValueError("no PHYLIP header") from None
    body = lines[1:]
    for attempt in (_sequential, _interleaved):
        rows = attempt(body, count, width)
        if rows is not None:
            return rows
    raise ValueError("neither sequential nor interleaved PHYLIP")


def _sequential(body: list[str], count: int, width: int) -> list[tuple[str, str]] | None:
    rows, k = [], 0
    while k < len(body) and len(rows) < count:
        label, *rest = body[k].split()
        sites, k = "".join(rest), k + 1
        while len(sites) < width and k < len(body):
            sites, k = sites + "".join(body[k].split()), k + 1
        if len(sites) != width:
            return None
        rows.append((label, sites.upper()))
    return rows if len(rows) == count and k == len(body) else None


def _interleaved(body: list[str], count: int, width: int) -> list[tuple[str, str]] | None:
    if len(body) % count:
        return None
    labels, sites = [], []
    for i, line in enumerate(body):
        parts = line.split()
        if i < count:
            labels.append(parts[0])
            sites.append("".join(parts[1:]))
        else:
            sites[i % count] += "".join(parts)
    if any(len(s) != width for s in sites):
        return None
    return [(a, s.upper()) for a, s in zip(labels, sites)]


def read_phylip(spark: SparkSession, path: str) -> DataFrame:
    """PHYLIP files, each parsed whole by one task, as the format asks for."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            for text in frame["value"]:
                rows = parse_phylip(text)
                yield pd.DataFrame({"seq_id": range(len(rows)), "label": [r[0] for r in rows], "sites": [r[1] for r in rows]})

    return spark.read.text(path, wholetext=True).mapInPandas(run, "seq_id long, label string, sites string")


def first_bytes(spark: SparkSession, path: str, n: int = 7) -> bytes:
    """The first bytes of the first file of a path, wherever Hadoop's file systems reach; no more of it is read."""
    context = spark.sparkContext
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    system = pattern.getFileSystem(conf)
    found = list(system.globStatus(pattern) or [])
    while found and found[0].isDirectory():
        inside = sorted(system.listStatus(found[0].getPath()), key=lambda s: s.getPath().getName())
        found = [s for s in inside if not s.getPath().getName().startswith(("_", "."))]
    if not found:
        raise FileNotFoundError(path)
    stream = system.open(found[0].getPath())
    try:
        read = [stream.read() for _ in range(min(n, found[0].getLen()))]
    finally:
        stream.close()
    return bytes(b & 255 for b in read if b >= 0)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Whatever the file is: packed binary, FASTA or PHYLIP, told by its first bytes."""
    head = first_bytes(spark, path)
    if head.startswith(b"BFAST"):
        from cladeflow.sources.packed import PackedFasta

        spark.dataSource.register(PackedFasta)
        return spark.read.format("packed_fasta").load(path)
    if head.lstrip().startswith(b">") or head[:2] == b"\x1f\x8b":
        return read_fasta(spark, path)
    return read_phylip(spark, path)


def write_fasta(rows: DataFrame, path: str) -> None:
    """One record for each row, in part files."""
    rows.select(F.concat(F.lit(">"), "label", F.lit("\n"), "sites").alias("value")).write.text(path)


def split_files(spark: SparkSession, reference: DataFrame, queries: list[DataFrame], labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reference part, query part): the first row of every wanted label, and all rows of other labels.

    Raises ValueError if query files differ in width or a wanted label is missing.
    """
    widths = [q.agg(F.max(F.length("sites")).alias("w"), F.min(F.length("sites")).alias("v")).first() for q in queries]
    if len({x for w in widths for x in w if x is not None}) > 1:
        raise ValueError("query files differ in width")
    lost = [r["label"] for r in missing_labels(reference, labels).limit(20).collect()]
    if lost:
        raise ValueError("no sequences for " + ", ".join(sorted(lost)))
    together = queries[0]
    for q in queries[1:]:
        together = together.unionByName(q)
    return first_of_each(reference, labels), query_part(together, labels)


def describe(rows: DataFrame, width: int) -> str:
    """A line about an alignment."""
    r = profile(rows, width).first()
    return f"{r['sequences']} sequences of {r['max_sites']} sites, {r['gap_columns']} gap columns ({100 * r['gap_share']:.2f} %)"
