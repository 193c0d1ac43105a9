"""Work lists (query, edge) and samples (query, edge, logl): merging, splitting, inverting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.operators.ordering import row_numbers


def all_pairs(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """Every query with every edge. The edges of a tree are few by nature and go to every task."""
    return queries.crossJoin(F.broadcast(edges))


def by_edge(work: DataFrame) -> DataFrame:
    """Queries of each edge, counted and listed."""
    return work.groupBy("edge").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("query")).alias("queries"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both samples."""
    return a.unionByName(b)


def collapse(rows: DataFrame) -> DataFrame:
    """One row for each query with all its placements, best first."""
    items = F.sort_array(F.collect_list(F.struct((-F.col("logl")).alias("key"), "edge", "logl")))
    placed = F.transform(items, lambda x: F.struct(x["edge"].alias("edge"), x["logl"].alias("logl")))
    return rows.groupBy("query").agg(placed.alias("p"))


def split_work(work: DataFrame, parts: int, order: str) -> DataFrame:
    """Near-equal contiguous parts: of n rows, each but the last has (n - n % parts + parts) / parts."""
    n = work.agg(F.count("*").alias("__n"))
    chunk = F.floor((F.col("__n") - F.col("__n") % parts + parts) / parts)
    numbered = row_numbers(work, order, "__k").crossJoin(F.broadcast(n))  # a table of one row
    return numbered.withColumn("part", F.floor(F.col("__k") / chunk).cast("long")).drop("__k", "__n")


def split_sample(rows: DataFrame, parts: int) -> DataFrame:
    """Parts by query number."""
    return rows.withColumn("part", F.pmod("query", F.lit(parts)).cast("long"))


def difficulty(rows: DataFrame, value: str) -> DataFrame:
    """Each value over the smallest one."""
    least = rows.agg(F.min(value).alias("__least"))
    return rows.crossJoin(F.broadcast(least)).withColumn("difficulty", F.col(value) / F.col("__least")).drop("__least")


def local_slices(total: int, ranks: int) -> list[tuple[int, int]]:
    """(offset, size) of contiguous slices of ceil(total / ranks) rows; the last ones may be shorter or empty."""
    part = -(-total // ranks)
    return [(min(r * part, total), max(0, min(part, total - r * part))) for r in range(ranks)]


def to_rooted(rows: DataFrame, edge_map: DataFrame, root: dict) -> DataFrame:
    """Edges and distal lengths of placements in the numbering of the rooted tree.

    edge_map: (edge, rooted_edge), one row for an edge; root: root_edge, distal_edge, distal_length,
    proximal_edge, proximal_length.
    """
    joined = rows.join(F.broadcast(edge_map), "edge", "left")
    at_root, over = F.col("edge") == root["root_edge"], F.col("distal_length") > root["distal_length"]
    edge = F.when(at_root & over, root["proximal_edge"]).when(at_root, root["distal_edge"]).otherwise(F.col("rooted_edge"))
    moved = root["proximal_length"] - (F.col("distal_length") - root["distal_length"])
    length = F.when(at_root & over, moved).otherwise(F.col("distal_length"))
    return joined.withColumn("__edge", edge.cast("long")).withColumn("distal_length", length).drop("rooted_edge", "edge").withColumnRenamed(
        "__edge", "edge"
    )
