"""Placement of query sequences on the edges of a reference tree.

One map over the queries does all numeric work: a matrix product scores every query on every edge, the
candidates of each query are chosen at once, so the pairs are never laid out as rows, and the candidates of a
batch are scored thoroughly, edge by edge, on the surfaces of ``functions.surfaces``. Weights, output filter and rooted
numbers follow in the map, and what leaves it is one row a query with an array of its placements; ``weighted``,
``filtered`` and ``rooted`` are the same as functions of such arrays. No step shuffles. The reference goes to every
task as one broadcast; its size is computed first and held against ``MAX_BROADCAST``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.functions.likelihood import Prescorer, Reference, encode
from cladeflow.functions.sites import keep_columns, normalise, range_span
from cladeflow.functions.surfaces import Surfaces
from cladeflow.operators.alignment import gap_mask

MAX_BROADCAST = 1 << 30
BLOCK, ROWS = 2048, 10000  # sequences that go through a surface at once, and through the map
PLACED = (
    "seq_id long, names array<string>, p array<struct<edge_num:int,likelihood:double,"
    "like_weight_ratio:double,distal_length:double,pendant_length:double>>"
)


@dataclass
class Options:
    """Knobs of a run, with the usual values."""

    prescoring: bool = True
    prescoring_threshold: float = 0.99999
    heuristic: str = "dynamic"  # dynamic, fixed or strike_box
    support_threshold: float = 0.01
    by_sum: bool = False
    filter_min: int = 1
    filter_max: int = 7
    chunk_size: int = 500
    premasking: bool = True
    precision: int = 10
    preserve_rooting: bool = True

    def __post_init__(self):
        if not 0 <= self.support_threshold <= 1 or not 0 <= self.prescoring_threshold <= 1:
            raise ValueError("thresholds must lie in [0, 1]")
        if self.filter_min < 1 or self.filter_min > self.filter_max:
            raise ValueError("filter_min must be at least 1 and at most filter_max")
        if self.heuristic not in ("dynamic", "fixed", "strike_box"):
            raise ValueError(f"no heuristic {self.heuristic!r}")


def choose(scores: np.ndarray, options: Options) -> np.ndarray:
    """(sequence, edge) mask of the candidates; ties go to the smaller edge."""
    n, edges = scores.shape
    if not options.prescoring:
        return np.ones_like(scores, bool)
    order = np.argsort(-scores, axis=1, kind="stable")
    top = np.take_along_axis(scores, order, axis=1)
    weights = np.exp(top - top[:, :1])
    weights /= weights.sum(axis=1, keepdims=True)
    place = np.arange(edges)
    if options.heuristic == "strike_box":
        hits = (top >= top[:, :1] - 3).sum(axis=1, keepdims=True)
        keep = place < hits + np.minimum(np.maximum(40 - hits, 0), 6)
    elif options.heuristic == "fixed":
        keep = np.broadcast_to(place < np.ceil(options.prescoring_threshold * edges), top.shape)
    else:
        before = np.cumsum(weights, axis=1) - weights
        keep = (before < options.prescoring_threshold) | (place < 1)
    out = np.zeros_like(keep)
    np.put_along_axis(out, order, keep, axis=1)
    return out


def candidates(queries: DataFrame, reference: Reference, options: Options, columns: np.ndarray | None = None) -> DataFrame:
    """(seq_id, names, p) with all candidates of each query and no weights yet."""
    return _scored(queries, reference, options, lambda found, n: found)


def _scored(queries: DataFrame, reference: Reference, options: Options, finish: Callable[[Found, int], Found]) -> DataFrame:
    """(seq_id, names, p) of what ``finish`` makes of the candidates."""
    lookup = reference.lookup()
    size = lookup.nbytes + reference.lower.nbytes + reference.upper.nbytes
    if size > MAX_BROADCAST:
        raise ValueError(f"the reference takes {size} bytes; place on parts of the tree or raise MAX_BROADCAST")
    shared = queries.sparkSession.sparkContext.broadcast((reference, lookup, Surfaces.of(reference, lookup)))

    def run(batches):
        tree, table, surfaces = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                codes = encode(part.column("sites").to_pylist(), tree.states)
                found = finish(search(codes, tree, table, surfaces, options), len(codes))
                yield pa.RecordBatch.from_arrays([part.column("seq_id"), part.column("names").cast(ARROW.field("names").type), found.arrays(len(codes))], schema=ARROW)

    return queries.select("seq_id", "names", "sites").mapInArrow(run, PLACED)


@dataclass
class Found:
    """Placements of the sequences of a batch: one element a placement, those of a sequence together."""

    rows: np.ndarray
    edges: np.ndarray
    logl: np.ndarray
    ratio: np.ndarray
    distal: np.ndarray
    pendant: np.ndarray

    def take(self, which: np.ndarray) -> Found:
        return Found(*(x[which] for x in vars(self).values()))

    def arrays(self, n: int) -> pa.Array:
        """The array of placements of each of n sequences."""
        ends = np.concatenate([[0], np.cumsum(np.bincount(self.rows, minlength=n))]).astype(np.int32)
        item = ARROW.field("p").type.value_type
        values = [pa.array(x, f.type) for x, f in zip((self.edges.astype(np.int32), self.logl, self.ratio, self.distal, self.pendant), item)]
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(values, fields=list(item)), type=ARROW.field("p").type)


def search(codes: np.ndarray, reference: Reference, lookup: np.ndarray, surfaces: Surfaces | None, options: Options) -> Found:
    """All candidates of the sequences with their best places, by sequence and edge."""
    out: list[tuple] = []
    # sequences and edges that go to Reference.thorough
    rest_rows, rest_edges = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    other = np.ones(len(codes), bool)
    for rows, hot in surfaces.hot(codes) if surfaces else ():
        other[rows] = False
        for a in range(0, len(rows), BLOCK):
            block, own_hot = rows[a : a + BLOCK], hot[a : a + BLOCK]
            chosen = choose(surfaces.prescore(own_hot), options)
            for edge in range(chosen.shape[1]):
                own = np.flatnonzero(chosen[:, edge])
                if len(own):
                    logl, distal, pendant, stayed = surfaces.edges[edge].thorough(own_hot[own])
                    on = np.flatnonzero(stayed)
                    out.append((block[own[on]], np.full(len(on), edge), logl[on], distal[on], pendant[on]))
                    rest_rows.append(block[own[~stayed]])
                    rest_edges.append(np.full(len(own) - len(on), edge))
    other = np.flatnonzero(other)
    prescore = Prescorer(lookup, reference.states)
    for a in range(0, len(other), options.chunk_size):
        rows, edges = np.nonzero(choose(prescore(codes[other[a : a + options.chunk_size]]), options))
        rest_rows.append(other[a + rows])
        rest_edges.append(edges)
    rows, edges = np.concatenate(rest_rows), np.concatenate(rest_edges)
    for edge in np.unique(edges).tolist():
        own = rows[edges == edge]
        for a in range(0, len(own), options.chunk_size):
            part = own[a : a + options.chunk_size]
            out.append((part, np.full(len(part), edge), *reference.thorough(edge, codes[part])))
    rows, edges, logl, distal, pendant = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((edges, rows))
    return Found(rows, edges, logl, np.zeros(len(rows)), distal, pendant).take(order)


def finished(found: Found, n: int, options: Options, reference: Reference) -> Found:
    """Weights, output filter and, if asked for, rooted numbers: as ``weighted``, ``filtered`` and ``rooted``."""
    best = np.full(n, -np.inf)
    np.maximum.at(best, found.rows, found.logl)
    share = np.exp(found.logl - best[found.rows])
    found.ratio = share / np.bincount(found.rows, share, minlength=n)[found.rows]
    found = found.take(np.lexsort((found.edges, -found.ratio, found.rows)))
    size = np.bincount(found.rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(len(found.rows)) - first[found.rows]
    if options.by_sum:
        # sums in the order of the placements, sequence by sequence
        ratio = np.zeros((n, int(size.max(initial=0))))
        ratio[found.rows, place] = found.ratio
        before = np.concatenate([np.zeros((n, 1)), np.cumsum(ratio, axis=1)], axis=1)[found.rows, place]
        kept = np.bincount(found.rows, before < options.support_threshold, minlength=n)
    else:
        kept = np.bincount(found.rows, found.ratio > options.support_threshold, minlength=n)
    kept = np.maximum(np.minimum(kept, options.filter_max), options.filter_min)
    found = found.take(np.flatnonzero(place < kept[found.rows]))
    r = reference.tree.rooting
    if options.preserve_rooting and r is not None:
        over = (found.edges == r.root_edge) & (found.distal > r.distal_length)
        found.distal = np.where(over, r.proximal_length - (found.distal - r.distal_length), found.distal)
        found.edges = np.where(over, r.proximal_edge, np.array(r.numbers)[found.edges])
    return found


ARROW = pa.schema(
    [
        ("seq_id", pa.int64()),
        ("names", pa.list_(pa.string())),
        (
            "p",
            pa.list_(
                pa.struct(
                    [
                        ("edge_num", pa.int32()),
                        ("likelihood", pa.float64()),
                        ("like_weight_ratio", pa.float64()),
                        ("distal_length", pa.float64()),
                        ("pendant_length", pa.float64()),
                    ]
                )
            ),
        ),
    ]
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with a value that is computed once, not for every element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def weighted(p: Column) -> Column:
    """The placements with weights, best first: a softmax over the array, in linear time but for the sort."""

    def with_weights(best: Column, total: Column) -> Column:
        return F.transform(
            p,
            lambda x: F.struct(
                x["edge_num"].alias("edge_num"),
                x["likelihood"].alias("likelihood"),
                (F.exp(x["likelihood"] - best) / total).alias("like_weight_ratio"),
                x["distal_length"].alias("distal_length"),
                x["pendant_length"].alias("pendant_length"),
            ),
        )

    sum_of = lambda best: F.aggregate(p, F.lit(0.0), lambda s, x: s + F.exp(x["likelihood"] - best))
    most = F.array_max(F.transform(p, lambda x: x["likelihood"]))
    with_weight = _let(most, lambda best: _let(sum_of(best), lambda total: with_weights(best, total)))

    def before(a: Column, b: Column) -> Column:
        same = a["like_weight_ratio"] == b["like_weight_ratio"]
        first = (a["like_weight_ratio"] > b["like_weight_ratio"]) | (same & (a["edge_num"] < b["edge_num"]))
        return F.when(same & (a["edge_num"] == b["edge_num"]), 0).when(first, -1).otherwise(1)

    return F.array_sort(with_weight, before)


def filtered(p: Column, options: Options) -> Column:
    """The output filter on a sorted array of placements."""
    ratio = F.transform(p, lambda x: x["like_weight_ratio"])
    if options.by_sum:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
        more = lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["n"] + 1).alias("n"))
        kept = F.aggregate(ratio, start, lambda s, x: F.when(s["sum"] < options.support_threshold, more(s, x)).otherwise(s))["n"]
    else:
        kept = F.size(F.filter(ratio, lambda x: x > options.support_threshold))
    kept = F.greatest(F.least(kept, F.lit(options.filter_max)), F.lit(options.filter_min))
    return F.when(F.size(p) > 0, F.slice(p, F.lit(1), F.least(kept, F.size(p)))).otherwise(p)


def rooted(p: Column, reference: Reference) -> Column:
    """Edges and distal lengths in the numbering of the rooted tree."""
    r = reference.tree.rooting
    numbers = F.array(*[F.lit(x) for x in r.numbers])

    def move(x: Column) -> Column:
        edge, distal = x["edge_num"], x["distal_length"]
        over = (edge == r.root_edge) & (distal > r.distal_length)
        return F.struct(
            F.when(over, r.proximal_edge).otherwise(F.element_at(numbers, edge + 1)).cast("int").alias("edge_num"),
            x["likelihood"].alias("likelihood"),
            x["like_weight_ratio"].alias("like_weight_ratio"),
            F.when(over, r.proximal_length - (distal - r.distal_length)).otherwise(distal).alias("distal_length"),
            x["pendant_length"].alias("pendant_length"),
        )

    return F.transform(p, move)


def place(queries: DataFrame, reference: Reference, options: Options | None = None, collapse: bool = True) -> DataFrame:
    """(seq_id, names, p) for queries (seq_id, label, sites); queries of gaps alone are left to ``unplaceable``.

    Equal sequences are scored once: their labels become the names of one row.
    """
    options = options or Options()
    protein = reference.states == 20
    ready = queries.withColumn("sites", normalise(F.col("sites"), protein)).where(range_span(F.col("sites")) > 0)
    if collapse:
        members = F.sort_array(F.collect_list(F.struct("seq_id", "label")))
        parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # kept, as the map behind takes long
        ready = ready.repartition(parts, "sites").groupBy("sites").agg(F.min("seq_id").alias("seq_id"), members["label"].alias("names"))
    else:
        ready = ready.withColumn("names", F.array("label"))
    return _scored(ready, reference, options, lambda found, n: finished(found, n, options, reference))


def unplaceable(queries: DataFrame) -> DataFrame:
    """Queries without any symbol but gaps."""
    return queries.where(range_span(normalise(F.col("sites"))) == 0)


# Symbols that tell nothing of a site, by the number of states.
GAPS = {4: "-?.NnXxOo", 20: "-?.Xx"}


def masked_inputs(queries: DataFrame, sequences: dict[str, str], gaps: str = "-") -> tuple[DataFrame, dict[str, str]]:
    """Both alignments without the columns that are gaps throughout either; ``GAPS`` has wider sets of gaps."""
    width = len(next(iter(sequences.values())))
    mask = gap_mask(queries, width, gaps)
    mask = [m or all(s[i] in gaps for s in sequences.values()) for i, m in enumerate(mask)]
    kept = {k: "".join(c for c, m in zip(s, mask) if not m) for k, s in sequences.items()}
    return queries.withColumn("sites", keep_columns(F.col("sites"), mask)), kept


def exploded(placed: DataFrame) -> DataFrame:
    """One row a placement."""
    return placed.select("seq_id", F.explode("p").alias("x")).select("seq_id", "x.*")
