"""Scores under the model of equal rates, in closed form: the SQL-checkable twin of the numeric kernel.

With four equally frequent bases, a base stays itself over a length t with probability 1/4 + 3/4 exp(-4t/3) and
becomes a given other one with 1/4 - 1/4 exp(-4t/3). A site of a query on an edge is then one of a few cases,
so scores are a matrix product of one-hot sites with a small table, as in the general kernel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cladeflow.functions.trees import DEFAULT_LENGTH

BASES = "ACGT"
MAX_EDGES = 100_000


def change(t: float) -> np.ndarray:
    decay = np.exp(-4 * t / 3)
    return np.full((4, 4), 0.25 - 0.25 * decay) + np.eye(4) * decay


def tables(edges: list[tuple[int, str, str, float]], place: float, pendant: float) -> np.ndarray:
    """(site, base, edge) log-likelihoods of a base at a share of the edge's length from its lower end."""
    width = len(edges[0][1])
    out = np.empty((width, 4, len(edges)))
    for k, (_, lower, upper, length) in enumerate(edges):
        low = change(length * place)[:, [BASES.index(c) for c in lower]]
        high = change(length * (1 - place))[:, [BASES.index(c) for c in upper]]
        out[:, :, k] = np.log(0.25 * (low * high).T @ change(pendant))
    return out


def scores(sequences: list[str], table: np.ndarray) -> np.ndarray:
    """(sequence, edge) sums over sites that are no gaps, to six places."""
    width = table.shape[0]
    data = np.frombuffer("".join(sequences).encode(), np.uint8).reshape(-1, width)
    hot = np.stack([data == ord(c) for c in BASES], axis=2).astype(float)
    return np.round(hot.reshape(len(data), -1) @ table.reshape(width * 4, -1), 6)


def score_pairs(
    queries: DataFrame, edges: DataFrame, place: float = 0.5, pendant: float = DEFAULT_LENGTH, keep: float | None = None
) -> DataFrame:
    """(seq_id, edge, logl) of queries (seq_id, sites) on edges (edge, lower, upper, length).

    keep: only the best edges of each query, until their weights sum up to it; the others are never rows.
    """
    rows = edges.orderBy("edge").limit(MAX_EDGES + 1).collect()
    if len(rows) > MAX_EDGES:
        raise ValueError("too many edges for one table")
    shared = queries.sparkSession.sparkContext.broadcast(
        (np.array([r["edge"] for r in rows]), tables([tuple(r) for r in rows], place, pendant))
    )

    def run(batches):
        numbers, table = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                found = scores(part.column("sites").to_pylist(), table)
                ids = part.column("seq_id").to_numpy()
                mask = np.ones_like(found, bool) if keep is None else best(found, keep)
                row, edge = np.nonzero(mask)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row]), pa.array(numbers[edge]), pa.array(found[row, edge])], ["seq_id", "edge", "logl"]
                )

    return queries.select("seq_id", "sites").mapInArrow(run, "seq_id long, edge long, logl double")


def best(found: np.ndarray, threshold: float) -> np.ndarray:
    """Best edges of each row until their weights reach the threshold; ties go to the smaller edge."""
    order = np.argsort(-found, axis=1, kind="stable")
    top = np.take_along_axis(found, order, axis=1)
    weight = np.exp(top - top[:, :1])
    weight /= weight.sum(axis=1, keepdims=True)
    before = np.round(np.cumsum(weight, axis=1) - weight, 9)
    out = np.zeros_like(found, bool)
    np.put_along_axis(out, order, before < threshold, axis=1)
    out[np.arange(len(out)), order[:, 0]] = True
    return out
