"""A prepared reference (tree, model, conditional likelihoods) as a Parquet table and a small JSON file of it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from cladeflow.functions.likelihood import Reference
from cladeflow.functions.models import parse_model
from cladeflow.functions.trees import Tree

SCHEMA = "edge_num int, lower array<double>, upper array<double>, scale array<double>"
HEAD = "newick string, model string, labels array<string>, sites array<string>"


def save(spark: SparkSession, reference: Reference, sequences: dict[str, str], newick: str, path: str) -> None:
    """One row an edge, so that a reader can take some edges only; the model's numbers are written in full."""
    m = reference.model
    numbers = lambda v: "{" + "/".join(map(repr, map(float, v))) + "}"
    text = f"{m.name}{numbers(_unique(m))}+FU{numbers(m.freqs)}"
    text += f"+IU{{{m.pinv!r}}}" if m.pinv else ""
    if m.alpha is not None:
        text += f"+G{m.categories}{'a' if m.gamma_mode == 'median' else 'm'}{{{m.alpha!r}}}"
    elif m.categories > 1:
        text += f"+R{m.categories}{numbers(m.cat_rates)}{numbers(m.cat_weights)}"
    labels = [t.label for t in reference.tree.tips]
    spark.createDataFrame([(newick, text, labels, [sequences[x] for x in labels])], HEAD).write.parquet(f"{path}/head")
    rows = [
        (e, reference.lower[e].ravel().tolist(), reference.upper[e].ravel().tolist(), reference.scale[e].tolist())
        for e in range(reference.tree.n_edges)
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/edges")


def _unique(model) -> list[float]:
    from cladeflow.functions.models import DNA_MODELS

    if model.name not in DNA_MODELS:
        return model.rates
    symmetry = DNA_MODELS[model.name][0]
    return [model.rates[symmetry.index(str(c))] for c in range(max(map(int, symmetry)) + 1)]


def load(spark: SparkSession, path: str) -> tuple[Reference, dict[str, str]]:
    """The reference; conditionals are taken from the table, not computed. All edges must be there."""
    head = spark.read.parquet(f"{path}/head").first()
    sequences = dict(zip(head["labels"], head["sites"]))
    reference = Reference(Tree(head["newick"]), parse_model(head["model"]), sequences, conditionals=False)
    shape, filled = reference.lower.shape[1:], 0
    for r in edges(spark, path).toLocalIterator():
        e = r["edge_num"]
        reference.lower[e] = np.array(r["lower"]).reshape(shape)
        reference.upper[e] = np.array(r["upper"]).reshape(shape)
        reference.scale[e] = r["scale"]
        filled += 1
    if filled != reference.tree.n_edges:
        raise ValueError("the store lacks edges")
    return reference, sequences


def edges(spark: SparkSession, path: str, wanted: list[int] | None = None) -> DataFrame:
    """Rows of all or some edges; the choice reaches the scan."""
    table = spark.read.schema(SCHEMA).parquet(f"{path}/edges")
    return table if wanted is None else table.where(table["edge_num"].isin(wanted))
