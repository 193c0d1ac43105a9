"""Placements as jplace documents (version 3)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ["edge_num", "likelihood", "like_weight_ratio", "distal_length", "pendant_length"]


def placement_text(p: Column, precision: int = 10) -> Column:
    """One placement as a JSON list with fixed decimals."""
    real = f"%.{precision}f"
    return F.format_string(f"[%d, {real}, {real}, {real}, {real}]", *[p[f] for f in FIELDS])


def quoted(text: Column) -> Column:
    """A JSON string, escaped."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'^\{"x":(.*)\}$', 1)


def pquery_text(precision: int = 10) -> Column:
    """The JSON object of a row (names, p)."""
    placed = F.array_join(F.transform("p", lambda p: placement_text(p, precision)), ", ")
    names = F.array_join(F.transform("names", quoted), ", ")
    return F.concat(F.lit('{"p": ['), placed, F.lit('], "n": ['), names, F.lit("]}"))


def header(newick: str) -> str:
    return '{\n  "tree": ' + json.dumps(newick) + ',\n  "placements":\n  [\n'


def trailer(invocation: str) -> str:
    fields = ", ".join(json.dumps(f) for f in FIELDS)
    return f'  ],\n  "metadata": {{"invocation": {json.dumps(invocation)}}},\n  "version": 3,\n  "fields": [{fields}]\n}}\n'


def write_parts(placed: DataFrame, path: str, precision: int = 10) -> None:
    """One JSON object a line, in part files ordered by seq_id."""
    lines = placed.repartitionByRange("seq_id").sortWithinPartitions("seq_id")
    lines.select(pquery_text(precision).alias("value")).write.text(path)


def write_document(placed: DataFrame, path: str, newick: str, invocation: str, precision: int = 10) -> None:
    """One document in a local file; rows pass through the driver one partition at a time. Valid without rows."""
    lines = placed.orderBy("seq_id").select(pquery_text(precision).alias("value"))
    with open(path, "w", encoding="utf-8") as f:
        f.write(header(newick))
        first = True
        for row in lines.toLocalIterator():
            f.write(("" if first else ",\n") + "    " + row["value"])
            first = False
        f.write(("" if first else "\n") + trailer(invocation))


def read_document(spark, path: str) -> DataFrame:
    """(seq_id, names, p) of a document; older versions, with n or nm, are read too."""
    with open(path, encoding="utf-8") as f:
        document = json.load(f)
    rows = []
    for i, q in enumerate(document["placements"]):
        names = q.get("n") or [x[0] for x in q.get("nm", [])]
        placed = [dict(zip(document["fields"], p)) for p in q["p"]]
        rows.append((i, [names] if isinstance(names, str) else names, [tuple([int(p[FIELDS[0]]), *(float(p[f]) for f in FIELDS[1:])]) for p in placed]))
    kinds = "edge_num int, " + ", ".join(f"{f} double" for f in FIELDS[1:])
    schema = "seq_id long, names array<string>, p array<struct<" + kinds.replace(" ", ":").replace(",:", ",") + ">>"
    return spark.createDataFrame(rows, schema)
