"""Command line: place, split and convert.

    python -m cladeflow --tree T --ref-msa R --query Q --model M --outdir D
    python -m cladeflow --split R Q [Q ...] --outdir D
    python -m cladeflow --bfast Q --outdir D
    python -m cladeflow --tree T --ref-msa R --model M --dump-store D ; ... --load-store D --query Q
"""

from __future__ import annotations

import argparse
import os
import shlex
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cladeflow.functions.likelihood import Reference
from cladeflow.functions.models import parse_model, read_parameters
from cladeflow.functions.trees import Tree
from cladeflow.operators.placement import Options, masked_inputs, place, unplaceable
from cladeflow.sources import jplace, packed, sequences, store


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="cladeflow", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("-t", "--tree")
    p.add_argument("-s", "--ref-msa")
    p.add_argument("-q", "--query")
    p.add_argument("-m", "--model", default="GTR+G+F", help="a model string, or a file written by another program")
    p.add_argument("-w", "--outdir", default=".")
    mode = p.add_mutually_exclusive_group()
    mode.add_argument("-c", "--bfast", metavar="FILE", help="convert to the packed binary format")
    mode.add_argument("--split", nargs="+", metavar="FILE", help="reference alignment, then query files")
    mode.add_argument("-B", "--dump-store", metavar="DIR")
    p.add_argument("-b", "--load-store", metavar="DIR")
    limit = p.add_mutually_exclusive_group()
    limit.add_argument("--filter-acc-lwr", type=float)
    limit.add_argument("--filter-min-lwr", type=float)
    p.add_argument("--filter-min", type=int, default=1)
    p.add_argument("--filter-max", type=int, default=7)
    heuristic = p.add_mutually_exclusive_group()
    heuristic.add_argument("-g", "--dyn-heur", type=float)
    heuristic.add_argument("-G", "--fix-heur", type=float)
    heuristic.add_argument("--baseball-heur", action="store_true")
    heuristic.add_argument("--no-heur", action="store_true")
    p.add_argument("--chunk-size", type=int, default=500)
    p.add_argument("--no-pre-mask", action="store_true")
    p.add_argument("--precision", type=int, default=10)
    p.add_argument("--preserve-rooting", choices=("on", "off"), default="on")
    p.add_argument("--redo", action="store_true", help="replace an earlier result")
    p.add_argument("-v", "--verbose", action="store_true")
    a = p.parse_args(argv)
    if a.load_store and (a.tree or a.ref_msa):
        p.error("--load-store takes the place of --tree and --ref-msa")
    if not (a.bfast or a.split or a.load_store) and not (a.tree and a.ref_msa):
        p.error("--tree and --ref-msa are needed")
    if not (a.bfast or a.split or a.dump_store) and not a.query:
        p.error("--query is needed")
    if a.split and len(a.split) < 2:
        p.error("--split needs a reference and at least one query file")
    return a


def options(a: argparse.Namespace) -> Options:
    share = a.filter_acc_lwr if a.filter_acc_lwr is not None else a.filter_min_lwr
    threshold = next((x for x in (a.dyn_heur, a.fix_heur) if x is not None), 0.99999)
    return Options(
        prescoring=not a.no_heur,
        prescoring_threshold=threshold,
        heuristic="strike_box" if a.baseball_heur else "fixed" if a.fix_heur is not None else "dynamic",
        support_threshold=0.01 if share is None else share,
        by_sum=a.filter_acc_lwr is not None,
        filter_min=a.filter_min,
        filter_max=a.filter_max,
        chunk_size=a.chunk_size,
        premasking=not a.no_pre_mask,
        precision=a.precision,
        preserve_rooting=a.preserve_rooting == "on",
    )


def read_model(text: str):
    if os.path.isfile(text):
        with open(text, encoding="utf-8", errors="replace") as f:
            text = read_parameters(f.read())
    return parse_model(text)


def small_alignment(spark: SparkSession, path: str) -> dict[str, str]:
    """A reference alignment, whose size is that of the tree, by label; the first row of a label counts."""
    rows = sequences.read_sequences(spark, path).orderBy("seq_id").collect()
    return {r["label"].split()[0] if r["label"] else "": r["sites"] for r in reversed(rows)}


def fresh(path: str, redo: bool) -> str:
    if os.path.exists(path) and not redo:
        sys.exit(f"{path} exists; --redo replaces it")
    return path


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    os.makedirs(a.outdir, exist_ok=True)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.bfast:
        rows = sequences.read_sequences(spark, a.bfast).orderBy("seq_id")
        out = fresh(os.path.join(a.outdir, os.path.basename(a.bfast) + ".bfast"), a.redo)
        packed.write_packed(lambda: ((r["label"], r["sites"]) for r in rows.toLocalIterator()), out)
        print(out)
        return
    if a.split:
        reference = sequences.read_sequences(spark, a.split[0])
        ref, query = sequences.split_files(
            spark, reference, [sequences.read_sequences(spark, f) for f in a.split[1:]], reference.select("label")
        )
        for name, rows in (("reference", ref), ("query", query)):
            sequences.write_fasta(rows, fresh(os.path.join(a.outdir, f"{name}.fasta"), a.redo))
        return
    if a.load_store:
        reference, aligned = store.load(spark, a.load_store)
        queries = sequences.read_sequences(spark, a.query)
    else:
        with open(a.tree, encoding="utf-8") as f:
            newick = f.read()
        tree, model = Tree(newick, a.preserve_rooting == "on"), read_model(a.model)
        aligned = small_alignment(spark, a.ref_msa)
        if a.dump_store:
            store.save(spark, Reference(tree, model, aligned), aligned, newick, a.dump_store)
            return
        queries = sequences.read_sequences(spark, a.query)
        if not a.no_pre_mask:
            queries, aligned = masked_inputs(queries, aligned)
        reference = Reference(tree, model, aligned)
    if a.verbose:
        print(reference.model.report(), f"Reference: {reference.tree.n_edges} edges, log-likelihood {reference.tree_logl():.6f}", sep="\n")
    placed = place(queries, reference, options(a))
    out = fresh(os.path.join(a.outdir, "placements.jplace"), a.redo)
    jplace.write_document(placed, out, reference.tree.newick(a.precision), shlex.join(["cladeflow", *(argv or sys.argv[1:])]), a.precision)
    lost = unplaceable(queries).select(F.count("*")).first()[0]
    if lost:
        print(f"{lost} sequences hold nothing but gaps and were not placed", file=sys.stderr)
    print(out)


if __name__ == "__main__":
    main()
