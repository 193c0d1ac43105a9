import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeflow.functions import likelihood as L
from cladeflow.functions import models as M
from cladeflow.functions import surfaces
from cladeflow.functions.surfaces import Surfaces
from cladeflow.functions.trees import DEFAULT_LENGTH, Tree, parse_newick
from cladeflow.operators import equalrates, placement
from cladeflow.plans import inputs, registry
from cladeflow.plans.registry import small_reference
from cladeflow.sources import jplace, packed, sequences, store
from cladeflow.streaming import stream

SF = "/root/testdata/sf0.001"


def test_unrooted_numbers():
    text = "(p:0.5,(q:0.25,(r:0.75,s:0.5):0.25):1.5,t:2)top;"
    assert Tree(text).newick(2) == "(p:0.50{0},(q:0.25{1},(r:0.75{2},s:0.50{3}):0.25{4}):1.50{5},t:2.00{6})top;"


def tip_distances(top, numbers, edge, distal):
    """Distances of all tips from a point on an edge; distal: from its lower end."""
    near = {}
    for node in top.postorder():
        for child in node.children:
            near.setdefault(id(node), []).append((child, child.length))
            near.setdefault(id(child), []).append((node, child.length))
    child = next(n for n in top.postorder() if n is not top and numbers[id(n)] == edge)
    parent = next(n for n in top.postorder() if child in n.children)
    out, todo = {}, [(child, parent, distal), (parent, child, child.length - distal)]
    while todo:
        node, came, far = todo.pop()
        if not node.children:
            out[node.label] = far
        todo += [(n, node, far + x) for n, x in near[id(node)] if n is not came]
    return out


@pytest.mark.parametrize(
    "text",
    [
        "(((p:0.3,q:0.7):0.2,r:1.1):0.4,(s:0.9,(t:0.6,u:0.8):0.5):0.1);",
        "(p:0.3,((q:0.7,r:1.1)qr:0.2,(s:0.9,t:0.6):0.8):0.45)top;",
        "(((p:0.3,q:0.7):0.2,(r:1.1,s:0.9)rs:0.4):0.6,t:0.05);",
    ],
    ids=["two inner", "left tip", "right tip"],
)
def test_rooted_numbers(text):
    tree = Tree(text)
    order = [n for n in tree.rooted_top.postorder() if n is not tree.rooted_top]
    rooted = {id(n): k for k, n in enumerate(order)}
    written = parse_newick(tree.newick(2))
    assert [n.number for n in written.postorder()][:-1] == list(range(len(order)))
    assert [(n.label, n.length) for n in written.postorder()][:-1] == [(n.label, n.length) for n in order]
    # a point on the unrooted tree is the same point on the rooted one: as far from every tip
    unrooted, met = {id(n): n.number for n in tree.edges}, set()
    for node in tree.edges:
        for share in (0.0, 0.1, 0.5, 0.77, 1.0):
            place, length = tree.rooting.of(node.number, share * node.length)
            met.add(place)
            want = tip_distances(tree.top, unrooted, node.number, share * node.length)
            assert tip_distances(tree.rooted_top, rooted, place, length) == pytest.approx(want, abs=1e-10)
    assert met == set(range(len(order)))


def test_other_lengths():
    tree = Tree("(a:1,b:2,(c:3,d:4):5);")
    tree.set_lengths({0: 0.5, 4: 2.5})
    assert [n.length for n in tree.edges] == [0.5, 2, 3, 4, 2.5]
    with pytest.raises(ValueError):
        tree.set_lengths({1: 0.0})
    rooted = Tree("((a:1,b:2):3,(c:3,d:4):5);")
    with pytest.raises(ValueError):
        rooted.set_lengths({rooted.rooting.root_edge: 1.0})


def test_tree_errors():
    assert Tree("(A,B,(C,D));").edges[0].length == pytest.approx(DEFAULT_LENGTH)
    for bad in ("(A:1,B:1);", "(A,B,C,D);", "((A,B,C),D,E);", "(A,A,B);"):
        with pytest.raises(ValueError):
            Tree(bad)
    for bad in ("(A,B", "A,B);", "(A,B)); x"):
        with pytest.raises(ValueError):
            parse_newick(bad)


def test_models():
    assert M.gamma_rates(0.193259, 4) == pytest.approx([0.000417, 0.029979, 0.365837, 3.603767], abs=1e-6)
    assert sum(M.gamma_rates(0.7, 5, "median")) == pytest.approx(5)
    m = M.parse_model("GTR{1/2/3/4/5/2}+FU{0.1/0.2/0.3/0.4}+IU{0.1}+G4{0.5}")
    assert m.rates == [0.5, 1, 1.5, 2, 2.5, 1] and m.pinv == 0.1 and m.categories == 4
    assert M.parse_model(str(m)).rates == m.rates
    assert M.parse_model("DNA").freq_mode == "count"
    assert M.parse_model("HKY{2/4}").rates == [1, 2, 1, 1, 2, 1]
    r = M.parse_model("JC+R2{0.5/2}{0.6/0.4}")
    assert sum(a * b for a, b in zip(r.cat_rates, r.cat_weights)) == pytest.approx(1)
    for bad in ("NOPE", "GTR{1/2}", "GTR+G4+G4", "JC+FU{0.5/0.5}", "JC+Z", "JC+ASC_FELS"):
        with pytest.raises(ValueError):
            M.parse_model(bad)
    assert "gamma" in m.report()


def test_parameter_files():
    assert M.read_parameters("GTR{1/2/3/4/5/1}+FC, noname = 1-705\n") == "GTR{1/2/3/4/5/1}+FC"
    rates = "\n".join(f"rate {a} <-> {b}: {i}.5" for i, (a, b) in enumerate(["AC", "AG", "AT", "CG", "CT", "GT"]))
    freqs = "\n".join(f"freq pi({c}): 0.25" for c in "ACGT")
    text = f"This is RAxML version 8.2.4\nDataType: DNA\nSubstitution Matrix: GTR\n\nalpha: 0.4\ninvar: 0.1\n{rates}\n\n{freqs}\n"
    assert M.read_parameters(text) == "GTR{0.5/1.5/2.5/3.5/4.5/5.5}+FU{0.25/0.25/0.25/0.25}+IU{0.1}+G4{0.4}"
    rates = "\n".join(f"  {a}-{b}: 1.0" for a, b in ["AC", "AG", "AT", "CG", "CT", "GT"])
    freqs = "\n".join(f"  pi({c}) = 0.25" for c in "ACGT")
    text = f"IQ-TREE 1\nModel of substitution: GTR+F+G4\n{rates}\n{freqs}\nModel of rate heterogeneity: Gamma with 4 categories\nGamma shape alpha: 0.8\n"
    assert M.read_parameters(text) == "GTR{1.0/1.0/1.0/1.0/1.0/1.0}+FU{0.25/0.25/0.25/0.25}+G4{0.8}"
    with pytest.raises(ValueError):
        M.read_parameters("nothing here")


@pytest.fixture(scope="module")
def reference(spark):
    return small_reference(spark, SF)


def test_pulley(reference):
    values = [reference.tree_logl(e) for e in range(reference.tree.n_edges)]
    assert max(values) - min(values) < 1e-8


def test_prescore_is_thorough_in_the_middle(reference):
    codes = L.encode(["ACGT" * 16, "--" + "ACGTTGCA" * 7 + "------"], 4)
    scores = L.Prescorer(reference.lookup(), 4)(codes)
    logl, distal, pendant = reference.thorough(4, codes)
    assert (logl >= scores[:, 4] - 1e-9).all()
    assert ((0 < distal) & (distal < reference.lengths[4])).all() and (pendant > 0).all()


def test_leaf_places_on_itself(reference):
    tip = reference.tree.tips[2]
    table = L.tip_table(4)
    sites = "".join(L.NUCLEOTIDES[int(np.flatnonzero((table == row).all(1))[-1])] for row in reference.tips[tip.number])
    scores = L.Prescorer(reference.lookup(), 4)(L.encode([sites], 4))
    assert scores.argmax() == tip.number


def test_broken_likelihoods_are_errors():
    tree, aligned = Tree("(a:0.1,b:0.2,c:0.3);"), {"a": "ACGT", "b": "ACGA", "c": "ACTT"}
    good = L.Reference(tree, M.parse_model("JC"), aligned)
    assert good.tree_logl() < 0
    good.lower[0, 0] = np.nan
    with pytest.raises(ValueError):
        good.tree_logl()
    good.lower[0, 0] = 0.0
    with pytest.raises(ValueError):
        good.tree_logl()


def test_first_bytes(spark, tmp_path):
    for name, content in (("a.fasta", b">x\nACGT\n"), ("b.bin", b"BFAST\xff\x00more"), ("c", b"2")):
        (tmp_path / name).write_bytes(content)
        assert sequences.first_bytes(spark, str(tmp_path / name)) == content[:7]
    (tmp_path / "_SUCCESS").write_bytes(b"")
    assert sequences.first_bytes(spark, str(tmp_path)) == b">x\nACGT"
    with pytest.raises(FileNotFoundError):
        sequences.first_bytes(spark, str(tmp_path / "none"))


def test_symbols():
    with pytest.raises(ValueError):
        L.encode(["AC!"], 4)
    with pytest.raises(ValueError):
        L.encode(["AC", "A"], 4)
    assert L.valid_sites(L.encode(["-A-C-"], 4), 4).tolist() == [[False, True, True, True, False]]


def test_place_end_to_end(spark, reference, tmp_path):
    rows = inputs.alignment(spark, SF).select("seq_id", "label", "sites").where("seq_id < 300000")
    rows = rows.unionByName(spark.createDataFrame([(999999, "gaps", "-" * 64)], rows.schema))
    placed = placement.place(rows, reference).cache()
    assert placement.unplaceable(rows).count() == 1
    assert placed.select(F.explode("names")).count() == rows.count() - 1
    for r in placed.collect():
        ratios = [p["like_weight_ratio"] for p in r["p"]]
        assert 1 <= len(ratios) <= 7 and ratios == sorted(ratios, reverse=True) and sum(ratios) <= 1 + 1e-9
    path = str(tmp_path / "out.jplace")
    jplace.write_document(placed, path, reference.tree.newick(), "place")
    document = json.load(open(path))
    assert document["version"] == 3 and len(document["placements"]) == placed.count()
    again = jplace.read_document(spark, path)
    assert again.count() == placed.count()
    jplace.write_document(placed.limit(0), path, reference.tree.newick(), 'say "x"')
    assert json.load(open(path))["placements"] == []


def test_options():
    scores = np.log(np.array([[0.5, 0.3, 0.15, 0.05]]))
    pick = lambda **k: placement.choose(scores, placement.Options(**k)).tolist()[0]
    assert pick(prescoring_threshold=0.7) == [True, True, False, False]
    assert pick(heuristic="fixed", prescoring_threshold=0.25) == [True, False, False, False]
    assert pick(heuristic="strike_box") == [True] * 4 and pick(prescoring=False) == [True] * 4
    with pytest.raises(ValueError):
        placement.Options(filter_min=9)


def test_too_many_edges_are_not_dropped(spark, monkeypatch):
    edges = spark.createDataFrame([(k, "ACGT", "ACGA", 0.1) for k in range(3)], "edge long, lower string, upper string, length double")
    rows = spark.createDataFrame([(1, "ACGT")], "seq_id long, sites string")
    monkeypatch.setattr(equalrates, "MAX_EDGES", 3)
    assert registry._two_phase(rows, edges).count() > 0
    monkeypatch.setattr(equalrates, "MAX_EDGES", 2)
    with pytest.raises(ValueError):
        registry._two_phase(rows, edges)


def test_store(spark, tmp_path, reference):
    rows = {f"N{r['edge']}": r["lower"] for r in inputs.edge_sequences(spark, SF).where("edge < 8").collect()}
    store.save(spark, reference, rows, reference.tree.newick().replace("{", "[").replace("}", "]"), str(tmp_path / "s"))
    again, _ = store.load(spark, str(tmp_path / "s"))
    assert again.tree_logl() == pytest.approx(reference.tree_logl(), abs=1e-9)
    assert store.edges(spark, str(tmp_path / "s"), [1, 2]).count() == 2


def test_files(spark, tmp_path):
    fasta = tmp_path / "a.fasta"
    fasta.write_text(">one\nACG\nT-\n>two x\nacgta\n>three\n-----\n")
    rows = sequences.read_fasta(spark, str(fasta), 5)
    want = [(0, "one", "ACGT-"), (1, "two x", "ACGTA"), (2, "three", "-----")]
    assert [tuple(r) for r in rows.orderBy("seq_id").collect()] == want
    with pytest.raises(Exception, match="differ in width"):
        sequences.read_fasta(spark, str(fasta), 6).collect()
    path = str(tmp_path / "a.bin")
    packed.write_packed(lambda: ((b, c) for _, b, c in want), path, [False] * 4 + [True])
    spark.dataSource.register(packed.PackedFasta)
    got = spark.read.format("packed_fasta").option("slice", 2).load(path).orderBy("seq_id").collect()
    assert [tuple(r) for r in got] == want
    cut = spark.read.format("packed_fasta").option("masked", "true").load(path).orderBy("seq_id").collect()
    assert [r["sites"] for r in cut] == ["ACGT", "ACGT", "----"]
    with pytest.raises(ValueError):
        packed.pack("AC!")
    phy = tmp_path / "a.phy"
    phy.write_text("2 6\none ACG\ntwo TTT\n\nACG\nTTA\n")
    assert [tuple(r)[1:] for r in sequences.read_sequences(spark, str(phy)).collect()] == [("one", "ACGACG"), ("two", "TTTTTA")]
    assert sequences.parse_phylip("1 4\nx AC\nGT\n") == [("x", "ACGT")]
    assert sequences.read_sequences(spark, str(fasta)).count() == 3 and sequences.read_sequences(spark, path).count() == 3


def test_split_files(spark):
    ref = spark.createDataFrame([(0, "a", "AC"), (1, "a", "AG"), (2, "b", "AT"), (3, "q", "GG")], "seq_id long, label string, sites string")
    labels = spark.createDataFrame([("a",), ("b",)], "label string")
    one, two = sequences.split_files(spark, ref, [ref, ref], labels)
    assert sorted(r["sites"] for r in one.collect()) == ["AC", "AT"] and [r["label"] for r in two.collect()] == ["q", "q"]
    with pytest.raises(ValueError):
        sequences.split_files(spark, ref, [ref], spark.createDataFrame([("z",)], "label string"))


def test_stream_equals_batch(spark, tmp_path, reference):
    rows = inputs.alignment(spark, SF).select("seq_id", "label", "sites").where("seq_id < 100000")
    rows.write.parquet(str(tmp_path / "in"))
    query = stream.place_stream(stream.read_sequences(spark, str(tmp_path / "in")), reference, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("seq_id", "json")
    want = placement.place(rows, reference).select("seq_id", jplace.pquery_text().alias("json"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_default_length():
    assert DEFAULT_LENGTH == pytest.approx(-math.log(0.9))


def test_surfaces_are_thorough(spark, reference):
    rows = [r["sites"] for r in inputs.alignment(spark, SF).where("seq_id < 500000000").select("sites").collect()][:400]
    table = L.tip_table(4)
    tip = "".join(L.NUCLEOTIDES[int(np.flatnonzero((table == row).all(1))[-1])] for row in reference.tips[reference.tree.tips[2].number])
    rows += [tip, tip[:30] + "-" * 10 + tip[40:], "RYN" + rows[0][3:]]  # a copy of a tip, a gap inside, several states
    codes, lookup, options = L.encode(rows, 4), reference.lookup(), placement.Options()
    tables = Surfaces.of(reference, lookup)
    fast = placement.search(codes, reference, lookup, tables, options)
    slow = placement.search(codes, reference, lookup, None, options)
    assert (fast.rows == slow.rows).all() and (fast.edges == slow.edges).all() and set(fast.rows) == set(range(len(rows)))
    assert np.abs(fast.logl - slow.logl).max() < 1e-5
    hot = tables.hot(codes)
    assert sum(len(own) for own, _ in hot) == len(rows) - 1
    found = [tables.edges[e].thorough(h)[3] for _, h in hot for e in range(reference.tree.n_edges)]
    assert np.concatenate(found).mean() > 0.95  # or nothing would be gained


def test_large_references_have_no_surfaces(reference, monkeypatch):
    monkeypatch.setattr(surfaces, "MAX_BYTES", 1)
    assert Surfaces.of(reference, reference.lookup()) is None


@pytest.mark.parametrize("by_sum", [False, True])
def test_finished_as_columns(spark, reference, by_sum):
    options = placement.Options(by_sum=by_sum, support_threshold=0.9 if by_sum else 0.01, filter_max=5)
    rows = inputs.alignment(spark, SF).select("seq_id", "label", "sites").where("seq_id < 50000000")
    named = rows.withColumn("names", F.array("label"))
    p = placement.filtered(placement.weighted(F.col("p")), options)
    want = placement.candidates(named, reference, options).withColumn("p", p).withColumn("p", placement.rooted(F.col("p"), reference))
    got = placement.place(rows, reference, options, collapse=False)
    want, got = ({r["seq_id"]: [tuple(x) for x in r["p"]] for r in d.collect()} for d in (want, got))
    assert want.keys() == got.keys()
    for k, p in want.items():
        assert [x[0] for x in p] == [x[0] for x in got[k]] and np.array(p) == pytest.approx(np.array(got[k]), abs=1e-9)


def test_alignment_of_odd_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inputs, "PIECE", 128)
    texts = ["aZ" * 150, "", None, "ä1 é\n", "é" * 70 + "Bc", "x" * 64, "y" * 65]
    spark.createDataFrame(list(enumerate(texts, 3)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    bases = dict(zip(inputs.LETTERS + inputs.LETTERS.lower(), inputs.BASES * 2))
    want = []
    for k, text in enumerate(texts, 3):
        letters = "".join(bases.get(c, "") for c in text or "")
        want += [(k * inputs.CHUNKS + a // 64, k, f"d{k}", letters[a : a + 64].ljust(64, "-")) for a in range(0, len(letters), 64)]
    assert sorted(map(tuple, inputs.alignment(spark, str(tmp_path)).collect())) == want
