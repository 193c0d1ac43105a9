import json
import random

import pytest

from cladeflow.__main__ import arguments, main, options


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("cli"), random.Random(1)
    base = "".join(rng.choice("ACGT") for _ in range(80))
    change = lambda s, n: "".join(rng.choice("ACGT") if rng.random() < n else c for c in s)
    tips = {x: change(base, 0.2) for x in "ABCDE"}
    (folder / "t.nwk").write_text("(((A:0.1,B:0.2):0.05,C:0.1):0.03,(D:0.2,E:0.1):0.07);")
    (folder / "ref.fa").write_text("".join(f">{k}\n{v}\n" for k, v in tips.items()))
    (folder / "q.fa").write_text(f">q1\n{change(tips['C'], 0.02)}\n>q2\n{tips['E'][:60]}{'-' * 20}\n>gap\n{'-' * 80}\n")
    return folder, tips


def test_place(spark, files, capsys):
    folder, _ = files
    common = ["--query", str(folder / "q.fa"), "--outdir", str(folder / "out")]
    main(["--tree", str(folder / "t.nwk"), "--ref-msa", str(folder / "ref.fa"), "--model", "GTR+G", "-v", *common])
    document = json.load(open(folder / "out/placements.jplace"))
    best = {q["n"][0]: q["p"][0][0] for q in document["placements"]}
    # C and E are the edges 3 and 6 of the rooted tree
    assert best == {"q1": 3, "q2": 6} and "1 sequences hold nothing" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        main(["--tree", str(folder / "t.nwk"), "--ref-msa", str(folder / "ref.fa"), *common])
    main(["--tree", str(folder / "t.nwk"), "--ref-msa", str(folder / "ref.fa"), "--model", "GTR+G", "--dump-store", str(folder / "store")])
    main(["--load-store", str(folder / "store"), "--redo", *common])
    again = json.load(open(folder / "out/placements.jplace"))
    assert {q["n"][0]: q["p"][0][0] for q in again["placements"]} == best


def test_convert_and_split(spark, files):
    folder, tips = files
    main(["--bfast", str(folder / "ref.fa"), "--outdir", str(folder / "b")])
    from cladeflow.sources import sequences

    rows = sequences.read_sequences(spark, str(folder / "b/ref.fa.bfast")).collect()
    assert {r["label"]: r["sites"] for r in rows} == tips
    main(["--split", str(folder / "ref.fa"), str(folder / "ref.fa"), str(folder / "q.fa"), "--outdir", str(folder / "s")])
    assert sorted(r["label"] for r in sequences.read_fasta(spark, str(folder / "s/query.fasta")).collect()) == ["gap", "q1", "q2"]


def test_options():
    base = ["--tree", "t", "--ref-msa", "r", "--query", "q"]
    o = options(arguments([*base, "-G", "0.2", "--filter-acc-lwr", "0.9"]))
    assert (o.heuristic, o.prescoring_threshold, o.by_sum, o.support_threshold) == ("fixed", 0.2, True, 0.9)
    assert options(arguments([*base, "--baseball-heur"])).heuristic == "strike_box"
    assert not options(arguments([*base, "--no-heur"])).prescoring
    for bad in (["--tree", "t"], [*base, "-g", "1", "-G", "1"], ["--split", "x"], ["--load-store", "x", *base]):
        with pytest.raises(SystemExit):
            arguments(bad)
