import pytest
from pyspark.sql import functions as F

from cladeflow.functions import sites as S
from cladeflow.operators import alignment as A
from cladeflow.operators.ordering import row_numbers, running_sum

ROWS = [(0, "a", "---ATAGCT--"), (1, "b", "--GATAG-T--"), (2, "a", "-----------"), (3, "c", "---ATAGCT--")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "seq_id long, label string, sites string")


def test_ranges(rows):
    found = [(r["begin"], r["span"]) for r in A.with_range(rows).orderBy("seq_id").collect()]
    assert found[0] == (3, 6) and found[1] == (2, 7) and found[2][1] == 0
    good, bad = A.split_empty(rows)
    assert (good.count(), bad.count()) == (3, 1)


def test_masks(rows):
    mask = A.gap_mask(rows, 11)
    assert mask == [True, True, *[False] * 7, True, True]
    table = [r["masked"] for r in A.mask_table(rows, 11).orderBy("pos").collect()]
    assert table == mask
    assert A.project(rows, mask).orderBy("seq_id").first()["sites"] == "-ATAGCT"
    with pytest.raises(Exception, match="differ in width"):
        A.project(rows, [False]).collect()
    both = A.or_mask(A.mask_table(rows, 11), A.mask_table(rows, 11).withColumn("masked", F.col("pos") == 5))
    assert [r["pos"] for r in both.where("masked").orderBy("pos").collect()] == [0, 1, 5, 9, 10]


def test_wide_mask(spark):
    wide = spark.createDataFrame([(0, "x", "A" * 40 + "-" * 60)], "seq_id long, label string, sites string")
    assert A.gap_mask(wide, 100) == [False] * 40 + [True] * 60


def test_profile_and_frequencies(rows):
    r = A.profile(rows, 11).first()
    assert (r["sequences"], r["min_sites"], r["max_sites"], r["gap_columns"]) == (4, 11, 11, 4)
    f = {r["base"]: r["frequency"] for r in A.base_frequencies(rows.where("seq_id = 0")).collect()}
    assert f == {"A": 2 / 6, "C": 1 / 6, "G": 1 / 6, "T": 2 / 6}


def test_labels(rows, spark):
    wanted = spark.createDataFrame([("a",), ("z",)], "label string")
    assert sorted(r["seq_id"] for r in A.reference_part(rows, wanted).collect()) == [0, 2]
    assert sorted(r["seq_id"] for r in A.query_part(rows, wanted).collect()) == [1, 3]
    assert [r["seq_id"] for r in A.first_of_each(rows, wanted).collect()] == [0]
    assert [r["label"] for r in A.missing_labels(rows, wanted).collect()] == ["z"]


def test_collapse(rows):
    found = {r["seq_id"]: r["labels"] for r in A.collapse_equal(rows).collect()}
    assert found == {0: ["a", "c"], 1: ["b"], 2: ["a"]}


def test_symbols(spark):
    text = "AATGCTTCGTAA---NNNATTCBDAVMKWYR"
    row = spark.createDataFrame([(text,)], "s string")
    packed = row.select(S.encode(F.col("s")).alias("p"), F.length("s").alias("n"))
    assert packed.select(S.decode(F.col("p"), F.col("n"))).first()[0] == text
    assert spark.createDataFrame([("acu?xo.n",)], "s string").select(S.normalise(F.col("s"))).first()[0] == "ACT----N"
    assert row.select(S.is_dna(F.col("s"))).first()[0]


def test_dense_numbers(spark):
    ids = spark.range(0, 5_000_000, 50_000).withColumnRenamed("id", "k")
    assert [r["n"] for r in row_numbers(ids, "k", "n").orderBy("k").collect()] == list(range(100))


def test_running_sum_in_levels(spark):
    """Against a plain loop: negative orders, orders no double can hold, and windows of three rows at most."""
    orders = [-(1 << 62), -7, -3, -1, 0, 1, 2, 5, 9, 26, 27, 700, (1 << 53) + 1, (1 << 53) + 2, (1 << 62) + 3]
    rows = spark.createDataFrame([(k, i + 1) for i, k in enumerate(orders)], "k long, v long")
    wanted = [sum(range(1, i + 1)) for i in range(len(orders))]
    for levels in (0, 1, 2, 3):
        found = running_sum(rows, "k", F.col("v"), "s", bucket=3, levels=levels).orderBy("k").collect()
        assert [(r["k"], r["v"], r["s"]) for r in found] == list(zip(orders, range(1, 16), wanted))
    assert running_sum(rows.where("k > 800 and k < 900"), "k", F.col("v"), "s").collect() == []
