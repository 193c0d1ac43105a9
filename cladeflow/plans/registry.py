"""Queries over the driver's tables and their SQL equivalents.

Each query applies operators of this package to whole tables; ``ORACLES`` holds the same in DuckDB's SQL, with
the same column names. Doubles are rounded to nine places or fewer on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.functions import sites as S
from cladeflow.functions import texts
from cladeflow.functions.likelihood import Prescorer, Reference, encode
from cladeflow.functions.models import parse_model
from cladeflow.functions.trees import DEFAULT_LENGTH, Tree
from cladeflow.operators import alignment as A
from cladeflow.operators import equalrates, ordering, placement, samples, selection
from cladeflow.plans import inputs
from cladeflow.plans.inputs import ALN, EDGES, PAIRS, WIDTH, table
from cladeflow.sources import jplace

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(rows: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return rows.withColumns({n: F.round(F.col(n), digits) for n in names})


# --- weights and selection -------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT user_id AS query, event_type AS edge, -round(sum(value), 6) AS logl FROM events GROUP BY 1, 2)
SELECT query, edge, round(e / sum(e) OVER (PARTITION BY query), 9) AS lwr
FROM (SELECT *, exp(logl - max(logl) OVER (PARTITION BY query)) AS e FROM s)
""")
def lwr_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("query"), F.col("event_type").alias("edge"))
    scores = scores.agg((-F.round(F.sum("value"), 6)).alias("logl"))
    return rounded(selection.with_weights(scores), "lwr").select("query", "edge", "lwr")


def _selected(rows: DataFrame) -> DataFrame:
    return rounded(rows, "lwr").select("query", "edge", "rn", "lwr")


_COLUMNS = "SELECT query, edge, rn, round(lwr, 9) AS lwr FROM ranked WHERE "


@query(f"WITH {PAIRS} {_COLUMNS} (round(before, 12) < 0.95 AND rn <= 7) OR rn <= 1")
def select_accumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(selection.accumulated(selection.with_weights(inputs.pairs(spark, sf_dir)), 0.95, 1, 7))


@query(f"WITH {PAIRS} {_COLUMNS} round(before, 12) < 0.99999 OR rn <= 1")
def select_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(selection.select_candidates(inputs.pairs(spark, sf_dir), "dynamic", 0.99999))


@query(f"WITH {PAIRS} {_COLUMNS} (lwr > 0.01 AND rn <= 7) OR rn <= 1")
def filter_min_lwr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(selection.filter_placements(selection.with_weights(inputs.pairs(spark, sf_dir)), 0.01, 1, 7))


@query(f"WITH {PAIRS} {_COLUMNS} (round(before, 12) < 0.9 AND rn <= 5) OR rn <= 2")
def filter_accumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.with_weights(inputs.pairs(spark, sf_dir))
    return _selected(selection.filter_placements(rows, 0.9, 2, 5, by_sum=True))


@query(f"WITH {PAIRS} {_COLUMNS} rn <= ceil(0.1 * n)")
def select_top_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(selection.select_candidates(inputs.pairs(spark, sf_dir), "fixed", 0.1))


@query(f"WITH {PAIRS} {_COLUMNS} rn <= ceil(0.5 * n)")
def discard_bottom_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(selection.without_bottom(selection.with_weights(inputs.pairs(spark, sf_dir)), 0.5))


@query(f"""
WITH {PAIRS}, b AS (
  SELECT query, edge, logl, row_number() OVER (PARTITION BY query ORDER BY logl DESC, edge) AS rn,
    max(logl) OVER (PARTITION BY query) AS best FROM pairs
), h AS (SELECT *, count(*) FILTER (logl >= best - 3) OVER (PARTITION BY query) AS hits FROM b)
SELECT query, edge, rn, round(logl, 9) AS logl FROM h WHERE rn <= hits + least(greatest(40 - hits, 0), 6)
""")
def select_strike_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.select_candidates(inputs.pairs(spark, sf_dir), "strike_box")
    return rounded(rows, "logl").select("query", "edge", "rn", "logl")


@query(f"""
WITH {PAIRS} SELECT query, edge, round(logl, 9) AS logl FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY logl DESC, edge) AS k FROM pairs) WHERE k = 1
""")
def best_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.best_edge(inputs.pairs(spark, sf_dir)), "logl")


@query(f"WITH {PAIRS} {_COLUMNS} rn <= 3 AND lwr >= 0.05")
def select_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.with_weights(inputs.pairs(spark, sf_dir))
    return _selected(selection.select_by(rows, lambda rn, lwr: (rn <= 3) & (lwr >= 0.05)))


# --- alignments ------------------------------------------------------------------------------------------


@query(f"""
WITH {ALN} SELECT pos::INT AS pos, bool_and(substr(sites, (pos + 1)::INT, 1) = '-') AS masked
FROM aln, range({WIDTH}) t(pos) GROUP BY pos
""")
def gap_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mask_table(inputs.alignment(spark, sf_dir), WIDTH)


_SHORT = f"""
WITH {ALN}, short AS (SELECT * FROM aln WHERE seq_id IN (SELECT seq_id FROM aln GROUP BY seq_id HAVING min(length(rtrim(sites, '-'))) <= 40)),
long AS (SELECT * FROM aln WHERE length(rtrim(sites, '-')) > 40),
m1 AS (SELECT pos, bool_and(substr(sites, (pos + 1)::INT, 1) = '-') AS masked FROM short, range({WIDTH}) t(pos) GROUP BY pos),
m2 AS (SELECT pos, bool_and(substr(sites, (pos + 1)::INT, 1) = '-') AS masked FROM long, range({WIDTH}) t(pos) GROUP BY pos)
"""


def _by_span(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sequences with at most 40 sites, whose last columns are gaps, and the others."""
    rows = inputs.alignment(spark, sf_dir)
    return rows.where(S.range_span(F.col("sites")) <= 40), rows.where(S.range_span(F.col("sites")) > 40)


@query(_SHORT + "SELECT pos::INT AS pos, m1.masked OR m2.masked AS masked FROM m1 JOIN m2 USING (pos)")
def mask_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    short, long = _by_span(spark, sf_dir)
    return A.or_mask(A.mask_table(short, WIDTH), A.mask_table(long, WIDTH))


@query(
    _SHORT
    + """SELECT seq_id, string_agg(substr(sites, (pos + 1)::INT, 1), '' ORDER BY pos) AS sites
FROM short JOIN (SELECT pos FROM m1 WHERE NOT masked) ON true GROUP BY seq_id"""
)
def mask_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = _by_span(spark, sf_dir)[0]
    return A.project(short, A.gap_mask(short, WIDTH)).select("seq_id", "sites")


@query(f"""
WITH {ALN}, m AS (
  SELECT pos, bool_and(substr(sites, (pos + 1)::INT, 1) = '-') AS masked FROM aln, range({WIDTH}) t(pos) GROUP BY pos)
SELECT (SELECT count(*) FROM aln) AS sequences, (SELECT min(length(sites))::INT FROM aln) AS min_sites,
  (SELECT max(length(sites))::INT FROM aln) AS max_sites, count(*) FILTER (masked) AS gap_columns,
  round(count(*) FILTER (masked) / count(*)::DOUBLE, 9) AS gap_share FROM m
""")
def info_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.profile(inputs.alignment(spark, sf_dir), WIDTH), "gap_share")


@query(f"""
WITH {ALN} SELECT seq_id, (length(sites) - length(ltrim(sites, '-')))::INT AS begin, length(trim(sites, '-'))::INT AS span FROM aln
""")
def valid_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.with_range(inputs.alignment(spark, sf_dir)).select("seq_id", "begin", "span")


@query("""
SELECT doc_id, translate(upper(regexp_replace(text, '[^ -~]', '', 'g')), 'UXO.?', 'T----') AS sites,
  regexp_full_match(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[-TGKCYSBAWRDMHVN]+') AS dna FROM documents
""")
def normalise_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plain = F.regexp_replace("text", "[^ -~]", "")
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return docs.select("doc_id", S.normalise(plain).alias("sites"), S.is_dna(letters).alias("dna"))


@query(f"""
WITH {ALN} SELECT seq_id, regexp_full_match(sites, '[-TGKCYSBAWRDMHVN]+') AS dna, length(trim(sites, '-')) > 0 AS placeable FROM aln
""")
def dna_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.alignment(spark, sf_dir)
    return rows.select("seq_id", S.is_dna(F.col("sites")).alias("dna"), (S.range_span(F.col("sites")) > 0).alias("placeable"))


@query(f"WITH {ALN} SELECT seq_id, translate(sites, '{S.NUCLEOTIDES}', '{S.HEX}') AS packed FROM aln")
def fourbit_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.alignment(spark, sf_dir).select("seq_id", F.hex(S.encode(F.col("sites"))).alias("packed"))


@query(f"WITH {ALN} SELECT seq_id, sites FROM aln")
def fourbit_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.alignment(spark, sf_dir)
    return rows.select("seq_id", S.decode(S.encode(F.col("sites")), F.length("sites")).alias("sites"))


@query(f"""
WITH {ALN}, b AS (SELECT seq_id, 16 + strlen(label) + (length(sites) + 1) // 2 AS bytes FROM aln)
SELECT seq_id, bytes::BIGINT AS bytes,
  coalesce(sum(bytes) OVER (ORDER BY seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM b
""")
def entry_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.entry_offsets(inputs.alignment(spark, sf_dir))


@query(f"""
WITH {ALN} SELECT sites, min(seq_id) AS seq_id, count(*) AS n, string_agg(label, ',' ORDER BY seq_id, label) AS labels FROM aln GROUP BY sites
""")
def collapse_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.collapse_equal(inputs.alignment(spark, sf_dir))
    return rows.select("sites", "seq_id", F.size("labels").cast("long").alias("n"), F.array_join("labels", ",").alias("labels"))


def _good_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return good.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("label"))


_GOOD = "good AS (SELECT DISTINCT 'd' || doc_id AS label FROM labels WHERE quality = 1)"


@query(f"WITH {ALN}, {_GOOD} SELECT seq_id, label FROM aln WHERE label IN (SELECT label FROM good)")
def split_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.reference_part(inputs.alignment(spark, sf_dir), _good_labels(spark, sf_dir)).select("seq_id", "label")


@query(f"WITH {ALN}, {_GOOD} SELECT seq_id, label FROM aln WHERE label NOT IN (SELECT label FROM good)")
def split_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.query_part(inputs.alignment(spark, sf_dir), _good_labels(spark, sf_dir)).select("seq_id", "label")


@query(f"""
WITH {ALN}, {_GOOD} SELECT seq_id, label, sites FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY seq_id) AS k FROM aln WHERE label IN (SELECT label FROM good)) WHERE k = 1
""")
def reference_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_of_each(inputs.alignment(spark, sf_dir), _good_labels(spark, sf_dir))


@query("SELECT DISTINCT c_custkey::VARCHAR AS label FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def tips_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tips = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("label"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("label"))
    return A.missing_labels(rows, tips)


@query(f"""
WITH {ALN}, n AS (SELECT sum(length(sites) - length(replace(sites, 'A', ''))) AS a, sum(length(sites) - length(replace(sites, 'C', ''))) AS c,
  sum(length(sites) - length(replace(sites, 'G', ''))) AS g, sum(length(sites) - length(replace(sites, 'T', ''))) AS t FROM aln)
SELECT base, round(x / (a + c + g + t)::DOUBLE, 9) AS frequency
FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS base, unnest([a, c, g, t]) AS x, a, c, g, t FROM n)
""")
def base_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.base_frequencies(inputs.alignment(spark, sf_dir)), "frequency")


# --- work lists and samples ------------------------------------------------------------------------------


@query("SELECT c_custkey AS query, n_nationkey AS edge FROM customer, nation")
def all_pairs_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query"))
    return samples.all_pairs(queries, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("edge")))


@query(f"""
WITH {PAIRS} SELECT edge, count(*) AS n, string_agg(query, ',' ORDER BY query) AS queries FROM (SELECT DISTINCT query, edge FROM pairs) GROUP BY edge
""")
def work_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples.by_edge(inputs.pairs(spark, sf_dir))
    return rows.select("edge", "n", F.array_join(F.transform("queries", lambda q: q.cast("string")), ",").alias("queries"))


@query(f"WITH {PAIRS} SELECT count(*) AS pairs, count(DISTINCT edge) AS edges, count(DISTINCT query) AS queries FROM pairs")
def work_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.pairs(spark, sf_dir).agg(
        F.count("*").alias("pairs"), F.countDistinct("edge").alias("edges"), F.countDistinct("query").alias("queries")
    )


@query("""
WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, k // ((n - n % 13 + 13) // 13) AS part FROM k
""")
def work_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.split_work(table(spark, sf_dir, "orders").select("o_orderkey"), 13, "o_orderkey")


@query(f"WITH {PAIRS} SELECT query, edge, query % 5 AS part FROM pairs")
def sample_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.split_sample(inputs.pairs(spark, sf_dir), 5).select("query", "edge", "part")


@query(f"""
WITH {PAIRS}, s AS (
  SELECT user_id AS query, 0::BIGINT AS edge, -round(sum(value), 4) AS logl FROM events GROUP BY 1
), u AS (SELECT query, edge, logl FROM pairs UNION ALL SELECT * FROM s)
SELECT query, count(*) AS n, string_agg(edge, ',' ORDER BY -logl, edge) AS edges FROM u GROUP BY query
""")
def sample_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("query"))
    more = more.agg((-F.round(F.sum("value"), 4)).alias("logl")).select("query", F.lit(0).cast("long").alias("edge"), "logl")
    rows = samples.collapse(samples.merge(inputs.pairs(spark, sf_dir), more))
    edges = F.array_join(F.transform("p", lambda x: x["edge"].cast("string")), ",")
    return rows.select("query", F.size("p").cast("long").alias("n"), edges.alias("edges"))


@query("SELECT o_orderkey, round(o_totalprice / (SELECT min(o_totalprice) FROM orders), 9) AS difficulty FROM orders")
def difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples.difficulty(table(spark, sf_dir, "orders"), "o_totalprice")
    return rounded(rows, "difficulty").select("o_orderkey", "difficulty")


@query("""
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_partkey % 97 = 96 AND l_quantity / 50e0 > 0.5 THEN 98 WHEN l_partkey % 97 = 96 THEN 97
       WHEN l_partkey % 97 > 40 THEN l_partkey % 97 + 1 ELSE l_partkey % 97 END AS edge,
  round(CASE WHEN l_partkey % 97 = 96 AND l_quantity / 50e0 > 0.5 THEN 0.75 - (l_quantity / 50e0 - 0.5) ELSE l_quantity / 50e0 END, 9) AS distal_length
FROM lineitem
""")
def root_edge_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") % 97).alias("edge"), (F.col("l_quantity") / 50.0).alias("distal_length")
    )
    numbers = spark.range(97).select(F.col("id").alias("edge"), (F.col("id") + (F.col("id") > 40).cast("int")).alias("rooted_edge"))
    root = {"root_edge": 96, "distal_edge": 97, "distal_length": 0.5, "proximal_edge": 98, "proximal_length": 0.75}
    rows = samples.to_rooted(lines, numbers, root)
    return rounded(rows, "distal_length").select("l_orderkey", "l_linenumber", "edge", "distal_length")


@query("""
SELECT row_number() OVER (ORDER BY event_id) - 1 AS n, event_id FROM events
""")
def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.row_numbers(table(spark, sf_dir, "events").select("event_id"), "event_id", "n")


@query("""
WITH n AS (SELECT count(*) AS n FROM orders), r AS (SELECT unnest(range(7)) AS rank)
SELECT rank, least(rank * ((n + 6) // 7), n) AS "offset", greatest(0, least((n + 6) // 7, n - rank * ((n + 6) // 7))) AS size FROM r, n
""")
def local_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = samples.local_slices(table(spark, sf_dir, "orders").count(), 7)
    return spark.createDataFrame([(r, o, n) for r, (o, n) in enumerate(found)], "rank long, offset long, size long")


# --- scores ----------------------------------------------------------------------------------------------

_SITES = f"""
WITH {ALN}, {EDGES}, e AS (
  SELECT edge, pos, substr(lower, (pos + 1)::INT, 1) AS lo, substr(upper, (pos + 1)::INT, 1) AS up, length FROM edges, range({WIDTH}) t(pos)
), b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS x),
tab AS (
  SELECT edge, pos, q.x AS base, ln(0.25e0 * sum(
      (0.25e0 + (CASE WHEN b.x = lo THEN 0.75e0 ELSE -0.25e0 END) * exp(-4e0 / 3e0 * length * 0.5e0))
    * (0.25e0 + (CASE WHEN b.x = up THEN 0.75e0 ELSE -0.25e0 END) * exp(-4e0 / 3e0 * length * 0.5e0))
    * (0.25e0 + (CASE WHEN b.x = q.x THEN 0.75e0 ELSE -0.25e0 END) * exp(4e0 / 3e0 * ln(0.9e0))))) AS l
  FROM e, b, b q GROUP BY edge, pos, q.x
), tab2 AS (
  SELECT edge, pos, q.x AS base, ln(0.25e0 * sum(
      (0.25e0 + (CASE WHEN b.x = lo THEN 0.75e0 ELSE -0.25e0 END) * exp(-4e0 / 3e0 * length * 0.25e0))
    * (0.25e0 + (CASE WHEN b.x = up THEN 0.75e0 ELSE -0.25e0 END) * exp(-4e0 / 3e0 * length * 0.75e0))
    * (0.25e0 + (CASE WHEN b.x = q.x THEN 0.75e0 ELSE -0.25e0 END) * exp(-4e0 / 3e0 * 0.5e0)))) AS l
  FROM e, b, b q GROUP BY edge, pos, q.x
), sites AS (SELECT seq_id, pos, substr(sites, (pos + 1)::INT, 1) AS base FROM aln, range({WIDTH}) t(pos)
), pre AS (SELECT seq_id, edge, round(sum(l), 6) AS logl FROM sites JOIN tab USING (pos, base) GROUP BY 1, 2)
"""


@query(_SITES + "SELECT seq_id, edge, logl FROM pre")
def prescore_equal_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.alignment(spark, sf_dir)
    return equalrates.score_pairs(rows, inputs.edge_sequences(spark, sf_dir))


@query(
    _SITES
    + """, w AS (
  SELECT seq_id, edge, logl, e / sum(e) OVER (PARTITION BY seq_id) AS lwr FROM (
    SELECT *, exp(logl - max(logl) OVER (PARTITION BY seq_id)) AS e FROM pre)
), c AS (
  SELECT seq_id, edge FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY logl DESC, edge) AS rn,
    coalesce(sum(lwr) OVER (PARTITION BY seq_id ORDER BY logl DESC, edge ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM w) WHERE round(before, 9) < 0.99 OR rn = 1
), s AS (
  SELECT seq_id, edge, round(sum(l), 6) AS logl FROM c JOIN sites USING (seq_id) JOIN tab2 USING (edge, pos, base) GROUP BY 1, 2
), v AS (
  SELECT seq_id, edge, logl, e / sum(e) OVER (PARTITION BY seq_id) AS lwr FROM (
    SELECT *, exp(logl - max(logl) OVER (PARTITION BY seq_id)) AS e FROM s)
)
SELECT seq_id, edge, logl, round(lwr, 4) AS lwr FROM (
  SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY lwr DESC, edge) AS rn FROM v) WHERE (lwr > 0.01 AND rn <= 7) OR rn <= 1
"""
)
def two_phase_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.alignment(spark, sf_dir)
    return rounded(_two_phase(rows, inputs.edge_sequences(spark, sf_dir)), "lwr", digits=4)


def _two_phase(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Both phases in one map; weights and the filter as windows over what is left."""
    import numpy as np
    import pyarrow as pa

    found = edges.orderBy("edge").limit(equalrates.MAX_EDGES + 1).collect()
    if len(found) > equalrates.MAX_EDGES:
        raise ValueError("too many edges for one table")
    tables = [equalrates.tables([tuple(r) for r in found], p, t) for p, t in ((0.5, DEFAULT_LENGTH), (0.25, 0.5))]
    shared = rows.sparkSession.sparkContext.broadcast((np.array([r["edge"] for r in found]), *tables))

    def run(batches):
        numbers, cheap, costly = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                sites = part.column("sites").to_pylist()
                row, edge = np.nonzero(equalrates.best(equalrates.scores(sites, cheap), 0.99))
                logl = equalrates.scores(sites, costly)[row, edge]
                ids = part.column("seq_id").to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(numbers[edge]), pa.array(logl)], ["query", "edge", "logl"])

    scored = rows.select("seq_id", "sites").mapInArrow(run, "query long, edge long, logl double")
    kept = selection.filter_placements(selection.with_weights(scored), 0.01, 1, 7)
    return kept.select(F.col("query").alias("seq_id"), "edge", "logl", "lwr")


# A rooted tree over the nations' first letters: fixed, so that the kernel has something to stand on.
TREE = "((N0:0.11,(N1:0.2,N2:0.15):0.08):0.05,((N3:0.3,N4:0.12):0.07,(N5:0.18,(N6:0.22,N7:0.09):0.06):0.1):0.04);"


def small_reference(spark: SparkSession, sf_dir: str) -> Reference:
    """The tree above with the sequences of eight nations."""
    rows = {f"N{r['edge']}": r["lower"] for r in inputs.edge_sequences(spark, sf_dir).where("edge < 8").collect()}
    return Reference(Tree(TREE), parse_model("GTR{1.2/3.1/0.9/1.1/3.4/1.0}+FC+G4{0.6}"), rows)


@query()
def place_thorough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline with the numeric kernel on every sequence of the alignment; no SQL can say this."""
    placed = placement.place(inputs.alignment(spark, sf_dir).select("seq_id", "label", "sites"), small_reference(spark, sf_dir))
    return rounded(placement.exploded(placed), *jplace.FIELDS[1:], digits=6)


# --- documents and trees ---------------------------------------------------------------------------------


@query(f"""
WITH {PAIRS} SELECT query, '{{"p": [' || string_agg(printf('[%d, %.10f, %.10f, %.10f, %.10f]', edge, logl, round(lwr, 9), 0.5e0, 0.25e0), ', ' ORDER BY lwr DESC, edge)
  || '], "n": ["q' || query || '"]}}' AS json FROM ranked WHERE rn <= 3 GROUP BY query
""")
def jplace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.select_by(selection.with_weights(inputs.pairs(spark, sf_dir)), lambda rn, lwr: rn <= 3)
    item = F.struct(
        F.col("rn"),
        F.col("edge").alias("edge_num"),
        F.col("logl").alias("likelihood"),
        F.round("lwr", 9).alias("like_weight_ratio"),
        F.lit(0.5).alias("distal_length"),
        F.lit(0.25).alias("pendant_length"),
    )
    placed = rows.groupBy("query").agg(F.sort_array(F.collect_list(item)).alias("p"))
    named = placed.withColumn("names", F.array(F.concat(F.lit("q"), F.col("query").cast("string"))))
    return named.select("query", jplace.pquery_text().alias("json"))


# Written by hand from the tree above: edges in postorder, the two at the root joined.
_EDGE_VALUES = """
(0, 'N0', 0.11, true), (1, 'N1', 0.2, true), (2, 'N2', 0.15, true), (3, '', 0.08, false), (4, 'N3', 0.3, true),
(5, 'N4', 0.12, true), (6, '', 0.07, false), (7, 'N5', 0.18, true), (8, 'N6', 0.22, true), (9, 'N7', 0.09, true),
(10, '', 0.06, false), (11, '', 0.1, false), (12, '', 0.05 + 0.04, false)"""
_EDGE_ROWS = f"(VALUES {_EDGE_VALUES}) t(edge, label, length, tip)"


@query(f"SELECT edge::INT AS edge, label, round(length::DOUBLE, 9) AS length, tip FROM {_EDGE_ROWS}")
def edge_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [r[:4] for r in Tree(TREE, False).rows()]
    return rounded(spark.createDataFrame(rows, "edge int, label string, length double, tip boolean"), "length")


@query(f"SELECT count(*) AS edges, count_if(tip)::BIGINT AS tips, round(sum(length::DOUBLE), 9) AS total FROM {_EDGE_ROWS}")
def tree_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = Tree(TREE, False)
    return spark.createDataFrame([(tree.n_edges, len(tree.tips), round(tree.total_length, 9))], "edges long, tips long, total double")


def _candidate_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, p): the placements of each query as the kernel hands them on, without weights."""
    zero = F.lit(0.0)
    item = F.struct(
        F.col("edge").cast("int").alias("edge_num"),
        F.col("logl").alias("likelihood"),
        zero.alias("like_weight_ratio"),
        (F.col("edge") / 1000.0).alias("distal_length"),
        zero.alias("pendant_length"),
    )
    return inputs.pairs(spark, sf_dir).groupBy("query").agg(F.collect_list(item).alias("p"))


def _array_rows(rows: DataFrame) -> DataFrame:
    placed = rows.select("query", F.posexplode("p").alias("k", "x"))
    found = placed.select("query", F.col("x.edge_num").cast("long").alias("edge"), (F.col("k") + 1).cast("long").alias("rn"), "x.like_weight_ratio")
    return rounded(found.withColumnRenamed("like_weight_ratio", "lwr"), "lwr")


@query(f"WITH {PAIRS} {_COLUMNS} (lwr > 0.01 AND rn <= 7) OR rn <= 1")
def kernel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and output filter on arrays, as a run applies them."""
    rows = _candidate_arrays(spark, sf_dir).withColumn("p", placement.weighted(F.col("p")))
    return _array_rows(rows.withColumn("p", placement.filtered(F.col("p"), placement.Options())))


@query(f"WITH {PAIRS} {_COLUMNS} (before < 0.9 AND rn <= 5) OR rn <= 2")
def kernel_filter_by_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = placement.Options(by_sum=True, support_threshold=0.9, filter_min=2, filter_max=5)
    rows = _candidate_arrays(spark, sf_dir).withColumn("p", placement.weighted(F.col("p")))
    return _array_rows(rows.withColumn("p", placement.filtered(F.col("p"), options)))


@query(f"""
WITH {PAIRS}, placed AS (SELECT query, edge, edge / 1000e0 AS distal FROM pairs WHERE edge < 13
  UNION ALL SELECT query, 12, 0.03 + edge / 2000e0 FROM pairs WHERE edge < 97)
SELECT query, CASE WHEN edge < 4 THEN edge WHEN edge < 12 THEN edge + 1 WHEN distal > 0.04 THEN 4 ELSE 13 END AS edge,
  round(CASE WHEN edge = 12 AND distal > 0.04 THEN 0.05e0 - (distal - 0.04e0) ELSE distal END, 9) AS distal FROM placed
""")
def kernel_rooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placements on the tree above in the numbers of its rooted form, on arrays. Edge 12 holds the root."""
    pairs = inputs.pairs(spark, sf_dir)
    rows = pairs.where("edge < 13").select("query", "edge", (F.col("edge") / 1000.0).alias("distal"))
    rows = rows.unionByName(pairs.select("query", F.lit(12).cast("long").alias("edge"), (0.03 + F.col("edge") / 2000.0).alias("distal")))
    none = F.lit(0.0)
    fields = none.alias("likelihood"), none.alias("like_weight_ratio"), F.col("distal").alias("distal_length"), none.alias("pendant_length")
    rows = rows.select("query", F.array(F.struct(F.col("edge").cast("int").alias("edge_num"), *fields)).alias("p"))
    moved = rows.withColumn("p", placement.rooted(F.col("p"), small_reference(spark, sf_dir)))
    return rounded(moved.select("query", F.col("p")[0]["edge_num"].cast("long").alias("edge"), F.col("p")[0]["distal_length"].alias("distal")), "distal")


def _change(length: str, a: str, b: str) -> str:
    """SQL: probability of b after a along a length, all changes being equally likely."""
    return f"(CASE WHEN {a} = {b} THEN 0.25e0 + 0.75e0 * exp(-4e0 * ({length}) / 3e0) ELSE 0.25e0 - 0.25e0 * exp(-4e0 * ({length}) / 3e0) END)"


@query(f"""
WITH {ALN}, {EDGES}, tips AS (SELECT edge, lower, length FROM edges WHERE edge < 3),
cells AS (  -- a symbol in the middle of an edge of the tree of three tips
  SELECT o.edge, pos, q.s AS symbol, ln(sum(0.25e0 * {_change("o.length / 2", "x.s", "substr(o.lower, pos::INT, 1)")}
    * {_change(repr(DEFAULT_LENGTH), "x.s", "q.s")} * {_change("o.length / 2", "x.s", "y.s")}
    * {_change("b.length", "y.s", "substr(b.lower, pos::INT, 1)")} * {_change("c.length", "y.s", "substr(c.lower, pos::INT, 1)")})) AS logl
  FROM tips o JOIN tips b ON b.edge <> o.edge JOIN tips c ON c.edge > b.edge AND c.edge <> o.edge,
    (SELECT unnest(range(1, {WIDTH} + 1)) AS pos), (SELECT unnest(['A', 'C', 'G', 'T']) AS s) q,
    (SELECT unnest(['A', 'C', 'G', 'T']) AS s) x, (SELECT unnest(['A', 'C', 'G', 'T']) AS s) y
  GROUP BY 1, 2, 3
), letters AS (SELECT seq_id, unnest(range(1, {WIDTH} + 1)) AS pos, sites FROM aln)
SELECT seq_id, edge, round(sum(logl), 6) AS logl FROM letters JOIN cells USING (pos)
WHERE symbol = substr(sites, pos::INT, 1) GROUP BY 1, 2
""")
def kernel_prescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel's table of insertions and its matrix product, on a tree small enough for SQL."""
    import numpy as np
    import pyarrow as pa

    tips = {r["edge"]: r for r in inputs.edge_sequences(spark, sf_dir).where("edge < 3").collect()}
    newick = "(" + ",".join(f"T{e}:{tips[e]['length']!r}" for e in range(3)) + ");"
    reference = Reference(Tree(newick), parse_model("JC"), {f"T{e}": r["lower"] for e, r in tips.items()})
    shared = spark.sparkContext.broadcast(reference.lookup())

    def run(batches):
        prescore = Prescorer(shared.value, 4)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                scores = prescore(encode(part.column("sites").to_pylist(), 4))
                ids = np.repeat(part.column("seq_id").to_numpy(), scores.shape[1])
                edges = np.tile(np.arange(scores.shape[1]), len(scores))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(edges), pa.array(scores.ravel())], ["seq_id", "edge", "logl"])

    rows = inputs.alignment(spark, sf_dir).select("seq_id", "sites")
    return rounded(rows.mapInArrow(run, "seq_id long, edge long, logl double"), "logl", digits=6)


@query("""
SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x)), ', ') AS joined,
  length(string_split(p_name, ' '))::INT AS parts, printf('%.10f', p_retailprice) AS price FROM part
""")
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splitting with empty parts kept, joining with commas, fixed decimals."""
    parts = texts.split_all(F.col("p_name"), " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        texts.joined(F.transform(parts, F.upper)).alias("joined"),
        F.size(parts).alias("parts"),
        texts.fixed(F.col("p_retailprice")).alias("price"),
    )


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over time: an extension, as the batch form of the streaming query."""
    from cladeflow.streaming.stream import event_counts

    return rounded(event_counts(table(spark, sf_dir, "events")), "total", digits=4)
