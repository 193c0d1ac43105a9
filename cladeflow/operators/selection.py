"""Likelihood weights and candidate selection over placements (query, edge, logl)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def per_query() -> WindowSpec:
    return Window.partitionBy("query")


def with_weights(rows: DataFrame) -> DataFrame:
    """Adds ``lwr``, the softmax of logl within each query, shifted by the maximum."""
    shifted = F.exp(F.col("logl") - F.max("logl").over(per_query()))
    return rows.withColumn("__e", shifted).withColumn("lwr", F.col("__e") / F.sum("__e").over(per_query())).drop("__e")


def ranked(rows: DataFrame, by: str = "lwr") -> DataFrame:
    """Adds ``rn``, the place within the query; ties go to the smaller edge."""
    order = Window.partitionBy("query").orderBy(F.desc(by), "edge")
    return rows.withColumn("rn", F.row_number().over(order).cast("long"))


def top_percent(rows: DataFrame, share: float) -> DataFrame:
    """The first ceil(share * n) of each query."""
    _unit(share)
    counted = ranked(rows).withColumn("__n", F.count("*").over(per_query()))
    return counted.where(F.col("rn") <= F.ceil(F.lit(share) * F.col("__n"))).drop("__n")


def without_bottom(rows: DataFrame, share: float) -> DataFrame:
    return top_percent(rows, 1.0 - share)


def accumulated(rows: DataFrame, threshold: float, least: int = 1, most: int | None = None) -> DataFrame:
    """Best rows until their weights reach the threshold (the row that crosses it included), least and most."""
    _unit(threshold)
    _bounds(least, most)
    before = Window.partitionBy("query").orderBy(F.desc("lwr"), "edge").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranked(rows).withColumn("__before", F.round(F.coalesce(F.sum("lwr").over(before), F.lit(0.0)), 12))
    wanted = F.col("__before") < threshold
    if most is not None:
        wanted &= F.col("rn") <= most
    return summed.where(wanted | (F.col("rn") <= least)).drop("__before")


def supported(rows: DataFrame, threshold: float, least: int = 1, most: int | None = None) -> DataFrame:
    """Rows with a weight above the threshold, least and most."""
    _unit(threshold)
    _bounds(least, most)
    wanted = F.col("lwr") > threshold
    if most:
        wanted &= F.col("rn") <= most
    return ranked(rows).where(wanted | (F.col("rn") <= least))


def strike_box(rows: DataFrame, box: float = 3.0, strikes: int = 6, pitches: int = 40) -> DataFrame:
    """Rows within ``box`` of the best logl, and up to ``strikes`` more while fewer than ``pitches`` are seen."""
    best = rows.withColumn("__best", F.max("logl").over(per_query()))
    hits = F.count_if(F.col("logl") >= F.col("__best") - box).over(per_query())
    counted = ranked(best, by="logl").withColumn("__hits", hits)
    more = F.least(F.greatest(F.lit(pitches) - F.col("__hits"), F.lit(0)), F.lit(strikes))
    return counted.where(F.col("rn") <= F.col("__hits") + more).drop("__hits", "__best")


def best_edge(rows: DataFrame) -> DataFrame:
    """The best row of each query, by a grouped maximum."""
    best = F.max_by(F.struct("edge", "logl"), F.struct("logl", -F.col("edge"))).alias("best")
    return rows.groupBy("query").agg(best).select("query", "best.edge", "best.logl")


def select_candidates(rows: DataFrame, heuristic: str = "dynamic", threshold: float = 0.99999) -> DataFrame:
    """Candidates by name: strike_box, fixed (a share of all) or dynamic (accumulated weight)."""
    rules: dict[str, Callable[[], DataFrame]] = {
        "strike_box": lambda: strike_box(rows),
        "fixed": lambda: top_percent(with_weights(rows), threshold),
        "dynamic": lambda: accumulated(with_weights(rows), threshold),
    }
    if heuristic not in rules:
        raise ValueError(f"no heuristic {heuristic!r}")
    return rules[heuristic]()


def filter_placements(
    rows: DataFrame, threshold: float = 0.01, least: int = 1, most: int = 7, by_sum: bool = False
) -> DataFrame:
    """The output filter: by accumulated weight or by each row's weight."""
    return accumulated(rows, threshold, least, most) if by_sum else supported(rows, threshold, least, most)


def select_by(rows: DataFrame, rule: Callable[[Column, Column], Column]) -> DataFrame:
    """A rule of one's own: from rank and weight to whether a row stays."""
    return ranked(rows).where(rule(F.col("rn"), F.col("lwr")))


def two_phase(
    rows: DataFrame,
    cheap: Callable[[DataFrame], DataFrame],
    choose: Callable[[DataFrame], DataFrame],
    costly: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """A cheap score of all pairs, a choice within each query, and a costly score of what is left."""
    return costly(choose(cheap(rows)))


def _unit(x: float) -> None:
    if not 0.0 <= x <= 1.0:
        raise ValueError("the threshold must lie in [0, 1]")


def _bounds(least: int, most: int | None) -> None:
    if least < 1:
        raise ValueError("at least one row must stay")
    if most and least > most:
        raise ValueError("the minimum exceeds the maximum")
