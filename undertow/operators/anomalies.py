"""Anomaly score and flag for every row: isolation forest plus z-scores, or z-scores alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.functions.cells import column, number
from undertow.operators.forest import contamination, grow_forest, isolation_score
from undertow.operators.quantiles import exact_quantiles
from undertow.operators.statistics import TableStats, imputed
from undertow.session import written

FOREST = "isolation-forest"
ZSCORE = "zscore-ensemble"
TOP_ROWS = 25
# Columns added to the table; the names leave a table's own "score" alone.
SCORE, ZMAX, FLAG = "anomaly_score", "anomaly_zmax", "is_anomaly"
RAW = "_isolation"
RESCUE_SCORE = 0.55


@dataclass(frozen=True)
class Scoring:
    """Expressions over the input columns: nothing is attached or joined until asked.

    `any_flagged` and `best` (an upper bound of the scores) are known without another scan.
    """

    method: str
    score: Column
    zmax: Column
    is_anomaly: Column
    any_flagged: bool
    best: float

    def attach(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {SCORE: self.score, ZMAX: self.zmax, FLAG: self.is_anomaly}
        )


def zmax(stats: TableStats, columns: list[str]) -> Column:
    """Largest distance from the mean in deviations; gaps and constant columns count as 0."""
    distances = [
        F.coalesce(F.abs((number(n) - F.lit(stats[n].mean)) / F.lit(stats[n].spread)), F.lit(0.0))
        for n in columns
        if stats[n].spread
    ]
    return F.greatest(F.lit(0.0), F.lit(0.0), *distances)


def farthest_zscore(stats: TableStats, columns: list[str]) -> float:
    """The table's largest z-score, from each column's extremes."""
    ends = [
        abs((end - c.mean) / c.spread)
        for c in (stats[n] for n in columns)
        if c.spread
        for end in (c.low, c.high)
    ]
    return max(ends, default=0.0)


def _clipped(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def zscore_scoring(stats: TableStats, columns: list[str]) -> Scoring:
    distance = zmax(stats, columns)
    farthest = farthest_zscore(stats, columns)
    best = min(farthest / 4, 1.0)
    return Scoring(ZSCORE, _clipped(distance / 4), distance, distance > 3, farthest > 3, best)


def forest_scoring(
    df: DataFrame, stats: TableStats, columns: list[str], row_id: str, seed: int = 42
) -> tuple[DataFrame, Scoring]:
    """The table with its raw scores, written once, and the scoring built on them.

    Scoring a row walks 100 trees, so it happens once; the range and the cut are found over all rows
    of what was written, and every later use reads it.
    """
    forest = grow_forest(df, stats, columns, row_id, seed)
    raw = isolation_score(forest, imputed(stats, columns))
    scored = written(df.select("*", raw.alias(RAW)), "scores")
    share = 1 - contamination(stats.rows)
    low, cut, high = exact_quantiles(scored, {RAW: stats.rows}, (0.0, share, 1.0))[RAW]
    raw = F.col(RAW)
    scaled = (raw - F.lit(low)) / F.lit(high - low) if high > low else raw
    distance = zmax(stats, columns)
    score = _clipped(F.lit(0.7) * scaled + F.lit(0.3) * _clipped(distance / 4))
    return scored, Scoring(FOREST, score, distance, raw > F.lit(cut), high > cut, 1.0)


def score_rows(
    df: DataFrame,
    stats: TableStats,
    row_id: str,
    columns: list[str] | None = None,
    method: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """The table with `anomaly_score` (0..1), `anomaly_zmax` and `is_anomaly` per row."""
    names = stats.numeric if columns is None else columns
    if method is None:
        method = FOREST if len(names) >= 2 and stats.rows >= 10 else ZSCORE
    if method == FOREST:
        df, scoring = forest_scoring(df, stats, names, row_id, seed)
    else:
        scoring = zscore_scoring(stats, names)
    scored = scoring.attach(df).drop(RAW)
    if scoring.any_flagged or scoring.best <= RESCUE_SCORE or not stats.rows:
        return scored
    return rescue(scored, stats.rows, row_id)


def highest_first(row_id: str) -> list[Column]:
    """By score, then row id. The last digits of a score depend on the order rows were summed in,
    so scores equal to nine decimals count as ties."""
    return [F.desc(F.round(SCORE, 9)), column(row_id)]


def rescue(scored: DataFrame, rows: int, row_id: str) -> DataFrame:
    """Flag the top few rows of a table with no flagged row, if the best score is high."""
    most = max(1, min(5, rows // 20))
    top = scored.select(column(row_id), SCORE).orderBy(*highest_first(row_id))
    found = top.limit(most).collect()
    if not found or found[0][SCORE] <= RESCUE_SCORE:
        return scored
    return scored.withColumn(FLAG, column(row_id).isin([row[0] for row in found]))


def top_rows(
    scored: DataFrame, row_id: str, most: int | None = TOP_ROWS, keep: int = 10
) -> DataFrame:
    """The highest scores with the first columns; low ones stay only when flagged."""
    added = (SCORE, ZMAX, FLAG)
    shown = [c for c in scored.columns if c not in added and c != row_id][:keep]
    ordered = scored.select(column(row_id), *added, *[column(c) for c in shown]).orderBy(
        *highest_first(row_id)
    )
    return (
        (ordered if most is None else ordered.limit(most))
        .where((F.col(SCORE) >= 0.45) | F.col(FLAG))
        .withColumn(SCORE, F.round(SCORE, 3))
        .withColumn(ZMAX, F.round(ZMAX, 2))
    )


def anomaly_summary(scored: DataFrame, method: str) -> DataFrame:
    """One row: method, flagged rows, their share in percent."""
    flagged = F.count_if(FLAG)
    return scored.agg(
        F.lit(method).alias("method"),
        flagged.alias("anomaly_count"),
        F.round(flagged / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100, 1).alias("anomaly_pct"),
    )
