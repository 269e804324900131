"""Column statistics: one aggregate over a relation, kept until the relation changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ColumnStats:
    rows: int
    low: int
    high: int
    distinct: int


def stats_frame(df: DataFrame, exact: bool = False) -> DataFrame:
    """A row for each column: column, rows, low, high, distinct (exact, or by HyperLogLog)."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in df.columns:
        aggs += [F.min(c).alias(f"{c}_low"), F.max(c).alias(f"{c}_high"), distinct(c).alias(f"{c}_distinct")]
    wide = df.agg(*aggs)
    each = [F.struct(F.lit(i).alias("column"), F.col("rows"), *(F.col(f"{c}_{x}").cast("decimal(20,0)").alias(x) for x in ("low", "high", "distinct"))) for i, c in enumerate(df.columns)]
    return wide.select(F.inline(F.array(*each)))


class StatsStore:
    """Statistics by relation and column. One aggregate reads the columns that a plan asks for and that aren't known yet;
    they are kept until the relation is registered anew."""

    def __init__(self):
        self._kept: dict[int, tuple[DataFrame, dict[int, ColumnStats]]] = {}

    def get(self, relation: int, df: DataFrame, columns: list[int]) -> dict[int, ColumnStats]:
        if relation not in self._kept or self._kept[relation][0] is not df:
            self._kept[relation] = df, {}
        known = self._kept[relation][1]
        missing = [c for c in columns or [0] if c not in known]
        if missing:
            rows = stats_frame(df.select(*(f"c{c}" for c in missing))).collect()  # a row for each column
            known |= {missing[r["column"]]: ColumnStats(r["rows"], int(r["low"] or 0), int(r["high"] or 0), max(1, int(r["distinct"]))) for r in rows}
        return known
