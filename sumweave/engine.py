"""Runs queries: parse, normalise, plan, compile; render a line."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .catalog import Catalog
from .operators.compile import eager_sums, joined, null_row, sums
from .plans.normalize import normalize
from .plans.parse import parse
from .plans.planner import JoinPlan, plan
from .plans.spec import ColumnRef, QuerySpec


def render(row: Row | Iterable) -> str:
    """A result line: sums divided by spaces, NULL for null."""
    return " ".join("NULL" if v is None else str(int(v)) for v in row)


class Engine:
    """order: `stats` plans joins of three relations and more by statistics, `written` takes the first connected order as
    written. eager: aggregate leaves before joins; None: where some join is estimated to make more rows than all inputs
    have. zero_is_null: a sum of 0 is null, like that of no rows."""

    def __init__(self, catalog: Catalog, order: str = "stats", eager: bool | None = False, zero_is_null: bool = True, allow_cross: bool = False):
        if order not in ("stats", "written"):
            raise ValueError(f"order is stats or written, not {order!r}")
        self.catalog = catalog
        self.order, self.eager, self.zero_is_null, self.allow_cross = order, eager, zero_is_null, allow_cross

    def spec(self, query: str | QuerySpec) -> QuerySpec:
        """The normalised query; raises for relations and columns that don't exist."""
        spec = normalize(parse(query) if isinstance(query, str) else query)
        for b, r in enumerate(spec.relations):
            self.catalog.check(r, spec.columns_of(b))
        return spec

    def plan(self, query: str | QuerySpec) -> JoinPlan:
        spec = self.spec(query)
        return plan(spec, self._stats(spec), self.allow_cross)

    def cost(self, query: str | QuerySpec) -> float:
        """Estimated rows that the query reads and makes, by statistics, whatever the number of relations."""
        spec = self.spec(query)
        return 0.0 if spec.empty else plan(spec, self._known(spec), self.allow_cross).cost

    def _stats(self, spec: QuerySpec):
        # with two relations there is one order, and Spark picks the sides
        least = 2 if self.eager is None else 3
        if self.order == "written" or len(spec.relations) < least or spec.empty:
            return None
        return self._known(spec)

    def _known(self, spec: QuerySpec):
        return [self.catalog.stats.get(r, self.catalog.frame(r), spec.columns_of(b)) for b, r in enumerate(spec.relations)]

    def query(self, query: str | QuerySpec, signed: bool = False) -> DataFrame:
        """One row s0, s1, ...: decimal(20,0), or long if signed."""
        spec = self.spec(query)
        frames = [self.catalog.frame(r) for r in spec.relations]
        stats = self._stats(spec)
        steps = plan(spec, stats, self.allow_cross)
        if spec.empty:
            return null_row(spec, frames[0], signed)
        inputs = sum(next(iter(s.values())).rows for s in stats) if stats else 0
        if self.eager or self.eager is None and stats and max(s.rows for s in steps.steps) > inputs:
            return eager_sums(spec, steps, frames, self.zero_is_null, signed)
        known = {ColumnRef(b, c): s for b, cols in enumerate(stats) for c, s in cols.items()} if stats else None
        return sums(spec, joined(spec, steps, frames), known, self.zero_is_null, signed)

    def run(self, query: str | QuerySpec) -> str:
        return render(self.query(query).first())

    def sql(self, query: str | QuerySpec) -> str:
        """The query as given, in SQL."""
        return (parse(query) if isinstance(query, str) else query).to_sql(zero_is_null=self.zero_is_null)

    def explain(self, query: str | QuerySpec) -> str:
        """The normalised query, the join order with estimates, and Spark's plan."""
        df = self.query(query)
        spark_plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return f"{self.spec(query).to_text()}\n{self.plan(query).describe()}\n{spark_plan}"

    def batch_frame(self, queries: Iterable[str | QuerySpec]) -> DataFrame:
        """ordinal and line of each query, as one Spark job: a union of one-row sums."""
        out = None
        for i, q in enumerate(queries):
            df = self.query(q)
            line = F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in df.columns))
            row = df.select(F.lit(i).cast("long").alias("ordinal"), line.alias("line"))
            out = row if out is None else out.unionByName(row)
        if out is None:
            return self.catalog.spark.createDataFrame([], "ordinal long, line string")
        return out

    def batch(self, lines: Iterable[str], threads: int = 4) -> list[str]:
        """Answers of all queries of a stream of lines, in order; see BatchSession."""
        from .streaming.batch import BatchSession

        with BatchSession(self, threads) as session:
            out = [x for line in lines for x in session.feed(line)]
        return out + session.rest
