"""From a join plan to one DataFrame: filtered leaves, inner equality joins, one global row of sums."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.unsigned import I64_MAX, from_limbs, limbs, literal
from ..plans.planner import JoinPlan
from ..plans.spec import ColumnRef, Filter, QuerySpec
from ..plans.stats import ColumnStats


def condition(f: Filter, kind: T.DataType) -> Column:
    """A comparison that reaches the scan: longs are compared with longs. No long is above 2**63 - 1."""
    c = F.col(f.column.name)
    if f.constant > I64_MAX and not isinstance(kind, T.DecimalType):
        return F.lit(f.op == "<")
    k = literal(f.constant)
    return {"<": c < k, ">": c > k, "=": c == k}[f.op]


def leaf(spec: QuerySpec, binding: int, frame: DataFrame) -> DataFrame:
    """The binding's needed columns, b<i>_c<j>, after its filters and equalities within a row."""
    refs = [ColumnRef(binding, c) for c in spec.columns_of(binding)]
    # a binding that only multiplies rows keeps one column
    df = frame.select(*(F.col(f"c{r.column}").alias(r.name) for r in refs)) if refs else frame.select(F.lit(1).alias(f"b{binding}_"))
    for f in spec.filters:
        if f.column.binding == binding:
            df = df.where(condition(f, df.schema[f.column.name].dataType))
    for j in spec.joins:
        if j.left.binding == j.right.binding == binding:
            df = df.where(F.col(j.left.name) == F.col(j.right.name))
    return df


def joined(spec: QuerySpec, plan: JoinPlan, frames: list[DataFrame]) -> DataFrame:
    """Inner joins in the plan's order; all predicates that link a relation to those before are keys of its join. How a
    join runs is left to Spark's own size checks and adaptive execution."""
    out = None
    for step in plan.steps:
        right = leaf(spec, step.binding, frames[step.binding])
        if out is None:
            out = right
        elif not step.joins:
            out = out.crossJoin(right)
        else:
            out = out.join(right, reduce(lambda a, b: a & b, (F.col(j.left.name) == F.col(j.right.name) for j in step.joins)), "inner")
    return out


def sums(spec: QuerySpec, rows: DataFrame, stats: dict[ColumnRef, ColumnStats] | None = None, zero_is_null: bool = True, signed: bool = False) -> DataFrame:
    """One row s0, s1, ...: each selection's sum. A column that is selected twice is summed once."""
    parts, high = {}, {}
    for c in dict.fromkeys(spec.selections):
        if stats and c in stats:
            high[c] = stats[c].high
        parts[c] = limbs(F.col(c.name), rows.schema[c.name].dataType, high.get(c))
    totals = rows.agg(*(F.sum(x).alias(f"{c.name}_{k}") for c, xs in parts.items() for k, x in enumerate(xs)), *(F.max(c.name).alias(f"{c.name}_high") for c in high))

    def total(c: ColumnRef) -> Column:
        out = from_limbs([F.col(f"{c.name}_{k}") for k in range(len(parts[c]))], zero_is_null, signed)
        # fewer limbs are only right while the known maximum is
        return F.when(F.col(f"{c.name}_high") > F.lit(high[c]), F.raise_error(F.lit(f"{c} has values above its known maximum {high[c]}; register the relation anew"))).otherwise(out) if c in high else out

    return totals.select(*(total(c).alias(f"s{i}") for i, c in enumerate(spec.selections)))


def null_row(spec: QuerySpec, frame: DataFrame, signed: bool = False) -> DataFrame:
    """The answer of a query without rows, from no job at all."""
    kind = "long" if signed else "decimal(20,0)"
    return frame.sparkSession.range(1).select(*(F.lit(None).cast(kind).alias(f"s{i}") for i in range(len(spec.selections))))


def eager_sums(spec: QuerySpec, plan: JoinPlan, frames: list[DataFrame], zero_is_null: bool = True, signed: bool = False) -> DataFrame:
    """The same row by eager aggregation (Yan and Larson, 1995): each leaf is first reduced to a row for each combination
    of its join columns, with a count and the sums of its selected columns. Joins then multiply counts instead of rows."""
    modulus = F.lit(Decimal(1 << 64)).cast("decimal(20,0)")

    def mod(c: Column) -> Column:
        return F.pmod(c.cast("decimal(38,0)"), modulus).cast("decimal(20,0)")

    out, done = None, []
    for step in plan.steps:
        b = step.binding
        keys = sorted({c.name for j in spec.joins for c in (j.left, j.right) if c.binding == b})
        own = [c for c in dict.fromkeys(spec.selections) if c.binding == b]
        part = leaf(spec, b, frames[b]).groupBy(*keys).agg(F.count(F.lit(1)).cast("decimal(18,0)").alias(f"n{b}"), *(mod(F.sum(F.col(c.name).cast("decimal(20,0)"))).alias(f"t_{c.name}") for c in own))
        if out is None:
            out = part
        elif step.joins:
            out = out.join(part, reduce(lambda x, y: x & y, (F.col(j.left.name) == F.col(j.right.name) for j in step.joins)), "inner")
        else:
            out = out.crossJoin(part)
        done.append(b)
    totals = []
    for c in dict.fromkeys(spec.selections):
        product = F.col(f"t_{c.name}")
        for b in done:
            if b != c.binding:
                product = mod(product * F.col(f"n{b}"))
        totals.append(F.sum(product).alias(f"{c.name}_0"))
    return out.agg(*totals).select(*(from_limbs([F.col(f"{c.name}_0")], zero_is_null, signed).alias(f"s{i}") for i, c in enumerate(spec.selections)))
