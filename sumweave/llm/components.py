"""Connected components by alternating stars (Kiveris et al., 2014), as joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _least(edges: DataFrame, to: str) -> DataFrame:
    """For each u of edges (u, v): the least of u and its v."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias(to))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both, "m"), "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down, "m")
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


#: So many edges are one task's work at most, about 200 MB as strings of 32 characters.
FEW = 500_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            up.setdefault(u, u)
            up.setdefault(v, v)
            a, c = root(u), root(v)
            if a != c:
                up[max(a, c)] = min(a, c)
    nodes = list(up)
    for k in range(0, len(nodes), 10_000):
        part = nodes[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([root(x) for x in part])], names=["node", "component"])


def components_of_few(edges: DataFrame, few: int = FEW) -> DataFrame:
    """As components(), with one pass in one task where there are `few` edges at most; each star round costs several
    shuffles, which small graphs don't need. More edges take the star rounds; the result is the same."""
    now = written(edges.select("u", "v").where("u is not null and v is not null and u != v"))
    if now.count() > few:
        return components(now)
    kind = edges.schema["u"].dataType.simpleString()
    return now.coalesce(1).mapInArrow(_union_find, f"node {kind}, component {kind}")


def components(edges: DataFrame) -> DataFrame:
    """edges: columns u, v of one orderable type. Returns node, component (the least node that it is linked to).

    Nulls, loops and repeated edges count for nothing; no edges give no rows. Each round is written to the shared folder,
    and the driver gets a count and a checksum of it. A hub costs a partial minimum and a join that can be split.
    """
    kind = edges.schema["u"].dataType
    now = written(edges.select("u", F.col("v").cast(kind).alias("v")).where("u is not null and v is not null and u != v").distinct())
    mark = _mark(now)
    while mark[0]:
        after = written(_small_star(_large_star(now)).where("u != v").distinct())
        then = _mark(after)
        drop_written(now)
        now = after
        if then == mark:
            break
        mark = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
