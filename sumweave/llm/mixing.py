"""Mixing sources to target weights by the cube method: balanced sampling of fractional inclusion probabilities."""

from __future__ import annotations

import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, any_over, copies, drop_written, whole_row, written

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix's size against that of all documents, and the most that a source is repeated.
SHARE, MOST = 1.5, 2.0
#: Documents that one flight holds.
BLOCK = 2048
#: Up to so many sources are ranked in one task and broadcast; more are ranked by ranges and joined, with the same result.
FEW_SOURCES = 100_000
_SEED = 20240229


def level(total: float, capped: Callable[[float], tuple[float, float]], share: float = SHARE) -> float:
    """The level x at which the sources' shares, x times their weights or the most they may have, add up to share * total.
    capped(x): the weights of the sources that aren't full at x, and what full ones have. Each step shares anew what the
    sources that the last level fills leave over, so levels rise until none is filled."""
    x = -1.0
    while True:
        weights, full = capped(x)
        then = (share * total - full) / weights if weights else x
        if then <= x:
            return x
        x = then


def targets(sizes: list[float], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Shares by weight of share times all sizes; none over most times its size, and the excess is shared anew."""
    if not sizes:
        return []

    def capped(x: float) -> tuple[float, float]:
        full = [x * w > most * s for s, w in zip(sizes, weights, strict=True)]
        return sum(w for w, f in zip(weights, full, strict=True) if not f), sum(most * s for s, f in zip(sizes, full, strict=True) if f)

    x = level(sum(sizes), capped, share)
    return [min(x * w, most * s) for s, w in zip(sizes, weights, strict=True)]


def flight(sizes: list[float], chance: list[float], rng: random.Random) -> list[float]:
    """Moves the chances until two at most are neither 0 nor 1. The sum of chances and that of sizes times chances hold,
    and each chance holds in expectation: a step runs along the null space of the two constraints for three documents,
    to one of its ends, with odds that make the step fair."""
    p = list(chance)
    live, i, n = [], 0, len(p)
    while True:
        while len(live) < 3 and i < n:
            if 1e-12 < p[i] < 1 - 1e-12:
                live.append(i)
            else:
                p[i] = float(round(p[i]))
            i += 1
        if len(live) == 3:
            a, b, c = live
            u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
        elif len(live) == 2 and sizes[live[0]] == sizes[live[1]]:
            u = (1.0, -1.0)
        else:
            return p
        up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(live, u, strict=True) if x)
        down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(live, u, strict=True) if x)
        step = up if rng.random() * (up + down) < down else -down
        for k, x in zip(live, u, strict=True):
            p[k] += step * x
            if p[k] < 1e-12 or p[k] > 1 - 1e-12:
                p[k] = float(round(p[k]))
        live = [k for k in live if 0 < p[k] < 1]


def land(sizes: list[float], chance: list[float]) -> list[float]:
    """Rounds the few chances that are left (two at most after a flight), nearest to their sum of sizes."""
    open_ = [k for k, x in enumerate(chance) if 0 < x < 1]
    want, best = sum(sizes[k] * chance[k] for k in open_), None
    for bits in range(1 << len(open_)):
        got = sum(sizes[k] for j, k in enumerate(open_) if bits >> j & 1)
        if best is None or (abs(got - want), bits) < best:
            best = (abs(got - want), bits)
    out = list(chance)
    for j, k in enumerate(open_):
        out[k] = float(best[1] >> j & 1)
    return out


def doc_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


_UNIT = "_key string, doc_id long, size long, source_no long, copy long, whole int, chance double, blocks long"


def _fly(block: pd.DataFrame) -> pd.DataFrame:
    block = block.drop(columns="_b").sort_values(["size", "_key", "copy"], ascending=[False, True, True], kind="stable").reset_index(drop=True)  # what stays open is small
    sizes = block["size"].astype(float).tolist()
    one = int(block["blocks"].iloc[0]) == 1
    rng = random.Random(f"{_SEED} {block['source_no'].iloc[0]} {block['_key'].iloc[0]} {len(block)}")
    chance = flight(sizes, block["chance"].tolist(), rng)
    block["chance"] = land(sizes, chance) if one else chance
    return block


def _ranked(sums: DataFrame, few: bool) -> DataFrame:
    """sums (source, s, n) with source_no: their place by code points (UTF-8 orders alike), null last."""
    last = F.col("source").isNull()
    if few:
        return sums.withColumn("source_no", F.row_number().over(Window.orderBy(last, "source")).cast("long") - 1)
    parts = written(sums.repartitionByRange(last, "source").withColumn("part", F.spark_partition_id()))
    ends, before = [], 0
    for r in parts.groupBy("part").agg(F.count("*").alias("k")).orderBy("part").collect():  # a row for each partition
        ends.append((r["part"], before))
        before += r["k"]
    first = sums.sparkSession.createDataFrame(ends, "part int, before long")
    return parts.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(last, "source"))).join(F.broadcast(first), "part").withColumn("source_no", F.col("before") + F.col("k") - 1)


def source_targets(units: DataFrame, few: int = FEW_SOURCES) -> tuple[DataFrame, bool]:
    """source_no, source, source_size, target, n of each source of the units; and whether they are `few`."""
    sums = written(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s"), F.sum("n").alias("n")))
    total, many = sums.agg(F.sum("s"), F.count("*")).first()
    weight = F.element_at(F.array(*map(F.lit, map(float, WEIGHTS))), (F.col("source_no") % len(WEIGHTS) + 1).cast("int"))
    ranked = written(_ranked(sums, many <= few).withColumn("w", weight).select("source_no", "source", "s", "n", "w"))
    if many <= few:
        rows = sorted(ranked.select("source_no", "s", "w").collect())
        aims = targets([r["s"] for r in rows], [r["w"] for r in rows])
        aim = ranked.sparkSession.createDataFrame([(r["source_no"], a) for r, a in zip(rows, aims, strict=True)], "source_no long, target double")
        found = ranked.join(F.broadcast(aim), "source_no")  # FEW_SOURCES rows at most
    else:

        def capped(x: float) -> tuple[float, float]:
            full = F.lit(x) * F.col("w") > MOST * F.col("s")
            return tuple(v or 0.0 for v in ranked.agg(F.sum(F.when(~full, F.col("w"))), F.sum(F.when(full, MOST * F.col("s")))).first())

        found = ranked.withColumn("target", F.least(F.lit(level(total, capped)) * F.col("w"), MOST * F.col("s")))
    return found.select("source_no", "source", F.col("s").alias("source_size"), "target", "n"), many <= few


def mix_units(units: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """units: _key, doc_id, source, size, n (so many alike), as a written table. Returns a row for each document, with
    source_no, size and times (how often the mix takes it); and the sources: source_no, source, source_size, target."""
    sources, few = source_targets(units, FEW_SOURCES)
    sources = written(sources)
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)  # FEW_SOURCES rows at most
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(MOST), F.col("target") / F.col("source_size"))).otherwise(0.0)
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("long").alias("blocks")
    plan = sources.select("source_no", F.col("source").alias("_s"), F.floor(ratio).cast("int").alias("whole"), (ratio - F.floor(ratio)).alias("chance"), blocks(F.col("n")))
    columns = ("_key", "doc_id", "size", "source_no", "copy", "whole", "chance", "blocks")
    now = copies(units.join(small(plan), units["source"].eqNullSafe(F.col("_s"))), "n", any_over(units, "n")).select(*columns)
    done = None
    while True:
        where = F.pmod(F.xxhash64(F.lit(_SEED), "_key", "copy"), F.col("blocks"))
        flown = written(now.withColumn("_b", where).groupBy("source_no", "_b").applyInPandas(_fly, _UNIT))
        fixed = flown.where("chance = 0 or chance = 1")
        done = fixed if done is None else done.unionByName(fixed)
        left = flown.where("chance > 0 and chance < 1")
        if left.isEmpty():
            break
        again = left.groupBy("source_no").agg(blocks(F.count("*")))
        now = left.drop("blocks").join(small(again), "source_no").select(*columns)
    taken = done.select("_key", "doc_id", "size", "source_no", "copy", (F.col("whole") + F.col("chance").cast("int")).alias("times"))
    return taken, small(sources.drop("n"))


def query(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text, source). Null text: size 0. Null source: a source of its own, the last.
    Repeated rows are documents of their own; they are counted first, then numbered, and spread over blocks. Ties of size
    within a block go by id. Other columns are left out; no documents give no rows. A very long text counts by its words,
    and is taken or not like others. Only ids, sizes and sources are shuffled; a source's documents are split into blocks,
    and what a block leaves open (two documents) flies again with what other blocks leave, until a source has one block,
    which lands."""
    units = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", doc_words(F.col("text")).alias("size"))
        .groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
        .withColumn("_key", F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "size"))
    )
    taken, sources = mix_units(units)
    return taken.join(sources, "source_no").select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it (0 to 2 times). Rows alike in all columns are numbered together,
    and one of them stands for all; texts are shuffled once."""
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns))
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64(row).cast("string"), F.xxhash64(F.lit(1), row).cast("string"))
    keyed = docs.select(whole_row(docs), key.alias("_key"), F.col("doc_id").cast("long").alias("doc_id"), "source", doc_words(F.col("text")).alias("size"))
    units = written(keyed.select("_key", "doc_id", "source", "size").groupBy("_key", "doc_id", "source", "size").agg(F.count("*").alias("n")))
    taken, _ = mix_units(units)
    times = written(taken.groupBy("_key").agg(F.sum("times").alias("times")).where("times > 0"))
    drop_written(units)
    # the aggregate deals the rows by key, and so they lie right for the join
    one = keyed.groupBy("_key").agg(F.first("row").alias("row"))
    return copies(one.join(times, "_key"), "times", any_over(times, "times")).select("row.*")
