"""The registered queries over the given tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from decimal import Decimal
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .engine import Engine
from .folders import new_folder
from .plans.parse import parse
from .plans.stats import stats_frame
from .sources.binary import read_binary, write_binary, write_parts
from .sources.tables import RELATIONS, catalog, duck_views
from .sources.text import export_relation, generated, read_tbl, write_tbl
from .streaming.batch import BatchSession
from .streaming.stream import answer_stream

#: Name and text of each query, over the relations of sources.tables.
TEXTS = {
    "join2_gt": "6 5|0.0=1.0&1.0>7500|0.5 1.2",
    "join3_chain_gt": "5 3 1|0.1=1.0&1.1=2.0&0.0>7000|0.0 1.1",
    "filter_lt": "6 4|0.1=1.0&0.4<10|0.5 1.1",
    "filter_eq": "5 3|0.1=1.0&1.1=7|0.2 1.0",
    "filter_gt": "9 8|0.0=1.0&1.1>500|1.1 0.1",
    "filter_range": "5 3|0.1=1.0&0.0>1000&0.0<5000|0.2",
    "filter_multi_column": "6 5|0.0=1.0&0.4>40&0.3<3&1.2>10000000|0.5 1.0",
    "join4_chain": "6 5 3 1|0.0=1.0&1.1=2.0&2.1=3.0&3.1=2|0.5 1.2 2.0",
    "join_star": "6 5 4 2|0.0=1.0&0.1=2.0&0.2=3.0&2.1<10|0.5 2.1 3.1",
    "join_self": "3 3|0.1=1.1|0.0 1.0",
    "join_composite_key": "6 6|0.0=1.0&0.1=1.1&0.3<3|0.4 1.4",
    "join_cycle": "2 3 1|0.1=1.1&1.1=2.0&2.0=0.1|0.0 1.0",
    "join_same_binding_eq": "6 5|0.0=1.0&0.3=0.4|0.5",
    "join_fanout": "7 5|0.1=1.1|0.2 1.2",
    "sum_multi": "6 5|0.0=1.0&0.4>25|0.4 0.5 1.3",
    "sum_repeated_column": "6 5|0.0=1.0&0.4=7|0.4 0.4 1.0",
    "sum_zero_is_null": "1 0|0.1=1.0&1.0<1|0.1 0.0",
    "sum_empty_is_null": "1 0|0.1=1.0&1.0>99|0.0",
    "norm_weak_filters": "5 3|0.1=1.0&0.0<9000&0.0<4000&0.0>10&0.0>100|0.0",
    "norm_contradiction_eq": "5 3|0.1=1.0&0.0<5&0.0=5|0.0",
    "norm_contradiction_range": "5 3|0.1=1.0&0.0>10&0.0<5|0.0",
    "norm_duplicate_predicate": "5 3|0.1=1.0&1.0=0.1&0.0<500|0.2",
    "single_relation_sum": "6|0.4>10&0.0<9000|0.5 0.4",
    "planned_order_equivalence": "1 3 5 6|3.0=2.0&2.1=1.0&1.1=0.0&3.4>45|3.5 2.2 0.1",
}
BATCH = ("join2_gt", "sum_zero_is_null", "filter_range", "join_cycle", "norm_contradiction_eq", "sum_repeated_column")


def _text(spark: SparkSession, sf_dir: str, text: str, **options) -> DataFrame:
    return Engine(catalog(spark, sf_dir), **options).query(text, signed=True)


def join_fanout_eager(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(spark, sf_dir, TEXTS["join_fanout"], eager=True)


def planned_order_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer in the planned and in the written order."""
    text = TEXTS["planned_order_equivalence"]
    written = _text(spark, sf_dir, text, order="written").select(F.lit("written").alias("plan"), "*")
    return _text(spark, sf_dir, text).select(F.lit("stats").alias("plan"), "*").unionByName(written)


def sum_unsigned_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of values near 2**64, modulo 2**64: 2**64 - 1 less the order key, joined with their customers."""
    c = Catalog(spark)
    high = F.lit(Decimal((1 << 64) - 1)).cast("decimal(20,0)")
    orders = catalog(spark, sf_dir).frame(5)
    c.register(orders.select((high - F.col("c0")).cast("decimal(20,0)").alias("c0"), "c1"))
    c.register(catalog(spark, sf_dir).frame(3))
    return Engine(c).query("0 1|0.1=1.0&0.0>9223372036854775808|0.0 1.1").select(F.col("s0").cast("string").alias("s0"), F.col("s1").cast("string").alias("s1"))


def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [stats_frame(catalog(spark, sf_dir).frame(i), exact=True).select(F.lit(i).alias("relation"), "column", "rows", *(F.col(x).cast("long").alias(x) for x in ("low", "high", "distinct"))) for i in (3, 5, 6)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def known_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and ranges as plans ask for them, a few columns at a time."""
    c, rows = catalog(spark, sf_dir), []
    for i, columns in ((6, [0, 4]), (6, [4, 5]), (3, [1])):
        found = c.stats.get(i, c.frame(i), columns)
        rows += [(i, k, found[k].rows, found[k].low, found[k].high) for k in columns]
    return spark.createDataFrame(rows, "relation int, column int, rows long, low long, high long").distinct()


def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each query after it was parsed."""
    return spark.createDataFrame([(k, parse(t).to_text()) for k, t in TEXTS.items()], "name string, text string")


def stream_of_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers to a file of query lines, read and answered as a stream."""
    folder = new_folder(spark)
    spark.createDataFrame([(TEXTS[k],) for k in BATCH], "value string").coalesce(1).write.text(f"{folder}/in")
    answer_stream(Engine(catalog(spark, sf_dir)), f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("ordinal", "line")


def scan_tbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_folder(spark)}/orders.tbl"
    write_tbl(catalog(spark, sf_dir).frame(5), path)
    return read_tbl(spark, path, 4)


def scan_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_folder(spark, local=True)}/lineitem"
    write_parts(catalog(spark, sf_dir).frame(6), path)
    return read_binary(spark, path)


def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query over relations that were written as binary files and read again."""
    folder, c = new_folder(spark, local=True), Catalog(spark)
    for i, r in enumerate((5, 3)):
        write_binary(catalog(spark, sf_dir).frame(r), f"{folder}/r{i}")
        c.register(read_binary(spark, f"{folder}/r{i}"))
    return Engine(c).query("0 1|0.1=1.0&1.1=7|0.2 1.0", signed=True)


def generate_dummy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark, 1000, 3)


def batch_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of two batches, longest first within each, by the batch protocol."""
    lines = [TEXTS[k] for k in BATCH]
    with BatchSession(Engine(catalog(spark, sf_dir))) as session:
        answers = [x for line in [*lines[:4], "F", *lines[4:], "F"] for x in session.feed(line)]
    return spark.createDataFrame(list(enumerate(answers)), "ordinal long, line string")


def batch_as_one_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(catalog(spark, sf_dir)).batch_frame(TEXTS[k] for k in BATCH)


_buckets: dict[tuple[SparkSession, str], Catalog] = {}


def join_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join of relations that were dealt by its key when they were registered; later queries find them so."""
    key = (spark, sf_dir)
    if key not in _buckets:
        given, out = catalog(spark, sf_dir), Catalog(spark)
        out.register(given.frame(6), 6, bucket_by=0, buckets=8)
        out.register(given.frame(5), 5, bucket_by=0, buckets=8)
        _buckets[key] = out
    return Engine(_buckets[key]).query(TEXTS["join2_gt"], signed=True)


def _exported(spark: SparkSession, sf_dir: str, relations: tuple[int, ...]) -> str:
    folder = new_folder(spark, local=True)
    for i, r in enumerate(relations):
        export_relation(catalog(spark, sf_dir).frame(r), i, folder)
    return folder


def init_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query over the relations of an init list, as export writes it."""
    folder = _exported(spark, sf_dir, (5, 3))
    with open(f"{folder}/init") as f:
        c = Catalog.from_init(spark, [*f, "Done"], folder)
    return Engine(c).query("0 1|0.1=1.0&1.1=7|0.2 1.0", signed=True)


def export_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and sums of a relation from each form that export writes."""
    folder = _exported(spark, sf_dir, (3,))
    name = f"made_{uuid.uuid4().hex}"
    with open(f"{folder}/r0.sql") as f:
        spark.sql(f.read().strip().rstrip(";").replace("TABLE r0 ", f"TABLE {name} "))
    forms = {"binary": read_binary(spark, f"{folder}/r0"), "ddl": spark.table(name), "parquet": spark.read.parquet(f"{folder}/r0.parquet"), "tbl": read_tbl(spark, f"{folder}/r0.tbl", 2)}
    each = [df.agg(F.count("*").alias("n"), F.sum("c0").alias("s0"), F.sum("c1").alias("s1")).select(F.lit(k).alias("form"), "*") for k, df in forms.items()]
    return reduce(DataFrame.unionByName, each)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: partial(_text, text=text) for name, text in TEXTS.items() if name != "planned_order_equivalence"},
    **{f.__name__: f for f in (planned_order_equivalence, join_fanout_eager, sum_unsigned_wrap, column_stats, scan_tbl, scan_binary, export_roundtrip, generate_dummy, batch_in_order, batch_as_one_job, join_bucketed, init_list, export_forms, known_stats, text_round_trip, stream_of_queries)},
}


def _sql(text: str) -> str:
    return f"{duck_views()} {parse(text).to_sql()}"


def _oracles() -> dict[str, str]:
    out = {name: _sql(text) for name, text in TEXTS.items()}
    plain = parse(TEXTS["planned_order_equivalence"]).to_sql().removeprefix("SELECT ")
    out["planned_order_equivalence"] = f"{duck_views()} SELECT 'stats' AS plan, {plain} UNION ALL SELECT 'written' AS plan, {plain}"
    out["join_fanout_eager"] = out["join_fanout"]
    out["sum_unsigned_wrap"] = (
        f"{duck_views()} SELECT CAST(SUM(CAST(18446744073709551615 - r5.c0 AS HUGEINT)) % 18446744073709551616 AS VARCHAR) AS s0, "
        "CAST(SUM(r3.c1) AS VARCHAR) AS s1 FROM r5, r3 WHERE r5.c1 = r3.c0"
    )
    columns = [(i, k) for i in (3, 5, 6) for k in range(len(RELATIONS[i][1]))]
    out["column_stats"] = f"{duck_views()} " + " UNION ALL ".join(
        f'SELECT CAST({i} AS INTEGER) AS relation, CAST({k} AS INTEGER) AS "column", COUNT(*) AS "rows", MIN(c{k}) AS low, MAX(c{k}) AS high, COUNT(DISTINCT c{k}) AS "distinct" FROM r{i}' for i, k in columns
    )
    out["known_stats"] = f"{duck_views()} " + " UNION ALL ".join(
        f'SELECT CAST({i} AS INTEGER) AS relation, CAST({k} AS INTEGER) AS "column", COUNT(*) AS "rows", MIN(c{k}) AS low, MAX(c{k}) AS high FROM r{i}' for i, k in ((6, 0), (6, 4), (6, 5), (3, 1))
    )
    out["text_round_trip"] = " UNION ALL ".join(f"SELECT '{k}' AS name, '{t}' AS text" for k, t in TEXTS.items())
    out["scan_tbl"] = f"{duck_views()} SELECT * FROM r5"
    out["scan_binary"] = f"{duck_views()} SELECT * FROM r6"
    out["export_roundtrip"] = _sql("5 3|0.1=1.0&1.1=7|0.2 1.0")
    out["generate_dummy"] = "SELECT range AS c0, range AS c1, range AS c2 FROM range(1000)"
    lines = []
    for i, k in enumerate(BATCH):
        spec = parse(TEXTS[k])
        line = " || ' ' || ".join(f"COALESCE(CAST(s{j} AS VARCHAR), 'NULL')" for j in range(len(spec.selections)))
        lines.append(f"SELECT CAST({i} AS BIGINT) AS ordinal, {line} AS line FROM ({spec.to_sql()}) q{i}")
    out["batch_in_order"] = out["batch_as_one_job"] = out["stream_of_queries"] = f"{duck_views()} " + " UNION ALL ".join(lines)
    out["join_bucketed"] = out["join2_gt"]
    out["init_list"] = out["export_roundtrip"]
    out["export_forms"] = f"{duck_views()} " + " UNION ALL ".join(f"SELECT '{k}' AS form, COUNT(*) AS n, CAST(SUM(c0) AS BIGINT) AS s0, CAST(SUM(c1) AS BIGINT) AS s1 FROM r3" for k in ("binary", "ddl", "parquet", "tbl"))
    return out


ORACLE_SQL = _oracles()
