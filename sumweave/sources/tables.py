"""The given Parquet tables as relations: integers as they are, money in cents, dates as days since 1970."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Catalog

#: Table and column expressions of each relation, in Spark SQL and, where it differs, DuckDB. `#` marks money, `@` a date.
RELATIONS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("region", ("r_regionkey",)),
    ("nation", ("n_nationkey", "n_regionkey")),
    ("supplier", ("s_suppkey", "s_nationkey")),
    ("customer", ("c_custkey", "c_nationkey")),
    ("part", ("p_partkey", "p_size", "p_retailprice#")),
    ("orders", ("o_orderkey", "o_custkey", "o_totalprice#", "o_orderdate@")),
    ("lineitem", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice#", "l_shipdate@")),
    ("events", ("event_id", "user_id", "value#")),
    ("documents", ("doc_id", "n_chars")),
    ("labels", ("doc_id", "quality", "toxic")),
    ("embeddings", ("vec_id", "label")),
    ("conversations", ("conv_id", "turn")),
    ("pages", ("page_id",)),
    ("benchmark", ("item_id",)),
)


def expression(column: str, duck: bool = False) -> str:
    name = column.rstrip("#@")
    if column.endswith("#"):
        return f"CAST(ROUND({name} * 100) AS BIGINT)"
    if column.endswith("@"):
        return f"CAST(date_diff('day', DATE '1970-01-01', CAST({name} AS DATE)) AS BIGINT)" if duck else f"CAST(datediff(CAST({name} AS DATE), DATE '1970-01-01') AS BIGINT)"
    return f"CAST({name} AS BIGINT)"


def relation(spark: SparkSession, sf_dir: str, i: int) -> DataFrame:
    table, columns = RELATIONS[i]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{expression(c)} AS c{k}" for k, c in enumerate(columns)))


_catalogs: dict[tuple[SparkSession, str], Catalog] = {}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """One catalog for each session and folder."""
    key = (spark, sf_dir)
    if key not in _catalogs:
        out = Catalog(spark)
        for i in range(len(RELATIONS)):
            out.register(relation(spark, sf_dir, i), i)
        _catalogs[key] = out
    return _catalogs[key]


def duck_views() -> str:
    """WITH items r0, r1, ... over the tables' views."""
    return "WITH " + ", ".join(f"r{i} AS (SELECT {', '.join(f'{expression(c, True)} AS c{k}' for k, c in enumerate(cols))} FROM {t})" for i, (t, cols) in enumerate(RELATIONS))
