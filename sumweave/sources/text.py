"""Pipe-separated text with a pipe after the last value, DDL, generated relations, and export in all forms."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tbl(spark: SparkSession, path: str, columns: int, unsigned: bool = False) -> DataFrame:
    """c0, c1, ...: longs, or decimal(20,0) if unsigned. The empty field after the last pipe is declared, so that rows are
    checked: a row that doesn't fit raises."""
    kind = "decimal(20,0)" if unsigned else "bigint"
    schema = ", ".join([*(f"c{i} {kind}" for i in range(columns)), "_end string"])
    return spark.read.schema(schema).option("sep", "|").option("mode", "FAILFAST").option("columnPruning", "false").csv(path).select(*(f"c{i}" for i in range(columns)))


def write_tbl(df: DataFrame, path: str) -> None:
    """A folder of text files; each value is followed by a pipe."""
    df.select("*", F.lit(None).cast("string").alias("_end")).write.option("sep", "|").csv(path)


def ddl(df: DataFrame, relation: int, data: str | None = None, provider: str = "csv") -> str:
    """Spark's CREATE TABLE for r<relation>, over data if it is given."""
    kinds = ["DECIMAL(20,0)" if isinstance(f.dataType, T.DecimalType) else "BIGINT" for f in df.schema.fields]
    columns = [f"c{i} {k}" for i, k in enumerate(kinds)] + (["_end STRING"] if provider == "csv" else [])
    options = " OPTIONS (sep '|')" if provider == "csv" else ""
    return f"CREATE TABLE r{relation} ({', '.join(columns)}) USING {provider}{options}" + (f" LOCATION '{data}'" if data else "")


def generated(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """Every column counts from 0."""
    return spark.range(rows).select(*(F.col("id").alias(f"c{i}") for i in range(columns)))


def export_relation(df: DataFrame, relation: int, folder: str) -> None:
    """r<id> (binary), r<id>.tbl, r<id>.parquet, r<id>.sql; the binary file's name is appended to `init`."""
    from .binary import write_binary

    base = f"{folder}/r{relation}"
    write_binary(df, base)
    write_tbl(df, f"{base}.tbl")
    df.write.parquet(f"{base}.parquet")
    Path(f"{base}.sql").write_text(ddl(df, relation, f"{base}.tbl") + ";\n")
    with open(f"{folder}/init", "a") as f:
        f.write(f"r{relation}\n")
