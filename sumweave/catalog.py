"""Relations by id: DataFrames of unsigned columns c0, c1, ..."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folders import new_folder
from .plans.spec import UnknownColumn, UnknownRelation
from .plans.stats import StatsStore


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark, self._frames = spark, {}
        self.stats = StatsStore()

    def register(self, df: DataFrame, relation: int | None = None, view: bool = False, check: bool = False, bucket_by: int | None = None, buckets: int = 200) -> int:
        """Columns are renamed c0, c1, ... by place; integers become longs, decimals decimal(20,0). Without an id the next
        ordinal is taken. view also makes a temp view r<id>.

        Values are unsigned: nulls and negative numbers don't belong in a relation, and check, a scan, raises for them.
        bucket_by: a column's number. The relation is written to the shared folder once, dealt by this column into so many
        buckets and sorted within them; joins on the column with relations dealt into as many need no exchange then."""
        kinds = [f.dataType for f in df.schema.fields]
        for name, kind in zip(df.columns, kinds, strict=True):
            if not isinstance(kind, (T.IntegralType, T.DecimalType)):
                raise TypeError(f"column {name} is {kind.simpleString()}; relations hold unsigned integers")
        cols = [F.col(f"`{c}`").cast("decimal(20,0)" if isinstance(k, T.DecimalType) else "long").alias(f"c{i}") for i, (c, k) in enumerate(zip(df.columns, kinds, strict=True))]
        relation = len(self._frames) if relation is None else relation
        df = df.select(*cols)
        if check:
            bad = df.agg(*(F.count_if(F.col(c).isNull() | (F.col(c) < 0)).alias(c) for c in df.columns)).first()
            if any(bad):
                raise ValueError(f"relation {relation} has null or negative values: {bad.asDict()}")
        self._frames[relation] = df if bucket_by is None else self._bucketed(df, f"c{bucket_by}", buckets)
        if view:
            self._frames[relation].createOrReplaceTempView(f"r{relation}")
        return relation

    def _bucketed(self, df: DataFrame, column: str, buckets: int) -> DataFrame:
        name = f"bucketed_{uuid.uuid4().hex}"
        df.repartition(buckets, column).write.bucketBy(buckets, column).sortBy(column).option("path", new_folder(self.spark)).saveAsTable(name)
        return self.spark.table(name)

    def frame(self, relation: int) -> DataFrame:
        if relation not in self._frames:
            raise UnknownRelation(f"no relation {relation}; there are {sorted(self._frames)}")
        return self._frames[relation]

    def check(self, relation: int, columns: Iterable[int]) -> None:
        n = len(self.frame(relation).columns)
        for c in columns:
            if c >= n:
                raise UnknownColumn(f"relation {relation} has columns 0 to {n - 1}, not {c}")

    def cache(self, relation: int) -> None:
        """Keeps a hot relation in memory, columnar; Spark evicts and recomputes as needed."""
        self._frames[relation] = self.frame(relation).cache()

    def __len__(self) -> int:
        return len(self._frames)

    def __iter__(self):
        return iter(sorted(self._frames))

    @staticmethod
    def from_init(spark: SparkSession, lines: Iterable[str], folder: str = "") -> Catalog:
        """Binary relation files by name, one a line up to `Done`; ids are ordinals."""
        from .sources.binary import read_binary

        out = Catalog(spark)
        for line in lines:
            name = line.strip()
            if name == "Done":
                break
            if name:
                out.register(read_binary(spark, f"{folder}/{name}" if folder else name))
        return out
