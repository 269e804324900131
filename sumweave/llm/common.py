"""What the operators share: reading tables, and cutting lineage in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import new_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A word, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"
#: Copies that one task makes of a row, or the root of their number if that is more.
COPIES = 4096
#: A null doc_id counts as one document that comes after all others.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. One whose scan has fewer splits than there are cores, so a small one, is dealt to all of them first, as the
    work on a row is much beside moving it."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: a cut lineage that outlives lost executors."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Removes what written() made, once nothing reads it any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def copies(rows: DataFrame, n: str, hot: bool, most: int = COPIES) -> DataFrame:
    """Each row n times, numbered 1 .. n in the column `copy`. If hot (some n is over `most`), rows of more copies are cut
    into ranges first, which are dealt to all tasks: no task makes all copies of a row. rows is evaluated twice then."""
    few = (rows.where(F.col(n) <= most) if hot else rows).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n).cast("long"))))
    if not hot:
        return few
    each = F.greatest(F.lit(most), F.ceil(F.sqrt(n))).cast("long")
    ranges = rows.where(F.col(n) > most).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n).cast("long"), each)))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, so that adaptive execution doesn't join the small ranges again
    ranges = ranges.repartition(parts, *(f"`{c}`" for c, kind in ranges.dtypes if "map<" not in kind))  # maps have no hash
    return few.unionByName(ranges.withColumn("copy", F.explode(F.sequence("copy", F.least(F.col("copy") + each - 1, F.col(n).cast("long"))))))


def any_over(rows: DataFrame, n: str, most: int = COPIES) -> bool:
    return not rows.where(F.col(n) > most).isEmpty()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def id_key(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(LAST_ID))


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def whole_row(df: DataFrame) -> Column:
    """All columns as one, `row`, so that none clashes with what an operator adds."""
    return F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row")
