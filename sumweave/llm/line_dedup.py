"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, id_key, let, written

BLANKS = " \u0009\u000a\u000b\u000c\u000d"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _without(lines: Column, dropped: Column) -> Column:
    """The lines between the sorted positions in dropped; each line is copied once."""
    bounds = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines)))
    return let(
        F.struct(lines.alias("l"), bounds.alias("b")),
        lambda s: F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.size(s["b"]) - 2),
                lambda j: F.slice(s["l"], F.get(s["b"], j) + 2, F.get(s["b"], j + 1) - F.get(s["b"], j) - 1),
            )
        ),
    )


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drops lines whose key (stripped, A-Z lowered, min_chars code points or more) is in min_docs documents or more,
    but for those of the smallest doc_id that holds it.

    Returns doc_id, kept (text), n_lines, n_dropped, one row for each row of docs.
    Null or empty text: one empty line. Null doc_id: one document that comes after all others. Rows that repeat a
    doc_id are one document. Other columns are left out. An empty table gives no rows. A very long text is split in one
    task, and its lines are dealt out by key like others.

    A key is known by two 64-bit hashes. Lines are exploded and hashed once: hashes, ids and positions are written to the
    shared folder, and only these are shuffled by key, with partial aggregation first, and the join that finds the dropped
    lines is one that adaptive execution can split at a hot key; the texts are shuffled once, by document.
    """
    rows = docs.select("doc_id", "text").withColumns({"_id": id_key(F.col("doc_id")), "_th": F.xxhash64("text")})
    keys = written(
        rows.select("_id", "_th", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .select("_id", "_th", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("_id", "_th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    if min_docs == 2:  # there are two different ids just if the least isn't the greatest
        shared = keys.groupBy("h1", "h2").agg(F.min("_id").alias("keep"), F.max("_id").alias("other")).where("keep < other")
    else:
        shared = (
            keys.groupBy("h1", "h2", "_id").agg(F.lit(1).alias("one"))
            .groupBy("h1", "h2").agg(F.min("_id").alias("keep"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
        )
    # h makes the join deal both sides anew: adaptive execution can only split the join's own exchanges at a hot key
    h = F.col("h1").bitwiseXOR(F.col("h2")).alias("h")
    dropped = (
        keys.select("_id", "_th", "pos", h, "h1").join(shared.select(h, "h1", "keep"), ["h", "h1"])
        .where("_id != keep")
        .groupBy("_id", "_th")
        .agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    )
    gone = F.coalesce(F.col("gone"), F.array().cast("array<int>"))
    return rows.join(dropped, ["_id", "_th"], "left").select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit("")))
        .otherwise(F.array_join(_without(_lines(F.col("text")), gone), "\n"))
        .alias("kept"),
        F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_dropped"),
    )


def query(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM t),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(id) AS keep FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT id) >= 2),
d AS (SELECT r, pos, line, keep IS NOT NULL AND id <> keep AS gone FROM k LEFT JOIN s USING (key)),
a AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM d GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM a JOIN t USING (r)
"""
