"""MinHash near-dedup: BagMinHash signatures of word shingles, banding, verification of the multiset overlap, components.

After Ertl, BagMinHash (2018): each shingle has Poisson processes over intervals of the weight axis, [0, 1), [1, 2), [2, 4),
[4, 8) and so on, with rates as the intervals' lengths; a text with the shingle w times sees the points below w. Each point
belongs to one of the signature's components, and the earliest point that a text sees is that component's value. Two texts
agree in a component with the probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, drop_written, id_key, whole_row, written
from .components import components_of_few
from .textbytes import Texts, chunks, mix

SHINGLE = 5
SIMILARITY = 0.8
#: Components of a signature; bands made of the first of them, and rows of a band: at a similarity of 0.8,
#: 1 - (1 - 0.8**4)**16 = 0.9998 share a band.
SIZE = 128
BANDS = 16
ROWS = 4
#: A text meets the hub of a bucket only if their signatures agree in so much. Nothing is lost by that: texts that stay in
#: different components are compared in step 4 whatever their signatures.
LEAST = 0.7
#: Texts of a bucket, and shingles of these texts, that a cell holds to be met (and, of each again, to ask).
PIECE = 4096
PIECE_SHINGLES = 1 << 20
CELL = ("bucket", "i", "j")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def bags(t: Texts, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, hash and count of each different shingle; a text with fewer words is one shingle."""
    sizes = np.diff(t.first)
    whole = np.flatnonzero(t.whole(shingle))
    short = np.flatnonzero((sizes > 0) & (sizes < shingle))
    doc = np.concatenate([t.doc[whole], short])
    gram = np.concatenate([t.grams(shingle)[whole], t.hashes(t.starts[t.first[short]], t.ends[t.first[short + 1] - 1])]) if len(doc) else np.zeros(0, np.uint64)
    _, at, count = np.unique(mix(gram + mix(doc.astype(np.uint64))), return_index=True, return_counts=True)
    return doc[at], gram[at], count


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def signatures(n: int, doc: np.ndarray, gram: np.ndarray, count: np.ndarray, size: int = SIZE) -> np.ndarray:
    """n x size hashes of the earliest points; texts without shingles have zeros."""
    weight = np.bincount(doc, weights=count, minlength=n)
    sig, best = np.zeros(n * size, np.uint64), np.full(n * size, np.inf)
    todo = weight > 0
    limit = np.where(todo, size * (np.log(size) + 4) / np.maximum(weight, 1), 0.0)
    parts = []
    level = 0
    while True:
        low = 0 if level == 0 else 1 << (level - 1)
        mine = count > low
        if not mine.any():
            break
        parts.append((doc[mine], mix(gram[mine] + np.uint64(level)), count[mine], np.full(mine.sum(), low), np.full(mine.sum(), max(low, 1))))
        level += 1
    if not parts:
        return sig.reshape(n, size)
    docs, seeds, counts, lows, rates = (np.concatenate(x) for x in zip(*parts, strict=True))
    while todo.any():
        live = np.flatnonzero(todo[docs])
        time, step = np.zeros(len(live)), 0
        cells, times, points = [], [], []
        while len(live):
            step += 1
            h = mix(seeds[live] + np.uint64(step * int(_ODD) % 2**64))
            time = time - np.log1p(-_uniform(h)) / rates[live]
            early = time <= limit[docs[live]]
            live, time, h = live[early], time[early], mix(h[early])
            seen = lows[live] + rates[live] * _uniform(h) < counts[live]  # the point's place on the weight axis
            cells.append(docs[live[seen]] * size + (h[seen] & np.uint64(0x7FF)).astype(np.int64) * size // 2048)
            times.append(time[seen])
            points.append(mix(h[seen]))
        cell, when, point = np.concatenate(cells), np.concatenate(times), np.concatenate(points)
        again = np.repeat(todo, size)
        best[again] = np.inf
        np.minimum.at(best, cell, when)
        first = when == best[cell]
        sig[cell[first]] = point[first]
        todo = todo & ~np.isfinite(best.reshape(n, size)).all(1)  # a component has no point yet: look further
        limit = limit * 2
    return sig.reshape(n, size)


def band_hashes(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    h = np.zeros((len(sig), bands), np.uint64)
    for j in range(rows):
        h = mix(h * _ODD + sig[:, j : bands * rows : rows])
    return mix(h + np.arange(bands, dtype=np.uint64))


def _fixed(rows: np.ndarray) -> pa.Array:
    """Binary values of one length."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, t in chunks(b):
            doc, gram, count = bags(t)
            sig = signatures(t.n, doc, gram, count)
            bands = band_hashes(sig).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(t.n + 1) * bands.shape[1], pa.int32()), pa.array(bands.ravel()))
            size = np.bincount(doc, weights=count, minlength=t.n).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(c)).slice(lo, hi - lo) for c in ("_id", "key")] + [lists, _fixed((sig & np.uint64(255)).astype(np.uint8)), pa.array(size)],
                names=["_id", "key", "bands", "code", "size"],
            )


def _codes(b: pa.RecordBatch, name: str) -> np.ndarray:
    a = b.column(b.schema.get_field_index(name))
    return np.frombuffer(a.buffers()[2], np.uint8)[a.offset * SIZE : (a.offset + len(a)) * SIZE].reshape(-1, SIZE)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) whose sizes and signatures allow the similarity."""
    for b in batches:
        if b.num_rows:
            m, n = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("size", "size2"))
            ok = (np.minimum(m, n) >= SIMILARITY * np.maximum(m, n)) & ((_codes(b, "code") == _codes(b, "code2")).mean(1) >= LEAST)
            yield b.filter(pa.array(ok)).select(["u", "v"])


def _bag(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each bag starts (and the last ends) in the hashes, and the hashes of all."""
    a = b.column(b.schema.get_field_index(name))
    offs = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64) // 4
    return offs, np.frombuffer(a.buffers()[2], np.uint8)[: 4 * offs[-1]].view(np.uint32)


def _met(asks: np.ndarray, tokens: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many of the hashes `asks` each of n bags holds; tokens are those of the bags in order, owner the bag of each."""
    lo, hi = np.searchsorted(tokens, asks, "left"), np.searchsorted(tokens, asks, "right")
    many = hi - lo
    at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return np.bincount(owner[at], minlength=n)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links between different components, from rows in the order of their cells. In each cell, every text that
    asks is compared with all texts to be met, whole multisets each; what a link has joined isn't compared again."""

    def linked(comp: np.ndarray, role: np.ndarray, offs: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int]]:
        size, comp = np.diff(offs), comp.copy()
        to, index = np.flatnonzero(role & 1), None
        for x in np.flatnonzero(role & 2):
            m, n = size[x], size[to]
            may = (comp[to] != comp[x]) & (np.minimum(m, n) >= SIMILARITY * np.maximum(m, n))
            if not may.any():
                continue
            if index is None:
                tokens = np.concatenate([data[offs[y] : offs[y + 1]] for y in to])
                order = np.argsort(tokens)
                index = tokens[order], np.repeat(np.arange(len(to)), n)[order]
            met = _met(data[offs[x] : offs[x + 1]], *index, len(to))
            found = to[may & (met >= SIMILARITY * (m + n - met) - 1e-9)]
            for c, k in zip(*np.unique(comp[found], return_index=True), strict=True):
                yield x, found[k]
                comp[comp == c] = comp[x]

    def whole(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys, comp = t.column(t.schema.get_field_index("key")), t.column(t.schema.get_field_index("comp")).dictionary_encode().indices.to_numpy()
        role = t.column(t.schema.get_field_index("role")).to_numpy()
        offs, data = _bag(t, "bag")
        edges = np.append(_edges(t), len(role))
        pairs = [(lo + x, lo + y) for lo, hi in zip(edges, edges[1:]) if hi - lo > 1 for x, y in linked(comp[lo:hi], role[lo:hi], offs[lo : hi + 1], data)]
        if pairs:
            u, v = (keys.take(pa.array(x, pa.int64())) for x in zip(*pairs, strict=True))
            yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        # cells before the batch's last one are whole; that may go on in the next batch
        last = int(_edges(b)[-1])
        if last or held and _cell(b, 0) != _cell(held[-1], held[-1].num_rows - 1):
            if held and _cell(b, 0) != _cell(held[-1], held[-1].num_rows - 1):
                yield from whole(held)
                held = []
            if last:
                yield from whole([*held, b.slice(0, last)])
                held = []
        held.append(b.slice(last))
    if held:
        yield from whole(held)


def _cell(b: pa.RecordBatch, row: int) -> tuple:
    return tuple(b.column(b.schema.get_field_index(c))[row].as_py() for c in CELL)


def _edges(b: pa.RecordBatch) -> np.ndarray:
    """The rows where cells begin."""
    columns = [b.column(b.schema.get_field_index(c)).to_numpy() for c in CELL]
    return np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)))


def _multisets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted 32-bit hashes of (shingle, which occurrence) for each text: sets that meet as the multisets do."""
    for b in batches:
        for lo, hi, t in chunks(b):
            doc, gram, count = bags(t)
            rows = np.repeat(np.arange(len(doc)), count)
            nth = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
            items = np.sort((doc[rows].astype(np.uint64) << np.uint64(32)) | (mix(gram[rows] + nth.astype(np.uint64) * _ODD) >> np.uint64(32)))
            offs = np.searchsorted(items, np.arange(t.n + 1, dtype=np.uint64) << np.uint64(32))
            low = (items & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            data = pa.Array.from_buffers(pa.binary(), t.n, [None, pa.py_buffer((4 * offs).astype(np.int32)), pa.py_buffer(low.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("key")).slice(lo, hi - lo), data], names=["key", "bag"])


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def items(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
        offs, data = _bag(b, name)
        n = np.diff(offs)
        return n, (np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(32)) | data[offs[0] :]

    for big in batches:
        for at in range(0, big.num_rows, 500):
            b = big.slice(at, 500)
            (m, x), (n, y) = items(b, "bag"), items(b, "bag2")
            both = np.sort(np.concatenate([x, y]))
            met = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(m))
            # 32-bit hashes that collide within one text count as met; this is about one in 10**4 pairs
            yield b.filter(pa.array(met >= SIMILARITY * (m + n - met) - 1e-9)).select(["u", "v"])


def _verified(pairs: DataFrame, classes: DataFrame, bags: DataFrame) -> DataFrame:
    """The likely ones of the pairs that have the similarity. The payload of a pair is moved once, that of its hub only to
    meet it."""
    kinds = classes.select("key", "code", "size")
    asked = written(
        pairs.join(kinds.withColumnRenamed("key", "u"), "u")
        .join(kinds.select(F.col("key").alias("v"), F.col("code").alias("code2"), F.col("size").alias("size2")), "v")
        .select("u", "v", "code", "size", "code2", "size2").mapInArrow(_likely, "u string, v string")
    )
    met = asked.join(bags.withColumnRenamed("key", "u"), "u").join(bags.select(F.col("key").alias("v"), F.col("bag").alias("bag2")), "v")
    found = written(met.select("u", "v", "bag", "bag2").mapInArrow(_overlap, "u string, v string"))
    drop_written(asked)
    return found


def _compared(near: DataFrame, links: DataFrame, bags: DataFrame) -> DataFrame:
    """Links between the components that buckets still hold: of each pair of texts in one bucket, unless links join them.

    Texts outside of a bucket's largest component ask all others. A large bucket is a grid of cells: texts to be met are
    dealt out to columns and those that ask to rows, and cell (i, j) compares the askers of row i with the texts of
    column j; so every pair meets, and no cell grows with its bucket."""
    groups = written(components_of_few(links))
    other = F.col("bucket").bitwiseXOR(F.lit(1)).alias("b")
    label = near.join(groups.withColumnRenamed("node", "key"), "key", "left").select("key", "bucket", "size", F.coalesce("component", "key").alias("comp"))
    parts = label.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("n", "w", "comp")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("parts")).where("parts > 1")
    cells = lambda n, w: F.ceil(F.greatest(n / PIECE, w / PIECE_SHINGLES)).cast("int")
    mixed = mixed.select(other, F.col("top.comp").alias("top"), cells(F.col("n"), F.col("w")).alias("columns"), cells(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("lines"))
    open_ = label.withColumn("b", other).join(mixed, "b").withColumns({"j": F.expr("pmod(xxhash64(key, 1), columns)"), "i": F.expr("if(comp = top, -1, pmod(xxhash64(key, 2), lines))")})
    # role 1: to be met, in each line of cells; 2: asks, in each column; 3: both in this cell
    place = "transform(sequence(0, lines - 1), x -> struct(int(x) as i, int(j) as j, if(x = i, 3, 1) as role))"
    place = f"concat({place}, if(i < 0, array(), transform(filter(sequence(0, columns - 1), x -> x != j), x -> struct(int(i) as i, int(x) as j, 2 as role))))"
    placed = open_.select("key", "bucket", "comp", F.expr(f"inline({place})"))
    rows = placed.join(bags, "key").repartition(*CELL).sortWithinPartitions(*CELL).select("key", *CELL, "role", "comp", "bag")
    found = written(rows.mapInArrow(_compare, "u string, v string").distinct())
    drop_written(groups)
    return found


def near_duplicates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Returns (a row for each row of docs: doc_id, class_id, _id, key, first (whether it stands for its class); the
    verified links u, v between different texts).

    A class is a component of texts linked by a weighted Jaccard similarity of SIMILARITY or more over word shingles, and
    class_id its least doc_id. Equal texts are one text with all its rows. Null texts and such without words have a class
    of their own each. Null doc_id: comes after all others; a class of only those has a null class_id. Repeated rows are
    one text with several rows. A similarity of just SIMILARITY links. No documents give no rows; other columns are left
    out. A very long text is one row of its shingles' hashes, 4 bytes a word, and is compared whole.

    1. One scan signs all texts; equal texts are merged by a partial aggregate.
    2. In every band bucket, each text is paired with the bucket's hub: the text that shares most buckets with others.
       So pairs grow with the texts, not with the squares of groups.
    3. Likely pairs are verified on whole multisets; components of the links are found.
    4. In buckets that still hold several components, texts are compared with all those of other components. So every pair
       that shares a bucket is verified or joined; only pairs without a common bucket are lost.
    """
    rows = docs.select("doc_id", "text").withColumns({"_id": id_key(F.col("doc_id")), "key": F.md5(F.coalesce("text", F.lit("")))})
    signed = written(rows.select("_id", "key", "text").mapInArrow(_sign, "_id long, key string, bands array<long>, code binary, size long"))
    classes = written(signed.where("size > 0").groupBy("key").agg(F.min("_id").alias("_id"), F.first("bands").alias("bands"), F.first("code").alias("code"), F.first("size").alias("size")))
    members = classes.select("key", "size", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    near = written(members.withColumn("b", F.col("bucket").bitwiseXOR(F.lit(1))).join(shared.select(F.col("bucket").bitwiseXOR(F.lit(1)).alias("b"), "n"), "b").drop("b"))
    # one row of each text that shares a bucket; its text is shuffled once, for all rounds
    chosen = classes.select("key", "_id").join(near.select("key").distinct(), "key", "left_semi")
    texts = rows.select("_id", "key", "text").join(chosen, ["key", "_id"], "left_semi").select("key", "text")
    bags = written(texts.mapInArrow(_multisets, "key string, bag binary").groupBy("key").agg(F.first("bag").alias("bag")))
    score = near.groupBy("key").agg(F.sum("n").alias("score"))
    hubs = near.join(score, "key").groupBy("bucket").agg(F.max(F.struct("score", "key")).alias("hub")).select(F.col("bucket").bitwiseXOR(F.lit(1)).alias("b"), F.col("hub.key").alias("hub"))
    pairs = near.withColumn("b", F.col("bucket").bitwiseXOR(F.lit(1))).join(hubs, "b").where("key != hub").select(F.col("key").alias("u"), F.col("hub").alias("v")).distinct()
    of_hubs = _verified(pairs, classes, bags)
    others = _compared(near, of_hubs, bags)
    links = written(of_hubs.unionByName(others))
    for df in (near, bags, of_hubs, others):
        drop_written(df)
    groups = written(components_of_few(links))
    ids = classes.select("key", "_id").join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = ids.groupBy("component").agg(F.min(F.struct(F.col("_id").alias("class"), F.col("key").alias("of"))).alias("least"))
    member = ids.join(least, "component").select("key", "least")
    out = signed.select("_id", "key").join(member, "key", "left").withColumn("least", F.coalesce("least", F.struct(F.col("_id").alias("class"), F.col("key").alias("of"))))
    null = F.lit(None).cast("long")
    return out.select(
        F.when(F.col("_id") < LAST_ID, F.col("_id")).otherwise(null).alias("doc_id"),
        F.when(F.col("least.class") < LAST_ID, F.col("least.class")).otherwise(null).alias("class_id"),
        "_id", "key", F.expr("_id = least.class and key = least.of").alias("first"),
    ), links


def query(docs: DataFrame) -> DataFrame:
    found, _ = near_duplicates(docs)
    return found.select("doc_id", "class_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near duplicates: the row with the least doc_id of each class stays, one row if it is repeated. Rows
    without words are a class each and stay, but for repeated ones."""
    found, _ = near_duplicates(docs)
    keep = found.where("first").select("_id", "key").distinct()
    rows = docs.select(whole_row(docs), id_key(F.col("doc_id")).alias("_id"), F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    return rows.join(keep, ["_id", "key"]).dropDuplicates(["_id", "key"]).select("row.*")


#: The exact classes; the search loses 0.02% of the pairs at SIMILARITY, if nothing else links them.
ORACLE_SQL = rf"""
WITH RECURSIVE t AS MATERIALIZED (SELECT row_number() OVER (ORDER BY text) AS k, text, min(coalesce(doc_id, 9223372036854775807)) AS id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws
  FROM documents WHERE regexp_matches(text, '[^\x20\x09-\x0D]') GROUP BY text),
g AS (SELECT k, unnest(list_transform(range(1, greatest(len(ws) - {SHINGLE - 2}, 2)), lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' '))) AS gram FROM t),
s AS MATERIALIZED (SELECT k, gram, count(*) AS c FROM g GROUP BY k, gram),
z AS (SELECT k, sum(c) AS n FROM s GROUP BY k),
m AS (SELECT a.k AS u, b.k AS v, sum(least(a.c, b.c)) AS met FROM s a JOIN s b ON a.gram = b.gram AND a.k < b.k GROUP BY a.k, b.k),
e AS MATERIALIZED (SELECT u, v FROM m JOIN z x ON x.k = u JOIN z y ON y.k = v WHERE met >= {SIMILARITY} * (x.n + y.n - met) - 1e-9),
r AS (SELECT k AS a, k AS b FROM t UNION SELECT r.a, x.v FROM r JOIN (SELECT u, v FROM e UNION ALL SELECT v, u FROM e) x ON x.u = r.b),
c AS (SELECT r.a AS k, min(t.id) AS class FROM r JOIN t ON t.k = r.b GROUP BY r.a)
SELECT doc_id, CASE WHEN class IS NULL THEN doc_id WHEN class < 9223372036854775807 THEN class END AS class_id FROM documents LEFT JOIN t USING (text) LEFT JOIN c USING (k)
"""
