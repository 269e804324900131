"""Substring dedup by relative Lempel-Ziv parsing against reference blocks.

A window of WINDOW words belongs to its anchor: the leftmost gram of GRAM words of least hash in it. A segment is a run of
a text's windows with one anchor position. Equal windows have equal anchors, and never lie in one segment, so a segment has
to be parsed against one reference only: that of the segments with its anchor. Equal segments are one entry of it, with a
count; its factors are those of all of them. Segments whose anchor occurs once need no parse.

A block holds the references of some anchors whole. An anchor with more than ENTRIES entries is split first: longer grams
around it (22 words, 29, 32, 34, at last the whole window) take its place, and each window goes to one of two segments,
by the side on which it has more words. Equal windows take the same way, so no reference has to meet another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, id_key, written
from .textbytes import Texts, chunks, mix, powers

WINDOW = 35
GRAM = 8
#: Different segments that an anchor's reference holds at most before it is split, 62 words each at most.
ENTRIES = 4096
#: Words of segments that one reference block indexes, about.
BLOCK_WORDS = 150_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _least(a: np.ndarray, k: int) -> np.ndarray:
    """For each i, the leftmost place of the least of a[i : i + k]."""
    at, span = np.arange(len(a)), 1
    while span < k:
        step = min(span, k - span)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(a[right] < a[left], right, left)
        span += step
    return at


def segments(t: Texts, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """text, first word in the text, windows, place of the anchor from there, anchor hash and digest of each segment."""
    n = len(t.words) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    g = t.grams(gram)
    at = _least(g, window - gram + 1)[:n]
    whole = t.whole(window)
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | ~whole[:-1]
    start = np.flatnonzero(new & whole)
    # a run ends before the next start or the first window that isn't whole
    edges = np.flatnonzero(new | ~whole)
    count = np.append(edges, n)[np.searchsorted(edges, start, "right")] - start
    digest = _span_hash(t.words, start, start + count + window - 1)
    return t.doc[start], start - t.first[t.doc[start]], count, at[start] - start, g[at[start]], digest


def _span_hash(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words[start:end]; they depend on these words only."""
    h = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words ^ _ODD) * powers(_ODD, len(words)), out=h[1:])
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    return mix((h[end] - h[start]) * powers(inverse, len(words) + 1)[start] + (end - start).astype(np.uint64))


def _scan(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("_id", "_th"))
            for lo, _, t in chunks(b):
                doc, start, count, place, anchor, digest = segments(t, window, gram)
                # equal segments of one text, of which a periodic text has many, are one row
                order = np.lexsort((start, digest, anchor, doc))
                d, a, g = doc[order], anchor[order], digest[order]
                first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (g[1:] != g[:-1]))[: len(d)])
                own = order[first]
                starts = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(start[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x) for x in (anchor[own].view(np.int64), digest[own].view(np.int64), ids[lo + doc[own]], hashes[lo + doc[own]])), starts, pa.array(count[own].astype(np.int32)), pa.array(place[own].astype(np.int32))],
                    names=["anchor", "digest", "_id", "_th", "starts", "n", "p"],
                )

    return run


def _words(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Binary values: the hashes words[start:start + size]."""
    offs = np.concatenate([[0], np.cumsum(size)])
    data = words[np.arange(offs[-1]) + np.repeat(start - offs[:-1], size)]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((8 * offs).astype(np.int32)), pa.py_buffer(data.tobytes())])


ENTRY = "anchor long, digest long, copies long, p int, words binary"


def _fetch(window: int):
    """Reference entries: the word hashes of the wanted segments (lists want) of each text. Repeated rows, which come one
    after another, bring their entries once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            ids, hashes = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("_id", "_th"))
            if not len(ids):
                continue
            new = np.append(last != (ids[0], hashes[0]), (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1]))
            last = ids[-1], hashes[-1]
            b = b.filter(pa.array(new))
            want = b.column(b.schema.get_field_index("want"))
            sizes = np.diff(np.frombuffer(want.buffers()[1], np.int32)[want.offset : want.offset + len(want) + 1])
            fields = {f: want.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("anchor", "digest", "copies", "start", "n", "p")}
            row = np.repeat(np.arange(len(want)), sizes)
            for lo, hi, t in chunks(b):
                mine = np.flatnonzero((row >= lo) & (row < hi))
                data = _words(t.words, t.first[row[mine] - lo] + fields["start"][mine], fields["n"][mine].astype(np.int64) + window - 1)
                yield pa.RecordBatch.from_arrays([*(pa.array(fields[f][mine]) for f in ("anchor", "digest", "copies", "p")), data], names=["anchor", "digest", "copies", "p", "words"])

    return run


def _entries(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all entries of b, and where each begins."""
    a = b.column(b.schema.get_field_index("words"))
    offs = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    return np.frombuffer(a.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(np.uint64), (offs - offs[0]) // 8


def _refine(window: int, gram: int):
    """Entries with anchors of `gram` words become one or two with longer anchors each: the windows that have more words
    after the anchor's start, and the others. sub_*: the new anchor and digest; at: the place in the old entry."""
    offsets = window - gram + 1
    more = offsets // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            words, offs = _entries(b)
            anchor, digest, copies, p = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("anchor", "digest", "copies", "p"))
            p, last = p.astype(np.int64), np.diff(offs) - window  # the entry's windows start at 0 .. last
            after = np.maximum(0, p - (offsets - more) + 1)  # those from here on go with the words after the anchor
            for lo, hi, place in ((after, last, p), (np.zeros(len(p), np.int64), np.minimum(last, after - 1), p - more)):
                own = np.flatnonzero(hi >= lo)
                start, size = offs[own] + lo[own], hi[own] - lo[own] + window
                key = _span_hash(words, offs[own] + place[own], offs[own] + place[own] + gram + more)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x[own]) for x in (anchor, digest)), pa.array(key.view(np.int64)), pa.array(_span_hash(words, start, start + size).view(np.int64)), pa.array(copies[own]), pa.array(lo[own].astype(np.int32)), pa.array((place - lo)[own].astype(np.int32)), _words(words, start, size)],
                    names=["anchor", "digest", "sub_anchor", "sub_digest", "copies", "at", "p", "words"],
                )

    return run


def matches(words: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each word of the entries, how long what starts there goes on alike at any other word of the block, within
    both entries; by the ranks of all suffixes, from prefix doubling."""
    n = len(words)
    end = np.repeat(offs[1:], np.diff(offs))
    here = np.arange(n)
    ranks, k, longest = [], 1, int(np.diff(offs).max())
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    while True:
        ranks.append(np.append(rank, 0))
        if k >= longest:
            break
        then = np.where(here + k < end, ranks[-1][np.minimum(here + k, n)], 0)  # 0: past the end of the entry
        rank = np.unique(rank * (n + 1) + then, return_inverse=True)[1].astype(np.int64) + 1
        k *= 2
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1], order[1:]
    alike = np.zeros(n - 1, np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        x, y = np.minimum(a + alike, n), np.minimum(b + alike, n)
        alike += np.where((ranks[j][x] == ranks[j][y]) & (a + alike < end[a]) & (b + alike < end[b]), 1 << j, 0)
    alike = np.minimum(alike, np.minimum(end[a] - a, end[b] - b))
    out = np.zeros(n, np.int64)
    out[a] = alike  # the longest match of a suffix is a neighbour by rank
    out[b] = np.maximum(out[b], alike)
    return out


def parse(words: np.ndarray, offs: np.ndarray, copies: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Relative Lempel-Ziv factors, of a window's words at least, of each entry against the block of all of them: entry,
    first and last word + 1 from the entry's start.

    At each place the longest match is taken, which for an entry with copies is its rest. Then the windows across its
    boundary are looked up, from the first that isn't within it; the next that occurs elsewhere starts the next factor.
    So what the factors cover are the windows that occur elsewhere."""
    end = offs[1:]
    rest = np.repeat(end, np.diff(offs)) - np.arange(len(words))
    long = np.where(np.repeat(copies > 1, np.diff(offs)), rest, matches(words, offs))
    hit = np.append(np.flatnonzero(long >= window), len(words))
    entry, at, found = np.arange(len(end)), offs[:-1], []
    while len(entry):
        at = hit[np.searchsorted(hit, at)]  # the next place where a window occurs elsewhere
        inside = at < end[entry]
        entry, at = entry[inside], at[inside]
        found.append((entry, at, at + long[at]))
        at = at + long[at] - window + 1
    entry, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
    return entry, lo - offs[entry], hi - offs[entry]


def _parse_blocks(window: int):
    """Reads entries in the order of anchor and digest; a block ends between two anchors."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        anchor, digest = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("anchor", "digest"))
        one = np.append(True, (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1]))  # an entry may come twice, from repeated rows
        b = b.filter(pa.array(one))
        words, offs = _entries(b)
        entry, lo, hi = parse(words, offs, b.column(b.schema.get_field_index("copies")).to_numpy(), window)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[one][entry], digest[one][entry], lo.astype(np.int32), hi.astype(np.int32))], names=["anchor", "digest", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            while b.num_rows:
                words, offs = _entries(b)
                anchor = b.column(b.schema.get_field_index("anchor")).to_numpy()
                ends = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1  # rows at which an anchor starts
                if held and held[-1].column(0)[-1].as_py() != anchor[0]:
                    ends = np.append(0, ends)
                full = ends[size + offs[ends] >= BLOCK_WORDS] if len(ends) else ends
                cut = int(full[0]) if len(full) else b.num_rows
                if cut:
                    held.append(b.slice(0, cut))
                    size += int(offs[cut])
                if len(full):
                    yield block(held)
                    held, size = [], 0
                b = b.slice(cut)
        if held:
            yield block(held)

    return run


def factors(entries: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = ENTRIES) -> DataFrame:
    """anchor, digest, lo, hi: the factors of each entry (see ENTRY) against the reference of its anchor. Anchors of more
    than `most` entries are split by longer grams until none is; the whole window has one entry."""
    kinds = entries.groupBy("anchor").agg(F.count_distinct("digest").alias("kinds")).where(F.col("kinds") > most)
    kinds = written(kinds.select("anchor"))
    schema = "anchor long, digest long, lo int, hi int"

    def parsed(rows: DataFrame) -> DataFrame:
        return rows.repartition("anchor").sortWithinPartitions("anchor", "digest").mapInArrow(_parse_blocks(window), schema)

    if gram >= window or kinds.isEmpty():
        return parsed(entries)
    subs = written(entries.join(kinds, "anchor", "left_semi").mapInArrow(_refine(window, gram), "anchor long, digest long, sub_anchor long, sub_digest long, copies long, at int, p int, words binary"))
    below = subs.groupBy(F.col("sub_anchor").alias("anchor"), F.col("sub_digest").alias("digest")).agg(F.sum("copies").alias("copies"), F.first("p").alias("p"), F.first("words").alias("words"))
    found = factors(written(below), window, gram + (window - gram + 1) // 2, most)
    c = F.col("sub_anchor").bitwiseXOR(F.col("sub_digest")).alias("c")
    found = found.select(F.col("anchor").bitwiseXOR(F.col("digest")).alias("c"), F.col("digest").alias("sub_digest"), "lo", "hi")
    up = subs.select("anchor", "digest", "sub_digest", "at", c).join(found, ["c", "sub_digest"]).select("anchor", "digest", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))
    return parsed(entries.join(kinds, "anchor", "left_anti")).unionByName(up)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        gone = b.column(b.schema.get_field_index("gone"))
        for lo, hi, t in chunks(b):
            n_words, n_removed, kept = [], [], []
            for i in range(lo, hi):
                words = t[i - lo].split()  # of bytes: splits at the six ASCII blanks
                n_words.append(len(words))
                if gone[i].is_valid:
                    drop = np.zeros(len(words) + 1, np.int32)
                    r = gone[i].values
                    np.add.at(drop, r.field("lo").to_numpy(), 1)
                    np.add.at(drop, r.field("hi").to_numpy(), -1)
                    inside = np.cumsum(drop[:-1]) > 0
                    words = [w for w, x in zip(words, inside.tolist(), strict=True) if not x]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            ids = b.column(b.schema.get_field_index("doc_id")).slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def duplicate_ranges(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = ENTRIES) -> DataFrame:
    """rows: _id, _th, text. Returns _id, _th, gone: the ranges [lo, hi) of words that factors cover."""
    segs = written(rows.mapInArrow(_scan(window, gram), "anchor long, digest long, _id long, _th long, starts array<int>, n int, p int"))
    shared = segs.groupBy("anchor").agg(F.sum(F.size("starts")).alias("places")).where("places > 1")
    # xored, so that the join deals both sides itself and adaptive execution can split a hot anchor
    near = written(segs.withColumn("a", F.col("anchor").bitwiseXOR(F.lit(1))).join(shared.select(F.col("anchor").bitwiseXOR(F.lit(1)).alias("a")), "a", "left_semi").drop("a"))
    drop_written(segs)
    classes = near.groupBy("anchor", "digest").agg(F.sum(F.size("starts")).alias("copies"), F.min(F.struct("_id", "_th", F.get("starts", F.lit(0)).alias("start"), "n", "p")).alias("at"))
    asked = (
        classes.groupBy(F.col("at._id").alias("_id"), F.col("at._th").alias("_th"))
        .agg(F.collect_list(F.struct("anchor", "digest", "copies", F.col("at.start").alias("start"), F.col("at.n").alias("n"), F.col("at.p").alias("p"))).alias("want"))
    )
    entries = written(rows.join(asked, ["_id", "_th"]).select("_id", "_th", "text", "want").sortWithinPartitions("_id", "_th").mapInArrow(_fetch(window), ENTRY))
    c = F.col("anchor").bitwiseXOR(F.col("digest")).alias("c")
    found = factors(entries, window, gram, most).select(c, "digest", "lo", "hi")
    return (
        near.select("_id", "_th", "starts", c, "digest").join(found, ["c", "digest"])
        .select("_id", "_th", F.explode("starts").alias("start"), "lo", "hi")
        .groupBy("_id", "_th").agg(F.collect_set(F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))).alias("gone"))
    )


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Returns doc_id, n_words, n_removed, kept (the other words, one space between) for each row of docs.

    A word goes if a window of as many words covers it whose words also start anywhere else. Null and empty texts have no
    words. Null doc_id: one id of its own. Repeated rows are copies of each other, and lose what they share like others.
    Texts shorter than a window stay. No documents give no rows; other columns are left out.

    Only 64-bit hashes are shuffled for the search, then texts twice by document: for the words of segments whose anchor
    occurs more than once, and for the result. Words are compared by 64-bit hashes, all of a window's one by one. A very long
    text is scanned alone, and its segments are dealt out like others.
    """
    rows = docs.select("doc_id", "text").withColumns({"_id": id_key(F.col("doc_id")), "_th": F.xxhash64("text")})
    gone = duplicate_ranges(rows.select("_id", "_th", "text"), window)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(gone, ["_id", "_th"], "left").select("doc_id", "text", "gone").mapInArrow(_apply, f"doc_id {kind}, n_words long, n_removed long, kept string")


def query(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i, unnest(list_transform(range(1, len(ws) + 1), lambda k: CASE WHEN k + 34 <= len(ws) THEN array_to_string(ws[k:k + 34], ' ') END)) AS win FROM t),
c AS (SELECT r, w, i, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS dup FROM w),
g AS (SELECT r, w, i, max(dup::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
a AS (SELECT r, count(*) AS n_words, sum(gone) AS n_removed, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM g GROUP BY r)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN a USING (r)
"""
