"""Benchmark decontamination: a BM25 index of test items, searched with every passage by block-max WAND, then verified."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import written
from .textbytes import Texts, chunks

SHINGLE = 5
#: Of an item's different shingles, so much must be in one passage; and of those of its question and its answer.
OVERLAP = 0.8
PART_OVERLAP = 0.5
#: BM25's parameters, and postings of a block.
K1, B = 1.2, 0.75
POSTINGS = 64
#: Terms that one index holds, about (some 16 MB of text, and 100 MB in a worker); more make more indexes, each of which is
#: searched with all passages in a scan of its own. Scores don't depend on it.
INDEX_TERMS = 3_000_000
#: Words of a passage, or twice the longest item if that is more; a passage may start at any word.
PASSAGE = 128
#: All ASCII characters but letters and digits part words; letters count without case.
_PARTS = np.arange(256) < 128
_PARTS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def _texts(texts: list[str]) -> Texts:
    raw = [x.encode() for x in texts]
    return Texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64), True, _PARTS)


def _tail(text: str) -> str:
    """The answer: the last line, or the last third of the words if there is one line."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 1:
        return lines[-1]
    words = text.split()
    return " ".join(words[len(words) - len(words) // 3 :])


class Bag(NamedTuple):
    """An item's different terms in order, how often each occurs, and which are its answer's."""

    words: int
    size: int  # words of a term
    length: int  # terms, repeats counted
    terms: np.ndarray
    tf: np.ndarray
    answer: np.ndarray


def bags(texts: list[str | None]) -> list[Bag | None]:
    """Terms are shingles of five words; an item with fewer words is one term, and one without words is None."""
    t, tails = _texts([x or "" for x in texts]), _texts([_tail(x or "") for x in texts])
    out: list[Bag | None] = []
    for i in range(t.n):
        n = int(t.first[i + 1] - t.first[i])
        k = min(SHINGLE, n)
        if not n:
            out.append(None)
            continue
        grams = t.grams(k)[t.first[i] : t.first[i + 1] - k + 1]
        answer = np.arange(len(grams)) + k // 2 >= n - int(tails.first[i + 1] - tails.first[i])
        different, tf = np.unique(grams, return_counts=True)
        out.append(Bag(n, k, len(grams), different, tf, np.isin(different, grams[answer])))
    return out


class Totals(NamedTuple):
    """Of all items, whatever index they are in: how many have words, their mean length, and words of the longest."""

    items: int
    length: float
    words: int


@dataclass
class Index:
    """A posting's weight is its BM25 impact over the least score that a passage with OVERLAP of the item's terms can
    have, so that the threshold is 1 for all items."""

    totals: Totals
    ids: list = field(default_factory=list)
    terms: np.ndarray = None  # sorted hashes
    sizes: tuple[int, ...] = ()  # words of a term that occur
    first: np.ndarray = None  # postings first[t] .. first[t + 1] - 1 are those of term t, by item
    items: np.ndarray = None
    weights: np.ndarray = None
    of_item: np.ndarray = None  # of_item[i] .. of_item[i + 1] - 1: the numbers of item i's terms, and which are its answer's
    numbers: np.ndarray = None
    answers: np.ndarray = None
    postings: dict = field(default_factory=dict)

    @staticmethod
    def build(items: list[tuple[object, Bag, np.ndarray]], totals: Totals) -> Index:
        """items: id, bag, and in how many of all items each of its terms occurs."""
        weights = []
        for _, x, df in items:
            idf = np.log(1 + (totals.items - df + 0.5) / (df + 0.5))
            impact = idf * x.tf * (K1 + 1) / (x.tf + K1 * (1 - B + B * x.length / totals.length))
            weights.append(impact / np.sort(impact)[: math.ceil(OVERLAP * len(impact))].sum())
        every = np.concatenate([x.terms for _, x, _ in items])
        owner = np.repeat(np.arange(len(items)), [len(x.terms) for _, x, _ in items])
        order = np.lexsort((owner, every))
        terms, number = np.unique(every, return_inverse=True)
        return Index(
            totals, [i for i, _, _ in items], terms, tuple(sorted({x.size for _, x, _ in items})),
            np.append(np.searchsorted(every[order], terms), len(every)), owner[order].astype(np.int32), np.concatenate(weights)[order],
            np.concatenate([[0], np.cumsum([len(x.terms) for _, x, _ in items])]), number.astype(np.int32), np.concatenate([x.answer for _, x, _ in items]),
        )

    def posting(self, term: int) -> tuple[list, list, list, float]:
        """Items, weights, blocks (last item, most weight) and most weight of a term; kept once a passage has it."""
        found = self.postings.get(term)
        if found is None:
            own = slice(self.first[term], self.first[term + 1])
            i, w = self.items[own].tolist(), self.weights[own].tolist()
            blocks = [(i[min(k + POSTINGS, len(i)) - 1], max(w[k : k + POSTINGS])) for k in range(0, len(i), POSTINGS)]
            found = self.postings[term] = i, w, blocks, max(w)
        return found

    def item(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.of_item[item], self.of_item[item + 1])
        return self.numbers[own], self.answers[own]

    def search(self, terms: list[int], least: float = 1 - 1e-9) -> list[tuple[int, float]]:
        """All items that score least or more for a passage with these terms, by block-max WAND."""
        cursors = [[p[0][0], 0, p] for p in map(self.posting, terms)]  # item, place, list
        found = []

        def seek(c: list, item: int) -> bool:
            items, place = c[2][0], c[1]
            while place < len(items) and items[place] < item:
                block = place // POSTINGS
                place = (block + 1) * POSTINGS if c[2][2][block][0] < item else place + 1
            c[1] = place
            if place >= len(items):
                return False
            c[0] = items[place]
            return True

        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for k, c in enumerate(cursors):
                bound += c[2][3]
                if bound >= least:
                    pivot = k
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            ahead = [self._block(c, item) for c in cursors[: pivot + 1]]
            if sum(w for _, w in ahead) < least:
                # no item up to the nearest end of these blocks can reach it, nor any before the next list starts
                to = min(end for end, _ in ahead) + 1
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                to = max(to, item + 1)
                cursors = [c for k, c in enumerate(cursors) if k > pivot or seek(c, to)]
            elif cursors[0][0] == item:
                score = sum(c[2][1][c[1]] for c in cursors[: pivot + 1])
                if score >= least:
                    found.append((item, score))
                cursors = [c for k, c in enumerate(cursors) if k > pivot or seek(c, item + 1)]
            else:
                cursors = [c for c in cursors if c[0] >= item or seek(c, item)]
        return found

    @staticmethod
    def _block(c: list, item: int) -> tuple[float, float]:
        """(last item, most weight) of the list's block that may hold the item."""
        block = c[1] // POSTINGS
        blocks = c[2][2]
        while block < len(blocks) and blocks[block][0] < item:
            block += 1
        return blocks[block] if block < len(blocks) else (math.inf, 0.0)

    def hits(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, term and words of the term, wherever a term occurs within a text."""
        at, term, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if not len(self.terms):
            return at[0], term[0], size[0]
        seen = np.zeros(1 << 20, bool)
        seen[(self.terms & np.uint64(0xFFFFF)).astype(np.int64)] = True
        for k in self.sizes:
            g = t.grams(k)
            maybe = np.flatnonzero(seen[(g & np.uint64(0xFFFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.terms, g[maybe]), len(self.terms) - 1)
            ok = (self.terms[place] == g[maybe]) & (t.doc[maybe] == t.doc[maybe + k - 1])
            at.append(maybe[ok])
            term.append(place[ok])
            size.append(np.full(ok.sum(), k))
        return np.concatenate(at), np.concatenate(term), np.concatenate(size)

    def _held(self, item: int, terms: list[int], starts: list[int], ends: list[int], width: int) -> tuple:
        """(overlap, score, question's overlap, answer's) of the best window of so many words that verifies, or ()."""
        own, answer = self.item(item)
        part = dict(zip(own.tolist(), answer.tolist(), strict=True))
        whole = [int((~answer).sum()), int(answer.sum())]
        least, met, best, to = OVERLAP * len(own) - 1e-9, [0, 0], (), 0
        many: dict[int, int] = {}
        if len(set(terms)) < least:
            return ()
        for k, at in enumerate(starts):
            grown = k == 0
            while to < len(terms) and ends[to] <= at + width:
                x = terms[to]
                many[x] = many.get(x, 0) + 1
                if many[x] == 1:
                    met[part[x]] += 1
                    grown = True
                to += 1
            if grown and sum(met) >= least:
                parts = [m / n if n else 1.0 for m, n in zip(met, whole, strict=True)]
                if min(parts) >= PART_OVERLAP and (not best or sum(met) / len(own) >= best[0]):
                    score = sum(self._weight(x, item) for x, n in many.items() if n)
                    best = max(best, (sum(met) / len(own), score, parts[0], parts[1]))
            many[terms[k]] -= 1
            if not many[terms[k]]:
                met[part[terms[k]]] -= 1
        return best

    def _weight(self, term: int, item: int) -> float:
        items, weights = self.posting(term)[:2]
        return weights[bisect_left(items, item)]

    def matches(self, t: Texts) -> list[tuple[int, int, float, float, float, float]]:
        """(text, item, score, overlap, question's, answer's) of each text's best passage, wherever it starts, for each item that verifies."""
        at, term, size = self.hits(t)
        if not len(at):
            return []
        step = max(PASSAGE, 2 * self.totals.words) // 2
        doc, word = t.doc[at], at - t.first[t.doc[at]]
        # searched are passages of three steps, a step apart, as each window of two steps is within one, wherever it starts
        last = word // step
        rows, back = np.tile(np.arange(len(at)), 3), np.repeat(np.arange(3), len(at))
        fits = (last[rows] >= back) & (word[rows] + size[rows] <= (last[rows] - back + 3) * step)
        rows, passage = rows[fits], (last[rows] - back)[fits]
        order = np.lexsort([word[rows], passage, doc[rows]])
        rows, passage = rows[order], passage[order]
        cut = np.flatnonzero(np.append(True, (np.diff(doc[rows]) != 0) | (np.diff(passage) != 0)))
        best: dict[tuple[int, int], tuple] = {}
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(rows)], strict=True):
            terms, start = term[rows[lo:hi]], word[rows[lo:hi]]
            for item, _ in self.search(np.unique(terms).tolist()):
                own = np.isin(terms, self.item(item)[0])
                if held := self._held(item, terms[own].tolist(), start[own].tolist(), (start + size[rows[lo:hi]])[own].tolist(), 2 * step):
                    key = (int(doc[rows[lo]]), item)
                    best[key] = max(best.get(key, ()), held)
        return [(doc, item, b[1], b[0], b[2], b[3]) for (doc, item), b in sorted(best.items())]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = bags(b.column(1).to_pylist())
        own = [i for i, x in enumerate(found) if x is not None]
        columns = zip(*((x.words, x.size, x.length, x.terms.view(np.int64).tolist(), x.tf.tolist(), x.answer.tolist()) for x in found if x is not None), strict=True)
        if own:
            names = ["item_id", "words", "size", "length", "terms", "tf", "answer"]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), *map(pa.array, columns)], names=names).cast(
                pa.schema([(n, t) for n, t in zip(names, [b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_())], strict=True)])
            )


def indexes(items: DataFrame) -> Iterator[Index]:
    """Bounded indexes over all items. In how many items a term occurs is counted over all, so an item scores alike in any
    index. The driver reads the items' terms one after another, and holds those of one index."""
    kind = items.schema["item_id"].dataType.simpleString()
    found = items.select("item_id", "text").where("text is not null").mapInArrow(_bags, f"item_id {kind}, words int, size int, length int, terms array<long>, tf array<int>, answer array<boolean>")
    found = written(found.withColumn("row", F.expr("uuid()")))
    every = found.agg(F.count("*"), F.avg("length"), F.max("words")).first()
    if not every[0]:
        return
    totals = Totals(*every)
    postings = found.select("row", F.explode(F.arrays_zip("terms", "tf", "answer")).alias("x")).select("row", "x.*")
    df = postings.groupBy("terms").agg(F.count("*").alias("df"))
    own = postings.join(df, "terms").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("terms", "tf", "answer", "df"))).alias("x"))
    rows = found.select("row", "item_id", "words", "size", "length").join(own, "row").select("item_id", "words", "size", "length", "x.terms", "x.tf", "x.answer", "x.df")
    held, many = [], 0
    for r in rows.toLocalIterator():
        terms = np.array(r["terms"], np.int64).view(np.uint64)
        order = np.argsort(terms)
        tf, answer, df = (np.array(r[c])[order] for c in ("tf", "answer", "df"))
        held.append((r["item_id"], Bag(r["words"], r["size"], r["length"], terms[order], tf, answer), df))
        many += len(terms)
        if many >= INDEX_TERMS:
            yield Index.build(held, totals)
            held, many = [], 0
    if held:
        yield Index.build(held, totals)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each row of docs and item that one of its passages holds: doc_id, item_id, score, overlap,
    question_overlap, answer_overlap.

    A passage holds an item if OVERLAP of the item's different shingles are in it, and PART_OVERLAP of both its question's
    and its answer's (the last line, or the last third of a single line). The search finds all items above a threshold that
    no such passage can miss. Null and empty texts or items match nothing; null ids are kept as such; repeated rows match
    alike, repeated items each; no documents or no items give no rows; other columns are left out. Of passages with equal
    overlap the one of the highest score counts. A very long text is worked on alone, its passages one after another. A map
    over documents: nothing of them is shuffled; an index has a bounded size.
    """
    kinds = [docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, overlap double, question_overlap double, answer_overlap double"
    id_type = to_arrow_type(items.schema["item_id"].dataType)
    rows, out = docs.select("doc_id", "text"), None
    for index in indexes(items):
        sent = docs.sparkSession.sparkContext.broadcast(index)  # INDEX_TERMS bounds it

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in batches:
                for lo, _, t in chunks(b, fold=True, spaces=_PARTS):
                    if found := index.matches(t):
                        doc, item, *rest = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array(np.array(doc) + lo)), pa.array([index.ids[i] for i in item], id_type), *(pa.array(x, pa.float64()) for x in rest)],
                            names=["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"],
                        )

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs whose passages hold no item, with the columns of docs; see contaminated()."""
    for k, index in enumerate(indexes(items)):
        sent = docs.sparkSession.sparkContext.broadcast(index)  # INDEX_TERMS bounds it

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for lo, _, t in chunks(b, fold=True, spaces=_PARTS):
                    for doc, *_ in sent.value.matches(t):
                        keep[lo + doc] = False
                yield b.filter(pa.array(keep))

        # one index at a time in a worker
        docs = (written(docs) if k else docs).mapInArrow(run, docs.schema)
    return docs


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contaminated(docs, items)
