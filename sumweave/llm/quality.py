"""Quality rules as a short-circuit cascade: rules with the most rejection per cost, by a sample, go first."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import Texts, chunks, mix

#: The symbol characters.
SYMBOLS = b"#*$%&|<>"
#: Documents that costs and selectivities are estimated on; the outcome doesn't depend on them, only the order.
SAMPLE = 200
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_IS_UPPER = np.isin(np.arange(256), np.arange(65, 91))
#: ASCII letters, and all bytes of other characters.
_IS_LETTER = _IS_UPPER | np.isin(np.arange(256), np.arange(97, 123)) | (np.arange(256) >= 128)


class Features:
    """Counts for each text; each is computed when a rule first asks for it. Some rows of others' have the counts that are
    known there, and copy texts only for a new one."""

    def __init__(self, texts: Texts | None, of: Features | None = None, rows: np.ndarray | None = None):
        self._of, self._rows = of, rows
        if texts is not None:
            self.t, self.n = texts, texts.n
        else:
            self.n = len(rows)
            self.__dict__ |= {k: tuple(x[rows] for x in v) if isinstance(v, tuple) else v[rows] for k, v in of.__dict__.items() if k not in ("t", "n", "_of", "_rows")}

    def take(self, rows: np.ndarray) -> Features:
        return Features(None, self, rows)

    @cached_property
    def t(self) -> Texts:
        return self._of.t.take(self._rows)

    def _sum(self, marks: np.ndarray) -> np.ndarray:
        """Marked bytes in each text."""
        total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return total[self.t.offs[1:]] - total[self.t.offs[:-1]]

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.t.first)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self._sum(~self.t.spaces[self.t.buf] & ((self.t.buf & 0xC0) != 0x80))

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._sum(_IS_SYMBOL[self.t.buf])

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self._sum(_IS_UPPER[self.t.buf])

    @cached_property
    def n_ascii_letters(self) -> np.ndarray:
        return self._sum(_IS_LETTER[self.t.buf] & (self.t.buf < 128))

    @cached_property
    def n_letter_words(self) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(_IS_LETTER[self.t.buf], dtype=np.int64)])
        return np.bincount(self.t.doc[total[self.t.ends] > total[self.t.starts]], minlength=self.t.n)

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text: lines with a word, and different ones among them."""
        t = self.t
        feeds = np.flatnonzero(t.buf == 10)
        starts = np.union1d(t.offs[:-1], feeds + 1)
        ends = np.union1d(feeds, t.offs[1:])
        starts = starts[starts < len(t.buf)]
        starts = starts[t.buf[starts] != 10]  # the others are empty lines
        ends = ends[np.searchsorted(ends, starts, "right")]
        words = np.searchsorted(t.starts, ends) > np.searchsorted(t.starts, starts)
        starts, ends = starts[words], ends[words]
        doc = np.searchsorted(t.offs, starts, "right") - 1
        _, first = np.unique(mix(t.hashes(starts, ends) + mix(doc.astype(np.uint64))), return_index=True)
        return np.bincount(doc, minlength=t.n), np.bincount(doc[first], minlength=t.n)

    @cached_property
    def n_lines(self) -> np.ndarray:
        return self._lines[0]

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        return self._lines[0] - self._lines[1]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        t = self.t
        whole = t.whole(3)
        at = np.flatnonzero(whole)
        if not len(at):
            return np.zeros(t.n, np.int64)
        keys = mix(t.grams(3)[at] + mix(t.doc[at].astype(np.uint64)))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = at[twice]
        covered = np.zeros(len(t.words), bool)
        for j in range(3):
            covered[hit + j] = True
        return np.bincount(t.doc[covered], minlength=t.n)


@dataclass(frozen=True)
class Rule:
    """rejects(features) marks the texts that fail."""

    name: str
    rejects: Callable[[Features], np.ndarray]


BASE_RULES = (
    Rule("too_short", lambda f: f.n_words < 50),
    Rule("repetitive", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("word_length", lambda f: (f.word_chars < 3 * f.n_words) | (f.word_chars > 12 * f.n_words)),
    Rule("few_letters", lambda f: 10 * f.n_letter_words < 8 * f.n_words),
    Rule("dup_lines", lambda f: 2 * f.n_dup_lines > f.n_lines),
    Rule("shouting", lambda f: 2 * f.n_upper > np.maximum(1, f.n_ascii_letters)),
)


def ordered(rules: tuple[Rule, ...], batches: list[pa.RecordBatch], known: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """The rules by rejection per second on a sample, highest first; ties by name. Each is measured alone, beside the
    counts that are known anyway."""
    found = []
    for rule in rules:
        seconds, out, n = 1e-9, 0, 0
        for b in batches:
            for _, _, texts in chunks(b):
                features = Features(texts)
                for c in known:
                    getattr(features, c)
                began = time.perf_counter()
                out += int(rule.rejects(features).sum())
                seconds += time.perf_counter() - began
                n += texts.n
        found.append((-(out / max(n, 1)) / seconds, rule.name, rule))
    return tuple(r for *_, r in sorted(found, key=lambda x: x[:2]))


def passes(rules: tuple[Rule, ...], features: Features) -> np.ndarray:
    """Marks the texts that no rule rejects; a rule only sees those that are left when its turn comes."""
    left, out = np.arange(features.n), np.zeros(features.n, bool)
    for rule in rules:
        bad = rule.rejects(features)
        if bad.any():
            left = left[~bad]
            features = features.take(np.flatnonzero(~bad))
        if not len(left):
            break
    out[left] = True
    return out


def plan(docs: DataFrame, rules: tuple[Rule, ...], known: tuple[str, ...] = (), sample: int = SAMPLE) -> tuple[Rule, ...]:
    """Orders the rules on the sample documents of least hash (whole texts, but none of 100,000 characters or more, which
    bounds what the driver gets). Only the order of evaluation depends on them, never a verdict."""
    picked = docs.where(F.length("text") < 100_000).select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample)
    texts = docs.join(F.broadcast(picked.select("doc_id").distinct()), "doc_id").select("text").limit(2 * sample)  # sample ids at most
    return ordered(rules, texts.toArrow().to_batches(), known)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that no rule rejects, with the columns of docs, whatever their names. Null text counts as empty, and
    is too short by RULES. Repeated rows are judged alike; an empty table stays empty. A very long text is judged whole,
    alone. A count on a rule's bound passes."""
    rules = plan(docs, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [passes(rules, Features(t)) for _, _, t in chunks(b)]
            if keep:
                yield b.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def query(docs: DataFrame) -> DataFrame:
    """Counts and verdict of each row of docs (doc_id, text). Null and empty texts: no words, base_failed, not kept. Repeated
    rows are judged alike, a very long text whole; other columns are left out; no documents give no rows.

    The base rules' counts are asked for all rows; the other rules are a cascade over what the base rules leave."""
    rest = plan(docs, tuple(r for r in RULES if r not in BASE_RULES), COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in chunks(b):
                f = Features(texts)
                counts = [getattr(f, c) for c in COUNTS]
                failed = np.logical_or.reduce([r.rejects(f) for r in BASE_RULES])
                kept = np.zeros(texts.n, bool)
                good = np.flatnonzero(~failed)
                if len(good):
                    kept[good] = passes(rest, f.take(good))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(failed), pa.array(kept)],
                    names=["doc_id", *COUNTS, "base_failed", "kept"],
                )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


ORACLE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i, unnest(list_transform(range(1, len(ws) + 1), lambda k: CASE WHEN k + 2 <= len(ws) THEN array_to_string(ws[k:k + 2], ' ') END)) AS win FROM t),
c AS (SELECT r, w, i, win IS NOT NULL AND count(*) OVER (PARTITION BY r, win) > 1 AS dup FROM w),
g AS (SELECT r, w, max(dup::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS again FROM c),
a AS (SELECT r, sum(length(w)) AS word_chars, sum(again) AS n_repeat_words, sum(CASE WHEN regexp_matches(w, '[A-Za-z\x{80}-\x{10FFFF}]') THEN 1 ELSE 0 END) AS n_letter_words FROM g GROUP BY r),
l AS (SELECT r, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS ls FROM t),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, coalesce(n_letter_words, 0) AS n_letter_words,
  length(regexp_replace(x, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(x, '[^A-Za-z]', '', 'g')) AS n_letters FROM t JOIN l USING (r) LEFT JOIN a USING (r)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 12 * n_words
  OR 10 * n_letter_words < 8 * n_words OR 2 * n_dup_lines > n_lines OR 2 * n_upper > greatest(1, n_letters)) AS kept FROM v
"""
