"""Edit-aware token counts: a tree of pre-token counts for each document; an edit re-encodes what it touches."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Pre-tokens of a leaf, or words if the text is cut at its spaces.
LEAF = 64
#: Characters past its end that may decide where a pre-token ends (an apostrophe with the two letters after it).
CONTEXT = 3
#: Different words whose counts a worker keeps, and the longest that it keeps.
KEPT, LONGEST = 1_000_000, 64
#: Two blanks of which the last is a space: only there does a pre-token hold a space that isn't its first character.
_WIDE = re.compile(r"\s ")


def default_vocabulary() -> tuple[str, str]:
    """Path of a tokenizer's ranks file, and its pre-token pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Tokenizer:
    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.words: dict[str, int] = {}

    def count(self, piece: str) -> int:
        """Tokens of one pre-token."""
        return len(self.encoding._encode_single_piece(piece))

    def unit(self, unit: str) -> int:
        """Pre-tokens << 32 | tokens of a space with what follows it up to the next space."""
        pieces = self.pattern.findall(unit)
        return len(pieces) << 32 | sum(map(self.count, pieces))

    def total(self, words: list[str]) -> int:
        """Sum of unit(" " + word)."""
        try:
            return sum(map(self.words.__getitem__, words))
        except KeyError:
            out = 0
            for w in words:
                n = self.words.get(w)
                if n is None:
                    n = self.unit(" " + w)
                    if len(w) <= LONGEST:
                        if len(self.words) >= KEPT:
                            self.words.clear()
                        self.words[w] = n
                out += n
            return out


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


class TokenTree:
    """Pre-tokens of a text in leaves; each node holds the characters, pre-tokens and tokens below it.

    A text without wide blanks is cut at its spaces, where pre-tokens begin, so a leaf is known by its text until an edit
    reaches it, and its sums come from those of its words."""

    def __init__(self, text: str, tok: Tokenizer):
        self.tok, self.text, self.encoded = tok, text, 0
        self.leaves: list[tuple[str | None, list[str], list[int]]] = []
        sums = []
        if _WIDE.search(text):
            pieces = tok.pattern.findall(text)
            counts = [tok.count(x) for x in pieces]
            for k in range(0, len(pieces), LEAF):
                self.leaves.append((None, pieces[k : k + LEAF], counts[k : k + LEAF]))
                sums.append(self._sums(self.leaves[-1]))
        else:
            words = text.split(" ")
            for k in range(0, len(words), LEAF):
                part = words[k : k + LEAF]
                joined = " ".join(part)
                n = tok.total(part) if k else tok.unit(part[0]) + tok.total(part[1:])
                self.leaves.append((" " + joined if k else joined, [], []))
                sums.append((len(joined) + (k > 0), n >> 32, n & 0xFFFFFFFF))
        if not self.leaves:
            self.leaves, sums = [(None, [], [])], [(0, 0, 0)]
        self.base = 1
        while self.base < len(self.leaves):
            self.base *= 2
        self.nodes = [(0, 0, 0)] * self.base + sums + [(0, 0, 0)] * (self.base - len(sums))
        for k in range(self.base - 1, 0, -1):
            self._add(k)

    def _open(self, k: int) -> tuple[list[str], list[int]]:
        """Pre-tokens and counts of a leaf."""
        text, pieces, counts = self.leaves[k]
        if text is not None:
            pieces = self.tok.pattern.findall(text)
            counts = [self.tok.count(x) for x in pieces]
            self.leaves[k] = (None, pieces, counts)
        return pieces, counts

    @staticmethod
    def _sums(leaf: tuple[str | None, list[str], list[int]]) -> tuple[int, int, int]:
        return sum(map(len, leaf[1])), len(leaf[1]), sum(leaf[2])

    def _add(self, k: int) -> None:
        a, b = self.nodes[2 * k], self.nodes[2 * k + 1]
        self.nodes[k] = (a[0] + b[0], a[1] + b[1], a[2] + b[2])

    @property
    def n_pretokens(self) -> int:
        return self.nodes[1][1]

    @property
    def n_tokens(self) -> int:
        return self.nodes[1][2]

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the pre-token that holds character at; the last leaf past the end."""
        at = min(at, max(0, len(self.text) - 1))
        k, start = 1, 0
        while k < self.base:
            k *= 2
            if at >= start + self.nodes[k][0]:
                start += self.nodes[k][0]
                k += 1
        k -= self.base
        if k >= len(self.leaves):
            k = len(self.leaves) - 1
        return k, start

    def replace(self, start: int, end: int, new: str) -> None:
        """Puts new for text[start:end]. Scanning begins at the first pre-token that could have seen the edit, and ends
        where a pre-token begins at a place where one began before, after the edit."""
        old = self.text
        self.text = old[:start] + new + old[end:]
        shift = len(new) - (end - start)
        leaf, at = self._find(max(0, start - CONTEXT))
        pieces, place = self._open(leaf)[0], 0
        while place < len(pieces) and at + len(pieces[place]) + CONTEXT <= start:
            at += len(pieces[place])
            place += 1
        # a pre-token of blanks may end earlier for what follows it, so the one before is scanned again, too
        if place:
            place -= 1
            at -= len(pieces[place])
        elif leaf:
            leaf -= 1
            while leaf and not self.nodes[self.base + leaf][1]:
                leaf -= 1
            pieces = self._open(leaf)[0]
            place = max(0, len(pieces) - 1)
            at -= len(pieces[place]) if pieces else 0
        # old pre-tokens from here on, passed until the scan meets a beginning
        k, i, passed = leaf, place, at
        fresh: list[str] = []
        for m in self.tok.pattern.finditer(self.text, at):
            here = m.start()
            while passed + shift < here or passed < end:
                if i >= len(self._open(k)[0]):
                    if k + 1 >= len(self.leaves):
                        break
                    k, i = k + 1, 0
                    continue
                passed += len(self.leaves[k][1][i])
                i += 1
            if passed >= end and passed + shift == here and here >= start + len(new):
                break
            fresh.append(m.group())
        else:
            k = len(self.leaves) - 1
            i = len(self._open(k)[0])
        counts = [self.tok.count(x) for x in fresh]
        self.encoded += len(fresh)
        p, c = self._open(leaf)
        after_p, after_c = (x[i:] for x in self._open(k))
        if k == leaf:
            self.leaves[k] = (None, p[:place] + fresh + after_p, c[:place] + counts + after_c)
        else:
            self.leaves[leaf] = (None, p[:place] + fresh, c[:place] + counts)
            self.leaves[leaf + 1 : k] = [(None, [], [])] * (k - leaf - 1)
            self.leaves[k] = (None, after_p, after_c)
        for j in range(leaf, k + 1):
            self.nodes[self.base + j] = self._sums(self.leaves[j])
        touched = set(range((self.base + leaf) // 2, (self.base + k) // 2 + 1))
        while touched and touched != {0}:
            for j in touched:
                self._add(j)
            touched = {j // 2 for j in touched if j > 1}


#: What the query's edits redact, and what they put there.
REDACTIONS = (
    (re.compile(r"(?<![\w.+-])[\w.+-]{1,64}@[\w-]{1,64}(?:\.[\w-]{1,64})+"), "<email>", re.compile("@")),
    (re.compile(r"(?<!\d)\d{1,3}(?:\.\d{1,3}){3}(?!\d)"), "<ip>", re.compile(r"\d\.\d")),
    (re.compile(r"(?<!\d)\d{7,}(?!\d)"), "<number>", re.compile(r"\d{7}")),
)


def redactions(text: str) -> list[tuple[int, int, str]]:
    """(start, end, replacement) for e-mail and IP addresses and long numbers; none overlap, in order."""
    found: list[tuple[int, int, str]] = []
    for pattern, new, needs in REDACTIONS:
        if needs.search(text):
            found += [(m.start(), m.end(), new) for m in pattern.finditer(text)]
    found.sort()
    out: list[tuple[int, int, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


COLUMNS = ("n_chars", "n_pretokens", "n_tokens", "n_edits", "n_chars_edited", "n_pretokens_edited", "n_tokens_edited", "n_reencoded")


def count_tokens(docs: DataFrame, edits: Callable[[str], list[tuple[int, int, str]]] = redactions, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Tokens of each row of docs (doc_id, text) before and after its edits, which are applied from the last to the first;
    n_reencoded: the pre-tokens that they encoded anew.

    Null and empty texts: all zeros. Repeated rows count alike; no documents give no rows; other columns are left out. Of
    edits that start at one place the first in the list stays. A very long text is one tree in one task. A map over
    documents: nothing is shuffled. The vocabulary (path, pattern) is read by each worker from its own path.
    """
    path, pattern = vocabulary or default_vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, pattern)
        for b in batches:
            rows = []
            for text in b.column(1):
                tree = TokenTree(text.as_py() or "", tok)
                row = [len(tree.text), tree.n_pretokens, tree.n_tokens]
                todo = edits(tree.text)
                for start, end, new in reversed(todo):
                    tree.replace(start, end, new)
                rows.append((*row, len(todo), len(tree.text), tree.n_pretokens, tree.n_tokens, tree.encoded))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(len(COLUMNS)))], names=["doc_id", *COLUMNS])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COLUMNS))


def query(docs: DataFrame) -> DataFrame:
    return count_tokens(docs)
