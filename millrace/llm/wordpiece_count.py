"""Greedy word-piece token counts by a linear longest-match automaton; no piece is built."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from millrace.llm._common import ship, split_words

#: Distinct words that a worker remembers; then it starts afresh. Longer words aren't remembered.
WORDS, LONGEST = 600_000, 64
#: Longer words would be one unknown token, as in the usual greedy tokenizer after its splits at punctuation; words here are cut at
#: white space only, so there is no such limit.
MAX_CHARS = math.inf


def pieces_of(vocabulary: Iterable[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """(word-initial, continuing) pieces of a vocabulary of (piece, kind) that marks word starts with ``▁``."""
    normal = [p for p, kind in vocabulary if kind == "normal"]
    return sorted({p[1:] for p in normal if p[0] == "▁" and len(p) > 1 and "▁" not in p[1:]}), sorted({p for p in normal if "▁" not in p})


class LongestMatch:
    """A trie of initial pieces (from the root) and continuing pieces (from a second root). A failure link of a node leads to
    where the walk goes on once the longest pieces inside the node's string are popped; ``pops`` counts those pieces."""

    def __init__(self, initial: Iterable[str], continuing: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # 0: a word starts, 1: a word goes on
        self.final = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                at = root
                for c in piece:
                    to = self.next[at].get(c)
                    if to is None:
                        to = self.next[at][c] = len(self.next)
                        self.next.append({})
                        self.final.append(False)
                    at = to
                if at > 1:
                    self.final[at] = True
        n = len(self.next)
        self.fail, self.pops = [-1] * n, [0] * n
        queue = deque((root, c, to) for root in (0, 1) for c, to in self.next[root].items())
        while queue:
            parent, c, at = queue.popleft()
            if self.final[at]:  # the whole string is a piece
                self.fail[at], self.pops[at] = 1, 1
            else:  # the parent's pieces, then as far as c can be read
                to, popped = self.fail[parent], self.pops[parent]
                while to >= 0 and c not in self.next[to]:
                    popped += self.pops[to]
                    to = self.fail[to]
                if to >= 0:
                    self.fail[at], self.pops[at] = self.next[to][c], popped
            queue.extend((at, d, to) for d, to in self.next[at].items())

    def count(self, word: str) -> int:
        """Pieces of the word by greedy longest match; 0 if it can't be cut into pieces."""
        if len(word) > MAX_CHARS:
            return 0
        at = total = 0
        step, fail, pops = self.next, self.fail, self.pops
        for c in word:
            to = step[at].get(c)
            while to is None:
                total += pops[at]
                at = fail[at]
                if at < 0:
                    return 0
                to = step[at].get(c)
            at = to
        while at != 1:  # what is left must end in whole pieces
            total += pops[at]
            at = fail[at]
            if at < 0:
                return 0
        return total


class _Counts(dict):
    def __init__(self, automaton: LongestMatch):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word.decode())
        if len(word) <= LONGEST:
            if len(self) >= WORDS:
                self.clear()
            self[word] = n
        return n


_workers: dict[int, _Counts] = {}


def _counts(pieces: Broadcast) -> _Counts:
    initial, continuing = pieces.value
    key = hash((len(initial), len(continuing), tuple(initial[::997]), tuple(continuing[::997])))
    if key not in _workers:
        _workers.clear()
        _workers[key] = _Counts(LongestMatch(initial, continuing))
    return _workers[key]


def count_word_pieces(docs: DataFrame, initial: list[str], continuing: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every document's whole text.

    n_tokens sums the pieces of all words; a word of any length that can't be cut is one unknown token
    and counts in n_unknown. Null and empty texts have zeros. Repeated rows are counted each; other columns don't pass; an empty table gives no
    rows. There is no shuffle.
    """
    spark = docs.sparkSession
    ship(spark)
    pieces = spark.sparkContext.broadcast((initial, continuing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(pieces)
        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.binary()):
                found = list(map(counts.__getitem__, split_words(text.as_py() or b"")))
                unknown = found.count(0)
                rows.append((len(found), sum(found) + unknown, unknown))
            columns = [list(c) for c in zip(*rows)] or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=[id_col, "n_words", "n_tokens", "n_unknown"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_words long, n_tokens long, n_unknown long")
