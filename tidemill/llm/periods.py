"""Periodic runs of words by the harmonic grid.

A run is a stretch of consecutive words with smallest period q, at least `max(LEAST_LENGTH, 2 * q)` words long, that no neighbouring
word extends keeping period q. For every period p the grid has the places p, 2p, 3p, ...: a run of period p holds two neighbouring places of
it, whose words are equal, and it reaches as far as the texts around these two agree. So for each pair (jp, (j+1)p) the longest common
extension is asked for forwards and backwards, and the stretch from where the one ends to where the other ends is a run of period p if they
come to p words together. The grids have n + n/2 + n/3 + ... pairs, so a text of n words takes O(n log n) queries.

Extensions come from a suffix array of the words (prefix doubling), its neighbours' common prefixes and range minimum queries over these
(minima of blocks in a sparse table); backward ones from the same of the reversed words. Texts are worked on together, some
`TOGETHER` words at a time, with a word of its own after each, so that nothing reaches over a text's end. Pairs whose words differ,
and pairs without three equal words on either side, can't belong to a run (its two extensions come to six words at least) and are never
asked for; texts without other pairs don't enter a suffix array. A stretch found with several periods counts with the smallest:
by the periodicity lemma that is its smallest period.

Work is a map over rows, in memory of about 200 bytes a word of the longest text. No rows meet, so no key can be hot.

Defined cases: null text has no words and no runs; a null doc_id is a row like others and its words are never edited; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.text import texts_of

LEAST_LENGTH = 12
#: Words of neighbouring texts that are worked on together; a longer text goes alone.
TOGETHER = 1 << 17
#: Grid pairs that are looked at together.
PAIRS = 1 << 20
#: Common prefixes under one entry of the sparse table.
BLOCK = 16


class Numbers(dict):
    """A number for each distinct word."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


class Extensions:
    """Longest common extensions in an array of numbers: suffix array, common prefixes of its neighbours, range minima."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        ranks = [np.unique(values, return_inverse=True)[1].astype(np.int32)]
        order, step = np.argsort(ranks[0], kind="stable"), 1
        while len(ranks[-1]) and ranks[-1].max() < n - 1:
            ahead = np.zeros(n, np.int64)
            ahead[: n - step] = ranks[-1][step:] + 1
            keys = ranks[-1].astype(np.int64) * (n + 1) + ahead
            order = np.argsort(keys, kind="stable")
            new = np.concatenate([[0], np.cumsum(np.diff(keys[order]) != 0)])
            following = np.empty(n, np.int32)
            following[order] = new
            ranks.append(following)
            step *= 2
        self.rank = ranks[-1]
        self.common = self._common(order, ranks[:-1])
        pad = np.full(-n % BLOCK, np.iinfo(np.int32).max, np.int32)
        blocks = np.concatenate([self.common, pad]).reshape(-1, BLOCK)
        self.ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        self.behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.table = [blocks.min(axis=1)]
        while 2 << len(self.table) <= 2 * len(blocks):
            low, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(low[:-half], low[half:]))

    @staticmethod
    def _common(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
        """For each place of the suffix array, how much its suffix has in common with the one before."""
        a, b = order[:-1].copy(), order[1:].copy()
        found = np.zeros(len(a), np.int32)
        for level in range(len(ranks) - 1, -1, -1):
            inside = (a < len(order)) & (b < len(order))
            same = np.zeros(len(a), bool)
            same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
            found[same] += 1 << level
            a[same] += 1 << level
            b[same] += 1 << level
        return np.concatenate([np.zeros(min(1, len(order)), np.int32), found])

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How far the suffixes at `x` and `y`, which differ, agree."""
        one, two = self.rank[x].astype(np.int64), self.rank[y].astype(np.int64)
        low, high = np.minimum(one, two) + 1, np.maximum(one, two)
        out = np.minimum(self.behind[low], self.ahead[high])
        first, last = low // BLOCK, high // BLOCK
        near = first == last
        if near.any():
            a, b = low[near], high[near]
            least = self.common[a]
            for k in range(1, BLOCK):
                least = np.minimum(least, self.common[np.minimum(a + k, b)])
            out[near] = least
        width = last - first - 1
        far = width > 0
        if far.any():
            a, b, size = first[far] + 1, last[far], width[far]
            level = np.frexp(size.astype(np.float64))[1] - 1
            least = np.empty(len(a), np.int32)
            for k in np.unique(level):
                own = level == k
                least[own] = np.minimum(self.table[k][a[own]], self.table[k][b[own] - (1 << k)])
            out[far] = np.minimum(out[far], least)
        return out


def grid(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of neighbouring grid places of every period of every text, as places of the joined texts, some at a time."""
    for first, last in slices(sizes * (np.log(np.maximum(sizes, 2)) + 1)):
        own = sizes[first:last]
        periods = own // 2
        period = np.arange(periods.sum()) - np.repeat(np.cumsum(periods) - periods, periods) + 1
        base = np.repeat(starts[first:last], periods)
        counts = (np.repeat(own, periods) - 1) // np.maximum(period, 1)
        for a, b in slices(counts):
            part = counts[a:b]
            p = np.repeat(period[a:b], part)
            j = np.arange(len(p)) - np.repeat(np.cumsum(part) - part, part)
            x = np.repeat(base[a:b], part) + j * p
            yield x, x + p


def slices(weights: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of runs of entries that weigh about `PAIRS` together, one entry at least."""
    reached = np.cumsum(weights)
    first = 0
    while first < len(weights):
        before = reached[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(reached, before + PAIRS, "right")))
        yield first, last
        first = last


def agreeing(values: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs have equal words, and three equal words from there on or three before."""
    own = np.flatnonzero(values[x] == values[y])
    a, b = x[own], y[own]
    on = (values[a + 1] == values[b + 1]) & (values[a + 2] == values[b + 2])
    back = (values[a - 1] == values[b - 1]) & (values[a - 2] == values[b - 2]) & (values[a - 3] == values[b - 3])
    return own[on | back]


def runs(texts: list[list[int]], least: int = LEAST_LENGTH) -> tuple[np.ndarray, ...]:
    """text, start, end, period of every run, ordered by text, start and period. `texts` hold numbers of words, from 0."""
    none = (np.zeros(0, np.int64),) * 4
    sizes = np.array([len(t) for t in texts], np.int64)
    long = np.flatnonzero(sizes >= least)
    if not len(long):
        return none
    values, starts = joined([texts[k] for k in long.tolist()])
    found = [(x[keep], y[keep]) for x, y in grid(starts, sizes[long]) for keep in [agreeing(values, x, y)] if len(keep)]
    if not found:
        return none
    x, y = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    # the texts that have such pairs, joined anew
    owner = np.searchsorted(starts, x, "right") - 1
    kept, owner = np.unique(owner, return_inverse=True)
    moved = starts[kept]
    values, starts = joined([texts[k] for k in long[kept].tolist()])
    x, y = x - moved[owner] + starts[owner], y - moved[owner] + starts[owner]
    # the array begins and ends with words of its own, so that no extension reaches its edge
    ahead = Extensions(values).of(x, y).astype(np.int64)
    mirror = len(values) - 1
    behind = Extensions(values[::-1]).of(mirror - (x - 1), mirror - (y - 1)).astype(np.int64)
    period = y - x
    whole = ahead + behind >= np.maximum(period, least - period)
    start, end, period, owner = (x - behind)[whole], (y + ahead)[whole], period[whole], owner[whole]
    order = np.lexsort((period, end, start))
    start, end, period, owner = start[order], end[order], period[order], owner[order]
    new = np.concatenate([[True], (np.diff(start) != 0) | (np.diff(end) != 0)]) if len(start) else np.zeros(0, bool)
    start, end, period, owner = start[new], end[new], period[new], owner[new]
    order = np.lexsort((period, start))
    return tuple(v[order] for v in (long[kept][owner], start - starts[owner], end - starts[owner], period))


def joined(texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after the other, with three words of their own at both ends and one between; where each begins."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = 3 + np.cumsum(sizes + 1) - (sizes + 1)
    values = -1 - np.arange(int(sizes.sum()) + len(texts) + 5)
    for start, text in zip(starts.tolist(), texts, strict=True):
        values[start : start + len(text)] = text
    return values, starts


def edited(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document of the op12 contract: a tenth of them, by a hash of doc_id, repeat a stretch to their end."""
    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    stretch = words[a : a + p]
    return words[:a] + (stretch * ((n - a) // p + 1))[: n - a]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run (start, end, period) repeats after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, end, period in found:
        gone[start + period] += 1
        gone[end] -= 1
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    return [words[k] for k in kept.tolist()]


def periodic_runs(docs: DataFrame, *, least: int = LEAST_LENGTH, edit: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id and the runs of every row of `docs` (doc_id, text): n_runs, the longest one, digests and, if asked for, runs and collapsed text.

    The longest run is start (word number), length, period, exponent_milli; ties go to the smallest start, then period. `edit` plants the
    repetitions of the op12 contract first.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [("n_runs", pa.int64()), *[(n, pa.int64()) for n in ("start", "length", "period", "exponent_milli")], ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
    ddl = f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    if with_text:
        fields += [("runs", pa.list_(pa.list_(pa.int64()))), ("collapsed", pa.string())]
        ddl += ", runs array<array<long>>, collapsed string"

    def described(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
        longest = max(found, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
        best = (None,) * 4 if longest is None else (longest[0], longest[1] - longest[0], longest[2], 1000 * (longest[1] - longest[0]) // longest[2])
        lines = "".join([f"{s},{e - s},{p}\n" for s, e, p in found])
        text = b" ".join(collapsed(words, found) if found else words)
        row = (len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest())
        return (*row, [[s, e - s, p] for s, e, p in found], text.decode()) if with_text else row

    def worked(texts: list[list[bytes]]) -> list[tuple]:
        numbers = Numbers()
        owner, start, end, period = runs([list(map(numbers.__getitem__, t)) if len(t) >= least else [] for t in texts], least)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        all_runs = list(zip(start.tolist(), end.tolist(), period.tolist(), strict=True))
        return [described(words, all_runs[bounds[k] : bounds[k + 1]]) for k, words in enumerate(texts)]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, waiting, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                words = edited(text.split(), doc_id) if edit else text.split()
                if waiting and size + len(words) > TOGETHER:
                    rows += worked(waiting)
                    waiting, size = [], 0
                waiting.append(words)
                size += len(words)
            rows += worked(waiting)
            columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], ["doc_id", *[n for n, _ in fields]])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(found, ddl)
