"""Passages of evaluation items inside documents.

Method: windows of items and of documents get a SimHash fingerprint.  It is cut
into ``radius + 1`` blocks; two fingerprints within the radius agree in at least
one block, so looking every block up in a sorted index misses none of them.
Candidates are verified by the exact weighted similarity of their word shingles.
Windows are as long as the shortest passage that counts, or as long as the item.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.shared import written

_WORDS = re.compile(r"[^\W_]+")
#: Words of items indexed at a time (their index takes about 150 bytes each in a worker).
INDEXED_WORDS = 400_000
#: Words fingerprinted at a time (256 bytes each).
CHUNK = 50_000
#: Share of the items from which on a word that they have does not vote on fingerprints of whole items.
IDLE_SHARE = 0.05
#: Words of a shingle in the verification.
SHINGLE = 5


def _hashes(text: str, cache: dict[str, int]) -> list[int]:
    out = []
    for w in _WORDS.findall(text.lower()):
        h = cache.get(w)
        if h is None:
            if len(cache) > 300_000:
                cache.clear()
            h = cache[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return out


def _bit_sums(words: np.ndarray, idle: np.ndarray | None = None) -> np.ndarray:
    """Running sums of the words' votes (1 or -1) on each of 64 bits; ``idle`` words (sorted) do not vote."""
    votes = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.int8)
    votes = votes + votes - np.int8(1)
    if idle is not None and len(idle):
        votes[idle[np.minimum(np.searchsorted(idle, words), len(idle) - 1)] == words] = 0
    sums = np.zeros((len(words) + 1, 64), np.int32)
    np.cumsum(votes, axis=0, dtype=np.int32, out=sums[1:])
    return sums


def _prints(sums: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every window of ``size`` words: the majority of each bit."""
    if len(sums) <= size:
        return np.empty(0, np.uint64)
    return np.packbits(sums[size:] > sums[:-size], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(words: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every window of ``size`` words of a text of any length."""
    n = len(words) - size + 1
    return np.concatenate([_prints(_bit_sums(words[lo : lo + CHUNK + size - 1]), size) for lo in range(0, n, CHUNK)]) if n > 0 else np.empty(0, np.uint64)


def window_size(n_words: int) -> int:
    """Window of an item of ``n_words`` words: the largest step of the ladder 5, 6, 7, 8, 10, 12, 15, ... that it holds."""
    size = SHINGLE
    while (step := max(size + 1, size * 5 // 4)) <= n_words:
        size = step
    return size


class _Index:
    """Block tables of the items' windows, by window size.

    With a ``size`` every window of that many words of an item is in it, without
    one the middle window of about the item's own size.
    """

    def __init__(self, items: list[tuple[int, str]], size: int | None, radius: int) -> None:
        cache: dict[str, int] = {}
        self.radius, self.whole = radius, size is None
        self.ids = np.array([i for i, _ in items], np.int64)
        texts = [np.array(_hashes(text, cache), np.uint64) for _, text in items]
        ends = np.cumsum([0, *map(len, texts)])
        self.words = np.concatenate([np.empty(0, np.uint64), *texts])
        self.owner = np.repeat(np.arange(len(texts)), np.diff(ends))
        # Weights: the rarer a shingle among the items, the more it says.
        self.shingle = _window_keys(self.words, SHINGLE)
        seen = Counter(self.shingle.tolist())
        self.weight = np.array([math.log(1 + len(items) / seen[s]) + 1e-9 for s in self.shingle.tolist()])
        # What many items have would make the fingerprints of all texts alike.
        often = Counter(x for t in texts for x in set(t.tolist()))
        self.idle = np.array(sorted(w for w, n in often.items() if n > max(2, IDLE_SHARE * len(items))), np.uint64) if self.whole else None
        at: dict[int, list[np.ndarray]] = {}
        for k, w in enumerate(texts):
            if len(w) >= (size or SHINGLE):
                n = size or window_size(len(w))
                at.setdefault(n, []).append(ends[k] + (np.arange(len(w) - n + 1) if size else np.array([(len(w) - n) // 2])))
        edges = [round(64 * j / (radius + 1)) for j in range(radius + 2)]
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
        self.tables: list[tuple[int, np.ndarray, np.ndarray, list]] = []
        for n, places in sorted(at.items()):
            places = np.concatenate(places)
            prints = np.concatenate([_prints(_bit_sums(self.words[p : p + n], self.idle), n) for p in places.tolist()]) if self.whole else fingerprints(self.words, n)[places]
            tables = []
            for shift, mask in self.blocks:
                key = (prints >> shift) & mask
                order = np.argsort(key, kind="stable")
                tables.append((key[order], order))
            self.tables.append((n, places, prints, tables))
        self.ends = ends

    def search(self, words: np.ndarray, owner: np.ndarray, similarity: float) -> set[tuple[int, int]]:
        """Pairs (owner, item) with a window pair of at least this weighted similarity."""
        found: set[tuple[int, int]] = set()
        if not len(words) or not self.tables:
            return found
        widest = self.tables[-1][0]
        ours = _window_keys(words, SHINGLE)
        for lo in range(0, len(words), CHUNK):
            part = words[lo : lo + CHUNK + widest - 1]
            sums = _bit_sums(part, self.idle)
            for n, at, theirs, tables in self.tables:
                prints = _prints(sums, n)[:CHUNK]
                if not len(prints):
                    continue
                places = np.flatnonzero(owner[lo : lo + len(prints)] == owner[lo + n - 1 : lo + n - 1 + len(prints)])
                prints = prints[places]
                for (shift, mask), (keys, order) in zip(self.blocks, tables):
                    key = (prints >> shift) & mask
                    first, last = np.searchsorted(keys, key, side="left"), np.searchsorted(keys, key, side="right")
                    fan = last - first
                    for piece in np.array_split(np.flatnonzero(fan), max(1, int(fan.sum()) // 1_000_000)):
                        f = fan[piece]
                        left = np.repeat(piece, f)
                        right = order[np.repeat(first[piece], f) + np.arange(len(left)) - np.repeat(np.cumsum(f) - f, f)]
                        near = np.bitwise_count(prints[left] ^ theirs[right]) <= self.radius
                        x, y = lo + places[left[near]], at[right[near]]
                        found |= self._similar_items(ours, owner, x, y, n, similarity) if self.whole else self._similar_windows(ours, owner, x, y, n, similarity)
        return found

    def _similar_windows(self, ours: np.ndarray, owner: np.ndarray, x: np.ndarray, y: np.ndarray, size: int, similarity: float) -> set[tuple[int, int]]:
        """Windows compared place by place."""
        found: set[tuple[int, int]] = set()
        steps = np.arange(size - SHINGLE + 1)
        for k in range(0, len(x), 200_000):
            a, b = x[k : k + 200_000], y[k : k + 200_000]
            w = self.weight[b[:, None] + steps]
            good = ((ours[a[:, None] + steps] == self.shingle[b[:, None] + steps]) * w).sum(axis=1) >= similarity * w.sum(axis=1) - 1e-9
            found.update(zip(owner[a[good]].tolist(), self.ids[self.owner[b[good]]].tolist()))
        return found

    def _similar_items(self, ours: np.ndarray, owner: np.ndarray, x: np.ndarray, y: np.ndarray, size: int, similarity: float) -> set[tuple[int, int]]:
        """The share of an item's shingles that the document has around the window."""
        found: set[tuple[int, int]] = set()
        for a, k in {(int(a), int(self.owner[b])) for a, b in zip(x, y)}:
            pair = (int(owner[a]), int(self.ids[k]))
            if pair in found:
                continue
            lo, hi = int(self.ends[k]), int(self.ends[k + 1]) - SHINGLE + 1
            slack = hi - lo + SHINGLE - size + 2
            around = slice(max(0, a - slack), a + size - SHINGLE + 1 + slack)
            mine = ours[around][owner[around][: len(ours[around])] == owner[a]]
            w = self.weight[lo:hi]
            if w[np.isin(self.shingle[lo:hi], mine)].sum() >= similarity * w.sum() - 1e-9:
                found.add(pair)
        return found


def _window_keys(words: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = (h ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
    return h


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    passage: str = "question",
    size: int | None = 13,
    radius: int = 1,
    similarity: float = 1.0,
    indexed_words: int = INDEXED_WORDS,
) -> DataFrame:
    """Documents with each item of which they hold a passage: distinct ``(doc_id, item_id)``.

    With a ``size`` a passage is a window of that many consecutive words (runs of
    letters and digits, without letter case) whose weighted shingle similarity to
    a window of the document is at least ``similarity``; at 1.0 all words are
    equal.  Without a ``size`` windows are as long as the items, and a passage
    is a whole item of which the document has at least ``similarity`` of the
    weighted shingles in one place, so that edited copies are found; how many of
    them, depends on ``radius`` (see the tests).

    Whole texts are searched.  Null texts and texts of fewer words give no rows,
    nor do items of fewer than ``size`` (or five) words; an id in several rows
    counts as one document with all their texts.  Items are indexed in blocks of
    about ``indexed_words`` words, one after the other: every block is searched
    in all documents before the driver reads the next.
    """
    known = items.select(F.col(item_key).cast("long").alias("i"), F.col(passage).alias("q")).where(F.col("i").isNotNull() & F.col("q").isNotNull()).distinct()
    n_words = known.agg(F.coalesce(F.sum(F.size(F.split("q", r"\s+"))), F.lit(0))).first()[0]
    n_blocks = max(1, -(-n_words // indexed_words))
    rows = docs.select(F.col(doc_key).cast("long").alias("doc"), F.col(text).alias("t")).where(F.col("doc").isNotNull() & F.col("t").isNotNull())
    out = None
    for block in range(n_blocks):
        part = known if n_blocks == 1 else known.where(F.pmod(F.xxhash64("i"), F.lit(n_blocks)) == block)
        found = rows.mapInArrow(_searcher([(r["i"], r["q"]) for r in part.collect()], size, radius, similarity), "doc_id bigint, item_id bigint")
        found = found if n_blocks == 1 else written(found, "leaks")
        out = found if out is None else out.unionByName(found)
    return out.distinct().select(F.col("doc_id").alias(doc_key), F.col("item_id").alias(item_key))


def _searcher(items: list[tuple[int, str]], size: int | None, radius: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, cache = None, {}
        for batch in batches:
            index = index or _Index(items, size, radius)
            found: set[tuple[int, int]] = set()
            docs = batch.column(0).to_pylist()
            words, owner = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                h = _hashes(t, cache)
                words += h
                owner += [k] * len(h)
                if len(words) >= CHUNK:
                    found |= index.search(np.array(words, np.uint64), np.array(owner, np.int64), similarity)
                    words, owner = [], []
            found |= index.search(np.array(words, np.uint64), np.array(owner, np.int64), similarity)
            yield pa.RecordBatch.from_arrays([pa.array([docs[a] for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["doc_id", "item_id"])

    return run
