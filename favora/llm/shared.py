"""What the operators of this subpackage share: scratch tables, word hashing and connected components.

Word hashing works on the bytes of a whole Arrow text column at once.  A word is a maximal run of code points other than
the space and U+0009 to U+000D; all of these are single bytes in UTF-8, so bytes and code points agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from favora.functions.tables import store

#: Texts are worked on in pieces of whole documents of about this many bytes, which bounds a task's memory.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Longer words, which are few, are hashed one by one.
LANED = 64
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
#: Words of which a worker keeps the ids.
REMEMBERED = 500_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pieces(batches: Iterator[pa.RecordBatch], text: int | str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of whole documents, about `most` bytes at a time; a null text counts as empty."""
    for batch in batches:
        at = batch.schema.get_field_index(text) if isinstance(text, str) else text
        column = pc.fill_null(batch.column(at), "").cast(pa.large_string())
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words before each document (one longer than the documents)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[1:-1][cuts]
    last[cuts - 1] = inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte of `data` on, as little-endian numbers; there are zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, with A-Z lower-cased if `fold`.

    Eight bytes at a time go through mix(), whose steps are bijective; words of more than LANED bytes take BLAKE2b.
    """
    data = _LOWER[data] if fold else data
    lanes = _lanes(data)
    starts, n = np.asarray(starts, np.int64), np.asarray(ends - starts, np.int64)
    h = (lanes[starts] & _KEEP[np.minimum(n, 8)]) * np.uint64(0x9FB21C651E98DF25) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = mix(h)
    long = np.flatnonzero(n > 8)
    for at in range(8, LANED, 8):
        long = long[n[long] > at]
        if not len(long):
            break
        lane = lanes[starts[long] + at] & _KEEP[np.minimum(n[long] - at, 8)]
        h[long] = mix(h[long] * np.uint64(0xD1342543DE82EF95) + mix(lane + np.uint64(0x2545F4914F6CDD1D)))
    for i in np.flatnonzero(n > LANED):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : starts[i] + n[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def same_bytes(data: np.ndarray, starts: np.ndarray, n: np.ndarray, other: np.ndarray, at: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the `n` bytes of `data` at `starts` are the `m` bytes of `other` at `at`, for each word."""
    same = n == m
    one, two = _lanes(data), _lanes(other)
    left = np.flatnonzero(same)
    for k in range(0, LANED, 8):
        left = left[same[left] & (n[left] > k)]
        if not len(left):
            return same
        same[left] = ((one[starts[left] + k] ^ two[at[left] + k]) & _KEEP[np.minimum(n[left] - k, 8)]) == 0
    for i in left[same[left] & (n[left] > LANED)]:
        same[i] = bool((data[starts[i] : starts[i] + n[i]] == other[at[i] : at[i] + n[i]]).all())
    return same


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the distinct words, sorted; the place of one word of each key; and the key's place for each word.

    Words are told apart by their bytes: of words that share a hash, all but one kind get keys of their own.
    """
    keys, one, which = np.unique(word_hashes(data, starts, ends, fold=False), return_index=True, return_inverse=True)
    n, rep = ends - starts, one[which]
    odd = np.flatnonzero(~same_bytes(data, starts, n, data, starts[rep], n[rep]))
    if not len(odd):
        return keys, one, which
    full = keys[which]
    taken = set(keys.tolist())
    named: dict[bytes, int] = {}
    for i in odd.tolist():
        word = data[starts[i] : ends[i]].tobytes()
        if word not in named:
            key = int(full[i])
            while key in taken:
                key = (key + 1) % (1 << 64)
            taken.add(key)
            named[word] = key
        full[i] = named[word]
    return np.unique(full, return_index=True, return_inverse=True)


class Words:
    """The ids of words seen before, by the words' hashes and bytes; of at most REMEMBERED words, others are looked up again."""

    def __init__(self) -> None:
        self.keys, self.at, self.n, self.ids = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.bytes, self.from_, self.size = np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)

    def find(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key, and whether the word there is the one that is asked for."""
        place = np.searchsorted(self.keys, keys)
        if not len(self.keys):
            return place, np.zeros(len(keys), bool)
        near = np.minimum(place, len(self.keys) - 1)
        known = self.keys[near] == keys
        which = np.flatnonzero(known)
        known[which] = same_bytes(data, starts[which], sizes[which], self.bytes, self.from_[near[which]], self.size[near[which]])
        return near, known

    def add(self, keys: np.ndarray, ids: np.ndarray, before: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Take sorted new keys with their ids and the words' bytes; a key that another word has is left to it."""
        place = np.searchsorted(self.keys, keys)
        free = np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] != keys if len(self.keys) else np.ones(len(keys), bool))
        place, start = place[free], before[:-1] + len(self.ids)
        upto = np.concatenate([[0], np.cumsum(sizes[free])])
        self.from_ = np.insert(self.from_, place, upto[:-1] + len(self.bytes))
        self.size = np.insert(self.size, place, sizes[free])
        self.bytes = np.concatenate([self.bytes, data[np.arange(upto[-1]) + np.repeat(starts[free] - upto[:-1], sizes[free])]])
        self.at = np.insert(self.at, place, start[free])
        self.n = np.insert(self.n, place, np.diff(before)[free])
        self.keys = np.insert(self.keys, place, keys[free])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def ids_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, search: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one after another, and the number of ids before each word.

        search(i) gives the same for the new words at the places i.
        """
        keys, one, which = distinct_words(data, starts, ends)
        starts, sizes = starts[one], (ends - starts)[one]
        place, known = self.find(keys, data, starts, sizes)
        n, at = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        n[known], at[known] = self.n[place[known]], self.at[place[known]]
        new = np.flatnonzero(~known)
        ids, before = search(one[new]) if len(new) else (np.empty(0, np.int64), np.zeros(1, np.int64))
        n[new], at[new] = np.diff(before), before[:-1] + len(self.ids)
        every = np.concatenate([self.ids, ids])
        if len(new) and len(self.keys) + len(new) <= REMEMBERED:
            self.add(keys[new], ids, before, data, starts[new], sizes[new])
        n = n[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        return every[np.arange(upto[-1]) + np.repeat(at[which] - upto[:-1], n)], upto


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Each document's sorted distinct hashes of its runs of `k` words; with fewer words, of all its words as one run."""
    starts, ends, at = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    runs = h.copy()
    for j in range(1, k):
        runs = mix(runs[: max(0, len(h) - j)] * np.uint64(0x9FB21C651E98DF25) + h[j:])
    out = []
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        n = hi - lo
        if n >= k:
            out.append(np.unique(runs[lo : hi - k + 1]))
        elif n:
            one = h[lo : lo + 1]
            for j in range(1, n):
                one = mix(one * np.uint64(0x9FB21C651E98DF25) + h[lo + j : lo + j + 1])
            out.append(mix(one + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of an undirected graph, component being its smallest node; nodes without an edge are not listed.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each a partial aggregation and an equi-join, so that
    no task holds a node's whole neighbourhood.  Every round is written to the shared folder.
    """
    e = store(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while True:
        tops = e.select(F.col("v").alias("u"))
        tall = e.join(tops, "u", "left_semi").limit(1).count()
        wide = 0 if tall else e.groupBy("u").count().where("count > 1").limit(1).count()
        if not tall and not wide:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("v"))
        rest = large.join(low.withColumnRenamed("v", "m"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = store(low.union(rest).distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
