"""Periodic runs of words, from branching tandem repeats in a suffix tree (Stoye and Gusfield, 2002).

A run is a longest stretch of consecutive words in which words `q` apart are identical, `q` being its smallest period, that
holds its period at least twice.

The words of some documents at a time, each document with an alphabet and an end mark of its own, go into one suffix tree.
It is held as the sorted suffixes with the lengths of their common prefixes: an inner node of depth d is an interval of
suffixes, cut in two at an entry of d (a node of several children is cut several times).  Of each cut only the smaller half's
leaves i are visited, which is n log n visits in all; where i + d or i - d is a leaf of the other half, the two suffixes agree in
exactly d words: a tandem repeat of period d that branches.  Every run ends in one.  A repeat is rotated to the left for as
long as words agree, and repeats that become the same stretch are merged into the run with the smallest period.

Every step works on whole arrays; a task needs some 250 bytes for each word of the longest of its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from favora.llm.shared import distinct_words, pieces, read, word_spans

#: Shorter runs don't count.
LEAST_LENGTH = 12
#: Leaves that are looked at together.
TOGETHER = 1 << 20
#: Bytes of text of the documents that share a tree.
TREE_BYTES = 1 << 19
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes in order, and for each k the suffixes' ranks by their first 2 ** k symbols (equal where those agree).

    No suffix may be the beginning of another one, so each text ends in a symbol that occurs once.
    """
    n = len(symbols)
    order = np.argsort(symbols)
    key = symbols[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, step = [rank], 1
    left = np.flatnonzero(~(first & np.append(first[1:], True)))
    while len(left):
        at = order[left]
        key = rank[at].astype(np.int64) * n + rank[at + step]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[left] = at
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(first, left, 0))
        levels.append(rank)
        left = left[~(first & np.append(first[1:], True))]
        step *= 2
    return order, levels


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of symbols in which the suffixes at `a` and `b` agree, for each pair of different suffixes."""
    out = np.zeros(len(a), np.int64)
    agree = [np.flatnonzero(levels[0][a] == levels[0][b])]
    for rank in levels[1:]:
        live = agree[-1]
        agree.append(live[rank[a[live]] == rank[b[live]]])
    for k in range(len(levels) - 1, -1, -1):
        live = agree[k]
        begun = out[live] > 0
        more = live[begun]
        more = more[levels[k][a[more] + out[more]] == levels[k][b[more] + out[more]]]
        out[more] += 1 << k
        out[live[~begun]] = 1 << k
    return out


def _reach(least: list[np.ndarray], at: np.ndarray, depth: np.ndarray, step: int) -> np.ndarray:
    """How many entries in a row, before `at` (step -1) above depth or behind it (step 1) at depth or above."""
    out = np.zeros(len(at), np.int64)

    def passes(k: int, live: np.ndarray) -> np.ndarray:
        begin = at[live] + 1 + out[live] if step > 0 else np.maximum(at[live] - out[live] - (1 << k), 0)
        found = least[k][begin]
        return live[found >= depth[live] if step > 0 else found > depth[live]]

    passed, live = [], np.arange(len(at))
    for k in range(len(least)):
        live = passes(k, live)
        if not len(live):
            break
        out[live] += 1 << k
        passed.append(live)
    for k in range(len(passed) - 1, -1, -1):
        out[passes(k, passed[k])] += 1 << k
    return out


def branching_repeats(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Start and period of each tandem repeat that branches, and the ranks of suffix_order()."""
    order, levels = suffix_order(symbols)
    rank, n = levels[-1], len(order)
    depths = np.zeros(n + 1, np.int64)
    depths[1:n] = common_prefixes(levels, order[:-1], order[1:])
    cuts = np.flatnonzero(depths)
    least = [depths]
    while 2 << len(least) <= n:
        half, width = least[-1], 1 << (len(least) - 1)
        wide = np.zeros_like(half)
        wide[: n + 1 - width] = np.minimum(half[: n + 1 - width], half[width:])
        least.append(wide)
    depth = depths[cuts]
    before, behind = _reach(least, cuts, depth, -1), _reach(least, cuts, depth, 1)
    lower = before <= behind
    size = np.where(lower, before, behind) + 1
    own = np.where(lower, cuts - 1 - before, cuts)
    low, high = np.where(lower, cuts, cuts - 1 - before), np.where(lower, cuts + behind, cuts - 1)
    upto = np.concatenate([[0], np.cumsum(size)])
    starts, periods = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at = 0
    while at < len(cuts):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + TOGETHER, "right")) - 1)
        which = np.repeat(np.arange(at, to), size[at:to])
        leaf = order[np.arange(upto[at], upto[to]) + (own - upto[:-1])[which]]
        d = depth[which]
        ahead, back = rank[leaf + d], rank[np.maximum(leaf - d, 0)]
        hit = (ahead >= low[which]) & (ahead <= high[which])
        starts.append(leaf[hit])
        periods.append(d[hit])
        hit = (back >= low[which]) & (back <= high[which]) & (leaf >= d)
        starts.append((leaf - d)[hit])
        periods.append(d[hit])
        at = to
    return np.concatenate(starts), np.concatenate(periods), levels


def runs_of(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of the runs of LEAST_LENGTH or more, by start, then period."""
    start, period, levels = branching_repeats(symbols)
    end = start + 2 * period
    for k in range(len(levels) - 1, -1, -1):
        at = start - (1 << k)
        live = np.flatnonzero(at >= 0)
        live = live[levels[k][at[live]] == levels[k][at[live] + period[live]]]
        start[live] -= 1 << k
    long = end - start >= LEAST_LENGTH
    start, end, period = start[long], end[long], period[long]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    by = np.lexsort((period, start))
    return start[by], (end - start)[by], period[by]


def _worked(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The runs and the collapsed text of each document."""
    starts, ends, at = word_spans(data, offsets)
    docs = len(at) - 1
    kinds, _, which = distinct_words(data, starts, ends)
    of = np.repeat(np.arange(docs), np.diff(at))
    shift = at + np.arange(docs + 1)
    symbols = np.empty(len(starts) + docs, np.int64)
    symbols[np.arange(len(starts)) + of] = of * (len(kinds) + 1) + which + 1
    symbols[shift[1:] - 1] = np.arange(docs) * (len(kinds) + 1)
    start, length, period = runs_of(symbols)
    doc = np.searchsorted(shift, start, "right") - 1
    here = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=docs))])
    runs = pa.ListArray.from_arrays(pa.array(here, pa.int32()), pa.StructArray.from_arrays([pa.array(start - shift[doc]), pa.array(length), pa.array(period)], fields=list(_RUN)))
    cover = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    kept = np.cumsum(cover) == 0
    raw, texts = data.tobytes(), []
    for i in range(docs):
        words = raw[offsets[i] : offsets[i + 1]].split()
        if here[i + 1] > here[i]:
            words = [words[j] for j in np.flatnonzero(kept[shift[i] : shift[i] + len(words)])]
        texts.append(b" ".join(words))
    return runs, pa.array(texts, pa.binary()).cast(pa.string())


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) for each row of `docs`.

    runs has start, length and period (in words) of every run of LEAST_LENGTH words or more, by start, then period.
    collapsed has the text's words, joined by one space, without those that a run holds after its first period.  Null and
    empty texts have no run and collapse to an empty text; repeated rows and rows without an id are worked on each; columns
    other than doc_id and text are not read.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, 1, TREE_BYTES):
            yield pa.RecordBatch.from_arrays([rows.column(0), *_worked(data, offsets)], names=["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """`text`, for a tenth of the ids with its words from some place on replaced by a repetition of the first of them.

    Of n words (n > 0) and h = crc32(doc_id as text) with h % 10 = 0, g = h div 10: each word i >= a is word
    a + (i - a) % p, where a = g % n and p = 1 + (n - a) div (3 + g % 8).  Other texts, and those without an id, stay.
    """
    h = F.crc32(doc_id.cast("string"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g = F.floor(h / 10).cast("long")

    def source(s: Column, i: Column) -> Column:
        n = F.size(s["words"])
        a = s["g"] % n
        p = 1 + F.floor((n - a) / (3 + s["g"] % 8)).cast("long")
        return F.element_at(s["words"], F.when(i < a, i).otherwise(a + (i - a) % p).cast("int") + 1)

    # An array of one struct, so that the words are cut once and not for each word.
    given = F.array(F.struct(words.alias("words"), g.alias("g")))
    made = F.transform(given, lambda s: F.when(F.size(s["words"]) > 0, F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.size(s["words"]) - 1), lambda i: source(s, i)))).otherwise(""))[0]
    return F.when(h % 10 == 0, made).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: all `documents`, with the contract's repetitions planted."""
    docs = read(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("text"))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    # The greatest of (length, -start, -period).
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = periodic_runs(docs).withColumn("longest", longest)
    length, period = F.col("longest.length"), -F.col("longest.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
