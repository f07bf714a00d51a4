"""Benchmark passages in documents, by latent semantic retrieval.

Texts are cut into passages of WINDOW words, STRIDE words apart.  Passages are TF-IDF vectors over FEATURES hashed words;
inverse frequencies come from all documents.  A randomised SVD of the benchmark's passages (Rademacher test matrix, power
iterations, each a distributed product with A^T A) gives a latent basis V of at most RANK dimensions.  A document passage p
is a candidate for a benchmark passage b if the part of it that lies along b in the latent space,

    y(p, b) = <V'p, V'b> / |V'b|^2 = cos(V'p, V'b) |V'p| / |V'b|

reaches COSINE^2.  Unlike the cosine itself that is not diluted by what else stands in p: where p has the words of b and
others, y is the squared cosine of b with p's part in b's words.  For a b of which the basis holds less than HELD, its own
TF-IDF vector is used in place of V'b.

y is a sum over the words of p, which bounds it: alike benchmark passages form clusters of CLUSTER, a table holds the most
that each word can add for any passage of a cluster, and only the clusters whose sum of these over p reaches the threshold
are searched.  Nothing that reaches it is lost.  Passages that can't reach it for any cluster, most of all, are skipped by
running sums over the text.

Candidates are confirmed by the longest common subsequence of words and by the share of answer words, so that paraphrases
are found and chance likeness is not.  Benchmarks are searched in blocks of BLOCK passages, whose size is bounded and which
are sent to the tasks one after another; documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from favora.functions.tables import store
from favora.llm.shared import mix, pieces, read, word_hashes, word_spans

WINDOW = 24
STRIDE = 8
FEATURES = 1 << 18
RANK = 256
OVERSAMPLING = 16
POWER_STEPS = 2
COSINE = 0.63
#: Share of a passage's square that the basis must hold.
HELD = 0.7
CLUSTER = 32
#: Shares of an item's words, or of a full passage's, that must stand in the document in order.
ITEM_LCS = 0.6
PASSAGE_LCS = 0.85
ANSWER_SHARE = 0.5
#: Without an answer this many of the rarest words stand for it, and a share of them is enough, as changes hit any word.
ANSWER_WORDS = 6
RAREST_SHARE = 1 / 3
#: Items of fewer words must stand in the document word by word.
SHORT = 8
BLOCK = 4096
_WORD = re.compile("[^ \t-\r]+")
_AZ = {c: c + 32 for c in range(65, 91)}


def _words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_AZ))


def _starts(lo: int, hi: int) -> np.ndarray:
    """Where the passages of words lo to hi start; the last one ends with the text."""
    if hi - lo <= WINDOW:
        return np.array([lo] if hi > lo else [], np.int64)
    at = np.arange(lo, hi - WINDOW + 1, STRIDE)
    return at if at[-1] == hi - WINDOW else np.append(at, hi - WINDOW)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents, and in how many of them each hashed word stands."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for _, data, offsets in pieces(batches, 0):
            starts, ends, at = word_spans(data, offsets)
            f = (word_hashes(data, starts, ends) % np.uint64(FEATURES)).astype(np.int64)
            f += np.repeat(np.arange(len(at) - 1), np.diff(at)) * FEATURES
            total += np.bincount(np.unique(f) % FEATURES, minlength=FEATURES)
            n += len(offsets) - 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], n))], names=["f", "n"])

    out = np.zeros(FEATURES + 1, np.int64)
    for r in docs.select("text").mapInArrow(task, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow().to_batches():
        out[r.column(0).to_numpy()] = r.column(1).to_numpy()
    return int(out[-1]), out[:-1]


class Basis(NamedTuple):
    """The latent basis: the features it knows (sorted), and a row of RANK or fewer numbers for each."""

    features: np.ndarray
    rows: np.ndarray


def benchmark_passages(items: DataFrame) -> DataFrame:
    """(item_id, first, features) of each passage: the hashed words of the words from `first`."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, 1):
            starts, ends, at = word_spans(data, offsets)
            f = (word_hashes(data, starts, ends) % np.uint64(FEATURES)).astype(np.int64)
            out = [(i, int(s - lo), f[s : min(s + WINDOW, hi)].tolist()) for i, lo, hi in zip(rows.column(0).to_pylist(), at[:-1], at[1:], strict=True) for s in _starts(lo, hi)]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["item_id", "first", "features"])

    return items.select("item_id", "text").mapInArrow(task, "item_id long, first long, features array<long>")


def _times(passages: DataFrame, idf: np.ndarray, basis: Basis | None, rank: int) -> Basis:
    """A^T A V for the TF-IDF rows A of the passages; without a basis V is a Rademacher matrix, made from hashed features."""

    def rows_of(f: np.ndarray) -> np.ndarray:
        if basis is not None:
            return basis.rows[np.searchsorted(basis.features, f)]
        bits = mix(f.astype(np.uint64)[:, None] * np.uint64(1 + rank // 64 + 1) + np.arange(1 + rank // 64, dtype=np.uint64))
        return 2.0 * ((bits[:, np.arange(rank) // 64] >> (np.arange(rank) % 64).astype(np.uint64)) & np.uint64(1)) - 1.0

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            f = np.asarray(column.flatten(), np.int64)
            if not len(f):
                continue
            at = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1]])
            w = idf[f][:, None]
            image = np.add.reduceat(w * rows_of(f), at)
            back = w * np.repeat(image, np.diff(np.append(at, len(f))), axis=0)
            one, which = np.unique(f, return_inverse=True)
            out = np.zeros((len(one), rank))
            np.add.at(out, which, back)
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(one % 64), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel().astype(np.float32)), rank).cast(pa.list_(pa.float32()))], names=["f", "slice", "v"])

    def total(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        one, which = np.unique(table.column("f").to_numpy(), return_inverse=True)
        out = np.zeros((len(one), rank))
        np.add.at(out, which, np.asarray(table.column("v").combine_chunks().flatten()).reshape(-1, rank))
        return pa.table({"f": one, "v": pa.FixedSizeListArray.from_arrays(pa.array(out.ravel().astype(np.float32)), rank).cast(pa.list_(pa.float32()))})

    # At most FEATURES rows of `rank` numbers, in single precision on their way.
    sums = passages.select("features").mapInArrow(task, "f long, slice long, v array<float>").groupBy("slice").applyInArrow(total, "f long, v array<float>").toArrow()
    features = sums.column("f").to_numpy()
    order = np.argsort(features)
    rows = np.concatenate([np.asarray(c.flatten()) for c in sums.column("v").chunks]).reshape(-1, rank) if len(sums) else np.empty((0, rank), np.float32)
    return Basis(features[order], rows[order])


def latent_basis(passages: DataFrame, idf: np.ndarray) -> Basis:
    """The leading right singular vectors of the passages' TF-IDF matrix."""
    rank = min(RANK + OVERSAMPLING, max(1, passages.count()))
    basis: Basis | None = None
    for _ in range(POWER_STEPS + 1):
        image = _times(passages, idf, basis, rank)
        basis = Basis(image.features, np.linalg.qr(image.rows.astype(float))[0] if len(image.features) >= rank else np.eye(len(image.features), rank))
    # The rotation that diagonalises V' A' A V orders the directions by singular value.
    image = _times(passages, idf, basis, rank)
    values, turn = np.linalg.eigh(basis.rows.T @ image.rows)
    keep = np.argsort(-values)[:RANK]
    return Basis(basis.features, (basis.rows @ turn[:, keep]).astype(np.float32))


class Block(NamedTuple):
    """What a task needs of a block of benchmark passages."""

    features: np.ndarray
    rows: np.ndarray
    bounds: np.ndarray
    most: np.ndarray
    latent: np.ndarray
    own: dict[int, tuple[np.ndarray, np.ndarray]]
    passage_item: np.ndarray
    passage_first: np.ndarray
    item_ids: list[int]
    words: list[list[str]]
    answers: list[tuple[list[str], float]]


def lcs(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence, by Hyyrö's bit-parallel algorithm."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for w in b:
        if u := v & at.get(w, 0):
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _hashes(words: list[str]) -> np.ndarray:
    """The hashes of words, which are lower-cased and hold no space."""
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return word_hashes(data, starts, ends)


def _block(rows: list, passages: list, idf: np.ndarray, basis: Basis) -> Block:
    number = {r.item_id: k for k, r in enumerate(rows)}
    words = [_words(r.text) for r in rows]
    answers = []
    for r, ws in zip(rows, words, strict=True):
        if given := _words(r.answer) if "answer" in r else []:
            answers.append((given, ANSWER_SHARE))
            continue
        one = list(dict.fromkeys(ws))
        weight = idf[(_hashes(one) % np.uint64(FEATURES)).astype(np.int64)] if one else []
        answers.append(([one[i] for i in np.argsort(-np.asarray(weight), kind="stable")[:ANSWER_WORDS]], RAREST_SHARE))
    features = np.unique(np.concatenate([p.features for p in passages])).astype(np.int64) if passages else np.empty(0, np.int64)
    scaled = (idf[features][:, None] * basis.rows[np.searchsorted(basis.features, features)]).astype(np.float32)
    # A passage's latent vector is the sum of its words' rows.
    of = [np.searchsorted(features, p.features) for p in passages]
    image = np.array([scaled[x].sum(axis=0) for x in of], np.float32).reshape(len(passages), scaled.shape[1])
    square = np.array([((np.unique(x, return_counts=True)[1] * idf[features[np.unique(x)]]) ** 2).sum() for x in of])
    held = (image.astype(np.float64) ** 2).sum(axis=1)
    # Alike passages side by side: by the strongest of the leading directions, then the next one.
    leading = np.abs(image[:, :16])
    order = np.lexsort((leading.argsort(axis=1)[:, -2], leading.argmax(axis=1))) if leading.shape[1] > 1 else np.arange(len(passages))
    passages, of, image, square, held = [passages[i] for i in order], [of[i] for i in order], image[order], square[order], held[order]
    latent = np.where((held >= HELD * square)[:, None], image / np.maximum(held, 1e-9)[:, None], 0).astype(np.float32)
    own = {}
    for j in np.flatnonzero(held < HELD * square).tolist():
        one, times = np.unique(of[j], return_counts=True)
        own[j] = one, (times * idf[features[one]] ** 2 / square[j]).astype(np.float32)
    bounds = np.zeros((len(features), -(-len(passages) // CLUSTER)), np.float32)
    for c in range(bounds.shape[1]):
        bounds[:, c] = (scaled @ latent[c * CLUSTER : (c + 1) * CLUSTER].T).max(axis=1).clip(0)
        for j in range(c * CLUSTER, min((c + 1) * CLUSTER, len(passages))):
            if j in own:
                bounds[own[j][0], c] = np.maximum(bounds[own[j][0], c], own[j][1])
    return Block(features, scaled, bounds, bounds.max(axis=1, initial=0).astype(np.float64), latent, own, np.array([number[p.item_id] for p in passages], np.int64), np.array([p.first for p in passages], np.int64), list(number), words, answers)


def _confirmed(block: Block, item: int, first: int, words: list[str], start: int) -> tuple[float, float] | None:
    """Shares of common words and of answer words, if the words around `start` hold the item or its passage."""
    mine, (answer, enough) = block.words[item], block.answers[item]
    n = len(mine)
    region = words[max(0, start - n) : start + WINDOW + n]
    if n < SHORT:
        return (1.0, 1.0) if any(region[i : i + n] == mine for i in range(len(region) - n + 1)) else None
    here = set(region)
    share = sum(w in here for w in answer) / max(1, len(answer))
    # No subsequence has more words than stand there at all.
    if share >= enough and sum(w in here for w in mine) / n >= ITEM_LCS and (common := lcs(mine, region) / n) >= ITEM_LCS:
        return common, share
    part = mine[first : first + WINDOW]
    if len(part) == WINDOW and sum(w in here for w in part) >= PASSAGE_LCS * WINDOW and lcs(part, words[max(0, start - WINDOW) : start + 2 * WINDOW]) >= PASSAGE_LCS * WINDOW:
        return lcs(mine, region) / n, share
    return None


def _candidates(b: Block, f: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(windows, passages, y) of the candidates among windows of a text; f: places of its words in b.features, or -1."""
    least = COSINE**2
    span = first[:, None] + np.arange(WINDOW)
    g = np.where(span < last[:, None], f[np.minimum(span, len(f) - 1)], -1)

    def sums(table: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The table's rows, summed over each window's words; every window has a word that the benchmark has."""
        some = of >= 0
        return np.add.reduceat(table[of[some]], np.concatenate([[0], np.cumsum(some.sum(axis=1))[:-1]]))

    alive = sums(b.bounds, g) >= least - 1e-4
    which = np.flatnonzero(alive.any(axis=1))
    if not len(which):
        return
    g, alive = g[which], alive[which]
    image = sums(b.rows, g)
    for c in np.flatnonzero(alive.any(axis=0)).tolist():
        i = np.flatnonzero(alive[:, c])
        y = image[i] @ b.latent[c * CLUSTER : (c + 1) * CLUSTER].T
        for j in range(y.shape[1]):
            if c * CLUSTER + j in b.own:
                part = np.zeros(len(b.features) + 1, np.float32)
                one, share = b.own[c * CLUSTER + j]
                part[one] = share
                y[:, j] = part[g[i]].sum(axis=1)
        w, j = np.nonzero(y >= least - 1e-6)
        yield which[i[w]], j + c * CLUSTER, y[w, j]


def _search(docs: DataFrame, block: Block) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = sent.value
        place = np.full(FEATURES, -1, np.int64)
        place[b.features] = np.arange(len(b.features))
        most = np.append(b.most, 0.0)
        for rows, data, offsets in pieces(batches, 1):
            starts, ends, at = word_spans(data, offsets)
            f = place[(word_hashes(data, starts, ends) % np.uint64(FEATURES)).astype(np.int64)]
            reach = np.concatenate([[0], np.cumsum(most[f])])
            windows = [_starts(lo, hi) for lo, hi in zip(at[:-1], at[1:], strict=True)]
            doc = np.repeat(np.arange(len(windows)), [len(x) for x in windows])
            first = np.concatenate(windows) if windows else np.empty(0, np.int64)
            last = np.minimum(first + WINDOW, at[1:][doc]) if len(first) else first
            live = np.flatnonzero(reach[last] - reach[first] >= COSINE**2 - 1e-4)
            hits: dict[tuple[int, int], list] = {}
            for lo in range(0, len(live), 2048):
                some = live[lo : lo + 2048]
                for i, j, y in _candidates(b, f, first[some], last[some]):
                    for k, p, v in zip(some[i].tolist(), j.tolist(), y.tolist(), strict=True):
                        hits.setdefault((int(doc[k]), int(b.passage_item[p])), []).append((-v, int(first[k] - at[doc[k]]), int(b.passage_first[p])))
            out, texts, ids = [], {}, rows.column(0).to_pylist()
            for (d, item), found in sorted(hits.items()):
                if d not in texts:
                    texts = {d: _words(rows.column(1)[d].as_py())}
                for negative, start, passage in sorted(found):
                    if (shares := _confirmed(b, item, passage, texts[d], start)) is not None:
                        out.append((ids[d], b.item_ids[item], min(1.0, -negative) ** 0.5, *shares))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], names=["doc_id", "item_id", "cosine", "common_share", "answer_share"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, item_id long, cosine double, common_share double, answer_share double")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, common_share, answer_share) of each document and item that it holds.

    `benchmark` has item_id, text and perhaps answer; without answers an item's ANSWER_WORDS rarest words stand for it.
    Null and empty texts hold nothing and are held by nothing; of items that share an id the one with the least text
    counts, and items without an id don't.  Rows that share a doc_id, or have none, give one row.  Other columns are not read.
    """
    n, df = document_frequencies(docs)
    idf = np.maximum(np.log((n + 1) / (df + 1)), 0.05)
    given = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text", *(["answer"] if "answer" in benchmark.columns else []))
    items = store(given.groupBy("item_id").agg(F.min(F.struct("text", *given.columns[2:])).alias("i")).select("item_id", "i.*"), "items")
    passages = store(benchmark_passages(items), "passages")
    basis = latent_basis(passages, idf)
    blocks = max(1, -(-passages.count() // BLOCK))
    of = F.pmod(F.xxhash64("item_id", "first"), F.lit(blocks))
    out = None
    for k in range(blocks):
        mine = passages.where(of == k)
        # About BLOCK passages, and the texts of their items.
        rows = items.join(mine.select("item_id").distinct(), "item_id", "left_semi").orderBy("item_id").collect()
        found = _search(docs, _block(rows, mine.orderBy("item_id", "first").collect(), idf, basis))
        out = found if out is None else out.union(found)
    # Passages of one item may stand in several blocks, and rows may repeat.
    best = F.max(F.struct("common_share", "cosine", "answer_share")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.cosine", "b.common_share", "b.answer_share")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: all `documents` against `benchmark`."""
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go.

    Rows without a doc_id stay; of rows that share one all go if one does.  Null and empty texts hold nothing, and an empty
    benchmark leaves all rows.
    """
    gone = find_leaks(docs, read(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
