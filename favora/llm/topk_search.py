"""Exact top-k BM25 search over a sharded inverted index, with block-max WAND pruning.

Every task turns its documents into shards of about SHARD_BYTES of text.  A shard holds texts of equal words once, in an
order that brings alike texts together (by the most frequent word of each, then by length), cut into blocks of BLOCK_DOCS.
Postings are sorted by term and document; for each list of more postings than blocks the greatest impact in every block is
stored as well.  A shorter list has about one posting in a block it touches, so that its postings are its block maxima.
Statistics are global: scores of different shards compare, and the shards' best make up the exact result.

The pivots of a query are the documents at which the block maxima of its lists add up to its threshold; nothing else can
be a result.  They are found for a whole shard at once: the short lists are added up, and the maxima of the long lists
complete the sum in each block.  Groups of documents without a pivot are skipped; the others are scored on the long lists'
own postings, as matrix products with the queries that have a pivot there.  The group of the greatest bound comes first and
raises the threshold to the k-th best score in it; thresholds start from the best of a part of the shards, which are lower
bounds of the final ones.

Queries are taken in blocks of QUERY_BLOCK_BYTES, which are sent to the tasks one after another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from favora.functions.tables import store
from favora.llm.shared import pieces, read, word_hashes, word_spans

K = 10
K1, B = 1.2, 0.75
SHARD_BYTES = 12 << 20
BLOCK_DOCS = 16
#: Documents that are scored together; whole blocks.
GROUP_DOCS = 64
QUERY_BLOCK_BYTES = 16 << 20
#: Queries whose scores a task holds at once.
BATCH = 512
FIRST_SHARDS = 8
#: Frequent words by which a shard's documents are ordered.
ORDERING = 64
DIGITS = 6
_SLACK = 1e-5
_KINDS = {"ids": np.int64, "id_ptr": np.int32, "lengths": np.int32, "terms": np.uint64, "ptr": np.int32, "at": np.int32, "tf": np.int32, "long": np.int32, "maxima": np.float32}
INDEX = "shard long, " + ", ".join(f"{x} binary" for x in _KINDS)


def collection_size(docs: DataFrame) -> tuple[int, int]:
    """The number of documents with an id, and of their words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = words = 0
        for _, data, offsets in pieces(batches, 0):
            n, words = n + len(offsets) - 1, words + len(word_spans(data, offsets)[0])
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([words])], names=["n", "words"])

    row = docs.where("doc_id is not null").select("text").mapInArrow(task, "n long, words long").agg(F.sum("n"), F.sum("words")).first()
    return row[0] or 0, row[1] or 0


def _weight(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    """The part of a posting's impact that is not its term's idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _blocks(n: int) -> int:
    """Blocks of `n` documents; whole groups."""
    return -(-n // GROUP_DOCS) * (GROUP_DOCS // BLOCK_DOCS)


def _shard(ids: list, digests: list, lengths: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, mean: float) -> pa.RecordBatch:
    """One row of the index, from postings in any order."""
    # Texts of equal words count once.
    _, one, same = np.unique(np.array(digests, "S16"), return_index=True, return_inverse=True)
    keep = one[same[doc]] == doc
    term, doc, tf = term[keep], same[doc[keep]], tf[keep]
    lengths, n = lengths[one], len(one)
    terms, place = np.unique(term, return_inverse=True)
    sizes = np.bincount(place, minlength=len(terms))
    # The order of the documents: their most frequent one of the words that most documents have, then their length.
    often = np.sort(np.argsort(-sizes, kind="stable")[:ORDERING])
    row = np.full(len(terms), -1)
    row[often] = np.arange(len(often))
    counts = np.zeros((len(often) + 1, n), np.int32)
    of = row[place] >= 0
    counts[row[place[of]], doc[of]] = tf[of]
    order = np.lexsort((lengths, counts.argmax(axis=0)))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    lengths, doc = lengths[order], rank[doc]
    by = np.lexsort((doc, place))
    place, doc, tf = place[by], doc[by], tf[by]
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    blocks = _blocks(n)
    long = np.flatnonzero(sizes > n / BLOCK_DOCS)
    maxima = np.zeros((len(long), blocks), np.float32)
    for i, t in enumerate(long.tolist()):
        at, weight = doc[ptr[t] : ptr[t + 1]], _weight(tf[ptr[t] : ptr[t + 1]], lengths[doc[ptr[t] : ptr[t + 1]]], mean)
        heads = np.flatnonzero(np.concatenate([[True], at[1:] // BLOCK_DOCS != at[:-1] // BLOCK_DOCS]))
        # Rounded up, so that they stay bounds.
        maxima[i, at[heads] // BLOCK_DOCS] = np.nextafter(np.maximum.reduceat(weight, heads).astype(np.float32), np.float32(np.inf))
    members = np.lexsort((np.array(ids, np.int64), rank[same]))
    out = {"ids": np.array(ids, np.int64)[members], "id_ptr": np.concatenate([[0], np.cumsum(np.bincount(rank[same], minlength=n))]), "lengths": lengths, "terms": terms, "ptr": ptr, "at": doc, "tf": tf, "long": long, "maxima": maxima}
    return pa.RecordBatch.from_arrays([pa.array([int(min(ids))]), *(pa.array([v.astype(_KINDS[k]).tobytes()], pa.binary()) for k, v in out.items())], names=["shard", *out])


def build_index(docs: DataFrame, mean: float) -> DataFrame:
    """One row for each shard: its documents, its terms (hashes, sorted), their postings, and the long lists' block maxima.

    `mean` is the mean length of all documents.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        digests: list = []
        parts: list = []
        size = 0

        def flush() -> pa.RecordBatch:
            return _shard(ids, digests, *(np.concatenate([p[j] for p in parts]) for j in range(4)), mean)

        for rows, data, offsets in pieces(batches, 1):
            starts, ends, at = word_spans(data, offsets)
            n = np.diff(at)
            h = word_hashes(data, starts, ends)
            digests += [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
            doc = np.repeat(np.arange(len(n)), n) + len(ids)
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.empty(0, np.int64)
            parts.append((n, h[new], doc[new], np.diff(np.append(new, len(h)))))
            ids += rows.column(0).to_pylist()
            size += len(data)
            if size >= SHARD_BYTES:
                yield flush()
                ids, digests, parts, size = [], [], [], 0
        if ids:
            yield flush()

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, INDEX)


class Queries(NamedTuple):
    """A block of queries: their distinct terms (sorted), each query's terms as places in `terms`, and thresholds."""

    ids: np.ndarray
    terms: np.ndarray
    ptr: np.ndarray
    of: np.ndarray
    df: np.ndarray
    least: np.ndarray


def _columns(batch: pa.RecordBatch, i: int) -> dict[str, np.ndarray]:
    names = batch.schema.names
    return {k: np.frombuffer(batch.column(names.index(k))[i].as_buffer(), t) for k, t in _KINDS.items() if k in names}


def _places(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(terms, wanted), max(0, len(terms) - 1))
    return place, (terms[place] == wanted if len(terms) else np.zeros(len(wanted), bool))


def _frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many documents each of the terms stands."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                s = _columns(batch, i)
                place, found = _places(s["terms"], sent.value)
                some = np.flatnonzero(found)
                copies = np.diff(s["id_ptr"])
                sums = np.concatenate([[0], np.cumsum(copies[s["at"]])]) if (copies > 1).any() else np.arange(len(s["at"]) + 1)
                total[some] += sums[s["ptr"][place[some] + 1]] - sums[s["ptr"][place[some]]]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["t", "n"])

    out = np.zeros(len(terms), np.int64)
    for b in index.select("id_ptr", "terms", "ptr", "at").mapInArrow(task, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow().to_batches():
        out[b.column(0).to_numpy()] = b.column(1).to_numpy()
    sent.unpersist()
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(sizes)])
    return np.arange(upto[-1]) + np.repeat(starts - upto[:-1], sizes)


class _Lists(NamedTuple):
    """The lists of a shard that a block of queries reads."""

    place: np.ndarray
    row: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray
    impact: np.ndarray
    at: np.ndarray
    long: np.ndarray
    bounds: np.ndarray


def _lists(s: dict[str, np.ndarray], q: Queries, n_docs: int, mean: float) -> _Lists:
    """Postings with impacts: of short lists one after another, of long ones as a matrix, with their block maxima."""
    n = len(s["lengths"])
    blocks = _blocks(n)
    place, found = _places(s["terms"], q.terms)
    idf = np.log(1 + (n_docs - q.df + 0.5) / (q.df + 0.5))
    of_long = np.full(len(s["terms"]) + 1, -1)
    of_long[s["long"]] = np.arange(len(s["long"]))
    long_of = np.where(found, of_long[place], -1)
    sizes = np.where(found & (long_of < 0), s["ptr"][np.minimum(place + 1, len(s["ptr"]) - 1)] - s["ptr"][place], 0).astype(np.int64)
    which = _ranges(s["ptr"][place].astype(np.int64), sizes)
    at, tf = s["at"][which].astype(np.int64), s["tf"][which]
    impact = np.repeat(idf, sizes) * _weight(tf, s["lengths"][at], mean)
    used = np.flatnonzero(long_of >= 0)
    row = np.full(len(q.terms), -1)
    row[used] = np.arange(len(used))
    long = np.zeros((len(used), blocks * BLOCK_DOCS))
    for i, t in enumerate(used.tolist()):
        part = slice(s["ptr"][place[t]], s["ptr"][place[t] + 1])
        long[i, s["at"][part]] = idf[t] * _weight(s["tf"][part], s["lengths"][s["at"][part]], mean)
    maxima = s["maxima"].reshape(len(s["long"]), blocks)[long_of[used]] * idf[used][:, None]
    return _Lists(place, row, sizes, np.concatenate([[0], np.cumsum(sizes)]), impact, at, long, maxima)


def _scored(short: np.ndarray, wants: np.ndarray, x: _Lists, some: np.ndarray, group: int) -> np.ndarray:
    """The scores of a group's documents for some queries of a batch."""
    cols = slice(group * GROUP_DOCS, (group + 1) * GROUP_DOCS)
    return short[some, cols] + wants[some] @ x.long[:, cols]


def _search_batch(x: _Lists, q: Queries, lo: int, hi: int, k: int, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, documents, scores) of what reaches the thresholds `least` of the queries lo to hi."""
    n = x.long.shape[1]
    wants, short = np.zeros((hi - lo, len(x.long))), np.empty((hi - lo, n))
    for i in range(lo, hi):
        mine = q.of[q.ptr[i] : q.ptr[i + 1]]
        rows = x.row[mine]
        wants[i - lo, rows[rows >= 0]] = 1
        few = mine[x.sizes[mine] > 0]
        some = _ranges(x.starts[few], x.sizes[few])
        short[i - lo] = np.bincount(x.at[some], weights=x.impact[some], minlength=n)
    # The greatest score that each document can have, and the greatest of each group.
    upper = short.reshape(hi - lo, -1, BLOCK_DOCS) + (wants @ x.bounds)[:, :, None]
    groups = n // GROUP_DOCS
    best = upper.reshape(hi - lo, groups, GROUP_DOCS).max(axis=2)
    if k <= GROUP_DOCS:
        first = np.where(best.max(axis=1) >= least, best.argmax(axis=1), -1)
        for g in np.unique(first[first >= 0]).tolist():
            some = np.flatnonzero(first == g)
            reached = np.partition(_scored(short, wants, x, some, g), GROUP_DOCS - k, axis=1)[:, GROUP_DOCS - k]
            least[some] = np.maximum(least[some], reached - _SLACK)
    floor = np.maximum(least, 1e-12)
    for g in range(groups):
        some = np.flatnonzero(best[:, g] >= floor)
        if len(some):
            score = _scored(short, wants, x, some, g)
            i, d = np.nonzero(score >= floor[some][:, None])
            yield some[i] + lo, d + g * GROUP_DOCS, score[i, d]


def _search_shard(s: dict[str, np.ndarray], q: Queries, n_docs: int, mean: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, doc_ids, rounded scores) of the shard's documents that may be among a query's best, k at most for each."""
    x = _lists(s, q, n_docs, mean)
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for lo in range(0, len(q.ids), BATCH):
        hi = min(lo + BATCH, len(q.ids))
        found = list(_search_batch(x, q, lo, hi, k, q.least[lo:hi] - _SLACK))
        if not found:
            continue
        of, doc, score = (np.concatenate(c) for c in zip(*found, strict=True))
        # Equal texts come back one by one; more than k of them can't be results.
        copies = np.minimum(np.diff(s["id_ptr"])[doc], k)
        ids = s["ids"][_ranges(s["id_ptr"][doc].astype(np.int64), copies)]
        of, score = np.repeat(of, copies), np.round(np.repeat(score, copies), DIGITS)
        order = np.lexsort((ids, -score, of))
        of, ids, score = of[order], ids[order], score[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        out.append((q.ids[of[place < k]], ids[place < k], score[place < k]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _search(index: DataFrame, q: Queries, n_docs: int, mean: float, k: int) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast(q)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _search_shard(_columns(batch, i), sent.value, n_docs, mean, k)], names=["query_id", "doc_id", "score"])

    found = index.mapInArrow(task, "query_id long, doc_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _block(rows: list) -> Queries:
    ids, texts = np.array([r.query_id for r in rows], np.int64), pa.array([r.text for r in rows], pa.large_string())
    terms = []
    for _, data, offsets in pieces(iter([pa.RecordBatch.from_arrays([texts], names=["t"])]), 0):
        starts, ends, at = word_spans(data, offsets)
        h = word_hashes(data, starts, ends)
        terms += [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    every = np.unique(np.concatenate(terms)) if terms else np.empty(0, np.uint64)
    return Queries(ids, every, np.concatenate([[0], np.cumsum([len(x) for x in terms])]).astype(np.int64), np.searchsorted(every, np.concatenate(terms)) if terms else np.empty(0, np.int64), np.zeros(len(every), np.int64), np.zeros(len(ids)))


def top_k(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, doc_id, score): of each query the k best documents by BM25, of equal scores the smaller doc_id first.

    `queries` has query_id and text; a query is the set of its words.  Documents without a word of the query are no
    results, so queries without words have none.  Null texts count as empty; rows without an id are left out.  Rows may
    repeat, and then are results each; of queries that share an id the one with the least text counts.  Scores are rounded
    to DIGITS digits before they are compared.  Other columns are not read.
    """
    n_docs, words = collection_size(docs)
    mean = max(words, 1) / max(n_docs, 1)
    index = store(build_index(docs, mean), "index")
    asked = store(queries.where("query_id is not null").groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "queries")
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // QUERY_BLOCK_BYTES))
    part = index.where(F.pmod(F.xxhash64("shard"), F.lit(FIRST_SHARDS)) == 0)
    out = None
    for b in range(blocks):
        q = _block(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").collect())
        q = q._replace(df=_frequencies(index, q.terms))
        # Of at least k documents, the k-th best score of a part can't exceed that of all.
        first = _search(part, q, n_docs, mean, k).where(F.col("rank") == k).select("query_id", "score").collect()
        least = dict((r.query_id, r.score) for r in first)
        q = q._replace(least=np.array([least.get(i, 0.0) for i in q.ids.tolist()]))
        found = _search(index, q, n_docs, mean, k)
        out = found if out is None else out.union(found)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: each document whose doc_id is divisible by 100, as a query against all `documents`."""
    docs = read(spark, sf_dir, "documents")
    return top_k(docs, docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text"))


OP4_SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\v\f\r]+') as w from documents where doc_id is not null),
s as (select count(*) as n, sum(len(w)) / count(*) as mean from d),
p as (select r, doc_id, len(w) as dl, t, count(*) as tf from (select r, doc_id, w, unnest(w) as t from d) group by all),
f as (select t, count(*) as df from p group by t),
q as (select distinct doc_id as query_id, t from p where doc_id % 100 = 0),
x as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) as score
  from q join f using (t) join p using (t), s group by query_id, r, doc_id)
select query_id, cast(rank as bigint) as rank, doc_id, score from
  (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from x) where rank <= 10
"""
