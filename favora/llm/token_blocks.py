"""Token ids in a binary format of patched frame-of-reference blocks.

A file is a row group of the Parquet table that holds the output: one row is one page of whole documents in ascending
doc_id order.  Its ids are cut into blocks of BLOCK values; of each block the minimum is subtracted, the rest is packed at
the width that holds PERCENTILE of the values, and the values that need more are kept in an exception list (position in
the page, high part).  `block_start` says at which byte of `packed` each block starts, so any block can be decoded alone.

    shard int, page int            place in ascending order
    first_id, last_id long         the page's least and greatest doc_id; Parquet's statistics of them lead to a document
    doc_ids, doc_tokens array      the page's documents and their number of ids
    ids_before long                ids of the shard's pages before this one
    block_min, block_width, block_start array
    exc_at, exc_high array         exceptions: position in the page, value >> width
    packed binary                  little-endian bit stream

Documents are dealt to shards by ranges of doc_id, so shards are written and read independently and a lost task is just
run again.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from favora.functions.tables import shared_dir
from favora.llm.shared import Words, pieces, read, word_spans

BLOCK = 256
PERCENTILE = 90
END = 1
MARK = "|"
TOGETHER = 500
SCHEMA = "shard int, page int, first_id long, last_id long, ids_before long, doc_ids array<long>, doc_tokens array<int>, block_min array<int>, block_width array<int>, block_start array<long>, exc_at array<int>, exc_high array<int>, packed binary"
_ARROW = pa.schema([("shard", pa.int32()), ("page", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("ids_before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((x, pa.list_(pa.int32())) for x in ("doc_tokens", "block_min", "block_width")), ("block_start", pa.list_(pa.int64())), ("exc_at", pa.list_(pa.int32())), ("exc_high", pa.list_(pa.int32())), ("packed", pa.binary())])
_encoders: dict[str, _Encoder] = {}


def _lay(values: np.ndarray, w: int) -> np.ndarray:
    """Values (one row for each block) of `w` bits as little-endian bit streams, one row of 64-bit words for each block."""
    turned = np.ascontiguousarray(values.T).astype(np.uint64)
    out = np.zeros((BLOCK * w // 64 + 1, values.shape[0]), np.uint64)
    for i, v in enumerate(turned):
        word, shift = divmod(i * w, 64)
        out[word] |= v << np.uint64(shift)
        if shift + w > 64:
            out[word + 1] |= v >> np.uint64(64 - shift)
    return np.ascontiguousarray(out[:-1].T)


def _lift(words: np.ndarray, w: int) -> np.ndarray:
    """What _lay() was given."""
    turned = np.vstack([np.ascontiguousarray(words.T), np.zeros((1, words.shape[0]), np.uint64)])
    out = np.empty((BLOCK, words.shape[0]), np.uint64)
    mask = np.uint64((1 << w) - 1)
    for i in range(BLOCK):
        word, shift = divmod(i * w, 64)
        v = turned[word] >> np.uint64(shift)
        if shift + w > 64:
            v = v | turned[word + 1] << np.uint64(64 - shift)
        out[i] = v & mask
    return out.T


def pack(ids: np.ndarray) -> dict:
    """One page of ids (uint32) as the block columns of SCHEMA; the last block is filled up with its minimum."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, ids.max(initial=0), np.int64)
    grid[:n] = ids
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    rest.ravel()[n:] = 0
    chosen = np.partition(rest, BLOCK * PERCENTILE // 100 - 1, axis=1)[:, BLOCK * PERCENTILE // 100 - 1]
    width = np.ceil(np.log2(chosen + 1)).astype(np.int64)
    over = np.flatnonzero(rest > ((1 << width) - 1)[:, None])
    starts = np.concatenate([[0], np.cumsum(width * (BLOCK // 64))])
    packed = np.zeros(int(starts[-1]), "<u8")
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        packed[starts[of][:, None] + np.arange(BLOCK * w // 64)] = _lay(rest[of] & ((1 << w) - 1), w)
    return {"block_min": low.astype(np.int32), "block_width": width.astype(np.int32), "block_start": starts[:-1] * 8, "exc_at": over.astype(np.int32), "exc_high": (rest.ravel()[over] >> width[over // BLOCK]).astype(np.int32), "packed": packed.tobytes()}


def unpack(n: int, block_min: np.ndarray, block_width: np.ndarray, block_start: np.ndarray, exc_at: np.ndarray, exc_high: np.ndarray, packed: bytes) -> np.ndarray:
    """The `n` ids of a page, as uint32."""
    words = np.frombuffer(packed, "<u8")
    out = np.zeros((len(block_min), BLOCK), np.int64)
    for w in np.unique(block_width[block_width > 0]).tolist():
        of = np.flatnonzero(block_width == w)
        out[of] = _lift(words[(block_start[of] // 8)[:, None] + np.arange(BLOCK * w // 64)], w)
    out.ravel()[exc_at] |= exc_high << block_width[exc_at // BLOCK]
    return (out + block_min[:, None]).ravel()[:n].astype(np.uint32)


class _Encoder:
    """The tokenizer of a file, with the ids of words seen before.

    The tokenizer splits at white space and joins nothing across it, so a text's ids are those of its words one after
    another.  New words are encoded together, with MARK between them; words that hold it are encoded alone.
    """

    def __init__(self, path: str):
        # Spark has a task for each core.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.seen = Words()
        ids = self.tokenizer.encode(f"a {MARK} a", add_special_tokens=False).ids
        if len(ids) != 3:
            raise ValueError(f"the tokenizer has no id for {MARK} alone")
        self.mark_id = ids[1]

    def _search(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = [MARK in w for w in words]
        together = f" {MARK} ".join("" if o else w for w, o in zip(words, odd, strict=True))
        # This call leaves out the offsets of tokens.
        ids = np.array(self.tokenizer.encode_batch_fast([together], add_special_tokens=False)[0].ids, np.int64)
        marks = np.flatnonzero(ids == self.mark_id)
        before = np.concatenate([[0], marks - np.arange(len(marks)), [len(ids) - len(marks)]])
        ids = np.delete(ids, marks)
        if any(odd):
            parts = np.split(ids, before[1:-1])
            for i in np.flatnonzero(odd):
                parts[i] = np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, np.int64)
            ids, before = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, before

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each text with the end id, one after another, and the number of ids before each text."""
        starts, ends, at = word_spans(data, offsets)
        raw = data.tobytes()

        def search(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found = [self._search([raw[a:b].decode() for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]) for part in np.array_split(new, -(-len(new) // TOGETHER))]
            sizes = np.concatenate([np.diff(b) for _, b in found])
            return np.concatenate([i for i, _ in found]), np.concatenate([[0], np.cumsum(sizes)])

        ids, upto = self.seen.ids_of(data, starts, ends, search)
        upto = upto[at]
        return np.insert(ids, upto[1:], END), upto + np.arange(len(upto))


def _encoder(path: str) -> _Encoder:
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def write_ids(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Write the ids of all documents to `path` in the format above.

    `tokenizer` is a tokenizer file that is present on every executor.  Null texts count as empty (the end id alone).
    Documents are in ascending doc_id order, nulls first; repeated ids in order of their texts.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, page, before = _encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        for rows, data, offsets in pieces(batches, 1):
            ids, upto = encoder.encode(data, offsets)
            found = rows.column(0).to_pylist()
            known = [i for i in found if i is not None]
            out = {"shard": shard, "page": page, "first_id": min(known, default=None), "last_id": max(known, default=None), "ids_before": before, "doc_ids": found, "doc_tokens": np.diff(upto)} | pack(ids)
            page, before = page + 1, before + len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([out[f.name]], f.type) for f in _ARROW], schema=_ARROW)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(parts, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(task, SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str, digest: bool = False, doc_id: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document, decoded from the files; start counts the ids of all before it.

    With `digest`, ids_crc32 (the CRC-32 of the ids as little-endian unsigned 32-bit integers) comes instead of ids.  With
    `doc_id` only the pages that may hold it are read, and its rows given.
    """
    pages = spark.read.schema(SCHEMA).parquet(path)
    # One number for each shard.
    before, done = {}, 0
    for shard, n in sorted(pages.groupBy("shard").agg(F.sum(F.expr("aggregate(doc_tokens, 0L, (a, x) -> a + x)"))).collect()):
        before[shard] = done
        done += n

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {f: batch.column(j)[i] for j, f in enumerate(_ARROW.names)}
                n = r["doc_tokens"].values.to_numpy().astype(np.int64)
                columns = [r[x].values.to_numpy().astype(np.int64) for x in ("block_min", "block_width", "block_start", "exc_at", "exc_high")]
                ids = unpack(int(n.sum()), *columns, r["packed"].as_py())
                at = np.concatenate([[0], np.cumsum(n)])
                start = before[r["shard"].as_py()] + r["ids_before"].as_py() + at[:-1]
                if digest:
                    last = pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([r["doc_ids"].values, pa.array(start), pa.array(n), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    wanted = pages if doc_id is None else pages.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    out = wanted.mapInArrow(task, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>"))
    return out if doc_id is None else out.where(F.col("doc_id") == doc_id)


def op3_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: all `documents`, written to the shared folder and read back."""
    import public_tokenizers

    path = f"{shared_dir(spark)}/token-blocks-{uuid.uuid4().hex}"
    write_ids(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_ids(spark, path, digest=True)
