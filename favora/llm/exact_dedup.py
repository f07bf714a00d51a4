"""Exact duplicates through a sharded index of cuckoo filters over live digests.

A document's digest is the SHA-256 of its text in which each run of white space is one space.  The index holds

    filters    (shard, live, table): a cuckoo filter for each shard of the digests, 16-bit fingerprints in buckets of four
    content    (shard, digest, size, first, n): the live digests with their text's size in bytes, the row that stays and the
               number of rows, in buckets by digest
    members    (doc_id, digest, size, batch, row): the rows behind them

New documents are combined within each Arrow batch and dealt to their digests' shards, where they meet the filter in the order
in which rows stay.  A key that the filter doesn't hold is new and goes in without a look at the content.  A hit is only a
candidate: it is joined to the content's buckets, and counts where digest and size are there; else its fingerprint was
another one's, and it is put into the filter as well.  A filter that is full is made anew with twice the buckets from the
stored keys.  Deletion takes a digest out of filter and content with its last row.

The size is part of what must agree, so two texts count as equal only with the same SHA-256 and length.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from favora.functions.tables import shared_dir, store
from favora.llm.shared import mix, read

SLOTS = 4
FULL = 0.9
KICKS = 500
LEAST_BUCKETS = 16
#: Rows for each shard on average, which bounds a filter and a task's memory.
SHARD_ROWS = 1 << 19
#: A digest with more than this part of all rows is sent to the tasks, so that no task gets all its rows; there are fewer of them.
HOT = 200
FILTER, DELETE, INSERT, FORCE = range(4)
_FIRST = "first struct<lost: boolean, doc_id: long, batch: int, row: long>"


class CuckooFilter:
    """Fingerprints of 64-bit hashes; every hash has two buckets, each of which the fingerprint leads to from the other."""

    def __init__(self, buckets: int = LEAST_BUCKETS, table: bytes | None = None) -> None:
        self.table = np.zeros(buckets * SLOTS, np.uint16) if table is None else np.frombuffer(table, "<u2").astype(np.uint16)
        self.buckets = len(self.table) // SLOTS
        self.live = int(np.count_nonzero(self.table))
        self.state = 1

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = (hashes >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        one = (hashes & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints, one, self._other(one, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def _slots(self, prints: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A slot with that content in one of the buckets, and whether there is one."""
        grid = self.table.reshape(-1, SLOTS)
        both = np.concatenate([grid[one], grid[two]], axis=1) == prints[:, None]
        at = both.argmax(axis=1)
        return np.where(at < SLOTS, one, two) * SLOTS + at % SLOTS, both[np.arange(len(at)), at]

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash may be in; never false for one that is."""
        return self._slots(*self._places(hashes))[1]

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """Put the hashes in, each once more; gives the places of those for which there is no room."""
        prints, one, two = self._places(hashes)
        left = np.arange(len(hashes))
        while len(left):
            slot, free = self._slots(np.zeros(len(left), np.uint16), one[left], two[left])
            chosen = np.flatnonzero(free)
            chosen = chosen[np.unique(slot[chosen], return_index=True)[1]]
            if not len(chosen):
                break
            self.table[slot[chosen]] = prints[left[chosen]]
            self.live += len(chosen)
            left = np.delete(left, chosen)
        return left[[not self._push(prints[i : i + 1], int(two[i])) for i in left.tolist()]] if len(left) else left

    def _push(self, homeless: np.ndarray, bucket: int) -> bool:
        moved = []
        for _ in range(KICKS):
            free = np.flatnonzero(self.table[bucket * SLOTS : bucket * SLOTS + SLOTS] == 0)
            # A fixed sequence, so that a task that is run again makes the same table.
            self.state = (self.state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            slot = bucket * SLOTS + (int(free[0]) if len(free) else (self.state >> 33) % SLOTS)
            moved.append((slot, self.table[slot]))
            homeless, self.table[slot] = self.table[slot : slot + 1].copy(), homeless[0]
            if len(free):
                self.live += 1
                return True
            bucket = int(self._other(np.array([bucket]), homeless)[0])
        for slot, was in reversed(moved):
            self.table[slot] = was
        return False

    def discard(self, hashes: np.ndarray) -> np.ndarray:
        """Take each hash out once; gives the places of those that aren't in."""
        prints, one, two = self._places(hashes)
        left, gone = np.arange(len(hashes)), []
        while len(left):
            slot, there = self._slots(prints[left], one[left], two[left])
            gone.append(left[~there])
            left, slot = left[there], slot[there]
            chosen = np.unique(slot, return_index=True)[1]
            self.table[slot[chosen]] = 0
            self.live -= len(chosen)
            left = np.delete(left, chosen)
        return np.concatenate(gone) if gone else left


class Shard:
    """The filter of one shard while keys come: what it was given, and a second one for keys that it has no room for.

    The second one's keys are known here, so it grows from them.  A shard that had no filter has the second one alone.
    """

    def __init__(self, table: bytes | None = None) -> None:
        self.given = None if table is None else CuckooFilter(table=table)
        self.more = CuckooFilter()
        self.keys = np.empty(0, np.uint64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = self.more.holds(hashes)
        return found if self.given is None else found | self.given.holds(hashes)

    def add(self, hashes: np.ndarray) -> None:
        if self.given is not None:
            room = max(0, int(self.given.buckets * SLOTS * FULL) - self.given.live)
            hashes = np.concatenate([hashes[:room][self.given.add(hashes[:room])], hashes[room:]])
        self.keys = np.concatenate([self.keys, hashes])
        if not len(hashes):
            return
        while len(self.keys) > self.more.buckets * SLOTS * FULL or len(self.more.add(hashes)):
            self.more, hashes = CuckooFilter(self.more.buckets * 2), self.keys

    def discard(self, hashes: np.ndarray) -> None:
        if self.given is not None:
            self.given.discard(hashes)

    def result(self) -> tuple[CuckooFilter, bool]:
        """The filter, and whether it holds all keys; if not, it is to be made anew from the stored ones."""
        if self.given is None:
            return self.more, True
        return self.given, not len(self.keys)


class Index(NamedTuple):
    """The tables of the module's docstring, the number of shards and of batches that were put in."""

    shards: int
    batches: int
    filters: DataFrame
    content: DataFrame
    members: DataFrame


def normalised(text: Column) -> Column:
    """The text with one space for each run of white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def _digests(column: pa.Array) -> np.ndarray:
    """The bytes of a column of 32-byte values, one row for each."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), 32)


def _combined(rows: DataFrame) -> DataFrame:
    """(digest, size, first, n): rows of one digest in one Arrow batch as one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            # In the order in which rows stay, so that the first of each is the one.
            table = table.sort_by([("lost", "ascending"), ("doc_id", "ascending"), ("batch", "ascending"), ("row", "ascending")])
            kept = ("size", "lost", "doc_id", "batch", "row")
            out = table.group_by("digest", use_threads=False).aggregate([*((c, "first") for c in kept), ("row", "count")])
            yield from out.select(["digest", *(f"{c}_first" for c in kept), "row_count"]).rename_columns(["digest", *kept, "n"]).combine_chunks().to_batches()

    lost = F.col("doc_id").isNull()
    flat = rows.select("digest", "size", lost.alias("lost"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "batch", "row")
    made = flat.mapInArrow(task, "digest binary, size long, lost boolean, doc_id long, batch int, row long, n long")
    return made.select("digest", "size", F.struct("lost", "doc_id", "batch", "row").alias("first"), "n")


def _applied(filters: DataFrame | None, keys: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """Keys (digest, size, first, n, op) brought to their filters: the new filters, and the inserted keys with `hit`.

    Within a shard deletions come first, then insertions by `first`, then the ones that are put in whatever the filter holds.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, Shard()

        def done() -> Iterator[pa.RecordBatch]:
            if at is not None:
                found, whole = shard.result()
                yield pa.RecordBatch.from_arrays([pa.array([FILTER], pa.int32()), pa.array([at], pa.int32()), pa.array([found.table.astype("<u2").tobytes()], pa.binary()), pa.array([found.live]), pa.array([None], batch_first), pa.array([None], pa.int64()), pa.array([whole])], names=names)

        names = ["op", "shard", "payload", "size", "first", "n", "flag"]
        batch_first = pa.struct([("lost", pa.bool_()), ("doc_id", pa.int64()), ("batch", pa.int32()), ("row", pa.int64())])
        for batch in batches:
            ops, of = (np.asarray(batch.column(c)) for c in (0, 1))
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (ops[1:] != ops[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True):
                if hi == lo:
                    continue
                if of[lo] != at:
                    yield from done()
                    at, shard = int(of[lo]), Shard()
                part = batch.slice(lo, hi - lo)
                if ops[lo] == FILTER:
                    shard = Shard(part.column(2)[0].as_py())
                    continue
                digests = _digests(part.column(2))
                hashes = np.ascontiguousarray(digests[:, :8]).view("<u8").ravel()
                if ops[lo] == DELETE:
                    shard.discard(hashes)
                    continue
                hit = np.zeros(len(hashes), bool)
                new = np.arange(len(hashes))
                if ops[lo] == INSERT:
                    whole = np.ascontiguousarray(digests).view("V32").ravel()
                    # Later keys of the same digest meet what the first one has put in.
                    new = np.sort(np.unique(whole, return_index=True)[1])
                    hit[:] = True
                    hit[new] = shard.holds(hashes[new])
                    new = new[~hit[new]]
                shard.add(hashes[new])
                yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(hit)], names=names)
        yield from done()

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = keys.select("op", _shard(shards).alias("shard"), F.col("digest").alias("payload"), "size", "first", "n")
    if filters is not None:
        given = given.unionByName(filters.select(F.lit(FILTER).alias("op"), "shard", F.col("table").alias("payload"), F.col("live").alias("size")), allowMissingColumns=True)
    dealt = given.repartition(parts, "shard").sortWithinPartitions("shard", "op", "first")
    out = store(dealt.mapInArrow(task, f"op int, shard int, payload binary, size long, {_FIRST}, n long, flag boolean"), "cuckoo")
    tables = out.where(F.col("op") == FILTER).select("shard", F.col("size").alias("live"), F.col("payload").alias("table"), F.col("flag").alias("whole"))
    return tables, out.where(F.col("op") != FILTER).select(F.col("payload").alias("digest"), "size", "first", "n", F.col("flag").alias("hit"))


def _bucketed(content: DataFrame, shards: int) -> DataFrame:
    """`content` in the shared folder, in buckets by digest: later joins by digest don't shuffle it."""
    spark, name = content.sparkSession, f"favora_content_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = content.select(_shard(shards).alias("shard"), "digest", "size", "first", "n").repartition(parts, "digest", "size")
    made.write.bucketBy(parts, "digest", "size").sortBy("digest", "size").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def _resized(filters: DataFrame, content: DataFrame, shards: int) -> DataFrame:
    """The filters, those that are full made anew from the stored keys of their shards."""
    small = filters.where(~F.col("whole")).select("shard")
    if not small.limit(1).count():
        return filters
    keys = content.join(small, "shard", "left_semi").select("digest", "size", "first", "n", F.lit(FORCE).alias("op"))
    return filters.where("whole").unionByName(_applied(None, keys, shards)[0])


def resharded(index: Index, shards: int) -> Index:
    """The index with another number of shards, its filters made anew from the stored keys."""
    keys = index.content.select("digest", "size", "first", "n", F.lit(FORCE).alias("op"))
    return index._replace(shards=shards, filters=_applied(None, keys, shards)[0], content=_bucketed(index.content, shards))


def insert(index: Index | None, docs: DataFrame) -> Index:
    """The index (None: an empty one) with all rows of `docs` (doc_id, text) put in.

    Null texts count as empty.  Rows without an id are members that stay only where no row of the text has one; of several
    rows with the same text and the same smallest id the one that was put in first stays.  Other columns are not read.
    """
    batch = index.batches if index else 0
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text"))
    rows = text.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("size"))
    rows = store(rows.select("*", F.lit(batch).alias("batch"), F.monotonically_increasing_id().alias("row")), "digests")
    total = rows.count() + (index.members.count() if index else 0)
    if index and total > 2 * index.shards * SHARD_ROWS:
        index = resharded(index, index.shards * 4)
    # Several for each task, so that tasks are even.
    shards = index.shards if index else 1 << max(8, (total // SHARD_ROWS).bit_length())
    filters, keys = _applied(index.filters if index else None, _combined(rows).withColumn("op", F.lit(INSERT)), shards)
    new = keys.where("not hit").drop("hit")
    hits = keys.where("hit").groupBy("digest", "size").agg(F.min("first").alias("more_first"), F.sum("n").alias("more"))
    known = new.select("digest", "size", "first", "n")
    if index:
        known = known.unionByName(index.content.select("digest", "size", "first", "n"))
    # A hit that the content doesn't have was another key's fingerprint: it is content of its own.
    met = known.join(hits, ["digest", "size"], "full_outer")
    content = _bucketed(
        met.select("digest", "size", F.least("first", "more_first").alias("first"), (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n")),
        shards,
    )
    strays = store(hits.join(known.select("digest", "size"), ["digest", "size"], "left_anti").select("digest", "size", F.col("more_first").alias("first"), F.col("more").alias("n"), F.lit(FORCE).alias("op")), "strays")
    if strays.limit(1).count():
        # A filter that is to be made anew takes them from the content.
        filters = _applied(filters.where("whole"), strays, shards)[0].join(filters.where("not whole"), "shard", "left_anti").unionByName(filters.where("not whole"))
    return Index(shards, batch + 1, store(_resized(filters, content, shards), "filters"), content, index.members.unionByName(rows) if index else rows)


def delete(index: Index, ids: DataFrame) -> Index:
    """The index without the members whose doc_id is in `ids` (doc_id); ids that are not in change nothing."""
    gone = ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    lost = store(_combined(index.members.join(gone, "doc_id", "left_semi")).groupBy("digest", "size").agg(F.sum("n").alias("lost")), "lost")
    members = store(index.members.join(gone, "doc_id", "left_anti"), "members")
    again = _combined(members.join(lost, ["digest", "size"], "left_semi")).groupBy("digest", "size").agg(F.min("first").alias("again"))
    met = index.content.join(lost, ["digest", "size"], "left").join(again, ["digest", "size"], "left")
    left = F.col("n") - F.coalesce("lost", F.lit(0))
    content = _bucketed(met.where(left > 0).select("digest", "size", F.coalesce("again", "first").alias("first"), left.alias("n")), index.shards)
    dead = lost.join(content, ["digest", "size"], "left_anti").select("digest", "size", F.lit(None).cast(content.schema["first"].dataType).alias("first"), F.lit(0).cast("long").alias("n"), F.lit(DELETE).alias("op"))
    return index._replace(filters=_applied(index.filters, dead, index.shards)[0], content=content, members=members)


def standing(index: Index) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each member; one row of each group is kept, that of keep_id."""
    total = index.members.count()
    found = index.content.select("digest", "size", "first", F.col("n").alias("group_size"))
    hot = F.broadcast(store(found.where(F.col("group_size") * HOT > total), "hot"))
    rest = index.members.join(hot.select("digest", "size"), ["digest", "size"], "left_anti").join(found, ["digest", "size"])
    every = index.members.join(hot, ["digest", "size"]).unionByName(rest)
    first = F.col("first")
    return every.select(
        "doc_id",
        F.when(~first["lost"], first["doc_id"]).alias("keep_id"),
        "group_size",
        ((F.col("batch") == first["batch"]) & (F.col("row") == first["row"])).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: all `documents` put into an empty index."""
    return standing(insert(None, read(spark, sf_dir, "documents")))


OP11_SQL = r"""
WITH t AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
