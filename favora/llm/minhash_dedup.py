"""MinHash near-duplicate groups by min-max hashing.

Each document's set of distinct word shingles is reduced under `PERMUTATIONS` permutations to both its minimum and its
maximum (Ji et al., 2013), so 320 values cost 160 hash evaluations.  Bands of `ROWS` values from different permutations
become bucket keys: two sets of similarity 0.8 miss all 32 buckets with a chance of 3 in a million.  Four bits of every
value form a sketch; pairs whose sketches agree five standard deviations less than those of similarity 0.8 are left out.
What remains is confirmed on the full sets, so the links returned are exact.

Groups never meet in one task: equal sets are first folded into one class; in a bucket the classes are compared with its
most connected one, then with another.  Classes that are still in other components than most of a bucket are compared with
all of that component and with each other, in tasks of two blocks of bounded size; pairs are never listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from favora.functions.tables import store
from favora.llm.shared import components, mix, pieces, read, shingles

PERMUTATIONS = 160
ROWS = 5
BANDS = 32
#: Sets of a block, and their elements: a task holds two blocks.
PAIR_BLOCK = 200
PAIR_ELEMENTS = 200_000
SLOTS = 1 << 40
SKETCH_LONGS = 2 * PERMUTATIONS // 16
_FACTORS = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)


def _bands(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket keys and sketches of non-empty sets, one row each."""
    every = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]]).astype(np.int64)
    values = np.empty((2 * PERMUTATIONS, len(sets)), np.uint64)
    for i, factor in enumerate(_FACTORS):
        image = every * factor
        values[2 * i] = np.minimum.reduceat(image, at)
        values[2 * i + 1] = np.maximum.reduceat(image, at)
    keys = np.empty((len(sets), BANDS), np.uint64)
    for j in range(BANDS):
        # Minima or maxima only, so that a band has each permutation once.
        key = np.full(len(sets), j + 1, np.uint64)
        for i in range(ROWS):
            key = mix(key * np.uint64(0x9FB21C651E98DF25) + values[2 * (j // 2 * ROWS + i) + j % 2])
        keys[:, j] = key
    bits = mix(values) >> np.uint64(60)
    sketch = np.zeros((len(sets), SKETCH_LONGS), np.uint64)
    for i in range(2 * PERMUTATIONS):
        sketch[:, i // 16] |= bits[i] << np.uint64(4 * (i % 16))
    return keys, sketch


def alike(a: str, b: str, percent: int) -> str:
    """SQL: whether two sketches agree as those of sets of at least this similarity do, five standard deviations allowed."""
    p = percent / 100 + (1 - percent / 100) / 16
    most = 2 * PERMUTATIONS * (1 - p) + 5 * (2 * PERMUTATIONS * p * (1 - p)) ** 0.5
    x = [f"({a}[{i}] ^ {b}[{i}])" for i in range(SKETCH_LONGS)]
    y = [f"({v} | shiftrightunsigned({v}, 1))" for v in x]
    # A set bit for each four that differ.
    return " + ".join(f"bit_count(({v} | shiftrightunsigned({v}, 2)) & {0x1111111111111111}L)" for v in y) + f" <= {int(most)}"


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, sketch) of each document; the last three are null for documents without words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, 1):
            sets = shingles(data, offsets, words)
            full = [i for i, x in enumerate(sets) if len(x)]
            keys: list = [None] * len(sets)
            digests: list = [None] * len(sets)
            sketches: list = [None] * len(sets)
            if full:
                for i, band, sketch in zip(full, *(x.view(np.int64) for x in _bands([sets[i] for i in full])), strict=True):
                    keys[i], sketches[i], digests[i] = band, sketch, hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those (a, b) of `pairs` whose full sets have 100 * intersection >= percent * union."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, one_set = None, np.empty(0, np.uint64)
        for batch in batches:
            for rows, data, offsets in pieces([batch], 3):
                a_ids, b_ids = rows.column(0).to_pylist(), rows.column(1).to_pylist()
                linked = []
                for i, b_set in enumerate(shingles(data, offsets, words)):
                    if a_ids[i] != one:
                        _, d, o = next(pieces([rows.slice(i, 1)], 2))
                        one, one_set = a_ids[i], shingles(d, o, words)[0]
                    common = len(np.intersect1d(one_set, b_set, assume_unique=True))
                    if 100 * common >= percent * (len(one_set) + len(b_set) - common):
                        linked.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([a_ids[i] for i in linked], pa.int64()), pa.array([b_ids[i] for i in linked], pa.int64())], names=["a", "b"])

    sides = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return sides.select("a", "b", "text_a", "text_b").mapInArrow(task, "a long, b long")


def _undecided(buckets: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The buckets' classes with their components, and of each bucket with several its largest one and a class of that."""
    of = components(links)
    named = buckets.select("band", "doc", "n").join(of.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    kinds = named.groupBy("band", "component").agg(F.count("*").alias("c"), F.max(F.struct(F.xxhash64("band", "doc"), "doc", "n")).alias("one"))
    mixed = kinds.groupBy("band").agg(F.count("*").alias("kinds"), F.max(F.struct("c", "component", "one")).alias("most")).where("kinds > 1")
    return named, mixed.select("band", F.col("most.component").alias("main"), F.col("most.one.doc").alias("pivot"), F.col("most.one.n").alias("pivot_n"))


def _linked(one: list[np.ndarray], two: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """The places of linked sets, through an index of the second list's elements."""
    size = np.array([len(x) for x in two])
    every, of = np.concatenate(two), np.repeat(np.arange(len(two)), size)
    order = np.argsort(every, kind="stable")
    every, of = every[order], of[order]
    for i, x in enumerate(one):
        lo, hi = np.searchsorted(every, x), np.searchsorted(every, x, "right")
        n = hi - lo
        upto = np.concatenate([[0], np.cumsum(n)])
        common = np.bincount(of[np.arange(upto[-1]) + np.repeat(lo - upto[:-1], n)], minlength=len(two))
        for j in np.flatnonzero(100 * common >= percent * (len(x) + size - common)):
            yield i, int(j)


def _confirm_blocks(sides: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The links (a, b) of the `few` documents of each group `main` of `sides` (main, doc, few, n) with all of the group."""
    blocks = lambda count, n: F.greatest(F.ceil(count / PAIR_BLOCK), F.ceil(n / PAIR_ELEMENTS))
    sizes = sides.groupBy("main").agg(blocks(F.count_if("few"), F.sum(F.when(F.col("few"), F.col("n")).otherwise(0))).alias("rows"), blocks(F.count("*"), F.sum("n")).alias("cols")).where("rows > 0")
    full = sides.join(sizes, "main").join(texts.select(F.col("doc_id").alias("doc"), "text"), "doc")
    row, col = (F.pmod(F.xxhash64("doc"), F.col(x)) for x in ("rows", "cols"))
    asks = full.where("few").select("main", row.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)).alias("j"), F.lit(0).alias("side"), "doc", "text", "cols")
    asked = full.select("main", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("i"), col.alias("j"), F.lit(1).alias("side"), "doc", "text", "cols")
    # The pairs of blocks of a group take slots side by side, which ranges of even size deal out.
    slot = F.pmod(F.pmod(F.xxhash64("main"), F.lit(SLOTS)) + F.col("i") * F.col("cols") + F.col("j"), F.lit(SLOTS))
    dealt = asks.union(asked).withColumn("slot", slot).drop("cols")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs, sets = None, ([], []), ([], [])

        def found() -> pa.RecordBatch:
            out = [sorted((docs[0][i], docs[1][j])) for i, j in _linked(*sets, percent)] if sets[0] and sets[1] else []
            out = [x for x in out if x[0] != x[1]]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

        for rows, data, offsets in pieces(batches, 5):
            keys = zip(*(rows.column(c).to_pylist() for c in range(3)), strict=True)
            for key, side, doc, of in zip(keys, rows.column(3).to_pylist(), rows.column(4).to_pylist(), shingles(data, offsets, words), strict=True):
                if key != now:
                    yield found()
                    now, docs, sets = key, ([], []), ([], [])
                docs[side].append(doc)
                sets[side].append(of)
        yield found()

    return dealt.repartitionByRange("slot").sortWithinPartitions("slot", "main", "i", "j").mapInArrow(task, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per doc_id: n_shingles, component_id and kept.

    Null texts count as empty; documents without words link with nothing.  Rows with a null doc_id can't be named and are
    left out.  Where rows share a doc_id, the one with the least text stands for it.  Other columns are not read.
    """
    given = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = store(signatures(given, words), "signatures")
    if found.groupBy("doc_id").count().where("count > 1").limit(1).count():
        given = given.groupBy("doc_id").agg(F.min("text").alias("text"))
        found = store(signatures(given, words), "signatures")
    classes = found.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc"))
    first = classes.join(found.select(F.col("doc_id").alias("doc"), "n_shingles", "bands"), "doc")
    spread = first.select("doc", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count("*").alias("c")).where("c > 1")
    buckets = store(spread.join(shared, "band").select("band", "doc", "n", "c"), "buckets")
    texts = store(given.join(buckets.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")
    sketches = store(found.select(F.col("doc_id").alias("doc"), "sketch").join(buckets.select("doc").distinct(), "doc", "left_semi"), "sketches")
    one, two = (sketches.select(F.col("doc").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    sizes = (F.greatest("n", "n2") * percent <= F.least("n", "n2") * 100)

    # The most connected class of a bucket is its pivot.
    known = buckets.groupBy("doc").agg(F.sum("c").alias("mates"))
    ranked = buckets.join(known, "doc")
    pivots = ranked.groupBy("band").agg(F.max(F.struct("mates", (-F.col("doc")).alias("d"), "n")).alias("p"))
    pairs = ranked.join(pivots, "band").where("doc != -p.d").groupBy("doc").agg(F.max(F.struct("p.mates", "p.d", F.col("p.n").alias("n2"), "n")).alias("p"))
    pairs = pairs.select(F.least("doc", -F.col("p.d")).alias("a"), F.greatest("doc", -F.col("p.d")).alias("b"), "p.n", "p.n2").where(sizes).select("a", "b").distinct()
    pairs = store(pairs.join(one, "a").join(two, "b").where(alike("sketch_a", "sketch_b", percent)).select("a", "b"), "pairs")
    links = store(confirm(pairs, texts, words, percent), "links")
    done = pairs
    named, mixed = _undecided(buckets, links)
    few = named.join(mixed, "band").where("component != main")
    pairs = few.select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b"), "n", F.col("pivot_n").alias("n2")).where(sizes).select("a", "b").distinct()
    pairs = pairs.join(one, "a").join(two, "b").where(alike("sketch_a", "sketch_b", percent)).select("a", "b")
    pairs = store(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
    links = store(links.union(confirm(pairs, texts, words, percent)), "links")

    named, mixed = _undecided(buckets, links)
    sides = named.join(mixed, "band").groupBy("main", "doc").agg(F.bool_or(F.col("component") != F.col("main")).alias("few"), F.first("n").alias("n"))
    links = store(links.union(_confirm_blocks(store(sides, "sides"), texts, words, percent)), "links")
    of = components(links)
    member = classes.join(of.withColumnRenamed("node", "doc"), "doc", "left").select("set_key", F.coalesce("component", "doc").alias("component"))
    out = found.select("doc_id", "n_shingles", "set_key").join(member, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: two-word shingles over `documents`."""
    return near_duplicates(read(spark, sf_dir, "documents"), words=2, percent=80)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates (five-word shingles) the smallest doc_id stays.

    Rows without a doc_id and documents without words all stay; rows that share a doc_id stay or go together, by the one
    with the least text.  An empty table gives an empty one.
    """
    gone = near_duplicates(docs, words=5, percent=80).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


OP6_SQL = r"""
with recursive d as (select doc_id, min(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\v\f\r]+')) as w from documents where doc_id is not null group by doc_id),
s as (select distinct doc_id, unnest(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) when len(w) = 1 then w else [] end) as sh from d),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as n from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c.n >= 80 * (x.n + y.n - c.n)),
e as (select a, b from l union all select b, a from l),
r(doc_id, o) as (select doc_id, doc_id from d union select r.doc_id, e.b from r join e on r.o = e.a),
m as (select doc_id, min(o) as component_id from r group by doc_id)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from m left join n using (doc_id)
"""
