"""Exact duplicates, periodic runs and whitening against brute-force versions, with nulls, empty texts, ties and empty tables."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from favora.llm import exact_dedup, periodic_runs, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, digest string, size long, batch int, first int, runs string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, None, 2, "y") for i, t in rows], DOCS)


def groups(rows):
    """(doc_id, keep_id, group_size, sha256) of each row, and the number of kept rows of each text, by plain grouping."""
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    by = {}
    for i, t in rows:
        by.setdefault(norm(t), []).append(i)
    out = []
    for t, ids in by.items():
        known = [i for i in ids if i is not None]
        out += [(i, min(known, default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str), len(by)


def check(index, rows):
    got = exact_dedup.standing(index).collect()
    expected, n = groups(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == expected
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in kept}) == n
    assert all(r.doc_id == r.keep_id for r in kept)
    # The filters hold each live digest once.
    assert sum(r.live for r in index.filters.collect()) == index.content.count() == n


ROWS = [(7, "a b"), (3, "a  b"), (9, "a\t\nb"), (3, "a b"), (4, " a b"), (5, None), (2, ""), (None, "a b"), (None, "lost"), (None, "lost"), (8, "é b"), (6, "é b"), (1, "x " * 50_000), (11, "x  " * 50_000)]


def test_dedup_equals_grouping_and_sql(spark):
    check(exact_dedup.insert(None, docs(spark, ROWS)), ROWS)
    check(exact_dedup.insert(None, docs(spark, ROWS).repartition(7)), ROWS)
    check(exact_dedup.insert(None, docs(spark, []).limit(0)), [])
    con = duckdb.connect()
    pdf = docs(spark, [r for r in ROWS if r[0] is not None]).toPandas()  # noqa: F841
    con.execute("create view documents as select * from pdf")
    got = exact_dedup.standing(exact_dedup.insert(None, docs(spark, [r for r in ROWS if r[0] is not None])))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(exact_dedup.OP11_SQL).fetchall())


def test_index_takes_batches_and_deletions(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["u", "v w", f"t{r.randrange(300)}", None])) for i in range(600)]
    index = exact_dedup.insert(None, docs(spark, rows[400:]))
    index = exact_dedup.insert(index, docs(spark, rows[:400]))
    check(index, rows)
    gone = set(r.sample(range(600), 350)) | {i for i, t in rows if t == "v w"}
    index = exact_dedup.delete(index, spark.createDataFrame([(i,) for i in [*gone, 5000]] + [(None,)], "doc_id long"))
    left = [x for x in rows if x[0] not in gone]
    check(index, left)
    # What was taken out is new again.
    check(exact_dedup.insert(index, docs(spark, [(7000, "v w"), (6000, "v w")])), [*left, (7000, "v w"), (6000, "v w")])


def test_false_hits_are_told_apart(spark, monkeypatch):
    """Filters whose fingerprints are all alike hit for every key; the content decides."""
    plain = exact_dedup.CuckooFilter._places

    def same(self, hashes):
        prints, one, two = plain(self, hashes)
        return np.ones_like(prints), one, self._other(one, np.ones_like(prints))

    monkeypatch.setattr(exact_dedup.CuckooFilter, "_places", same)
    monkeypatch.setattr(exact_dedup, "SHARD_ROWS", 1 << 40)
    rows = [(i, f"t{i % 120}") for i in range(200)]
    filters = exact_dedup.CuckooFilter()
    filters.add(np.arange(40, dtype=np.uint64) * np.uint64(1 << 50))
    assert filters.holds(np.arange(9, dtype=np.uint64)).any()
    index = exact_dedup.insert(None, docs(spark, rows))
    check(index, rows)
    check(exact_dedup.insert(index, docs(spark, [(1000, "t5"), (1001, "new")])), [*rows, (1000, "t5"), (1001, "new")])


def test_full_filters_grow_from_stored_keys(spark):
    """All digests in a few shards: a second batch finds their filters full."""
    rows = [(i, f"text {i}") for i in range(3000)]
    index = exact_dedup.insert(None, docs(spark, rows[:1000]))
    index = exact_dedup.resharded(index, 2)
    before = {r.shard: len(r.table) for r in index.filters.collect()}
    index = exact_dedup.insert(index, docs(spark, rows[1000:] + rows[:10]))
    after = {r.shard: len(r.table) for r in index.filters.collect()}
    assert all(after[s] > before[s] for s in before) and all(r.whole for r in index.filters.collect())
    check(index, rows + rows[:10])


def test_cuckoo_filter_forgets_nothing():
    r = np.random.default_rng(1)
    hashes = r.integers(0, 1 << 63, 3600, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    f = exact_dedup.CuckooFilter(1024)
    left = f.add(hashes)
    put = np.delete(hashes, left)
    assert f.holds(put).all() and f.live == len(put) > 3500
    assert f.holds(r.integers(0, 1 << 63, 50_000, dtype=np.uint64)).mean() < 1e-3
    assert not len(f.discard(put[:1000])) and f.holds(put[1000:]).all()
    assert not len(f.discard(put[1000:])) and not f.table.any() and f.live == 0
    s = exact_dedup.Shard()
    for part in np.array_split(hashes, 9):
        s.add(part)
    grown, whole = s.result()
    assert whole and grown.live == len(hashes) and s.holds(hashes).all()


def brute_runs(words):
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_equal_brute_force(spark):
    r = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a " * 11), (4, "a " * 12), (5, "a b " * 6), (6, "abc"), (None, "z " * 40), (7, "a " * 12), (8, "A a " * 30 + "é é " * 20)]
    for i in range(10, 160):
        n, few = r.choice([30, 80, 200]), r.choice([1, 2, 3, 40])
        w = [r.choice("abcdefghijklmnopqrstuvwxyz" * 2)[:1] if few > 3 else r.choice("abc"[:few]) for _ in range(n)]
        if r.random() < 0.7:
            a = r.randrange(n)
            p = r.randint(1, max(1, (n - a) // 2))
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        rows.append((i, r.choice([" ", "  ", "\t"]).join(w)))
    got = periodic_runs.periodic_runs(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for (i, text), g in zip(sorted(rows, key=str), sorted(got, key=lambda g: str((g.doc_id, dict(rows)[g.doc_id]))), strict=True):
        words = WORD.findall(text or "")
        assert g.doc_id == i
        assert [tuple(x) for x in g.runs] == brute_runs(words)
        assert g.collapsed == collapsed(words, brute_runs(words))
    assert periodic_runs.periodic_runs(docs(spark, []).limit(0)).count() == 0


def test_runs_of_a_long_text(spark):
    r = random.Random(6)
    block = [f"w{r.randrange(50)}" for _ in range(700)]
    words = [f"u{k}" for k in range(30_000)] + block * 40 + ["x"] * 5000
    (g,) = periodic_runs.periodic_runs(docs(spark, [(1, " ".join(words))])).collect()
    assert [tuple(x) for x in g.runs] == [(30_000, 28_000, 700), (58_000, 5000, 1)]
    assert g.collapsed == " ".join([*words[:30_000], *block, "x"])


def test_planted_query_equals_brute_force(spark, tmp_path):
    r = random.Random(7)
    rows = [(i, r.choice([" ".join(r.choice(["aa", "b", "cc", "d"]) for _ in range(r.randrange(0, 60))), None, ""])) for i in range(300)] + [(None, "a " * 30)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {g.doc_id: g for g in periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect()}
    for i, text in rows:
        words = WORD.findall(text or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(words)
        top = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        expected = (i, len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4))
        expected += (hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest())
        assert tuple(got[i]) == expected


def plain_whitening(x, most):
    n, s = len(x), x.sum(axis=0)
    v = np.cov(x.T.astype(float), bias=True)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    return ((x - s / n) @ vectors) / np.sqrt(values), values / np.trace(v), [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, deviation string")


@pytest.mark.parametrize("parts", [1, 5])
def test_whitening_equals_plain(spark, parts):
    r = np.random.default_rng(2)
    x = (r.normal(size=(400, 40)) * np.linspace(0.1, 3, 40) + 5).astype(np.float32)
    bad = [(None, x[0]), (1000, None), (1001, []), (1002, [None] * 40), (1003, [float("nan")] * 40), (1004, [float("inf")] * 40), (1005, [1.0] * 39)]
    rows = [*enumerate(x.tolist()), *bad, (0, x[0].tolist())]
    whole = np.floor(64 * np.vstack([x, x[:1], x[:1]]).astype(float)).astype(np.int64) + 1_000_000
    expected, shares, far = plain_whitening(whole, 32)
    out, basis, error = whitening.whiten(vectors(spark, rows).repartition(parts))
    got = out.collect()
    assert len(got) == 402 and error < 1e-9 and basis.moments.n == 402
    by = {g.vec_id: g for g in got}
    w = np.array([by[i].whitened for i in range(400)])
    sign = np.sign((w * expected[:400]).sum(axis=0))
    assert np.abs(w * sign - expected[:400]).max() < 1e-8
    assert [int(by[i].deviation) for i in range(400)] == far[:400]
    assert np.abs(basis.values / basis.trace - shares).max() < 1e-12


def test_whitening_query_and_degenerate_tables(spark, tmp_path):
    r = np.random.default_rng(3)
    flat = np.column_stack([r.normal(size=(50, 3)), np.ones(50)])
    vectors(spark, [*enumerate(flat.tolist())]).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op13_embedding_whitening(spark, str(tmp_path)).toPandas()
    # A dimension without spread has no component.
    assert sorted(got.groupby("component").size().items()) == [(1, 50), (2, 50), (3, 50)]
    assert got.identity_error.max() < 1e-9 and (got.n == 50).all() and abs(got.drop_duplicates("component").explained.sum() - 1) < 1e-9
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out, basis, _ = whitening.whiten(vectors(spark, rows))
        assert basis is None and out.count() == 0
        assert out.columns == ["vec_id", "deviation", "whitened"]


def test_moments_merge_without_loss():
    r = np.random.default_rng(4)
    x = r.normal(size=(1000, 5)) + 1e8
    parts = [whitening.local_moments(p) for p in np.array_split(x, 7)]
    got = parts[0]
    for p in parts[1:]:
        got = whitening.merged(got, p)
    rest = x - x.mean(axis=0)
    assert np.abs(got.scatter - rest.T @ rest).max() < 1e-5
    assert whitening.merged(whitening.Moments(0, np.zeros(0), np.zeros(0), np.zeros(0)), got) is got


def test_large_deviations_are_exact(spark):
    far = np.array([[3_000_000_000, 1], [2, 2]])
    assert whitening._deviation(far) == [9 * 10**18 + 1, 8]
    assert whitening._deviation(np.array([[10**11, 0]], object)) == [10**22]
