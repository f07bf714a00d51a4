"""Operators on texts against brute-force versions, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from favora.llm import decontaminate, minhash_dedup, pii, quality, sentencepiece_unigram, token_blocks
from favora.llm.shared import components, pieces, word_hashes, word_spans
from pyspark.sql import functions as F

tokenizer_files = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, bands string, found int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), "x", None) for i, t in rows], DOCS)


def arrow(texts):
    return pieces(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])]), 0)


def test_word_hashes_follow_words():
    texts = ["A b\tc", "", None, "é  a B", " x ", "a"]
    seen = {}
    for _, data, offsets in arrow(texts):
        starts, ends, at = word_spans(data, offsets)
        words = [bytes(data[a:b]).decode().translate(AZ) for a, b in zip(starts, ends, strict=True)]
        assert words == [w for t in texts for w in WORD.findall((t or "").translate(AZ))]
        assert np.diff(at).tolist() == [len(WORD.findall(t or "")) for t in texts]
        for w, h in zip(words, word_hashes(data, starts, ends), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def thue_morse(n):
    """Two words that every polynomial hash modulo a power of two takes for one."""
    x, y = "a", "b"
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("same", [lambda h: h * 0, lambda h: h % np.uint64(3), lambda h: h])
def test_words_with_equal_hashes_are_told_apart(monkeypatch, same):
    """Ids follow the words' bytes, even if a hash can't tell words apart."""
    from favora.llm import shared

    plain = shared.word_hashes
    monkeypatch.setattr(shared, "word_hashes", lambda *args, **more: same(plain(*args, **more)))
    r = random.Random(20)
    words = [*thue_morse(10), *thue_morse(4), "a", "b", "abcdefgh", "abcdefghi", "abcdefgh" * 8, "abcdefgh" * 8 + "x", "abcdefgh" * 8 + "y"]
    seen, number = shared.Words(), {w: [i] * (i % 3 + 1) for i, w in enumerate(words)}
    for _ in range(5):
        texts = [" ".join(r.choice(words) for _ in range(30)) for _ in range(3)]
        for _, data, offsets in arrow(texts):
            starts, ends, at = word_spans(data, offsets)

            def search(some, data=data, starts=starts, ends=ends):
                parts = [number[bytes(data[starts[i] : ends[i]]).decode()] for i in some]
                return np.array(sum(parts, [])), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

            ids, upto = seen.ids_of(data, starts, ends, search)
            assert ids.tolist() == sum((number[w] for t in texts for w in t.split()), [])
            assert len(upto) == len(starts) + 1


def test_words_that_polynomial_hashes_confuse(spark, tmp_path):
    from tokenizers import Tokenizer

    x, y = thue_morse(10)
    rows = [(1, x), (2, y), (3, f"{x} {x} {y}"), (4, f"{y} {y} {x}")]
    path = tokenizer_files.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    token_blocks.write_ids(docs(spark, rows), path, str(tmp_path / "t"))
    for got in token_blocks.read_ids(spark, str(tmp_path / "t")).collect():
        assert got.ids == [*plain.encode(dict(rows)[got.doc_id], add_special_tokens=False).ids, 1]
    model = tokenizer_files.path("piece_bpe_32k.model")
    assert {z.doc_id: z.decoded for z in sentencepiece_unigram.encode_documents(docs(spark, rows), model).collect()} == dict(rows)
    assert all(z.kept for z in minhash_dedup.near_duplicates(docs(spark, rows), 2).collect())


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)]
    of = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    got = dict(tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got.get(n, n) == c for n, c in of.items())


def brute_groups(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(AZ))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    of = {i: i for i in sets}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((root(a), root(b)))
            of[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, monkeypatch, k):
    monkeypatch.setattr(minhash_dedup, "PAIR_BLOCK", 5)
    r = random.Random(k)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(4):
        base = [r.choice(words) for _ in range(120)]
        for _ in range(25):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 6, 8])):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((len(rows), " ".join(w)))
    rows += [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "one two"), (905, "one\ttwo\n"), (906, "lonely " * 3000)]
    got = minhash_dedup.near_duplicates(docs(spark, [*rows, (None, "one"), (905, "one\ttwo\n")]), k).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute_groups(rows, k, 80)
    assert len(got) == len(rows)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_near_duplicates_equal_sql(spark):
    import duckdb

    r = random.Random(21)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(r.choice(words) for _ in range(40)) for _ in range(8)]
    rows = [(i, " ".join(w if r.random() > 0.02 else r.choice(words) for w in r.choice(base).split())) for i in range(120)] + [(500, None), (501, ""), (502, "One"), (503, "one"), (504, "a\x0bB"), (505, "a b")]
    pdf = docs(spark, rows).toPandas()  # noqa: F841
    con = duckdb.connect()
    con.execute("create view documents as select * from pdf")
    expected = con.execute(minhash_dedup.OP6_SQL).fetchall()
    got = [tuple(x) for x in minhash_dedup.near_duplicates(docs(spark, rows), 2).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(got) == sorted(expected)
    assert len({x[2] for x in got}) < len(rows) - 20


def test_near_duplicates_of_nothing(spark):
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(int(x) for x in m[0].split(".")) > 255 or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.mark.parametrize("alphabet", ["ab@@.-1234 +(_é", "0123456789 -+().", "4141 1111-@a."])
def test_base_spans(alphabet):
    r = random.Random(3)
    for _ in range(5000):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(80)))
        assert pii.base_spans(text) == brute_spans(text)


def test_disclosing_terms_are_found_and_masked(spark):
    r = random.Random(4)
    common = [f"{a}{b}word" for a in "abcdefgh" for b in "klmnop"]
    fill = lambda n: " ".join(r.choice(common) for _ in range(n))
    rows = [(i, f"{fill(30)} Zebrafish {fill(3)} zed@mail.org {fill(30)}") for i in range(6)] + [(100 + i, fill(60)) for i in range(60)]
    rows += [(500, None), (501, ""), (502, "call +1 (386) 555-3733"), (None, "x 10.0.0.1"), (502, "call +1 (386) 555-3733")]
    got = pii.find(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    assert all(by[i].n_email == 1 and by[i].n_term == 1 for i in range(6))
    assert all(by[100 + i].spans == "" for i in range(60))
    assert by[500].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[502].spans == "phone:5:22"
    clean = {x.doc_id: x for x in pii.stage(spark, docs(spark, rows), "").collect()}
    assert all("[EMAIL]" in clean[i].text and "ebrafish" not in clean[i].text for i in range(6))
    assert clean[502].text == "call [PHONE]"
    assert clean[502].n_chars == len("call [PHONE]")
    assert clean[500].text is None


def test_pack_and_unpack():
    for n, top in itertools.product((0, 1, 255, 256, 257, 3000), (1, 2, 49408, 2**31 - 1)):
        ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
        ids[: n // 20] = top - 1
        page = token_blocks.pack(ids)
        columns = [np.asarray(page[x]).astype(np.int64) for x in ("block_min", "block_width", "block_start", "exc_at", "exc_high")]
        assert (token_blocks.unpack(n, *columns, page["packed"]) == ids).all()


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_files.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    r = random.Random(5)
    parts = ["a", "b'", "s", " ", " <|endoftext|>", "<|startoftext|> ", "\t\n", "é", "é", "\x1c", "\xa0", "İ", "1.2", "don't", "LL "]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(40)))) for i in range(200)] + [(900, None), (901, ""), (902, "word " * 40000)]
    token_blocks.write_ids(docs(spark, rows), path, str(tmp_path / "t"))
    got = {x.doc_id: x for x in token_blocks.read_ids(spark, str(tmp_path / "t")).collect()}
    sums = {x.doc_id: x.ids_crc32 for x in token_blocks.read_ids(spark, str(tmp_path / "t"), digest=True).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids) == (start, len(ids), ids)
        assert sums[i] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    for i in (7, 901):
        one = token_blocks.read_ids(spark, str(tmp_path / "t"), doc_id=i).collect()
        assert [(x.doc_id, x.start, x.ids) for x in one] == [(i, got[i].start, got[i].ids)]
    token_blocks.write_ids(docs(spark, []), path, str(tmp_path / "none"))
    assert token_blocks.read_ids(spark, str(tmp_path / "none")).count() == 0


def brute_segment(p, text):
    text = f" {text}"
    best, back = [0.0], [None]
    ids = {s: i for i, s in enumerate(p.surface) if p.score[i] < 0}
    for end in range(1, len(text) + 1):
        options = []
        for start in range(max(0, end - p.longest), end):
            piece = text[start:end].encode()
            if piece in ids:
                options.append((best[start] + p.score[ids[piece]], start, [ids[piece]]))
            elif end - start == 1:
                options.append((best[start] + p.unknown, start, [int(p.byte_ids[b]) for b in piece]))
        best.append(max(o[0] for o in options))
        back.append(options)
    return best[-1]


def test_segmentation(spark):
    model = tokenizer_files.path("piece_bpe_32k.model")
    r = random.Random(6)
    parts = [*"abcdethe  \n▁éñ漢😀Z19", "the ", " of", "   ", "tion"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.choice([0, 1, 5, 40, 90])))) for i in range(200)] + [(900, None), (901, "a" * 3000), (902, "  "), (None, "x")]
    given = docs(spark, rows)
    p = sentencepiece_unigram.fit(given, model)
    single = set(p.byte_ids.tolist())
    # The scores are those of the pieces' shares in the segmentation of the round before.
    first = sentencepiece_unigram.fit(given, model, 1)
    p0 = sentencepiece_unigram.load(model)
    counts = {}
    for x in sentencepiece_unigram.encode_documents(given, model, "zipf").collect():
        for i in x.ids:
            counts[i] = counts.get(i, 0) + 1
    normal = [i for i in range(len(p0.score)) if p0.score[i] < 0]
    total = sum(counts.get(i, 0) + 0.5 for i in normal)
    assert all(first.score[i] == pytest.approx(math.log((counts.get(i, 0) + 0.5) / total)) for i in normal)
    assert sentencepiece_unigram.fit(docs(spark, []), model).score[normal] == pytest.approx(-math.log(len(normal)))
    for x in sentencepiece_unigram.encode_documents(given, model).collect():
        text = dict(rows)[x.doc_id] or ""
        assert x.decoded == text
        if text and len(text) < 100:
            raw = b"".join(p.surface[i] for i in x.ids if i in single)
            score = sum(p.score[i] for i in x.ids if i not in single) + p.unknown * len(raw.decode())
            assert score == pytest.approx(brute_segment(p, text))
        else:
            assert bool(x.ids) == bool(text)


def test_leaks(spark):
    r = random.Random(7)
    common, rare = [f"c{i}" for i in range(40)], [f"r{i}" for i in range(4000)]
    text = lambda n: " ".join(r.choice(common if r.random() < 0.5 else rare) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((15, 20, 30, 45, 60, 90))] + [(50, None), (51, "c1 c2 unique9"), (None, "c1")]
    clean = [(i, text(r.choice([5, 40, 300]))) for i in range(150)]
    leaks = [(1000 + i, f"{text(50)} {t} {text(70)}") for i, t in items[:6]] + [(1051, f"{text(30)} c1 c2 unique9 {text(9)}")]
    words = items[4][1].split()
    leaks.append((1100, f"{text(40)} {' '.join(w for j, w in enumerate(words) if j % 10 != 3)} {text(40)}"))
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    found = decontaminate.find_leaks(docs(spark, [*clean, *leaks, (2000, None), (2001, ""), (1000, leaks[0][1])]), bench).collect()
    assert {(x.doc_id, x.item_id) for x in found} == {(1000 + i, i) for i in range(6)} | {(1051, 51), (1100, 4)}
    assert decontaminate.find_leaks(docs(spark, clean), bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs(spark, []), bench).count() == 0


def test_lcs():
    r = random.Random(8)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.lcs(a, b) == table[-1][-1]


def test_quality_on_held_out_rows(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    good = lambda: " ".join(word() for _ in range(r.randrange(5, 200))).capitalize() + "."
    bad = lambda: r.choice([lambda: (word() + " ") * 60, lambda: " ".join(f"{word()}###$$" for _ in range(50)), lambda: good().upper() + "!!!"])()
    truth = {i: int(r.random() < 0.7) for i in range(600)}
    rows = [(i, good() if y else bad()) for i, y in truth.items()] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, y, 0) for i, y in truth.items()] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs(spark, [*rows, (0, rows[0][1])]), labels).collect()
    assert len(got) == len(rows) + 1
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    tested = [x for x in got if x.held_out and x.doc_id in truth]
    assert sum(x.predicted == truth[x.doc_id] for x in tested) / len(tested) > 0.95
    none = quality.quality_scores(docs(spark, rows), labels.where(F.col("quality") == 1)).collect()
    assert {x.score for x in none} == {0.5}


def test_frequent_items_amid_unique_words_are_found(spark):
    r = random.Random(12)
    fresh = (f"u{i}" for i in itertools.count())
    unique = lambda n: [next(fresh) for _ in range(n)]
    rare = [f"b{i}" for i in range(400)]
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in range(3, 31)}
    held = {}
    texts = []
    for d in range(300):
        # Each item stands in a third of the documents, at every offset to the windows.
        mine = [n for n in items if (d + n) % 3 == 0]
        words = []
        for n in mine:
            words += unique(24 + r.randrange(8)) + items[n]
        texts.append((d, " ".join([*words, *unique(24)])))
        held[d] = set(mine)
    others = [(100 + k, " ".join(r.sample(rare, 20))) for k in range(60)]
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()] + others, "item_id long, text string")
    got = {d: set() for d in held}
    for x in decontaminate.find_leaks(docs(spark, texts), benchmark).collect():
        got[x.doc_id].add(x.item_id)
    assert got == held


def test_changed_frequent_items_amid_unique_words_are_found(spark):
    r = random.Random(13)
    item = [f"w{k}" for k in range(20)]
    texts = []
    for d in range(90):
        words = [f"u{d}x{k}" for k in range(80)]
        if d % 3 == 0:
            changed = list(item)
            for k in r.sample(range(2, 20), 3):
                changed[k] = f"c{d}x{k}"
            start = r.randrange(30)
            words[start:start] = changed
        texts.append((d, " ".join(words)))
    got = decontaminate.find_leaks(docs(spark, texts), spark.createDataFrame([(1, " ".join(item), "w0 w1")], "item_id long, text string, answer string")).collect()
    assert {x.doc_id for x in got} == {d for d, _ in texts if d % 3 == 0}


def brute_held(item, words):
    """Whether a stretch of a document holds an item: in order 0.6 of its words, or 0.85 of 24 words of it in a row."""
    n = len(item)
    if n < 8:
        return any(words[i : i + n] == item for i in range(len(words) - n + 1))

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            now = [0]
            for j, y in enumerate(b):
                now.append(row[j] + 1 if x == y else max(row[j + 1], now[j]))
            row = now
        return row[-1]

    for start in range(0, max(1, len(words) - 23), 4):
        region = words[max(0, start - n) : start + 24 + n]
        if sum(w in region for w in item) >= 0.6 * n and common(item, region) >= 0.6 * n:
            return True
    return False


def test_paraphrases_are_found(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 100)
    r = random.Random(14)
    common, rare = [f"c{i}" for i in range(60)], [f"r{i}" for i in range(3000)]
    text = lambda n: [r.choice(common if r.random() < 0.5 else rare) for _ in range(n)]
    items = [(i, text(r.choice([15, 24, 37, 60]))) for i in range(80)]
    rows, truth = [], set()
    for i, words in items:
        for rate in (0.1, 0.22, 0.35):
            changed = []
            for w in words:
                u = r.random()
                if u >= rate * 0.55:
                    changed.append(r.choice(rare) if u < rate else w)
            rows.append((len(rows), text(r.randrange(60)) + changed + text(r.randrange(60))))
            if brute_held(words, rows[-1][1]):
                truth.add((len(rows) - 1, i))
    rows += [(len(rows) + k, text(150)) for k in range(100)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(docs(spark, [(i, " ".join(w)) for i, w in rows]), bench).collect()}
    assert len(truth) > 200
    assert got <= {(d, i) for d, i in truth} | {(d, d // 3) for d in range(240)}
    # The truth asks for no answer words, so a few of the most changed ones are left out.
    assert len(got & truth) >= 0.9 * len(truth)
    light = {(d, i) for d, i in truth if d % 3 < 2}
    assert len(got & light) >= 0.97 * len(light)


def test_very_long_items(spark):
    r = random.Random(15)
    words = [f"w{r.randrange(30000)}" for _ in range(30000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[1000:1400])), (3, " ".join(r.sample(words, 400)))]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "x" * 100000)], "item_id long, text string")
    got = decontaminate.find_leaks(docs(spark, [*rows, (4, "a " + "x" * 100000), (5, "x" * 99999)]), bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(1, 1), (2, 1), (4, 2)}


def test_discriminant_equals_brute_force(spark):
    """Scores from labelled statistics, by plain means, covariances and Gaussian densities."""
    r = np.random.default_rng(16)
    text = lambda good: " ".join(("abcdefgh"[r.integers(8)] * r.integers(1, 9)) + ("" if good or r.random() < 0.6 else "#|!7"[r.integers(4)]) for _ in range(r.integers(5, 120)))
    truth = {i: int(r.random() < 0.6) for i in range(300)}
    rows = [(i, text(y)) for i, y in truth.items()]
    given = docs(spark, rows)
    labels = spark.createDataFrame(list(truth.items()), "doc_id long, quality int")
    x = {z.doc_id: np.array(z.x) for z in quality.document_statistics(given).collect()}
    learn = {k: np.array([x[i] for i, y in truth.items() if y == k and zlib.crc32(str(i).encode()) % 5]) for k in (0, 1)}
    n = {k: len(v) for k, v in learn.items()}
    cov = {k: np.cov(v.T, bias=True) for k, v in learn.items()}
    pooled = np.diag(sum(n[k] * np.diag(cov[k]) for k in cov) / sum(n.values()))
    density = {}
    for k in (0, 1):
        s = max(0.15, len(quality.FEATURES) / (len(quality.FEATURES) + n[k]))
        c = (1 - s) * cov[k] + s * pooled + 4e-4 * np.eye(len(pooled))
        d = np.array([x[i] for i in truth]) - learn[k].mean(axis=0)
        density[k] = -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1]
    expected = density[1] - density[0]
    got = {z.doc_id: z for z in quality.quality_scores(given, labels).collect()}
    model = quality.fit(quality.document_statistics(given), labels)
    for i, e in zip(truth, expected, strict=True):
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-(model.slope * min(max(e, -100), 100) + model.shift))), abs=2e-3)
    again = {z.doc_id: z.score for z in quality.quality_scores(given.repartition(7), labels.repartition(3)).collect()}
    assert again == {i: z.score for i, z in got.items()}


def brute_find(rows):
    """All spans of each row, by counting every context and every word."""
    marks = [chr(c) for c in [*range(128), *range(0x80, 0xC0), *range(0x2000, 0x2080), *range(0x3000, 0x3040)] if not (c < 128 and chr(c).isalnum())]

    def stripped(text, a, b):
        while a < b and text[a] in marks:
            a += 1
        while a < b and text[b - 1] in marks:
            b -= 1
        return a, b

    def term(text, a, b):
        a, b = stripped(text, a, b)
        word = text[a:b].translate(AZ)
        if brute_spans(text[a:b]):
            return ""
        return f"long {word}" if len(word) > 64 else word if sum(c.isalpha() for c in word) >= 3 else ""

    total, occurrences, around, own = 0, {}, {}, []
    for _, text in rows:
        text = text or ""
        words = [m.span() for m in WORD.finditer(text)]
        total += len(words)
        for a, b in words:
            x, y = stripped(text, a, b)
            w = text[x:y].translate(AZ)
            occurrences[f"long {w}" if len(w) > 64 else w] = occurrences.get(f"long {w}" if len(w) > 64 else w, 0) + 1
        found = brute_spans(text)
        mine, pieces_ = {}, set(words)
        for start, kind, end in found:
            before = [(a, b) for a, b in words if a < start][-10:]
            if before and before[-1][1] > start:
                before[-1] = (max([before[-1][0], *(z for _, _, z in found if z <= start)]), start)
            after = [(a, b) for a, b in words if a >= end]
            inside = [b for a, b in words if a < end < b]
            if inside:
                after = [(end, min([inside[0], *(x for x, _, _ in found if x >= end)])), *after]
            near = [x for x in before + after[:10] if x[0] < x[1]]
            pieces_.update(x for x in before[-1:] + after[:1] if x[0] < x[1])
            near = [x for x in near if not brute_spans(text[x[0] : x[1]])]
            context = tuple(text[a:b] for a, b in near)
            value = re.sub("[^0-9]", "", text[start:end]) if kind > 1 else text[start:end].lower()
            for entity in ((kind, value), kind):
                for t in {term(text, a, b) for a, b in near} - {""}:
                    around.setdefault(entity, {}).setdefault(t, set()).add(context)
                    mine.setdefault(t, set()).add(entity)
                around.setdefault(entity, {}).setdefault("", set()).add(context)
        own.append((text, found, mine, pieces_))
    out = []
    for text, found, mine, pieces_ in own:
        spans = [(a, list(KINDS)[k], b) for a, k, b in found]
        for t, entities in mine.items():
            worst = 0
            for e in entities:
                n_te, n_e = len(around[e][t]), len(around[e][""])
                if n_te >= 2:
                    n_t = max(n_te, occurrences.get(t, 0))
                    worst = max(worst, math.log(n_te * total / (n_t * n_e)) / math.log((total + 1) / n_e))
            if worst >= 0.85:
                spans += [(*stripped(text, a, b)[:1], "term", stripped(text, a, b)[1]) for a, b in pieces_ if term(text, a, b) == t]
        order = [*KINDS, "term"]
        out.append(",".join(f"{k}:{a}:{b}" for a, k, b in sorted(set(spans), key=lambda z: (z[0], order.index(z[1]), z[2]))))
    return out


def test_disclosures_equal_brute_force(spark):
    r = random.Random(17)
    common = [f"{a}{b}word" for a in "abcdefgh" for b in "klmnop"]
    marked = lambda w: r.choice(["", "", "«", "(", "“", "...", "—"]) + w + r.choice(["", "", "»", ").", "”,", "!!!!!", "…"])
    fill = lambda n: [marked(r.choice(common)) for _ in range(n)]
    entities = ["zed@mail.org", "10.1.2.3", "+1 (386) 555-3733", "4111 1111 1111 1111", "amy@b.example.net", "8.8.8.8"]
    rows = []
    for i in range(150):
        words = fill(r.randrange(40))
        for _ in range(r.choice([0, 0, 1, 1, 3])):
            k = r.randrange(len(entities))
            clue = f"clue{'abcdef'[k]}x" if r.random() < 0.6 else "y" * 70 + "abcdef"[k] if r.random() < 0.2 else r.choice(common)
            joined = r.choice([" ", " ", ";", "="])
            words += [*fill(r.randrange(4)), marked(clue) + joined + entities[k], *fill(r.randrange(4)), *([f"Clue{'abcdef'[k]}x"] if r.random() < 0.3 else [])]
        rows.append((i, " ".join(words + fill(r.randrange(30)))))
    rows += [(None, rows[5][1]), (None, None), (900, ""), (5, rows[5][1]), (901, "a" * 5000 + " me@x.org;" * 300), (902, "cluea" + "x" * 300 + "@mail.org")]
    expected = brute_find(rows)
    got = [(x.doc_id, x.spans, x.n_term) for x in pii.find(docs(spark, rows)).collect()]
    assert sorted((str(i), s, s.count("term:")) for i, s, _ in got) == sorted((str(i), s, s.count("term:")) for (i, _), s in zip(rows, expected, strict=True))
    assert all(n == s.count("term:") for _, s, n in got)
    assert sum(n for _, _, n in got) > 50
    # A row without an id keeps its terms.
    assert any(i is None and n for i, _, n in got) == any("term:" in s for (i, _), s in zip(rows, expected, strict=True) if i is None)
