"""Personal data: base patterns, and terms that give protected entities away.

Base findings are e-mail and IP addresses, payment cards and phone numbers.  Each found value is a protected entity, and so
is each kind as a class.  A term's disclosure of an entity is measured on the corpus as in information-theoretic
sanitisation (Sánchez and Batet):

    disclosure(t, e) = PMI(t; e) / IC(e) = log(n_te N / (n_t n_e)) / log(N / n_e)

n_te counts the distinct contexts (WINDOW words to either side) of e that hold t, n_e the distinct contexts of e, n_t the
occurrences of t in the corpus and N all words of the corpus.  Contexts count once however often they are copied.  The
measure is 1 for a term that stands nowhere but beside e, and falls with the share of its uses that don't.  A term of an
entity's context that reaches GENERALISE in at least SUPPORT contexts is generalised wherever that document uses it; one
that reaches REMOVE is removed.

A term is a word without the marks at its ends, A-Z lower-cased; it has three letters or more.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from favora.functions.tables import store
from favora.llm.shared import pieces, read, word_hashes, word_spans

KINDS = ("email", "ip", "card", "phone")
WINDOW = 10
SUPPORT = 2
GENERALISE = 0.85
REMOVE = 0.95
#: Words of the corpus are counted if they fall on a set bit of a filter of this many bits, whatever the number of terms.
FILTER_BITS = 1 << 23
#: Sums that a task holds at once.
MOST_COUNTED = 1 << 20
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^ \t-\r]+")
#: ASCII marks, U+0080 to U+00BF, general punctuation and CJK punctuation; in UTF-8 they follow from the first two bytes.
_MARKS = "".join(chr(c) for c in (*range(128), *range(0x80, 0xC0), *range(0x2000, 0x2080), *range(0x3000, 0x3040)) if not (c < 128 and chr(c).isalnum()))
#: Longer terms are stood for by a digest.
LONGEST = 64
#: Parts of a hot entity's terms that are joined apart.
SALTS = 32
_AZ = {c: c + 32 for c in range(65, 91)}
_NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at)
        start = at
        # The local part is the run of its characters before the @, back to the end of the last address.
        while found and start > done and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            start -= 1
        if found and start < at:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in m.group().split("."))):
            yield m.span()


def _luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, in order."""
    return sorted((a, k, b) for k, find in enumerate((_emails, _ips, _cards, _phones)) for a, b in find(text))


def _term(word: str) -> str:
    """The term that a word stands for; empty for words of less than three letters."""
    term = word.strip(_MARKS).translate(_AZ)
    if len(term) > LONGEST:
        return "#" + hashlib.blake2b(term.encode(), digest_size=16).hexdigest()
    return term if sum(map(str.isalpha, term)) >= 3 else ""


def term_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of the terms of words: without the marks at their ends; empty where nothing else is left."""
    padded = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(3, np.uint8)])
    ascii_ = np.ones(256, bool)
    ascii_[128:] = False
    ascii_[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False

    def mark(at: np.ndarray) -> np.ndarray:
        """Bytes of the mark that starts at each place; 0 for none."""
        one, two = padded[at + 3], padded[at + 4]
        return np.where(ascii_[one], 1, np.where(one == 0xC2, 2, np.where((one == 0xE2) & ((two == 0x80) | (two == 0x81)) | (one == 0xE3) & (two == 0x80), 3, 0)))

    starts, ends = starts.copy(), ends.copy()
    live = np.arange(len(starts))
    while len(live):
        n = mark(starts[live])
        starts[live] = np.minimum(starts[live] + n, ends[live])
        live = live[(n > 0) & (starts[live] < ends[live])]
    live = np.flatnonzero(starts < ends)
    while len(live):
        at = ends[live]
        n = np.zeros(len(live), np.int64)
        for back in (3, 2, 1):
            n = np.where((n == 0) & (at - back >= starts[live]) & (mark(at - back) == back), back, n)
        ends[live] = at - n
        live = live[(n > 0) & (ends[live] > starts[live])]
    return starts, ends


_FOUND = "doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, starts array<int>, kinds array<int>, ends array<int>, contexts array<struct<entity:string,kind:string,context:long,terms:array<struct<term:string,h:long>>>>, uses array<struct<term:string,start:int,end:int>>, n_words long"
_TERM = pa.struct([("term", pa.string()), ("h", pa.int64())])
_CONTEXT = pa.struct([("entity", pa.string()), ("kind", pa.string()), ("context", pa.int64()), ("terms", pa.list_(_TERM))])
_USE = pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _hashes(terms: list[str]) -> list[int]:
    """word_hashes of the terms as 64-bit integers."""
    data = [x.encode() for x in terms]
    ends = np.cumsum([len(x) + 1 for x in data], dtype=np.int64) - 1
    return word_hashes(np.frombuffer(b" ".join(data), np.uint8), ends - [len(x) for x in data], ends).view(np.int64).tolist() if data else []


def _contexts(text: str, found: list[tuple[int, int, int]]) -> tuple[list[dict], list[dict]]:
    """Of each finding its entity, a key of the words around it and their terms, and all uses of these terms in the text.

    Findings cut the words that they stand in, and the words of findings don't count.
    """
    words = [m.span() for m in _WORD.finditer(text)]
    heads = [a for a, _ in words]
    cuts = [0, *sorted(b for _, _, b in found)]
    nexts = sorted(a for a, _, _ in found) + [len(text)]
    bare: dict[str, str] = {}
    out, sought, parts = [], set(), set()

    def term(word: str) -> str:
        if word not in bare:
            bare[word] = "" if base_spans(word) else _term(word)
        return bare[word]

    for start, kind, end in found:
        at = bisect.bisect_left(heads, start)
        # What stands in the same word before and after the finding, up to the next finding on either side.
        before = [(max(a, cuts[bisect.bisect_right(cuts, start) - 1]) if b > start else a, min(b, start)) for a, b in words[max(0, at - WINDOW) : at]]
        to = bisect.bisect_right(heads, end - 1)
        after = [(end, min(words[to - 1][1], max(end, nexts[bisect.bisect_left(nexts, end)])))] if to and words[to - 1][1] > end else []
        after += words[to : to + WINDOW - len(after)]
        said = [text[a:b] for a, b in before + after if a < b]
        parts.update(x for x in before[-1:] + after[:1] if x[0] < x[1])
        kept = [(w, t) for w in said if (t := term(w)) or not base_spans(w)]
        key = int.from_bytes(hashlib.blake2b("\n".join(w for w, _ in kept).encode(), digest_size=8).digest(), "little", signed=True)
        terms = sorted({t for _, t in kept if t})
        sought.update(terms)
        value = text[start:end].lower() if kind == 0 else text[start:end] if kind == 1 else _NOT_DIGIT.sub("", text[start:end])
        out.append({"entity": f"{KINDS[kind]}:{value}", "kind": KINDS[kind], "context": key, "terms": terms})
    uses = []
    for a, b in sorted(parts.union(words)):
        if (t := term(text[a:b])) and t in sought:
            word = text[a:b]
            a += len(word) - len(word.lstrip(_MARKS))
            uses.append({"term": t, "start": a, "end": a + len(word.strip(_MARKS))})
    return out, uses


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), *((x, pa.list_(pa.int32())) for x in ("starts", "kinds", "ends")), ("contexts", pa.list_(_CONTEXT)), ("uses", pa.list_(_USE)), ("n_words", pa.int64())])
    for rows, data, offsets in pieces(batches, 2):
        out = []
        words = np.diff(word_spans(data, offsets)[2]).tolist()
        for text, n in zip(rows.column(2).to_pylist(), words, strict=True):
            found = base_spans(text or "")
            said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)
            counts = [sum(k == x for _, k, _ in found) for x in range(4)]
            contexts, uses = _contexts(text, found) if found else ([], [])
            out.append((*counts, hashlib.sha256(said.encode()).hexdigest(), [a for a, _, _ in found], [k for _, k, _ in found], [b for _, _, b in found], contexts, uses, n))
        every = sorted({t for row in out for c in row[8] for t in c["terms"]})
        of = dict(zip(every, _hashes(every), strict=True))
        for row in out:
            for c in row[8]:
                c["terms"] = [{"term": t, "h": of[t]} for t in c["terms"]]
        columns = [rows.column(0), rows.column(1), *(list(c) for c in zip(*out, strict=True))]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _sums(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(h, n): how often each task's texts hold the terms whose hash is on the filter.

    Most terms stand in the texts of every task, so the sums are as many as terms and tasks: the tasks follow the cluster, as
    tasks that follow the input would make them grow with the product of both.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(sent.value).astype(bool)
        keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]

        def added() -> tuple[np.ndarray, np.ndarray]:
            one, of = np.unique(np.concatenate(keys), return_inverse=True)
            return one, np.bincount(of, weights=np.concatenate(counts), minlength=len(one)).astype(np.int64)

        for _, data, offsets in pieces(batches, 0):
            words, ends, _ = word_spans(data, offsets)
            starts, ends = term_spans(data, words, ends)
            starts, ends = starts[starts < ends], ends[starts < ends]
            h = word_hashes(data, starts, ends)
            # Long terms go by their digests.
            long = np.flatnonzero(ends - starts > LONGEST)
            h[long] = np.array(_hashes([_term(data[starts[i] : ends[i]].tobytes().decode()) or " " for i in long.tolist()]), np.int64).view(np.uint64)
            h = h[known[(h % np.uint64(FILTER_BITS)).astype(np.int64)]]
            one, n = np.unique(h, return_counts=True)
            keys.append(one)
            counts.append(n)
            if sum(map(len, keys)) > MOST_COUNTED:
                one, n = added()
                # Sums of few terms stay, as they come again; those of many go on.
                if len(one) > MOST_COUNTED // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(n)], names=["h", "n"])
                    one, n = one[:0], n[:0]
                keys, counts = [one], [n]
        one, n = added()
        yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(n)], names=["h", "n"])

    few = docs.select("text").coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)
    return few.mapInArrow(task, "h long, n long")


def _occurrences(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(h, n): how often the corpus holds the terms whose hash is on the filter; each task adds up its own first."""
    return _sums(docs, bits).groupBy("h").agg(F.sum("n").alias("n"))


def disclosing_terms(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(entity, term, disclosure) of the terms that reach GENERALISE; an entity is a value, or a kind as a class."""
    seen = found.select(F.explode("contexts").alias("c")).select(F.explode(F.array("c.entity", "c.kind")).alias("entity"), "c.context", "c.terms")
    n_e = store(seen.select("entity", "context").distinct().groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= SUPPORT), "entities")
    pairs = seen.select("entity", "context", F.explode("terms").alias("t")).select("entity", "context", "t.term", "t.h").distinct()
    pairs = store(pairs.groupBy("entity", "term", "h").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= SUPPORT), "pairs")
    # The filter has FILTER_BITS bits at any size of the corpus; what passes by accident goes in the join below.
    marked = pairs.select(F.expr(f"cast(pmod(h, {FILTER_BITS}) as int)").alias("bit")).groupBy(F.expr("bit div 8").alias("byte")).agg(F.expr("cast(bit_or(shiftright(128, bit % 8)) as int)").alias("v")).toArrow()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    bits[marked.column("byte").to_numpy()] = marked.column("v").to_numpy()
    if not bits.any():
        return pairs.select("entity", "term", F.lit(0.0).alias("disclosure"))
    total = found.agg(F.sum("n_words")).first()[0]
    # The classes are few, and hot; the values are joined.
    classes = {r.entity: r.n_e for r in n_e.where(F.col("entity").isin(*KINDS)).collect()}
    of_class = F.create_map(*(F.lit(x) for k, n in classes.items() for x in (k, n))) if classes else F.lit(None).cast("map<string,bigint>")
    counted = store(pairs.join(_occurrences(docs, bits), "h", "left").withColumn("n", F.greatest(F.coalesce("n", F.lit(0)), "n_te")), "counted")
    told = counted.where(F.col("entity").isin(*KINDS)).withColumn("n_e", F.try_element_at(of_class, F.col("entity")))
    told = told.unionByName(counted.where(~F.col("entity").isin(*KINDS)).join(n_e, "entity"))
    value = F.log(F.col("n_te") * F.lit(float(total)) / (F.col("n") * F.col("n_e"))) / F.log(F.lit(float(total) + 1) / F.col("n_e"))
    return told.select("entity", "term", value.alias("disclosure")).where(F.col("disclosure") >= GENERALISE)


def _told(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, text_key, told): the spans of each document's disclosing terms, for documents that have some.

    Each document asks for the terms of its own contexts, so a join brings no more rows than there are such terms; those of
    an entity and term that many documents share are dealt to SALTS parts.
    """
    rows = found.where(F.size("contexts") > 0).select("doc_id", "text_key", "contexts")
    asked = rows.select("doc_id", "text_key", F.explode("contexts").alias("c")).select("doc_id", "text_key", "c.entity", "c.kind", F.explode("c.terms").alias("t")).select("doc_id", "text_key", F.explode(F.array("entity", "kind")).alias("entity"), "t.term")
    asked = asked.distinct().withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)))
    every = terms.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    mine = asked.join(every, ["entity", "term", "salt"]).groupBy("doc_id", "text_key", "term").agg(F.max("disclosure").alias("disclosure"))
    mine = mine.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("term", (F.col("disclosure") >= REMOVE).alias("removed"))).alias("terms"))
    one = found.where(F.size("uses") > 0).select("doc_id", "text_key", "uses").dropDuplicates(["doc_id", "text_key"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for uses, terms in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                removed = {t["term"]: t["removed"] for t in terms}
                spans.append([{"start": u["start"], "end": u["end"], "removed": removed[u["term"]]} for u in uses if u["term"] in removed])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("removed", pa.bool_())])))], names=["doc_id", "text_key", "told"])

    both = _alike(one, mine, "inner").select("doc_id", "text_key", "uses", "terms")
    return both.mapInArrow(task, "doc_id long, text_key long, told array<struct<start:int,end:int,removed:boolean>>")


def _alike(one: DataFrame, two: DataFrame, how: str) -> DataFrame:
    """Both joined by doc_id, which may be null, and text_key."""
    two = two.withColumnRenamed("doc_id", "_doc_id").withColumnRenamed("text_key", "_text_key")
    return one.join(two, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key")), how).drop("_doc_id", "_text_key")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))


def find(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs`: the counts and digest of its base findings, and the spans of all.

    Null texts count as empty: no findings, the digest of the empty string.  Rows may repeat and ids may be null; columns
    other than doc_id and text are not read.
    """
    found = store(_keyed(docs).mapInArrow(_detect, _FOUND), "findings")
    told = _told(found, store(disclosing_terms(found, docs), "terms"))
    base = F.expr("transform(starts, (a, i) -> named_struct('start', a, 'rank', kinds[i], 'end', ends[i]))")
    more = F.expr("transform(coalesce(told, array()), x -> named_struct('start', x.start, 'rank', if(x.removed, 5, 4), 'end', x.end))")
    out = _alike(found, told, "left").withColumn("all", F.array_sort(F.concat(base, more)))
    names = "array('email', 'ip', 'card', 'phone', 'term', 'term')"
    spans = F.expr(f"array_join(transform(all, x -> concat({names}[x.rank], ':', x.start, ':', x.end)), ',')")
    return out.select("doc_id", "text_key", *(f"n_{k}" for k in KINDS), "base_sha256", spans.alias("spans"), F.size(F.coalesce("told", F.array())).cast("long").alias("n_term"), F.col("all").alias("found"))


def sanitised(text: str = "text", found: str = "found") -> Column:
    """`text` with the spans in the column of find() replaced: base kinds and generalised terms by a label, others by nothing."""
    labels = "array('[EMAIL]', '[IP]', '[CARD]', '[PHONE]', '[TERM]', '')"
    # Spans may overlap: what an earlier one covers isn't replaced again.
    step = f"concat(s.out, if(x.start > s.at, substring({text}, s.at + 1, x.start - s.at), ''), if(x.start >= s.at, {labels}[x.rank], ''))"
    return F.expr(f"aggregate({found}, named_struct('out', '', 'at', 0), (s, x) -> if(x.end <= s.at, s, named_struct('out', {step}, 'at', x.end)), s -> concat(s.out, substring({text}, s.at + 1)))")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: all `documents`."""
    return find(read(spark, sf_dir, "documents")).drop("text_key", "found")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: findings are replaced in the text, and n_chars follows; all documents stay.

    That holds for rows without a doc_id and for rows that share one too; null texts stay null.
    """
    dirty = find(docs).where(F.size("found") > 0).select(F.col("doc_id").alias("_pii_id"), F.col("text_key").alias("_pii_key"), F.col("found").alias("_pii_found")).dropDuplicates(["_pii_id", "_pii_key"])
    both = docs.join(dirty, F.col("doc_id").cast("long").eqNullSafe(F.col("_pii_id")) & (F.xxhash64("text") == F.col("_pii_key")), "left")
    clean = both.withColumn("text", F.when(F.col("_pii_found").isNotNull(), sanitised("text", "_pii_found")).otherwise(F.col("text")))
    return (clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean).select(docs.columns)
