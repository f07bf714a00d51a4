"""Languages of web pages by Bayesian evidence fusion.

log P(l | page) = log-likelihood of the visible text + log P(declared markup language | l) + log P(address suffix | l)
                  + log prior of the host

The text model is a multinomial over hashed byte trigrams of each language, learned from all labelled documents.  The
other three come from grouped sums of the pages' text posteriors: reliability of declarations, suffixes (the host's last
label) with add-one smoothing, and host priors that are smoothed towards those of the domain (the host's last two labels),
and those towards all pages.  A page's own posterior is taken out of its host's and domain's sums.  A page without a host
takes the prior of all pages.

Hosts, domains and suffixes of more than a HOT-th of the pages, fewer than HOT of each, are sent to the tasks; the others
are joined, so that no key of a join has more than that share of the rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from favora.functions.tables import store
from favora.llm.shared import pieces, read
from favora.llm.url_filter import host_and_path

BUCKETS = 1 << 16
MOST_LANGUAGES = 200
#: Trigrams of a text aren't independent; it counts as this many at most.
EFFECTIVE = 60
HOST_STRENGTH = 5.0
HOT = 500
_LETTER = np.arange(256, dtype=np.uint32)
_LETTER[:65] = 32
_LETTER[65:91] += 32
_LETTER[91:97] = 32
_LETTER[123:128] = 32
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)", re.DOTALL | re.IGNORECASE)
_TAG = re.compile(r"<[^>]*>?")


def visible(html: str | None) -> str:
    """The text of a page: without comments, scripts, styles and tags."""
    return _TAG.sub(" ", _HIDDEN.sub(" ", html or ""))


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each byte trigram, and the document it stands in; runs without letters don't count."""
    c = _LETTER[data]
    if len(c) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = ((c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1]) * np.uint32(0x85EBCA6B) ^ c[2:]) * np.uint32(0xC2B2AE35) >> np.uint32(16)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    good = (doc[:-2] == doc[2:]) & ((c[:-2] != 32) | (c[1:-1] != 32)) & ((c[1:-1] != 32) | (c[2:] != 32))
    return code[good].astype(np.int64), doc[:-2][good]


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages in `labelled` (text, lang), and log P(bucket | language), add-one smoothed."""
    languages = sorted(r.lang for r in labelled.where("lang is not null").select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    number = {x: i for i, x in enumerate(languages)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(number) * BUCKETS, np.int64)
        for rows, data, offsets in pieces(batches, 0):
            of = np.array([number[x] for x in rows.column(1).to_pylist()], np.int64)
            code, doc = trigrams(data, offsets)
            total += np.bincount(of[doc] * BUCKETS + code, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["at", "n"])

    counts = np.ones(len(languages) * BUCKETS)
    sums = labelled.where("lang is not null").select("text", "lang").mapInArrow(task, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    # A number for each language and bucket.
    for batch in sums.toArrow().to_batches():
        counts[batch.column(0).to_numpy()] += batch.column(1).to_numpy()
    counts = counts.reshape(-1, BUCKETS)
    return languages, (np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))).astype(np.float32)


def _text_evidence(pages: DataFrame, model: np.ndarray) -> DataFrame:
    """`pages` with `e`, the log-likelihood of each language, less that of the likeliest."""
    sent = pages.sparkSession.sparkContext.broadcast(model)
    names = pages.columns
    at = names.index("html")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in pieces([batch], at):
                texts = pa.array([visible(x) for x in rows.column(at).to_pylist()], pa.large_string())
                _, data, offsets = next(pieces([pa.RecordBatch.from_arrays([texts], names=["t"])], 0, 1 << 62))
                code, doc = trigrams(data, offsets)
                n = np.bincount(doc, minlength=len(texts))
                e = np.array([np.bincount(doc, weights=row[code], minlength=len(texts)) for row in sent.value]).T
                e = e * (np.minimum(n, EFFECTIVE) / np.maximum(n, 1))[:, None]
                e -= e.max(axis=1, keepdims=True)
                column = pa.FixedSizeListArray.from_arrays(pa.array(e.ravel()), e.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([c for j, c in enumerate(rows.columns) if j != at] + [column], names=[c for c in names if c != "html"] + ["e"])

    kept = ", ".join(f"{c} {t}" for c, t in pages.dtypes if c != "html")
    return pages.mapInArrow(task, f"{kept}, e array<double>")


def _softmax(e: str) -> Column:
    return F.expr(f"transform({e}, x -> exp(x - array_max({e})) / aggregate(transform({e}, y -> exp(y - array_max({e}))), 0D, (s, y) -> s + y))")


def _joined(rows: DataFrame, sums: DataFrame, key: str, total: int) -> DataFrame:
    """`rows` with the columns of `sums` (key, n, more) but n, by the key; null for an empty key."""
    more = [c for c in sums.columns if c not in (key, "n")]
    hot = sums.where(F.col("n") * HOT > total).select(F.col(key).alias("_key"), *(F.col(c).alias(f"_hot_{c}") for c in more))
    rows = rows.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left")
    # Rows that have found theirs, or ask for nothing, are dealt at random; no host holds a slash.
    asked = F.when((F.col(key) == "") | F.col("_key").isNotNull(), F.concat(F.lit("/"), F.xxhash64("page_id", "row").cast("string"))).otherwise(F.col(key))
    cold = sums.where(F.col("n") * HOT <= total).select(F.col(key).alias("_asked"), *(F.col(c).alias(f"_cold_{c}") for c in more))
    rows = rows.withColumn("_ask", asked).drop("_key").join(cold, F.col("_ask") == F.col("_asked"), "left")
    for c in more:
        rows = rows.withColumn(c, F.coalesce(f"_hot_{c}", f"_cold_{c}"))
    return rows.drop("_ask", "_asked", *(f"_{x}_{c}" for x in ("hot", "cold") for c in more))


def identify(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row for each row of `pages` (page_id, url, html): lang, confidence, text_lang, declared, host.

    Missing evidence counts for nothing: null or empty pages have no text, null addresses neither host, domain nor suffix.
    Of equal posteriors the first language in order wins.  Without labelled documents lang is null.  Other columns are not
    read.
    """
    languages, model = learn(labelled)
    host, _ = host_and_path(F.col("url"))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]+)", 1))
    given = pages.select("page_id", host.alias("host"), declared.alias("declared"), "html")
    given = given.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    if not languages:
        none = F.lit(None).cast("string")
        return given.select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("text_lang"), "declared", "host")
    found = store(_text_evidence(given, model).withColumn("p", _softmax("e")).withColumn("row", F.monotonically_increasing_id()), "evidence")
    k = len(languages)
    summed = [F.sum(F.get("p", F.lit(i))).alias(f"s{i}") for i in range(k)]
    array = F.array(*(F.col(f"s{i}") for i in range(k)))

    def sums(key: str) -> DataFrame:
        named = found.where(F.col(key) != "").groupBy(key).agg(F.count("*").alias("n"), *summed)
        return store(named.select(key, "n", array.alias(f"by_{key}")), f"by-{key}")

    total_row = found.agg(F.count("*").alias("n"), *summed).first()
    every = [(total_row[f"s{i}"] or 0.0) + 1.0 for i in range(k)]
    prior = F.array(*(F.lit(x / sum(every)) for x in every))
    total = F.array(*(F.lit(x) for x in every))
    # Declarations of a language count by how often they are right, others for nothing.
    right = found.where(F.col("declared").isin(languages)).groupBy("declared").agg(*summed).collect()
    table = np.ones((k, k)) + 8 * np.eye(k)
    for r in right:
        table[:, languages.index(r.declared)] += [r[f"s{i}"] for i in range(k)]
    table = np.log(table / table.sum(axis=1, keepdims=True))
    said = F.create_map(*(x for j, name in enumerate(languages) for x in (F.lit(name), F.array(*(F.lit(float(v)) for v in table[:, j])))))
    joined, suffixes = found, sums("suffix")
    kinds = suffixes.count()
    for key, of in (("host", sums("host")), ("domain", sums("domain")), ("suffix", suffixes)):
        joined = _joined(joined, of, key, total_row.n)
    joined = joined.withColumn("prior", prior).withColumn("total", total).withColumn("said", F.try_element_at(said, F.col("declared")))
    fused = F.expr(f"""transform(e, (x, i) -> x + coalesce(said[i], 0D) + if(host = '', ln(prior[i]),
        if(suffix = '', 0D, ln((greatest(by_suffix[i] - p[i], 0D) + 1) / (total[i] + {kinds})))
        + ln((greatest(by_host[i] - p[i], 0D) + {HOST_STRENGTH} * (if(domain = '', 0D, greatest(by_domain[i] - p[i], 0D)) + {HOST_STRENGTH} * prior[i]) / (if(domain = '', 0D, greatest(aggregate(by_domain, 0D, (s, y) -> s + y) - 1, 0D)) + {HOST_STRENGTH}))
             / (greatest(aggregate(by_host, 0D, (s, y) -> s + y) - 1, 0D) + {HOST_STRENGTH}))))""")
    out = joined.withColumn("f", fused).withColumn("q", _softmax("f"))
    names = F.array(*(F.lit(x) for x in languages))
    top = lambda p: F.get(names, (F.array_position(p, F.array_max(p)) - 1).cast("int"))
    return out.select("page_id", top("q").alias("lang"), F.array_max("q").alias("confidence"), top("p").alias("text_lang"), "declared", "host")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: all `pages`, with the languages of `documents`."""
    return identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))
