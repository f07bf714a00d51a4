"""URL verdicts from rules, and from a character language-model ratio for URLs that no rule fits.

URLs that a rule accepts or rejects are the two training classes.  For each class a variable-order Markov model over an
alphabet of 32 symbols is smoothed by Witten-Bell interpolation from order ORDER down to order 0.  Both models become one
table of log-likelihood ratios, whose size is fixed by the alphabet (32 ** (ORDER + 1) rows), so it can be sent to all
tasks; only one row for each URL is shuffled.  The mean ratio over a URL's symbols is compared with a threshold calibrated on a fifth of
the classes' URLs, which the models don't learn from.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from favora.functions.tables import store
from favora.llm.shared import read

#: (verdict, host, path): a rule fits its host and all subdomains, if the URL's path starts with its path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MOST_RULES = 1000
#: Symbol 0 stands for both ends, 31 for all characters not listed; digits are one symbol.
ALPHABET = "^abcdefghijklmnopqrstuvwxyz0/.-"
SYMBOLS = 32
ORDER = 3
DIGITS = 6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, by host, then by path: STRUCT<hosts, paths, rule, verdict>, or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    given = F.array(*(F.struct(F.lit(len(h)).alias("hosts"), F.lit(len(p)).alias("paths"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("h"), F.lit(p).alias("p")) for v, h, p in rules))
    return F.array_max(F.filter(given, lambda r: ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"]))) & F.startswith(path, r["p"])))


def symbols(url: Column) -> Column:
    """The symbols of a whole URL, with its query and fragment, between ORDER start symbols and an end symbol."""
    lowered = F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER)
    text = F.regexp_replace(F.regexp_replace(lowered, "[0-9]", "0"), "[^a-z0/.-]", "?")
    padded = F.split(F.concat(F.lit("^" * ORDER), text, F.lit("^")), "")
    # An empty string at the end is no character.
    return F.transform(F.filter(padded, lambda c: c != ""), lambda c: F.when(c == "?", SYMBOLS - 1).otherwise(F.instr(F.lit(ALPHABET), c) - 1))


def grams(codes: Column) -> Column:
    """The runs of ORDER + 1 symbols, each as one number; `codes` should be a column, as it is read at every place."""
    number = lambda i: sum((F.get(codes, i + j) * SYMBOLS ** (ORDER - j) for j in range(1, ORDER + 1)), F.get(codes, i) * SYMBOLS**ORDER)
    return F.transform(F.sequence(F.lit(0), F.size(codes) - ORDER - 1), number)


def ratios(counts: DataFrame) -> DataFrame:
    """(code, v): log-likelihood ratio of each run of symbols, for `counts` (code, a, b) of the two classes."""
    spark = counts.sparkSession
    p = None
    for n in range(ORDER + 1):
        size = SYMBOLS ** (n + 1)
        seen = counts.groupBy((F.col("code") % size).alias("code")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        context = F.floor(F.col("code") / SYMBOLS).alias("context")
        totals = seen.groupBy(context).agg(*(x for k in "ab" for x in (F.sum(k).alias(f"n{k}"), F.count_if(F.col(k) > 0).alias(f"t{k}"))))
        grid = spark.range(size).withColumnRenamed("id", "code").join(seen, "code", "left").withColumn("context", context).join(totals, "context", "left")
        below = (lambda k: F.lit(1.0 / SYMBOLS)) if p is None else (lambda k: F.col(f"below_{k}"))
        if p is not None:
            grid = grid.withColumn("shorter", F.col("code") % (size // SYMBOLS)).join(p.select(F.col("code").alias("shorter"), F.col("pa").alias("below_a"), F.col("pb").alias("below_b")), "shorter")
        none = F.lit(0)
        smooth = lambda k, below=below: F.when(F.coalesce(f"n{k}", none) == 0, below(k)).otherwise((F.coalesce(k, none) + F.col(f"t{k}") * below(k)) / (F.col(f"n{k}") + F.col(f"t{k}")))
        p = grid.select("code", smooth("a").alias("pa"), smooth("b").alias("pb"))
    return p.select("code", (F.log("pa") - F.log("pb")).alias("v"))


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """One row for each row of `pages`: page_id, host, path, rule, verdict and score (the mean log ratio of the whole URL).

    Of a URL without `://` host and path are empty, and the method judges all of it; a null one counts as empty.  Where a class
    has no URL every score is 0 and the threshold too, and the verdict `allow`.  Other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"), symbols(F.col("url")).alias("codes"))
    ruled = named.withColumn("r", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("row", F.monotonically_increasing_id())
    # A fifth of the pages, by a hash that SQL has as well.
    tested = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 7), 16, 10).cast("long") % 5 == 0
    learning = ruled.where(F.col("r").isNotNull() & ~F.coalesce(tested, F.lit(True)))
    runs = learning.select(F.explode(grams(F.col("codes"))).alias("code"), (F.col("r.verdict") == "allow").cast("long").alias("a"))
    counts = store(runs.groupBy("code").agg(F.sum("a").alias("a"), F.sum(1 - F.col("a")).alias("b")), "url-grams")
    both = counts.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    if not both[0] or not both[1]:
        return ruled.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    # SYMBOLS ** (ORDER + 1) rows at any size of the input.
    table = F.broadcast(store(ratios(counts), "url-ratios"))
    keys = [F.col(c) for c in ("page_id", "host", "path")] + [F.col("r.rule").alias("rule"), F.col("r.verdict").alias("given")]
    runs = ruled.select("row", *keys, F.explode(grams(F.col("codes"))).alias("code"))
    scored = runs.join(table, "code").groupBy("row", "page_id", "host", "path", "rule", "given").agg(F.round(F.avg("v"), DIGITS).alias("score"))
    scored = store(scored.drop("row"), "url-scores")
    bins = scored.where(F.col("given").isNotNull() & tested).groupBy(F.round(F.col("score") * 50).alias("bin")).agg(F.sum((F.col("given") == "allow").cast("long")).alias("a"), F.count("*").alias("n"))
    cut = threshold([(r.bin, r.a, r.n - r.a) for r in bins.collect()]) / 50
    verdict = F.coalesce(F.col("given"), F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def threshold(bins: list[tuple[float, int, int]]) -> float:
    """Where the shares of accepted URLs below and of rejected ones above are least in sum; of equals the nearest to 0."""
    a, b = max(1, sum(x[1] for x in bins)), max(1, sum(x[2] for x in bins))
    bins = sorted(bins)
    cuts = [0.0, *((x[0] + y[0]) / 2 for x, y in zip(bins, bins[1:], strict=False))]
    wrong = lambda cut: sum(x[1] / a if x[0] < cut else 0 for x in bins) + sum(x[2] / b if x[0] >= cut else 0 for x in bins)
    return min(cuts, key=lambda cut: (round(wrong(cut), 12), abs(cut)))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: all `pages`."""
    return judge(read(spark, sf_dir, "pages"))


def _sql() -> str:
    """DuckDB SQL of the registered query, for tables with URLs of both classes."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    steps, ratios = [], []
    for n in range(ORDER + 1):
        size = SYMBOLS ** (n + 1)
        below = [f"1.0 / {SYMBOLS}" if not n else f"p{n - 1}.p{k}" for k in "ab"]
        join = "" if not n else f" left join p{n - 1} on p{n - 1}.g = w.g"
        steps.append(f"s{n} as (select code % {size} as code, sum(a) as a, sum(b) as b from counts group by 1)")
        steps.append(f"t{n} as (select code // {SYMBOLS} as context, sum(a) as na, sum(b) as nb, count(*) filter (where a > 0) as ta, count(*) filter (where b > 0) as tb from s{n} group by 1)")
        values = ", ".join(f"case when coalesce(t.n{k}, 0) = 0 then {b} else (coalesce(s.{k}, 0) + t.t{k} * {b}) / (t.n{k} + t.t{k}) end as p{k}" for k, b in zip("ab", below, strict=True))
        steps.append(f"p{n} as (select w.g, {values} from wanted w left join s{n} s on s.code = w.g % {size} left join t{n} t on t.context = (w.g % {size}) // {SYMBOLS}{join})")
    ratios = f"v as (select g, ln(pa) - ln(pb) as v from p{ORDER})"
    code = " + ".join(f"c[i + {j}] * {SYMBOLS ** (ORDER - j)}" for j in range(ORDER + 1))
    return f"""
with rules(verdict, h, p) as (values {rules}),
u as (select row_number() over () as r, page_id, coalesce(url, '') as url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
n as (select r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
  '{"^" * ORDER}' || regexp_replace(regexp_replace(translate(url, '{_UPPER}', '{_LOWER}'), '[0-9]', '0', 'g'), '[^a-z0/.-]', '?', 'g') || '^' as text,
  ('0x' || substr(md5(page_id::varchar), 1, 7))::bigint % 5 = 0 as tested from u),
f as (select n.r, max(row(length(h), length(p), h || p, rules.verdict)) as m from n join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by n.r),
k as (select n.*, f.m[3] as rule, f.m[4] as given, list_transform(string_split(text, ''), lambda x: case when x = '?' then {SYMBOLS - 1} else strpos('{ALPHABET}', x) - 1 end) as c from n left join f using (r)),
g as (select r, page_id, host, path, rule, given, tested, unnest(list_transform(range(1, len(c) - {ORDER - 1}), lambda i: {code})) as g from k),
counts as (select g as code, count(*) filter (where given = 'allow') as a, count(*) filter (where given = 'block') as b from g where given is not null and not tested group by g),
wanted as (select distinct g from g),
{", ".join(steps)}, {ratios},
scored as (select r, page_id, host, path, rule, given, tested, round(avg(v), {DIGITS}) as score from g join v using (g) group by all),
bins as (select round(score * 50) as bin, count(*) filter (where given = 'allow') as a, count(*) filter (where given = 'block') as b from scored where given is not null and tested group by 1),
cuts as (select 0.0 as cut union all select (bin + lead(bin) over (order by bin)) / 2 from bins qualify lead(bin) over (order by bin) is not null),
wrong as (select cut, sum(case when bin < cut then a else 0 end) / greatest(1, sum(a)) + sum(case when bin >= cut then b else 0 end) / greatest(1, sum(b)) as w from cuts, bins group by cut),
best as (select cut / 50 as cut from wrong order by round(w, 12), abs(cut), cut <> 0, cut limit 1)
select page_id, host, path, rule, coalesce(given, case when score >= coalesce((select cut from best), 0) then 'allow' else 'block' end) as verdict, score from scored
"""


OP5_SQL = _sql()
