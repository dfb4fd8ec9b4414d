"""URL filters by a Bloom filter cascade (DataFrame functions only).

Every url gives candidate keys: a suffix of its host at a label border, joined with a prefix of its path. The corpus's
distinct candidate keys are the complete key universe. Level 1 of a cascade encodes the listed keys of that universe,
level 2 the keys that level 1 passes wrongly, level 3 the listed keys that level 2 passes, and so on until no key is
passed wrongly. Over the universe, membership is then exact, and urls are judged without a join: the filters reach the
scan of the urls as scalar subqueries.

Which suffixes and prefixes are tried is data too: the shapes of listed keys (labels of the host, characters of the path)
are one array, over which higher-order functions make a url's keys, so the plan is the same for five rules as for a
hundred thousand of any shapes.

Size: the first level takes about ``1.44 * log2(universe / listed)`` bits a listed key, the others together a few bits
a listed key, so what is sent around is bounded by the list, whatever the corpus. A list whose first level would pass
``max_filter_bits`` is dealt by hash of the key into parts that do not; each part has cascades of its own over its part
of the universe and takes one narrow pass over the urls, which keeps the best rule so far.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkqa.llm import bloom
from sparkqa.llm.shared import ascii_lower, free, stored

#: The rules (host and path prefix) and their verdicts.
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]

MAX_FILTER_BITS = 1 << 28


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def labels_of(host: Column) -> Column:
    return F.when(host == "", 0).otherwise(F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1)


def key_shapes(rules: DataFrame) -> Column:
    """The distinct (labels of the host, characters of the path) of listed keys, as a scalar subquery of one array."""
    host = F.substring_index("key", "/", 1)
    shape = F.struct(labels_of(host).alias("labels"), (F.length("key") - F.length(host)).alias("chars"))
    return rules.agg(F.collect_set(shape).alias("shapes")).scalar()


def candidate_keys(host: Column, path: Column, shapes: Column) -> Column:
    """The keys a url may be listed under."""
    fit = F.filter(shapes, lambda s: (s["labels"] <= labels_of(host)) & (s["chars"] <= F.length(path)))
    suffix = lambda n: F.call_function("substring_index", host, F.lit("."), -n)
    return F.transform(fit, lambda s: F.concat(suffix(s["labels"]), F.substring(path, F.lit(1), s["chars"])))


class Cascade:
    """Filters of alternate levels; ``contains`` is exact for every key of the universe it was built over."""

    def __init__(self, levels: list[tuple[DataFrame, int, int]]):
        self.levels = levels

    def words(self) -> list[Column]:
        """The levels' filters, as scalar subqueries."""
        return [bloom.words_of(words) for words, _, _ in self.levels]

    def contains(self, key: Column, words: list[Column] | None = None) -> Column:
        """words: where the levels' filters are found instead."""
        words, found = words or self.words(), F.lit(False)
        for depth in range(len(self.levels), 0, -1):
            _, bits, hashes = self.levels[depth - 1]
            found = bloom.passes(key, words[depth - 1], depth, bits, hashes) & ~found
        return found


def first_share(inside: int, outside: int) -> float:
    """The share of other keys that a first level may pass."""
    return min(0.5, max(inside * math.sqrt(0.5) / max(1, outside), 1e-9))


def build_cascade(inside: DataFrame, outside: DataFrame, n_inside: int, n_outside: int) -> Cascade:
    """inside, outside: the keys (once each) of the universe that are listed and those that are not, and how many."""
    levels: list[tuple[DataFrame, int, int]] = []
    while n_inside:
        depth = len(levels) + 1
        bits, hashes = bloom.shape(n_inside, first_share(n_inside, n_outside) if depth == 1 else 0.5)
        words = bloom.build(inside, "key", depth, bits, hashes)
        levels.append((words, bits, hashes))
        wrong = stored(outside.where(bloom.passes(F.col("key"), bloom.words_of(words), depth, bits, hashes)), "wrong")
        inside, outside, n_inside, n_outside = wrong, inside, wrong.count(), n_inside
    return Cascade(levels)


def longest_listed(keys: Column, filters: Column, block: Cascade, allow: Cascade) -> Column:
    """The longest of the keys that a cascade has, as struct(n, h, key, verdict); null without one. filters: an array of one
    struct of the levels' words, those of ``block`` first."""
    n = len(block.levels)
    sized = lambda k, verdict: F.struct(F.length(k).alias("n"), F.length(F.substring_index(k, "/", 1)).alias("h"), k.alias("key"), F.lit(verdict).alias("verdict"))

    def of(w: Column) -> Column:
        words = [w[f"w{i}"] for i in range(n + len(allow.levels))]
        return F.array_max(F.transform(keys, lambda k: F.when(block.contains(k, words[:n]), sized(k, "block")).when(allow.contains(k, words[n:]), sized(k, "allow"))))

    return F.element_at(F.transform(filters, of), 1)


def filter_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """Adds host, path, rule and verdict to ``urls``.

    rules: (key, verdict 'allow' or 'block'), key being host and path prefix such as ``example.com/en/``. A key fits its
    host and all subdomains if the path starts with its path; the longest fitting key wins (equal lengths: the longer
    host), and gives its verdict. A url with no listed key has rule null and the verdict ``default``: not listed.

    Null urls and urls without ``://`` have empty host and path and no rule. Repeated rows are judged each on their own,
    an empty table or list gives an empty result or no rules, long urls are judged whole, other columns are kept, whatever
    they are called; columns that are named host, path, rule or verdict are replaced. A key listed twice with both
    verdicts is blocked.
    """
    rules = rules.where("key is not null").groupBy("key").agg(F.max(F.col("verdict") == "block").alias("block"))
    judged = urls.withColumns({"host": host_of(F.col(f"`{url}`")), "path": path_of(F.col(f"`{url}`"))})
    shapes, keys, filters, best = free([*judged.columns, "rule", "verdict"], "shapes", "keys", "filters", "best")
    listed = key_shapes(rules)
    made = candidate_keys(F.col("host"), F.col("path"), F.col(shapes))
    seen = judged.select("host", "path").withColumn(shapes, listed).select(F.explode(made).alias("key"), F.lit(True).alias("seen"), F.lit(None).cast("boolean").alias("block"))
    both = seen.unionByName(rules.select("key", F.lit(False).alias("seen"), "block"))
    universe = stored(both.groupBy("key").agg(F.max("seen").alias("seen"), F.max("block").alias("block")).where("seen").select("key", "block"), "universe")
    counted = universe.agg(F.count("*").alias("all"), F.count_if("block").alias("block"), F.count_if(~F.col("block")).alias("allow")).first()
    most = max(bloom.shape(n, first_share(n, counted.all - n))[0] for n in (counted.block, counted.allow))
    parts = -(-most // max_filter_bits)
    in_part = lambda part: lambda key: F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts)) == part
    judged = judged.withColumn(best, F.lit(None).cast("struct<n:int,h:int,key:string,verdict:string>"))
    for part in range(parts):
        own = universe.where(in_part(part)(F.col("key"))) if parts > 1 else universe
        if parts > 1:
            counted = own.agg(F.count("*").alias("all"), F.count_if("block").alias("block"), F.count_if(~F.col("block")).alias("allow")).first()
        block = build_cascade(own.where("block"), own.where("not coalesce(block, false)"), counted.block, counted.all - counted.block)
        allow = build_cascade(own.where("not block"), own.where("coalesce(block, true)"), counted.allow, counted.all - counted.allow)
        every = [*block.words(), *allow.words()]
        # the filters are bound once for all keys of a url, as the one element of an array; Spark puts that projection into
        # the next one, where it is used once, so no row carries them
        bound = F.array(F.struct(*[w.alias(f"w{i}") for i, w in enumerate(every)])) if every else F.array(F.struct(F.lit(0).alias("w0")))

        own_keys = F.filter(F.col(keys), in_part(part)) if parts > 1 else F.col(keys)
        found = longest_listed(own_keys, F.col(filters), block, allow)
        tried = judged.withColumn(shapes, listed).withColumn(keys, made).drop(shapes).withColumn(filters, bound)
        judged = tried.withColumn(best, F.array_max(F.array(F.col(best), found))).drop(keys, filters)
        if part + 1 < parts:
            judged = stored(judged, "judged")
    return judged.withColumns({"rule": F.col(f"{best}.key"), "verdict": F.coalesce(F.col(f"{best}.verdict"), F.lit(default))}).drop(best)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = reduce(DataFrame.unionByName, [spark.range(1).select(F.lit(k).alias("key"), F.lit(v).alias("verdict")) for k, v in RULES])
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest
), rules(rule, verdict) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in RULES)}
), fits AS (
  SELECT page_id, r.rule, r.verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC) AS n
  FROM parts JOIN rules r
    ON (host = split_part(r.rule, '/', 1) OR ends_with(host, '.' || split_part(r.rule, '/', 1)))
   AND starts_with(path, substr(r.rule, length(split_part(r.rule, '/', 1)) + 1))
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.n = 1
"""
