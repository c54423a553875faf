"""URL filters by a Bloom filter cascade (DataFrame functions only).

Level 0 encodes the listed keys; level 1 the keys of the complete universe that
level 0 takes wrongly; level 2 the listed keys that level 1 takes; and so on until
no key is wrong.  A key belongs to the list iff the first level without it is odd
(or, where every level has it, the number of levels is odd).  Over the universe
that is exact, and a probe is a chain of bit tests without a join.

The filters travel as scalar subqueries, in segments of ``MAX_BITS`` at most (8 MB;
a key's hash names its segment).  Their size follows the *list*, not the pages: ten
bits a listed key in level 0 and far less in all others, so 125 MB for 100 million
listed hosts.  There is one way for every size.

The list is a table of domains; a domain lists its own host and all subdomains
(:func:`listed_hosts`).  ``BLOCKED_DOMAINS`` is the table that the query uses.

Edge cases: a null url, or one without ``://``, has an empty host and path; the
empty host is a key like any other; null keys are on no list; an empty list gives no
levels and lists nothing, and so does an empty universe with an empty list; listed keys
outside the universe are encoded too; urls of any length are judged whole; repeated urls
are judged alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.store import cut

BITS_PER_KEY, HASHES, MAX_BITS = 10, 4, 1 << 26
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict): fixed values of the query's contract
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
BLOCKED_DOMAINS = tuple(f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


@dataclass
class Cascade:
    """Levels of (bits of a segment, segments, DataFrame of seg and words: an array of 64-bit words)."""

    levels: list[tuple[int, int, DataFrame]]

    def contains(self, key: Column) -> Column:
        """Whether each key is on the list."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(_in_level(key, i, *self.levels[i]), out).otherwise(F.lit(i % 2 == 1))
        return key.isNotNull() & out


def _bit(key: Column, level: int, j: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits))


def _segment(key: Column, level: int, segments: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(HASHES)), F.lit(segments))


def _in_level(key: Column, level: int, bits: int, segments: int, words: DataFrame) -> Column:
    table = words.filter("seg = 0").select("words").scalar()
    for i in range(1, segments):
        table = F.when(_segment(key, level, segments) == i, words.filter(F.col("seg") == i).select("words").scalar()).otherwise(table)
    hit = F.lit(True)
    for j in range(HASHES):
        hit = hit & _set(table, _bit(key, level, j, bits))
    return hit


def _set(table: Column, pos: Column) -> Column:
    word = F.get(table, F.shiftright(pos, 6).cast("int"))
    return word.bitwiseAND(_mask(pos)) != 0


def _mask(pos: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), pos.bitwiseAND(F.lit(63)).cast("int"))


def _level(spark: SparkSession, keys: DataFrame, level: int, bits: int, segments: int) -> DataFrame:
    """(seg, words): the level's bits as one array of words for each segment."""
    per = bits // 64
    pos = F.explode(F.array(*[_bit(F.col("key"), level, j, bits) for j in range(HASHES)]))
    placed = keys.select(_segment(F.col("key"), level, segments).alias("seg"), pos.alias("pos"))
    some = placed.select((F.col("seg") * per + F.shiftright("pos", 6)).alias("word"), _mask(F.col("pos")).alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    every = spark.range(per * segments).select(F.col("id").alias("word")).join(some, "word", "left")
    rows = F.array_sort(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))))
    return cut(every.groupBy(F.floor(F.col("word") / per).alias("seg")).agg(F.transform(rows, lambda x: x["mask"]).alias("words")))


def build_cascade(listed: DataFrame, universe: DataFrame, bits_per_key: int = BITS_PER_KEY, max_bits: int = MAX_BITS) -> Cascade:
    """The cascade of ``listed`` within ``universe`` (both with a column ``key``; listed keys outside the universe count as in it)."""
    spark = universe.sparkSession
    listed = cut(listed.select("key").filter("key is not null").distinct())
    others = cut(universe.select("key").filter("key is not null").distinct().join(listed, "key", "left_anti"))
    inside, outside, levels = listed, others, []
    while n := inside.count():
        segments = -(-n * bits_per_key // max_bits)
        bits = -(-n * bits_per_key // (64 * segments)) * 64
        level = len(levels)
        levels.append((bits, segments, _level(spark, inside, level, bits, segments)))
        wrong = cut(outside.filter(_in_level(F.col("key"), level, *levels[-1])))
        inside, outside = wrong, inside
    return Cascade(levels)


def listed_hosts(universe: DataFrame, domains: DataFrame) -> DataFrame:
    """The keys (hosts) of ``universe`` that are a listed ``domain`` or under one."""
    labels = F.split("key", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return universe.select("key").distinct().select("key", F.explode(tails).alias("domain")).join(domains.select("domain").distinct(), "domain", "left_semi").select("key").distinct()


def judge_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, cascade: Cascade, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    d = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = judge_rules(F.col("host"), F.col("path"), rules)
    listed = F.when(cascade.contains(F.col("host")), F.lit("block")).otherwise(F.lit("allow"))
    return d.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, listed).alias("verdict"))


def op5_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    universe = pages.select(host_of(F.col("url")).alias("key")).distinct()
    domains = spark.range(1).select(F.explode(F.array(*map(F.lit, BLOCKED_DOMAINS))).alias("domain"))
    return filter_urls(pages, build_cascade(listed_hosts(universe, domains), universe))


_FITS = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
_BEST = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
OP5_SQL = f"""
WITH d AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages)
SELECT page_id, host, path,
    CASE {' '.join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{h + p}'" for h, p, _ in _BEST)} END AS rule,
    CASE {' '.join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{v}'" for h, p, v in _BEST)}
        WHEN EXISTS (SELECT 1 FROM (VALUES {', '.join(f"('{x}')" for x in BLOCKED_DOMAINS)}) b(domain) WHERE host = domain OR ends_with(host, '.' || domain))
        THEN 'block' ELSE 'allow' END AS verdict
FROM d
"""
