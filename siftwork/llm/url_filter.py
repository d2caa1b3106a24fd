"""URL filters: a Bloom filter cascade with exact answers over the corpus's keys.

Level 1 holds the listed keys. Level 2 holds the other keys that level 1 lets through by mistake,
level 3 the listed keys that level 2 lets through, and so on until a level makes no mistake over
the key universe, which is every distinct key of the corpus. A key's answer is given by the first
level that doesn't hold it, so membership is exact for each key of the universe, without a join.

Filters are bit arrays in 64-bit words, built by grouping on the word and or-ing the bits. The
universe is divided by a hash of the key into as many parts as keep every filter within
``MOST_BITS``; each part has a cascade of its own, so that no filter grows with the list. One part is
read by a scalar subquery, which gives each executor one copy. Of several, the filters lie in one row for
each part, and keys are read beside the row of their part; keys themselves are never joined.

Defined results: a null url, or one without ``://``, has an empty host and path, is never listed
and is allowed; repeated pages give repeated rows; other columns of pages are left out, whatever
their names; an empty table gives no rows; with no listed key, or none unlisted, one level is enough.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.common import lower_ascii, table, written


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))

#: Bits of a filter, 8 MB; a longer list is divided into parts.
MOST_BITS = 1 << 26


class Level(NamedTuple):
    bits: DataFrame  # part, words: one array of words for each part
    size: int
    hashes: int
    number: int


class Cascade(NamedTuple):
    parts: int
    levels: tuple[Level, ...]


def host_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    get = lambda k: F.coalesce(F.regexp_extract(url, parts, k), F.lit(""))
    return lower_ascii(get(1)), get(2)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one. A rule fits its host and all subdomains."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):  # the longest is tested first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.host + r.path)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _places(key: Column, size: int, hashes: int, number: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(number), F.lit(j), key), F.lit(size)) for j in range(hashes)]


def _holds(level: Level, words: Column, key: Column) -> Column:
    held = F.lit(True)
    for at in _places(key, level.size, level.hashes, level.number):
        word = F.get(words, F.shiftright(at, 6).cast("int"))
        held = held & (F.call_function("shiftrightunsigned", word, F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return held


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), key), F.lit(parts))


def _beside(rows: DataFrame, key: str, parts: int, levels: tuple[Level, ...]) -> tuple[DataFrame, list[Column]]:
    """(rows, the words of each level's filter for the row's part)."""
    if parts == 1:
        return rows, [level.bits.select("words").scalar() for level in levels]
    own = "filter_"
    while any(c.startswith(own) for c in rows.columns):
        own = "_" + own
    out, filters = rows.withColumn(own + "part", _part(F.col(key), parts)), None
    for level in levels:  # one row for each part
        mine = level.bits.select(F.col("part").alias(own + "part"), F.col("words").alias(f"{own}{level.number}"))
        filters = mine if filters is None else filters.join(mine, own + "part")
    return out.join(filters, own + "part"), [F.col(f"{own}{level.number}") for level in levels]


def _shape(n: int, wrong: float) -> tuple[int, int]:
    """(bits, hash functions) for n keys at a rate of wrong answers."""
    hashes = max(1, round(-math.log2(wrong)))
    size = max(64, math.ceil(n * hashes / math.log(2)))
    return (size + 63) // 64 * 64, hashes


def _build(keys: DataFrame, parts: int, size: int, hashes: int, number: int) -> Level:
    spark, n = keys.sparkSession, size // 64
    at = keys.select(_part(F.col("key"), parts).alias("part"), F.explode(F.array(*_places(F.col("key"), size, hashes, number))).alias("at"))
    one = F.expr("shiftleft(1L, cast(pmod(at, 64) as int))")
    every = spark.range(parts * n).select(F.floor(F.col("id") / n).alias("part"), (F.col("id") % n).alias("word"), F.lit(0).cast("long").alias("bits"))
    words = at.select("part", F.shiftright("at", 6).alias("word"), one.alias("bits")).unionByName(every)
    each = words.groupBy("part", "word").agg(F.bit_or("bits").alias("bits"))
    # bounded: a row has size / 64 words, about MOST_BITS / 64
    rows = each.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w")).select("part", F.transform("w", lambda x: x["bits"]).alias("words"))
    return Level(written(rows), size, hashes, number)


def cascade(universe: DataFrame, most_bits: int = MOST_BITS) -> Cascade:
    """The levels for a universe of distinct (key, listed); without a listed key there are none."""
    inside, outside = (universe.where(c).select("key") for c in ("listed", "not listed"))
    n, others = inside.count(), outside.count()
    if not n:
        return Cascade(1, ())
    wrong = min(0.5, n / (math.sqrt(2) * others)) if others else 0.5
    parts = math.ceil(_shape(n, wrong)[0] / most_bits)
    levels: list[Level] = []
    while n:
        if parts > 1:  # the largest part's number of keys
            n = inside.groupBy(_part(F.col("key"), parts).alias("part")).count().agg(F.max("count")).first()[0]
        level = _build(inside, parts, *_shape(n, wrong if not levels else 0.5), len(levels) + 1)
        levels.append(level)
        rows, (words,) = _beside(outside, "key", parts, (level,))
        passed = written(rows.where(_holds(level, words, F.col("key"))).select("key"))
        inside, outside, n = passed, inside, passed.count()
    return Cascade(parts, tuple(levels))


def with_listed(rows: DataFrame, key: str, found: Cascade, name: str = "in_list") -> DataFrame:
    """``rows`` with ``name``: whether ``key`` is listed; right for keys of the universe, any answer for others."""
    if not found.levels:
        return rows.withColumn(name, F.lit(False))
    beside, words = _beside(rows, key, found.parts, found.levels)
    answer = F.lit(len(found.levels) % 2 == 1)
    for i in reversed(range(len(found.levels))):
        answer = F.when(_holds(found.levels[i], words[i], F.col(key)), answer).otherwise(F.lit(i % 2 == 1))
    return beside.select(*rows.columns, answer.alias(name))


def judge(pages: DataFrame, universe: DataFrame, rules: tuple[Rule, ...] = RULES, most_bits: int = MOST_BITS) -> DataFrame:
    """page_id, host, path, rule and verdict for each page: the rule's verdict, else block if the host is listed."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = with_listed(rows, "host", cascade(universe, most_bits))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when((F.col("host") != "") & F.col("in_list"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))


def hosts_without_https(pages: DataFrame) -> DataFrame:
    """(key, listed) for each distinct host: listed are hosts that serve no page by https."""
    host, _ = host_path(F.col("url"))
    safe = lower_ascii(F.substring("url", 1, 8)) == "https://"
    hosts = pages.select(host.alias("key"), safe.alias("safe")).where("key <> ''")
    return written(hosts.groupBy("key").agg((~F.max("safe")).alias("listed")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, hosts_without_https(pages))
