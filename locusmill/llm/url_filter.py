"""URL filters: prefix rules, and a list of URLs behind a blocked Bloom filter.

A blocked Bloom filter keeps all bits of one key in one 256-bit block, so a lookup is one
row: the filter is a table (block, w0 .. w3) that is broadcast. Its size is bounded by
``max_blocks`` whatever the length of the list; a long list only lets more false hits
through. Hits go on to a hash join with the list itself, so the answer is always exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: (host, path) in rule strings, and what a rule says. Longest wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not name content.
TRACKING = "^(utm_[^=]*|ref|gclid|fbclid)(=.*)?$"
BITS_PER_KEY = 12
MAX_BLOCKS = 1 << 17  # 256-bit blocks: 4 MiB of bits, at most 131,072 broadcast rows


def host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else ''."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """host + path + ?query: no ``www.``, default port, double or final slash, tracking
    parameter or fragment; parameters sorted. Null where there is no host."""
    name = F.regexp_replace(F.regexp_replace(host(url), r":(80|443)$", ""), r"^www\.", "")
    way = F.regexp_replace(F.regexp_replace(path(url), "/+", "/"), "/$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.array_join(kept, "&")
    return F.when(name != "", F.concat(name, way, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise("")))


def matching_rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """(says, rule) of the longest rule that fits, or null. A rule fits its host and all its
    subdomains, if the path starts with the rule's. Of equally long rules the first wins."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1]), i))
    found = F.lit(None).cast("struct<says:string,rule:string>")
    for i in reversed(order):
        name, slash, rest = rules[i][1].partition("/")
        fits = ((host_ == name) | host_.endswith(f".{name}")) & path_.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rules[i][0]).alias("says"), F.lit(rules[i][1]).alias("rule"))).otherwise(found)
    return found


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and the four words of its mask, two bits in each."""
    h = F.xxhash64(key)
    g = F.xxhash64(key, F.lit(1))
    six = lambda i: F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int")
    one = F.lit(1).cast("long")
    words = [_shift(one, six(2 * w)).bitwiseOR(_shift(one, six(2 * w + 1))) for w in range(4)]
    return F.pmod(h, F.lit(blocks)).cast("int"), words


def _shift(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)


def bloom_blocks(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0 .. w3): the filter over the keys, one row per block in use."""
    block, words = _bits(F.col(key), blocks)
    rows = listed.where(F.col(key).isNotNull()).select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def possible(rows: DataFrame, key: str, listed: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``rows`` whose ``key`` may be in ``listed`` (one column, distinct): all that are, and few others.

    For a join that would else move every row; it still has to decide. The filter has at
    most ``max_blocks`` rows; a longer list only lets more pass."""
    p, blocks = unused(rows), 1
    while blocks < min(listed.count() * BITS_PER_KEY // 256 + 1, max_blocks):
        blocks *= 2
    name = listed.columns[0]
    bloom = bloom_blocks(listed.select(F.col(name).cast(rows.schema[key].dataType).alias(f"{p}key")), f"{p}key", blocks)
    bloom = F.broadcast(bloom.withColumnsRenamed({c: p + c for c in bloom.columns}))  # at most max_blocks rows
    block, words = _bits(F.col(key), blocks)
    hit = F.lit(True)
    for i, w in enumerate(words):
        hit = hit & (F.col(f"{p}w{i}").bitwiseAND(w) == w)
    return rows.join(bloom, (block == F.col(f"{p}block")) & F.col(key).isNotNull()).where(hit).select(*rows.columns)


def url_filter(
    pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES, max_blocks: int = MAX_BLOCKS
) -> DataFrame:
    """``pages`` (with a ``url``) plus host, path, canonical_url, rule, listed, verdict.

    ``listed``: one column ``canonical_url``. The verdict is the rule's, else block for a
    listed URL and allow for any other. A null or odd URL has an empty host and path, no
    rule, and is allowed. Repeated pages are judged one by one, repeated or null entries
    of the list do not matter. Columns of ``pages`` with one of the new names, in whatever case,
    are replaced.
    """
    new = ["host", "path", "canonical_url", "rule", "listed", "verdict"]
    keep = [c for c in pages.columns if c.lower() not in new]
    p = unused(pages)
    judged = pages.select(*keep, host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical_url"))
    judged = judged.withColumn(f"{p}rule", matching_rule(F.col("host"), F.col("path"), rules))
    judged = judged.withColumn("rule", F.col(f"{p}rule")["rule"]).withColumn(f"{p}says", F.col(f"{p}rule")["says"]).drop(f"{p}rule")
    names = listed.select(F.col("canonical_url").alias(f"{p}key")).where(F.col(f"{p}key").isNotNull()).distinct()
    wanted = int(names.count()) * BITS_PER_KEY // 256 + 1
    blocks = 1
    while blocks < min(wanted, max_blocks):
        blocks *= 2
    block, words = _bits(F.col("canonical_url"), blocks)
    bloom = bloom_blocks(names, f"{p}key", blocks)
    bloom = F.broadcast(bloom.withColumnsRenamed({c: p + c for c in bloom.columns}))  # at most max_blocks rows
    hit = F.col("canonical_url").isNotNull()
    for i, w in enumerate(words):
        hit = hit & (F.col(f"{p}w{i}").bitwiseAND(w) == w)
    probe = judged.join(bloom, block == F.col(f"{p}block"), "left").withColumn(f"{p}hit", F.coalesce(hit, F.lit(False)))
    sure = probe.where(~F.col(f"{p}hit")).withColumn("listed", F.lit(False))
    maybe = probe.where(F.col(f"{p}hit")).join(names, F.col("canonical_url") == F.col(f"{p}key"), "left")
    maybe = maybe.withColumn("listed", F.col(f"{p}key").isNotNull()).drop(f"{p}key")
    out = sure.unionByName(maybe)
    verdict = F.coalesce(F.col(f"{p}says"), F.when(F.col("listed"), "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).select(*keep, *new)
