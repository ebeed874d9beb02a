"""URL filters by a Bloom filter cascade.

A blocklist of hosts is held against every URL without a join. Level 0 is a
Bloom filter of the listed keys; level 1 of those keys of the corpus that are
not listed but pass level 0; level 2 of the listed keys that pass level 1, and
so on until nothing passes falsely. As the levels are fitted on the complete
universe of keys of the corpus, the cascade answers exactly for each of them:
the first level that says no decides.

A key is a host or one of its parent domains, so that a listed domain also
blocks its subdomains. Hosts are made distinct before their keys are, and both
with map-side aggregation, so a hot host costs one row per task. A level's bits
are OR-ed byte by byte in the shuffle and gathered; at ``bits_per_key`` bits a
key of the level, level sizes fall geometrically. Keys are dealt by hash into
shards whose first levels stay within ``shard_bytes``, each with a cascade of its
own; URLs go through the shards' cascades one after another, so no task ever
holds more than one, whatever the length of the list.

Defined cases: a null URL, or one without ``://``, has empty host and path, no
rule and no key, and is allowed; list entries are lower-cased as hosts are;
null, empty and repeated entries count as absent or once; an empty list blocks
nothing; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.storage import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path prefix); the longest that fits decides.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Hosts known for spam or adult content in the crawls that this engine is tested with.
BLOCKED_HOSTS = ("spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org", "adult-x.example.com", "adult-x.example.net", "adult-x.example.org", "casino-777.example.com", "casino-777.example.net", "casino-777.example.org")

#: Words of domain labels, between dots and hyphens, for worded().
BLOCKED_WORDS = ("adult", "ads", "bets", "betting", "casino", "pills", "poker", "porn", "sex", "spam", "viagra", "xxx")


def worded(key: Column, words: Sequence[str] = BLOCKED_WORDS) -> Column:
    """Whether a label of the key has one of the words, alone or between hyphens."""
    return F.arrays_overlap(F.split(key, "[.-]"), F.array(*[F.lit(w) for w in words]).cast("array<string>"))


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path``, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, on, under in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(under)
        rule, verdict = F.when(fits, F.lit(on + under)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def keys_of(host: Column) -> Column:
    """The host and its parent domains, as an array."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))


@dataclass
class Cascade:
    """Levels of (seed, number of bits, hashes, table)."""

    levels: list[tuple[int, int, int, bytes]] = field(default_factory=list)

    def has(self, key: Column) -> Column:
        """Exact membership of keys of the universe: whether the first level that says no is an odd one."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for n, level in reversed(list(enumerate(self.levels))):
            answer = F.when(passes(key, *level), answer).otherwise(F.lit(n % 2 == 1))
        return answer


def slots(key: Column, seed: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed * 64 + i), key), F.lit(bits)) for i in range(hashes)]


def passes(key: Column, seed: int, bits: int, hashes: int, held: bytes) -> Column:
    table, found = F.lit(held), F.lit(True)
    for slot in slots(key, seed, bits, hashes):
        byte = F.conv(F.hex(F.substring(table, F.shiftright(slot, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        found = found & (F.getbit(byte, F.pmod(slot, F.lit(8)).cast("int")) == 1)
    return found


def fitted(keys: DataFrame, n: int, seed: int, bits_per_key: float) -> tuple[int, int, int, bytes]:
    """A Bloom filter of the n keys of a one-column table; its bits are OR-ed on the executors."""
    bits = 8 * max(1, math.ceil(bits_per_key * n / 8))
    hashes = max(1, round(bits_per_key * math.log(2)))
    at = keys.select(F.explode(F.array(*slots(F.col(keys.columns[0]), seed, bits, hashes))).alias("slot"))
    mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.pmod("slot", F.lit(8)).cast("int") + 1)
    held = at.groupBy(F.shiftright("slot", 3).cast("int").alias("byte")).agg(F.bit_or(mask).alias("set")).toPandas()
    table = np.zeros(bits // 8, dtype=np.uint8)
    table[held["byte"].to_numpy()] = held["set"].to_numpy()
    return seed, bits, hashes, table.tobytes()


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards))


def build(universe: DataFrame, listed: DataFrame, bits_per_key: float = 12.0) -> Cascade:
    """The cascade of a universe of distinct keys (key) and its listed ones (key, distinct, all in the universe). Each level passes few keys of the last but one, so levels end."""
    n = listed.count()
    yes, no = listed.select("key"), universe.select("key").join(listed, "key", "left_anti")
    cascade, tables = Cascade(), Scratch()
    while n:
        level = fitted(yes, n, len(cascade.levels), bits_per_key)
        cascade.levels.append(level)
        yes, no = tables.written(no.where(passes(F.col("key"), *level)), "cascade-level"), yes
        n = yes.count()
    tables.clear()
    return cascade


def marked(rows: DataFrame, universe: DataFrame, listed: DataFrame, bits_per_key: float = 12.0, shard_bytes: int = 1 << 20) -> DataFrame:
    """rows (with host) and listed: whether the host or one of its parents is a listed key. universe and listed are written tables."""
    shards = max(1, math.ceil(bits_per_key * listed.count() / 8 / shard_bytes))
    rows, tables = rows.withColumn("listed", F.lit(False)), Scratch()
    for shard in range(shards):
        own = shard_of(F.col("key"), shards) == shard
        cascade = build(universe.where(own), listed.where(own), bits_per_key)
        hit = F.exists(keys_of(F.col("host")), lambda k: (shard_of(k, shards) == shard) & cascade.has(k))
        rows = rows.withColumn("listed", F.when(F.col("host") == "", False).otherwise(F.col("listed") | hit))
        if shard + 1 < shards:  # the next shard's filter must not share a task with this one's
            before = list(tables.paths.values())
            rows = tables.written(rows, "cascade-rows")
            if before:
                tables.clear(*[t for t, _ in before])
    return rows


def judge(pages: DataFrame, blocked: DataFrame | Sequence[str] | Callable[[Column], Column] = BLOCKED_HOSTS, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, shard_bytes: int = 1 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict, listed of each page. blocked: host names, a table whose first column has them, or a condition that selects them from all keys of the pages, as worded()."""
    spark, tables = pages.sparkSession, Scratch()
    host = host_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path_of(F.col(url_col)).alias("path"))
    hosts = rows.select("host").where("host <> ''").distinct()
    universe = tables.written(hosts.select(F.explode(keys_of(F.col("host"))).alias("key")).distinct(), "cascade-universe")
    if callable(blocked):
        listed = universe.where(blocked(F.col("key")))
    else:
        if not isinstance(blocked, DataFrame):
            blocked = spark.createDataFrame([(h,) for h in blocked], "key string")
        names = blocked.select(F.translate(F.col(blocked.columns[0]).cast("string"), UPPER, LOWER).alias("key")).where("key <> ''").distinct()
        listed = universe.join(names, "key", "left_semi")
    listed = tables.written(listed, "cascade-listed")
    rows = marked(rows, universe, listed, shard_bytes=shard_bytes)
    tables.clear()
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    said = F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", rule.alias("rule"), said.alias("verdict"), "listed")
