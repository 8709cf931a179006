"""URL rules by exact membership of keys in Bloom filter cascades, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.session import written

WORD = 64


@dataclass
class Level:
    """A Bloom filter as 64-bit words; which hashes it uses follows from its number."""

    number: int
    hashes: int
    bits: int
    words: list[int]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, depths: Sequence[int], lengths: Sequence[int]) -> Column:
    """Array of structs (size, host_size, key), longest first: the host's last labels, each with the path's beginning.

    Only numbers of labels and lengths of paths that rules have can make a key that is listed.
    """
    labels = F.split(host, r"\.")
    n = F.size(labels)
    depths, lengths = (F.array(*[F.lit(x) for x in sorted(set(values))]) for values in (depths, lengths))
    hosts = F.transform(F.filter(depths, lambda d: d <= n), lambda d: F.array_join(F.slice(labels, n - d + 1, d), "."))
    lengths = F.filter(lengths, lambda x: x <= F.length(path))
    starts = F.transform(lengths, lambda x: F.substring(path, F.lit(1), x))
    keys = F.flatten(
        F.transform(
            hosts,
            lambda h: F.transform(
                starts, lambda p: F.struct((F.length(h) + F.length(p)).alias("size"), F.length(h).alias("host_size"), F.concat(h, p).alias("key"))
            ),
        )
    )
    return F.reverse(F.array_sort(keys))


def _places(key: Column, number: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(number), F.lit(i), key), F.lit(bits)) for i in range(hashes)]


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (place % WORD).cast("int"))


def in_level(key: Column, level: Level) -> Column:
    """Whether all of a key's bits are set."""
    words = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<long>")  # folded to a constant
    places = _places(key, level.number, level.hashes, level.bits)
    tests = [F.get(words, (p / WORD).cast("int")).bitwiseAND(_bit(p)) != 0 for p in places]
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def build_level(keys: DataFrame, number: int, n: int, rate: float) -> Level:
    """Bloom filter of a table (key) of n rows with about this rate of false positives."""
    bits = max(WORD, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    bits = -(-bits // WORD) * WORD
    hashes = max(1, round(bits / n * math.log(2)))
    hashes = min(hashes, 16)
    place = F.explode(F.array(*_places(F.col("key"), number, hashes, bits)))
    words = keys.select(place.alias("p")).select((F.col("p") / WORD).cast("int").alias("w"), _bit(F.col("p")).alias("b"))
    found = {r["w"]: r["b"] for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).collect()}
    return Level(number, hashes, bits, [found.get(i, 0) for i in range(bits // WORD)])


def build_cascade(listed: DataFrame, universe: DataFrame, n_universe: int) -> list[Level]:
    """Levels that tell the listed keys from all others in ``universe``, both tables (key).

    The first level holds the listed keys; each later one those keys of the other side that the level before
    takes for its own. Only the first looks at the whole universe; what passes it is about as much as is listed. The
    filters' size follows the list, by a factor of the logarithm of how much larger the universe is.
    """
    ours = written(listed.select("key").filter("key is not null").distinct(), "cascade")
    n = ours.count()
    if not n:
        return []
    levels = [build_level(ours, 1, n, min(0.5, n * 0.5**0.5 / max(1, n_universe)))]
    theirs = universe.select("key").filter(in_level(F.col("key"), levels[0])).distinct().join(ours, "key", "left_anti")
    theirs = written(theirs, "cascade")
    while n := theirs.count():
        levels.append(build_level(theirs, len(levels) + 1, n, 0.5))
        wrong = written(ours.filter(in_level(F.col("key"), levels[-1])), "cascade")
        ours, theirs = theirs, wrong
    return levels


def listed_in(key: Column, levels: Sequence[Level]) -> Column:
    """Exact membership of a key of the universe: the first level that does not know it decides."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(in_level(key, levels[i]), out).otherwise(F.lit(i % 2 == 1))
    return out


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    ``rules`` are (verdict, host, path) with verdict ``block`` or ``allow``. A rule fits its host and all
    subdomains where the url's path starts with the rule's path; the rule with the longest text wins, then the
    one with the longer host. Where none fits, the rule is null and the verdict is ``default``: a key that no
    list holds. Of a key listed on both sides the block counts. Null and odd urls have an empty host and path,
    and no rule. Rows are judged one by one, so repeated rows and null ids are no matter; an empty table gives
    no rows. Rule lists are small tables of the driver.
    """
    if any(v not in ("block", "allow") for v, _, _ in rules):
        raise ValueError("a rule's verdict is block or allow")
    spark = pages.sparkSession
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    keyed = rows.withColumn("keys", keys_of(F.col("host"), F.col("path"), [h.count(".") + 1 for _, h, _ in rules] or [1], [len(p) for _, _, p in rules] or [0]))
    universe = keyed.select(F.explode("keys.key").alias("key"))
    cascades = {}
    n = universe.count() if rules else 0
    for verdict in ("block", "allow"):
        names = [h + p for v, h, p in rules if v == verdict]
        if names:
            listed = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in names])).alias("key"))
            cascades[verdict] = build_cascade(listed, universe, n)

    def member(verdict: str, key: Column) -> Column:
        return listed_in(key, cascades[verdict]) if verdict in cascades else F.lit(False)

    hit = F.filter("keys", lambda k: member("block", k["key"]) | member("allow", k["key"]))
    rule = F.get(hit, F.lit(0))["key"]
    judged = keyed.select("id", "host", "path", rule.alias("rule"))
    verdict = F.when(F.col("rule").isNull(), default).when(member("block", F.col("rule")), "block").otherwise("allow")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
