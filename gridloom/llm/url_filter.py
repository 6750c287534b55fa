"""URL filters: exact membership from a Bloom filter cascade.

The keys that could be asked for are all known: every host suffix of every url
of the corpus with every prefix of its path that a rule could have. Level 1
encodes the listed keys, level 2 the other keys that level 1 accepts wrongly,
level 3 the listed keys that level 2 accepts wrongly, and so on until nobody is
taken in. The first level that refuses a key tells what it is, with no join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import common
from gridloom.llm.common import LOWER, UPPER, bits_for, bloom_bits, bloom_build, bloom_test, stored

#: False-positive rates of level 1 and of the others.
FIRST_RATE, RATE = 0.01, 0.5
#: Levels at the most. Each takes a new hash, so fewer than 2 in 10**12 of a level's keys are left after so many.
LEVELS = 40


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path: after the first ``://``; both empty for null or without it."""
    at = F.call_function("locate", F.lit("://"), F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def candidates(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Keys of all rules that could fit: host suffixes with path prefixes, longest key first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    prefixes = F.array(*[F.substr(path, F.lit(1), F.lit(k)) for k in path_lengths] or [F.lit("")])
    if 0 not in path_lengths:  # a rule without a path fits by its host alone
        prefixes = F.filter(prefixes, lambda p: p != "")
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    keys = F.array_distinct(F.when(host == "", F.array().cast("array<string>")).otherwise(keys))
    ordered = F.array_sort(F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k"))))
    return F.transform(ordered, lambda o: o["k"])


def _hash(key: Column, level: int) -> Column:
    return F.xxhash64(key, F.lit(level))


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts))


@dataclass(frozen=True)
class Cascade:
    """Filters by part of the keys and level: (bytes, bits, hashes); membership is exact over the universe it was made from."""

    parts: list[list[tuple[bytes, int, int]]]

    def holds(self, key: Column) -> Column:
        """Whether the key is listed: the first level of its part that refuses it tells."""
        whole = F.lit(False)
        for n, levels in enumerate(self.parts):
            out = F.lit(len(levels) % 2 == 1)
            for i in reversed(range(len(levels))):
                inside = bloom_test(_hash(key, i), *levels[i])
                out = F.when(inside, out).otherwise(F.lit(i % 2 == 1))
            whole = out if len(self.parts) == 1 else F.when(_part(key, len(self.parts)) == n, out).otherwise(whole)
        return whole


def build_cascade(universe: DataFrame, listed: DataFrame, key: str = "key") -> Cascade:
    """Cascade for ``listed`` keys over ``universe``; both have a string column ``key``, null keys are left out.

    Every level is set in Spark. Keys are cut by hash into as many parts as it
    takes for each level of a part to fit into FILTER_BYTES, and each part has
    a cascade of its own: level 1 holds the listed keys, each later level those
    that the one before takes wrongly. Answers hold for keys of the universe
    and of the list.
    """
    yes = stored(listed.filter(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct(), "cascade-listed")
    no = stored(universe.filter(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct().join(yes, "key", "left_anti"), "cascade-other")
    n_yes = yes.count()
    # Bits of level 1, and of level 2, which holds what level 1 takes wrongly; later levels hold less.
    want = max(bits_for(n_yes, FIRST_RATE), bits_for(FIRST_RATE * no.count(), RATE)) if n_yes else 0
    parts = max(1, math.ceil(1.25 * want / (8 * common.FILTER_BYTES)))
    return Cascade([_levels(*(x if parts == 1 else x.filter(_part(F.col("key"), parts) == n) for x in (yes, no))) for n in range(parts)])


def _levels(yes: DataFrame, no: DataFrame) -> list[tuple[bytes, int, int]]:
    levels: list[tuple[bytes, int, int]] = []
    inside, outside = yes, no  # this level encodes inside; what it takes of outside goes into the next
    while (n := inside.count()) > 0:
        if len(levels) == LEVELS:
            raise ValueError(f"{n} keys are still undecided after {LEVELS} levels")
        i = len(levels)
        bits, hashes = bloom_bits(n, FIRST_RATE if i == 0 else RATE)
        data = bloom_build(inside, _hash(F.col("key"), i), bits, hashes)
        levels.append((data, bits, hashes))
        wrong = outside.filter(bloom_test(_hash(F.col("key"), i), data, bits, hashes))
        inside, outside = stored(wrong, f"cascade-{i}"), inside
    return levels


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds _host, _path, _rule and _verdict to ``pages`` (all other columns stay, whatever their names).

    ``rules`` are (host, path, verdict). A rule fits its host and all
    subdomains when the url's path starts with the rule's, an empty one always;
    the longest fitting key wins, a block over an allow of the same key. Without a fitting rule no
    cascade holds a key of the url, and the verdict is ``default``. A url that
    is null or has no ``://`` has empty host and path and fits no rule.
    """
    spark: SparkSession = pages.sparkSession
    host, path = split_url(F.col(f"`{url}`"))
    lengths = sorted({len(p) for _, p, _ in rules})
    new = ["_host", "_path", "_rule", "_verdict"]
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in new])
    df = pages.select(row.alias("row"), host.alias("_host"), path.alias("_path")).withColumn("_keys", candidates(F.col("_host"), F.col("_path"), lengths))
    universe = df.select(F.explode("_keys").alias("key")).distinct()
    universe = stored(universe, "cascade-universe")
    verdicts = [v for v in ("block", "allow") if any(r[2] == v for r in rules)]
    holds = {}
    for v in verdicts:
        listed = spark.createDataFrame([(h + p,) for h, p, r in rules if r == v], "key string")
        holds[v] = build_cascade(universe, listed)
    hit = F.filter("_keys", lambda k: _any([c.holds(k) for c in holds.values()]))
    df = df.withColumn("_rule", F.get(hit, F.lit(0)))
    verdict = F.lit(default)
    for v in reversed(verdicts):
        verdict = F.when(F.col("_rule").isNotNull() & holds[v].holds(F.col("_rule")), F.lit(v)).otherwise(verdict)
    return df.withColumn("_verdict", verdict).select("row.*", *new)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out
