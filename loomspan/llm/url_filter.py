"""URL rules by an exact cascade of Bloom filters, in DataFrame operations only.

Listed keys are ``host + path prefix``.  Every url has few candidate keys:
its host and each parent domain, with each path prefix of a length that some
rule has.  The universe is the set of all candidate keys of the corpus.

Level 1 of a cascade holds the listed keys, level 2 the keys of the universe
that level 1 passes though they aren't listed, level 3 the listed keys that
level 2 passes, and so on until a level has no false positives.  A key's
answer is the parity of the first level that doesn't hold it, so membership
is exact for each key of the universe and needs no join: levels are constant
bit arrays in the projection over the pages.

What is sent to each task are those bit arrays.  The bits a key of level 1
follow how many times more keys the universe has than the list, so that
about FALSE_SHARE times as many keys as are listed pass it wrongly, whatever
the size of the corpus; further levels shrink from there.  So the size
follows the rule list.  A list of more than PART_KEYS keys is dealt by hash
into cascades of that size, each kept in a constant of its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import ascii_lower, cut, unused

#: Bits a key in levels after the first, and its places among them.
BITS_PER_KEY = 12
PROBES = 4
FALSE_SHARE = 0.5
PART_KEYS = 500_000
MAX_LEVELS = 40


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty if it is null or has no ``://``."""
    pattern = r"(?s)://([^/?#]*)([^?#]*)"
    part = lambda n: F.coalesce(F.regexp_extract(url, pattern, n), F.lit(""))
    return ascii_lower(part(1)), part(2)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Candidate keys of a url, from the longest to the shortest: all parents of the host with all usable prefixes."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))

    def of_length(n: int) -> Column:
        return F.transform(hosts, lambda h: F.when(F.char_length(path) >= n, F.concat(h, F.substring(path, 1, n))))

    made = [of_length(n) for n in sorted(set(lengths), reverse=True)]
    return F.array_sort(F.array_compact(F.concat(*made)), lambda a, b: F.char_length(b) - F.char_length(a))


def probes(key: Column, level: int, bits: int, n: int = PROBES) -> list[Column]:
    """Bit positions of a key in a level."""
    a, b = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    return [F.pmod(F.shiftright(a, 4) + F.lit(i) * F.shiftright(b, 8), F.lit(bits).cast("long")) for i in range(n)]


def first_level(listed: int, universe: int) -> tuple[int, int]:
    """(bits a key, its places) for which about FALSE_SHARE * listed keys of the universe pass wrongly."""
    share = min(0.5, FALSE_SHARE * listed / max(universe, 1))
    places = max(PROBES, math.ceil(-math.log2(share)))
    return max(BITS_PER_KEY, math.ceil(places / math.log(2))), places


class BloomCascade:
    """Levels of bits for each part of the keys; `holds(key)` is a Column that is exact over the universe."""

    def __init__(self, listed: DataFrame, universe: DataFrame, part_keys: int = PART_KEYS):
        """Both have a string column `key`; universe may repeat keys and hold the listed ones."""
        listed = cut(listed.select("key").where("key is not null").distinct())
        outs = universe.select("key").where("key is not null")
        n = listed.count()
        keys = outs.agg(F.approx_count_distinct("key")).first()[0] if n else 0
        self.parts: list[list[tuple[int, int, list[int]]]] = []
        parts = max(1, -(-n // part_keys))
        for i in range(parts):
            mine = (listed, outs) if parts == 1 else (df.where(self._part(F.col("key"), parts) == i) for df in (listed, outs))
            self.parts.append(self._levels(*mine, keys // parts))

    @staticmethod
    def _part(key: Column, parts: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts))

    @classmethod
    def _levels(cls, listed: DataFrame, outs: DataFrame, keys: int) -> list[tuple[int, int, list[int]]]:
        """(bits, places of a key, the bits as words) of each level."""
        levels: list[tuple[int, int, list[int]]] = []
        ins = listed
        while len(levels) < MAX_LEVELS:
            n = ins.count()
            if not n:
                return levels
            each, places = (BITS_PER_KEY, PROBES) if levels else first_level(n, keys)
            bits = max(64, -(-n * each // 64) * 64)
            levels.append((bits, places, cls._bits(ins, len(levels), bits, places)))
            passed = outs.where(cls._passes(F.col("key"), levels, len(levels) - 1)).distinct()
            if len(levels) == 1:
                passed = passed.join(listed, "key", "left_anti")
            ins, outs = cut(passed), ins
        raise ValueError(f"no exact cascade in {MAX_LEVELS} levels")

    @staticmethod
    def _bits(keys: DataFrame, level: int, bits: int, places: int) -> list[int]:
        words = keys.select(F.explode(F.array(*probes(F.col("key"), level, bits, places))).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))).alias("bits"))
        found = {r["word"]: r["bits"] for r in words.collect()}
        return [found.get(i, 0) for i in range(bits // 64)]

    @staticmethod
    def _passes(key: Column, levels: list[tuple[int, int, list[int]]], level: int) -> Column:
        bits, places, words = levels[level]
        data = F.from_json(F.lit("[" + ",".join(map(str, words)) + "]"), "array<bigint>")
        at = F.array(*probes(key, level, bits, places))
        return F.forall(at, lambda p: F.getbit(F.get(data, F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)

    def holds(self, key: Column) -> Column:
        answers = []
        for levels in self.parts:
            out = F.lit(len(levels) % 2 == 1)
            for i in reversed(range(len(levels))):
                out = F.when(~self._passes(key, levels, i), F.lit(i % 2 == 1)).otherwise(out)
            answers.append(out)
        if len(answers) == 1:
            return answers[0]
        of = self._part(key, len(answers))
        out = F.lit(False)
        for i, answer in enumerate(answers):
            out = F.when(of == i, answer).otherwise(out)
        return out


def url_filter(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule (key of the longest rule that fits, else null) and verdict added.

    A rule fits its host and all subdomains if the path starts with the
    rule's; of several the longest wins.  Null urls and urls without ``://``
    have an empty host and path and get the default verdict.  Of rules that
    tie in length the one with the longer path wins, as only their hosts
    differ; a rule listed twice counts once, with the verdict last by name.
    Repeated rows are each judged, urls of any length whole; an empty table
    gives an empty result.  Existing columns named host, path, rule or
    verdict are replaced, others kept.
    """
    spark = pages.sparkSession
    lengths = [len(r.path) for r in rules]
    host, path = url_parts(F.col(url))
    keys = candidate_keys(F.col("host"), F.col("path"), lengths or [0])
    parts = pages.withColumns({"host": host, "path": path})
    universe = parts.select(F.explode(keys).alias("key"))
    found = {}
    for verdict in sorted({r.verdict for r in rules}):
        listed = spark.range(1).select(F.explode(F.array(*(F.lit(r.key) for r in rules if r.verdict == verdict))).alias("key"))
        found[verdict] = BloomCascade(listed, universe)

    def judged(k):
        answer = F.lit(None).cast("string")
        for verdict, cascade in found.items():
            answer = F.when(cascade.holds(k), F.lit(verdict)).otherwise(answer)
        return F.struct(k.alias("rule"), answer.alias("verdict"))

    hit = unused(parts, "hit")
    out = parts.withColumn(hit, F.get(F.filter(F.transform(keys, judged), lambda h: h["verdict"].isNotNull()), 0))
    return out.withColumns({"rule": F.col(hit + ".rule"), "verdict": F.coalesce(hit + ".verdict", F.lit(default))}).drop(hit)
