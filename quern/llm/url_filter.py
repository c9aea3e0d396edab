"""URL filters by a Bloom filter cascade, in DataFrame functions only.

Every url has a key: its host and as many leading path segments as the longest rule path has. The universe
is all keys of the corpus, the listed keys are those whose rule says block. Level 0 is a Bloom filter of the
listed keys; level 1 encodes the unlisted keys that level 0 lets pass, level 2 the listed ones that level 1 lets
pass, and so on until a level lets nothing false pass. A key's first level without it decides: exact for every
key of the universe, with no join. The levels are constants of the plan, each once, and none has more than `most_bits`
bits: keys are cut by hash into as many sections as the listed keys, and the unlisted ones that level 0 is expected to
let pass, ask for, each section with a cascade of its own; if a level comes out above the bound all the same, there are
twice as many sections. One pass over the urls serves PASS sections, each row by its own section's bits.

Defined results: a null url, or one without ://, has empty host and path and no rule; repeated rows get equal
verdicts; urls are read whole, however long; other columns are kept out; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import written

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Bits for each key of a level and bits set for each, for about 1 in 100 false; bits that one level may have.
BITS, SET, MOST_BITS = 10, 5, 1 << 25
#: Share of other keys that a level lets pass, rounded up; sections that one pass over the urls serves.
FALSE, PASS = 0.012, 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) after the first :// and the path up to ? or #; both empty without ://."""
    begin = F.instr(url, "://")
    rest = F.when(begin > 0, F.substring(url, begin + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says; nulls if none does."""
    which, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, p = split_rule(rule)
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        which, says = F.when(fits, rule).otherwise(which), F.when(fits, verdict).otherwise(says)
    return which, says


def key_of(host: Column, path: Column, rules=RULES) -> Column:
    """Host and leading path: rules can tell no two urls with one key apart."""
    slashes = max((split_rule(r)[1].count("/") for r, _ in rules), default=0)
    if slashes == 0:
        return F.concat(host, F.lit(" "))
    open_end = any(not r.endswith("/") for r, _ in rules)
    lead = path if open_end else F.regexp_extract(path, "^" + "(?:[^/]*/)" + f"{{0,{slashes}}}", 0)
    return F.concat(host, F.lit(" "), lead)


class LevelTooLarge(OverflowError):
    """A level would have more bits than it may."""


class Level:
    """A Bloom filter as an array of 64-bit words that the plan carries as a constant."""

    def __init__(self, keys: DataFrame, count: int, number: int, most_bits: int):
        self.words = max(1, math.ceil(count * BITS / 64))
        if self.words * 64 > most_bits:
            raise LevelTooLarge(f"a level of {count} keys is above {most_bits} bits")
        self.number = number
        bit = keys.select(F.explode(F.array(*self.places(F.col("key")))).alias("at"))
        found = bit.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits"))
        held = [0] * self.words
        for r in found.collect():  # at most `words` rows, which the check above bounds
            held[r.word] = r.bits
        self.bits = F.split(F.lit(",".join(map(str, held))), ",").cast("array<bigint>")

    def places(self, key: Column) -> list[Column]:
        h = F.xxhash64(key, F.lit(self.number))
        a, b = F.shiftrightunsigned(h, 33), h.bitwiseAND(F.lit(0x7FFFFFFF)).bitwiseOR(F.lit(1))
        return [F.pmod(a + F.lit(i) * b, F.lit(self.words * 64)) for i in range(SET)]

    def has(self, key: Column) -> Column:
        return F.forall(F.array(*self.places(key)), lambda at: F.call_function("shiftright", F.get(self.bits, F.floor(at / 64).cast("int")), (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)


class Cascade:
    """Exact membership for every key of a universe (key, listed), which should be a written table."""

    def __init__(self, universe: DataFrame, most_bits: int = MOST_BITS):
        self.levels: list[Level] = []
        sides = {True: universe.where("listed").select("key"), False: universe.where("not listed").select("key")}
        side = True
        while count := sides[side].count():
            level = Level(sides[side], count, len(self.levels), most_bits)
            self.levels.append(level)
            sides[not side] = sides[not side].where(level.has(F.col("key")))
            side = not side

    def has(self, key: Column) -> Column:
        """Listed or not. Level i lets through all that it encodes; the first that doesn't let a key through decides."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(self.levels[i].has(key), answer).otherwise(F.lit(i % 2 == 1))
        return answer


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", most_bits: int = MOST_BITS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page: the longest fitting rule's verdict as the cascade holds it, allow if none fits."""
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", key_of(F.col("host"), F.col("path"), rules))
    which, says = rule_of(F.col("host"), F.col("path"), rules)
    listed = F.coalesce(says == "block", F.lit(False))
    universe = written(urls.groupBy("key").agg(F.max(listed).alias("listed")), "universe")
    of, cascades = sections(universe, most_bits)
    out = []
    for begin in range(0, len(cascades), PASS):
        own = cascades[begin : begin + PASS]
        blocked = F.lit(False)
        for s, cascade in enumerate(own, begin):
            blocked = cascade.has(F.col("key")) if len(cascades) == 1 else F.when(of(F.col("key")) == s, cascade.has(F.col("key"))).otherwise(blocked)
        some = urls if len(cascades) <= PASS else urls.where(of(F.col("key")).between(begin, begin + len(own) - 1))
        out.append(some.select(id_col, "host", "path", which.alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict")))
    return reduce(DataFrame.union, out)


def sections(universe: DataFrame, most_bits: int = MOST_BITS) -> tuple[Callable[[Column], Column], list[Cascade]]:
    """The section of a key, and a cascade for each section."""
    n = dict(universe.groupBy("listed").count().collect())
    most = max(n.get(True, 0), n.get(False, 0) * FALSE if n.get(True) else 0)
    many = max(1, math.ceil(most * BITS / (most_bits * 0.9)))
    while True:
        of = lambda key, many=many: F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(many))
        try:
            return of, [Cascade(universe if many == 1 else universe.where(of(F.col("key")) == s), most_bits) for s in range(many)]
        except LevelTooLarge:
            many *= 2


#: The whole operator with the default rules in DuckDB SQL, over the view pages.
SQL = """
with rest as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
split as (
  select page_id, regexp_extract(rest, '^[^/?#]*') as given, rest from rest),
parts as (
  select page_id, translate(given, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(given) + 1), '^[^?#]*') as path from split),
ruled as (
  select *, case
    when ('.' || host) like '%.example.net' and starts_with(path, '/en/') then 'example.net/en/'
    when ('.' || host) like '%.example.com' and starts_with(path, '/de/') then 'example.com/de/'
    when ('.' || host) like '%.org' and starts_with(path, '/fr/') then 'org/fr/'
    when ('.' || host) like '%.net' and starts_with(path, '/') then 'net/' end as rule from parts)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from ruled
"""
