"""URL lists as cascades of Bloom filters: exact for every key of the corpus, without a join.

The key universe is every (host suffix, path start) and every host word that occurs in the urls. The first filter holds
the listed keys of the universe; the next holds the keys outside the list that the first lets through; the next the listed keys that
the second lets through; and so on, until no key is told wrongly. A key is listed if the first filter that
it fails has an odd number (from 0).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chunkloom.session import written

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a filter, which travels as one literal. The first of a cascade holds about 1.44 * log2(keys of the universe / listed keys) bits for
#: each listed key; longer lists are split by a hash of the key into as many cascades as it takes.
MOST_BITS = 1 << 26
#: Words of host labels (parted by hyphens) that are listed besides the rules.
BLOCKED_WORDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam")


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


@dataclass(frozen=True)
class Level:
    seeds: tuple[int, ...]
    bits: int
    words: tuple[int, ...]

    def holds(self, key: Column) -> Column:
        words = F.lit(list(self.words)).cast("array<bigint>")
        places = F.array(*[F.pmod(F.xxhash64(F.lit(seed), key), F.lit(self.bits)) for seed in self.seeds])
        return F.forall(places, lambda at: F.getbit(F.element_at(words, (at / 64).cast("int") + 1), F.pmod(at, F.lit(64)).cast("int")) == 1)


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts))


def contains(cascades: Sequence[Sequence[Level]], key: Column) -> Column:
    """Whether a key of the universe is listed, by the cascade of its part."""
    found = [_listed(cascade, key) for cascade in cascades]
    out = found[-1]
    for part in reversed(range(len(cascades) - 1)):
        out = F.when(_part(key, len(cascades)) == part, found[part]).otherwise(out)
    return out


def _listed(cascade: Sequence[Level], key: Column) -> Column:
    out = F.lit(len(cascade) % 2 == 1)
    for i in reversed(range(len(cascade))):
        out = F.when(~cascade[i].holds(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


def _hashes(rate: float) -> int:
    return max(1, round(-math.log2(rate)))


def _level(keys: DataFrame, n: int, rate: float, number: int) -> Level:
    hashes = _hashes(rate)
    bits = max(64, 64 * math.ceil(1.4427 * n * hashes / 64))
    seeds = tuple(1000 * number + i for i in range(hashes))
    places = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(s), "key"), F.lit(bits)) for s in seeds]))
    set_bits = keys.select(places.alias("at")).groupBy((F.col("at") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mask")
    )
    words = [0] * (bits // 64)
    for word, mask in set_bits.collect():  # as many rows as the filter has words, at most
        words[word] = mask
    return Level(seeds, bits, tuple(words))


def _table(spark: SparkSession, rows: DataFrame | Sequence[Sequence[str]], *names: str) -> DataFrame:
    """A short list as a table of literals, without a Python worker; a table stays as it is."""
    if isinstance(rows, DataFrame):
        return rows
    nothing = F.struct(*[F.lit(None).cast("string").alias(n) for n in names])
    made = [F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*(made or [nothing])))).where(F.lit(bool(made)))


def build_cascades(universe: DataFrame, listed: DataFrame | Sequence[str], most_bits: int | None = None) -> list[list[Level]]:
    """``universe`` holds distinct strings in ``key`` and is read several times; ``listed`` is the list to tell apart in it, a sequence or a table with ``key``."""
    listed = _table(universe.sparkSession, listed if isinstance(listed, DataFrame) else [(k,) for k in listed], "key")
    marks = listed.select("key").distinct().withColumn("listed", F.lit(True))
    marked = written(universe.join(marks, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "marked-keys")
    n_listed, n_all = marked.agg(F.count_if("listed"), F.count(F.lit(1))).head()
    rate = min(0.5, max(1e-9, math.sqrt(0.5) * n_listed / max(1, n_all - n_listed)))
    parts = max(1, math.ceil(1.4427 * n_listed * _hashes(rate) / (most_bits or MOST_BITS)))
    return [_cascade(marked.where(_part(F.col("key"), parts) == part) if parts > 1 else marked, rate) for part in range(parts)]


def _cascade(marked: DataFrame, rate: float) -> list[Level]:
    levels: list[Level] = []
    now, other = marked.where("listed"), marked.where("not listed")
    while n := now.count():
        level = _level(now, n, rate if not levels else 0.5, len(levels))
        levels.append(level)
        now, other = other.where(level.holds(F.col("key"))), now
    return levels


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null and where ``://`` is missing."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWERED), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _candidates(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """(length, text, key) of every host suffix with every path start as long as some rule's path."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())

    def one(suffix, start):
        text = F.concat(suffix, start)
        return F.struct(F.length(text).alias("n"), text.alias("rule"), F.concat(suffix, F.lit(" "), start).alias("key"))

    return F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: one(s, p))))


def _word_keys(host: Column) -> Column:
    return F.transform(F.array_distinct(F.split(host, "[.-]")), lambda w: F.concat(F.lit("word "), w))


def judged(
    pages: DataFrame, rules: DataFrame | Sequence[Rule], blocked_words: DataFrame | Sequence[str] = BLOCKED_WORDS, id_column: str = "page_id", url_column: str = "url"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed_word) for every row.

    ``rules`` are tables or sequences of (verdict, host, path), ``blocked_words`` of words (``word``). The longest fitting rule decides; of equally long ones the greater text, and allow before block for the same text.
    Where no rule fits, a listed word among the words of the host blocks, and everything else is allowed. A null url, or one
    without ``://``, has an empty host and path and is allowed. Rows that repeat, or have no id, are judged one by one; an empty table gives
    no rows, and columns beside the two named are not looked at.
    """
    spark = pages.sparkSession
    rules = _table(spark, [(r.verdict, r.host, r.path) for r in rules] if not isinstance(rules, DataFrame) else rules, "verdict", "host", "path")
    blocked = _table(spark, [(w,) for w in blocked_words] if not isinstance(blocked_words, DataFrame) else blocked_words, "word")
    host, path = url_parts(F.col(url_column).cast("string"))
    urls = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())  # as many as the longest path has characters
    keyed = urls.select("*", _candidates(F.col("host"), F.col("path"), lengths).alias("fits"), _word_keys(F.col("host")).alias("words"))
    # Keys of the same task are made distinct before they are shuffled; a host with a third of all urls stays a few keys.
    universe = written(keyed.select(F.explode(F.concat(F.transform("fits", lambda c: c["key"]), "words")).alias("key")).distinct(), "url-keys")
    of_rule = F.concat("host", F.lit(" "), "path").alias("key")
    lists = [rules.where(F.col("verdict") == v).select(of_rule) for v in ("allow", "block")] + [blocked.select(F.concat(F.lit("word "), "word").alias("key"))]
    allow, block, words = (build_cascades(universe, keys) for keys in lists)
    fitting = F.filter("fits", lambda c: contains(allow, c["key"]) | contains(block, c["key"]))
    best = keyed.select("page_id", "host", "path", F.array_max(fitting).alias("best"), F.exists("words", lambda w: contains(words, w)).alias("listed_word"))
    verdict = F.when(F.col("best").isNotNull(), F.when(contains(allow, F.col("best.key")), "allow").otherwise("block")).otherwise(F.when(F.col("listed_word"), "block").otherwise("allow"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "listed_word")
