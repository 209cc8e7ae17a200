"""URL filter: exact membership from a cascade of Bloom filters (DataFrame functions only).

Level 0 of a cascade encodes the listed keys. Level 1 encodes those other keys of the corpus that
level 0 takes for listed, level 2 the listed keys that level 1 takes for its own, and so on until a
level deceives nobody. A key of that corpus is listed if it passes an odd number of levels in a
row, with no error. Each level holds, per 64-bit word, a few bits of every key hashed there, and is
an array of longs that reaches the tasks as a scalar subquery: rows are judged without a join.

Cases: a null url, or one without `://`, has an empty host and path and no rule fits it. Repeated
rows and repeated ids are judged each on its own. Other columns of the input are ignored. An empty
list makes a cascade that lists nothing."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perimeter.llm.common import LOWER, UPPER
from perimeter.storage import materialize

#: Bits a filter holds per key, and bits set per key.
BITS_PER_KEY, BITS_SET = 16, 4
#: Most listed keys whose filter may be sent to every task (16 bits each: 16 MB). Longer lists are joined.
MAX_LISTED = 8_000_000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


@dataclass
class Level:
    """One Bloom filter: a one-row frame holding an array of `size` 64-bit words."""

    bits: DataFrame
    size: int
    seed: int

    def slot(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.seed)), F.lit(self.size))

    def mask(self, key: Column) -> Column:
        h = F.xxhash64(F.lit(self.seed), key)
        out = F.lit(0).cast("long")
        for i in range(BITS_SET):
            place = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
            out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
        return out

    def holds(self, key: Column) -> Column:
        mask = self.mask(key)
        return F.get(self.bits.scalar(), self.slot(key).cast("int")).bitwiseAND(mask) == mask

    @staticmethod
    def of(keys: DataFrame, count: int, seed: int) -> Level:
        """Filter over the column `key`."""
        size = max(1, ceil(count * BITS_PER_KEY / 64))
        blank = Level(keys, size, seed)
        put = keys.select(blank.slot(F.col("key")).alias("slot"), blank.mask(F.col("key")).alias("word"))
        every = keys.sparkSession.range(size).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("word"))
        words = put.unionByName(every).groupBy("slot").agg(F.bit_or("word").alias("word"))
        row = words.agg(F.sort_array(F.collect_list(F.struct("slot", "word"))).alias("w"))
        return Level(materialize(row.select(F.transform("w", lambda x: x["word"]).alias("words"))), size, seed)


@dataclass
class Cascade:
    levels: list[Level]

    @staticmethod
    def over(listed: DataFrame, universe: DataFrame, max_levels: int = 40) -> Cascade:
        """Cascade of `listed` (column key) that is exact on `universe` (column key)."""
        inside = materialize(listed.select("key").filter("key IS NOT NULL").distinct())
        count, levels = inside.count(), []
        if not count:
            return Cascade([])
        levels.append(Level.of(inside, count, 0))
        fooled = universe.select("key").filter(levels[0].holds(F.col("key"))).distinct()
        outside = materialize(fooled.join(inside, "key", "left_anti"))
        while count := outside.count():
            if len(levels) == max_levels:
                raise RuntimeError(f"the cascade did not end in {max_levels} levels")
            levels.append(Level.of(outside, count, len(levels)))
            inside, outside = outside, materialize(inside.filter(levels[-1].holds(F.col("key"))))
        return Cascade(levels)

    def holds(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            out = F.when(level.holds(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def suffix(host: Column, labels: int) -> Column:
    """The last `labels` labels of a host (all of it, if it has fewer)."""
    return F.substring_index(host, ".", -labels)


def literal_keys(spark: SparkSession, keys: list[str]) -> DataFrame:
    listed = F.array(*[F.lit(k) for k in keys]) if keys else F.array().cast("array<string>")
    return spark.range(1).select(F.explode(listed).alias("key"))


def filter_urls(pages: DataFrame, rules: list[Rule], blocked: DataFrame, keep: list[str], url: str = "url") -> DataFrame:
    """The columns `keep` of every row, and host, path, rule and verdict.

    `rules` is a short fixed list: the longest that fits gives the verdict. A rule fits its host and
    all subdomains if the path starts with the rule's. Where none fits, hosts in `blocked` (column
    key, any number) and their subdomains are blocked and all others allowed."""
    spark = pages.sparkSession
    host, path = split_url(F.col(url))
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    probes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    tried = [F.concat(suffix(F.col("host"), n), F.substring("path", 1, m)) for n, m in probes]
    names = rows.filter("host <> ''").select("host").distinct()
    blocked = blocked.filter("key IS NOT NULL").select(F.translate("key", UPPER, LOWER).alias("key")).distinct()
    tails = [r[0] for r in blocked.select(F.size(F.split("key", r"\.")).alias("n")).distinct().collect()]
    hosts = [suffix(F.col("host"), n) for n in sorted(tails)]
    by_rule = Cascade.over(literal_keys(spark, [r.key for r in rules]),
                           rows.select(F.explode(F.array(*tried) if tried else F.array().cast("array<string>")).alias("key")))
    rule_keys = literal_keys(spark, [r.key for r in rules])
    allows = Cascade.over(literal_keys(spark, [r.key for r in rules if r.verdict == "allow"]), rule_keys)
    hits = [F.when(by_rule.holds(k), F.struct(F.length(k), k)) for k in tried]
    best = F.greatest(*hits) if len(hits) > 1 else (hits or [F.lit(None).cast("struct<n:int,k:string>")])[0]
    judged = rows.withColumn("_best", best).withColumn("rule", F.col("_best").getField(
        "col2") if hits else F.lit(None).cast("string")).drop("_best")
    if blocked.count() <= MAX_LISTED:
        listing = Cascade.over(blocked, names.select(F.explode(F.array(*hosts)).alias("key")) if hosts else names.select(
            F.col("host").alias("key")))
        judged = judged.withColumn("_listed", F.coalesce(*[F.when(listing.holds(h), True) for h in hosts], F.lit(False))
                                   if hosts else F.lit(False))
    else:
        judged = judged.withColumn("_listed", F.lit(False))
        found = blocked.select("key", F.lit(True).alias("_hit"))
        for h in hosts:
            judged = (judged.withColumn("key", h).join(found, "key", "left")
                      .withColumn("_listed", F.col("_listed") | F.coalesce("_hit", F.lit(False))).drop("key", "_hit"))
    by_list = F.when(F.col("_listed"), F.lit("block")).otherwise(F.lit("allow"))
    by_rules = F.when(allows.holds(F.col("rule")), F.lit("allow")).otherwise(F.lit("block"))
    return judged.select(*keep, "host", "path", "rule",
                         F.when(F.col("rule").isNotNull(), by_rules).otherwise(by_list).alias("verdict"))
