"""URL filters by a Bloom filter cascade (operator 4), in DataFrame operations only.

Every URL has keys: its host and each parent domain with no more labels than the longest
host of rules or list, and each of these followed by the start of its path in the lengths
that rules have.  A cascade answers exactly, for every
key of the corpus, whether it is listed: level 1 is a Bloom filter of the listed keys that
occur; level 2 holds the corpus's other keys that level 1 lets pass; level 3 the listed
keys that level 2 lets pass; and so on until nothing passes wrongly.  A key is listed if
the number of levels that hold it, from the first on, is odd.  Pages meet the cascade as
bit arrays inside expressions, without a join: BITS_EACH to twice as many bits a listed key,
in shards of 2**SHARD_BITS.  A built cascade can be saved and opened again for any URLs
whose keys are in the universe that it was built for.

Null URLs and URLs without ``://`` have an empty host and path and meet no rule; empty
lists and tables give cascades that hold nothing; repeated rows get equal verdicts; ties
can't occur (keys of one URL with equal length are equal); very long URLs are cut nowhere
(a longer domain than any listed or ruled one can't be in a list, so it is no key); other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.llm import scratch

#: Hash functions and bits a key of each level, at least; a level's bits are a power of two, in shards of at most 2**SHARD_BITS (4 MB).
HASHES, BITS_EACH, SHARD_BITS = 4, 12, 25

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and where ``://`` is missing."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def domains(host: Column, most: int) -> Column:
    """The host and its parent domains, as far as they have at most ``most`` labels; none for an empty host."""
    labels = F.split(host, r"\.")
    last = F.slice(labels, F.greatest(F.size(labels) - most + 1, F.lit(1)), F.lit(most))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(last)), lambda i: F.array_join(F.slice(last, i, F.lit(most)), ".")))


@dataclass
class Level:
    bits: int
    words: DataFrame  # one row: array<array<bigint>>, the shards
    seed: int

    def holds(self, key: Column) -> Column:
        shards = self.words.scalar()
        out = F.lit(True)
        for h in range(HASHES):
            at = F.pmod(F.xxhash64(key, F.lit(self.seed * HASHES + h)), F.lit(self.bits))
            word = F.get(F.get(shards, F.shiftright(at, SHARD_BITS).cast("int")), F.shiftright(at.bitwiseAND(F.lit((1 << SHARD_BITS) - 1)), 6).cast("int"))
            out = out & (F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return out


class Cascade:
    """Exact membership of keys of a known universe in a list."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, universe: DataFrame, listed: DataFrame) -> Cascade:
        """``universe`` and ``listed``: DataFrames with one column, key; the universe is read as often as there are levels."""
        inside = universe.join(listed.select("key").distinct().withColumn("_listed", F.lit(True)), "key", "left")
        inside = scratch.stage(inside.select("key", F.coalesce("_listed", F.lit(False)).alias("listed")), "universe")
        levels: list[Level] = []
        encode, others = inside.where("listed").select("key"), inside.where("not listed").select("key")
        n = encode.count()
        while n:
            level = _level(encode, n, len(levels) + 1)
            levels.append(level)
            passed = scratch.stage(others.where(level.holds(F.col("key"))), "passed")
            encode, others, n = passed, encode, passed.count()
        return cls(levels)

    def save(self, path: str) -> None:
        """A folder for each level, which its bits and seed name."""
        for level in self.levels:
            level.words.write.option("compression", "zstd").parquet(f"{path}/level={level.seed}/bits={level.bits}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Cascade:
        every = spark.read.schema("words array<array<bigint>>, level int, bits bigint").parquet(path)
        found = sorted((r["level"], r["bits"]) for r in every.select("level", "bits").collect())  # a row a level
        return cls([Level(bits, spark.read.schema("words array<array<bigint>>").parquet(f"{path}/level={seed}/bits={bits}"), seed) for seed, bits in found])

    def holds(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            out = F.when(self.levels[i - 1].holds(key), out).otherwise(F.lit(i % 2 == 0))
        return out


def _level(keys: DataFrame, n: int, seed: int) -> Level:
    bits = 1 << (max(64, n * BITS_EACH) - 1).bit_length()
    each = min(bits, 1 << SHARD_BITS)
    places = keys.select(F.explode(F.array(*[F.pmod(F.xxhash64("key", F.lit(seed * HASHES + h)), F.lit(bits)) for h in range(HASHES)])).alias("at"))
    found = places.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("v"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("v"))
    dense = found.unionByName(every).groupBy("w").agg(F.bit_or("v").alias("v"))
    ordered = lambda *c: F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x[c[-1]])
    shards = dense.groupBy(F.floor(F.col("w") * 64 / each).alias("s")).agg(ordered("w", "v").alias("words"))  # each of bounded size
    return Level(bits, scratch.stage(shards.agg(ordered("s", "words").alias("words")), "level"), seed)


def _rule_parts(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def judge_urls(pages: DataFrame, block: list[str], allow: list[str], listed_hosts: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every page.

    Rules are written ``host/path-start`` and fit the host and its subdomains; the longest
    wins.  Without a rule, pages of hosts in ``listed_hosts`` (column key; with their
    subdomains) are blocked and all others allowed.  The rules are a short written list;
    ``listed_hosts`` can be of any size.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    lengths = sorted({len(_rule_parts(r)[1]) for r in [*block, *allow]})
    starts = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda x: x.isNotNull()) if lengths else F.array().cast("array<string>")
    named = listed_hosts.agg(F.max(F.size(F.split("key", r"\."))).alias("n")).first()["n"]
    most = max([1, named or 0, *[_rule_parts(r)[0].count(".") + 1 for r in [*block, *allow]]])
    hosts = domains(F.col("host"), most)
    rule_keys = F.flatten(F.transform(hosts, lambda d: F.transform(starts, lambda s: F.concat(d, s))))
    # the keys of three lists in one universe, told apart by their first characters
    both = F.concat(F.transform(rule_keys, lambda k: F.concat(F.lit("rule "), k)), F.transform(hosts, lambda k: F.concat(F.lit("host "), k)))
    keyed = parts.withColumn("_row", F.monotonically_increasing_id()).withColumn("key", F.explode_outer(both))
    as_block = F.concat(F.lit("block "), F.substring("key", 6, 1 << 30))
    universe = keyed.select(F.explode(F.when(F.startswith("key", F.lit("rule ")), F.array("key", as_block)).otherwise(F.array("key"))).alias("key")).where("key is not null").distinct()
    written = [f"rule {''.join(_rule_parts(r))}" for r in [*block, *allow]] + [f"block {''.join(_rule_parts(r))}" for r in block]
    lists = spark.createDataFrame([(k,) for k in written], "key string").unionByName(listed_hosts.select(F.concat(F.lit("host "), F.translate("key", _UPPER, _LOWER)).alias("key")))
    cascade = Cascade.build(universe, lists)
    hits = keyed.withColumn("hit", cascade.holds(F.col("key"))).withColumn("blocks", cascade.holds(as_block))
    is_rule = F.startswith("key", F.lit("rule "))
    # a page's keys are made in one task and summed there: one row a page is shuffled
    out = hits.groupBy("_row", id_col, "host", "path").agg(
        F.max(F.when(F.col("hit") & is_rule, F.struct(F.length("key").alias("n"), F.substring("key", 6, 1 << 30).alias("rule"), "blocks"))).alias("r"),
        F.coalesce(F.max(F.col("hit") & ~is_rule), F.lit(False)).alias("listed"),
    )
    blocked = F.when(F.col("r").isNotNull(), F.col("r.blocks")).otherwise(F.col("listed"))
    return out.select(id_col, "host", "path", F.col("r.rule").alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"), "listed")


#: The rules of the query, and hosts that are listed for spam and tracking.
BLOCK_RULES, ALLOW_RULES = ["net/", "example.com/de/"], ["example.net/en/", "org/fr/"]
LISTED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_HOSTS = [f"{name}.example.{end}" for name in LISTED_NAMES for end in ("com", "net", "org")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, BLOCK_RULES, ALLOW_RULES, spark.createDataFrame([(h,) for h in LISTED_HOSTS], "key string"))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r AS (
  SELECT *, CASE
      WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    regexp_matches(host, '^(.*\\.)?(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\\.example\\.(com|net|org)$') AS listed
  FROM h
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM r
"""
