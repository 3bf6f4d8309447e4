"""URL rules through a blocked Bloom filter and an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path) of the rules that the query applies.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Keys to a block of four 64-bit words, about; more where MAX_BLOCKS is reached, which costs exactness nothing.
KEYS_PER_BLOCK = 16
#: Blocks at most: the filter that is broadcast never exceeds some 16 MB.
MAX_BLOCKS = 1 << 18


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(_rest(url), "#", 1))
    host = F.substring_index(F.substring_index(rest, "?", 1), "/", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    rest = F.substring_index(F.substring_index(_rest(url), "#", 1), "?", 1)
    return F.when(F.instr(url, "://") > 0, F.when(F.instr(rest, "/") > 0, rest.substr(F.instr(rest, "/"), F.length(rest))).otherwise(F.lit(""))).otherwise(F.lit(""))


def _rest(url: Column) -> Column:
    return url.substr(F.instr(url, "://") + 3, F.length(url))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "verdict string, host string, path string")


def _hash(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(key, F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    """A bit in each of a block's four words, by disjoint bits of a second hash."""
    second = F.xxhash64(key, F.lit(7))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]


def bloom(rules: DataFrame, blocks: int) -> DataFrame:
    """The filter as a table ``block, w0 .. w3``: each key sets a bit in every word of one block."""
    key = _hash(F.col("host"), F.col("path"))
    rows = rules.select(_block(key, blocks).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(_masks(key))])
    return rows.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(4)])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.

    A rule fits its host and all subdomains where the url's path starts with the rule's. The longest rule (host
    and path) wins; of equally long ones that with the longer host, then the first in order. Each distinct
    (host, path) of the pages gives the keys that a fitting rule could have: every parent domain of at most as many labels as the longest rule's host with every prefix
    of a length that occurs among the rules. The Bloom filter, joined on its block, passes possible hits; an
    exact join on host and path removes false positives. A page that no rule fits gets ``default`` and a null rule.
    Null urls and urls without ``://`` have empty host and path. Repeated rows and null ids keep their rows; an empty
    table gives an empty one; other columns are not read; rules without host or path are ignored, of repeated rules
    ``allow`` comes first.
    """
    rules = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.min("verdict").alias("rule_verdict"))
    known = rules.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths"), F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(1)).alias("labels")).first()
    blocks = max(1, min(MAX_BLOCKS, known["n"] // KEYS_PER_BLOCK + 1))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    places = rows.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    # No rule has more labels than the longest rule's host, so a page's host has no more parents than that, however long it is.
    parents = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    places = places.withColumn("labels", F.slice(labels, F.greatest(F.lit(1), F.size(labels) - (known["labels"] - 1)), F.lit(known["labels"])))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in known["lengths"] or [0]]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = places.select("host", "path", F.explode(parents).alias("rule_host"), prefixes.alias("prefixes")).select("host", "path", "rule_host", F.explode("prefixes").alias("rule_path"))
    key = _hash(F.col("rule_host"), F.col("rule_path"))
    keys = keys.withColumn("block", _block(key, blocks))
    hits = keys.join(F.broadcast(bloom(rules, blocks)), "block")
    for i, mask in enumerate(_masks(key)):
        hits = hits.where(F.col(f"w{i}").bitwiseAND(mask) == mask)
    exact = hits.select("host", "path", "rule_host", "rule_path").join(rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "rule_verdict"), ["rule_host", "rule_path"])
    # The largest struct is the longest rule.
    best = exact.groupBy("host", "path").agg(F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("m"), F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict")).alias("best"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
