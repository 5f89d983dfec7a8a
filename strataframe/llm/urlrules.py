"""URL rules by a blocked Bloom filter and an exact join.

A rule names a host and the beginning of a path; it fits its host and all subdomains. The canonical keys of all rules,
and of their hosts alone, go into a blocked Bloom filter: one hash picks a block of eight 64-bit words, another sets one
bit in every word of it, so that a test looks at one block. A page's own keys are the endings of its host and the
beginnings of its path that have the sizes found among the rules. Those that the filter lets pass are joined with the
rules by equality, which removes the false ones; the longest rule that is left decides.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.session import settle

WORDS = 8  # of 64 bits in a block; a key has one bit in each
BITS_PER_KEY = 16
MOST_BLOCKS = 1 << 17  # 8 MB: the proven bound of what reaches driver and tasks; beyond it the join has more to remove
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first `://` and `/`, `?`, `#` or the end, with A-Z in lower case, and then up to `?`, `#`
    or the end. Both are empty for a null url or one without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + F.lit(1), F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def bits(blocks: int, *key: Column) -> tuple[Column, list[Column]]:
    """Block of a key and its bit in each word."""
    second = F.xxhash64(F.lit(1), *key)
    return F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int"), [
        F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]


def build_filter(keys: DataFrame, most_blocks: int = MOST_BLOCKS) -> tuple[int, list[int]]:
    """Number of blocks and all words of a filter over `keys`, hashed by all their columns in order.

    Words are put together by a grouped bitwise or in Spark; the driver gets `most_blocks * 8` words at most.
    """
    n = keys.count()
    blocks = min(most_blocks, max(1, -(-n * BITS_PER_KEY // (64 * WORDS))))
    block, places = bits(blocks, *[F.col(c) for c in keys.columns])
    masks = keys.select(block.alias("block"), *[F.expr("1L").alias(f"one{i}") for i in range(WORDS)],
                        *[p.alias(f"p{i}") for i, p in enumerate(places)])
    made = masks.groupBy("block").agg(*[F.expr(f"bit_or(shiftleft(one{i}, p{i}))").alias(f"w{i}") for i in range(WORDS)])
    words = [0] * (blocks * WORDS)
    for r in made.collect():
        words[r["block"] * WORDS : (r["block"] + 1) * WORDS] = [r[f"w{i}"] for i in range(WORDS)]
    return blocks, words


def passes(found: tuple[int, list[int]], *key: Column) -> Column:
    """Whether a key may be in the filter; true for every key that is."""
    blocks, words = found
    table = F.from_json(F.lit(json.dumps(words)), "array<bigint>")  # folded into one constant
    block, places = bits(blocks, *key)
    out = F.lit(True)
    for i, p in enumerate(places):
        word = F.get(table, block * WORDS + i)
        out = out & (F.call_function("getbit", word, p) == 1)
    return out


def numbers(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(sorted(values))), "array<int>")


def possible_rules(host: Column, path: Column, endings: list[int], beginnings: list[int], hosts: tuple, keys: tuple) -> Column:
    """Array of (host, path) keys of a page that both filters let pass: first endings of the host, then with the path."""
    labels = F.size(F.split(host, r"\."))
    own_hosts = F.transform(F.filter(numbers(endings), lambda k: k <= labels), lambda k: F.call_function("substring_index", host, F.lit("."), -k))
    known = F.filter(own_hosts, lambda h: (h != "") & passes(hosts, h))
    cuts = F.filter(numbers(beginnings), lambda c: c <= F.length(path))
    made = F.flatten(F.transform(known, lambda h: F.transform(
        cuts, lambda c: F.struct(h.alias("host"), F.substring(path, F.lit(1), c).alias("path")))))
    return F.filter(made, lambda s: passes(keys, s["host"], s["path"]))


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow",
          most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """`page_id, host, path, rule, verdict` of every row of `pages`.

    `rules` has `host`, `path` and `verdict`; rows with a null in one of them or an empty host are no rules. The longest
    fitting rule, as the text host and path together, decides; of equally long ones that with the longer host, and `block`
    before `allow` where the same rule says both. Without a fitting rule `rule` is null and the verdict is `default`: an
    unlisted url is let through. Null urls and those without `://` have an empty host and path, which no rule fits; a rule
    whose path is not empty fits no url with an empty path. Repeated pages are judged each for itself and null ids pass.
    A url of any length is read whole: only as many endings and beginnings are tried as the rules have sizes. Other
    columns are ignored, so they may have any name; empty tables give an empty frame, and no rules give the default.
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").where(
        (F.col("host") != "") & F.col("path").isNotNull() & F.col("verdict").isNotNull())
    rules = settle(rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")), "rules")
    sizes = rules.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("h"), F.collect_set(F.length("path")).alias("p")).first()
    hosts, keys = build_filter(rules.select("host").distinct(), most_blocks), build_filter(rules.select("host", "path"), most_blocks)

    host, path = host_and_path(F.col(url))
    parts = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    hits = possible_rules(F.col("host"), F.col("path"), sizes["h"], sizes["p"], hosts, keys)
    probed = settle(parts.withColumn("hits", hits), "probed")
    fine = probed.where(F.size("hits") == 0)
    asked = probed.where(F.size("hits") > 0)

    once = asked.groupBy("host", "path").agg(F.first("hits").alias("hits"))
    tried = once.select(F.col("host").alias("own_host"), F.col("path").alias("own_path"), F.explode("hits").alias("hit")).select(
        "own_host", "own_path", F.col("hit.host").alias("host"), F.col("hit.path").alias("path"))
    rule = F.concat("host", "path")
    exact = tried.join(rules, ["host", "path"]).groupBy("own_host", "own_path").agg(F.max(F.struct(
        F.length(rule).alias("size"), F.length("host").alias("host_size"), rule.alias("rule"), "verdict")).alias("best"))
    judged = asked.alias("a").join(
        exact.alias("e"), (F.col("a.host") == F.col("e.own_host")) & (F.col("a.path") == F.col("e.own_path")), "left")
    out = judged.select("a.page_id", "a.host", "a.path", F.col("e.best.rule").alias("rule"),
                        F.coalesce("e.best.verdict", F.lit(default)).alias("verdict"))
    return out.unionByName(fine.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))
