"""URL filter: a blocked Bloom filter of listed canonical URL keys, then an exact hash join.

A rule lists a host and a path; it fits that host and all its subdomains, where the path of the
URL starts with the rule's. The filter's keys are (host, path). A page's candidate keys are its
host's suffixes and its path's prefixes of the shapes (labels, path length) that rules have; a
Bloom filter of 64-bit blocks passes the few candidates that may be listed, and a hash join with
the rules removes false positives. The longest rule of a page wins.

DataFrame functions only. The filter has a fixed upper size; a list too long for it lets more
false positives through to the join, which stays exact. Rows keep their identity, so that a host
with a third of all rows does not gather anywhere. Null URLs and those without ``://`` have an
empty host and path and fit no rule; repeated rows give repeated results; an empty list allows
all. Rules with a null host, path or verdict are ignored; of equal rules, ``block`` wins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, joined

#: Bits of a key within its block, bits of the filter for each key, and the most blocks (0.5 MB).
HASHES, BITS_A_KEY, MOST_BLOCKS = 4, 16, 1 << 16


def ascii_lower(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The URL's lower-cased host and its path, both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return ascii_lower(host), path


def _block(host: Column, path: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(host, path), F.lit(blocks)).cast("int")


def _mask(host: Column, path: Column) -> Column:
    """The bits that a key sets in its block."""
    other = F.xxhash64(path, host)
    mask = F.lit(0).cast("bigint")
    for i in range(HASHES):
        bit = F.shiftrightunsigned(other, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return mask


def bloom(rules: DataFrame, blocks: int) -> Column:
    """The filter as one constant array of blocks."""
    set_bits = rules.select(_block(F.col("host"), F.col("path"), blocks).alias("b"), _mask(F.col("host"), F.col("path")).alias("m"))
    words = [0] * blocks
    for b, m in set_bits.groupBy("b").agg(F.bit_or("m")).collect():  # ``blocks`` rows at most
        words[b] = m
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (host, path, verdict) in the driver."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule`` and ``verdict`` of every row; a URL that no rule
    fits gets a null rule and ``default``."""
    listed = cut(
        rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict")
        .where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    )
    n_labels = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit(""))) + 1
    # the rules' shapes: few, as a host has 127 labels at most and listed paths are short
    shapes = sorted(map(tuple, listed.select(n_labels.alias("n"), F.length("path").alias("k")).distinct().collect()))
    total = listed.count()
    blocks = 1
    while blocks * 64 < total * BITS_A_KEY and blocks < MOST_BLOCKS:
        blocks *= 2
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    if not shapes:
        return rows.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    candidates = F.array(*(
        F.when((n_labels >= n) & (F.length("path") >= k), F.struct(F.substring_index("host", ".", -n).alias("host"), F.substring("path", 1, k).alias("path")))
        for n, k in shapes
    ))
    words = bloom(listed, blocks)

    def may_be_listed(key: Column) -> Column:
        mask = _mask(key["host"], key["path"])
        return key.isNotNull() & (F.get(words, _block(key["host"], key["path"], blocks)).bitwiseAND(mask) == mask)

    possible = rows.select("*", F.explode_outer(F.filter(candidates, may_be_listed)).alias("key"))
    possible = possible.select(id_col, "host", "path", "row", F.col("key.host").alias("key_host"), F.col("key.path").alias("key_path"))
    exact = listed.select(F.col("host").alias("key_host"), F.col("path").alias("key_path"), F.col("verdict").alias("listed_as"))
    judged = joined(possible, exact, ["key_host", "key_path"], "left")
    rule = F.concat("key_host", "key_path")
    best = F.max(F.when(F.col("listed_as").isNotNull(), F.struct(F.length(rule), F.length("key_host"), rule.alias("rule"), F.col("listed_as").alias("verdict"))))
    found = judged.groupBy("row").agg(
        F.first(id_col).alias(id_col), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best")
    )
    return found.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
