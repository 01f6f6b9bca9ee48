"""URL rules, then a blocked Bloom filter in front of an exact join with listed URLs.

The filter is a table: one row per block of 512 bits, eight words of 64, one bit a word and
URL. A page looks at one block only. Pages that the filter lets through are possible hits;
the exact hash join with the listed canonical URLs removes the false ones. There are no false
negatives, so the filter never changes a result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.llm.base import lower_ascii
from stationflow.session import materialise

WORDS = 8
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BROADCAST_BLOCKS = 500_000  # of 72 bytes


def host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. and usual ports, path (/ if empty), query without tracking; null for
    what is no absolute URL. Scheme and fragment are left out."""
    h = F.regexp_replace(F.regexp_replace(host(url), "^www[.]", ""), ":(80|443)$", "")
    p = F.when(path(url) == "", "/").otherwise(path(url))
    query = F.regexp_extract(url, "://[^?#]*[?]([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^(utm_[a-z]+|ref)="))
    q = F.array_join(F.array_sort(kept), "&")
    return F.when(host(url) != "", F.concat(h, p, F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))))


def rule_of(h: Column, p: Column, rules=RULES) -> Column:
    """Struct rule, verdict of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((h == name) | h.endswith("." + name)) & p.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _bits(key: Column) -> list[Column]:
    return [F.expr(f"shiftleft(1L, pmod(xxhash64(__key, {j}), 64))") for j in range(WORDS)]


def bloom_table(keys: DataFrame, bits_per_key: int = 12) -> tuple[DataFrame, int]:
    """block, w0 ... w7 of the distinct ``__key``s, and the number of blocks."""
    blocks = max(1, math.ceil(keys.count() * bits_per_key / (64 * WORDS)))
    table = keys.select(F.expr(f"pmod(xxhash64(__key), {blocks})").alias("block"),
                        *[b.alias(f"w{j}") for j, b in enumerate(_bits(F.col("__key")))])
    return table.groupBy("block").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(WORDS)]), blocks


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES, bits_per_key: int = 12) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for each row of ``pages``.

    ``listed`` has a column url; its canonical forms are blocked where no rule fits. Null or
    relative urls have empty host and path, fit no rule, are never listed and are allowed.
    Repeated rows each give a row. With an empty list only the rules block.
    """
    keys = materialise(listed.select(canonical(F.col("url")).alias("__key")).where("__key IS NOT NULL").distinct(), "listed")
    table, blocks = bloom_table(keys, bits_per_key)
    if blocks <= BROADCAST_BLOCKS:
        table = F.broadcast(table)
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
                        canonical(F.col("url")).alias("__key"))
    rows = rows.withColumn("block", F.expr(f"pmod(xxhash64(__key), {blocks})"))
    probed = rows.join(table, "block", "left")
    possible = F.col("__key").isNotNull()
    for j, b in enumerate(_bits(F.col("__key"))):
        possible = possible & (F.col(f"w{j}").bitwiseAND(b) == b)
    probed = probed.withColumn("possible", F.coalesce(possible, F.lit(False))).select(
        "page_id", "host", "path", "__key", "possible")
    hits = probed.where("possible").join(keys.withColumn("listed", F.lit(True)), "__key", "left")
    out = hits.unionByName(probed.where("NOT possible").withColumn("listed", F.lit(False)))
    out = out.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn(
        "listed", F.coalesce("listed", F.lit(False)))
    return out.select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
