"""URL rules, and a list of canonical URLs behind a blocked Bloom filter.

DataFrame functions only.  The filter is a table of 256-bit blocks, four longs
each, that an aggregation makes from the listed URLs: a URL's first hash names
its block, a second one sets two bits in each long.  A page goes on as a
possible hit if its block has all its bits; an exact join with the list then
removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, small

#: Bits of the filter for each listed URL.
BITS = 16
#: Blocks that may be broadcast: 48 bytes each, so 24 MB at most.  A larger filter is joined by its block number.
BROADCAST_BLOCKS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One name for a page: no ``www.`` or ``m.`` before the host, no ``.html`` or slash after the path."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/)+$", ""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest of (verdict, host, path) that fits; null if none does.

    ``rules`` is a short list of code: its entries become branches of one expression.
    """
    rule = verdict = F.lit(None).cast("string")
    for name, domain, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        rule, verdict = F.when(fits, domain + start).otherwise(rule), F.when(fits, name).otherwise(verdict)
    return rule, verdict


def _bits(url: str, i: int) -> str:
    """Bits of a URL in long ``i`` of its block, as SQL over the column ``url``."""
    place = [f"cast(shiftrightunsigned(xxhash64({url}, 'bits'), {12 * i + k}) & 63 as int)" for k in (0, 6)]
    return f"(shiftleft(1L, {place[0]}) | shiftleft(1L, {place[1]}))"


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """block, w0 to w3 from the column ``url`` of the list; blocks without a URL have no row."""
    keyed = listed.select(F.expr(f"pmod(xxhash64(url), {blocks})").alias("block"), *(F.expr(_bits("url", i)).alias(f"w{i}") for i in range(4)))
    return keyed.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)))


def possible_hits(pages: DataFrame, listed: DataFrame, listed_count: int) -> DataFrame:
    """``pages`` with a boolean ``possible``: false means that ``url`` is not in the list."""
    blocks = max(1, listed_count * BITS // 256)
    table = small(bloom_blocks(listed, blocks), blocks, BROADCAST_BLOCKS)
    has = " and ".join(f"w{i} & {_bits('url', i)} = {_bits('url', i)}" for i in range(4))
    keyed = pages.withColumn("block", F.expr(f"pmod(xxhash64(url), {blocks})"))
    return keyed.join(table, "block", "left").select(*pages.columns, F.expr(f"coalesce({has}, false)").alias("possible"))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``.

    ``listed`` has one column of canonical URLs; nulls, empty and repeated ones
    do not count.  The rule's verdict goes first, else a listed URL is blocked
    and any other allowed.  A null id stays null, repeated rows each give one,
    and either table may be empty.
    """
    listed = listed.select(F.col(listed.columns[0]).alias("url")).where("url <> ''").distinct()
    listed = Tables(pages.sparkSession).written(listed, "listed")  # counted, put into the filter and joined
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parts.select("*", rule.alias("rule"), verdict.alias("verdict"), canonical(F.col("host"), F.col("path")).alias("url"))
    tested = possible_hits(judged, listed, listed.count())
    open_ = F.col("rule").isNull() & F.col("possible")
    sure = tested.where(~open_).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    exact = tested.where(open_).join(listed.withColumn("hit", F.lit(True)), "url", "left")
    exact = exact.withColumn("verdict", F.when(F.col("hit"), "block").otherwise("allow"))
    columns = ["page_id", "host", "path", "rule", "verdict"]
    return sure.select(columns).unionByName(exact.select(columns))
