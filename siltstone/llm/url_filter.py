"""URL filters: host and path rules, then a blocked Bloom filter before an
exact join with the listed urls.

The Bloom filter is a table of 512-bit blocks, eight longs each, built by a
partial ``bit_or`` aggregate; a url's bits all lie in one block, so a probe is
one lookup. The table is broadcast while its size, known from the list's
count, is within ``BROADCAST_BYTES``, and joined by block number beyond. Pages
are parsed once; what they were parsed into and whether they may be listed is
stored, a few dozen bytes a page. Only urls that pass go on to the exact join,
which removes the false positives.

Rules (host, path) fit their host and its subdomains if the path starts with
the rule's; the longest fitting rule decides, else the list does.

Defined results: a null url or one without ``://`` has an empty host and path,
fits no rule and is not listed; rows without an id are judged like others;
equal rows get equal verdicts, and rules of equal length go by host; urls of any
length are taken whole; an empty list blocks nothing; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WORDS = 8
PROBES = 6
BITS_PER_URL = 16
BROADCAST_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host and path without scheme, default port, closing slash, fragment and
    ``utm_`` parameters; null without a host."""
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule (verdict, host, path) that
    fits, null if none does. The rules are a short fixed list, tried from the
    longest, so a plain conditional chain does."""
    chain = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        chain = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chain)
    return chain


def _positions(url: Column, blocks: int) -> tuple[Column, list[Column]]:
    block = F.pmod(F.xxhash64(url, F.lit(1)), F.lit(blocks)).cast("long")
    bits = F.xxhash64(url, F.lit(2))
    return block, [F.shiftrightunsigned(bits, 9 * k).bitwiseAND(F.lit(511)).cast("int") for k in range(PROBES)]


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) from a column ``url`` of canonical urls."""
    block, positions = _positions(F.col("url"), blocks)
    bits = listed.select(block.alias("block"), F.explode(F.array(*positions)).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)))
    return bits.groupBy("block").agg(*[F.coalesce(F.bit_or(F.when(F.floor(F.col("bit") / 64) == w, one)), F.lit(0).cast("long")).alias(f"w{w}") for w in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Columns: ``id_col``, host, path, rule, verdict, maybe (passed the Bloom
    filter), listed. ``listed`` has one column of urls to block."""
    spark = pages.sparkSession
    urls = stored(listed.select(canonical(F.col(f"`{listed.columns[0]}`")).alias("url")).filter("url IS NOT NULL").distinct(), "listed")
    count = urls.count()
    blocks = max(1, -(-count * BITS_PER_URL // (64 * WORDS)))
    table = bloom_filter(urls, blocks)
    if blocks * (WORDS + 1) * 8 <= BROADCAST_BYTES:
        table = F.broadcast(table)
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("raw"))
    source = source.select("id", host_of(F.col("raw")).alias("host"), path_of(F.col("raw")).alias("path"), canonical(F.col("raw")).alias("url"))
    source = source.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    block, positions = _positions(F.col("url"), blocks)
    words = F.array(*[F.col(f"w{w}") for w in range(WORDS)])
    hit = [F.call_function("shiftright", F.element_at(words, (F.floor(p / 64) + 1).cast("int")), p.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("long")) == 1 for p in positions]
    all_hit = hit[0]
    for h in hit[1:]:
        all_hit = all_hit & h
    probed = source.withColumn("at", block).join(table, F.col("at") == F.col("block"), "left").withColumn("maybe", F.col("url").isNotNull() & F.coalesce(all_hit, F.lit(False)))
    probed = stored(probed.select("id", "host", "path", F.when(F.col("maybe"), F.col("url")).alias("url"), "fit", "maybe"), "probed")
    passed = probed.filter("maybe").join(urls.select("url", F.lit(True).alias("listed")), "url", "left").select("id", "host", "path", "fit", "maybe", F.coalesce("listed", F.lit(False)).alias("listed"))
    stopped = probed.filter("not maybe").select("id", "host", "path", "fit", "maybe", F.lit(False).alias("listed"))
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return passed.unionByName(stopped).select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_list).alias("verdict"), "maybe", "listed")
