"""URL filters: a blocked Bloom filter of the listed canonical keys lets possible hits through to an exact hash join.

A listed rule is (host, path, verdict). It fits its host and all subdomains if the url's path starts with the rule's
path; the longest rule that fits wins. Every url is expanded to the keys under which a rule could list it: each suffix
of its host at a label boundary, with the prefix of its path at each length that occurs in the list. A key that the
filter rejects is certainly not listed; the exact join removes the filter's false positives.

Scale: the list is canonicalised and folded into 64-bit blocks with ``bit_or`` (map-side combined, no collect). The
filter has a block for four listed keys, counted, up to ``MOST_BLOCKS`` rows of 16 bytes, so it may be broadcast; a list
that overfills it only lets more keys through to the join. The exact join is broadcast when the list is counted at ``broadcast_rows``
or fewer, else it is an ordinary shuffle join that AQE splits where a host is hot. A page's keys are folded again
before the pages are met, so a hot host costs one row for each page.

Edge cases: null urls and urls without ``://`` have an empty host and path and meet no rule; repeated rows each get
their own result; an empty list leaves every page with ``default``; extra columns of either input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

BITS = 6
#: The least and most 64-bit blocks of the filter (16 MB).
LEAST_BLOCKS, MOST_BLOCKS = 1 << 10, 1 << 20


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s:.*?)://([^/?#]*)", 1)
    return lowered(rest)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def lowered(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def canonical(host: Column, path: Column) -> Column:
    """The key under which a url is listed: the host in lower case (A-Z), then the path."""
    return F.concat(lowered(host), path)


def blocks_for(keys: int) -> int:
    """A power of two: a block for four keys, within the bounds."""
    size = LEAST_BLOCKS
    while size < MOST_BLOCKS and 4 * size < keys:
        size <<= 1
    return size


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    """BITS bits of one 64-bit block, each from its own six bits of a second hash."""
    second = F.xxhash64(key, F.lit(1))
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        bit = F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def bloom(keys: DataFrame, key: str, blocks: int = LEAST_BLOCKS) -> DataFrame:
    """The filter of a key column: (block, bits), at most ``blocks`` rows."""
    return keys.where(F.col(key).isNotNull()).groupBy(_block(F.col(key), blocks).alias("block")).agg(F.bit_or(_mask(F.col(key))).alias("bits"))


def possible(probes: DataFrame, key: str, filt: DataFrame, blocks: int = LEAST_BLOCKS) -> DataFrame:
    """The rows of probes whose key may be listed."""
    tried = probes.withColumn("__block", _block(F.col(key), blocks)).withColumn("__mask", _mask(F.col(key)))
    met = tried.join(F.broadcast(filt.select(F.col("block").alias("__block"), F.col("bits").alias("__bits"))), "__block")
    return met.where(F.col("__bits").bitwiseAND(F.col("__mask")) == F.col("__mask")).drop("__block", "__mask", "__bits")


def url_filter(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", blocks: int | None = None, broadcast_rows: int = 10_000) -> DataFrame:
    """Judge every page by the rules (host, path, verdict): id, host, path, rule, verdict."""
    listed = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy(canonical(F.col("host"), F.col("path")).alias("key"))
        .agg(F.max(F.struct(F.length(F.concat("host", "path")), "verdict")).getField("verdict").alias("listed_verdict"))
    )
    lengths = sorted(r[0] for r in rules.where(F.col("path").isNotNull()).select(F.length("path")).distinct().collect())
    # Written once: a row's number must be the same for its keys and for itself.
    own = materialize(pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")), "url-pages")
    if not lengths:
        return own.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.when(F.length("path") >= n, F.substring("path", F.lit(1), n))), lambda p: p.isNotNull())
    keys = F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))
    probes = own.where(F.col("host") != "").select("row", F.explode(keys).alias("key"))
    n_listed = listed.count()
    blocks = blocks or blocks_for(n_listed)
    hits = possible(probes, "key", bloom(listed, "key", blocks), blocks)
    exact = F.broadcast(listed) if n_listed <= broadcast_rows else listed
    best = hits.join(exact, "key").groupBy("row").agg(F.max(F.struct(F.length("key").alias("n"), F.col("key").alias("key"), F.col("listed_verdict").alias("v"))).alias("best"))
    return own.join(best, "row", "left").select(id_col, "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))
