"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

A rule is (host, path, action): it fits its host and all subdomains, for paths that start with
its path; of the rules that fit, the longest decides (host and path together; of equally long
ones, block). Every distinct (host, path) of the urls is expanded into the suffixes of its host
at dots, times its path's prefixes of those lengths that rules have, so any rule path is met, also
one that ends inside a segment. Expressions are equi-joined with the rules on the first 32 bits of
their SHA-256, then whole digests are compared. Rules that are too many or too long to broadcast are
repeated under ``salts``, since an expression such as ``com/`` is met by a large part of all
places; rows without a host fit nothing and are spread over the closing join.

Without a fitting rule the verdict is allow, unless the caller gives ``words``: then a word of the host (cut at dots
and hyphens) among them, met by the same join, makes it block.

Nulls, ties and repeats: a null url, or one without "://", has an empty host and path and fits no
rule; an empty path fits only rules with an empty path; equal rules count once; a null rule host
or path, or an action other than allow or block, leaves the rule out; rows that repeat give equal
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Host words that a caller may have blocked where no rule fits.
BLOCKED_WORDS = ("adult", "bet", "bets", "betting", "casino", "escort", "gambling", "malware", "phishing", "poker", "porn", "sex", "spam", "warez", "xxx")
PREFIX = 8  # hex digits


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for a null url or one without "://"."""
    has = F.coalesce(url, F.lit("")).contains("://")
    rest = F.when(has, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    """The host and what follows each of its dots."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([(r[1], r[2], r[0]) for r in rules], "host string, path string, action string")


def judge(pages: DataFrame, rules: DataFrame, words: Sequence[str] = (), id_col: str = "page_id", url_col: str = "url", broadcast_rules: int = 100_000, broadcast_bytes: int = 32_000_000, max_lengths: int = 64, salts: int = 32) -> DataFrame:
    """Per row: page_id, host, path, rule (host and path of the rule that decides, else null) and verdict."""
    usable = rules.where("host IS NOT NULL AND path IS NOT NULL AND action IN ('allow', 'block')").select("host", "path", "action").distinct()
    of_words = pages.sparkSession.createDataFrame([(w,) for w in sorted(set(words))], "word string").select(F.concat(F.lit("word:"), "word").alias("expr"), F.lit(-1).alias("weight"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("action"))
    listed = usable.select(F.concat(F.lit("rule:"), "host", F.lit("\n"), "path").alias("expr"), (F.length("host") + F.length("path")).alias("weight"), F.concat("host", "path").alias("rule"), "action").unionByName(of_words)
    listed = listed.withColumn("digest", F.sha2("expr", 256)).withColumn("short", F.substring("digest", 1, PREFIX)).drop("expr")
    n, size, lengths = usable.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 120), F.lit(0)), F.collect_set(F.length("path"))).first()
    host, path = url_parts(F.col(url_col))
    own = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    places = own.select("host", "path").distinct()
    if len(lengths) > max_lengths:  # very many lengths: all prefixes
        cuts = F.transform(F.sequence(F.lit(0), F.length("path")), lambda i: F.substring("path", F.lit(1), i))
    else:
        fit = F.filter(F.array(*[F.lit(int(k)) for k in sorted(lengths)]).cast("array<int>"), lambda i: i <= F.length("path"))
        cuts = F.transform(fit, lambda i: F.substring("path", F.lit(1), i))
    as_rule = F.flatten(F.transform(host_suffixes(F.col("host")), lambda h: F.transform(cuts, lambda p: F.concat(F.lit("rule:"), h, F.lit("\n"), p))))
    as_word = F.transform(F.array_distinct(F.split("host", r"[.\-]")), lambda w: F.concat(F.lit("word:"), w))
    asked = places.where("host <> ''").select("host", "path", F.explode(F.concat(as_rule, as_word) if words else as_rule).alias("expr"))
    asked = asked.withColumn("full", F.sha2("expr", 256)).drop("expr").withColumn("short", F.substring("full", 1, PREFIX))
    if n <= broadcast_rules and size <= broadcast_bytes:
        met = asked.join(F.broadcast(listed), "short")
    else:
        every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        met = asked.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int")).join(listed.withColumn("salt", every), ["short", "salt"])
    met = met.where(F.col("full") == F.col("digest"))
    best = met.groupBy("host", "path").agg(F.max(F.struct("weight", "action", "rule")).alias("b"))  # "block" sorts last
    found = best.select(F.col("host").alias("h"), F.col("path").alias("p"), F.lit(0).cast("long").alias("s"), "b.rule", "b.action")
    spread = F.when(F.col("host") == "", F.xxhash64("page_id")).otherwise(F.lit(0))
    out = own.join(found, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")) & (spread == F.col("s")), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"))
