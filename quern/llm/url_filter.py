"""URL rules matched through hashed host-suffix and path-prefix expressions.

Every distinct URL is expanded into the suffixes of its host (at label
borders) times the prefixes of its path (at the lengths that rules have).  The
expressions meet the rules in an equi-join on the first 32 bits of their
SHA-256; the full digest confirms, and the longest rule decides.

Null URLs and URLs without ``://`` have an empty host and path and match no
rule; URLs without a rule get the method's verdict, ``allow``.  Of rules that
are equally long, the one whose text is least wins, and a rule given twice
with both verdicts blocks.  Repeated rows are judged alike; empty tables of
pages or rules work.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules are broadcast up to this many; beyond it the join shuffles by hash prefix.
BROADCAST_RULES = 200_000
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise("")
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict of every row; ``rules`` has host, path, verdict."""
    rules = rules.where("host is not null").select(
        F.translate("host", _UPPER, _LOWER).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        "verdict",
    )
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    known = rules.agg(F.count("*"), F.collect_set(F.length("path"))).first()
    keyed = rules.select(
        _digest(F.col("host"), F.col("path")).alias("digest"),
        F.concat("host", "path").alias("rule"),
        "verdict",
    ).withColumn("short", F.substring("digest", 1, 8))
    if known[0] <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    url = F.col(f"`{url_col}`").cast("string")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.array(*[F.lit(x) for x in sorted(known[1])]) if known[1] else F.array().cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    urls = rows.where("host <> ''").select("host", "path").distinct()
    spread = urls.select(
        "host",
        "path",
        F.explode(suffixes).alias("suffix"),
        prefixes.alias("prefixes"),
    ).select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
    asked = spread.select(
        "host",
        "path",
        _digest(F.col("suffix"), F.col("prefix")).alias("asked"),
    ).withColumn("short", F.substring("asked", 1, 8))
    hits = asked.join(keyed, "short").where("asked = digest")
    # longest first; of equals the least text
    best = hits.groupBy("host", "path").agg(
        F.min(F.struct((-F.length("rule")).alias("n"), "rule", "verdict")).alias("r")
    ).select("host", "path", "r.rule", "r.verdict")
    out = ["page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(DEFAULT)).alias("verdict")]
    # rows without a host meet no rule: they stay out of the join, where they would be one key
    judged = rows.where("host <> ''").join(best, ["host", "path"], "left").select(*out)
    bare = rows.where("host = ''").select(
        "page_id",
        "host",
        "path",
        F.lit(None).cast("string").alias("rule"),
        F.lit(None).cast("string").alias("verdict"),
    )
    return judged.unionByName(bare.select(*out))
