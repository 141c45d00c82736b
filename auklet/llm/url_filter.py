"""Host and path rules applied to URLs, as a safe-browsing list is: by digests of expressions, with DataFrame functions only.

A URL is expanded into host suffixes joined with path prefixes: those of the shapes that some rule has, a shape being how many
labels the host and how many segments the path of a rule have. So a URL of any length gives as many expressions as there are shapes
at most, each cut out in one pass. Rules meet expressions by the first four bytes of a SHA-256; the full digest then confirms,
and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url) -> F.Column:
    """What stands after the first :// up to / ? # or the end, with A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url) -> F.Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digested(df: DataFrame, column: str) -> DataFrame:
    digest = F.sha2(F.encode(column, "utf-8"), 256)
    return df.withColumn("digest", digest).withColumn("short", F.substring(digest, 1, 8))


def url_verdicts(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """(page_id, url, host, path, rule, verdict) for every row of pages; rules are (rule: host and path, verdict).

    A rule fits its host and all hosts under it where the URL's path starts with the rule's path. The longest fitting rule
    decides, of equal rules the smaller verdict; without one, `otherwise`. Null URLs and such without :// have an empty host
    and path, which no rule fits. Repeated rows are kept as often as they came; pages' other columns are ignored. Very long
    hosts and paths cost time in proportion to their length. Without rules, every verdict is `otherwise`.
    """
    urls = pages.groupBy("page_id", "url").agg(F.count("*").alias("times"))  # a repeated row, however hot, is expanded once
    parts = {"host": host_of(F.col("url")), "path": path_of(F.col("url"))}
    listed = rules.where("rule is not null").groupBy("rule").agg(F.min("verdict").alias("verdict"))
    cut = F.locate("/", "rule")
    own_host = F.when(cut > 0, F.substring("rule", F.lit(1), cut - 1)).otherwise(F.col("rule"))
    own_path = F.when(cut > 0, F.substring("rule", cut, F.length("rule"))).otherwise(F.lit(""))
    # a path of whole segments is cut at its slashes, any other at its length
    slashes = F.when(own_path.endswith("/"), F.length(own_path) - F.length(F.replace(own_path, F.lit("/")))).otherwise(F.lit(0))
    chars = F.when(slashes > 0, F.lit(-1)).otherwise(F.length(own_path))
    dots = F.length(own_host) - F.length(F.replace(own_host, F.lit(".")))
    shapes = listed.select((dots + 1).cast("int").alias("labels"), slashes.cast("int").alias("slashes"), chars.cast("int").alias("chars")).distinct()
    shapes = shapes.orderBy("labels", "slashes", "chars").collect()  # labels x depths of rules, however many rules there are
    if not shapes:
        return urls.withColumns(parts).withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("page_id", "url", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))

    wide = urls.withColumns(parts).withColumn("shape", F.explode(F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in s.asDict().items()]) for s in shapes])))
    fits = "length(host) - length(replace(host, '.')) >= shape.labels - 1 and if(shape.slashes > 0, length(path) - length(replace(path, '/')) >= shape.slashes, length(path) >= shape.chars) and contains(url, '://')"
    suffix = F.expr("substring_index(host, '.', -shape.labels)")
    prefix = F.expr("if(shape.slashes > 0, concat(substring_index(path, '/', shape.slashes), '/'), substring(path, 1, shape.chars))")
    wide = _digested(wide.where(fits).select("page_id", "url", F.concat(suffix, prefix).alias("expression")), "expression").drop("expression")
    listed = _digested(listed, "rule").select("short", F.col("digest").alias("rule_digest"), "rule", "verdict")
    fit = F.struct(F.length("rule").alias("n"), "rule", "verdict")
    best = wide.join(listed, "short").where("digest = rule_digest").groupBy("page_id", "url").agg(F.max(fit).alias("best"))
    best = best.select(F.col("page_id").alias("page_"), F.col("url").alias("url_"), "best")
    same = F.col("page_id").eqNullSafe(F.col("page_")) & (F.col("url") == F.col("url_"))
    out = urls.join(best, same, "left").select("page_id", "url", "times", "best").withColumns(parts)
    out = out.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
