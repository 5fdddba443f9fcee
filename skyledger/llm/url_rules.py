"""URL rules found through an index on each rule's rarest literal token, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: verdict, host, path of the registered query's rules; fixed values.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tokens of every url: one fetches rules without a literal token, one fetches none and counts the row.
ANY, ROW = "*", "#"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://`` or url."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def literal_tokens(host: Column, path: Column) -> Column:
    """Labels of the host as ``h:label`` and whole path segments as ``p:segment``, without empty ones.

    A segment is whole if a slash follows it, so that a rule's tokens are among
    those of every url it fits.
    """
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.split(path, "/")
    whole = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.filter(F.concat(labels, whole), lambda x: F.length(x) > 2))


def rule_table(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """``rules`` (verdict, host, path) with their text, pattern, length and the literal token that fewest of the
    counted urls hold (``tokens``: token, urls). Rules without a literal token get ``ANY``."""
    quoted = lambda c: F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    named = rules.dropna(subset=["verdict", "host", "path"]).select(
        "verdict",
        F.concat("host", "path").alias("rule"),
        (F.length("host") + F.length("path")).alias("length"),
        F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), quoted(F.col("host")), quoted(F.col("path"))).alias("pattern"),
        literal_tokens(F.col("host"), F.col("path")).alias("tokens"),
    )
    held = named.withColumn("token", F.explode_outer("tokens")).join(tokens, "token", "left")
    rare = F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), F.coalesce("token", F.lit(ANY)).alias("token")))
    return held.groupBy("verdict", "rule", "length", "pattern").agg(rare.alias("rare")).select(
        "verdict", "rule", "length", "pattern", F.col("rare.token").alias("token")
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains where the path starts with the
    rule's; the longest wins, then the one that is greater as text. Pages that no
    rule fits get a null rule and ``default``. Null or malformed urls have an
    empty host and path and fit no rule with a host. Repeated rows repeat. An
    empty table gives an empty result; no rules leave all to ``default``. Other
    columns are ignored.

    Every url sends its tokens to the rules indexed by them; only these
    candidates run their pattern. The tokens of a page are made and folded in
    one task, so one row a page is shuffled. Spark broadcasts the rules if they
    are small by its own measure and shuffles them otherwise.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    held = F.concat(F.array(F.lit(ROW), F.lit(ANY)), literal_tokens(F.col("host"), F.col("path")))
    split = split.select("page_id", "host", "path", F.explode(held).alias("token"))
    asked = rules.select(F.explode(literal_tokens(F.col("host"), F.col("path"))).alias("token")).distinct()
    counts = split.groupBy("token").agg(F.count(F.lit(1)).alias("urls")).join(asked, "token", "left_semi")
    found = split.join(rule_table(rules, counts), "token", "left")
    fits = F.regexp_like(F.concat("host", "path"), F.col("pattern"))
    best = F.max(F.when(fits, F.struct("length", "rule", "verdict")))
    copies = F.count(F.when(F.col("token") == ROW, 1))
    judged = found.groupBy("page_id", "host", "path").agg(best.alias("best"), copies.cast("int").alias("copies"))
    return judged.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Listed rules as a DataFrame of literals, whose size Spark knows."""
    rows = [F.struct(*(F.lit(x).alias(name) for x, name in zip(rule, ("verdict", "host", "path")))) for rule in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


ORACLE = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
best AS (
  SELECT page_id, host, path, max(CASE WHEN (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
         THEN {'length': length(h) + length(p), 'rule': h || p, 'verdict': verdict} END) AS best
  FROM u CROSS JOIN rules GROUP BY page_id, host, path
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM best
"""
