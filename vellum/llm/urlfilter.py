"""URL filter by hashed host-suffix and path-prefix expressions (DataFrame functions only).

Each URL is expanded into the expressions that a rule could be stored under,
the expressions' SHA-256 digests meet the rules on a short prefix of the
digest, full digests confirm, and the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import ascii_lower, without

SHORT_HEX = 8  # 32 bits of the digest travel in the join
BROADCAST_BYTES = 64 << 20
RULE_ROW_BYTES = 400  # generous JVM size of one rule row (two hex digests, rule text, flags)

Rule = tuple[str, str, str]  # verdict, host, path


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """(rule, host, path, verdict) from a list of (verdict, host, path)."""
    bad = [r for r in rules if r[0] not in ("allow", "block") or not r[1]]
    if bad:
        raise ValueError(f"rules need a verdict of allow or block and a host: {bad[:3]}")
    empty = spark.range(0).select(*[F.lit("").alias(c) for c in ("rule", "host", "path", "verdict")])
    for verdict, host, path in rules:
        empty = empty.unionAll(spark.range(1).select(F.lit(host + path).alias("rule"), F.lit(host).alias("host"),
                                                     F.lit(path).alias("path"), F.lit(verdict).alias("verdict")))
    return empty


def filter_urls(df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow",
                broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with host, path, rule, verdict for every row.

    A rule fits its host and all subdomains, if the path starts with the
    rule's path. The longest rule (host and path together) wins; of equally
    long ones, of which only repeats of one rule can fit, block wins. Without
    a fitting rule, `rule` is null and `verdict` is `default`: the lists know
    nothing against the URL. A null URL, or one without `://`, has an empty
    host and path and fits no rule. Rules with a null or empty host, or a null
    path, fit nothing. Input columns named host, path, rule or verdict are
    replaced; repeated rows stay repeated; empty tables give empty results.

    Only suffixes with as many labels, and prefixes as long, as some rule has
    are expanded: the others cannot match, and a URL of any length costs
    (label counts x path lengths of the rules) digests. Expressions are made
    once per distinct URL. The rules are broadcast if `broadcast_bytes` holds
    them, else joined on the short digest with AQE splitting hot prefixes.
    """
    df = without(df, "host", "path", "rule", "verdict")
    key = F.coalesce(F.col(url_col), F.lit(""))
    r = (rules.filter("host <> '' AND path IS NOT NULL")
         .select(F.col("rule").alias("__rule"), "host", "path", (F.col("verdict") == "block").alias("__block"),
                 F.sha2(F.concat("host", "path"), 256).alias("__full")))
    shape = r.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.size(F.split("host", r"\.")))).alias("labels"),
                  F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    r = r.select(F.substring("__full", 1, SHORT_HEX).alias("__short"), "__full", "__rule", "__block")
    if shape["n"] * RULE_ROW_BYTES <= broadcast_bytes:
        r = F.broadcast(r)

    urls = (df.select(key.alias("__url")).distinct()
            .select("__url", url_host(F.col("__url")).alias("__host"), url_path(F.col("__url")).alias("__path")))
    labels = F.split("__host", r"\.")
    hosts = [F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in shape["labels"]]
    paths = [F.when(F.length("__path") >= n, F.substring("__path", 1, n)) for n in shape["lengths"]]
    pairs = [F.concat(h, p) for h in hosts for p in paths]  # null where either is missing
    if not pairs:
        pairs = [F.lit(None).cast("string")]
    expanded = urls.select("__url", F.explode(F.array_compact(F.array(*pairs))).alias("__expr"))
    hashed = expanded.withColumn("__digest", F.sha2("__expr", 256))
    met = hashed.join(r, F.substring("__digest", 1, SHORT_HEX) == F.col("__short")).filter("__digest = __full")
    best = met.groupBy("__url").agg(F.max(F.struct(F.length("__rule").alias("n"), F.col("__block").alias("block"),
                                                   F.col("__rule").alias("rule"))).alias("__best"))
    out = df.withColumn("__key", key).join(best, F.col("__key") == F.col("__url"), "left")
    return out.select(*df.columns, url_host(F.col("__key")).alias("host"), url_path(F.col("__key")).alias("path"),
                      F.col("__best.rule").alias("rule"),
                      F.when(F.col("__best.block"), "block").when(~F.col("__best.block"), "allow")
                      .otherwise(F.lit(default)).alias("verdict"))
