"""URL filtering by given rules and by association rules mined from labelled URLs.

A given rule is a host and a path prefix with a verdict; the longest that fits decides. URLs that
a rule decides are the labelled ones: their tokens (host labels, path segments) and verdict are the
transactions from which Spark's FP-growth mines token combinations that imply a verdict. Mined rules
are pruned by support and confidence, and where a part of the tokens says as much. They decide the other
URLs: an inverted index holds each mined rule under its rarest token, a URL meets the rules of its
tokens there, and the one of most confidence among those it has in full decides.

All work is on distinct URLs, so copies of one URL cost one row. Tokens that occur in just the same
labelled URLs are one item while mining, so that long paths shared by many URLs don't multiply itemsets. A URL has an
item with any of its tokens: a rule mined for one of them holds for each in its place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES_SCHEMA = "antecedent array<string>, verdict string, confidence double, support double"


def host_of(url: str = "url") -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: str = "url") -> Column:
    """From the end of the host to the next ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: str = "host", path: str = "path") -> Column:
    """Host labels and path segments, each once; digits only are one token, however many."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    return F.array_distinct(F.filter(F.concat(labels, segments), lambda x: F.length(x) > 2))


def fit_given(urls: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``urls`` (with ``url, host, path``) and the given ``rule`` that fits longest with its ``said`` verdict, else nulls.

    ``rules`` are (verdict, host, path). A rule fits its host and all subdomains: each ending of the
    host that begins at a label meets the rules of that host.
    """
    given = urls.sparkSession.createDataFrame(list(rules), "said string, rule_host string, rule_path string")
    labels = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    best = (
        urls.withColumn("rule_host", F.explode(endings))
        .join(given, "rule_host")
        .where(F.col("path").startswith(F.col("rule_path")))
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .groupBy("url")
        .agg(F.max(F.struct(F.length("rule"), "rule", "said")).alias("best"))
        .select("url", "best.rule", "best.said")
    )
    return urls.join(best, "url", "left")


def _baskets(labelled: DataFrame) -> DataFrame:
    return labelled.select(F.array_sort("tokens").alias("tokens"), "said").distinct()


def items_of(labelled: DataFrame) -> DataFrame:
    """``token, item, n``: tokens of just the same distinct ``tokens`` and ``said`` are one item, named by the least of them."""
    one = F.xxhash64("tokens", "said").cast("decimal(20,0)")
    alike = (
        _baskets(labelled)
        .select(F.explode("tokens").alias("token"), one.alias("h"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("sum"))
    )
    return alike.withColumn("item", F.min("token").over(Window.partitionBy("n", "sum"))).select("token", "item", "n")


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.9, items: DataFrame | None = None) -> DataFrame:
    """``antecedent, verdict, confidence, support`` mined from ``tokens`` and ``said``; antecedents are of ``items``.

    Support is that of the tokens with the verdict, among distinct pairs of both. A rule stays
    if its confidence reaches the bound and exceeds that of every rule of fewer of its tokens.
    """
    spark = labelled.sparkSession
    baskets = cut(_baskets(labelled))
    if baskets.isEmpty():
        return spark.createDataFrame([], RULES_SCHEMA)
    items = cut(items_of(baskets)) if items is None else items
    least = baskets.count() * min_support
    frequent = items.where((F.col("n") >= least) & (F.col("token") == F.col("item"))).select("token")
    numbered = baskets.withColumn("row", F.xxhash64("tokens", "said"))
    kept = (
        numbered.select("row", "said", F.explode_outer("tokens").alias("token"))
        .join(frequent.withColumn("item", F.col("token")), "token", "left")
        .groupBy("row", "said")
        .agg(F.collect_set("item").alias("some"))
        .select(F.concat(F.col("some"), F.array(F.concat(F.lit("="), F.col("said")))).alias("items"))
    )
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(kept)
    found = cut(
        model.associationRules.where(F.col("consequent")[0].startswith("="))
        .where(~F.exists("antecedent", lambda x: x.startswith("=")))
        .select(F.array_sort("antecedent").alias("antecedent"), F.expr("substring(consequent[0], 2)").alias("verdict"), "confidence", "support")
    )
    shorter = (
        found.where(F.size("antecedent") > 1)
        .select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("without"))
        .withColumn("part", F.array_except("antecedent", F.array("without")))
    )
    covered = (
        shorter.alias("a")
        .join(found.alias("b"), (F.col("a.part") == F.col("b.antecedent")) & (F.col("a.verdict") == F.col("b.verdict")))
        .where(F.col("b.confidence") >= F.col("a.confidence"))
        .select("a.antecedent", "a.verdict")
        .distinct()
    )
    return found.join(covered, ["antecedent", "verdict"], "left_anti")


def match(urls: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """``url, mined``: the verdict of the best mined rule whose ``items`` the URL has; only URLs that meet one.

    Best is the most confidence, then support, then tokens; then ``block`` before ``allow``.
    """
    spread = rules.select("antecedent", F.explode("antecedent").alias("token")).distinct()
    rarity = spread.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = (
        spread.join(rarity, "token")
        .groupBy("antecedent")
        .agg(F.min(F.struct("n", "token")).alias("least"))
        .select("antecedent", F.col("least.token").alias("token"))
        .join(rules, "antecedent")
    )
    used = items.join(spread.select(F.col("token").alias("item")).distinct(), "item").select("token", "item")
    held = urls.select("url", F.explode("tokens").alias("token")).join(used, "token").groupBy("url").agg(F.collect_set("item").alias("tokens"))
    met = held.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    full = met.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", F.size("antecedent"), "verdict")).alias("best")
    return full.groupBy("url").agg(best).select("url", F.col("best.verdict").alias("mined"))


def judge(pages: DataFrame, given: Sequence[tuple[str, str, str]], url: str = "url", **mining) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``.

    The given rule that fits decides, else the mined rules, else the verdict is ``allow``. A null url,
    or one without ``://``, has an empty host and path. Columns of these names are replaced.
    """
    names = ("host", "path", "rule", "verdict")
    distinct = pages.select(F.coalesce(F.col(url), F.lit("")).alias("url")).distinct()
    parsed = distinct.select("url", host_of().alias("host"), path_of().alias("path"))
    known = cut(fit_given(parsed, given).withColumn("tokens", tokens_of()))
    labelled = known.where(F.col("said").isNotNull())
    items = cut(items_of(labelled))
    rules = cut(mine(labelled, items=items, **mining))
    judged = known.join(match(known.where(F.col("said").isNull()), rules, items), "url", "left").select(
        F.col("url").alias("_url"), "host", "path", "rule", F.coalesce("said", "mined", F.lit("allow")).alias("verdict")
    )
    rows = pages.drop(*names).withColumn("_url", F.coalesce(F.col(url), F.lit("")))
    return rows.join(judged, "_url").drop("_url")
