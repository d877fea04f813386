"""URL filters: host rules, and association rules that FP-growth mines from labelled urls.

``judged`` gives each url its host, path, the longest host rule that fits, and a verdict: the rule's, else block when a mined
combination of url tokens matches, else allow. DataFrame functions only. Null urls and urls without ``://`` have empty host
and path and are allowed. Rows are kept one for one; without labels no rule is mined. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAD = "label=block"
HostRule = tuple[str, str, str]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path, both empty if there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: host labels, domain of two labels, path words, query names."""
    labels = F.split(host, r"\.")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    named = lambda mark, words: F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(mark), w))
    return F.array_distinct(F.concat(
        named("host:", labels), named("domain:", F.array(F.substring_index(host, ".", -2))), named("path:", F.split(F.lower(path), r"[^\p{L}\p{N}]+")),
        named("query:", F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1)))))


def mined(urls: DataFrame, labels: DataFrame, min_support: float, min_confidence: float, min_count: int) -> DataFrame:
    """``(rule, antecedent, confidence, support, key)``: token combinations that go with block; key is their rarest token."""
    labelled = urls.join(labels, "page_id").select(F.array_union("tokens", F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    n = labelled.count()
    if not n:
        return labelled.sparkSession.createDataFrame([], "antecedent array<string>, confidence double, support double, key string, rule string")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_count / n)), minConfidence=min_confidence).fit(labelled)
    rules = model.associationRules.where((F.element_at("consequent", 1) == BAD)).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    keyed = rules.select("*", F.explode("antecedent").alias("token")).join(single, "token")
    return keyed.groupBy("antecedent", "confidence", "support").agg(F.min_by("token", F.struct("freq", "token")).alias("key")).withColumn(
        "rule", F.array_join("antecedent", "+"))


def judged(pages: DataFrame, labels: DataFrame, host_rules: Sequence[HostRule], min_support: float = 0.002, min_confidence: float = 0.6, min_count: int = 5) -> DataFrame:
    """``(page_id, host, path, rule, verdict, mined_rule, confidence)`` of every page.

    ``labels`` has (page_id, bad boolean). ``host_rules`` are (host, path, verdict). Mined rules are found by an inverted index from
    their rarest token, so a common token meets few rules; distinct urls are matched once.
    """
    spark = pages.sparkSession
    host, path = parts(F.col("url"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    urls = p.select("url", "host", "path").where("url is not null").distinct().withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))

    with_tokens = p.where("url is not null").withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path"))).select("page_id", "tokens")
    rules = mined(with_tokens, labels.groupBy("page_id").agg(F.max("bad").alias("bad")), min_support, min_confidence, min_count)
    hits = urls.select("url", "tokens", F.explode("tokens").alias("key")).join(rules, "key").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    mined_hit = hits.groupBy("url").agg(F.max(F.struct("confidence", "support", "rule")).alias("hit"))

    listed = spark.createDataFrame([(h, q, h + q, v) for h, q, v in host_rules], "suffix string, prefix string, listed string, says string")
    fits = urls.select("url", "path", F.explode(suffixes(F.col("host"))).alias("suffix")).join(listed, "suffix").where(F.startswith("path", "prefix"))
    listed_hit = fits.groupBy("url").agg(F.max(F.struct(F.length("listed").alias("n"), "listed", "says")).alias("fit"))

    found = mined_hit.join(listed_hit, "url", "full")
    return p.join(found, "url", "left").select(
        "page_id", "host", "path", F.col("fit.listed").alias("rule"),
        F.coalesce("fit.says", F.when(F.col("hit").isNotNull(), "block"), F.lit("allow")).alias("verdict"),
        F.col("hit.rule").alias("mined_rule"), F.col("hit.confidence").alias("confidence"))
