"""URL filters by mined association rules (operator 7), native expressions only.

Base rules (host, path) decide the URLs they fit; the longest wins.  Their
verdicts label those URLs, FP-growth mines which combinations of URL tokens go
with a verdict, and rules that pass the support and confidence limits judge
the remaining URLs.  A mined rule is found through an inverted index on its
rarest token and then checked against all tokens of the URL; the most
confident fitting rule decides (then the best supported; block before allow),
and without one the verdict is ``allow``.

Base rules are the only labels: the ``labels`` table names documents, not
pages.  The hosts and paths they are made of are no tokens, as they would only
repeat the label.

Defined cases: null urls and urls without ``://`` have empty host and path,
fit no rule and have no tokens; repeated rows are judged alike; without a
labelled URL nothing is mined; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.components import cut

# fixed values: base rules
BASE_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
              ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: above this many mined rules the inverted index is shuffled, not broadcast
BROADCAST_RULES = 20_000


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def base_rule(host_: Column, path_: Column, rules=BASE_RULES) -> Column:
    """``struct(rule, verdict)`` of the longest fitting base rule, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    # the longest is tested first, so it is added last
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host_: Column, path_: Column, rules=BASE_RULES) -> Column:
    """Distinct typed tokens of a URL: scheme, host labels, path segments
    (numbers as one token), extension, query keys, fragment; without the host
    labels and path segments of the base rules."""
    known = sorted({f"host:{x}" for _, h, _ in rules for x in h.split(".")}
                   | {f"path:{x}" for _, _, p in rules for x in p.split("/") if x})
    tail = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    named = lambda kind, arr: F.transform(F.filter(arr, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    segments = F.transform(F.split(path_, "/"), lambda s: F.regexp_replace(s, r"\d+", "0"))
    query = F.transform(F.split(tail, "&"), lambda s: F.substring_index(s, "=", 1))
    one = lambda kind, c: named(kind, F.array(c))
    return F.array_except(F.concat(
        one("scheme:", F.regexp_extract(url, r"(?s)^(.*?)://", 1)), named("host:", F.split(host_, r"\.")),
        named("path:", segments), one("ext:", F.regexp_extract(path_, r"\.([A-Za-z0-9]+)$", 1)),
        one("end:", F.when(path_.endswith("/"), "/").otherwise("")), named("query:", query),
        one("frag:", F.regexp_extract(url, r"(?s)#(.*)$", 1))),
        F.array(*[F.lit(x) for x in known]).cast("array<string>"))


def mine(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """``(rule_id, antecedent, verdict, confidence, support)`` from rows
    ``(tokens, verdict)``; a rule stays only if no rule with part of its
    tokens and the same verdict is as confident."""
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.filter(F.col("consequent")[0].startswith("verdict:")).select(
        F.array_sort("antecedent").alias("antecedent"),
        F.substring_index(F.col("consequent")[0], ":", -1).alias("verdict"), "confidence", "support")
    rules = cut(rules.filter(~F.exists("antecedent", lambda t: t.startswith("verdict:"))))
    # a rule meets its parts through each of its tokens left out in turn
    part = rules.select(F.col("antecedent").alias("part"), F.col("verdict").alias("v"),
                        F.col("confidence").alias("c"))
    smaller = rules.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("left_out")).select(
        "antecedent", "verdict", "confidence", F.array_except("antecedent", F.array("left_out")).alias("part"))
    dominated = smaller.join(part, (smaller.part == part.part) & (smaller.verdict == part.v)
                             & (part.c >= smaller.confidence)).select("antecedent", "verdict").distinct()
    return rules.join(dominated, ["antecedent", "verdict"], "left_anti").withColumn(
        "rule_id", F.xxhash64("antecedent", "verdict"))


def _rules_with_key(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Mined rules with the token under which the inverted index holds them:
    their rarest in the URLs to judge."""
    wanted = rules.select("rule_id", F.explode("antecedent").alias("token"))
    freq = (urls.select(F.explode("tokens").alias("token")).groupBy("token")
            .agg(F.count(F.lit(1)).alias("n")))
    key = (wanted.join(freq, "token", "left").groupBy("rule_id")
           .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("k")))
    return rules.join(key, "rule_id").select("rule_id", "antecedent", "verdict", "confidence", "support",
                                             F.col("k.token").alias("token"))


def judge(pages: DataFrame, rules=BASE_RULES, min_support: float = 0.02, min_confidence: float = 0.8,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, method_rule)`` per page."""
    u = F.col("url")
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    p = p.withColumns({"host": host(u), "path": path(u)})
    p = p.withColumn("base", base_rule(F.col("host"), F.col("path"), rules))
    toks = tokens(u, F.col("host"), F.col("path"), rules)
    labelled = cut(p.filter("base is not null").select(toks.alias("tokens"), "base.verdict"))
    out = p.select("page_id", "url", "host", "path", "base")
    if labelled.isEmpty():
        return out.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
                          F.lit("allow").alias("verdict"), F.lit(None).cast("string").alias("method_rule"))
    mined = cut(mine(labelled, min_support, min_confidence))
    # the verdict depends on the URL alone: judge each distinct one once
    urls = cut(p.filter("base is null and url is not null").select("url", toks.alias("tokens")).distinct())
    index = cut(_rules_with_key(mined, urls))
    if index.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    found = (urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
             .filter(F.size(F.array_except("antecedent", "tokens")) == 0))
    best = found.groupBy("url").agg(F.max(F.struct(
        "confidence", "support", (F.col("verdict") == "block").alias("block"),
        F.array_join("antecedent", " ").alias("antecedent"))).alias("m"))
    return out.join(best, "url", "left").select(
        "page_id", "host", "path", "base.rule",
        F.when(F.col("base").isNotNull(), F.col("base.verdict"))
        .when(F.col("m.block"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
        F.when(F.col("base").isNull(), F.col("m.antecedent")).alias("method_rule"))
