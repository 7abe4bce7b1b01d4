"""URL filtering with mined association rules and explicit host and path rules.

Native DataFrame operations only.  Spark's FP-growth mines combinations of URL
tokens together with the label of labelled pages; rules ``tokens => label`` that
reach the wanted support and confidence are kept where no shorter kept rule is
contained in them, posted in an inverted index under their rarest token and
looked up by the tokens of every page.  A page is blocked when a kept rule's
tokens are all in its URL.  Explicit rules ``host/path`` come first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Marks the label in a transaction; URL tokens hold no such character.
BAD = "#bad"
MIN_SUPPORT = 0.001
#: A rule's confidence, at least: this, or where bad labels are rarer this many times their share; and its log-likelihood ratio
#: against that share (10.83 is one in a thousand of chi-squared with one degree of freedom).
MIN_CONFIDENCE, MIN_LIFT, MIN_EVIDENCE = 0.5, 2.0, 10.83
#: Labelled rows that a rule rests on, at least, whatever the share asks for.
MIN_ROWS = 5
#: Rules that are broadcast, at most; beyond it the index is joined by shuffle with salted pages.
FEW_RULES = 100_000
SALTS = 16


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(host: Column, path: Column) -> Column:
    """Distinct URL tokens: host labels as ``h:label``, words of the path as ``p:word``; numbers become ``p:0``."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"^[0-9]+$", "0")))
    return F.array_distinct(F.filter(F.concat(labels, words), lambda x: F.length(x) > 2))


def explicit(host_col: Column, path_col: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of ``rules`` (``("example.net/en/", "allow")``) that fits host and path, and its verdict; null where none does.

    A rule fits its host and all subdomains where the path starts with the
    rule's path.  Of two that fit, the one with more characters wins.
    """
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host_col == name) | host_col.endswith("." + name)) & path_col.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float | None = None) -> DataFrame:
    """``(tokens, confidence, support)`` from ``labelled(tokens, bad)``: combinations of URL tokens that imply a bad label.

    ``support`` is the share of labelled rows with the tokens and a bad label.
    Rules must reach ``min_confidence`` (without one ``MIN_CONFIDENCE``, or
    ``MIN_LIFT`` times the share of bad rows where that is less) and differ from that share by more than chance.
    Rules that contain another kept rule's tokens decide nothing more and go;
    a rule may have any number of tokens.
    Empty where nothing is labelled.
    """
    baskets = labelled.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    n, bad = labelled.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    min_support = min(1.0, max(min_support, MIN_ROWS / n)) if n else 1.0
    base = bad / n if n else 0.0
    min_confidence = min(MIN_CONFIDENCE, MIN_LIFT * base) if min_confidence is None else min_confidence
    # A rule of n tokens comes from an itemset of n + 1; counting happens in FP-growth's trees.
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0] == BAD)
    if 0 < base < 1:
        hits = F.col("support") * n
        misses = hits / F.col("confidence") - hits
        other = F.when(F.col("confidence") < 1, misses * F.log((1 - F.col("confidence")) / (1 - base))).otherwise(0.0)
        rules = rules.where(2 * (hits * F.log(F.col("confidence") / base) + other) >= MIN_EVIDENCE)
    rules = materialise(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"), "url-mined")
    inside = (F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0)
    # subsets of a rule share a token with it: an equality join on exploded tokens, not all pairs
    one = rules.select("tokens", F.explode("tokens").alias("t"))
    part = rules.select(F.col("tokens").alias("part"), F.element_at("tokens", 1).alias("t"))
    return rules.join(one.join(part, "t").where(inside).select("tokens").distinct(), "tokens", "left_anti")


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = (), id_col: str = "page_id", min_support: float = MIN_SUPPORT, min_confidence: float | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, confidence)`` for every row of ``pages``.

    ``labels(doc_id, quality)`` labels the pages of the same id; quality 0 is
    bad.  ``verdict`` is the explicit rule's, else ``block`` where a mined rule
    matches (``confidence`` is the highest of those), else ``allow``.  Null urls
    and urls without ``://`` have empty host and path and no tokens; repeated
    rows and null ids keep a row each; extra columns are ignored; with no labels
    nothing is mined and all else is allowed.
    """
    split = pages.select(F.col(id_col).cast("long").alias("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    split = split.withColumn("tokens", tokens(F.col("host"), F.col("path")))
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    labelled = split.join(known, split.page_id == known.doc_id).select("tokens", "bad")
    verdicts = _matched(split, mine(labelled, min_support, min_confidence))
    rule, verdict = explicit(F.col("host"), F.col("path"), rules)
    out = verdicts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("given"), "confidence")
    own = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", own).alias("verdict"), "confidence")


def _matched(split: DataFrame, rules: DataFrame) -> DataFrame:
    """``split`` with the highest confidence of the rules that match each row (null where none does).

    Matching runs once for each distinct set of tokens.  The index lists each
    rule under one token, its rarest among the rules.
    """
    rules = rules.withColumn("rule_id", F.xxhash64("tokens"))
    per_rule = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("t"))
    rare = per_rule.groupBy("t").agg(F.count("*").alias("n"))
    posted = per_rule.join(rare, "t").groupBy("rule_id").agg(F.min(F.struct("n", "t")).alias("k"), F.first("tokens").alias("need"), F.first("confidence").alias("confidence"))
    index = materialise(posted.select(F.col("k.t").alias("t"), "need", "confidence"), "url-rules")
    split = split.withColumn("key", F.array_join(F.array_sort("tokens"), " "))
    sets = split.groupBy("key").agg(F.first("tokens").alias("tokens"))
    probes = sets.select("key", "tokens", F.explode("tokens").alias("t"))
    if index.count() <= FEW_RULES:
        hits = probes.join(F.broadcast(index), "t")
    else:  # hot tokens are spread over SALTS tasks
        probes = probes.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
        hits = probes.join(index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["t", "salt"])
    hits = hits.where(F.size(F.array_except("need", "tokens")) == 0).groupBy("key").agg(F.max("confidence").alias("confidence"))
    return split.join(materialise(hits, "url-hits"), "key", "left")
