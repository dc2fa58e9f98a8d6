"""URL filters: association rules mined from labelled URLs, applied through an inverted index.

*Tokens.*  A URL has at most ten: scheme, whole host, registered name (its last two
labels), the label just below that, the labels below this one, the first two path segments
(digit runs as ``#``), the file extension, the sorted query keys, and whether there is a
fragment.  So no transaction has more than eleven items and mining stays bounded whatever the
URL's length.

*Mining.*  Spark's FP-growth over the token sets of labelled URLs, blocked ones with one more
item; rules that conclude this item are kept by support, a share of the rows, and by
confidence, a bound and a multiple of the share of blocked rows, and pruned when a shorter
rule with a subset of the tokens is as confident.

*Matching.*  Every rule is posted once, under its rarest token.  The distinct token sets of
the URLs (far fewer than rows, combined before the shuffle) meet the postings by equi-join
and the remaining tokens are verified; the verdict goes back by a join on the token set.

*Listed rules.*  ``host/path-prefix`` rules with a fixed verdict come before mined ones; the
longest that fits wins.

All of it is DataFrame functions and Spark ML; there is no Python in the tasks.

Defined cases: a null url or one without ``://`` has an empty host, an empty path and no
tokens, fits no rule and is allowed; repeated rows get equal verdicts; equally confident
mined rules: the better supported, then the one whose name sorts first; no labels: no mined rules;
an empty table gives an empty result; null labels and labels without a url are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import save

BLOCKED = "label=block"
SEPARATOR = "\x1f"  # between tokens in the name of a set or rule


@dataclass(frozen=True)
class ListedRule:
    """``rule`` is ``host/`` or ``host/path-prefix``; it fits the host and all subdomains."""

    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


def host(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """The sorted distinct tokens of a URL."""
    u = F.coalesce(url, F.lit(""))
    labels = F.split(host(url), r"\.")
    segments = F.filter(F.split(F.regexp_replace(path(url), "[0-9]+", "#"), "/"), lambda s: s != "")
    query = F.regexp_extract(u, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    keys = F.array_join(F.array_sort(F.array_distinct(F.transform(F.split(query, "&"), lambda kv: F.split(kv, "=")[0]))), "&")

    def named(name: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(name + "="), value))

    extension = F.regexp_extract(path(url), r"\.([A-Za-z0-9]{1,8})$", 1)
    found = F.array(
        named("scheme", F.regexp_extract(u, r"(?s)^(.*?)://", 1)), named("host", host(url)),
        named("name", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")),
        F.when(F.size(labels) > 2, named("below", F.get(labels, F.size(labels) - 3))),
        F.when(F.size(labels) > 3, named("deep", F.array_join(F.slice(labels, F.lit(1), F.size(labels) - 3), "."))),
        named("seg1", F.get(segments, F.lit(0))), named("seg2", F.get(segments, F.lit(1))),
        named("ext", F.lower(extension)), named("keys", keys),
        F.when(F.contains(u, F.lit("#")), F.lit("fragment")))
    return F.when(F.contains(u, F.lit("://")), F.array_sort(F.array_distinct(F.array_compact(found)))).otherwise(
        F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float, min_confidence: float, min_count: int = 20, min_lift: float = 0.0) -> DataFrame:
    """Rules ``(rule_id, tokens, confidence, support, key)`` from rows ``(url, blocked)``;
    ``key`` is the rule's rarest token.  A rule needs the share ``min_support`` of the rows and
    at least ``min_count`` blocked rows, so that few labels make no rules; it needs
    ``min_confidence`` and ``min_lift`` times the share of blocked rows."""
    sets = save(labelled.filter("url is not null and blocked is not null")
                .select(tokens(F.col("url")).alias("tokens"), "blocked"))
    basket = sets.select(F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(BLOCKED))))
                         .otherwise(F.col("tokens")).alias("items"))
    n, blocked = sets.agg(F.count(F.lit(1)), F.count_if("blocked")).first()
    support = min(1.0, max(min_support, min_count / max(1, n)))
    confidence = min(1.0, max(min_confidence, min_lift * blocked / max(1, n)))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(basket)
    rules = save(model.associationRules.filter(F.array_contains("consequent", BLOCKED) & (F.size("antecedent") > 0))
                 .select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
                 .withColumn("rule_id", F.array_join("tokens", SEPARATOR)))
    # shorter rules with one token fewer, through the same index idea: all subsets of a rule
    # that leave out one token are looked up by their name
    parts = rules.select("rule_id", F.col("confidence").alias("own"), F.explode("tokens").alias("left_out"), "tokens")
    shorter = (parts.select("rule_id", "own", F.array_join(F.array_remove("tokens", F.col("left_out")), SEPARATOR).alias("sub"))
               .join(rules.select(F.col("rule_id").alias("sub"), "confidence"), "sub").filter("confidence >= own")
               .select("rule_id").distinct())
    kept = rules.join(shorter, "rule_id", "left_anti")
    counts = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = (kept.select("rule_id", F.explode("tokens").alias("token")).join(counts, "token")
              .groupBy("rule_id").agg(F.min(F.struct("n", "token"))["token"].alias("key")))
    return kept.join(rarest, "rule_id")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Per distinct token set (``key``, ``tokens``) that a mined rule fits: the rule."""
    rules = rules.select(F.col("key").alias("token"), F.col("tokens").alias("needs"), "rule_id", "confidence", "support")
    fits = (sets.select("set", "tokens", F.explode("tokens").alias("token")).join(rules, "token")
            .filter(F.size(F.array_except("needs", "tokens")) == 0))
    best = F.min(F.struct(-F.col("confidence"), -F.col("support"), F.col("rule_id")))
    return fits.groupBy("set").agg(best.alias("b")).select("set", F.translate("b.rule_id", SEPARATOR, " ").alias("mined_rule"),
                                                           (-F.col("b.col1")).alias("confidence"))


def listed(host_: Column, path_: Column, rules: tuple[ListedRule, ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.rule)):  # the longest is asked first
        fits = ((host_ == r.host) | F.endswith(host_, F.lit("." + r.host))) & F.startswith(path_, F.lit(r.path))
        rule = F.when(fits, F.lit(r.rule)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def judge(urls: DataFrame, mined: DataFrame, rules: tuple[ListedRule, ...], url: str = "url") -> DataFrame:
    """The rows with ``host``, ``path``, ``rule``, ``verdict``, ``mined_rule`` and ``confidence``
    (columns of these names are replaced)."""
    own = ["host", "path", "rule", "verdict", "mined_rule", "confidence", "set"]
    rows = (urls.drop(*own).withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url)))
            .withColumn("set", F.array_join(tokens(F.col(url)), SEPARATOR)))
    sets = urls.select(tokens(F.col(url)).alias("tokens")).distinct().withColumn("set", F.array_join("tokens", SEPARATOR))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    found = save(match(sets, mined))
    return (rows.join(found, "set", "left").withColumn("rule", rule)
            .withColumn("verdict", F.coalesce(verdict, F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")))
            .drop("set"))
