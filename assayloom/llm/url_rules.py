"""URL verdicts: fixed host and path rules first, else association rules mined by FP-growth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

AFTER_SCHEME = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
#: Item prefix of a verdict; no URL token starts with it.
VERDICT = "verdict="


@dataclass(frozen=True)
class UrlRule:
    """A rule fits `host` and its subdomains where the path starts with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(url, AFTER_SCHEME, 1), upper, upper.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, AFTER_SCHEME, 2), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, ties by text; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.text)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL: scheme, host labels and suffix, path words by place, query keys, fragment."""
    host, path, rest = url_host(url), url_path(url), F.coalesce(F.regexp_extract(url, AFTER_SCHEME, 3), F.lit(""))
    scheme = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    labels = F.split(host, r"\.")
    words = F.filter(F.split(F.lower(path), r"[/._\-]+"), lambda x: x != "")
    words = F.transform(words, lambda x: F.when(x.rlike(r"^\d+$"), F.lit("0")).otherwise(x))
    keys = F.transform(F.filter(F.split(F.regexp_extract(rest, r"(?s)^\?([^#]*)", 1), "[&;]"), lambda x: x != ""), lambda x: F.split(x, "=")[0])
    every = F.concat(
        F.array(F.concat(F.lit("scheme="), scheme), F.concat(F.lit("end="), F.element_at(labels, -1))),
        F.transform(F.filter(labels, lambda x: x != ""), lambda x: F.concat(F.lit("host="), x)),
        F.transform(words, lambda x: F.concat(F.lit("path="), x)),
        F.transform(keys, lambda x: F.concat(F.lit("key="), x)),
        F.when(rest.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(F.coalesce(every, F.array().cast("array<string>")))


def mine_url_rules(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.85) -> DataFrame:
    """labelled (tokens, verdict) -> (tokens, verdict, confidence, support): rules of FP-growth that name a verdict.

    Tokens below the support are dropped before mining, so each row has few items. Rules are as
    many as frequent token sets, which depends on the support and not on the number of rows.
    """
    empty = "tokens array<string>, verdict string, confidence double, support double"
    n = labelled.count()
    if not n:
        return labelled.sparkSession.createDataFrame([], empty)
    each = labelled.select(F.explode("tokens").alias("token")).groupBy("token").count()
    # a row has few tokens, and 1 / min_support of them at most are common in each place of a row
    common = [r.token for r in each.where(F.col("count") >= min_support * n).select("token").orderBy("token").toLocalIterator()]
    if not common:
        return labelled.sparkSession.createDataFrame([], empty)
    kept = F.array_intersect("tokens", F.array(*map(F.lit, common)))
    baskets = labelled.select(F.concat(kept, F.array(F.concat(F.lit(VERDICT), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(materialize(baskets))
    names = F.col("consequent")[0].startswith(VERDICT)
    tokens_only = F.forall("antecedent", lambda x: ~x.startswith(VERDICT))
    return model.associationRules.where(names & tokens_only).select(
        F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], len(VERDICT) + 1, 1000).alias("verdict"), "confidence", "support"
    )


def match_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """token_sets (tokens) distinct -> (tokens, mined): the verdict of the best rule, by an index on each rule's rarest token.

    Best is the highest confidence, then support, then more tokens, then the least verdict and tokens.
    """
    common = token_sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    each = rules.select(F.col("tokens").alias("needs"), "verdict", "confidence", "support", F.explode("tokens").alias("token")).join(common, "token")
    # a rule with a token that no set has is lost here, as it fits none
    index = each.groupBy("needs", "verdict", "confidence", "support").agg(F.min_by("token", F.struct("c", "token")).alias("token"), F.count("*").alias("there")).where(F.col("there") == F.size("needs"))
    met = token_sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("needs", "tokens")) == 0)
    rank = F.struct(-F.col("confidence"), -F.col("support"), -F.size("needs"), "verdict", "needs")
    return met.groupBy("tokens").agg(F.min_by("verdict", rank).alias("mined"), F.min(rank)["needs"].alias("needs"))


def judge_urls(pages: DataFrame, rules: list[UrlRule], default: str = "allow", url_col: str = "url", **mining) -> DataFrame:
    """pages and (host, path, rule, verdict, mined_from): the fixed rule's verdict, else a mined rule's, else default.

    URLs that a fixed rule judges are the labelled rows that rules are mined from. Every row is
    kept, repeated ones too; a null URL or one without `://` has empty host and path and no host
    token. Columns of pages that carry one of the new names are replaced.
    """
    new = ["host", "path", "rule", "verdict", "mined_from", "tokens"]
    url = F.col(url_col)
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    base = pages.drop(*[c for c in new if c != url_col])
    base = base.withColumns({"host": url_host(url), "path": url_path(url), "tokens": F.array_sort(url_tokens(url))})
    base = base.withColumns({"rule": rule, "verdict": verdict})
    mined = mine_url_rules(base.where("rule is not null").select("tokens", "verdict"), **mining)
    mined = materialize(mined)
    known = [r.token for r in mined.select(F.explode("tokens").alias("token")).distinct().orderBy("token").toLocalIterator()]
    useful = F.array_sort(F.array_intersect("tokens", F.array(*map(F.lit, known)).cast("array<string>")))
    open_sets = base.where("rule is null").select("tokens").distinct().select("tokens", useful.alias("useful"))
    open_sets = materialize(open_sets)
    best = match_rules(open_sets.select(F.col("useful").alias("tokens")).distinct(), mined)
    found = open_sets.join(best.select(F.col("tokens").alias("useful"), "mined", "needs"), "useful").select("tokens", "mined", "needs")
    out = base.join(found, "tokens", "left")
    by_rule = F.col("rule").isNotNull()
    return out.select(
        *[c for c in base.columns if c not in new],
        "host",
        "path",
        "rule",
        F.when(by_rule, F.col("verdict")).otherwise(F.coalesce("mined", F.lit(default))).alias("verdict"),
        F.when(~by_rule, F.col("needs")).alias("mined_from"),
    )
