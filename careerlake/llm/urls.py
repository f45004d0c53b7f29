"""URL filter: a rule list, and gradient-boosted trees on lexical features for the rest.

The trees are trained on labelled URLs; here the rules label them, and URLs without a rule are
judged by what the trees have learned from those with one. Features are lengths, depth, shares of
digits, hyphens and upper-case letters, entropy, numbers of parameters and labels, and how often
a host's suffixes are blocked among the labelled URLs (smoothed by the overall share).

A null URL, or one without ``://``, has empty host and path, fits no rule, and is judged by the
trees like any other. Repeated URLs are judged alike. Without labelled URLs everything is allowed;
if the labels are all one, that label is the verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerlake.llm.common import drawn, fresh, let, positions, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host_: Column, path_: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict; null without one."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host_ == rule.host) | host_.endswith("." + rule.host)) & path_.startswith(rule.path)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _share(text: Column, pattern: str) -> Column:
    kept = F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    return kept / F.greatest(F.length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""

    def of(chars: Column) -> Column:
        def runs(ordered: Column) -> Column:
            n = F.size(ordered)
            ends = F.filter(positions(n), lambda i: (i == n - 1) | (F.get(ordered, i) != F.get(ordered, i + 1)))
            return let(ends, lambda e: F.aggregate(
                F.transform(e, lambda at, k: let(
                    (at - F.coalesce(F.get(e, k - 1), F.lit(-1))) / n, lambda p: -p * F.log2(p))),
                F.lit(0.0), lambda a, x: a + x,
            ))

        return let(F.sort_array(chars), runs)

    return of(F.array_remove(F.split(text, ""), ""))


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_share", "host_digit_share",
    "hyphen_share", "upper_share", "entropy", "host_entropy", "parameters", "query_length", "fragment",
    "longest_part", "secure", "known_suffix", "suffix_1", "suffix_2", "suffix_3",
)


def features(df: DataFrame, url: str, host_: str, path_: str, prefix: str) -> DataFrame:
    """Lexical features of URLs as new columns ``prefix + name``, but for the suffix shares."""
    u, h, p = F.coalesce(F.col(url), F.lit("")), F.col(host_), F.col(path_)
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    made = {
        "url_length": F.length(u), "host_length": F.length(h), "path_length": F.length(p),
        "depth": _count(p, "/+"), "labels": _count(h, r"\."), "digit_share": _share(u, "[0-9]+"),
        "host_digit_share": _share(h, "[0-9]+"), "hyphen_share": _share(u, "-+"),
        "upper_share": _share(u, "[A-Z]+"), "entropy": _entropy(u), "host_entropy": _entropy(h),
        "parameters": F.when(F.length(query) > 0, _count(query, "&") + 1).otherwise(0),
        "query_length": F.length(query), "fragment": u.contains("#").cast("int"),
        "longest_part": F.array_max(F.transform(F.split(p, r"[/._-]"), F.length)),
        "secure": u.startswith("https:").cast("int"),
    }
    return df.withColumns({prefix + name: value.cast("double") for name, value in made.items()})


def suffix(host_: Column, labels: int) -> Column:
    """The last labels of a host."""
    return F.substring_index(host_, ".", -labels)


@dataclass(frozen=True)
class UrlModel:
    """Trees, the shares of blocked URLs by suffix, and the overall share."""

    trees: GBTClassificationModel | None
    shares: DataFrame
    overall: float

    def block_chance(self, df: DataFrame, url: str, host_: str, path_: str) -> tuple[DataFrame, str]:
        """``df`` with the chance that a URL is to be blocked, and the name of that column."""
        name = fresh(df, "block_chance")
        if self.trees is None:
            return df.withColumn(name, F.lit(self.overall)), name
        prefix = fresh(df, "url_")
        wide = _with_shares(features(df, url, host_, path_, prefix), self.shares, self.overall, host_, prefix)
        vector, raw, chance, guess = (prefix + n for n in ("vector", "raw", "chance", "guess"))
        wide = VectorAssembler(inputCols=[prefix + f for f in FEATURES], outputCol=vector).transform(wide)
        judged = (
            self.trees.setFeaturesCol(vector).setRawPredictionCol(raw).setProbabilityCol(chance)
            .setPredictionCol(guess).transform(wide)
        )
        return judged.select(*df.columns, vector_to_array(F.col(chance)).getItem(1).alias(name)), name


def _with_shares(df: DataFrame, shares: DataFrame, overall: float, host_: str, prefix: str) -> DataFrame:
    """Join the suffix shares: one row per suffix, left to the planner, skew split by AQE."""
    for labels in (1, 2, 3):
        key, share = prefix + f"key_{labels}", prefix + f"suffix_{labels}"
        df = df.withColumn(key, suffix(F.col(host_), labels)).join(
            shares.filter(F.col("labels") == labels).select(F.col("suffix").alias(key), F.col("share").alias(share)),
            key, "left",
        ).drop(key)
        if labels == 2:
            df = df.withColumn(prefix + "known_suffix", F.col(share).isNotNull().cast("double"))
        df = df.withColumn(share, F.coalesce(share, F.lit(overall)))
    return df


def train(
    labelled: DataFrame, url: str = "url", label: str = "label", sample: int = 10_000, trees: int = 20,
    depth: int = 4, smoothing: float = 20.0, seed: int = 7,
) -> UrlModel:
    """Fit the filter on labelled URLs (1: block, 0: allow).

    Suffix statistics are over all labelled URLs. The trees see about ``sample`` different ones
    of them, as the bound on what one fit reads.
    """
    known = labelled.select(F.col(url).alias("url"), F.col(label).cast("double").alias("label")).filter("label is not null")
    known = written(known.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))), "labelled")
    seen = known.agg(F.count(F.lit(1)), F.avg("label")).first()
    overall = float(seen[1] or 0.0)
    shares = written(
        known.select("label", F.explode(F.array(*[
            F.struct(F.lit(n).alias("labels"), suffix(F.col("host"), n).alias("suffix")) for n in (1, 2, 3)
        ])).alias("s")).groupBy("s.labels", "s.suffix").agg(
            ((F.sum("label") + smoothing * overall) / (F.count(F.lit(1)) + smoothing)).alias("share")
        ),
        "shares",
    )
    if overall in (0.0, 1.0):
        return UrlModel(None, shares, overall)
    # Different URLs, drawn by their hash: no layout of files changes the trees, and no URL that a
    # third of the rows have fills the sample.
    single = known.dropDuplicates(["url", "label"])
    # So few rows in one order are cut into bins and summed alike, too.
    chosen = written(drawn(single, F.col("url"), sample, single.count(), seed).repartition(1).sortWithinPartitions("url", "label"), "sample")
    wide = _with_shares(features(chosen, "url", "host", "path", "f_"), shares, overall, "host", "f_")
    ready = written(
        VectorAssembler(inputCols=["f_" + f for f in FEATURES], outputCol="features").transform(wide).select("features", "label"),
        "features",
    )
    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, checkpointInterval=-1).fit(ready)
    return UrlModel(fitted, shares, overall)


def judged(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of those names are replaced."""
    pages = pages.drop("host", "path", "rule", "verdict")
    split = pages.withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url)))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.withColumn("rule", rule).withColumn("verdict", verdict)
    labelled = ruled.filter("verdict is not null").select(
        F.col(url).alias("url"), (F.col("verdict") == "block").cast("int").alias("label")
    )
    scored, chance = train(labelled).block_chance(ruled, url, "host", "path")
    return scored.withColumn(
        "verdict", F.coalesce("verdict", F.when(F.col(chance) > 0.5, "block").otherwise("allow"))
    ).drop(chance)
