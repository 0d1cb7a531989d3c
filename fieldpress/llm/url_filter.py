"""Operator 5 [native]: URL rules, and gradient-boosted trees on lexical features where no rule fits.

Rules are (host, path) pairs: a rule fits its host and all subdomains if the url's path starts with the rule's; of
those that fit, the longest host, then the longest path, decides. URLs that a rule decides are the labelled ones:
the trees learn from at most ``SAMPLE`` of them (those with the smallest url hashes; tasks pass on a range of hashes that
holds about twice as many, so that what the driver gets doesn't grow with the number of tasks) and become one Spark
expression, so scoring is a projection that never leaves the JVM.

A suffix's odds are learned from the same labels as the trees, so for the trees they are taken out of fold: a url's odds
come from the hosts of the other ``FOLDS`` - 1 folds. Hosts of one fold are held out entirely while ``held_out_accuracy``
is measured.

Features: length, depth, digit ratio, entropy over characters, parameters, host labels, longest run between
separators, and of the host's last label its length and the smoothed log-odds of "block".

Defined cases: for a null url or one without ``://`` host and path are empty, no rule fits and the trees decide;
equal rows get equal verdicts; without labelled URLs, or with one label only, the trees are a constant;
an empty table gives no rows; a null page_id stays null; further columns aren't looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = 20_000
SUFFIXES, FOLDS = 64, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
FEATURES = ["f_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_run", "f_suffix_length", "f_suffix_odds"]


def parsed(pages: DataFrame) -> DataFrame:
    """Adds host and path."""
    at = F.coalesce(F.instr("url", "://"), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def rule_of(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of host and path; both null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: (len(r[1]), len(r[2]))):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def with_features(pages: DataFrame) -> DataFrame:
    """Adds the lexical features of url, host and path (all but the suffix's odds)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    low = F.translate(url, UPPER, LOWER)
    signs = LOWER + "0123456789/.-_=&?:%#"
    shares = [(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))) / n for c in signs]
    entropy = sum((F.when(s > 0, -s * F.log2(s)).otherwise(0.0) for s in shares), F.lit(0.0))
    count = lambda c, of: (F.length(of) - F.length(F.replace(of, F.lit(c), F.lit("")))).cast("double")
    suffix = F.substring_index("host", ".", -1)
    return pages.withColumns(
        {
            "f_length": F.length(url).cast("double"),
            "f_depth": count("/", F.col("path")),
            "f_digits": (F.length(url) - F.length(F.translate(url, "0123456789", ""))) / n,
            "f_entropy": entropy,
            "f_params": count("=", url) + count("&", url),
            "f_labels": count(".", F.col("host")) + 1,
            "f_run": F.coalesce(F.array_max(F.transform(F.split(url, r"[^0-9A-Za-z]+"), lambda x: F.length(x))), F.lit(0)).cast("double"),
            "f_suffix_length": F.length(suffix).cast("double"),
            "suffix": F.when(F.length(suffix) <= 24, suffix).otherwise("other"),
        }
    )


@dataclass
class Trees:
    """Boosted regression trees on logits; a tree is a leaf's value or (feature, threshold, left, right): left if value <= threshold."""

    base: float = 0.0
    trees: list = field(default_factory=list)
    odds: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def fit(x: np.ndarray, suffix: list[str], y: np.ndarray, fold: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3) -> Trees:
        """y: 1 for block; fold: that of a row's host. x lacks the last feature, which is learned here."""
        out = Trees()
        if not len(y):
            return out
        prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        out.base = prior
        if y.min() == y.max():
            return out
        values, place, count = np.unique(np.array(suffix), return_inverse=True, return_counts=True)
        known = np.zeros(len(values), bool)
        known[np.argsort(-count, kind="stable")[:SUFFIXES]] = True

        def odds(rows: np.ndarray) -> np.ndarray:
            n, block = (np.bincount(place[rows], weights=w, minlength=len(values)) for w in (None, y[rows]))
            return np.where(known & (n > 0), np.log((block + 1) / (n - block + 1)), prior)

        out.odds = {str(values[i]): float(v) for i, v in enumerate(odds(np.arange(len(y)))) if known[i]}
        apart = np.array([odds(np.flatnonzero(fold != f)) for f in range(FOLDS)])
        x = np.column_stack([x, apart[fold, place]])
        cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 33), method="lower")) for c in x.T]
        logit = np.full(len(y), prior)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-logit))
            tree = _grow(x, y - p, p * (1 - p), cuts, np.arange(len(y)), depth, rate)
            out.trees.append(tree)
            logit += _apply(tree, x)
        return out

    def logits(self, x: np.ndarray, suffix: list[str]) -> np.ndarray:
        """The same sum as ``logit`` for rows of features (without the last)."""
        x = np.column_stack([x, [self.odds.get(s, self.base) for s in suffix]])
        return self.base + sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def logit(self) -> Column:
        """The sum of all trees as a Spark expression over FEATURES."""
        return sum((_column(t) for t in self.trees), F.lit(self.base))

    def odds_column(self) -> Column:
        out = F.lit(self.base)
        for s, v in self.odds.items():
            out = F.when(F.col("suffix") == s, v).otherwise(out)
        return out


def _grow(x, gradient, weight, cuts, rows, depth, rate):
    g, h = gradient[rows].sum(), weight[rows].sum()
    best = (1e-6, None, None)
    if depth and len(rows) >= 40:
        for f, at in enumerate(cuts):
            left = x[rows, f][:, None] <= at
            gl, hl = gradient[rows] @ left, weight[rows] @ left
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(left.sum(axis=0) < 10) | (left.sum(axis=0) > len(rows) - 10)] = -1
            if (i := int(gain.argmax())) is not None and gain[i] > best[0]:
                best = (gain[i], f, float(at[i]))
    if best[1] is None:
        return float(rate * g / (h + 1))
    left = x[rows, best[1]] <= best[2]
    return best[1], best[2], _grow(x, gradient, weight, cuts, rows[left], depth - 1, rate), _grow(x, gradient, weight, cuts, rows[~left], depth - 1, rate)


def _apply(tree, x):
    if isinstance(tree, float):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], _apply(tree[2], x), _apply(tree[3], x))


def _column(tree) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    return F.when(F.col(FEATURES[tree[0]]) <= tree[1], _column(tree[2])).otherwise(_column(tree[3]))


def labelled_rows(found: DataFrame, sample: int) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(features, suffixes, 1 for block, fold of the host) of at most ``sample`` urls that a rule decides."""
    labelled = found.filter("rule IS NOT NULL").select(F.xxhash64("url").alias("k"), "page_id", "suffix", "decided", *FEATURES[:-1], F.pmod(F.xxhash64("host"), F.lit(FOLDS)).alias("fold"))
    n = found.filter("rule IS NOT NULL").count()
    part = F.pmod(F.col("k"), F.lit(1 << 30)) < int(min(1.0, 2 * sample / max(n, 1)) * (1 << 30))
    rows = labelled.filter(part).orderBy("k", "page_id").limit(sample).collect()
    x = np.array([[r[f] for f in FEATURES[:-1]] for r in rows]).reshape(len(rows), len(FEATURES) - 1)
    return x, [r["suffix"] for r in rows], np.array([float(r["decided"] == "block") for r in rows]), np.array([r["fold"] for r in rows], np.int64)


def _found(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    rule, verdict = rule_of(rules)
    return with_features(parsed(pages.select("page_id", "url")).withColumns({"rule": rule, "decided": verdict}))


def held_out_accuracy(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, sample: int = SAMPLE) -> tuple[float, int]:
    """(share of right verdicts, urls) on the hosts of the last fold, for trees that learned from the other hosts."""
    x, suffix, y, fold = labelled_rows(_found(pages, rules), sample)
    apart = np.flatnonzero(fold == FOLDS - 1)
    rest = np.flatnonzero(fold != FOLDS - 1)
    trees = Trees.fit(x[rest], [suffix[i] for i in rest], y[rest], fold[rest])
    right = (trees.logits(x[apart], [suffix[i] for i in apart]) >= 0) == (y[apart] > 0)
    return float(right.mean()) if len(apart) else 0.0, len(apart)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the trees' probability of "block") for each row of pages (page_id, url)."""
    found = _found(pages, rules)
    trees = Trees.fit(*labelled_rows(found, sample))
    found = found.withColumn("f_suffix_odds", trees.odds_column())
    found = found.withColumn("score", 1 / (1 + F.exp(-trees.logit())))
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("decided", method).alias("verdict"), "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
