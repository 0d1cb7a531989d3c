"""Operator 10 [native]: quality rules as a learned decision list over text statistics.

Sequential covering (RIPPER's growing and pruning, Cohen 1995): a rule for "reject" is grown on two thirds of the
labelled rows by adding the threshold with the most information gain, pruned on the rest, and kept if it is right
often enough there; what it covers is taken out and the next rule is grown. The list becomes one ordered CASE
expression over statistics that are themselves built-in expressions: nothing leaves the JVM.

The list learns from the statistics of at most ``SAMPLE`` labelled documents (those with the smallest hashes of
doc_id; a dozen numbers each are fetched). The statistics of every document cover its whole text.

Defined cases: a null or empty text has no words and fails the base rules; rows without doc_id or label are judged
like others but not learned from; a doc_id with several labels counts with its largest; without labels of both
kinds the list is empty and keeps what the base rules keep; columns besides doc_id and text aren't looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SAMPLE = 5_000
SPACE = r"[\x20\x09-\x0D]+"
FEATURES = ["r_symbols", "r_dup_lines", "r_repeat", "word_length", "r_upper", "r_exclaim", "r_digits", "words_per_line", "r_distinct", "n_words"]
#: A list of conditions (feature, "<=" or ">", threshold), all of which must hold.
Rule = list[tuple[str, str, float]]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of text, as columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"))
    # Blanks at the ends would make empty words.
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    docs = docs.withColumn("words", words)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    docs = docs.withColumns({"n_words": F.size("words").cast("long"), "lines": lines, "h": F.transform("words", lambda w: F.xxhash64(w))})
    triples = F.when(F.col("n_words") < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.slice("h", 1, F.greatest(F.col("n_words").cast("int") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2)))
    )
    docs = docs.withColumn("triples", triples)
    # Only texts in which some window stands twice are looked at more closely: sorted, equal windows are neighbours.
    some = F.size(F.array_distinct("triples")) < F.size("triples")
    placed = F.when(some, F.array_sort(F.transform("triples", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    docs = docs.withColumn("placed", placed)
    equal = lambda a, b: F.coalesce(a["x"] == b["x"], F.lit(False))
    twice = F.filter("placed", lambda a, i: equal(a, F.get("placed", i - 1)) | equal(a, F.get("placed", i + 1)))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda a: F.array(a["i"], a["i"] + 1, a["i"] + 2))))
    docs = docs.withColumns(
        {
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": F.when(F.col("placed").isNull(), 0).otherwise(F.size(covered)).cast("long"),
            "n_upper": F.regexp_count("text", F.lit(r"\p{Lu}")),
            "n_digits": F.regexp_count("text", F.lit("[0-9]")),
            "n_exclaim": F.regexp_count("text", F.lit("!")),
            "n_lines": F.size("lines"),
            "n_distinct": F.size(F.array_distinct("h")),
        }
    )
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    ratios = {
        "r_symbols": F.col("n_symbols") / chars,
        "r_dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "r_repeat": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
        "r_upper": F.col("n_upper") / chars,
        "r_exclaim": F.col("n_exclaim") / chars,
        "r_digits": F.col("n_digits") / chars,
        "words_per_line": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
        "r_distinct": F.col("n_distinct") / words,
    }
    docs = docs.withColumns(ratios)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    docs = docs.withColumn("base_failed", failed).drop("text", "words", "lines", "h", "triples", "placed")
    # Through a generator of one row: a filter on a statistic would else be pushed down with all expressions unfolded in it.
    return docs.select("doc_id", F.inline(F.array(F.struct(*[c for c in docs.columns if c != "doc_id"]))))


# ---------------------------------------------------------------- learning
def _gain(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> np.ndarray:
    return p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9)) - np.log2(p0 / (p0 + n0)))


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, sign, at in rule:
        column = x[:, FEATURES.index(f)]
        out &= column <= at if sign == "<=" else column > at
    return out


def _grow(x: np.ndarray, y: np.ndarray) -> Rule:
    rule: Rule = []
    rows = np.ones(len(y), bool)
    while len(rule) < 4 and (~y[rows]).any() and y[rows].any():
        p0, n0 = int(y[rows].sum()), int((~y[rows]).sum())
        best = (1e-6, None)
        for i, f in enumerate(FEATURES):
            values = np.unique(np.quantile(x[rows, i], np.linspace(0, 1, 65), method="lower"))
            cuts = (values[1:] + values[:-1]) / 2 if len(values) > 1 else values  # half-way, with room on both sides
            under = x[rows, i][:, None] <= cuts
            p, n = under[y[rows]].sum(axis=0), under[~y[rows]].sum(axis=0)
            for sign, a, b in (("<=", p, n), (">", p0 - p, n0 - n)):
                g = _gain(a, b, p0, n0)
                if g[k := int(g.argmax())] > best[0]:
                    best = (g[k], (f, sign, float(cuts[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        rows &= _holds(x, rule[-1:])
    return rule


def _worth(x: np.ndarray, y: np.ndarray, rule: Rule) -> float:
    hit = _holds(x, rule)
    p, n = int((hit & y).sum()), int((hit & ~y).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn_rules(x: np.ndarray, bad: np.ndarray, precision: float = 0.9, most: int = 12) -> list[Rule]:
    """Rules for "reject", in order. x: FEATURES by rows; the rows' order decides which prune."""
    rules: list[Rule] = []
    prune = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    while len(rules) < most and (left & bad & ~prune).sum() >= 5:
        grow, hold = left & ~prune, left & prune
        rule = _grow(x[grow], bad[grow])
        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(x[hold], bad[hold], r))
        hit = _holds(x, rule) & left
        if not hit.any() or bad[hit].mean() < precision or _worth(x[hold], bad[hold], rule) < 2 * precision - 1:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def rules_column(rules: list[Rule]) -> Column:
    """The number of the first rule that holds (from 1), or null."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        holds = F.lit(True)
        for f, sign, at in rules[k - 1]:
            holds = holds & (F.col(f) <= at if sign == "<=" else F.col(f) > at)
        out = F.when(holds, k).otherwise(out)
    return out


def rules_from(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    one = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = written(chosen, "labelled")  # at most ``sample`` rows: a proven bound for the broadcast
    rows = with_statistics(docs.join(F.broadcast(chosen), "doc_id", "left_semi")).join(F.broadcast(chosen), "doc_id")
    rows = rows.filter("NOT base_failed").select("quality", *FEATURES).orderBy(F.xxhash64("doc_id"), "word_chars").limit(2 * sample).collect()
    x = np.array([[r[f] for f in FEATURES] for r in rows], float).reshape(len(rows), len(FEATURES))
    return learn_rules(x, np.array([r["quality"] == 0 for r in rows], bool))


def judge_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """All statistics, base_failed, rule (number of the rejecting rule) and kept for each row of docs."""
    found = with_statistics(docs).withColumn("rule", rules_column(rules_from(docs, labels, sample)))
    return found.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
