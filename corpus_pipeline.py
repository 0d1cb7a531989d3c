"""A corpus pipeline: five stages, each one operator of ``fieldpress.llm``, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpress.llm.common import written
from fieldpress.llm.decontamination import without_leaks
from fieldpress.llm.ngram_join import ngram_classes
from fieldpress.llm.packing import pack
from fieldpress.llm.quality_classifier import THRESHOLD, held_out, train, with_scores
from fieldpress.llm.substring_dedup import remove_repeats
from fieldpress.llm.tokens import vocabulary


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under its threshold go.

    Null and empty texts are scored like others; equal rows get equal scores; rows without a doc_id are scored but not learned
    from; without labels all scores are 0.5 and all rows stay; an empty table stays empty; any other columns are kept as they are.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.filter(~held_out()))
    score = _free(docs, "quality_score")
    return with_scores(docs, model, score).filter(F.col(score) >= THRESHOLD).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id stays.

    Of several rows with that doc_id the one with the smallest text hash stays. Rows without a doc_id have no class and stay; null
    and empty texts are linked with nothing; an empty table stays empty; any other columns are kept as they are.
    """
    classes = written(ngram_classes(docs), "classes")
    others = classes.filter("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(others, "doc_id", "left_anti")
    twice = classes.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if twice.isEmpty():  # the rule: then no row has to be looked at for its doc_id again
        return kept.select(*map(_column, docs.columns))
    # Of rows with one doc_id: by hash of text and then of the row, in aggregates that are summed up before they meet.
    names, plain = [_column(c) for c in docs.columns], [_column(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    one = kept.join(twice, "doc_id", "left_semi").select(F.col("doc_id").alias("k"), F.struct(*names).alias("row"), F.xxhash64("text").alias("t"), F.xxhash64(*plain).alias("h"))
    one = one.groupBy("k").agg(F.min_by("row", F.struct("t", "h")).alias("row")).select(*(F.col("row")[c].alias(c) for c in docs.columns))
    return kept.join(twice, "doc_id", "left_anti").select(*names).unionByName(one)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut; a document with nothing left goes.

    Empty and short texts lose nothing and stay, null ones as empty; rows without a doc_id neither give nor take; rows that share a doc_id are
    one document; n_chars follows the text where it is cut; an empty table stays empty; any other columns are kept as they are.
    """
    rest = [c for c in docs.columns if c != "text"]
    found = remove_repeats(docs, carry=rest).filter("n_removed = 0 OR n_removed < n_words")
    columns = {c: F.col("rest")[c] for c in rest} | {"text": F.col("kept_text")}
    if "n_chars" in rest:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(columns["n_chars"])
    return found.select(*(columns[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none; equal rows share their fate; an empty table or benchmark changes nothing; any other columns
    are kept as they are.
    """
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 4096 tokens.

    Null and empty texts are one end id; rows without a doc_id, or with one that others have, are packed like all others; an empty
    table gives no rows; other columns are not looked at.
    """
    return pack(docs, vocabulary())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: Neither the classifier's scores nor token ids can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
