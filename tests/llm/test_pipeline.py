"""The pipeline against its stages' brute-force meaning, on a small corpus."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import VOCAB


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(4)

    def words(n):
        return list(rng.choice(VOCAB, n))

    item, passage = words(30), words(60)
    texts = [words(120) for _ in range(120)]
    for k in range(0, 120, 4):  # junk, as labelled
        texts[k] = [w + "###" for w in texts[k]]
    texts[5] = list(texts[1])
    texts[9] = [*texts[1][:119], "other"]
    texts[11] = [*texts[11][:50], *item, *texts[11][50:]]
    texts[13], texts[17] = [*texts[13], *passage], [*texts[17], *passage]
    docs = [(k, " ".join(t), "xx", "s", 1) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(120)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, str(tmp_path))
        out.write.parquet(str(tmp_path / name.replace(" ", "-")))
        out = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        left[name] = out
    ids = lambda name: {r.doc_id for r in left[name].collect()}
    assert ids("quality classifier") == {k for k in range(120) if k % 4}
    assert ids("n-gram Jaccard join") == ids("quality classifier") - {5, 9}
    kept = {r.doc_id: r for r in left["substring dedup"].collect()}
    assert kept[13].text.split() == texts[13] and kept[17].text.split() == texts[17][:120] and kept[17].n_chars == len(kept[17].text)
    assert ids("benchmark decontamination") == ids("substring dedup") - {11}
    assert ids("best-fit packing") == ids("benchmark decontamination")
    assert left["benchmark decontamination"].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, repeated rows and doc_ids, a very long text, empty tables, and columns with the names that stages use themselves."""
    rng = np.random.default_rng(6)
    base = [" ".join(rng.choice(VOCAB, 150)) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(base)] + [(None, base[0]), (None, None), (1, base[1]), (1, base[2]), (50, ""), (51, None), (51, None), (52, " ".join(rng.choice(VOCAB, 60_000))), (53, base[3])]
    extra = {"row_": 1, "quality_score": "q", "quality_score_": 2.0, "a.b": "x", "rest": "r", "t": 5, "spans": 7, "k": None, "label": "l", "n_words": 3}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in extra.items():
        docs = docs.withColumn(name, F.lit(value).cast("string") if value is None else F.lit(value))
    docs = docs.withColumn("m", F.create_map(F.lit("x"), F.col("doc_id")))
    spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, base[7]), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        found = out.collect()
        if name != "best-fit packing":
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
            assert all(r["a.b"] == "x" and r["quality_score_"] == 2.0 and r["row_"] == 1 for r in found)
        ids = sorted((r.doc_id for r in found), key=repr)
        if name == "n-gram Jaccard join":
            assert ids == sorted([*(k for k in range(40) if k != 2), None, None, 50, 51, 52], key=repr)  # 1 has the text of 2 too
        if name == "benchmark decontamination":
            assert len(found) == len(rows) - 1
        if name == "substring dedup":
            assert len(found) == len(rows) - 2  # 2 and 53 have nothing left
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
