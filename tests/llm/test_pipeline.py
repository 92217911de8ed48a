"""The pipeline against plain versions of its stages, and the queries' registration."""

import random
import time

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from lineloom.llm import quality, secrets

from . import brute
from .test_ops import documents, junk, prose


def test_pipeline_against_plain_stages(spark, tmp_path):
    rng = random.Random(12)
    bench = [(i, prose(rng, 30)) for i in range(4)]
    texts = [junk(rng) if i % 7 == 0 else prose(rng, rng.randint(40, 250)) for i in range(300)]
    texts += [texts[1], texts[1], texts[2] + " ", texts[3].replace(" ", " " + bench[0][1] + " ", 1), prose(rng, 90) + ' token = "' + "0123456789abcdef" * 2 + '"', None, ""]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)

    d = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(d, spark.read.parquet(f"{sf}/labels.parquet"), quality.training_row(5, 0))
    left = {i: t for i, t, *_ in docs if model.score(quality.np.array([quality.statistics(t)]))[0] >= quality.THRESHOLD}
    assert sum(i % 7 > 0 for i in left if i < 300) > 250 and sum(i % 7 == 0 for i in left if i < 300) < 6
    left = {min(g): left[min(g)] for g in brute.components({i: brute.fingerprint(t) for i, t in left.items()})}
    left = {i: t for (i, t), h in zip(left.items(), brute.hits(list(left.values()), bench), strict=True) if h[2] == 0}
    assert 303 not in left and 301 not in left

    stage, kept = d, {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, sf)
        assert stage.columns == d.columns
        stage.write.parquet(str(tmp_path / name))
        stage = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"]: r for r in stage.collect()}
    assert kept["decontamination"].keys() == left.keys() == kept["secrets"].keys()
    found = secrets.fit(spark.read.parquet(str(tmp_path / "decontamination")))
    for i, r in kept["secrets"].items():
        base, every, _ = secrets.spans(left[i], found)
        assert base == brute.secrets(left[i])
        assert r["text"] == (left[i] and secrets.redacted(left[i], every)) and r["n_chars"] == len(r["text"] or "")
        assert every or r["text"] == left[i]
    assert "[secret]" in kept["secrets"][304]["text"] and "0123456789abcdef" not in kept["secrets"][304]["text"]
    out = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == left.keys()
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_registration():
    names = __spark_entry__.queries()
    assert [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert len(corpus_pipeline.STAGES) == 5


def test_shuffles_go_with_their_queries(spark):
    rng = random.Random(36)
    texts = [prose(rng, 60) for _ in range(30)]
    texts += [t + " end" for t in texts]
    files = spark._jsc.sc().env().blockManager().diskBlockManager()
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    before = set(files.getAllFiles().mkString("\n").split("\n"))
    assert corpus_pipeline.unique(spark, documents(spark, texts), "").count() == 30
    for _ in range(20):
        left = [f for f in set(files.getAllFiles().mkString("\n").split("\n")) - before if "shuffle_" in f]
        if not left:
            break
        time.sleep(0.5)
    assert len(left) < 10
