"""The pipeline against a plain account of what each stage must drop."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontam, sharding

EN = "the and of to in is that it was for with as river stone cloud lamp forest wind table garden window silver paper bridge".split()
DE = "der die das und ist von mit den dem nicht schule straße wald fluss lampe garten fenster silber papier brücke winter".split()


def prose(words, seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    item = prose(EN, 999, 30)
    rows = [(i, prose(EN if i % 2 else DE, i, 120), "en" if i % 2 else "de", f"s{i % 3}") for i in range(60)]
    rows += [(60, rows[3][1], "en", "s1"), (61, rows[4][1] + " ende", "de", "s1")]  # copies
    rows += [(62, prose(EN, 62, 60) + " " + item + " " + prose(EN, 63, 60), "en", "s2")]  # a benchmark passage
    rows += [(63, "the end", "en", "s2"), (64, "a|b " * 90, "en", "s2"), (65, None, None, None), (66, "", "en", "s0"), (67, "12345 --- 67", "en", "s0")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_drop_what_they_must(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dropped = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        dropped.append((name, before - {r["doc_id"] for r in kept.select("doc_id").collect()}))
        docs = kept
    drops = dict(dropped)
    assert {65, 66, 67} <= drops["language"] <= {64, 65, 66, 67}
    assert drops["quality"] | drops["language"] == {63, 64, 65, 66, 67}
    assert drops["near_duplicates"] == {60, 61} and drops["decontaminate"] == {62}
    rows = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert set(rows["doc_id"]) == set(range(60))
    assert (rows.groupby("doc_id")["length"].sum() == rows.groupby("doc_id")["doc_tokens"].max()).all()


def test_stages_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_native_operators_run_no_python(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    for out in (sharding.shard(docs, 4), decontam.overlaps(docs, bench)):
        plan = out._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
