"""Pipeline stages and queries on awkward tables: nulls everywhere, empty tables, repeated rows, long texts, clashing columns."""

import shutil

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
CLASHES = "id fp gone doc component star cell h1 start runs seed at item weights score label sources repeats rest least kept place u node ids node_key vector".split()


@pytest.fixture
def place(tmp_path):
    for name in ("labels", "benchmark", "pages", "conversations", "embeddings"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    return tmp_path


def awkward(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    line = "The same long passage stands here, word after word, in many of these texts. It goes on for a while. "
    rows = [(None, None, None, None, None), (None, "", "en", None, 0), (1000, None, "en", "s", None), (1001, "", None, "s", 0), (1002, " \n\t", "en", "s", 3), (1003, line * 3, "en", "s", 300), (1003, line * 3, "en", "s", 300),
            (1004, "x" * 300_000, "en", "s", 300_000), (1005, "word " * 60_000, "en", "s", 300_000), (None, line, "en", "s", 1), (1006, "\x00�\U0001f600  ", "xx", "s", 5)]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema)).select("*", *[F.lit(7).alias(c) for c in CLASHES])


def through(spark, docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        path = f"{sf_dir}/stage-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "bpe":
            assert sorted(docs.columns) == sorted(before.columns), name
            assert docs.count() <= before.count(), name
    return docs


def test_stages_on_awkward_rows(spark, place):
    docs = awkward(spark)
    out = through(spark, docs, str(place))
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(1003) == 1 and {i for i in ids if i is not None} <= {r.doc_id for r in docs.select("doc_id").collect()}
    once = corpus_pipeline.STAGES[1][1](spark, docs, str(place))
    assert once.filter("doc_id IS NULL").count() == 0 and once.filter("doc_id = 1003").count() == 1


def test_stages_on_empty_tables(spark, place):
    docs = awkward(spark).limit(0)
    assert through(spark, docs, str(place)).count() == 0
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.mode("overwrite").parquet(str(place / f"none-{name}.parquet"))
        (place / f"{name}.parquet").unlink()
        (place / f"none-{name}.parquet").rename(place / f"{name}.parquet")
    (place / "more").mkdir()
    for name in ("labels", "benchmark"):
        shutil.copytree(place / f"{name}.parquet", place / "more" / f"{name}.parquet")
    few = awkward(spark)
    got = through(spark, few, str(place / "more"))
    assert 0 < got.count() <= few.count()  # without labels every score is 0.5, without items nothing leaks


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_on_awkward_and_empty_tables(spark, place, name):
    tables = {
        "documents": awkward(spark),
        "pages": spark.createDataFrame([(None, None), (1, None), (None, "http://com/en/"), (2, "http://com/en/"), (2, "http://com/en/")], "page_id long, url string").withColumn("html", F.lit("x")),
        "conversations": spark.createDataFrame([(None, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (1, None, "assistant", "a"), (2, 5, None, "b" * 50_000)], "conv_id long, turn long, role string, text string"),
        "embeddings": spark.createDataFrame([(None, [1.0], 1), (1, None, 1), (2, [], 1), (3, [1.0, None], 1), (4, [1.0, 2.0], None), (5, [1.0, 2.0], 1), (6, [1.0, 2.0], 1), (6, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int"),
        "labels": spark.createDataFrame([(None, 1, 0), (1, None, None), (0, 1, 0), (0, 0, 1), (1003, 1, 1)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(None, "a b c d e f"), (1, None), (2, ""), (3, "the same long passage stands here word after word in many of these texts")], "item_id long, text string"),
    }
    for kind in ("odd", "none"):
        for t, df in tables.items():
            (df if kind == "odd" else df.limit(0)).write.parquet(str(place / kind / f"{t}.parquet"))
        got = QUERIES[name](spark, str(place / kind)).collect()
        whole = {"op2_simhash": 71, "op3_quality": 71, "op4_urls": 5, "op6_bpe": 71, "op7_embedding": 8, "op9_lm": 71, "op11_mixing": 71, "op12_merkle": 71}
        if kind == "none":
            assert len(got) == (name == "op1_chat")  # the probe conversation is always there
        elif name in whole:
            assert len(got) == whole[name]
        elif name == "op5_decontaminate":
            assert {(r.doc_id, r.item_id) for r in got} == {(1003, 3), (None, 3)}
        elif name == "op8_substring":
            assert 1003 in {r.doc_id for r in got}
