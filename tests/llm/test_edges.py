"""Columns whose names clash with those of the operators, null ids, and empty tables, in operators and pipeline stages."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from rewritelab.llm import decontamination, fingerprints, html_text, language, mixing, personal_data, scoring, sharding, simhash

CLASHING = (
    "size score shard key label fp at node u v component_id fingerprint position slot target taken copies positions lang_pred held_out spans words value n_tokens n_bytes law __key __row __n __position "
    "__positions __kept __bad __lang __score __folded __doc __words __digest __q __class __order __bucket bucket word token n containment kind start end base_score text_crc32 source_size n_known"
).split()
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
TEXTS = [None, "", BASE, "quite other words that go on for a while here", "der Hund und die Katze laufen", "mail a@b.co or call +1 (269) 555-3296"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, TEXTS[i % 6], ["en", None, "de"][i % 3], ["a", None][i % 2], 3) + ("q",) * len(CLASHING) for i in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([("i1", BASE)], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.mark.parametrize(
    "run",
    [
        lambda d: language.predict(d, language.learn(d, "text", "lang")).select("doc_id", "lang_pred", "score"),
        simhash.near_duplicates,
        lambda d: sharding.shard_rows(d, 5),
        mixing.plan_mix,
        fingerprints.fingerprint,
        lambda d: personal_data.personal_data(d, personal_data.fit([])),
        lambda d: scoring.score_documents(d.withColumn("held_out", F.col("doc_id") % 10 == 0)),
        lambda d: html_text.extract(d.select(F.col("doc_id").alias("page_id"), F.lit("http://h.example.com/").alias("url"), F.col("text").alias("html"), *[f"`{c}`" for c in CLASHING])),
    ],
)
def test_clashing_names(clashing, run):
    assert len(run(clashing).collect()) == 30 and run(clashing.limit(0)).count() == 0


def test_clashing_names_of_items(spark, clashing):
    items = clashing.filter("doc_id = 2").withColumn("item_id", F.lit("i"))
    assert sorted(r["doc_id"] for r in decontamination.contained(clashing, items).collect()) == [2, 8, 14, 20, 26]


def test_too_many_labels_are_refused(clashing, monkeypatch):
    monkeypatch.setattr(language, "MOST_LABELS", 1)
    with pytest.raises(ValueError):
        language.learn(clashing, "text", "lang")


@pytest.mark.parametrize("nulls", [False, True])
def test_stages(spark, clashing, sf_dir, nulls):
    docs = clashing.withColumn("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("doc_id"))) if nulls else clashing
    want = {
        "language": sorted(TEXTS[2:] * 5),
        "near_duplicates": sorted({t or "" for t in TEXTS}),
        "decontamination": sorted([t or "" for t in TEXTS if t != BASE] * 5),
    }
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir)
        assert name == "sharding" or got.columns == docs.columns
        if name in want:
            assert sorted(r["text"] or "" for r in got.collect()) == want[name]
        elif name == "mixing":
            words = sum(len((r["text"] or "").split()) for r in got.collect())
            assert abs(words - 1.5 * sum(len((t or "").split()) for t in TEXTS) * 5) <= 60
        else:
            assert got.count() == 30
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_all_null(spark, sf_dir):
    docs = spark.createDataFrame([(None,) * 5] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    assert [stage(spark, docs, sf_dir).count() for _, stage in corpus_pipeline.STAGES] == [0, 1, 3, 0, 3]


def test_word_counts(spark):
    import re

    texts = ["", " ", "a", "a b", "\ta\x0b\x0cb\r\nc  ", "x\x1cy\x85z w v", "é ö", "x" * 70_000 + " y"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", mixing.n_words(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]
