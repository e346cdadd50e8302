"""Language identification on made-up languages and on held-out documents."""

import random

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from cohortlab.llm import language

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ber", "ung", "ein"], "cc": ["που", "και", "τον", "ένα"]}


def text(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(2)
    rows = [(text(lang, 60, rng), lang) for lang in SYLLABLES for _ in range(30)] + [("xx yy", None), (None, "aa")]
    return language.learn(spark.createDataFrame(rows, "text string, lang string"))


def test_one_language(spark, model):
    rng = random.Random(3)
    rows = [(i, lang, text(lang, n, rng)) for i, (lang, n) in enumerate((a, n) for a in SYLLABLES for n in (2, 20, 400))]
    out = language.identify(spark.createDataFrame(rows, "doc_id long, lang string, text string"), model).collect()
    assert all(r.lang_pred == r.lang and r.score == 1.0 and list(r.languages) == [r.lang] for r in out)


def test_mixture_has_its_proportions(spark, model):
    rng = random.Random(4)
    mixed = text("aa", 300, rng) + " " + text("bb", 100, rng)
    row = language.identify(spark.createDataFrame([(mixed,)], "text string"), model).first()
    assert set(row.languages) == {"aa", "bb"} and row.lang_pred == "aa"
    share = sum(map(len, mixed.split()[:300])) / len(mixed.replace(" ", ""))
    assert abs(row.score - share) < 0.1


def test_texts_without_letters_and_clashing_names(spark, model):
    rows = [(1, None, "q"), (2, "", "q"), (3, "12 + 34 !", "q"), (4, "é", "q"), (4, "é", "q"), (None, "a", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    out = language.identify(docs, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score", "languages"]
    got = {(r.doc_id, r.lang_pred == "und", r.score > 0) for r in out.collect()}
    assert got == {(1, True, False), (2, True, False), (3, True, False), (4, False, True), (None, False, True)}
    assert language.identify(docs.limit(0), model).count() == 0


def test_nothing_learned(spark):
    model = language.learn(spark.createDataFrame([("a", None)], "text string, lang string"))
    row = language.identify(spark.createDataFrame([("some text",)], "text string"), model).first()
    assert (row.lang_pred, row.score) == ("und", 0.0)


def test_held_out_documents(spark):
    docs = spark.read.parquet(TESTDATA.replace("0.001", "0.01") + "/documents.parquet").withColumn("out", language.held_out())
    out = language.identify(docs.where("out"), language.learn(docs.where(~F.col("out"))))
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98
