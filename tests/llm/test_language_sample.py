"""The bounded sample of the language model: shares at any size, repeated and null ids, accuracy on held-out rows."""

import random

import pytest
from pyspark.sql import functions as F

from handtrace.llm import language

WORDS = {"en": "the and with that have this from they which their", "de": "der und mit dass haben diese von sie welche ihre",
         "fr": "les et avec que avoir cette dans ils dont leurs"}


def text(lang, rng):
    return " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "s", "en"]) for _ in range(rng.randint(8, 30)))


def test_share_is_never_zero():
    assert language.share_of(10) == 1 << 60
    for rows in (10**10, 10**13):
        assert 0.99 < language.share_of(rows) * rows / (1 << 60) / language.PER_LANGUAGE <= 1


def test_repeated_and_null_ids_are_sampled_by_text(spark, monkeypatch):
    monkeypatch.setattr(language, "PER_LANGUAGE", 40)
    rng = random.Random(1)
    docs = spark.createDataFrame([(None if i % 2 else 7, text("en", rng) + f" {i}", "en") for i in range(2000)],
                                 "doc_id long, text string, lang string")
    n = language.training_sample(docs).count()
    assert 15 <= n <= 80


@pytest.mark.parametrize("extra", [False, True])
def test_held_out_accuracy(spark, extra):
    rng = random.Random(2)
    rows = [(i, text(lang, rng), lang) for i in range(240) for lang in [sorted(WORDS)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    if extra:
        docs = docs.withColumns({"score": F.lit("x"), "order": F.lit(1), "lang_pred": F.lit("y")})
    model = language.fit(docs.where("doc_id % 4 <> 2"))
    got = language.predict(docs.where("doc_id % 4 = 2"), model).select("doc_id", "lang_pred").collect()
    truth = {i: lang for i, _, lang in rows}
    assert len(got) == 60 and sum(truth[r["doc_id"]] == r["lang_pred"] for r in got) >= 57
