"""Held-out accuracy, codes, edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from planscope.llm import language_id as li

PARTS = {"en": ["th", "ing", "ou", "wh", "ed "], "de": ["sch", "ung", "ei", "ß", "en "], "fr": ["eau", "é", "qu", "ç", "es "], "es": ["ción", "ñ", "ll", "os ", "ar"], "pl": ["ł", "sz", "cz", "ów ", "ą"], "it": ["zione", "gli", "che ", "à", "io"]}


def corpus(langs, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(langs)
        rows.append((i, "".join(rng.choice(PARTS[lang]) + rng.choice(["a", "e", "", " "]) for _ in range(rng.randint(10, 80))), lang))
    return rows


@pytest.mark.parametrize("n", [2, 4, 6])
def test_held_out_accuracy(spark, n):
    rows = corpus(list(PARTS)[:n], 700, n)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.fit(docs.where("doc_id % 5 <> 0"), per_language=200)
    got = li.identify(docs.where("doc_id % 5 = 0").withColumn("score", F.lit(1)), model).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_codes():
    four = li.codewords(4)
    assert four.shape == (4, 7) and min((four[i] != four[j]).sum() for i in range(4) for j in range(i)) == 4
    many = li.codewords(20)
    assert min((many[i] != many[j]).sum() for i in range(20) for j in range(i)) >= many.shape[1] // 4


def test_edge_cases(spark):
    rows = corpus(["en", "de"], 200, 5)
    model = li.fit_texts([r[1] for r in rows], [r[2] for r in rows])
    names, score, close = model.predict([None, "", "123 !!", "thing", "the" * 60_000])
    assert names[:3] == ["und"] * 3 and score[:3].tolist() == [0, 0, 0] and names[4] == "en"
    mixed = model.predict([rows[0][1] + rows[1][1], "x"])[2]
    assert mixed.dtype == bool
    one = li.fit_texts(["abc"], ["en"])
    assert one.predict(["zzz", "1"])[0] == ["en", "und"]
    none = li.fit(spark.createDataFrame([(1, "a", None), (2, None, "en")], "doc_id long, text string, lang string"))
    assert none.predict(["abc"])[0] == ["und"]
    assert li.identify(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
