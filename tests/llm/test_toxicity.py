"""Held-out accuracy, planted texts, edge cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from planscope.llm import toxicity as tx
from planscope.llm.common import fold

INSULTS = ["idiot", "stupid", "moron", "worthless", "pathetic"]


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = ["th", "on", "er", "in", "re", "an", "ou", "le", "st"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 120))]
        toxic = int(rng.random() < 0.2)
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(INSULTS))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = tx.fit(docs.select("doc_id", "text"), docs.where(fold(F.col("doc_id")) != 0).select("doc_id", "toxic"))
    got = tx.score_documents(docs.withColumn("score", F.lit("clash")), model).where(fold(F.col("doc_id")) == 0).collect()
    right = np.mean([r.predicted == r.toxic for r in got])
    assert len(got) > 120 and right > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_planted_and_edge_cases(spark):
    rows = corpus(600, 2)
    model = tx.fit_texts([r[1] for r in rows], np.array([r[2] for r in rows]))
    s = model.score(["you stupid idiot moron", "there in the re on", "", "in " * 50_000])
    assert s[0] > 0.5 and s[1] < 0.5 and 0 <= s[2] < 0.5 and s[3] < 0.5
    df = spark.createDataFrame([(1, None), (1, None), (None, "x")], "doc_id long, text string")
    assert tx.score_documents(df, model).where("score is not null").count() == 3
    assert tx.score_documents(df.limit(0), model).count() == 0
    none = tx.fit(df, spark.createDataFrame([(1, None), (2, 1)], "doc_id long, toxic int"))
    assert none.score(["anything"]).tolist() == [0.0]


def test_a_fit_is_repeatable():
    rows = corpus(300, 3)
    args = [r[1] for r in rows], np.array([r[2] for r in rows])
    assert np.array_equal(tx.fit_texts(*args).score(args[0]), tx.fit_texts(*args).score(args[0]))
