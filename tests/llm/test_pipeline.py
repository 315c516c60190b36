"""Stages against plain Python on a small corpus, and the registry."""

import random

import numpy as np
import pandas as pd
from tokenizers import Tokenizer

import corpus_pipeline as cp
from planscope.llm import bpe, line_dedup, registry, toxicity
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_ngram_join import brute as brute_join
from tests.llm.test_toxicity import INSULTS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(folder):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["th", "on", "er", "in", "re", "an"]) for _ in range(rng.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage = line(60)
    docs, labels = [], []
    for i in range(160):
        lines = [line(rng.randint(3, 25)) for _ in range(rng.randint(1, 6))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            lines[0] += " you " + " ".join(rng.choice(INSULTS) for _ in range(4))
        if i % 9 == 0:
            lines.insert(1, passage)
        docs.append([i, "\n".join(lines), "en", f"s{i % 3}", 0])
        labels.append((i, 1, toxic))
    for i in range(160, 180):  # near copies that no whole line betrays: every line changes a little
        docs.append([i, "\n".join(x + " end" for x in docs[i - 100][1].split("\n")), "en", "s0", 0])
        labels.append((i, 1, labels[i - 100][2]))
    for d in docs:
        d[4] = len(d[1])
    pd.DataFrame(docs, columns=COLUMNS).to_parquet(f"{folder}/documents.parquet")
    pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).to_parquet(f"{folder}/labels.parquet")
    return passage


def test_stages(spark, tmp_path):
    passage = corpus(tmp_path)
    docs, rows = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        before = docs.toPandas()
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = before, docs.toPandas()
        if name != "bpe":
            assert docs.columns == COLUMNS

    before, after = rows["toxicity"]
    labels = pd.read_parquet(f"{tmp_path}/labels.parquet").set_index("doc_id")["toxic"]
    marked = before.assign(h=1)
    model = toxicity.fit_texts(marked.text.tolist(), labels.loc[marked.doc_id].to_numpy())
    assert abs(len(after) - (model.score(before.text.tolist()) < 0.5).sum()) <= 2
    assert np.mean([labels[d] == 0 for d in after.doc_id]) > 0.97
    assert len(set(before.doc_id[labels.loc[before.doc_id].to_numpy() == 0]) - set(after.doc_id)) <= 3

    before, after = rows["line_dedup"]
    gone = brute_lines(list(zip(before.doc_id, before.text, strict=True)), line_dedup.MIN_WORDS)
    want = {}
    for d, t in zip(before.doc_id, before.text, strict=True):
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])
        if left.strip() or not gone[d]:
            want[d] = left
    assert dict(zip(after.doc_id, after.text, strict=True)) == want
    assert sum(passage in t.split("\n") for t in after.text) == 1 and (after.n_chars == after.text.str.len()).all()

    before, after = rows["ngram_jaccard_join"]
    stays = {d for d, _, c in brute_join(list(zip(before.doc_id, before.text, strict=True)), 5, 80) if d == c}
    assert set(after.doc_id) == stays and len(stays) < len(before)

    before, after = rows["source_mix"]
    assert after.groupby("doc_id").size().max() <= 2 and set(after.doc_id) <= set(before.doc_id)
    total = lambda df: df.text.str.split().str.len().sum()
    assert abs(total(after) - 1.5 * total(before)) <= 0.05 * total(before)

    before, after = rows["bpe"]
    library = Tokenizer.from_file(bpe.tokenizer_path())
    texts = dict(zip(before.doc_id, before.text, strict=True))
    assert len(before) == len(after)
    for d, ids in zip(after.doc_id, after.token_ids, strict=True):
        assert list(ids) == library.encode(texts[d], add_special_tokens=False).ids


def test_run_equals_the_stages_and_names_are_complete(spark, tmp_path):
    corpus(tmp_path)
    a = cp.run(spark, str(tmp_path)).count()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == a > 0
    names = registry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
