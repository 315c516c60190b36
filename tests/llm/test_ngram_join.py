"""Components against brute force over real shingle sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from planscope.llm import ngram_join as nj
from planscope.llm import shingles
from planscope.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_set(text, words):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute(rows, words, percent):
    sets = [word_set(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min([x for x in (least.get(r), d) if x is not None], default=None)
    return sorted(((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, groups, copies, length, edits):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(1, length))]
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(rng.choice([" ", "\n", "\t "]).join(x.title() if rng.random() < 0.1 and x.isascii() else x for x in w))
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("words,percent,seed", [(4, 85, 1), (5, 80, 2)])
def test_against_brute_force(spark, words, percent, seed):
    rows = corpus(seed, 60, 8, 60, 4) + [(9001, None), (9002, ""), (9003, " \n"), (9004, "one two"), (9005, "ONE\ttwo"), (9006, "one two three")]
    got = nj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=words, percent=percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, words, percent)


def test_large_columns_go_through_blocks(spark, monkeypatch):
    rows = corpus(5, 2, 1, 80, 0)
    base = rows[0][1].split()
    while len(base) < 70:
        base += base
    base = [f"{x}{i}" for i, x in enumerate(base)]
    rng = random.Random(4)
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"new{rng.random()}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(nj, "BLOCK", 60)
    got = nj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=85).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 4, 85)


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(4, "a b c d e f g"), (4, "a b c d e f g"), (None, "a b c d e f g"), (None, "other words are in this text"), (None, None)]
    rows += [(None, " ".join(f"n{i}" for i in range(90))), (None, " ".join(f"n{i}" for i in range(88)))]
    got = nj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=85).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 4, 85)
    assert nj.jaccard_components(spark.createDataFrame([], "doc_id long, text string"), words=4, percent=85).count() == 0


def test_word_hashes_do_not_depend_on_place():
    long = "x" * 70_000
    a = list(shingles.shingle_sets([f"{'q ' * 40_000}alpha beta gamma {long} delta", f"alpha beta gamma {long} delta"], 5))
    assert set(a[1]) <= set(a[0])
    assert shingles.set_signature(a[1]) != shingles.set_signature(a[0])


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (1, 0)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)}


@pytest.mark.parametrize("classes,copies,before", [(40, 240, 5000), (18, 240, 5681), (64, 200, 3000), (70, 240, 5000)])
def test_columns_that_batches_cut_keep_all_links(classes, copies, before):
    """Every two classes of a column are a pair or both members, however often tasks sent them and batches end."""
    token = np.append(np.arange(before), np.full(classes * copies, before)).astype(np.int64)
    name = np.append(np.full(before, -1), np.repeat(np.arange(classes), copies)).astype(np.int64)
    place = np.full(len(token), 100 << 32, dtype=np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 10_000]) for c in (token, name, place)], names=["token", "class", "place"]) for i in range(0, len(token), 10_000)]
    out = [r for b in nj._bucket_pairs(85)(iter(batches)) for r in b.to_pylist()]
    members = {r["a"] for r in out if r["b"] is None}
    links = {(r["a"], r["b"]) for r in out if r["b"] is not None} | {(a, b) for a in members for b in members if a < b}
    assert links == {(a, b) for a in range(classes) for b in range(a + 1, classes)}
    assert bool(members) == (classes > nj.SMALL)


def test_large_columns_of_many_sizes(spark, monkeypatch):
    """A passage in documents of very different sizes: bands keep far sizes apart and lose no link."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(180):
        w = passage + [f"own{i // 3}x{j}" for j in range(rng.choice([0, 2, 5, 30, 90, 400]))]
        if rng.random() < 0.3:
            w[rng.randrange(len(w))] = f"new{i}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(nj, "BLOCK", 20)
    monkeypatch.setattr(nj, "SMALL", 8)
    got = nj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=4, percent=85).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 4, 85)


def test_far_bands_do_not_meet(spark):
    members = spark.createDataFrame([(1, c, n) for c, n in enumerate([10, 11, 12, 100, 110, 1000, 1100] * 3)], "token long, class long, size long")
    size = {c: n for c, n in enumerate([10, 11, 12, 100, 110, 1000, 1100] * 3)}
    together = {}
    for r in nj._deal(members, 85).collect():
        together.setdefault((r.lo, r.hi), set()).add(r["class"])
    met = {(a, b) for g in together.values() for a in g for b in g if a < b}
    assert {(a, b) for a in size for b in size if a < b and 100 * min(size[a], size[b]) >= 85 * max(size[a], size[b])} <= met
    assert not any(10 * min(size[a], size[b]) < 5 * max(size[a], size[b]) for a, b in met)


def test_repeated_rows_make_no_more_links(spark):
    a = " ".join(f"n{i}" for i in range(60))
    rows = [(1, a)] * 60 + [(2, a + " end")] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs = docs.selectExpr("doc_id", "text", "doc_id AS key", "xxhash64(text) AS hash")
    described, sketch = nj.describe(docs, 4)
    assert nj.class_links(docs, described, sketch, 4, 85).count() == 1


def test_one_row_of_each_component_stays(spark):
    a, other = " ".join(f"n{i}" for i in range(60)), " ".join(f"m{i}" for i in range(60))
    rows = [(1, a, "x"), (5, a, "x"), (5, other, "x"), (7, a + " end", "y"), (7, a + " end", "y"), (None, a, "z"), (None, "quite alone", "z"), (None, None, "n"), (8, "", "n"), (8, "", "n")]
    rows += [(9, "twice here", "t"), (9, "twice here", "t"), (None, "no id twice", "t"), (None, "no id twice", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash string").withColumnRenamed("hash", "n")
    got = nj.first_of_components(df, words=5, percent=80)
    assert got.columns == df.columns
    want = [(1, a, "x"), (5, other, "x"), (None, "quite alone", "z"), (None, None, "n"), (8, "", "n"), (8, "", "n"), (9, "twice here", "t"), (None, "no id twice", "t")]
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame(want, df.schema).collect()))
    late = [(None, a, "z"), (None, a + " end", "z"), (None, a, "z")]
    assert nj.first_of_components(spark.createDataFrame(late, df.schema), words=5, percent=80).count() == 1
    assert nj.first_of_components(spark.createDataFrame([], df.schema), words=5, percent=80).count() == 0
