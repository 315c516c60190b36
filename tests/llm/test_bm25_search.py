"""Top k against scoring everything."""

import math
import random
import re
from collections import Counter

import pytest

from planscope.llm import bm25_search as bm


def tokens(text):
    return re.findall("[0-9a-z_\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, queries, k):
    rows = [(d, Counter(tokens(t))) for d, t in rows if d is not None]
    mean = sum(sum(c.values()) for _, c in rows) / len(rows)
    df = Counter(t for _, c in rows for t in c)
    out = {}
    for q, text in queries:
        scored = []
        for d, c in rows:
            s = 0.0
            for t in set(tokens(text)):
                if t in c:
                    idf = math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5))
                    s += idf * c[t] * (bm.K1 + 1) / (c[t] + bm.K1 * (1 - bm.B + bm.B * sum(c.values()) / mean))
            if s > 0:
                scored.append((-round(s, 9), d))
        out[q] = sorted(scored)[:k]
    return out


@pytest.mark.parametrize("queries,shard", [(8192, 32768), (7, 50)])
def test_against_scoring_everything(spark, monkeypatch, queries, shard):
    monkeypatch.setattr(bm, "QUERIES", queries)
    rng = random.Random(8)
    vocab = [f"w{i}" if i % 3 else f"É{i}" for i in range(900)]
    weight = [1 / (i + 1) for i in range(900)]
    rows = [(i, " ".join(x.upper() if x.isascii() and rng.random() < 0.2 else x for x in rng.choices(vocab, weight, k=rng.randint(1, 80))) + ", end.") for i in range(400)]
    rows += [(400, rows[50][1]), (401, ""), (402, None), (450, "!!!"), (None, "w1 w2"), (500, rows[50][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ask = [(d, t) for d, t in rows if d is not None and d % 50 == 0 and tokens(t)]
    got = {}
    for r in bm.search(df, df.where("doc_id % 50 = 0"), k=10).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((-round(r.score, 9), r.doc_id))
    want = brute(rows, ask, 10)
    assert got.keys() == want.keys()
    for q in want:
        assert [x[1] for x in got[q]] == [x[1] for x in want[q]] and all(abs(a[0] - b[0]) < 1e-6 for a, b in zip(got[q], want[q], strict=True))


def shard_of(terms, counts, size, ids=None):
    import numpy as np

    df = np.bincount(np.concatenate(terms), minlength=size)
    row = bm.pack(np.arange(len(terms)) if ids is None else ids, [t.astype(np.int64) for t in terms], list(counts))
    mean = float(np.mean([c.sum() for c in counts]))
    return bm.Shard(row, np.arange(size), np.log(1 + (len(terms) - df + 0.5) / (df + 0.5)), mean), df


def search_one(shard, query, k, floor=0.0):
    return shard.tops([shard.known(query)], k, [floor])[0]


def test_a_shard_prunes():
    """Twelve vocabularies: blocks of the other ones are not opened, and fewer parts are read than without pruning."""
    import numpy as np

    rng = np.random.default_rng(1)
    p = (p := 1 / np.arange(1, 301)) / p.sum()
    terms = [np.sort(rng.choice(300, 20, replace=False, p=p)) + 300 * (i % 12) for i in range(12_000)]
    shard, _ = shard_of(terms, [np.ones(20, np.int32)] * 12_000, 3600)
    own = shard.known(terms[0])
    everything = shard.full(np.arange(12_000), own)
    frequent, rare = int((shard.row[own] >= 0).sum()), int(sum(shard.post[t + 1] - shard.post[t] for t in own if shard.row[t] < 0))
    assert frequent > 5
    docs, scores = search_one(shard, terms[0], 10)
    assert shard.doc_ids[docs[0]] == 0 and np.allclose(scores, np.sort(everything)[::-1][:10])
    for floor, share in ((scores[-1], 1 / 12), (scores[0], 1 / 50), (2 * scores[0], 1 / 100)):
        shard.touched = 0
        docs, _ = search_one(shard, terms[0], 10, floor)
        assert len(docs) == (everything >= floor).sum() and shard.touched - rare < frequent * 12_000 * share


@pytest.mark.parametrize("k", [1, 10, 200])
def test_a_shard_is_exact(k):
    import numpy as np

    rng = np.random.default_rng(k)
    p = (p := 1 / np.arange(1, 801)) / p.sum()
    terms = [np.sort(rng.choice(800, rng.integers(1, 60), replace=False, p=p)) for _ in range(900)]
    terms += [terms[i] for i in rng.integers(0, 900, 100)]  # ties
    counts = [rng.integers(1, 400, len(t)).astype(np.int32) if i % 7 == 0 else np.ones(len(t), np.int32) for i, t in enumerate(terms)]
    shard, _ = shard_of(terms, counts, 800, rng.permutation(1000))
    for q in range(0, 1000, 37):
        own = shard.known(terms[q])
        everything = shard.full(np.arange(1000), own)
        want = np.lexsort((shard.doc_ids, -everything))[:k]
        want = want[everything[want] > 0]
        for floor in (0.0, everything[want[-1]], everything[want[0]]):
            docs, scores = search_one(shard, terms[q], k, floor)
            up = [d for d in want if everything[d] >= floor]
            assert docs.tolist()[: len(up)] == up and np.array_equal(scores[: len(up)], everything[up])


def test_long_repeated_and_clashing(spark):
    """A text of 300,000 words, a query whose id is repeated, and columns called like the operator's own."""
    long = " ".join(f"x{i % 5000} y{i % 77}" for i in range(150_000))
    rows = [(0, long, 1, "a"), (0, "x1 x2 x3", 2, "b"), (1, "x1 x2 x3", 3, "c"), (2, "y1 z", 4, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, qid int, terms string")
    got = bm.search(df, df.where("doc_id = 0"), k=3)
    assert got.columns == ["qid", "rank", "doc_id", "score"]
    # the long text's query finds all four, the short one's the two equal texts and the long one
    assert sorted((r["qid"], r["rank"]) for r in got.collect()) == [(0, 1), (0, 1), (0, 2), (0, 2), (0, 3), (0, 3)]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bm.search(none, none).count() == 0
    some = spark.createDataFrame([(50, "a b")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in bm.search(some, some).collect()] == [(50, 1, 50)]
