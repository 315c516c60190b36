"""Alignment, blocks and the distributed form against plain loops that know neither pairs nor first holders."""

import random
from difflib import SequenceMatcher

import numpy as np

from planscope.llm import line_dedup as ld


def test_patience_is_a_common_subsequence():
    rng = random.Random(0)
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randint(0, 25))]
        b = [rng.randrange(12) for _ in range(rng.randint(0, 25))]
        got = ld.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
    assert ld.patience([1, 2, 3, 4, 5], [9, 2, 3, 8, 5]) == [(1, 1), (2, 2), (4, 4)]
    unique = rng.sample(range(100), 40), rng.sample(range(100), 40)
    longest = sum(m.size for m in SequenceMatcher(None, *unique, autojunk=False).get_matching_blocks())
    assert len(ld.patience(*unique)) >= longest


def lines_of(text):
    return [x.strip(" \t\n\v\f\r") for x in (text or "").split("\n")]


def brute(rows, least):
    """Every stretch of lines of every document, looked for in every earlier document."""
    docs = [(d, lines_of(t)) for d, t in rows if d is not None]
    out = {}
    for d, lines in docs:
        gone = set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[i:j]) >= least:
                    run = lines[i:j]
                    if any(e < d and any(other[k : k + len(run)] == run for k in range(len(other))) for e, other in docs):
                        gone |= set(range(i, j))
                    break
            for j in range(i, -1, -1):
                if sum(len(x.split()) for x in lines[j : i + 1]) >= least:
                    run = lines[j : i + 1]
                    if any(e < d and any(other[k : k + len(run)] == run for k in range(len(other))) for e, other in docs):
                        gone |= set(range(j, i + 1))
                    break
        out[d] = sorted(gone)
    return out


def texts(rng, n, pool, share):
    line = lambda k: " ".join(f"w{rng.randrange(500)}" for _ in range(k))
    return ["\n".join(rng.choice(pool) if rng.random() < share else line(rng.randint(0, 20)) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_pairs_take_moved_and_repeated_blocks():
    rng = random.Random(5)
    words = {i: rng.choice([0, 2, 5, 12]) for i in range(9)}
    name = {i: rng.getrandbits(63) for i in range(-1, 9)}
    more = 0
    for _ in range(400):
        a, b = ([rng.randrange(9) for _ in range(rng.randint(0, 14))] for _ in range(2))
        rows = [(1, "\n".join(" ".join([f"v{i}"] * words[i]) for i in b)), (2, "\n".join(" ".join([f"v{i}"] * words[i]) for i in a))]
        # lines without words are one line to the loop: give them one value here too
        a, b = ([-1 if not words[i] else i for i in x] for x in (a, b))
        wa, wb = ([words.get(i, 0) for i in x] for x in (a, b))
        a, b = ([name[i] for i in x] for x in (a, b))
        got = ld.common_blocks(*([np.array(x, dtype=np.int64)] for x in (a, wa, b, wb)), ld.MIN_WORDS)[0].tolist() if a and b else []
        assert got == (brute(rows, ld.MIN_WORDS)[2] if a and b else [])
        plain = ld.aligned_blocks(a, wa, b, ld.MIN_WORDS)
        assert set(plain) <= set(got)
        more += len(got) - len(set(plain))
    assert more > 50


def test_against_a_loop(spark):
    rng = random.Random(2)
    pool = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 6, 12, 60]))) for _ in range(40)] + ["", "a b"]
    rows = list(enumerate(texts(rng, 120, pool, 0.5)))
    rows = [(d, "\n".join(("  " + x + "\t") if rng.random() < 0.1 else x for x in t.split("\n"))) for d, t in rows]
    rows += [(200, rows[5][1]), (201, None), (202, ""), (203, "\n\n")] + [(300 + i, rows[i][1]) for i in range(0, 40, 5)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, deleted string, `__of` string, deleted_lines string")
    df = df.withColumnRenamed("__of", "kind")
    out = ld.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "deleted", "kind", "deleted_lines"]
    got = {r.doc_id: r for r in out.collect()}
    want = brute(rows, ld.MIN_WORDS)
    assert {d: list(r.deleted_lines) for d, r in got.items()} == want
    assert sum(map(len, want.values())) > 100
    for d, t in rows:
        lines = t.split("\n") if t is not None else None
        assert got[d].text == (None if lines is None else "\n".join(x for i, x in enumerate(lines) if i not in want[d]))
        assert (got[d].deleted, got[d].kind) == ("x", "y")


def test_nulls_repeats_and_empty(spark):
    text = "one two three four five six seven eight nine ten eleven\nshort"
    rows = [(1, text), (None, text), (None, None), (2, text), (2, text), (2, "other\n" + text)]
    got = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text or "", len(r.deleted_lines)) for r in got) == sorted(
        [("1", text, 0), ("None", text, 0), ("None", "", 0), ("2", "", 2), ("2", "", 2), ("2", "other", 2)]
    )
    assert ld.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_identical_and_overlapping_documents_of_short_lines(spark):
    verse = [f"verse {i} has just six words" for i in range(31)]
    rows = [(1, "\n".join(verse[:30])), (2, "\n".join(verse[:30])), (3, "\n".join(["a head of its own", *verse, "a foot of its own"])), (4, "one two three\n\nfour five"), (5, "x\none two three\n\nfour five")]
    got = {r.doc_id: list(r.deleted_lines) for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, ld.MIN_WORDS) == {1: [], 2: list(range(30)), 3: list(range(1, 31)), 4: [], 5: []}


def test_boilerplate_and_long_texts(spark):
    """One line in every document, twice in the first and in every third; one document of 20,000 lines."""
    common = "this very common line stands in each and every one of the documents"
    own = lambda i, j: f"document {i} line {j} with quite a few words of its very own"
    rows = [(0, f"{common}\n{own(0, 0)}\n{common}")]
    rows += [(i, "\n".join([own(i, 0), common, own(i, 1), *([common] if i % 3 == 0 else [])])) for i in range(1, 400)]
    rows += [(1000, "\n".join(own(1000, j) for j in range(20_000))), (1001, "\n".join([own(1000, j) for j in range(19_999, -1, -1)]))]
    got = {r.doc_id: list(r.deleted_lines) for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == got[1000] == [] and got[1001] == list(range(20_000))
    assert all(got[i] == ([1, 3] if i % 3 == 0 else [1]) for i in range(1, 400))
