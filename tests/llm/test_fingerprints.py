"""Edits, likenesses and fingerprints against plain Python."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from planscope.llm import fingerprints as fp


def pieces(text):
    return set(re.findall(rf"[^\n]{{1,{fp.SEGMENT}}}", text))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    docs = sorted({(d, t or "") for d, t in rows}, key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(docs):
        nxt = docs[(i + 1) % len(docs)][1]
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard(pieces(t), pieces(edited)), jaccard(pieces(t), pieces(nxt)))
    return out


def test_against_python(spark):
    rng = random.Random(1)
    line = lambda: "".join(rng.choice("abc é🙂") for _ in range(rng.randint(0, 150)))
    shared = [line() for _ in range(30)]
    rows = [(i * 2, "\n".join(rng.choice(shared) if rng.random() < 0.5 else line() for _ in range(rng.choice([0, 1, 3, 20, 80])))) for i in range(60)]
    rows += [(-5, None), (500, ""), (501, "x"), (502, rows[3][1]), (600, "\n".join(line() for _ in range(900)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit(1)).repartition(5)
    got = {r.doc_id: r for r in fp.fingerprint_documents(df).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    for d, (n, sha, near, nxt) in want.items():
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (n, sha), d
        assert abs(r.near_edited - near) < 1e-12 and abs(r.near_next - nxt) < 1e-12, d
    assert got[502].fingerprint == got[6].fingerprint
    assert got[501].fingerprint != got[500].fingerprint


def test_a_small_difference_peels_in_the_root_table(spark):
    a = [spark.range(1).select(F.array(*[F.xxhash64(F.lit(i)) for i in x])).first()[0] for x in (range(40), list(range(38)) + [90])]
    row = spark.createDataFrame([(a[0], a[1])], "a array<long>, b array<long>")
    cells = fp.subtract(fp.root_table(F.col("a")), fp.root_table(F.col("b")))
    p = row.select(fp.peel(cells, fp.ROOT_WIDTH, F.lit(13)).alias("p")).first().p
    assert p.done and (p.only_a, p.only_b) == (2, 1)


def test_retry_and_last_resort(spark):
    wide = spark.range(1).select(
        F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.xxhash64(i)).alias("a"), F.transform(F.sequence(F.lit(31), F.lit(100)), lambda i: F.xxhash64(i)).alias("b"),
        # digests that share all bits which choose cells: no width can tell them apart
        F.transform(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long")), lambda i: F.shiftleft(i, 60)).alias("c"), F.array(F.lit(7).cast("long")).alias("d"),
    )
    assert wide.select(fp.bucket_difference(F.col("a"), F.col("b"))).first()[0] == 70
    assert wide.select(fp.bucket_difference(F.col("c"), F.col("d"))).first()[0] == 5
    assert wide.select(fp.bucket_difference(F.col("a"), F.col("a"))).first()[0] == 0


def test_repeats_nulls_and_empty(spark):
    rows = [(1, "a\nb"), (1, "a\nb"), (1, "c"), (None, "a\nb"), (None, None), (2, "tail of it")]
    got = fp.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6 and sum(r.doc_id is None for r in got) == 2
    assert len({r.edited_sha256 for r in got if r.doc_id == 1 and r.n_chars == 3}) == 1
    one = fp.fingerprint_documents(spark.createDataFrame([(9, "abcdef")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one[0].near_next == 1.0
    assert fp.fingerprint_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
