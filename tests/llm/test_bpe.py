"""The encoder against the library that owns the vocabulary."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from planscope.llm import bpe

PATH = bpe.tokenizer_path()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def want(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False), len(ids)


def test_every_code_point(library):
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]
    texts = [" ".join(f"a{c}b" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    got = list(bpe.encode_texts(texts, PATH))
    bad = [i for i, (t, g) in enumerate(zip(texts, got, strict=True)) if g != want(library, t)]
    singles = [c for i in bad for c in points[i * 64 : i * 64 + 64] if next(bpe.encode_texts([f"a{c}b"], PATH)) != want(library, f"a{c}b")]
    assert [hex(ord(c)) for c in singles] == []


def test_random_and_odd_texts(library):
    rng = random.Random(3)
    pool = ["the", "ΣΑΣ", "don't", "$$$", "aaaaaaa", "é", "e\u0301", "日本語", "12345", " ", "\n", "\t", "<|startoftext|>", "<|endoftext|>", "<|", "|>", "x" * 50, "ﬁ", "İ", "\0", "'LL", "\u3000"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += ["", " ", "ab" * 20_000, "$" * 30_001, "".join(rng.choice("abcdefgh") for _ in range(20_000))]
    assert list(bpe.encode_texts(texts, PATH)) == [want(library, t) for t in texts]


def test_documents(spark, library):
    rows = [(1, "Hello it's <|endoftext|> x", "a"), (1, "Hello it's <|endoftext|> x", "a"), (2, None, "b"), (None, "", "c")]
    df = bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, decoded string"), PATH)
    assert df.columns == ["doc_id", "text", "n_tokens", "token_ids", "decoded", "ids_sha256", "decoded_sha256"]
    for r in df.collect():
        ids, plain, n = want(library, r.text or "")
        assert (" ".join(map(str, r.token_ids)), r.decoded, r.n_tokens) == (ids, plain, n)
        assert r.ids_sha256 == hashlib.sha256(ids.encode()).hexdigest()
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_decoding_ids_equals_the_library(spark):
    path = bpe.tokenizer_path()
    library = Tokenizer.from_file(path)
    texts = ["Hello, world! 12 mice", "naïve ＡＢＣ 日本語 🙂", "", "a <|endoftext|> b", "x" * 5000]
    rows = [(i, library.encode(t, add_special_tokens=False).ids, "old") for i, t in enumerate(texts)] + [(9, None, "old")]
    got = {r.doc_id: r.decoded for r in bpe.decode_ids(spark.createDataFrame(rows, "doc_id long, token_ids array<int>, decoded string"), path).collect()}
    assert got == {i: library.decode(ids, skip_special_tokens=False) if ids is not None else "" for i, ids, _ in rows}
