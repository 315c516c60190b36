"""BPE encoding and decoding with a public word-level vocabulary, in batched numpy merge rounds.

The distinct words of an Arrow batch are laid out as one flat array of symbol ids. A round looks up every
adjacent pair of a word by binary search over the sorted pair keys, finds each word's lowest rank, merges
all its occurrences of that pair from left to right, and compacts the array; words without a known pair
leave. Merging all occurrences at once equals merging one at a time because every merge ranks after the
merges that make its parts (checked when the vocabulary is loaded).

Words already encoded are kept during a task in a table that is emptied when it reaches ``CACHE_WORDS`` words, so
memory does not grow with the corpus.

Defined cases: null text is the empty text (no tokens, the hash of the empty string); texts are never cut;
repeated rows give repeated results; strings of special tokens in the text become those tokens, as the
vocabulary's library does. Extra columns are kept by ``encode_documents`` unless they clash with its outputs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planscope.llm.common import release_memory, small_batches, table

CACHE_WORDS = 120_000
#: Words with at least so many characters are not kept: they are rare and large.
LONG_WORD = 200


#: Ranges of letters and numbers (hexadecimal code points) of Unicode 17, which the regex module
#: knows but the vocabulary's library, on Unicode 16, doesn't.
NEWER = """558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6
1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""
#: Upper and lower case of letters of Unicode 16 and 17, which Python 3.13 doesn't know.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {0x10D50 + i: 0x10D70 + i for i in range(22)} | {0x16EA0 + i: 0x16EBB + i for i in range(25)}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the other bytes take the code points from 256 on, in order."""
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class Vocabulary:
    """A tokenizer file: merges as sorted pair keys with ranks, and the rules for splitting text into words."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.suffix: str = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in data["added_tokens"]}
        self.id_text = {i: str(i) for i in self.tokens}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        ranges = "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in NEWER.split())
        cased = "".join(f"\\U{c:08x}" for c in LOWER)
        # texts with code points on which the Unicode versions differ are split by explicit sets
        self.newer = regex.compile(f"[{ranges}{cased}]")
        explicit = pattern.replace(r"\p{L}", rf"[\p{{L}}--[{ranges}]]").replace(r"\p{N}", rf"[\p{{N}}--[{ranges}]]")
        self.explicit = regex.compile(explicit, flags=regex.V1)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        keys = np.array([(a << 32) | b for a, b, _ in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([c for _, _, c in pairs], dtype=np.int64)[order]
        made_at: dict[int, int] = {}
        for rank, (_, _, c) in enumerate(pairs):
            made_at[c] = rank
        if any(made_at.get(a, -1) >= rank or made_at.get(b, -1) >= rank for rank, (a, b, _) in enumerate(pairs)):
            raise ValueError("a merge ranks before one that makes its part: rounds would not equal single merges")
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.final = np.array([vocab[s + self.suffix] for s in symbols], dtype=np.int64)
        self.cache: dict[str, tuple[str, str, int]] = {}

    def merge_rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and the number of tokens of each word."""
        raw = [w.encode("utf-8") for w in words]
        length = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ids = self.inner[data]
        last = np.cumsum(length) - 1
        ids[last] = self.final[data[last]]
        word = np.repeat(np.arange(len(raw)), length)
        done_ids, done_words, done_at = [], [], []
        at = np.arange(len(ids))  # place of a symbol in the first layout keeps the order of finished words
        worst = np.int64(len(self.keys))
        while len(ids):
            same = word[:-1] == word[1:]
            key = (ids[:-1] << 32) | ids[1:]
            place = np.searchsorted(self.keys, key)
            place[place == len(self.keys)] = 0
            rank = np.where(same & (self.keys[place] == key), self.ranks[place], worst)
            rank = np.append(rank, worst)
            starts = np.flatnonzero(np.append(True, ~same)) if len(ids) > 1 else np.array([0])
            best = np.minimum.reduceat(rank, starts)
            count = np.diff(np.append(starts, len(ids)))
            live = np.repeat(best < worst, count)
            if not live.all():
                done_ids.append(ids[~live])
                done_words.append(word[~live])
                done_at.append(at[~live])
            hit = (rank == np.repeat(best, count)) & live
            where = np.flatnonzero(hit)
            if not len(where):
                break
            # of overlapping occurrences (a run of adjacent hits) every second one merges, from the left
            first = np.append(True, np.diff(where) != 1)
            run = np.maximum.accumulate(np.where(first, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run) % 2 == 0]
            slot = np.searchsorted(self.keys, (ids[where] << 32) | ids[where + 1])
            ids[where] = self.made[slot]
            live[where + 1] = False
            ids, word, at = ids[live], word[live], at[live]
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(raw), np.int64)
        all_ids, all_words, all_at = map(np.concatenate, (done_ids, done_words, done_at))
        order = np.argsort(all_at, kind="stable")
        return all_ids[order], np.bincount(all_words, minlength=len(raw))

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens: NFC, lower case per character. White space only ever separates
        words, so runs of it need not become one space first."""
        import unicodedata

        if text.isascii():
            return self.pattern.findall(text.lower())
        try:
            text.encode("latin-1")  # Latin-1 texts are in NFC and old enough for all Unicode tables
        except UnicodeEncodeError:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            if self.newer.search(text):
                return self.explicit.findall(text.translate(LOWER))
            return self.pattern.findall(text)
        return self.pattern.findall(text.lower())

    def split(self, text: str) -> list[str]:
        """All words of a text; special tokens are marked by a leading NUL, which no other word has in front
        of a special token's own text because such texts are split off first."""
        if "<|" not in text:
            return self.words(text)
        out: list[str] = []
        for part in self.special_split.split(text):
            if part in self.special:
                out.append("\0" + part)
            elif part:
                out += self.words(part)
        return out

    def know(self, words: set[str]) -> dict[str, tuple[str, str, int]]:
        """(ids as text, tokens as text, number) of each word."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        out: dict[str, tuple[str, str, int]] = {}
        fresh: list[str] = []
        tokens, id_text = self.tokens, self.id_text
        for w in words:
            if (got := self.cache.get(w)) is not None:
                out[w] = got
            elif w[0] == "\0" and w[1:] in self.special:
                out[w] = (str(self.special[w[1:]]), w[1:], 1)
            else:
                fresh.append(w)
        for lo in range(0, len(fresh), 50_000):
            part = fresh[lo : lo + 50_000]
            ids, counts = self.merge_rounds(part)
            ends = np.cumsum(counts).tolist()
            flat, start = ids.tolist(), 0
            for w, end in zip(part, ends, strict=True):
                own = flat[start:end]
                start = end
                out[w] = got = (" ".join([id_text[i] for i in own]), " ".join([tokens[i] for i in own]), len(own))
                if len(w) < LONG_WORD:
                    self.cache[w] = got
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _chunks(texts: list[str], chars: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many characters, one text at least."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size < chars):
            size += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def encode_texts(texts: list[str], path: str) -> Iterator[tuple[str, str, int]]:
    """For each text: ids joined by one space, the decoded text, the number of tokens.

    Decoding joins the tokens by one space: the vocabulary names no decoder."""
    v = vocabulary(path)
    for lo, hi in _chunks(texts):
        split = [v.split(t) for t in texts[lo:hi]]
        known = v.know(set().union(*split))
        for words in split:
            got = [known[w] for w in words]
            yield " ".join([g[0] for g in got]), " ".join([g[1] for g in got]), sum([g[2] for g in got])


def encode_documents(docs: DataFrame, path: str, *, text_col: str = "text", with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """``docs`` with n_tokens, token_ids (array of int, if ``with_ids``), decoded (if ``with_text``), ids_sha256,
    decoded_sha256. Results leave in batches of about half a million characters, whatever the size of the input's batches."""
    own = ["n_tokens", "token_ids", "decoded", "ids_sha256", "decoded_sha256"]
    kept = [f for f in docs.schema.fields if f.name not in own]
    fields = [*kept, T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] * with_ids + [T.StructField("decoded", T.StringType())] * with_text
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    place, names = len(kept), [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                yield from encoded(part)
        vocabulary(path).cache.clear()
        release_memory()

    def encoded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [t if t is not None else "" for t in batch.column(place).to_pylist()]
        for lo, hi in _chunks(texts):
            n, ids, decoded, ids_sha, decoded_sha = [], [], [], [], []
            for id_text, plain, count in encode_texts(texts[lo:hi], path):
                n.append(count)
                if with_ids:
                    ids.append(np.fromstring(id_text, dtype=np.int32, sep=" ") if id_text else np.zeros(0, np.int32))
                if with_text:
                    decoded.append(plain)
                ids_sha.append(hashlib.sha256(id_text.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(plain.encode("utf-8", "surrogatepass")).hexdigest())
            out = [c.slice(lo, hi - lo) for c in batch.columns[:place]] + [pa.array(n, pa.int64())]
            if with_ids:
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))))
            if with_text:
                out.append(pa.array(decoded, pa.string()))
            out += [pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=names)

    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text_col}`").alias("__text"))
    return rows.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in fields]))


def decode_ids(docs: DataFrame, path: str, *, ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with decoded: the tokens of ``ids_col`` (array of int) joined by one space, as the vocabulary names no decoder; null
    ids decode to the empty text, ids that the vocabulary lacks to nothing."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "decoded"]

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        tokens = vocabulary(path).tokens
        return pd.Series([" ".join([tokens[i] for i in x if i in tokens]) if x is not None else "" for x in ids], dtype=object)

    return docs.select(*kept, decode(F.col(ids_col).cast("array<int>")).alias("decoded"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, tokenizer_path(), with_ids=False, with_text=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def bpe_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: doc_id, source, token_ids and the hashes of ids and decoded text, a row per copy."""
    small_batches(spark)
    return encode_documents(docs.select("doc_id", "text", "source"), tokenizer_path(), with_text=False).select("doc_id", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")
