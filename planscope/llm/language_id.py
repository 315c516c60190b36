"""Language identification with error-correcting output codes.

Every language gets a codeword; each bit has a binary linear classifier on the presence of character n-grams.
A text's bit margins are compared with the codewords by loss-weighted decoding: the language with the least
sum of logistic losses, each bit weighted by how well it did in training, wins; a text whose two best
languages lie closer than ``AMBIGUOUS`` in probability is flagged.

The fit takes at most ``SAMPLE_PER_LANGUAGE`` documents of each language, ``SAMPLE_ROWS`` in all, with whole texts, on the
driver: those with the smallest hashes of doc_id in each of ``PARTS`` parts of the language. Rows without an id are not learnt from, and
of rows that share id and language one is. Prediction covers every row in a vectorised pandas UDF.

Defined cases: ``und`` with score 0.0 for null texts, texts without a letter, or when nothing was learnt;
null lang is not learnt from; a single language is always predicted with score 1.0; ties go to the language
first by name. Extra columns are kept unless they clash with the outputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planscope.llm import char_grams as g
from planscope.llm.common import checkpointed, fold, release_memory, table
from planscope.llm.url_filter import may_contain

#: Bounds of the fit: documents per language, and in all (many languages get fewer each, 20 at least).
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 1500, 8000
#: Parts of a language that are sampled apart.
PARTS = 50
FEATURES = 2500
SIZES = (1, 2, 3)
AMBIGUOUS = 0.2


def codewords(languages: int, seed: int = 11) -> np.ndarray:
    """+1/-1 matrix (languages, bits): all non-trivial splits for up to 5 languages, else random dense codes of
    about 10 log2(languages) bits whose rows differ in a third of the bits at least, where such are found."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 5:
        bits = 2 ** (languages - 1) - 1
        rows = [[1 if i == 0 else (1 if (b >> (i - 1)) & 1 else -1) for b in range(bits)] for i in range(languages)]
        return np.array(rows, dtype=float)
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(languages)))
    best, widest = None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], size=(languages, bits))
        apart = (bits - m @ m.T) / 2 + bits * np.eye(languages)
        if apart.min() > widest and not np.any(np.abs(m.sum(0)) == languages):
            best, widest = m, apart.min()
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    slots: np.ndarray | None
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the choice is ambiguous."""
        names, score, close = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        if not self.languages:
            return names, score, close
        has = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if self.slots is None:
            for i in has:
                names[i], score[i] = self.languages[0], 1.0
            return names, score, close
        own = [texts[i] for i in has]
        for lo, hi in g.chunks(own):
            x = g.presence(own[lo:hi], self.slots, len(self.weights), SIZES)
            margin = (x / np.sqrt(np.maximum(1, x.sum(1, keepdims=True)))) @ self.weights + self.bias
            loss = np.log1p(np.exp(np.clip(-margin[:, None, :] * self.code[None, :, :], -30, 30))) @ self.trust
            p = np.exp(loss.min(1, keepdims=True) - loss)
            p /= p.sum(1, keepdims=True)
            top = p.argmax(1)
            second = np.sort(p, axis=1)[:, -2]
            for k in range(hi - lo):
                i = has[lo + k]
                names[i], score[i], close[i] = self.languages[top[k]], p[k, top[k]], p[k, top[k]] - second[k] < AMBIGUOUS
        return names, score, close


def fit_texts(texts: list[str], langs: list[str], features: int = FEATURES) -> LanguageModel:
    languages = sorted(set(langs))
    if len(languages) < 2:
        return LanguageModel(languages, codewords(len(languages)), None, np.zeros(0), np.zeros(0), np.zeros(0))
    group = np.array([languages.index(x) for x in langs])
    size = np.bincount(group, minlength=len(languages)).astype(float)
    counts = g.document_counts(texts, group, len(languages), SIZES)
    seen = np.flatnonzero(counts.sum(0) >= 3)
    share = counts[:, seen] / size[:, None]
    best = np.lexsort((seen, -share.var(0)))[:features]
    slots = g.slot_table(seen[best])
    x = g.presence_matrix(texts, slots, len(best), SIZES)
    x /= np.sqrt(np.maximum(1, x.sum(1, keepdims=True)))
    code = codewords(len(languages))
    target = (code[group] > 0).astype(np.float32)
    w, b = g.logistic(x, target, l2=1e-5, rate=0.1, weight=1 / size[group])
    right = (((x @ w + b) > 0) == (target > 0)).mean(0)
    trust = np.maximum(right - 0.5, 1e-3)
    return LanguageModel(languages, code, slots, w, b, trust / trust.sum() * len(trust))


def fit(docs: DataFrame, *, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """``docs``: doc_id, text, lang. At most ``per_language`` documents of each language reach the driver, and at most
    ``SAMPLE_ROWS`` in all where there are fewer than 400 languages."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    per_language = max(20, min(per_language, SAMPLE_ROWS // max(1, known.select("lang").distinct().count())))
    # the first of each part of a language by hash: a part holds few rows, whatever the language's share of all rows
    parts = min(PARTS, per_language)
    order = Window.partitionBy("lang", "part").orderBy(F.col("h"), F.col("doc_id"))
    ids = known.where("doc_id is not null").select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).withColumn("part", F.pmod(F.xxhash64("h"), F.lit(parts)))
    ids = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language // parts)
    ids = checkpointed(ids.select("doc_id", "lang").distinct())
    # the Bloom filter keeps other texts out of the join's shuffle; of rows that share id and language one is taken
    texts = may_contain(known.select("doc_id", "lang", "text"), "doc_id", ids, "doc_id").join(ids, ["doc_id", "lang"])
    got = texts.groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")).toPandas()
    got = got.sort_values(["doc_id", "lang"])
    return fit_texts(got["text"].tolist(), got["lang"].tolist())


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        names, score, close = shared.value.predict(text.tolist())
        release_memory()
        return pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": score, "ambiguous": close})

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    return docs.select(*kept, predict(F.col(text_col)).alias("__p")).select(*kept, "__p.*")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold(F.col("doc_id")) != 0).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")
