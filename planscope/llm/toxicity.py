"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Each feature is the presence of a character n-gram times its log ratio of smoothed document counts in toxic and
other training texts; a logistic regression is fitted on these. Features are chosen by how far the two
shares lie apart in standard errors.

The fit takes at most ``SAMPLE_ROWS`` labelled rows with whole texts (those with the smallest hash of doc_id), on
the driver; scoring covers every row and is a vectorised pandas UDF.

Defined cases: null text is the empty text and gets a score like any other; null labels are not learnt from;
repeated label rows count once each; without both labels among the rows the score is the share of label 1
(0.0 without labels). Ties at 0.5 predict 1. Extra columns are kept unless they clash with the outputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planscope.llm import char_grams as g
from planscope.llm.common import fold, release_memory, small_batches, table

SAMPLE_ROWS = 8000
FEATURES = 3000
SIZES = (3, 4, 5, 6)


@dataclass
class ToxicityModel:
    slots: np.ndarray | None
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        if self.slots is None:
            return np.full(len(texts), self.bias)
        out = np.zeros(len(texts))
        for lo, hi in g.chunks(texts):
            z = g.presence(texts[lo:hi], self.slots, len(self.weights), SIZES) @ self.weights + self.bias
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def fit_texts(texts: list[str], toxic: np.ndarray, features: int = FEATURES) -> ToxicityModel:
    n1 = int(toxic.sum())
    n0 = len(toxic) - n1
    if not n1 or not n0:
        return ToxicityModel(None, np.zeros(0), n1 / max(1, len(toxic)))
    counts = g.document_counts(texts, toxic.astype(np.int64), 2, SIZES)
    seen = np.flatnonzero(counts.sum(0) >= 3)
    c0, c1 = counts[0, seen].astype(float), counts[1, seen].astype(float)
    share = (c0 + c1) / (n0 + n1)
    apart = np.abs(c1 / n1 - c0 / n0) / np.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-9)
    best = np.lexsort((seen, -apart))[:features]
    chosen, c0, c1 = seen[best], c0[best], c1[best]
    ratio = np.log((c1 + 1) / (n1 + 2)) - np.log((c0 + 1) / (n0 + 2))
    slots = g.slot_table(chosen)
    x = g.presence_matrix(texts, slots, len(chosen), SIZES)
    x *= ratio.astype(np.float32)
    w, b = g.logistic(x, toxic, l2=1e-4, rate=0.02)
    return ToxicityModel(slots, (w[:, 0] * ratio).astype(np.float32), float(b[0]))


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic. At most ``sample_rows`` labelled rows reach the driver."""
    marked = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(marked, "doc_id")
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text", "toxic").limit(sample_rows).toPandas()
    return fit_texts(got["text"].tolist(), got["toxic"].to_numpy(dtype=np.int64))


def score_documents(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        out = pd.Series(shared.value.score([t if t is not None else "" for t in text.tolist()]))
        release_memory()
        return out

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*kept, score(F.col(text_col)).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = table(spark, sf_dir, "labels").where(fold(F.col("doc_id")) != 0)
    model = fit(docs, learn)
    scored = score_documents(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the model is learnt from all labels of the documents at hand."""
    small_batches(spark)
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).where("predicted = 0").select("doc_id", "text", "lang", "source", "n_chars")
