"""Exact top-k BM25 search: an inverted index per shard with block-max WAND pruning, merged with global statistics.

Terms are runs of letters, digits and other non-ASCII characters, A-Z lower-cased (ASCII punctuation and white space
separate), named by 64-bit hashes. A query is the whole text of a document: its distinct terms.

1. The index is built once, whatever the number of queries: a task packs its documents into shards of at most
   ``SHARD_DOCS`` documents or ``SHARD_POSTINGS`` postings, each a row of arrays (vocabulary, postings by term,
   lengths), written to the shared checkpoint folder. Within a shard documents that share their most frequent term
   and have like lengths stand together, so that block maxima are close to what is in the block.
2. Queries are handled in blocks of at most ``QUERIES`` rows and ``TERMS`` terms; what a block broadcasts (terms,
   weights) is bounded by these. All blocks run over the same index; a block's top k are written before the next
   block begins. Document frequencies are summed over all shards for the terms of the block.
3. For each shard and query: the postings of rare terms are added up; every block of ``DOCS`` documents is bounded by
   its largest sum so far plus its maxima of the query's frequent terms. Blocks whose bound is below the threshold, the
   k-th score that the task has found so far, stay shut (the WAND condition with block maxima). Over the open blocks,
   or the stretch they lie in, the frequent terms are added in units of 1 / ``SCALE`` rounded up, and documents that
   reach the threshold are scored from their own terms.
4. A task works through its shards one by one, and the tasks' top k per query are merged to the top k of all.

Scores use statistics of all documents. Sums and bounds only select documents, with a margin above their rounding; a
document that ties with the threshold is scored, and scores are summed per document in one order of terms, so the
result equals that of scoring everything. Ties go to the smaller doc_id. A query finds its own document too. Documents
without a common term are no hits, so a query can have fewer than k.

Defined cases: null and empty texts match nothing; a null doc_id is neither query nor hit; repeated rows are hits each;
queries that repeat an id are one query each and get a rank each by row; an empty table gives no rows; columns other
than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planscope.llm import shingles
from planscope.llm.common import checkpointed, release_memory, table, text_slices

K1, B = 1.2, 0.75
QUERIES, TERMS = 8192, 2_000_000
#: A shard closes when it has so many documents (16-bit numbers) or postings: this bounds a task's memory.
SHARD_DOCS, SHARD_POSTINGS = 32_768, 4_000_000
#: So many of a shard's most frequent terms tell which documents stand together.
TOPS = 64
DOCS = 16
#: Terms in more than one of so many documents of a shard are frequent: pruned by block maxima. Their table has at
#: most ``CELLS`` cells; the most frequent terms come first.
FREQUENT, CELLS = 32, 1 << 25
#: Units of the rounded parts of frequent terms, and queries whose bounds are computed together.
SCALE, TOGETHER = 256, 64
#: Above the rounding of 32-bit parts.
MARGIN = 1e-4

_SEPARATES = np.ones(256, dtype=bool)
_SEPARATES[128:] = False
for _c in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_":
    _SEPARATES[_c] = False


def term_counts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct term hashes (sorted, signed) and their counts, for each text."""
    for lo, hi in shingles.batches(texts):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts[lo:hi]]
        offset = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
        h, start = shingles.word_hashes(b"\n".join(raw), _SEPARATES)
        h = h.view(np.int64)
        cut = np.searchsorted(start, offset)
        for k in range(hi - lo):
            yield np.unique(h[cut[k] : cut[k + 1]], return_counts=True)


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, terms) of queries (doc_id, text)."""

    @F.pandas_udf("array<bigint>")
    def terms(text: pd.Series) -> pd.Series:
        return pd.Series([t for t, _ in term_counts(text.tolist())], dtype=object)

    return queries.where("doc_id is not null").select(F.col("doc_id").alias("qid"), terms("text").alias("terms"))


_SHARD = ["docs", "words", "doc_ids", "lengths", "vocabulary", "df", "post_doc", "post_count"]
_SHARD_SCHEMA = "docs bigint, words bigint, doc_ids binary, lengths binary, vocabulary binary, df binary, post_doc binary, post_count binary"


def pack(doc_ids: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray]) -> dict:
    """A shard of the index: for each term of the sorted vocabulary its postings (number of the document, count).
    Empties ``terms`` and ``counts``."""
    lengths = np.array([c.sum() for c in counts], dtype=np.int64)
    doc = np.repeat(np.arange(len(terms), dtype=np.uint16), [len(t) for t in terms])
    term = np.concatenate(terms)
    terms.clear()
    count = np.concatenate(counts)
    counts.clear()
    count = count.astype(np.min_scalar_type(max(count.max(initial=0), 1)))
    by_term = np.argsort(term)
    term, doc, count = term[by_term], doc[by_term], count[by_term]
    del by_term
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, dtype=np.int64)
    vocabulary, df = term[first], np.diff(np.append(first, len(term))).astype(np.int32)
    del term
    # documents by their most frequent term: terms are handed out from the rarest to the most frequent, the last stays
    top = np.full(len(doc_ids), len(df), dtype=np.int32)
    rank = np.empty(len(df), dtype=np.int32)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df), dtype=np.int32)
    some = rank < TOPS
    at = np.repeat(some, df)
    number = np.repeat(rank[some], df[some])
    high = np.argsort(-number, kind="stable")
    top[doc[at][high]] = number[high]
    order = np.lexsort((doc_ids, lengths, top))
    place = np.empty(len(order), dtype=np.uint16)
    place[order] = np.arange(len(order))
    arrays = (doc_ids[order].astype(np.int64), lengths[order], vocabulary.astype(np.int64), df, place[doc], count)
    return dict(zip(_SHARD, (len(doc_ids), int(lengths.sum()), *(x.tobytes() for x in arrays)), strict=True))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of the documents (doc_id, text) of a task."""
    ids, terms, counts, postings = [], [], [], 0

    def shard() -> pa.RecordBatch:
        row = pack(np.array(ids, dtype=np.int64), terms, counts)
        ids.clear()
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([(c, pa.int64() if c in ("docs", "words") else pa.binary()) for c in _SHARD]))

    for batch in batches:
        known = batch.column(0).to_pylist()
        for at, (t, c) in enumerate(x for texts in text_slices(batch.column(1)) for x in term_counts(texts)):
            ids.append(known[at])
            terms.append(t)
            counts.append(c.astype(np.int32))
            postings += len(t)
            if len(ids) >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield shard()
                postings = 0
    if ids:
        yield shard()
    release_memory()


def build_index(docs: DataFrame) -> tuple[DataFrame, int, float]:
    """The shards of ``docs`` (doc_id, text), written once, the number of documents and their mean length."""
    n = docs.count()
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-n // SHARD_DOCS))
    shards = checkpointed(docs.coalesce(tasks).mapInArrow(_index, _SHARD_SCHEMA))
    words = shards.agg(F.sum("words")).first()[0] or 0
    return shards, n, max(words / max(n, 1), 1e-9)


def _frequencies(shared):
    """(term, df) of a task's shards for the terms of a block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = shared.value
        df = np.zeros(len(words), dtype=np.int64)
        for b in batches:
            for vocabulary, own in zip(b["vocabulary"], b["df"], strict=True):
                at, known = _look_up(words, np.frombuffer(vocabulary, dtype=np.int64))
                df[at[known]] += np.frombuffer(own, dtype=np.int32)[known]
        at = np.flatnonzero(df)
        yield pd.DataFrame({"term": at.astype(np.int32), "df": df[at]})

    return run


def _look_up(words: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(words, vocabulary)
    at[at == len(words)] = 0
    return at, words[at] == vocabulary


class Shard:
    """Postings of some documents for the terms of a block of queries, with their BM25 parts and block maxima."""

    def __init__(self, row: dict, words: np.ndarray, idf: np.ndarray, mean: float):
        read = lambda c, kind: np.frombuffer(row[c], dtype=kind)
        self.doc_ids, lengths, df = read("doc_ids", np.int64), read("lengths", np.int64), read("df", np.int32)
        self.n = len(self.doc_ids)
        doc = read("post_doc", np.uint16)
        count = read("post_count", f"u{max(1, len(row['post_count']) // max(1, len(doc)))}")
        at, known = _look_up(words, read("vocabulary", np.int64))
        kept = np.repeat(known, df)
        at, df = at[known], df[known]
        self.post_doc, count = doc[kept], count[kept]
        del kept, doc
        self.slot = np.full(len(words), -1, dtype=np.int32)
        self.slot[at] = np.arange(len(at), dtype=np.int32)
        self.gain, self.weight = idf[at] * (K1 + 1), K1 * (1 - B + B * lengths / mean)
        self.post = np.concatenate(([0], np.cumsum(df, dtype=np.int64)))
        term = np.repeat(np.arange(len(at), dtype=np.int32), df)
        self.post_part = np.empty(len(term), dtype=np.float32)
        for i in range(0, len(term), 1 << 20):
            j = i + (1 << 20)
            self.post_part[i:j] = self._part(term[i:j], self.post_doc[i:j], count[i:j])
        # by document, each with its terms in ascending order
        moved = np.argsort(self.post_doc, kind="stable")
        self.terms, self.counts = term[moved], count[moved]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(self.post_doc, minlength=self.n))))
        del moved, term, count
        # frequent terms: a row each of their parts, rounded up to units of 1 / SCALE, and the maxima by block
        self.blocks = -(-self.n // DOCS)
        wide = self.blocks * DOCS
        often = np.flatnonzero(df > max(16, self.n // FREQUENT))
        often = often[np.argsort(-df[often], kind="stable")[: CELLS // wide]]
        self.row = np.full(len(at), -1, dtype=np.int32)
        self.row[often] = np.arange(len(often), dtype=np.int32)
        self.dense = np.zeros((len(often), wide), dtype=np.uint16)
        for r, t in enumerate(often.tolist()):
            i, j = self.post[t], self.post[t + 1]
            self.dense[r, self.post_doc[i:j]] = np.ceil(self.post_part[i:j] * np.float32(SCALE * (1 + MARGIN)))
        self.cells = self.dense.reshape(len(often), self.blocks, DOCS)
        self.most = self.cells.max(2).astype(np.float32) if len(often) else np.zeros((0, self.blocks), dtype=np.float32)
        self.peak = self.most.max(1).astype(np.int64) if len(often) else np.zeros(0, dtype=np.int64)
        self.asked = np.zeros(len(at), dtype=bool)
        self.touched = 0  # parts that searches have read

    def known(self, query: np.ndarray) -> np.ndarray:
        """The shard's own numbers of the terms of a query that it has."""
        own = self.slot[query]
        return own[own >= 0]

    def _part(self, term: np.ndarray, doc: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.gain[term] * count / (count + self.weight[doc])

    def full(self, docs: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Whole scores of ``docs``, each summed in the order of terms."""
        if not len(docs):
            return np.zeros(0)
        spans = list(zip(self.start[docs].tolist(), self.start[docs + 1].tolist(), strict=True))
        terms = np.concatenate([self.terms[i:j] for i, j in spans])
        self.asked[own] = True
        hit = np.flatnonzero(self.asked[terms])
        self.asked[own] = False
        self.touched += len(terms)
        at = np.repeat(np.arange(len(docs)), [j - i for i, j in spans])[hit]
        count = np.concatenate([self.counts[i:j] for i, j in spans])[hit]
        return np.bincount(at, weights=self._part(terms[hit], docs[at], count), minlength=len(docs))

    def rare_sums(self, own: np.ndarray) -> np.ndarray:
        """For each document, the sum of its parts of the rare terms among ``own``."""
        rare = own[self.row[own] < 0]
        a, b = self.post[rare], self.post[rare + 1]
        self.touched += int((b - a).sum())
        spans = list(zip(a.tolist(), b.tolist(), strict=True))
        if not spans:
            return np.zeros(self.blocks * DOCS)
        docs = np.concatenate([self.post_doc[i:j] for i, j in spans])
        return np.bincount(docs, weights=np.concatenate([self.post_part[i:j] for i, j in spans]), minlength=self.blocks * DOCS)

    def frequent_sums(self, rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Sums of rows of frequent terms over the blocks from ``lo`` to ``hi``, rounded up."""
        out, part, room = np.zeros((hi - lo) * DOCS), None, 65535
        for r, peak in zip(rows.tolist(), self.peak[rows].tolist(), strict=True):
            row = self.dense[r, lo * DOCS : hi * DOCS]
            if part is None:
                part, room = row.copy(), 65535 - peak
            elif peak <= room:
                part += row
                room -= peak
            else:  # 16 bits are full
                out += part
                part, room = row.copy(), 65535 - peak
        self.touched += len(rows) * len(out)
        return (out if part is None else out + part) / SCALE

    def tops(self, queries: list[np.ndarray], k: int, floors: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Documents and scores of the top k of each query (own numbers). ``floors``: scores that k documents of other
        shards reach; documents below don't count."""
        picked = np.zeros((len(queries), len(self.dense)), dtype=np.float32)
        for i, own in enumerate(queries):
            rows = self.row[own]
            picked[i, rows[rows >= 0]] = 1
        upper = picked @ self.most * np.float32((1 + MARGIN) / SCALE)
        return [self.top(own, u, k, floor) for own, u, floor in zip(queries, upper, floors, strict=True)]

    def top(self, own: np.ndarray, upper: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """``upper``: for each block, the sum of the maxima of the query's frequent terms."""
        sums = self.rare_sums(own)
        bound = sums.reshape(-1, DOCS).max(1) * (1 + MARGIN) + upper
        if not floor:  # a threshold from likely documents of the best blocks
            blocks = np.argpartition(bound, self.blocks - min(self.blocks, k))[self.blocks - min(self.blocks, k) :]
            likely = (blocks[:, None] * DOCS + np.arange(DOCS)).reshape(-1)
            likely = likely[likely < self.n]
            if len(likely) > 2 * k:
                likely = likely[np.argpartition(sums[likely], len(likely) - 2 * k)[len(likely) - 2 * k :]]
            scores = self.full(likely, own)
            floor = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else 0.0
        least = max(floor * (1 - MARGIN), 1e-12)
        blocks = np.flatnonzero(bound >= least)
        if not len(blocks):
            return np.zeros(0, np.int64), np.zeros(0)
        rows = self.row[own]
        rows = rows[rows >= 0]
        lo, hi = int(blocks[0]), int(blocks[-1]) + 1
        if 8 * len(blocks) < hi - lo:  # few blocks are open: these alone
            at = (blocks[:, None] * DOCS + np.arange(DOCS)).reshape(-1)
            sums = sums[at] + self.cells[rows[:, None], blocks].sum(0, dtype=np.int64).reshape(-1) / SCALE
            self.touched += len(rows) * len(at)
        else:
            at = np.arange(lo * DOCS, hi * DOCS)
            sums = sums[lo * DOCS : hi * DOCS] + self.frequent_sums(rows, lo, hi)
        # sums are above the scores by less than a unit for each frequent term
        pick = np.flatnonzero(sums >= least)
        if len(pick) > 2 * k:
            held = sums[pick]
            pick = pick[held >= (np.partition(held, len(held) - k)[len(held) - k] - len(rows) / SCALE) * (1 - MARGIN)]
        docs = at[pick]
        docs = docs[docs < self.n]
        scores = self.full(docs, own)
        order = np.lexsort((self.doc_ids[docs], -scores))[:k]
        order = order[scores[order] > 0]
        return docs[order], scores[order]


def _search(shared, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        queries = np.split(s["terms"], s["start"][1:-1])
        # the task's top k of each query so far: its k-th score prunes the shards to come
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        for b in batches:
            for row in (r._asdict() for r in b.itertuples(index=False)):
                shard = Shard(row, s["words"], s["idf"], s["mean"])
                for lo in range(0, len(queries), TOGETHER):
                    held = best[lo : lo + TOGETHER]
                    tops = shard.tops([shard.known(q) for q in queries[lo : lo + TOGETHER]], k, [x[-1] if len(x) == k else 0.0 for _, x in held])
                    for q, ((ids, scores), (docs, found)) in enumerate(zip(held, tops, strict=True), lo):
                        if len(docs):
                            ids, scores = np.concatenate([ids, shard.doc_ids[docs]]), np.concatenate([scores, found])
                            first = np.lexsort((ids, -scores))[:k]
                            best[q] = ids[first], scores[first]
                del shard
        counts = [len(ids) for ids, _ in best]
        if sum(counts):
            yield pd.DataFrame({
                "query": np.repeat(np.arange(len(best)), counts), "qid": np.repeat(np.array(s["qid"], dtype=np.int64), counts),
                "doc_id": np.concatenate([ids for ids, _ in best]), "score": np.concatenate([x for _, x in best]),
            })
        release_memory()

    return run


def search(docs: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(qid, rank, doc_id, score) of the top ``k`` for every query (``queries``: the same columns as ``docs``)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    asked = checkpointed(query_terms(queries.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).where(F.size("terms") > 0))
    index = build_index(docs)
    results, held, size = [], [], 0
    for row in asked.orderBy("qid").toLocalIterator():  # no more than a block is held
        if held and (len(held) >= QUERIES or size + len(row.terms) > TERMS):
            results.append(checkpointed(_block(spark, index, held, k)))
            held, size = [], 0
        held.append((row.qid, np.array(row.terms, dtype=np.int64)))
        size += len(row.terms)
    if held:
        results.append(_block(spark, index, held, k))
    return reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], "qid long, rank int, doc_id long, score double")


def _block(spark, index: tuple[DataFrame, int, float], queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """The top k of one block of queries."""
    shards, n, mean = index
    words = np.unique(np.concatenate([t for _, t in queries]))
    # one row per term of the block: bounded by TERMS
    df = np.zeros(len(words), dtype=np.int64)
    counted = shards.select("vocabulary", "df").mapInPandas(_frequencies(spark.sparkContext.broadcast(words)), "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df[counted["term"]] = counted["df"]
    numbers = [np.searchsorted(words, t) for _, t in queries]
    shared = spark.sparkContext.broadcast({
        "words": words, "idf": np.log(1 + (n - df + 0.5) / (df + 0.5)), "mean": mean, "qid": [q for q, _ in queries],
        "terms": np.concatenate(numbers).astype(np.int32), "start": np.concatenate(([0], np.cumsum([len(t) for t in numbers]))),
    })
    found = shards.mapInPandas(_search(shared, k), "query int, qid bigint, doc_id bigint, score double")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id"))
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("qid", "rank", "doc_id", "score")


def op5_bm25_search(spark, sf_dir: str) -> DataFrame:
    """Queries: the whole text of every document whose id is divisible by 50; hits: all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, docs.where("doc_id % 50 = 0")).withColumn("score", F.round("score", 6))


_TOKENS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = f"""
WITH w AS (SELECT doc_id, {_TOKENS} AS w FROM documents WHERE doc_id IS NOT NULL),
n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
e AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM w) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM e GROUP BY t),
q AS (SELECT doc_id AS qid, t, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM e JOIN f USING (t), n WHERE doc_id % 50 = 0),
s AS (SELECT qid, e.doc_id, round(sum(idf * tf * ({K1}::DOUBLE + 1) / (tf + {K1}::DOUBLE * (1 - {B}::DOUBLE + {B}::DOUBLE * len(w.w) / mean))), 6) AS score
  FROM q JOIN e USING (t) JOIN w ON w.doc_id = e.doc_id, n GROUP BY ALL)
SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""
