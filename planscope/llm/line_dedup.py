"""Line dedup by pairwise alignment: documents that share lines are aligned with patience diff, and the aligned common
blocks are deleted from the later document (the one with the larger id).

Only line hashes move. A block is a run of consecutive lines with ``MIN_WORDS`` words or more that the earlier document
has as consecutive lines too. Any line of a block lies in a shortest run that reaches ``MIN_WORDS`` words from its
first or to its last line, so documents that share such a run, whatever the length of its lines, are candidates, and
every run pairs each of its holders with the first one (its least id): a number of pairs linear in the lines, however
many documents share a run. Documents with equal lines are one kind: the first stands for all, the others go whole.

Within a pair, lines unique on both sides are matched along a longest increasing subsequence, matches grow over equal
neighbours, and the gaps between are aligned likewise; aligned runs of ``MIN_WORDS`` words go. Patience matches nothing
twice and nothing out of order, so runs that it leaves are then placed again: those that the partner has elsewhere, or
that stand in one of the two more than once, go too. With that the first holder settles a run for good (no other
earlier document could take more of it), and the result is that of all pairs:

* a line is deleted exactly if it lies in a run of ``MIN_WORDS`` words that an earlier document has;
* the first document that holds a run keeps it, so no content is lost.

Defined cases: null and empty texts stay as they are; rows with a null id are neither aligned nor changed; rows that
share an id are versions of one document and not compared with each other, each loses its own lines; lines are
compared without the white space around them; lines repeated inside one document stay if no earlier document has
them. A document all of whose lines go keeps an empty text in ``dedup_lines``; the pipeline stage drops it. Extra
columns are kept; one called ``deleted_lines`` is replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planscope.llm.common import WORD, checkpointed, release_memory, small_batches, table

MIN_WORDS = 10
BASE = 0x9E3779B97F4A7C15  # of the hashes of runs; odd, so that it has an inverse
LENGTH, PAIR = np.uint64(0xD1342543DE82EF95), np.uint64(0xBF58476D1CE4E5B9)
LINES = 200_000  # of the pairs that are aligned together


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs (sorted by the first) that increases in the second: patience sorting."""
    tops, piles, back = [], [], []
    for i, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        if k == len(tops):
            tops.append(j)
            piles.append(i)
        else:
            tops[k], piles[k] = j, i
        back.append(piles[k - 1] if k else -1)
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) with a[i] == b[j], increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        seen_a: dict[int, int] = {}
        for i in range(a0, a1):
            seen_a[a[i]] = -1 if a[i] in seen_a else i
        seen_b: dict[int, int] = {}
        for j in range(b0, b1):
            if b[j] in seen_a:
                seen_b[b[j]] = -1 if b[j] in seen_b else j
        unique = sorted((i, seen_b[x]) for x, i in seen_a.items() if i >= 0 and seen_b.get(x, -1) >= 0)
        anchors = _increasing(unique)
        if not anchors:
            continue
        out += anchors
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            if k - i > 1 and m - j > 1:
                todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def run_names(lines: np.ndarray, words: np.ndarray, least: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last line of the shortest runs with ``least`` words from and to each line; ``sizes`` says how
    many lines each of the documents has that stand one after another in ``lines``."""
    line, words = lines.view(np.uint64), words.astype(np.int64)
    low = np.repeat(np.cumsum(sizes) - sizes, sizes)
    high = low + np.repeat(sizes, sizes)
    place = np.arange(len(line))
    after = np.cumsum(words)
    before = after - words
    stop = np.searchsorted(after, before + least, side="left")
    start = np.searchsorted(before, after - least, side="right") - 1
    down, up = stop < high, start >= low
    ends = np.unique(np.append(place[down], start[up]) << 32 | np.append(stop[down], place[up]))
    first, last = ends >> 32, ends & 0xFFFFFFFF
    # a polynomial of the line hashes, modulo 2**64, from prefix sums
    power = np.cumprod(np.append(np.uint64(1), np.full(len(line), BASE, dtype=np.uint64)))
    back = np.cumprod(np.append(np.uint64(1), np.full(len(line), pow(BASE, -1, 1 << 64), dtype=np.uint64)))
    total = np.append(np.uint64(0), np.cumsum(line * power[:-1]))
    name = (total[last + 1] - total[first]) * back[first] ^ (last - first).astype(np.uint64) * LENGTH
    return name.view(np.int64), first, last


def aligned_blocks(a: list[int], words: list[int], b: list[int], least: int) -> list[int]:
    """Lines of ``a`` in runs of ``least`` words or more that patience aligns with a run of ``b``."""
    out, run, total, after = [], [], 0, (-2, -2)
    for i, j in patience(a, b):
        if (i, j) != after:
            if total >= least:
                out += run
            run, total = [], 0
        run.append(i)
        total += words[i]
        after = (i + 1, j + 1)
    return out + run if total >= least else out


def common_blocks(a: list[np.ndarray], words: list[np.ndarray], b: list[np.ndarray], b_words: list[np.ndarray], least: int) -> list[np.ndarray]:
    """For each pair, numbers of the lines of ``a`` (hashes) in blocks: aligned by patience, or moved or repeated in one of the two."""
    size, b_size = (np.array([len(x) for x in side], dtype=np.int64) for side in (a, b))
    low = np.cumsum(size) - size
    gone = np.zeros(int(size.sum()), dtype=bool)
    for at, x, w, y in zip(low.tolist(), a, words, b, strict=True):
        found = aligned_blocks(x.tolist(), w.tolist(), y.tolist(), least)
        if found:
            gone[at + np.array(found)] = True
    name, first, last = run_names(np.concatenate(a), np.concatenate(words), least, size)
    b_name, b_first, _ = run_names(np.concatenate(b), np.concatenate(b_words), least, b_size)
    # names of all pairs at once, each mixed with its pair
    pair = (np.arange(len(size)).astype(np.uint64) * PAIR).view(np.int64)
    there = np.isin(name + np.repeat(pair, size)[first], b_name + np.repeat(pair, b_size)[b_first])
    steps = np.bincount(first[there], minlength=len(gone) + 1) - np.bincount(last[there] + 1, minlength=len(gone) + 1)
    gone |= np.cumsum(steps)[:-1] > 0
    return [np.flatnonzero(x).astype(np.int32) for x in np.split(gone, low[1:])]


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, version, lines, words): hashes and word counts of the lines of every document with an id."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    # trim, as the alignment compares lines without the white space around them
    hashed = F.transform(lines, lambda x: F.xxhash64(F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")))
    words = F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD)))
    return docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("version"), hashed.alias("lines"), words.alias("words"))


def _runs(least: int):
    """(doc_id, version, run): the shortest runs of lines with ``least`` words, from and to each line, once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            lines, words = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
            name, first, _ = run_names(lines, words, least, size)
            row = np.repeat(np.arange(len(size)), size)[first]
            order = np.lexsort((name, row))
            row, name = row[order], name[order]
            new = np.append(True, (row[1:] != row[:-1]) | (name[1:] != name[:-1]))[: len(row)]
            of = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(name[new])], names=["doc_id", "version", "run"])
        release_memory()

    return run


def aligned_lines(pairs: DataFrame, lines: DataFrame, least: int) -> DataFrame:
    """(doc_id, version, deleted): common blocks of the pairs (doc_id, version, other)."""
    earlier = lines.select(F.col("doc_id").alias("other"), F.col("lines").alias("theirs"), F.col("words").alias("their_words"))

    @F.pandas_udf("array<int>")
    def blocks(a: pd.Series, w: pd.Series, b: pd.Series, v: pd.Series) -> pd.Series:
        out, cut = [], np.cumsum(a.map(len) + b.map(len)).to_numpy() // LINES
        for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(cut)) + 1):
            out += common_blocks(*(list(x.iloc[part]) for x in (a, w, b, v)), least) if len(part) else []
        return pd.Series(out, dtype=object)

    # the partner's lines first, so that what travels to the later document is a pair of small arrays
    found = pairs.join(earlier, "other").join(lines, ["doc_id", "version"]).select("doc_id", "version", blocks("lines", "words", "theirs", "their_words").alias("gone"))
    # a document has no more distinct deleted lines than lines
    each = found.select("doc_id", "version", F.explode("gone").alias("line")).groupBy("doc_id", "version")
    return each.agg(F.collect_set("line").alias("deleted"))


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, version, deleted): numbers of the lines (from 0) that go, for documents that lose any."""
    lines = checkpointed(line_table(docs).dropDuplicates(["doc_id", "version"]).withColumn("kind", F.xxhash64("lines")))
    kinds = lines.groupBy("kind").agg(F.min("doc_id").alias("origin"), F.max("doc_id").alias("last")).where("origin <> last").drop("last")
    kinds = kinds.repartition("origin")  # so that the join has exchanges of its own, which adaptive execution can split
    lines = checkpointed(lines.join(kinds, "kind", "left").drop("kind"))
    total = F.aggregate("words", F.lit(0), lambda x, y: x + y)
    copies = lines.where((F.col("doc_id") > F.col("origin")) & (total >= min_words))
    copies = copies.select("doc_id", "version", F.sequence(F.lit(0), F.size("lines") - 1).alias("deleted"))
    lines = lines.where("origin is null or doc_id = origin").drop("origin")

    runs = lines.select("doc_id", "version", "lines", "words").mapInArrow(_runs(min_words), "doc_id bigint, version bigint, run bigint")
    holders = runs.groupBy("run").agg(F.min("doc_id").alias("other"), F.max("doc_id").alias("last")).where("other <> last").drop("last")
    pairs = runs.join(holders, "run").where("doc_id > other").select("doc_id", "version", "other").distinct()
    return aligned_lines(pairs, lines, min_words).unionByName(copies)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the common blocks deleted from the text, and deleted_lines (their numbers, sorted)."""
    gone = deleted_lines(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), min_words)
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("deleted").alias("__gone"))
    kept = [c for c in docs.columns if c != "deleted_lines"]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(id_col).cast("long").alias("__row"), F.xxhash64(F.col(text_col)).alias("__of"))
    rows = rows.join(gone, (F.col("__row") == F.col("__id")) & (F.col("__of") == F.col("__version")), "left")
    left = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    new = F.when(F.col("__gone").isNotNull() & F.col(text_col).isNotNull(), left).otherwise(F.col(text_col))
    cols = [new.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept]
    return rows.select(*cols, F.coalesce(F.sort_array("__gone"), F.array().cast("array<int>")).alias("deleted_lines"))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("deleted_lines").cast("long").alias("n_deleted"), "deleted_lines", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def line_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents lose their common blocks; those of which nothing but white space is left go."""
    small_batches(spark)
    out = dedup_lines(docs)
    left = out.where((F.size("deleted_lines") == 0) | F.col("text").rlike(WORD))
    return left.select("doc_id", "text", "lang", "source", F.when(F.size("deleted_lines") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long")).alias("n_chars"))
