"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are classes of documents with the same shingle set, columns are shingles. Overlap counts are
accumulated only where a size-derived bound lets a pair qualify:

1. Each text becomes a sorted array of shingle hashes. Equal sets form a class; only classes enter the product.
2. Columns are ordered by a fixed-size count sketch (rare first). With ``percent`` as threshold, a linked pair
   shares a column among the first ``n - ceil(percent * n / 100) + 1`` of both rows, so only these columns are
   dealt out, by column (a row per class and task: copies are dropped before the shuffle). Any order of the
   columns is exact; the sketch only keeps frequent columns out.
3. A column with at most ``SMALL`` classes gives pairs within the bounds on sizes and positions; a parity bitmap of
   each class bounds the symmetric difference from below and discards most of the rest; the overlap of those
   that remain is counted on the whole sets.
4. A column with more classes is multiplied by blocks: its classes are ordered by set size into bands such that only
   sets of the same band or of neighbouring ones can link, and hashed within a band to blocks of about ``BLOCK``. A
   task gets two blocks, multiplies their whole rows, and returns a spanning forest of the links it found; block pairs
   of other bands are never made. That is exact for components and never writes the pairs of a group.
5. Links join to components (``components.py``), classes take theirs to all documents.

Defined cases: null and empty texts have the empty set and stay alone; equal texts (and texts with equal sets)
are linked; a repeated row belongs to the same component; with a null id the component is the smallest id that is
not null. Hashes are 64-bit. ``jaccard_components`` returns its own columns only. ``ngram_join_stage`` keeps one row of
each component, of least id (null ids last), then of least text hash; rows that share an id with different texts are
different documents, equal rows are one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planscope.llm import shingles
from planscope.llm.common import checkpointed, release_memory, small_batches, table, text_slices
from planscope.llm.components import connected_components
from planscope.llm.url_filter import may_contain

SKETCH_BITS = 18
SLICES = 64
SMALL = 64
BLOCK = 1024
#: Postings that are compared together.
TOGETHER = 10_000


def least_overlap(a, b, percent: int):
    """The overlap that sets of sizes a and b need: 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def parity_bitmap(s: np.ndarray) -> bytes:
    """Bit i is the parity of the number of elements that hash to i; 8 bits per element or more, a power of 2 in
    all. Bitmaps of different sizes compare after folding the longer one by xor."""
    bits = 64
    while bits < 8 * len(s):
        bits *= 2
    count = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(count.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets from their bitmaps."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _describe(words: int):
    """(doc_id, key, hash, class, n, bitmap) per row, and the task's share of the column sketch as slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = np.zeros(1 << SKETCH_BITS, dtype=np.int64), set()
        for batch in batches:
            out = ([], [], [])
            for s in (s for texts in text_slices(batch.column(1)) for s in shingles.shingle_sets(texts, words)):
                name = shingles.set_signature(s)
                out[0].append(name)
                out[1].append(len(s))
                out[2].append(parity_bitmap(s) if len(s) else None)
                if len(s) and name not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(name)
                    np.add.at(sketch, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names=["doc_id", "key", "hash", "class", "n", "bitmap", "slice", "counts"],
            )
        parts = sketch.reshape(SLICES, -1)
        if sketch.any():
            release_memory()
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, none, pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["doc_id", "key", "hash", "class", "n", "bitmap", "slice", "counts"],
            )

    return run


def _sum_slices(key, rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((1 << SKETCH_BITS) // SLICES, dtype=np.int64)
    for x in rows["counts"]:
        total += np.frombuffer(x, dtype=np.int64)
    return pd.DataFrame({"slice": [key[0]], "counts": [total.tobytes()]})


def _sum_some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per slice and task: the partial sums before the shuffle."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b["slice"], b["counts"], strict=True):
            total[k] = total.get(k, 0) + np.frombuffer(x, dtype=np.int64)
    yield pd.DataFrame({"slice": pd.Series(list(total), dtype="int32"), "counts": [v.tobytes() for v in total.values()]})


def _postings(words: int, percent: int, sketch):
    """(token, class, place): the rare columns of each class, once per task; place is n * 2**32 + position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sketch.value, set()
        for batch in batches:
            token, name, place = [], [], []
            for s in (s for texts in text_slices(batch.column(0)) for s in shingles.shingle_sets(texts, words)):
                own = shingles.set_signature(s)
                if not len(s) or own in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(own)
                p = prefix_length(len(s), percent)
                rate = counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                first = np.lexsort((s, rate))[:p]
                token.append(s[first])
                name.append(np.full(p, own, dtype=np.int64))
                place.append((np.int64(len(s)) << 32) + np.arange(p))
            if token:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(name)), pa.array(np.concatenate(place))], names=["token", "class", "place"]
                )
        release_memory()

    return run


def _bucket_pairs(percent: int):
    """Over postings sorted by token, place and class: pairs (a, b) of small columns, and the members (b null) of large ones."""

    def small(token, name, place) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs at distance 1, 2, ... within columns, so that whole arrays are compared at once."""
        size, position = place >> 32, place & 0xFFFFFFFF
        for gap in range(1, SMALL):
            same = token[gap:] == token[:-gap]
            if not same.any():
                return
            i = np.flatnonzero(same)
            j = i + gap
            na, nb = size[i], size[j]
            need = least_overlap(na, nb, percent)
            good = (np.minimum(na, nb) >= need) & (np.minimum(na - position[i], nb - position[j]) >= need) & (name[i] != name[j])
            if good.any():
                a, b = name[i[good]], name[j[good]]
                yield np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, large = None, None

        def work(token, name, place):
            start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            length = np.diff(np.append(start, len(token)))
            many = np.repeat(length, length)
            wide = many > SMALL
            if large is not None:
                wide |= token == large
            few = (many > 1) & ~wide
            for a, b in small(token[few], name[few], place[few]):
                pairs = np.unique(np.stack([a, b], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.nulls(len(pairs), pa.int64())], names=_PAIR)
            if wide.any():
                yield pa.RecordBatch.from_arrays([pa.array(token[wide]), pa.array(name[wide]), pa.nulls(int(wide.sum()), pa.int64()), pa.array(place[wide])], names=_PAIR)

        held = []
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            if not held or (batch is not None and sum(len(c[0]) for c in held) < TOGETHER):
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
            # a class that several tasks sent counts once, so that what is held decides between small and large
            keep = np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
            cols = [c[keep] for c in cols]
            token = cols[0]
            last = np.searchsorted(token, token[-1], side="left")
            if len(token) - last > SMALL:  # a large column streams through
                last = len(token)
            if last:
                yield from work(*[c[:last] for c in cols])
                large = token[-1] if last == len(token) else (large if last == 0 else None)
            carry = [c[last:] for c in cols]
        if carry is not None and len(carry[0]):
            yield from work(*carry)
        carry = None
        release_memory()

    return run


_PAIR = ["token", "a", "b", "place"]


def _block_links(percent: int):
    """Links within and between two blocks of a large column: the sparse product of their rows, as a spanning forest."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("class").sort_values(["n", "class"], ignore_index=True)
        name, n, block = rows["class"].to_numpy(), rows["n"].to_numpy(), rows["block"].to_numpy()
        col = np.concatenate([np.asarray(s, dtype=np.int64) for s in rows["tokens"]])
        row = np.repeat(np.arange(len(rows)), n)
        order = np.argsort(col, kind="stable")
        col, row = col[order], row[order]
        _, number = np.unique(col, return_inverse=True)
        bounds = np.searchsorted(number, np.arange(number[-1] + 2))
        by_row = np.argsort(row, kind="stable")
        row_start = np.searchsorted(row[by_row], np.arange(len(rows) + 1))
        parent = np.arange(len(rows))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out, two = [], key[1] != key[2]
        for i in range(len(rows)):
            columns = number[by_row[row_start[i] : row_start[i + 1]]]
            hits = np.concatenate([row[bounds[c] : bounds[c + 1]] for c in columns])
            overlap = np.bincount(hits[hits > i], minlength=len(rows))
            good = overlap >= least_overlap(n[i], n, percent)
            good[: i + 1] = False
            if two:
                good &= block != block[i]
            for j in np.flatnonzero(good):
                x, y = root(i), root(j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((name[i], name[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _sets(words: int):
    """(class, n, tokens) from (class, n, text); a text of another class (rows that share an id) gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            name, n, tokens = [], [], []
            for own, s in zip(batch.column(0).to_pylist(), shingles.shingle_sets(batch.column(2).to_pylist(), words), strict=True):
                if shingles.set_signature(s) == own:
                    name.append(own)
                    n.append(len(s))
                    tokens.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(n, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], names=["class", "n", "tokens"])
        release_memory()

    return run


def _passes_bitmaps(percent: int):
    @F.pandas_udf("boolean")
    def passes(na: pd.Series, ma: pd.Series, nb: pd.Series, mb: pd.Series) -> pd.Series:
        return pd.Series([least_difference(x, y) <= p + q - 2 * least_overlap(p, q, percent) for p, x, q, y in zip(na.tolist(), ma, nb.tolist(), mb, strict=True)], dtype=bool)

    return passes


def _overlap_enough(percent: int):
    @F.pandas_udf("boolean")
    def enough(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(
            [len(np.intersect1d(x, y, assume_unique=True)) >= least_overlap(len(x), len(y), percent) for x, y in zip(a, b, strict=True)], dtype=bool
        )

    return enough


def describe(docs: DataFrame, words: int) -> tuple[DataFrame, object]:
    """(doc_id, key, hash, class, n, bitmap) of ``docs`` (doc_id, text, key, hash), checkpointed, and the broadcast column sketch."""
    spark = docs.sparkSession
    rows = checkpointed(docs.mapInArrow(_describe(words), "doc_id bigint, key bigint, hash bigint, class bigint, n bigint, bitmap binary, slice int, counts binary"))
    parts = rows.where("slice is not null").select("slice", "counts").mapInPandas(_sum_some, "slice int, counts binary")
    slices = parts.groupBy("slice").applyInPandas(_sum_slices, "slice int, counts binary").collect()  # 64 rows, 2 MB in all
    sketch = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), dtype=np.int64)
    for r in slices:
        sketch[r["slice"]] = np.frombuffer(r["counts"], dtype=np.int64)
    return rows.where("slice is null").select("doc_id", "key", "hash", "class", "n", "bitmap"), spark.sparkContext.broadcast(sketch.reshape(-1))


def _deal(members: DataFrame, percent: int) -> DataFrame:
    """(token, lo, hi, block, class) of members (token, class, size): each class in every pair of blocks that it is part of.

    Sizes a <= b of sets that link satisfy 100 * a >= percent * b. Bands are powers of 100 / percent, so links lie within a band or
    between neighbours; blocks are numbered band * 2**20 + block."""
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(float(np.log(100 / percent))) + 1e-9).cast("int") if percent < 100 else F.col("size").cast("int")
    rows = members.withColumn("band", band)
    blocks = rows.groupBy("token", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    near = blocks.join(blocks.select("token", (F.col("band") - 1).alias("band"), F.col("k").alias("above")), ["token", "band"], "left")
    near = near.join(blocks.select("token", (F.col("band") + 1).alias("band"), F.col("k").alias("below")), ["token", "band"], "left")
    number = lambda band, block: (band.cast("bigint") * (1 << 20) + block).cast("bigint")
    rows = rows.join(near, ["token", "band"])
    block = F.pmod(F.xxhash64("class"), F.col("k")).cast("int")
    every = lambda k, shift: F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1), lambda x: number(F.col("band") + shift, x))
    none = F.array().cast("array<bigint>")
    others = F.concat(every(F.col("k"), 0), F.when(F.col("above").isNotNull(), every(F.col("above"), 1)).otherwise(none), F.when(F.col("below").isNotNull(), every(F.col("below"), -1)).otherwise(none))
    dealt = rows.select("token", "class", number(F.col("band"), block).alias("block"), F.explode(others).alias("other"))
    return dealt.select("token", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "class")


def class_links(docs: DataFrame, described: DataFrame, sketch, words: int, percent: int) -> DataFrame:
    """Links (a, b) between classes that give the components of all links."""
    posts = docs.select("text").mapInArrow(_postings(words, percent, sketch), "token bigint, class bigint, place bigint")
    posts = posts.repartition(F.col("token")).sortWithinPartitions("token", "place", "class")
    found = checkpointed(posts.mapInArrow(_bucket_pairs(percent), "token bigint, a bigint, b bigint, place bigint"))
    classes = described.where("n > 0").groupBy("class").agg(F.first("n").alias("n"), F.min("key").alias("rep"), F.first("bitmap").alias("bitmap"))

    pairs = found.where("b is not null").select("a", "b").distinct()
    left = classes.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ma"))
    right = classes.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("mb"))
    pairs = pairs.join(left, "a").join(right, "b").where(_passes_bitmaps(percent)("na", "ma", "nb", "mb")).select("a", "b")
    pairs = checkpointed(pairs)
    members = found.where("b is null").select("token", F.col("a").alias("class"), F.shiftright("place", 32).alias("size")).dropDuplicates(["token", "class"])

    # whole sets of the classes that any of these need, from the text of one document each
    needed = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).union(members.select("class")).distinct()
    needed = needed.join(classes.select("class", "rep", "n"), "class")
    # (a Bloom filter of bounded size keeps most other texts out of the shuffle; the join is exact)
    needed = checkpointed(needed)
    texts = may_contain(docs.select(F.col("key").alias("rep"), "text"), "rep", needed, "rep").join(needed, "rep")
    sets = texts.select("class", "n", "text").mapInArrow(_sets(words), "class bigint, n bigint, tokens array<bigint>")
    sets = checkpointed(sets.dropDuplicates(["class"]))  # repeated rows of one document have one set

    a = sets.select(F.col("class").alias("a"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("class").alias("b"), F.col("tokens").alias("tb"))
    sure = pairs.join(a, "a").join(b, "b").where(_overlap_enough(percent)("ta", "tb")).select("a", "b")

    product = _deal(members, percent).join(sets, "class").groupBy("token", "lo", "hi").applyInPandas(_block_links(percent), "a bigint, b bigint")
    return sure.unionByName(product)


def jaccard_rows(docs: DataFrame, *, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hash, n, root) per row of ``docs``: rows of one component share ``root``; ``hash`` names the text."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("key", F.coalesce("doc_id", F.xxhash64("text"))).withColumn("hash", F.xxhash64("text"))  # finds a text again, also without an id
    described, sketch = describe(docs, words)
    root = connected_components(class_links(docs, described, sketch, words, percent))
    rows = described.select("doc_id", "hash", "class", "n").join(root, F.col("class") == F.col("node"), "left")
    return rows.select("doc_id", "hash", "n", F.coalesce("root", "class").alias("root"))


def jaccard_components(docs: DataFrame, *, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``; linked when 100 * |A & B| >= percent * |A | B|."""
    rows = jaccard_rows(docs, words=words, percent=percent, id_col=id_col, text_col=text_col)
    least = rows.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    least = least.repartition("component_id")  # so that the join has exchanges of its own, which adaptive execution can split
    out = rows.join(least, "root", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def first_of_components(docs: DataFrame, *, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component; documents without words all stay."""
    rows = jaccard_rows(docs, words=words, percent=percent, id_col=id_col, text_col=text_col)
    # rows with equal id and text are one document
    each = checkpointed(rows.where("n > 0").groupBy("root", "doc_id", "hash").agg(F.count("*").alias("copies")))
    first = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("first")).repartition("first")
    judged = each.join(first, "root").select("doc_id", "hash", "copies", (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.hash") == F.col("hash"))).alias("stays"))
    name = lambda d: [F.coalesce(d.cast("string"), F.lit("null")).alias("__id"), d.isNull().alias("__null")]
    gone = judged.where(~F.col("stays")).select(*name(F.col("doc_id")), F.col("hash").alias("__hash"))
    on = ["__id", "__null", "__hash"]
    own = docs.withColumn("__hash", F.xxhash64(F.col(text_col))).withColumns(dict(zip(on, name(F.col(id_col).cast("long")), strict=False)))
    kept = own.join(gone, on, "left_anti")
    several = checkpointed(judged.where(F.col("stays") & (F.col("copies") > 1)).select(*name(F.col("doc_id")), F.col("hash").alias("__hash")))
    if not several.isEmpty():  # of equal rows one stays; equal rows meet after partial aggregation
        copies = kept.join(several, on, "left_semi").groupBy(*on).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__row"))
        kept = kept.join(several, on, "left_anti").unionByName(copies.select(*on, "__row.*"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def ngram_join_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates (five words, similarity of 0.8 or more): the first document of each component stays."""
    small_batches(spark)
    return first_of_components(docs, words=5, percent=80).select("doc_id", "text", "lang", "source", "n_chars")


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * i >= 85 * (len(x.s) + len(y.s) - i)),
c(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, c.root FROM c JOIN l ON c.doc_id = l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, min(c.root) AS component_id FROM s JOIN c ON c.doc_id = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
