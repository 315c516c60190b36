"""Document fingerprints: invertible Bloom lookup tables over paragraph digests, in DataFrame functions only.

A text's paragraphs (lines; long ones in segments of at most ``SEGMENT`` characters, so that an edit inside a
long paragraph leaves the rest of it alike) are hashed to 64-bit digests; the set of digests goes into a table of
cells, each digest into one cell of each of three rows. A cell holds how many digests it got, their xor, and
the xor of their check hashes. The fingerprint is the table of 12 cells as text.

Likeness of two fingerprints: subtract the tables cell by cell and peel: a cell with count +1 or -1 whose check
fits holds one differing digest, which is taken out of its other cells, until nothing is left. What was peeled are the
differing digests, and with the numbers of digests of both sides they give the Jaccard similarity of the sets.
When peeling gets stuck, larger tables are tried: the digests are dealt to as many buckets as keeps about
``LOAD`` of each side in one, and a bucket's table has 6, then 12, 24, 48 cells per row. A bucket on which all of these
fail is compared digest by digest, so a likeness is always exact up to 64-bit collisions.

Likeness of equal sets is 1.0, that of two texts without paragraphs too, that of disjoint ones 0.0.

The exchange is by the key of a document once with its text; a neighbour receives only the prefix that its
edit needs (a third of its own length) and digests, never whole texts. The retry stage explodes digests inside the
partitions that hold their documents already.

Defined cases: null text is the empty text. Documents are ordered by descending id, null ids last; rows that share an
id are ordered by text hash, and rows that repeat id and text are one document in that order, each with
its result. The next document of the last is the first; of a single one, itself. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planscope.llm.common import checkpointed, table

SEGMENT = 64
CELL = "struct<c:int,k:bigint,h:bigint>"
CELLS = f"array<{CELL}>"
ROOT_WIDTH = 4
LOAD = 4
WIDTHS = (6, 12, 24, 48)


def paragraph_digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraph segments of ``text``."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"(?s)[^\n]{{1,{SEGMENT}}}"), F.lit(0)), lambda p: F.xxhash64(p)))


def _place(d: Column, row: int, width) -> Column:
    """The cell of digest ``d`` in a row: each row looks at other bits of the digest."""
    return F.pmod(F.shiftrightunsigned(d, 14 * row).bitwiseAND(F.lit(0x3FFFF)), F.lit(width) if isinstance(width, int) else width).cast("int")


def _check(d: Column) -> Column:
    return F.xxhash64(F.lit("check"), d)


def _cell(c: Column, k: Column, h: Column) -> Column:
    return F.struct(c.cast("int").alias("c"), k.alias("k"), h.alias("h"))


def _empty_cell() -> Column:
    return _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))


def entries(digests: Column, sign: int, width: Column | int) -> Column:
    """Digests with their check hash, sign, and the numbers of their cells in three rows of ``width``."""
    w = F.lit(width) if isinstance(width, int) else width
    return F.transform(digests, lambda d: _entry(d, F.lit(sign), w))


def _entry(d: Column, sign: Column, w: Column) -> Column:
    return F.struct(
        d.alias("d"), _check(d).alias("g"), sign.alias("s"), _place(d, 0, w).alias("p"), (w + _place(d, 1, w)).alias("q"), (w * 2 + _place(d, 2, w)).alias("r")
    )


def insert(cells: Column, added: Column) -> Column:
    """``cells`` with every entry added."""
    return F.aggregate(added, cells, _toggle)


def _toggle(cells: Column, x: Column) -> Column:
    """Add an entry: xor makes adding and taking out alike but for the count."""

    def change(cell: Column, i: Column) -> Column:
        changed = _cell(cell["c"] + x["s"], cell["k"].bitwiseXOR(x["d"]), cell["h"].bitwiseXOR(x["g"]))
        return F.when((i == x["p"]) | (i == x["q"]) | (i == x["r"]), changed).otherwise(cell)

    return F.transform(cells, change)


def empty_table(width: Column | int) -> Column:
    w = F.lit(width) if isinstance(width, int) else width
    return F.array_repeat(_empty_cell(), (w * 3).cast("int")).cast(CELLS)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["c"] - y["c"], x["k"].bitwiseXOR(y["k"]), x["h"].bitwiseXOR(y["h"]))).cast(CELLS)


PEELED = f"struct<cells:{CELLS},only_a:int,only_b:int,stuck:boolean>"


def peel(cells: Column, width: Column | int, steps: Column) -> Column:
    """(only_a, only_b, done): how many digests either side has alone, and whether the table was emptied."""
    w = F.lit(width) if isinstance(width, int) else width
    zero = F.struct(cells.alias("cells"), F.lit(0).alias("only_a"), F.lit(0).alias("only_b"), F.lit(False).alias("stuck")).cast(PEELED)

    def step(s: Column, _: Column) -> Column:
        # get() of an empty array is null; arrays of one candidate let the step name it and its entry once
        pure = F.get(F.filter(s["cells"], lambda x: (F.abs(x["c"]) == 1) & (x["h"] == _check(x["k"]))), F.lit(0))

        def taken_out(p: Column) -> Column:
            cells = F.element_at(F.transform(F.array(_entry(p["k"], -p["c"], w)), lambda e: _toggle(s["cells"], e)), 1)
            return F.struct(
                cells.alias("cells"), (s["only_a"] + (p["c"] > 0).cast("int")).alias("only_a"), (s["only_b"] + (p["c"] < 0).cast("int")).alias("only_b"), F.lit(False).alias("stuck")
            ).cast(PEELED)

        return F.element_at(F.transform(F.array(pure), lambda p: F.when(p.isNull(), s.withField("stuck", F.lit(True)).cast(PEELED)).otherwise(taken_out(p))), 1)

    def guarded(s: Column, i: Column) -> Column:
        return F.when(s["stuck"], s).otherwise(step(s, i))

    done = lambda s: F.forall(s["cells"], lambda x: (x["c"] == 0) & (x["k"] == 0) & (x["h"] == 0))
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), zero, guarded,
        lambda s: F.struct(s["only_a"].alias("only_a"), s["only_b"].alias("only_b"), done(s).alias("done")),
    )


def root_table(digests: Column) -> Column:
    return insert(empty_table(ROOT_WIDTH), entries(digests, 1, ROOT_WIDTH))


def fingerprint_text(cells: Column) -> Column:
    """Cells as count-xor-check in hexadecimal, joined by dots."""
    return F.array_join(F.transform(cells, lambda x: F.concat_ws("-", F.lower(F.hex(x["c"].cast("long"))), F.lower(F.hex(x["k"])), F.lower(F.hex(x["h"])))), ".")


TRIED = "struct<done:boolean,only_a:int,only_b:int>"


def bucket_difference(a: Column, b: Column) -> Column:
    """How many digests ``a`` and ``b`` differ in, by tables of growing width, at last digest by digest."""

    def attempt(best: Column, width: Column) -> Column:
        cells = insert(empty_table(width), F.concat(entries(a, 1, width), entries(b, -1, width)))
        steps = F.size(a) + F.size(b) + 1
        peeled = peel(cells, width, steps)
        return F.when(best["done"], best).otherwise(F.element_at(F.transform(F.array(peeled), lambda p: F.struct(p["done"].alias("done"), p["only_a"].alias("only_a"), p["only_b"].alias("only_b")).cast(TRIED)), 1))

    zero = F.struct(F.lit(False).alias("done"), F.lit(0).alias("only_a"), F.lit(0).alias("only_b")).cast(TRIED)
    plain = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    tried = F.aggregate(F.array(*[F.lit(w) for w in WIDTHS]), zero, attempt, lambda s: F.when(s["done"], s["only_a"] + s["only_b"]))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.size(a) + F.size(b)).otherwise(F.coalesce(tried, plain))


def likeness(n_a: Column, n_b: Column, differing: Column) -> Column:
    """Jaccard similarity from the sizes and the size of the symmetric difference."""
    union = n_a + n_b + differing
    return F.when(union == 0, 1.0).otherwise((n_a + n_b - differing) / union).cast("double")


def successors(keys: DataFrame) -> DataFrame:
    """(id, hash) of every document with those of the next one and its own length. Only ids, hashes and lengths
    move: they are range-partitioned in order, linked inside a partition, and across partitions through one row each."""
    order = [F.col("absent").asc(), F.col("id").desc(), F.col("hash").desc()]
    key = ["id", "absent", "hash"]
    rows = checkpointed(keys.distinct().repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order)
    linked = rows.withColumn("next", F.lead(F.struct(*key)).over(inside))
    # the first document of every partition: as many rows as there are partitions
    heads = rows.withColumn("n", F.row_number().over(inside)).where("n = 1").select("part", F.struct(*key).alias("head"))
    around = Window.orderBy("part")
    first = F.first("head").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("part", F.coalesce(F.lead("head").over(around), first).alias("after"))
    linked = linked.join(F.broadcast(heads), "part")
    return linked.select(*key, "n_chars", F.coalesce("next", "after").alias("next"))


KEY = ["id", "absent", "hash"]


def edited_documents(docs: DataFrame) -> DataFrame:
    """``docs`` (KEY, text) once each, with copies, n_chars, edited and x: the next document's digests."""
    length = F.char_length("text").cast("long")
    links = successors(docs.select(*KEY, length.alias("n_chars")))
    own = Window.partitionBy(*KEY)
    # both uses need the same columns of the exchange by key, so that it is made once
    once = docs.withColumn("rn", F.row_number().over(own.orderBy("text"))).withColumn("copies", F.count("*").over(own)).where("rn = 1 and copies > 0").drop("rn")
    # what a document sends to the one before it: the prefix that the edit needs, and its digests
    wanted = links.select(*[F.col(f"next.{c}").alias(c) for c in KEY], *[F.col(c).alias(f"to_{c}") for c in KEY], F.floor(F.col("n_chars") / 3).cast("int").alias("take"))
    sent = once.join(wanted, KEY).select(
        *[F.col(f"to_{c}").alias(c) for c in KEY], F.substring("text", F.lit(1), F.col("take")).alias("prefix"), paragraph_digests(F.col("text")).alias("x")
    )
    both = once.join(sent, KEY).withColumn("n_chars", length)
    keep = (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int")
    return both.withColumn("edited", F.concat(F.substring("text", F.lit(1), keep), F.col("prefix")))


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    text, key = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    base = docs.select(F.coalesce(key, F.lit(0).cast("long")).alias("id"), key.isNull().alias("absent"), F.xxhash64(text).alias("hash"), text.alias("text"))
    rows = edited_documents(base).select(
        *KEY, "copies", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        paragraph_digests(F.col("text")).alias("a"), paragraph_digests(F.col("edited")).alias("e"), "x",
    )
    rows = rows.select("*", root_table(F.col("a")).alias("ta"), root_table(F.col("e")).alias("te"), root_table(F.col("x")).alias("tx"))
    steps = F.lit(3 * ROOT_WIDTH + 1)
    rows = rows.withColumns({"pe": peel(subtract(F.col("ta"), F.col("te")), ROOT_WIDTH, steps), "px": peel(subtract(F.col("ta"), F.col("tx")), ROOT_WIDTH, steps)})
    first = lambda p: F.when(F.col(p)["done"], F.col(p)["only_a"] + F.col(p)["only_b"])
    info = F.struct(
        "copies", "n_chars", "edited_sha256", fingerprint_text(F.col("ta")).alias("fingerprint"), fingerprint_text(F.col("te")).alias("edited_fingerprint"),
        first("pe").alias("de"), first("px").alias("dx"), F.size("a").alias("na"), F.size("e").alias("ne"), F.size("x").alias("nx"),
    )
    # the root tables that were peeled are settled; the larger tables see the rest, bucket by bucket: a bucket is
    # the digest's top bits, as many as keep LOAD digests of the larger side in one
    most = F.greatest(F.size("a"), F.size("e"), F.size("x"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(most / F.lit(float(LOAD)), F.lit(1.0)))).cast("int"))
    none, long_null = F.lit(None), F.lit(None).cast("long")
    rows = rows.select(*KEY, "a", "e", "x", info.alias("info"), bits.alias("bits"), (first("pe").isNull() | first("px").isNull()).alias("open"))
    tag = lambda c, side: F.transform(c, lambda d: F.struct(d.alias("d"), F.lit(side).alias("s")))
    every = F.when(F.col("open"), F.concat(F.array(F.struct(long_null.alias("d"), F.lit(-1).alias("s"))), tag("a", 0), tag("e", 1), tag("x", 2))).otherwise(
        F.array(F.struct(long_null.alias("d"), F.lit(-1).alias("s")))
    )
    flat = rows.select(*KEY, "bits", "info", F.explode(every).alias("v"))
    bucket = F.when((F.col("bits") == 0) | F.col("v.d").isNull(), F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.col("v.d"), F.lit(64) - F.col("bits")))
    flat = flat.select(*KEY, bucket.alias("bucket"), F.col("v.d").alias("d"), F.col("v.s").alias("s"), F.when(F.col("v.s") == -1, F.col("info")).otherwise(none).alias("info"))
    side = lambda k: F.collect_list(F.when(F.col("s") == k, F.col("d")))
    buckets = flat.groupBy(*KEY, "bucket").agg(side(0).alias("a"), side(1).alias("e"), side(2).alias("x"), F.first("info", ignorenulls=True).alias("info"))
    buckets = buckets.select(*KEY, "info", bucket_difference(F.col("a"), F.col("e")).alias("de"), bucket_difference(F.col("a"), F.col("x")).alias("dx"))
    out = buckets.groupBy(*KEY).agg(F.sum("de").alias("de"), F.sum("dx").alias("dx"), F.first("info", ignorenulls=True).alias("i"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("i.copies"))))
    return out.select(
        F.when(~F.col("absent"), F.col("id")).alias("doc_id"), F.col("i.n_chars").alias("n_chars"), F.col("i.edited_sha256").alias("edited_sha256"),
        F.col("i.fingerprint").alias("fingerprint"), F.col("i.edited_fingerprint").alias("edited_fingerprint"),
        likeness(F.col("i.na"), F.col("i.ne"), F.coalesce(F.col("i.de"), F.col("de"))).alias("near_edited"),
        likeness(F.col("i.na"), F.col("i.nx"), F.coalesce(F.col("i.dx"), F.col("dx"))).alias("near_next"),
    )


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
