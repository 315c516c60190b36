"""Bins, marginals and count cubes: exact counts of any range whose bounds are bin edges, from a grouped table.

Bin boundaries ``b0 < b1 < ...`` cut the integer domain into intervals ``(b[i-1], b[i]]``, numbered from 1. A cube is the
grouped table of bin numbers and counts, so it holds only cells that occur and never needs a dense array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planscope.operators.relation import as_integer

EPSILON = 1e-9


def bin_boundaries(df: DataFrame, column: str, budget: int, parts: int = 64) -> DataFrame:
    """(bin, boundary) of one column: with more distinct values than ``budget``, the values at evenly spaced sorted
    positions, repeats dropped; else all distinct values; the lowest boundary is one less than the least value.

    Runs when called and returns at most ``budget + 1`` rows. Positions come from value counts and their running sums. The
    distinct values are cut into ``parts`` ranges at approximate quantiles, so that no task sorts all of them; the cuts
    only deal the work, the boundaries are exact. An empty column has no boundaries."""
    value = as_integer(F.col(column)).alias("v")
    counts = df.where(F.col(column).isNotNull()).groupBy(value).agg(F.count("*").alias("cnt")).persist()
    try:
        cuts = F.percentile_approx("v", [i / parts for i in range(1, parts)], 1000).alias("cuts")
        whole = counts.agg(F.sum("cnt").alias("n"), F.count("*").alias("values"), F.min("v").alias("least"), cuts).first()
        if whole["values"] <= budget:
            found = [r.v for r in counts.select("v").collect()]
            chosen = sorted({v for v in found} | ({whole["least"] - 1} if found else set()))
        else:
            part = bin_index(F.col("v"), sorted(set(whole["cuts"])))
            totals = dict(counts.groupBy(part.alias("part")).agg(F.sum("cnt").alias("cnt")).collect())
            before, starts = 0, []
            for k in range(len(set(whole["cuts"])) + 1):
                starts.append(before)
                before += totals.get(k, 0)
            run = F.sum("cnt").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
            start = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("part") + 1)
            rows = counts.withColumn("part", part).withColumn("last", start + run - 1).withColumn("first", F.col("last") - F.col("cnt") + 1)
            # a value is picked if the first position trunc(i * (n - 1) / budget) from its run's start on falls in its run
            n = whole["n"]
            i = F.least(F.expr(f"(first * {budget} + {max(n - 2, 0)}) div {max(n - 1, 1)}"), F.lit(budget))
            position = F.expr(f"picked * {n - 1} div {budget}")
            picked = rows.withColumn("picked", i).where(position.between(F.col("first"), F.col("last")))
            chosen = sorted(r.v - (r.v == whole["least"]) for r in picked.select("v").collect())
    finally:
        counts.unpersist()
    return df.sparkSession.createDataFrame(list(enumerate(chosen)), "bin long, boundary long")


def collect_bins(bins: DataFrame) -> list[int]:
    """The boundaries on the driver: at most the bin budget plus one."""
    return [r.boundary for r in bins.orderBy("bin").collect()]


def bin_index(value: Column, bins: list[int]) -> Column:
    """The number of the interval that holds the value: how many boundaries lie below it. 0 and len(bins) are outside."""
    return F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bins]), lambda b: b < value))


def cube(df: DataFrame, bins: dict[str, list[int]]) -> DataFrame:
    """Counts by bin numbers (a column ``bin_<column>`` each); rows with a null in any binned column drop out."""
    rows = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in bins]))
    return rows.groupBy(*[bin_index(as_integer(F.col(c)), b).alias(f"bin_{c}") for c, b in bins.items()]).agg(F.count("*").alias("cnt"))


def marginal(df: DataFrame, column: str, bins: list[int]) -> DataFrame:
    """(bin, cnt) of one column with zeros for empty bins."""
    one = cube(df, {column: bins}).withColumnRenamed(f"bin_{column}", "bin")
    frame = df.sparkSession.range(1, len(bins)).select(F.col("id").cast("int").alias("bin"))
    return frame.join(one, "bin", "left").select("bin", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def marginals(df: DataFrame, bins: dict[str, list[int]]) -> DataFrame:
    """(column, bin, cnt) of many columns in one pass, zeros for empty bins; nulls and values outside are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), bin_index(as_integer(F.col(c)), b).alias("bin"), F.col(c).isNotNull().alias("known")) for c, b in bins.items()]))
    seen = df.select(each.alias("x")).where("x.known").groupBy("x.column", "x.bin").agg(F.count("*").alias("cnt"))
    frame = df.sparkSession.createDataFrame([(c, i) for c, b in bins.items() for i in range(1, len(b))], "column string, bin int")
    return frame.join(seen, ["column", "bin"], "left").select("column", "bin", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def strict_marginal(df: DataFrame, column: str, bins: list[int]) -> DataFrame:
    """``marginal``, an error if a bin is empty."""
    out = marginal(df, column, bins)
    empty = [r.bin for r in out.where("cnt = 0").collect()]
    if empty:
        raise ValueError(f"empty bins of {column}: {sorted(empty)}")
    return out


def summary(cells: DataFrame, columns: list[str]) -> DataFrame:
    """One row: total count, cells that occur, and bins in use per column."""
    return cells.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"), F.count("*").alias("cells"), *[F.count_distinct(f"bin_{c}").alias(f"bins_{c}") for c in columns])


def marginal_of_cube(cells: DataFrame, column: str) -> DataFrame:
    return cells.groupBy(F.col(f"bin_{column}").alias("bin")).agg(F.sum("cnt").alias("cnt"))


def slice_batch(cells: DataFrame, ranges: DataFrame, columns: list[str]) -> DataFrame:
    """(query_id, cardinality) of many ranges at once. ``ranges``: query_id, and lo_<c>, hi_<c> bin numbers (inclusive)
    per column; a null lo_<c> leaves the column free. The ranges are a stated query set; they meet the cells of the cube,
    not the rows."""
    on = reduce(lambda a, b: a & b, [F.col(f"lo_{c}").isNull() | F.col(f"bin_{c}").between(F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in columns])
    return ranges.join(cells, on, "left").groupBy("query_id").agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("cardinality"))


def independence(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Every cell with its expected count if the columns were independent, and both ratios."""
    total = cells.agg(F.sum("cnt").alias("__n"))
    out = cells.join(F.broadcast(total))
    for c in columns:
        m = marginal_of_cube(cells, c).select(F.col("bin").alias(f"bin_{c}"), F.col("cnt").alias(f"m_{c}"))
        out = out.join(m, f"bin_{c}")
    share = reduce(lambda a, b: a * b, [F.col(f"m_{c}").cast("double") / F.col("__n") for c in columns])
    out = out.withColumn("expected", share * F.col("__n"))
    out = out.withColumns({"under_ratio": F.col("cnt") / (F.col("expected") + EPSILON), "over_ratio": F.col("expected") / (F.col("cnt") + 1)})
    return out.select(*[f"bin_{c}" for c in columns], "cnt", "expected", "under_ratio", "over_ratio")


def independent_ranges(cells: DataFrame, ranges: DataFrame, columns: list[str]) -> DataFrame:
    """(query_id, estimate): product of each column's selectivity times the total."""
    total = cells.agg(F.sum("cnt").alias("n"))
    out = ranges.select("query_id").join(F.broadcast(total)).withColumn("estimate", F.col("n").cast("double"))
    for c in columns:
        part = slice_batch(marginal_of_cube(cells, c).withColumnRenamed("bin", f"bin_{c}"), ranges.select("query_id", f"lo_{c}", f"hi_{c}"), [c])
        out = out.join(part.withColumnRenamed("cardinality", "k"), "query_id").withColumn("estimate", F.col("estimate") * F.col("k") / F.col("n")).drop("k")
    return out.select("query_id", "estimate")


def prefix_cdf(m: DataFrame) -> DataFrame:
    """(bin, cdf, mid): cumulated share up to and including a bin, and at its middle."""
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run, total = F.sum("cnt").over(upto), F.sum("cnt").over(every)
    return m.select("bin", (run / total).alias("cdf"), ((run - F.col("cnt") / 2) / total).alias("mid"))


def interval_sums(m: DataFrame) -> DataFrame:
    """(lo, hi, cnt) of all intervals of bins, from prefix sums (the square of the bins, not of rows)."""
    run = m.select("bin", F.sum("cnt").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("s"), "cnt")
    a, b = run.alias("a"), run.alias("b")
    return a.join(b, F.col("a.bin") <= F.col("b.bin")).select(F.col("a.bin").alias("lo"), F.col("b.bin").alias("hi"), (F.col("b.s") - F.col("a.s") + F.col("a.cnt")).alias("cnt"))


def best_interval(benefit: DataFrame, cost: DataFrame, ratio: float) -> DataFrame:
    """The interval with the most benefit whose cost is at most ``ratio`` of all; if none is, the cheapest."""
    both = interval_sums(benefit).withColumnRenamed("cnt", "benefit").join(interval_sums(cost).withColumnRenamed("cnt", "cost"), ["lo", "hi"])
    total = cost.agg(F.sum("cnt").alias("t"))
    fits = F.col("cost") <= F.col("t") * ratio
    order = [fits.desc(), F.when(fits, F.col("benefit")).otherwise(-F.col("cost")).desc(), F.col("lo"), F.col("hi")]
    return both.join(F.broadcast(total)).orderBy(*order).limit(1).select("lo", "hi", "benefit", "cost")


def moving_average(m: DataFrame, width: int = 3) -> DataFrame:
    """Centred mean with zeros beyond the ends."""
    half = width // 2
    return m.select("bin", (F.sum("cnt").over(Window.orderBy("bin").rowsBetween(-half, half)) / width).alias("avg"))


def fill_zeros(m: DataFrame) -> DataFrame:
    """Zeros replaced by linear interpolation between the nearest non-zero bins; ends take the nearest."""
    before, after = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col("cnt") != 0, F.struct("bin", "cnt"))
    rows = m.withColumns({"l": F.last(point, ignorenulls=True).over(before), "r": F.first(point, ignorenulls=True).over(after)})
    l, r = F.coalesce("l", "r"), F.coalesce("r", "l")
    width = (r["bin"] - l["bin"]).cast("double")
    value = F.when(width == 0, l["cnt"].cast("double")).otherwise(l["cnt"] + (r["cnt"] - l["cnt"]) * F.try_divide(F.col("bin") - l["bin"], width))
    return rows.select("bin", F.coalesce(value, F.lit(0.0)).alias("value"))


def nearest_boundary(bins: DataFrame, values: DataFrame) -> DataFrame:
    """(value, bin) of the boundary closest to each value (the lower one on ties)."""
    pairs = values.join(F.broadcast(bins))
    return pairs.groupBy("value").agg(F.min_by("bin", F.struct(F.abs(F.col("boundary") - F.col("value")), "bin")).alias("bin"))


def expand_from(m: DataFrame, centre: int, target: int) -> DataFrame:
    """The bins reached when going out from ``centre``, alternately up and down, until their counts reach ``target``."""
    step = F.when(F.col("bin") > centre, 2 * (F.col("bin") - centre) - 1).otherwise(2 * (centre - F.col("bin")))
    run = F.sum("cnt").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    return m.withColumn("step", step).withColumn("before", F.coalesce(run, F.lit(0))).where(F.col("before") < target).select("bin", "cnt")


def column_features(df: DataFrame, columns: list[str], least_rows: int = 1000) -> DataFrame:
    """(column, distinct_values, kurtosis, skewness) from power sums in one pass (population moments); columns with few values are left out."""
    aggs = []
    for c in columns:
        aggs += [F.count(c).alias(f"n_{c}"), F.countDistinct(c).alias(f"d_{c}"), F.kurtosis(c).alias(f"k_{c}"), F.skewness(c).alias(f"s_{c}")]
    row = df.agg(*aggs)
    out = row.selectExpr(f"stack({len(columns)}, " + ", ".join(f"'{c}', n_{c}, d_{c}, k_{c}, s_{c}" for c in columns) + ") AS (column, n, distinct_values, kurtosis, skewness)")
    return out.where(F.col("n") > least_rows).drop("n")


def rank_columns(features: DataFrame) -> DataFrame:
    """(column, score): ranks by each feature, added up; the best has the least."""
    rank = lambda c: F.row_number().over(Window.orderBy(F.col(c), "column")) - 1
    return features.select("column", sum([rank(c) for c in ("distinct_values", "kurtosis", "skewness")], F.lit(0)).alias("score"))


def coverage(ranges: DataFrame) -> DataFrame:
    """(bin, covering) for ranges (lo, hi): how many ranges cover a bin."""
    return ranges.select(F.explode(F.sequence("lo", "hi")).alias("bin")).groupBy("bin").agg(F.count("*").alias("covering"))


def weighted_benefit(ranges: DataFrame, bins: int) -> DataFrame:
    """(bin, weight): 1 plus the errors of the ranges (lo, hi, error) over a bin."""
    frame = ranges.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    added = ranges.select(F.explode(F.sequence("lo", "hi")).alias("bin"), "error").groupBy("bin").agg(F.sum("error").alias("e"))
    return frame.join(added, "bin", "left").select("bin", (F.coalesce("e", F.lit(0.0)) + 1.0).alias("weight"))


def flat_index(columns: list[Column], sizes: list[int]) -> Column:
    """Row-major number of a cell."""
    out = F.lit(0).cast("long")
    for c, s in zip(columns, sizes, strict=True):
        out = out * s + c
    return out


def multi_index(flat: Column, sizes: list[int]) -> list[Column]:
    out = []
    for s in reversed(sizes):
        out.append(flat % s)
        flat = F.floor(flat / s)
    return out[::-1]
