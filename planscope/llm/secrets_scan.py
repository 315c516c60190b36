"""Secret scan with an incremental ledger of blobs: every text is a blob named by its SHA-256, and only
(blob, rule version) pairs that the ledger does not hold yet are scanned; findings join back to all paths.

The ledger is a table ``(blob, rules, findings)``, appended to by each run: ``rules`` are the rules, each with its version, that a
run tried on the blob, ``findings`` what they found. A rule that is new or has a new version is tried on every blob, the others
only on new blobs. A path is a row of the input: many paths, and many versions of a path, can share a blob, which is then scanned
once. The distinct blobs are found with a partially aggregated ``groupBy(blob)``, so a text with a third of all rows is reduced on
the map side before the shuffle; with a ledger only the texts of blobs that have unseen pairs are fetched at all. The join back
carries only ids and findings.

All on the main path is DataFrame/SQL: positions come from the pieces that ``split`` leaves and the matches that
``regexp_extract_all`` returns, both leftmost and non-overlapping, as running sums of their lengths (a window within a blob), so
the work is linear in the text and its matches.

Defined cases: null text is the empty blob without findings; repeated rows are paths of one blob; a rule's
matches never overlap one another, those of different rules may; spans are code points, end exclusive,
ordered by start, then by the order of the rules. Texts are scanned whole. Other columns of the input are kept
by ``scan`` unless they are named like its outputs.
"""

from __future__ import annotations

from dataclasses import dataclass

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planscope.llm.common import shared_folder
from planscope.llm.url_filter import may_contain


@dataclass(frozen=True)
class Rule:
    """``pattern`` must have group ``group``, at least ``least`` characters of which make a match count."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1
    base: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}.{self.version}"


#: The base rules first, in the order that breaks ties; those of the method follow.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12, base=True),
    Rule("access", r"(AKIA[A-Z0-9]+)", 1, 18, base=True),
    Rule("hex", r"([0-9a-f]+)", 1, 16, base=True),
    Rule("private_key", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 1),
    Rule("github", r"(gh[pousr]_[A-Za-z0-9]+)", 1, 40),
    Rule("jwt", r"(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 1, 40),
    Rule("slack", r"(xox[abprs]-[A-Za-z0-9-]+)", 1, 20),
)

FINDINGS = "array<struct<start:bigint,rule:int,kind:string,end:bigint>>"


def rule_lengths(text: Column, rule: Rule) -> Column:
    """For each stretch of ``text`` up to and with a match: lengths of the gap before it, of the match and of its
    group; null if no match is long enough, which one search settles."""
    pattern = F.lit(rule.pattern)
    pieces = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group > 1 else whole
    lengths = F.arrays_zip(
        F.transform(pieces, F.char_length).alias("gap"), F.transform(whole, F.char_length).alias("len"), F.transform(part, F.char_length).alias("part")
    )
    least = rule.pattern if rule.group > 1 else rule.pattern[:-2] + f"{{{_more(rule)},}})" if rule.base else rule.pattern
    return F.when(text.rlike(least), lengths)


def _more(rule: Rule) -> int:
    """Repetitions of the last class that a match of the least length has at least."""
    return rule.least - (4 if rule.kind == "access" else 0)


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _unseen(ids: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rules): the names of the rules that each of the blobs ``ids`` still lacks, if any."""
    known = ledger.select("blob", F.explode("rules").alias("rule")).where(F.col("rule").isin([r.name for r in rules]))
    known = known.groupBy("blob").agg(F.collect_set("rule").alias("known"))  # no more than there are rules
    every = F.array(*[F.lit(r.name) for r in rules])
    left = ids.join(known, "blob", "left").select("blob", F.array_except(every, F.coalesce("known", F.array().cast("array<string>"))).alias("rules"))
    return left.where(F.size("rules") > 0)


def scan_new_pairs(docs: DataFrame, ledger: DataFrame | None, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rules, findings): the ledger rows that ``docs`` add to ``ledger``."""
    rows = docs.select(blob_id(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    every = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        blobs = rows.groupBy("blob").agg(F.first("text").alias("text")).withColumn("rules", every)
    else:
        unseen = _unseen(rows.select("blob").distinct(), ledger, rules)
        # (a Bloom filter keeps the texts of seen blobs out of the shuffle; the join is exact)
        blobs = may_contain(rows, "blob", unseen, "blob").groupBy("blob").agg(F.first("text").alias("text")).join(unseen, "blob")
    tried = [F.struct(F.lit(i).alias("rule"), F.when(F.array_contains("rules", r.name), rule_lengths(F.col("text"), r)).alias("x")) for i, r in enumerate(rules)]
    # one more element, so that a blob without findings has a row too
    none = F.struct(F.lit(-1).alias("rule"), F.array(F.struct(F.lit(0).alias("gap"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("int").alias("part"))).alias("x"))
    each = blobs.select("blob", "rules", F.explode(F.array(none, *tried)).alias("r")).where(F.col("r.x").isNotNull())
    each = each.select("blob", "rules", "r.rule", F.posexplode("r.x").alias("pos", "x"))
    upto = Window.partitionBy("blob", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("x.gap") + F.coalesce("x.len", F.lit(0))).cast("bigint")).over(upto)
    kind, least = (F.element_at(F.array(*[F.lit(getattr(r, k)) for r in rules]), F.greatest(F.col("rule"), F.lit(0)) + 1) for k in ("kind", "least"))
    found = F.struct((F.col("end") - F.col("x.len")).alias("start"), F.col("rule"), kind.alias("kind"), F.col("end").alias("end"))
    each = each.withColumn("end", end).select("blob", "rules", F.when((F.col("rule") >= 0) & (F.col("x.part") >= least), found).alias("found"))
    # a text has no more findings than characters
    return each.groupBy("blob").agg(F.first("rules").alias("rules"), F.array_sort(F.collect_list("found")).cast(FINDINGS).alias("findings"))


def record(docs: DataFrame, path: str, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at ``path`` lacks, append it, and return the ledger. ``path``: a folder that all executors share."""
    spark = docs.sparkSession
    try:
        ledger = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        ledger = None
    scan_new_pairs(docs, ledger, text_col=text_col, rules=rules).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def scan(docs: DataFrame, ledger: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with blob and findings of the current rules, as ``ledger`` has them."""
    own = ["blob", "findings"]
    current = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.struct(F.lit(i).alias("rule"), F.lit(r.name).alias("name")))])
    # blobs without findings need not travel: paths that find nothing in the join have none
    found = ledger.where(F.size("findings") > 0)
    # findings of the rules and versions at hand, with the rules' present numbers
    mine = F.filter("findings", lambda f: F.coalesce(F.array_contains("rules", F.element_at(current, f["kind"])["name"]), F.lit(False)))
    mine = F.transform(mine, lambda f: F.struct(f["start"].alias("start"), F.element_at(current, f["kind"])["rule"].alias("rule"), f["kind"].alias("kind"), f["end"].alias("end")))
    found = found.select("blob", mine.alias("findings")).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("findings")))).alias("findings"))
    found = found.repartition(F.xxhash64("blob"))  # so that the join has exchanges of its own, which adaptive execution can split
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    paths = docs.select(*kept, blob_id(F.col(text_col)).alias("blob"))
    return paths.join(found, "blob", "left").select(*kept, "blob", F.coalesce(F.col("findings"), F.array().cast(FINDINGS)).alias("findings"))


def span_text(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    """A ledger of its own, in the folder that driver and executors share."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledger = record(docs, f"{shared_folder(spark)}/secret-ledger-{uuid4().hex}")
    found = scan(docs, ledger).select("doc_id", "findings")
    n_base = sum(r.base for r in RULES)
    base = F.filter("findings", lambda f: f["rule"] < n_base)
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("findings")).alias("spans"),
    )


def _oracle() -> str:
    """Spans from the pieces and matches of each rule, in DuckDB."""
    part = """SELECT doc_id, {n} AS rule, '{kind}' AS kind, {base} AS base, pos[1] AS "start", pos[1] + len(m[i]) AS "end" FROM (
      SELECT doc_id, m, g, i, [list_sum([len(x) FOR x IN s[1:i]]) + coalesce(list_sum([len(x) FOR x IN m[1:i - 1]]), 0)] AS pos FROM (
        SELECT doc_id, s, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
          SELECT doc_id, string_split_regex(t, '{p}') AS s, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {g}) AS g
          FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))) WHERE len(g[i]) >= {least}"""
    rows = " UNION ALL ".join(part.format(n=i, kind=r.kind, base=r.base, p=r.pattern.replace("'", "''"), g=r.group, least=r.least) for i, r in enumerate(RULES))
    return f"""WITH f AS ({rows}), a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
      count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", rule) FILTER (base) AS b,
      string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", rule) AS spans FROM f GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents LEFT JOIN a USING (doc_id)"""


ORACLE = _oracle()
